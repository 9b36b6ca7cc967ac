"""A training-data pipeline of five stages over the documents table.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of documents.
A stage begins by deleting the steps of those before it, so a stage's result is
to be written, or to be the next stage's ``docs``, before another one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import near_copies, paragraphs, tiling, toxicity
from quirelake.llm import queries as registered
from quirelake.llm._shared import stage, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    with stage(docs):
        return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash within 2 bits, or five-word Jaccard of 0.8) stays, that with the smallest id."""
    with stage(docs):
        return near_copies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs stay in their first document only; n_chars follows the text."""
    with stage(docs):
        return paragraphs.deduplicated(docs, into="_cut").drop("_cut").withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    with stage(docs):
        return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the decoded bytes."""
    with stage(docs, last=True):
        return registered.with_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: The stages fit models and follow similarity links, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}

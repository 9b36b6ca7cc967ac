"""Runs the engine on a folder of structured documents: configuration, steps and command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import headings
from .operators import corpus, extract, metrics, process
from .sources import records, tei


@dataclass(frozen=True)
class EngineConfig:
    """What to read and what to write.

    ``path``: folder of ``*.tei.xml`` files.  ``out``: folder of the results.
    ``mode``: one record a line (jsonl), a folder per document (stem) or one
    list (array).  ``dedup``: only the first paper of each DOI or title.
    ``review``: treat every paper as a review.  ``tei_out``: keep the documents
    there.  ``reports``: corpus reports and media tables.  ``lookups``: folder
    with Parquet tables by_doi, by_title and pubmed.
    """

    path: str
    out: str
    mode: str = "jsonl"
    dedup: bool = False
    review: bool = False
    tei_out: str | None = None
    reports: bool = False
    lookups: str | None = None

    def __post_init__(self):
        if self.mode not in ("jsonl", "stem", "array"):
            raise ValueError(f"no such mode: {self.mode}")


def papers_of(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """The records of all documents below the path, with doc_id and stem."""
    found = tei.read_tei(spark, config.path).withColumn("doc_id", F.xxhash64("path"))
    if config.tei_out:
        records.write_tei(found.select("stem", "xml"), config.tei_out)
    known = process.Lookups()
    if config.lookups:
        known = process.Lookups(*[spark.read.parquet(f"{config.lookups}/{n}.parquet") for n in ("by_doi", "by_title", "pubmed")])
    out = process.process(found, known, config.review).join(found.select("doc_id", "stem"), "doc_id")
    if config.dedup:
        flat = out.withColumns({"doi": F.col("meta.doi"), "title": F.col("meta.title"), "path": F.col("meta.source_path")})
        out = corpus.dedup_papers(flat).drop("doi", "title", "path")
    return out


def run(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """Writes what the configuration asks for and returns the records, read back."""
    papers, path = papers_of(spark, config), f"{config.out}/records"
    if config.mode == "jsonl":
        records.write_jsonl(papers.drop("doc_id", "stem"), path)
    elif config.mode == "stem":
        records.write_json_by_stem(papers.drop("doc_id"), path)
    else:
        records.write_json_array(papers.drop("doc_id", "stem"), path)
    readers = {"jsonl": records.read_jsonl, "stem": records.read_json_by_stem, "array": records.read_json_array}
    written = readers[config.mode](spark, path)
    if config.reports:
        keyed = written.withColumn("doc_id", F.xxhash64("meta.source_path"))
        heads = tei.read_tei(spark, config.path)
        named = heads.select(F.xxhash64("path").alias("doc_id"), F.concat("stem", F.lit(".tei")).alias("stem"), "xml")
        found = extract.heads(named).join(named.select("doc_id", "stem"), "doc_id").select("stem", F.col("pre").alias("ord"), "head")
        measured = metrics.document_metrics(keyed, found)
        often = metrics.sample_frequencies(measured)
        records.write_corpus_reports(measured, corpus.with_gates(corpus.summary(measured)), often, headings.suggestions(often), f"{config.out}/reports")
        for kind in ("figures", "tables"):
            records.write_csv(records.media_rows(written, kind), f"{config.out}/reports/{kind}_csv")
    return written


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quirelake", description="Structured documents to paper records.")
    out.add_argument("path")
    out.add_argument("--out", required=True)
    out.add_argument("--mode", choices=("jsonl", "stem", "array"), default="jsonl")
    for flag in ("dedup", "review", "reports"):
        out.add_argument(f"--{flag}", action="store_true")
    out.add_argument("--tei-out")
    out.add_argument("--lookups")
    return out


def main(argv: list[str] | None = None) -> int:
    given = vars(parser().parse_args(argv))
    config = EngineConfig(**{f.name: given[f.name] for f in fields(EngineConfig)})
    spark = SparkSession.builder.appName("quirelake").getOrCreate()
    print(f"{run(spark, config).count()} records in {config.out}")
    return 0

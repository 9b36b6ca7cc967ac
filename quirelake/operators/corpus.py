"""Corpus level: deduplication, metrics of documents, summary, gates, heading frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import match_key

GATES = (
    ("title", "title_rate", 0.99, True), ("doi_or_journal", "doi_or_journal_rate", 0.95, True), ("abstract", "abstract_rate", 1.0, True),
    ("sections3", "sections3_rate", 0.85, True), ("mapping", "mapping_rate", 0.5, True), ("noise", "mean_noise", 0.02, False),
    ("duplicates", "duplicate_rate", 0.01, False),
)


def dedup_papers(papers: DataFrame, path: str = "path") -> DataFrame:
    """The first paper by path of each DOI, or of each title among those without DOI; papers with neither all stay."""
    kind = F.when(match_key(F.col("doi")).isNotNull(), "doi").when(match_key(F.col("title")).isNotNull(), "title")
    key = F.coalesce(match_key(F.col("doi")), match_key(F.col("title")))
    # papers without key are spread by their path: they must not meet in one task
    spread = F.coalesce(key, F.concat(F.lit("\x00"), F.col(path)))
    n = F.row_number().over(W.partitionBy("_kind", "_key").orderBy(path))
    return papers.withColumn("_kind", kind).withColumn("_key", spread).withColumn("_n", n).where("_n = 1 or _kind is null").drop("_kind", "_key", "_n")


def duplicate_keys(papers: DataFrame) -> DataFrame:
    """(kind, value, n): DOIs (as written) and titles (lower case) that occur more than once."""
    doi = papers.select(F.lit("doi").alias("kind"), F.col("doi").alias("value"))
    title = papers.select(F.lit("title").alias("kind"), match_key(F.col("title")).alias("value"))
    return doi.unionByName(title).where("coalesce(value, '') <> ''").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """Counts and rates over documents, for the corpus or by columns.

    Needs the columns of ``metrics.document_metrics``.
    """
    c = lambda cond, name: F.count_if(cond).alias(name)
    grouped = metrics.groupBy(*by) if by else metrics.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("docs"),
        c(F.col("has_title"), "with_title"), c(F.col("has_doi_or_journal"), "with_doi_or_journal"), c(F.col("has_abstract"), "with_abstract"),
        *[c(F.col("n_sections") >= k, f"with_{k}_sections") for k in (3, 4, 5)],
        c(F.col("figures_count") + F.col("tables_count") > 0, "with_media"), c(F.col("images_existing") > 0, "with_media_files"),
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("heads_total", "mapped_heads", "unmapped_heads", "noncontent_heads")],
        F.coalesce(F.avg("noise"), F.lit(0.0)).alias("mean_noise"),
    )


def with_gates(s: DataFrame, duplicates: Column | None = None) -> DataFrame:
    """Adds a boolean per gate and ``gates_pass``; rates of nothing pass."""
    rate = lambda n, d: F.try_divide(n, d)
    rates = {
        "title_rate": rate(F.col("with_title"), F.col("docs")),
        "doi_or_journal_rate": rate(F.col("with_doi_or_journal"), F.col("docs")),
        "abstract_rate": rate(F.col("with_abstract"), F.col("docs")),
        "sections3_rate": rate(F.col("with_3_sections"), F.col("docs")),
        "mapping_rate": rate(F.col("mapped_heads"), F.col("heads_total")),
        "mean_noise": F.col("mean_noise"),
        "duplicate_rate": rate(duplicates if duplicates is not None else F.lit(0), F.col("docs")),
    }
    for name, of, bar, at_least in GATES:
        value = rates[of]
        s = s.withColumn(f"gate_{name}", F.coalesce(value >= bar if at_least else value <= bar, F.lit(True)))
    passes = F.lit(True)
    for name, *_ in GATES:
        passes = passes & F.col(f"gate_{name}")
    return s.withColumn("gates_pass", passes)


def head_frequencies(heads: DataFrame, doc: str = "doc_id", ord_: str = "ord", head: str = "head", samples: int = 8) -> DataFrame:
    """(head, n, first_doc, first_ord): how often each heading is among the first ``samples`` of a document, in order of first sight on ties."""
    n = F.row_number().over(W.partitionBy(doc).orderBy(ord_))
    few = heads.withColumn("_n", n).where(F.col("_n") <= samples)
    at = F.min(F.struct(doc, ord_))
    return few.groupBy(head).agg(F.count(F.lit(1)).alias("n"), at.alias("_at")).select(head, "n", F.col(f"_at.{doc}").alias("first_doc"), F.col(f"_at.{ord_}").alias("first_ord"))


def source_totals(items: DataFrame, source: str = "source", *by: str) -> DataFrame:
    return items.groupBy(*by, F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))

"""Metrics of paper records: coverage, media, headings and noise, one row a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headings import CANONICAL, classify, is_boilerplate
from ..functions.text import file_stem, noise_ratio

#: Sections whose presence counts as coverage.
COVERED = ("introduction", "materials_and_methods", "results", "discussion", "conclusions")
#: Headings that come to an abstract are no mapped section.
MAPPED = tuple(k for k in CANONICAL if k != "abstract")
#: Unmapped headings that a document gives as samples.
SAMPLES = 8


def joined_sections(sections: Column) -> Column:
    """The texts of all sections that have one, an empty line between."""
    return F.array_join(F.filter(F.map_values(sections), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")


def coverage(sections: Column) -> Column:
    """Which of the covered sections have text, as a struct of booleans."""
    return F.struct(*[(F.coalesce(F.try_element_at(sections, F.lit(k)), F.lit("")) != "").alias(k) for k in COVERED])


def head_counts(heads: DataFrame, by: str = "stem", ord_: str = "ord", head: str = "head") -> DataFrame:
    """(by, heads_total, mapped_heads, unmapped_heads, noncontent_heads, unmapped_samples) of a (by, ord, head) table."""
    key = F.col("section")
    mapped, plain = key.isin(list(MAPPED)), is_boilerplate(key)
    rest = ~mapped & ~plain
    samples = F.slice(F.array_sort(F.collect_list(F.when(rest, F.struct(F.col(ord_).alias("o"), F.col(head).alias("h"))))), 1, SAMPLES)
    return classify(heads, head, "section").groupBy(by).agg(
        F.count(F.lit(1)).alias("heads_total"), F.count_if(mapped).alias("mapped_heads"), F.count_if(rest).alias("unmapped_heads"),
        F.count_if(plain).alias("noncontent_heads"), F.transform(samples, lambda s: s["h"]).alias("unmapped_samples"),
    )


def media_counts(papers: DataFrame, files: DataFrame | None, key: str) -> DataFrame:
    """(key, images_with_paths, images_existing, images_sources) of records with media.

    ``files`` is a (path, length) listing; an item exists if its path is in it.
    Sources are a map of counts, ``unknown`` where there is none.
    """
    items = papers.select(key, F.explode(F.concat("figures", "tables")).alias("m")).select(key, F.nullif("m.path", F.lit("")).alias("path"), F.coalesce(F.nullif("m.source", F.lit("")), F.lit("unknown")).alias("source"))
    if files is None:
        items = items.withColumn("length", F.lit(None).cast("long"))
    else:
        items = items.join(files.select("path", "length").groupBy("path").agg(F.max("length").alias("length")), "path", "left")
    each = items.groupBy(key, "source").agg(F.count("path").alias("paths"), F.count("length").alias("existing"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(
        F.sum("paths").alias("images_with_paths"), F.sum("existing").alias("images_existing"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("images_sources"),
    )


def document_metrics(papers: DataFrame, heads: DataFrame, files: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """One row per record of ``papers``, also for records without headings or media.

    ``heads`` is (stem, ord, head); a record's stem is the file name of its
    source path without its last extension.  Noise is taken over the texts of
    all its sections.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    abstract = F.coalesce(F.try_element_at("sections", F.lit("abstract")), F.lit(""))
    covered = coverage(F.col("sections"))
    base = papers.select(
        key, F.coalesce("meta.source_path", F.lit("")).alias("file"), file_stem(F.col("meta.source_path")).alias("stem"), F.col("meta.title").alias("title"),
        F.col("meta.doi").alias("doi"), F.col("meta.journal").alias("journal"), has("meta.title").alias("has_title"), (has("meta.doi") | has("meta.journal")).alias("has_doi_or_journal"),
        F.length(abstract).alias("abstract_len"), (F.length(abstract) >= 30).alias("has_abstract"), F.size("sections").alias("sections_count"), F.size("other_sections").alias("other_sections_count"),
        covered.alias("coverage"), sum((covered[k].cast("int") for k in COVERED), F.lit(0)).alias("n_sections"),
        F.size("figures").alias("figures_count"), F.size("tables").alias("tables_count"), noise_ratio(joined_sections(F.col("sections"))).alias("noise"),
    )
    counted = base.join(head_counts(heads), "stem", "left").join(media_counts(papers, files, key), key, "left").drop("stem")
    counts = ("heads_total", "mapped_heads", "unmapped_heads", "noncontent_heads", "images_with_paths", "images_existing")
    return counted.withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}
        | {"unmapped_samples": F.coalesce("unmapped_samples", F.array().cast("array<string>")), "images_sources": F.coalesce("images_sources", F.create_map().cast("map<string,bigint>"))}
    )


def sample_frequencies(metrics: DataFrame, key: str = "doc_id") -> DataFrame:
    """(head, n, first_doc, first_ord): how often each unmapped heading is among the samples."""
    rows = metrics.select(F.col(key).alias("doc"), F.posexplode("unmapped_samples").alias("ord", "head"))
    return rows.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "ord")).alias("at")).select("head", "n", F.col("at.doc").alias("first_doc"), F.col("at.ord").alias("first_ord"))

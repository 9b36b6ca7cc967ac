"""From structured documents to finished paper records, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_stem
from ..sources.records import MEDIA, REFERENCE, stored
from . import enrich, extract, media

_TEXTS = "map<string,string>"


def _no_texts() -> Column:
    return F.create_map().cast(_TEXTS)


@dataclass(frozen=True)
class Lookups:
    """Tables that stand in for bibliographic services; None means nothing is known."""

    by_doi: DataFrame | None = None
    by_title: DataFrame | None = None
    pubmed: DataFrame | None = None


def merged_media(papers: DataFrame, kind: str = "tables") -> DataFrame:
    """``papers`` with equal entries of one kind merged into one, in first-seen order.

    The rules are those of ``media.merge_tables``, here within each record's
    own list, so no row moves.
    """
    text = lambda m, c: F.nullif(F.trim(F.coalesce(m[c], F.lit(""))), F.lit(""))
    named = lambda prefix, value: F.concat(F.lit(prefix), value)

    def keyed(m, i):
        key = F.coalesce(
            named("caption:", F.lower(text(m, "caption"))), named("label:", F.lower(text(m, "label"))), named("path:", F.nullif(m["path"], F.lit(""))), named("row:", i.cast("string"))
        )
        return F.struct(key.alias("key"), m.alias("m"))

    def one(group):
        first = lambda c: F.get(F.filter(F.transform(group, lambda g: g["m"][c]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
        box = F.get(F.filter(F.transform(group, lambda g: g["m"]["pdf_bbox"]), lambda x: x.isNotNull()), F.lit(0))
        sources = F.filter(F.transform(group, lambda g: g["m"]["source"]), lambda x: F.coalesce(x, F.lit("")) != "")
        merged = F.get(group, F.lit(0))["m"]
        for c in ("label", "caption", "coords", "path"):
            merged = merged.withField(c, first(c))
        return merged.withField("pdf_bbox", box).withField("source", F.nullif(F.array_join(F.array_sort(F.array_distinct(sources)), "+"), F.lit("")))

    rows = F.transform(kind, keyed)
    keys = F.array_distinct(F.transform(rows, lambda r: r["key"]))
    return papers.withColumn(kind, F.transform(keys, lambda k: one(F.filter(rows, lambda r: r["key"] == k))).cast(papers.schema[kind].dataType))


def filtered_media(papers: DataFrame) -> DataFrame:
    """Of each page of a document the crops, or its other images if it has no crop; entries without a page stay."""
    page = lambda m: F.nullif(F.regexp_extract(F.coalesce(m["path"], F.lit("")), "page(\\d+)_", 1), F.lit(""))
    is_crop = lambda m: F.coalesce(m["path"].rlike("_crop\\d*\\."), F.lit(False))
    cropped = F.transform(F.filter(F.concat("figures", "tables"), is_crop), page)
    keep = lambda m: page(m).isNull() | is_crop(m) | ~F.coalesce(F.array_contains("_cropped", page(m)), F.lit(False))
    marked = papers.withColumn("_cropped", cropped)
    return marked.withColumns({k: F.filter(k, keep) for k in ("figures", "tables")}).drop("_cropped")


def reviewed(papers: DataFrame, force: bool = False) -> DataFrame:
    """Reviews get more methods and discussion from their other sections."""
    others = F.transform(F.map_entries("other_sections"), lambda e: F.struct(e["key"].alias("head"), e["value"].alias("text")))
    section = lambda k: F.try_element_at("sections", F.lit(k))
    made = enrich.augmented(others, section("materials_and_methods"), section("discussion"))
    entries = F.concat(
        F.filter(F.map_entries("sections"), lambda e: ~e["key"].isin("materials_and_methods", "discussion")),
        F.filter(
            F.array(*[F.struct(F.lit(k).alias("key"), F.col("_made")[k].alias("value")) for k in ("materials_and_methods", "discussion")]), lambda e: e["value"].isNotNull()
        ),
    )
    applies = F.lit(force) | enrich.is_review(F.col("meta.title"), F.col("meta.journal"), F.map_keys("other_sections"))
    return papers.withColumn("_made", made).withColumn("sections", F.when(applies, F.map_from_entries(entries)).otherwise(F.col("sections"))).drop("_made")


def with_abstracts(papers: DataFrame, lookups: Lookups) -> DataFrame:
    """Missing or short abstracts are looked up; see ``enrich.ensure_abstract``."""
    spark = papers.sparkSession
    # a table that the optimizer sees to be empty, so that records aren't shuffled for a join with nothing
    empty = spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast("string").alias(c) for c in ("doi", "title", "journal", "abstract")])
    flat = papers.withColumns({"abstract": F.try_element_at("sections", F.lit("abstract")), "doi": F.col("meta.doi"), "title": F.col("meta.title"), "journal": F.col("meta.journal")})
    tables = [empty if t is None else t for t in (lookups.by_doi, lookups.by_title, lookups.pubmed)]
    out = enrich.ensure_abstract(flat, *tables)
    others = F.filter(F.map_entries("sections"), lambda e: e["key"] != "abstract")
    own = F.when(F.col("abstract").isNotNull(), F.array(F.struct(F.lit("abstract").alias("key"), F.col("abstract").alias("value")))).otherwise(F.slice(others, 1, 0))
    meta = F.struct(F.col("meta.source_path"), "title", "journal", "doi", F.col("meta.authors"), F.col("meta.keywords"))
    return out.withColumns({"sections": F.map_from_entries(F.concat(own, others)), "meta": meta}).drop("abstract", "doi", "title", "journal")


def prefixed_labels(papers: DataFrame) -> DataFrame:
    """Labels of the documents' own media begin with Figure or Table."""

    def labelled(name: str):
        return lambda m: m.withField("label", media.prefixed_label(name, m["label"], m["source"]))

    return papers.withColumns({kind: F.transform(kind, labelled(name)) for kind, name in (("figures", "Figure"), ("tables", "Table"))})


def empty_records(rows: DataFrame, path: Column) -> DataFrame:
    """A record with nothing but its source path for each row of (doc_id, ...)."""
    none = F.lit(None).cast("string")
    people = F.lit(None).cast("array<struct<name: string, affiliation: string>>")
    meta = F.struct(path.alias("source_path"), none.alias("title"), none.alias("journal"), none.alias("doi"), people.alias("authors"), F.lit(None).cast("array<string>").alias("keywords"))
    empty = {"sections": _no_texts(), "other_sections": _no_texts()}
    lists = {k: F.array().cast(f"array<{t}>") for k, t in (("figures", MEDIA), ("tables", MEDIA), ("references", REFERENCE))}
    return rows.select("doc_id", meta.alias("meta"), *[c.alias(k) for k, c in (empty | lists).items()])


def process(tei: DataFrame, lookups: Lookups | None = None, force_review: bool = False, path: str = "path") -> DataFrame:
    """One record per row of ``tei`` (doc_id, path, xml), in the stages' fixed order.

    Parse, merge tables, filter media, augment reviews, ensure abstracts, prefix
    labels, merge and filter again.  A document that can't be parsed gets an
    empty record, so no input is lost; ids are unique.  Raw records are stored
    on the way, so no document is parsed twice; but for lookups nothing moves.
    """
    whole = {"sections": _TEXTS, "other_sections": _TEXTS, "figures": f"array<{MEDIA}>", "tables": f"array<{MEDIA}>", "references": f"array<{REFERENCE}>"}
    empty = {k: _no_texts() if t == _TEXTS else F.array().cast(t) for k, t in whole.items()}

    def in_full(kind):
        add = lambda m: F.struct(*[m[c] for c in ("label", "caption", "path", "source", "coords")], F.lit(None).alias("pdf_bbox"), F.lit(None).alias("csv_path"))
        return F.transform(kind, add).cast(f"array<{MEDIA}>")

    raw = stored(extract.papers(tei, path, errors=True).withColumns({k: in_full(k) for k in ("figures", "tables")}), "raw")
    records = raw.where("error is null").withColumns({k: F.coalesce(F.col(k).cast(t), empty[k]) for k, t in whole.items()})
    for stage in (
        merged_media, filtered_media, lambda r: reviewed(r, force_review), lambda r: with_abstracts(r, lookups or Lookups()),
        prefixed_labels, merged_media, filtered_media,
    ):
        records = stage(records)
    records = records.select("doc_id", "meta", *whole)
    lost = empty_records(raw.where("error is not null"), F.col("meta.source_path"))
    return records.unionByName(lost)


def sample_summary(papers: DataFrame, most: int = 12) -> DataFrame:
    """(source_path, stem, title, doi, journal, section_names, figures_count, tables_count): one row a record, at most ``most`` section names."""
    return papers.select(
        F.col("meta.source_path").alias("source_path"), file_stem(F.col("meta.source_path")).alias("stem"), F.col("meta.title").alias("title"), F.col("meta.doi").alias("doi"),
        F.col("meta.journal").alias("journal"), F.slice(F.map_keys("sections"), 1, most).alias("section_names"), F.size("figures").alias("figures_count"), F.size("tables").alias("tables_count"),
    )

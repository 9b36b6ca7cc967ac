"""What structured documents say: metadata, sections, media and references.

Each function takes documents (doc_id, xml), which are parsed on the way, or
their node table, which is brought together by document first; ``trees`` has
what is done with one document.  Nothing else is shuffled, and no document
meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK
from . import trees


class _Pages:
    """``trees.pages`` of one path."""

    def __init__(self, path: str | None):
        self.path = path

    def __call__(self, tree):
        return trees.pages(tree, self.path)


def titles(source: DataFrame) -> DataFrame:
    return trees.each(source, trees.title, "title string")


def dois(source: DataFrame) -> DataFrame:
    return trees.each(source, trees.doi, "doi string")


def journals(source: DataFrame) -> DataFrame:
    return trees.each(source, trees.journal, "journal string")


def metadata(source: DataFrame) -> DataFrame:
    """(doc_id, title, doi, journal), a row for each document."""
    return trees.each(source, trees.metadata, "title string, doi string, journal string")


def authors(source: DataFrame) -> DataFrame:
    """(doc_id, n, name, affiliation) in document order; authors with neither are left out.

    An affiliation is its organisation names and address parts joined by commas
    (its whole text without any); equal parts and affiliations, whatever their
    case, count once.
    """
    return trees.each(source, trees.authors, "n int, name string, affiliation string")


def heads(source: DataFrame) -> DataFrame:
    """(doc_id, pre, head) of all headings of body divisions."""
    return trees.each(source, trees.heads, "pre int, head string")


def body_sections(source: DataFrame) -> DataFrame:
    """(doc_id, ord, head, key, text, canonical): the sections of each body.

    A division with a heading of its own counts with all paragraphs below it,
    nested ones too; boilerplate and figure or table headings are left out.
    Sections of one canonical key (or, outside these, of one heading) are one,
    their texts joined by an empty line in document order.
    """
    return trees.each(source, trees.sections, "ord int, head string, key string, text string, canonical boolean")


def keywords(source: DataFrame) -> DataFrame:
    """(doc_id, keywords): in order, the first of those that differ in case only."""
    return trees.each(source, trees.keywords, "keywords array<string>")


def abstracts(source: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(doc_id, abstract): a body section named so, else the header's; keywords are appended, with a blank at the end.

    The sections are the documents' own, or those of ``sections`` (as of
    ``body_sections``), which are joined by ``doc_id``.
    """
    if sections is None:
        return trees.each(source, trees.abstract, "abstract string")
    own = sections.where("key = 'abstract'").select("doc_id", F.col("text").alias("own"))
    out = trees.each(source, trees.abstract_parts, "header string, keywords array<string>").join(own, "doc_id", "left")
    text, listed = F.coalesce("own", "header"), F.array_join("keywords", ", ")
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+$", "")
    whole = F.when(F.col("keywords").isNull(), text).when(bare == "", F.concat(listed, F.lit(" "))).otherwise(F.concat(bare, F.lit(" "), listed, F.lit(" ")))
    return out.select("doc_id", whole.alias("abstract")).where("abstract is not null")


def pages(source: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, pre, nth, page): the page that each element (on a path, if one is given) stands on.

    An as-of join on document order: the nearest page break before it, which must have a number.
    """
    return trees.each(source, _Pages(path), "pre int, nth int, page int")


def _number(x: Column) -> Column:
    return F.regexp_replace(F.call_function("format_number", x, F.lit("0.0###############")), ",", "")


def coordinates(coords: Column, page: Column) -> Column:
    """``page,x,y,w,h``: of five numbers or more the first five, of four with the page before; else null."""
    numbers = F.filter(F.transform(F.split(coords, f"(?:[;,]|{BLANK})+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())

    def written(n: Column) -> Column:
        at = lambda i: _number(F.get(n, F.lit(i)))
        five = F.concat_ws(",", F.get(n, F.lit(0)).cast("long").cast("string"), *[at(i) for i in range(1, 5)])
        four = F.concat_ws(",", page.cast("string"), *[at(i) for i in range(4)])
        return F.when(F.size(n) >= 5, five).when((F.size(n) == 4) & page.isNotNull(), four)

    # the numbers are read once
    return F.element_at(F.transform(F.array(numbers), written), 1)


def _zone(z: Column) -> Column:
    """``page,x,y,w,h`` of a facsimile zone; null unless its page and corners are numbers."""
    ulx, uly, lrx, lry = (z[k].try_cast("double") for k in ("ulx", "uly", "lrx", "lry"))
    sides = (ulx, uly, F.greatest(F.lit(0.0), lrx - ulx), F.greatest(F.lit(0.0), lry - uly))
    made = F.concat(z["page"], *[F.concat(F.lit(","), _number(x)) for x in sides])
    return F.when(z["page"].rlike("^\\d+$") & ulx.isNotNull() & uly.isNotNull() & lrx.isNotNull() & lry.isNotNull(), made)


def _where(raw: Column, page: Column, zones: Column) -> Column:
    """Coordinates of a figure: its graphic's, else those of the first zone it names."""
    of_zones = F.get(F.filter(F.transform(zones, _zone), lambda z: z.isNotNull()), F.lit(0))
    return F.coalesce(coordinates(raw, page), of_zones)


_ZONES = "array<struct<page: string, ulx: string, uly: string, lrx: string, lry: string>>"


def media(source: DataFrame) -> DataFrame:
    """(doc_id, kind, stage, pre, label, caption, source, coords): figures and tables, first wins.

    Stage 0 are figure elements, 1 table elements, 2 references to tables and 3
    paragraphs that begin like a table caption; a later stage only adds tables
    whose label no earlier one has.
    """
    found = trees.each(source, trees.media, f"kind string, stage int, pre int, label string, caption string, source string, raw string, page int, zones {_ZONES}")
    return found.select("doc_id", "kind", "stage", "pre", "label", "caption", "source", _where(F.col("raw"), F.col("page"), F.col("zones")).alias("coords"))


def references(source: DataFrame) -> DataFrame:
    """(doc_id, index, text, id, title, doi, year, authors) of the bibliography, numbered from 1 in document order."""
    return trees.each(source, trees.references, "index int, text string, id string, title string, doi string, year string, authors array<string>")


_PAIRS = "array<struct<key: string, value: string>>"
_RECORD = (
    f"title string, journal string, doi string, authors array<struct<name: string, affiliation: string>>, keywords array<string>, sections {_PAIRS}, other_sections {_PAIRS}, "
    f"media array<struct<kind: string, stage: int, pre: int, label: string, caption: string, source: string, raw: string, page: int, zones: {_ZONES}>>, "
    "references array<struct<index: int, text: string, id: string, title: string, doi: string, year: string, authors: array<string>>>"
)


def papers(source: DataFrame, path: str | None = None, errors: bool = False) -> DataFrame:
    """One nested record per document, as the record schema has it; maps are built here, last of all.

    ``path`` names the column of documents that becomes ``source_path``.  With
    ``errors`` a document that can't be parsed has a row too, and ``error`` says why.
    """
    given = source if path is None else source.withColumn("source_path", F.col(path))
    found = trees.each(given, trees.record, _RECORD, "source_path string" if path is not None else "", errors)

    def listed(kind: str) -> Column:
        item = lambda m: F.struct(m["label"].alias("label"), m["caption"].alias("caption"), F.lit(None).cast("string").alias("path"), m["source"].alias("source"), _where(m["raw"], m["page"], m["zones"]).alias("coords"))
        return F.transform(F.filter("media", lambda m: m["kind"] == kind), item)

    named = F.lit(None).cast("string").alias("source_path") if path is None else F.col("source_path")
    return found.select(
        "doc_id", F.struct(named, "title", "journal", "doi", "authors", "keywords").alias("meta"), F.map_from_entries("sections").alias("sections"), F.map_from_entries("other_sections").alias("other_sections"),
        listed("figure").alias("figures"), listed("table").alias("tables"), "references", *(["error"] if errors else []),
    )

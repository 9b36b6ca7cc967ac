"""Merging of table entries, crop geometry, label anchors and page choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_tables(items: DataFrame, doc: str = "doc_id", ord_: str = "ord") -> DataFrame:
    """One row per (doc, caption or label or path), first-seen order; entries with none stay alone.

    Missing label, caption, coords, path and pdf_bbox (if the items have it) are
    filled from the first later entry that has them; sources become their sorted distinct list joined by ``+``.
    ``path`` also replaces an empty one.
    """
    has = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    key = F.coalesce(
        F.concat(F.lit("caption:"), F.lower(has("caption"))), F.concat(F.lit("label:"), F.lower(has("label"))),
        F.concat(F.lit("path:"), F.nullif("path", F.lit(""))), F.concat(F.lit("row:"), F.col(ord_).cast("string")),
    )
    first = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(ord_))).alias(c)
    box = [F.min_by("pdf_bbox", F.when(F.col("pdf_bbox").isNotNull(), F.col(ord_))).alias("pdf_bbox")] if "pdf_bbox" in items.columns else []
    sources = F.array_join(F.array_sort(F.collect_set(F.nullif("source", F.lit("")))), "+")
    return (
        items.withColumn("_key", key)
        .groupBy(doc, "_key")
        .agg(F.min(ord_).alias(ord_), *[first(c) for c in ("label", "caption", "path", "coords")], *box, F.nullif(sources, F.lit("")).alias("source"))
        .drop("_key")
    )


def coord_groups(coords: Column) -> Column:
    """All groups of five numbers of a coordinate string: array of (page, a, b, c, d)."""
    n = F.filter(F.transform(F.split(coords, "[;,\\s]+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    last = F.floor(F.size(n) / F.lit(5)).cast("int") - 1
    groups = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda g: F.slice(n, g * 5 + 1, 5))
    as_struct = lambda g: F.struct(
        F.get(g, F.lit(0)).cast("int").alias("page"), *[F.get(g, F.lit(i)).alias(c) for i, c in enumerate("abcd", 1)]
    )
    return F.transform(F.filter(groups, lambda g: F.size(g) == 5), as_struct)


def as_corners(g: Column, width: Column, height: Column) -> Column:
    """Corners of a rectangle; x, y, w, h unless that leaves the page (by more than 1) or is degenerate."""
    a, b, c, d = (g[k] for k in "abcd")
    fits = (a + c <= width + 1) & (b + d <= height + 1) & (c > 0) & (d > 0)
    return F.struct(a.alias("x0"), b.alias("y0"), F.when(fits, a + c).otherwise(c).alias("x1"), F.when(fits, b + d).otherwise(d).alias("y1"))


def pixels(r: Column, dpi: int = 220) -> Column:
    """Width and height in pixels of a rectangle in points."""
    return F.struct(F.round((r["x1"] - r["x0"]) * dpi / 72).cast("int").alias("width"), F.round((r["y1"] - r["y0"]) * dpi / 72).cast("int").alias("height"))


def padded(r: Column, width: Column, height: Column, share: float = 0.06) -> Column:
    """The rectangle grown by a share of its size and cut to the page."""
    px, py = (r["x1"] - r["x0"]) * share, (r["y1"] - r["y0"]) * share
    zero = F.lit(0.0)
    return F.struct(
        F.greatest(zero, r["x0"] - px).alias("x0"), F.greatest(zero, r["y0"] - py).alias("y0"),
        F.least(width, r["x1"] + px).alias("x1"), F.least(height, r["y1"] + py).alias("y1"),
    )


def keyword_pages(pages: DataFrame, text: str, keywords: list[str], doc: str, page: str, most: int = 6) -> DataFrame:
    """The first pages of each document that hold any keyword."""
    hit = F.lower(F.coalesce(F.col(text), F.lit(""))).rlike("|".join(f"\\Q{k}\\E" for k in keywords)) if keywords else F.lit(False)
    n = F.row_number().over(W.partitionBy(doc).orderBy(page))
    return pages.where(hit).withColumn("n", n).where(F.col("n") <= most)


#: Words that announce a label.
ANNOUNCED = {"figure": ("figure", "fig.", "fig"), "table": ("table", "tab.", "tab")}


def label_anchors(words: DataFrame, by: tuple[str, ...] = ("doc_id",), pos: str = "pos", word: str = "word", labels: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by..., pos, kind, number, keep...): a figure or table word with a number in one of the next three words.

    With ``labels``, a (first of ``by``, number) table, only numbers in it count.
    ``keep`` are columns of the words that their anchors keep.
    """
    plain, kind = F.lower(F.trim(F.col(word))), F.lit(None).cast("string")
    for name, announced in ANNOUNCED.items():
        kind = F.when(plain.isin(*announced), name).otherwise(kind)
    # words move by what they are here: numbers, announcing words with what they keep, and others, of which only their order counts
    marked = words.select(*by, pos, kind.alias("kind"), F.when(plain.rlike("^[0-9]+$"), plain).alias("_digits"), *[F.when(kind.isNotNull(), F.col(c)).alias(c) for c in keep])
    w = W.partitionBy(*by).orderBy(pos)
    numbers = F.array_compact(F.array(*[F.lead("_digits", k).over(w) for k in (1, 2, 3)]))
    found = marked.select(*by, pos, "kind", numbers.alias("numbers"), *keep).where("kind is not null and size(numbers) > 0")
    if labels is None:
        return found.select(*by, pos, "kind", F.get("numbers", F.lit(0)).alias("number"), *keep)
    each = found.select(*by, pos, "kind", F.posexplode("numbers").alias("_k", "number"), *keep)
    known = each.join(labels.select(by[0], "number").distinct(), [by[0], "number"], "left_semi")
    # by document, so that what follows within one needs no other exchange
    return known.repartition(by[0]).groupBy(*by, pos, "kind").agg(F.min_by("number", "_k").alias("number"), *[F.first(c).alias(c) for c in keep])


def label_crops(words: DataFrame, labels: DataFrame | None = None, doc: str = "doc_id", page: str = "page", margin: float = 24.0, above: float = 24.0, gap: float = 12.0, span: float = 0.6, most: int = 8) -> DataFrame:
    """(doc, page, n, kind, number, x0, y0, x1, y1): the part of a page that belongs to each anchor, at most ``most`` a document.

    ``words`` are (doc, page, pos, word, x0, y0, page_width, page_height).  A crop
    begins ``above`` points over its anchor and ends ``gap`` points before the
    next anchor of its page, or after a ``span`` of the page's height; crops of
    at most 5 points either way are left out.
    """
    placed = words.select(doc, page, "pos", "word", F.col("x0").alias("_x"), F.col("y0").alias("_y"), "page_width", "page_height")
    anchors = label_anchors(placed, (doc, page), labels=labels, keep=("_x", "_y", "page_width", "page_height"))
    order = W.partitionBy(doc, page).orderBy("_y", "_x", "pos")
    then, height = F.lead("_y").over(order), F.col("page_height")
    top = F.greatest(F.lit(0.0), F.col("_y") - above)
    crops = anchors.select(
        doc, page, F.row_number().over(order).alias("n"), "kind", "number", F.lit(margin).alias("x0"), top.alias("y0"), (F.col("page_width") - margin).alias("x1"),
        F.least(height, F.coalesce(then - gap, top + height * span)).alias("y1"),
    ).where("y1 - y0 > 5 and x1 - x0 > 5")
    return crops.withColumn("_k", F.row_number().over(W.partitionBy(doc).orderBy(page, "n"))).where(F.col("_k") <= most).drop("_k")


def in_pages(pages: DataFrame, page: str, count: str) -> DataFrame:
    """Rows whose page number is one of the document's pages, counted from 1."""
    return pages.where(F.col(page).between(1, F.col(count)))


def prefer_crops(items: DataFrame, page: Column, *by: str) -> DataFrame:
    """Of each page the crops, or its images if it has no crop."""
    is_crop = F.col("path").rlike("_crop\\d*\\.")
    any_crop = F.max(is_crop.cast("int")).over(W.partitionBy(*by, page))
    return items.withColumn("_any", any_crop).where(is_crop | (F.col("_any") == 0)).drop("_any")


def first_path(candidates: DataFrame, doc: str, item: str) -> DataFrame:
    """The candidate of the first strategy that gave a path, per item."""
    n = F.row_number().over(W.partitionBy(doc, item).orderBy("priority"))
    return candidates.where(F.coalesce(F.col("path"), F.lit("")) != "").withColumn("_n", n).where("_n = 1").drop("_n")


def prefixed_label(kind: str, label: Column, source: Column) -> Column:
    """Puts Figure or Table before a label of the document's own that lacks it."""
    short = {"Figure": "fig", "Table": "tab"}[kind]
    return F.when((source == "tei") & ~F.lower(label).startswith(short), F.concat(F.lit(f"{kind} "), label)).otherwise(label)

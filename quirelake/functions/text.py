"""Text scalars as Column expressions (no Python functions on the rows)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it; ``\\s`` of neither engine agrees with it.
BLANK = "[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: What counts as noise: characters outside plain letters, digits, blanks and usual marks.
PLAIN = "[A-Za-z0-9\\x{09}-\\x{0d}\\x{1c}-\\x{20}.,;:'\"!?()\\[\\]{}\\-_/\\\\%+*=<>]"


def collapsed(x: Column) -> Column:
    """White space runs become one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), f"{BLANK}+", " "))


def missing_if_blank(x: Column) -> Column:
    return F.nullif(collapsed(x), F.lit(""))


def stripped(x: Column) -> Column:
    """Python's strip()."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")


def word_count(x: Column) -> Column:
    t = collapsed(x)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("int")


def noise_ratio(x: Column) -> Column:
    """Share of characters that aren't plain; 0 for empty text."""
    t = F.coalesce(x, F.lit(""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(t, PLAIN, "")), F.length(t)), F.lit(0.0))


def without_tags(x: Column) -> Column:
    """Tags become blanks, white space collapses; the common entities are decoded last."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " "), "\\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def shortened(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def contains_either_way(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return F.contains(a, b) | F.contains(b, a)


def positional_similarity(a: Column, b: Column) -> Column:
    """Equal characters at equal places, over the longer length."""

    def compared(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        chars = lambda t: F.split(t, "")
        equal = F.size(F.filter(F.zip_with(chars(x), chars(y), lambda p, q: p == q), lambda same: same))
        return F.when(longest == 0, 1.0).otherwise(F.try_divide(equal, longest))

    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    same = F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
    # both texts are collapsed once
    pair = F.transform(F.array(F.struct(collapsed(a).alias("x"), collapsed(b).alias("y"))), lambda p: compared(p["x"], p["y"]))
    return F.when(empty, F.when(same, 1.0).otherwise(0.0)).otherwise(F.element_at(pair, 1))


def safe_stem(path: Column) -> Column:
    """Base name without its last extension, and eight digits of the path's SHA-1."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    stem = F.regexp_replace(base, "(?<=.)\\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.left(F.sha1(F.encode(path, "UTF-8")), F.lit(8)))


def file_stem(path: Column) -> Column:
    """File name of a path without its last extension; null without a path."""
    return F.nullif(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", ""), F.lit(""))


def match_key(x: Column) -> Column:
    """DOIs and titles as they are compared."""
    return F.nullif(F.lower(stripped(x)), F.lit(""))


def pubmed_term(doi: Column, title: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(doi), F.concat(doi, F.lit("[DOI]"))).when(has(title), F.concat(F.lit('"'), title, F.lit('"[Title]')))


def media_label(kind: str, raw: Column, head: Column, caption: Column) -> Column:
    """``Figure 3`` or ``Table 2`` from head or caption, else from a raw number, else the bare kind."""
    name = kind.capitalize()
    pattern = "(?iU)\\b" + {"figure": "fig(?:ure)?", "table": "tab(?:le)?"}[kind] + "\\s*([A-Za-z0-9]+)"
    numbers = [F.nullif(F.regexp_extract(stripped(x), pattern, 1), F.lit("")) for x in (head, caption)]
    raw = stripped(raw)
    return F.coalesce(
        *[F.concat(F.lit(f"{name} "), n) for n in numbers],
        F.when(raw.rlike("(?U)^\\d{1,3}$"), F.concat(F.lit(f"{name} "), raw)),
        F.when(stripped(head) != "", F.lit(name)),
    )


_LABELLED = {kind: re.compile(r"\b" + name + r"\s*([A-Za-z0-9]+)", re.I) for kind, name in (("figure", "fig(?:ure)?"), ("table", "tab(?:le)?"))}


def label_of(kind: str, raw: str | None, head: str, caption: str) -> str | None:
    """``media_label`` of one item."""
    name = kind.capitalize()
    for x in (head, caption):
        found = _LABELLED[kind].search(x.strip())
        if found:
            return f"{name} {found[1]}"
    raw = (raw or "").strip()
    if re.fullmatch(r"\d{1,3}", raw):
        return f"{name} {raw}"
    return name if head.strip() else None

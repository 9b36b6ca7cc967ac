"""Section headings: sanitising, canonical names, and suggestions."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANK, stripped

CANONICAL = ("abstract", "introduction", "materials_and_methods", "results", "discussion", "conclusions", "results_and_discussion")
BOILERPLATE = frozenset(
    "references bibliography orcid funding abbreviations list_of_abbreviations acknowledgments acknowledgements "
    "data_availability availability_of_data_and_materials ethics_statement ethical_statement human_and_animal_rights "
    "consent_for_publication patient_consent contributorship authors_contributions author_contributions "
    "competing_interests conflicts_of_interest conflict_of_interest".split()
)
#: (key, fragments): the first rule with a fragment in the heading decides.
FRAGMENTS = (
    (
        "materials_and_methods",
        "method|statistic|power analysis|sample size|eligibility|inclusion|exclusion|sample preparation|specimen preparation|"
        "participants|population|search strategy|study selection|data extraction|quality assessment|risk of bias|preoperative|"
        "indication|systemic condition|local condition|outcome measure|randomization|blinding|charting|synthesis|"
        "protocol registration|heterogeneity",
    ),
    ("introduction", "introduc|aim|objective|purpose|background|hypothesis|hypotheses|focused question|focus question"),
    ("conclusions", "conclusion|clinical significance"),
    ("results", "result"),
    ("discussion", "discussion|limitation"),
)
SUGGESTED = (
    ("materials_and_methods", "analys[ie]s|examination|assessment|selection|extraction|imaging|radiographic|protocol"),
    ("introduction", "objective|aim|purpose|background"),
    ("discussion", "limitation|strength"),
    ("conclusions", "conclusion|clinical significance"),
)


#: What any heading with a suggestion holds, in lower case, whatever its white space.
HINTS = "|".join(fragments for _, fragments in SUGGESTED).replace(" ", f"{BLANK}+")


def dictionary() -> list[tuple[str, str]]:
    """(heading, key) pairs of exact matches."""
    lines = files("quirelake.rules").joinpath("headings.tsv").read_text("utf-8").splitlines()
    return [(heading, key) for key, heading in (line.split("\t") for line in lines if not line.startswith("#"))]


def sanitized(head: Column) -> Column:
    """Lower case, without leading marks and one leading number, white space collapsed."""
    x = F.lower(stripped(head))
    x = F.regexp_replace(x, f"^(?:[|>•\\-–—]|{BLANK})+", "")
    x = F.regexp_replace(x, f"^(?:[ivxlcdm]+\\.|\\d+(?:\\.\\d+)*\\.?)(?:[\\-:]|{BLANK})*", "")
    return stripped(F.regexp_replace(x, f"{BLANK}+", " "))


def by_rules(clean: Column) -> Column:
    """The key of a sanitised heading that the dictionary doesn't know."""
    out = F.when(clean == "", F.lit("")).when(F.contains(clean, F.lit("results")) & F.contains(clean, F.lit("discussion")), "results_and_discussion")
    out = reduce(lambda case, rule: case.when(clean.rlike(rule[1]), rule[0]), FRAGMENTS, out)
    return out.otherwise(F.replace(clean, F.lit(" "), F.lit("_")))


@lru_cache(1)
def _exact() -> dict[str, str]:
    return dict(dictionary())


@lru_cache(4096)
def key_of(head: str) -> str:
    """The canonical key of one heading, as ``classify`` gives it."""
    x = re.sub(r"^(?:[|>•\-–—]|\s)+", "", head.strip().lower())
    x = " ".join(re.sub(r"^(?:[ivxlcdm]+\.|[0-9]+(?:\.[0-9]+)*\.?)(?:[\-:]|\s)*", "", x).split())
    if x in _exact():
        return _exact()[x]
    if "results" in x and "discussion" in x:
        return "results_and_discussion"
    return next((key for key, fragments in FRAGMENTS if re.search(fragments, x)), x.replace(" ", "_"))


def classify(df: DataFrame, head: str, into: str = "key") -> DataFrame:
    """Adds the canonical key of ``head``.

    The dictionary is a packaged file of 224 entries, so its side of the join is broadcast.
    """
    exact = df.sparkSession.createDataFrame(dictionary(), "_heading string, _key string")
    return (
        df.withColumn("_clean", sanitized(F.col(head)))
        .join(F.broadcast(exact), F.col("_clean") == F.col("_heading"), "left")
        .withColumn(into, F.coalesce("_key", by_rules(F.col("_clean"))))
        .drop("_clean", "_heading", "_key")
    )


def is_boilerplate(key: Column) -> Column:
    return key.isin(sorted(BOILERPLATE))


def suggestion(head: Column) -> Column:
    """A key that an unmapped heading might get; null if no keyword is in it."""
    clean = sanitized(head)
    return reduce(lambda case, rule: case.when(clean.rlike(rule[1]), rule[0]), SUGGESTED[1:], F.when(clean.rlike(SUGGESTED[0][1]), SUGGESTED[0][0]))


def suggestions(frequencies: DataFrame, min_count: int = 1) -> DataFrame:
    """(head, key, n): the suggested key of each heading of a (head, n) table that occurs often enough."""
    # few headings hold any of the words: only these are sanitised and, where headings are still to be counted, moved
    rows = frequencies.where(F.lower("head").rlike(HINTS)).where((F.col("n") >= min_count) & (sanitized(F.col("head")) != ""))
    return rows.select("head", suggestion(F.col("head")).alias("key"), "n").where("key is not null")


def exact_sql() -> str:
    return ", ".join("('{}', '{}')".format(h.replace("'", "''"), k) for h, k in dictionary())


__all__ = ["BOILERPLATE", "CANONICAL", "by_rules", "classify", "dictionary", "exact_sql", "is_boilerplate", "key_of", "sanitized", "suggestion", "suggestions"]

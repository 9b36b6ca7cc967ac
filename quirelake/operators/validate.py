"""Ground truth: joins, checks, scores and the commonest issues."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import contains_either_way, positional_similarity, shortened, word_count
from .metrics import COVERED


@F.arrow_udf(DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio; no built-in function computes it."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in pairs], pa.float64())


def join_truth(papers: DataFrame, truth: DataFrame, key: str = "file_name") -> DataFrame:
    """Each truth row with its record, found by file name; ``status`` is error without one.

    ``papers`` without ``key`` get it from the file name of their source path.
    """
    if key not in papers.columns:
        papers = papers.withColumn(key, F.regexp_extract("meta.source_path", "([^/]*)$", 1))
    p = papers.withColumn("_has", F.lit(True))
    return truth.join(p, key, "left").withColumn("status", F.when(F.col("_has"), "success").otherwise("error")).drop("_has")


def metadata_checks(meta: Column, expected: Column) -> Column:
    """Presence of title, DOI and journal, and whether they match: titles and journals if one holds the other, DOIs if equal."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    both = lambda k: has(meta[k]) & has(expected[k])
    alike = lambda k: F.coalesce(both(k) & similar_titles(meta[k], expected[k]), F.lit(False))
    return F.struct(
        has(meta["title"]).alias("title_present"), alike("title").alias("title_matches"), has(meta["doi"]).alias("doi_present"),
        F.coalesce(both("doi") & (meta["doi"] == expected["doi"]), F.lit(False)).alias("doi_matches"), has(meta["journal"]).alias("journal_present"), alike("journal").alias("journal_matches"),
    )


def metadata_points(checks: Column) -> Column:
    """30 at most: an equal share for each of the six checks that hold."""
    names = ("title_present", "title_matches", "doi_present", "doi_matches", "journal_present", "journal_matches")
    return sum((F.coalesce(checks[n], F.lit(False)).cast("int") for n in names), F.lit(0)) * 30.0 / 6


def abstract_points(expected: Column, actual: Column, first50: Column, last50: Column, words: Column, expected_words: Column) -> Column:
    """20 at most; 20 if none is expected.  A missing abstract keeps the share of its word count."""
    there = F.coalesce(actual, F.lit("")) != ""
    head = F.when(F.coalesce(first50, F.lit("")) == "", 0.0).otherwise(positional_similarity(F.left(actual, F.lit(50)), first50))
    tail = F.when(F.coalesce(last50, F.lit("")) == "", 0.0).otherwise(positional_similarity(F.right(actual, F.lit(50)), last50))
    off = F.coalesce(F.try_divide(F.abs(words - expected_words), expected_words), F.lit(0.0))
    found = F.lit(1.0) + head + tail + (1 - F.least(off, F.lit(1.0)))
    return F.when(~F.coalesce(expected, F.lit(False)), 20.0).when(there, 20.0 * found / 4).otherwise(20.0 / 4)


def section_points(extracted: Column, expected: Column) -> Column:
    return F.when(expected > 0, 30.0 * F.least(F.try_divide(extracted, expected), F.lit(1.0))).otherwise(15.0)


def count_points(actual: Column, expected: Column) -> Column:
    off = F.try_divide(F.abs(actual - expected), expected)
    return F.when(expected > 0, 10.0 * F.greatest(F.lit(0.0), 1 - off)).otherwise(10.0)


def within(actual: Column, expected: Column, least: int, share: float) -> Column:
    """Differences up to ``least`` or a share of the expected count are fine."""
    return F.abs(actual - expected) <= F.greatest(F.lit(float(least)), expected * share)


def band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def scored(joined: DataFrame) -> DataFrame:
    """Adds all checks and points to the rows of ``join_truth``; null for rows without a record.

    ``metadata_checks``, ``matching_sections`` (expected names whose section has
    text), counts and differences, captions, label overlap, the points of the
    five parts, their sum ``score`` with its ``band``, and ``quick_score``, the
    mean of the parts that apply.
    """
    ok = F.col("status") == "success"
    text = lambda k: F.coalesce(F.try_element_at("sections", k), F.lit(""))
    abstract, truth = text(F.lit("abstract")), F.col("truth")
    names = F.coalesce(F.map_keys(truth["sections"]), F.array().cast("array<string>"))
    expected = {"figure": F.coalesce(truth["structural_info"]["total_figures"], F.lit(0)), "table": F.coalesce(truth["structural_info"]["total_tables"], F.lit(0))}
    labels = lambda items: F.array_distinct(F.filter(F.transform(items, lambda m: m["label"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    out = joined.withColumns(
        {
            "checks": metadata_checks(F.col("meta"), truth["metadata"]),
            "matching_sections": F.array_sort(F.filter(names, lambda k: text(k) != "")),
            "expected_sections": F.size(names),
            "extracted_sections": sum(((text(F.lit(k)) != "").cast("int") for k in COVERED), F.lit(0)),
            "abstract_words": word_count(abstract),
        }
    )
    for kind in ("figure", "table"):
        found = F.col(f"{kind}s")
        out = out.withColumns(
            {
                f"{kind}_count": F.size(found), f"expected_{kind}s": expected[kind], f"{kind}_diff": F.abs(F.size(found) - expected[kind]),
                f"{kind}s_with_captions": F.size(F.filter(found, lambda m: F.coalesce(m["caption"], F.lit("")) != "")),
                f"common_{kind}_labels": F.size(F.array_intersect(labels(found), labels(truth[f"{kind}s"]))),
            }
        )
    a = truth["abstract"]
    points = {
        "metadata_points": metadata_points(F.col("checks")),
        "abstract_points": abstract_points(a["present"], abstract, a["first_50_chars"], a["last_50_chars"], F.col("abstract_words"), a["word_count"]),
        "section_points": section_points(F.col("extracted_sections"), F.col("expected_sections")),
        "figure_points": count_points(F.col("figure_count"), F.col("expected_figures")),
        "table_points": count_points(F.col("table_count"), F.col("expected_tables")),
    }
    share = lambda kind: F.when(F.col(f"expected_{kind}s") > 0, F.greatest(F.lit(0.0), 1 - F.try_divide(F.col(f"{kind}_diff"), F.col(f"expected_{kind}s"))))
    parts = F.array_compact(
        F.array(
            F.when(F.coalesce(truth["metadata"]["doi"], F.lit("")) != "", F.coalesce(F.col("meta.doi") == truth["metadata"]["doi"], F.lit(False)).cast("double")),
            F.when(F.coalesce(a["present"], F.lit(False)), F.array_contains(F.map_keys("sections"), "abstract").cast("double")),
            F.when(F.col("expected_sections") > 0, F.least(F.try_divide(F.col("extracted_sections"), F.col("expected_sections")), F.lit(1.0))),
            share("figure"), share("table"),
        )
    )
    quick = F.when(F.size(parts) > 0, 100 * F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)).otherwise(0.0)
    out = out.withColumns(points).withColumn("score", sum((F.col(p) for p in points), F.lit(0.0))).withColumns({"band": band(F.col("score")), "quick_score": quick})
    made = [c for c in out.columns if c not in joined.columns]
    return out.withColumns({c: F.when(ok, F.col(c)) for c in made})


def side_by_side(results: DataFrame, key: str = "file_name", most: int = 60) -> DataFrame:
    """(key, part, item, expected, actual, ok): what was expected beside what was found, of records found.

    Texts are shortened to ``most`` characters; the first five figures and
    tables of either side are listed.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    row = lambda part, item, e, a, ok: F.struct(F.lit(part).alias("part"), F.lit(item).alias("item") if isinstance(item, str) else item.alias("item"), e.cast("string").alias("expected"), a.cast("string").alias("actual"), ok.alias("ok"))
    holds = lambda part, item, e, a: row(part, item, shortened(text(e), most), shortened(text(a), most), similar_titles(text(e), text(a)))
    same = lambda part, item, e, a: row(part, item, text(e.cast("string")), text(a.cast("string")), text(e.cast("string")) == text(a.cast("string")))
    near = lambda part, item, e, a, least: row(part, item, e, a, F.abs(e - a) <= least)
    t, meta = F.col("truth"), F.col("meta")
    abstract = F.coalesce(F.try_element_at("sections", F.lit("abstract")), F.lit(""))
    words = F.coalesce(t["abstract"]["word_count"], F.lit(0))
    fixed_rows = [
        holds("metadata", "title", t["metadata"]["title"], meta["title"]), same("metadata", "doi", t["metadata"]["doi"], meta["doi"]), holds("metadata", "journal", t["metadata"]["journal"], meta["journal"]),
        same("abstract", "present", F.coalesce(t["abstract"]["present"], F.lit(False)), abstract != ""),
        near("abstract", "words", words, F.col("abstract_words"), words * 0.1),
        near("figures", "count", F.col("expected_figures"), F.col("figure_count"), F.lit(2)), near("tables", "count", F.col("expected_tables"), F.col("table_count"), F.lit(1)),
    ]

    def listed(part: str):
        place = F.sequence(F.lit(1), F.least(F.lit(5), F.greatest(F.size(part), F.size(t[part]))))
        label = lambda items, i: text(F.get(items, i - 1)["label"])
        rows = F.transform(place, lambda i: row(part, i.cast("string"), label(t[part], i), label(F.col(part), i), label(t[part], i) == label(F.col(part), i)))
        return F.when(F.greatest(F.size(part), F.size(t[part])) > 0, rows).otherwise(F.slice(F.array(*fixed_rows), 1, 0))

    every = F.concat(F.array(*fixed_rows), listed("figures"), listed("tables"))
    return results.where("status = 'success'").select(key, F.explode(every).alias("r")).select(key, "r.*")


def success_rate(results: DataFrame) -> DataFrame:
    """One row: documents, successes, failures, their rate and the mean score of the successes."""
    ok = F.count_if(F.col("status") == "success")
    return results.agg(
        F.count(F.lit(1)).alias("total"), ok.alias("successful"), F.count_if(F.col("status") != "success").alias("failed"),
        F.try_divide(ok, F.count(F.lit(1))).alias("rate"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
    )


def top_issues(results: DataFrame, most: int = 5) -> DataFrame:
    """(issue, n) of the commonest issues of ``scored`` rows."""
    issues = F.array_compact(
        F.array(
            F.when(F.col("checks.title_present") & ~F.col("checks.title_matches"), "title_mismatch"),
            F.when(F.col("expected_sections") > F.col("extracted_sections"), "missing_sections"),
            F.when(F.col("figure_diff") > 2, "figure_count_diff"),
            F.when(F.col("table_diff") > 1, "table_count_diff"),
        )
    )
    return results.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue").limit(most)


def similar_titles(a: Column, b: Column) -> Column:
    return F.coalesce(contains_either_way(a, b), F.lit(False))

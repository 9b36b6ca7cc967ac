"""What label and suggestion queries move, and that they find the same."""

from pyspark.sql import functions as F

from quirelake.functions import headings
from quirelake.operators import media
from quirelake.plans import registry

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_suggestions_look_at_few_headings(spark):
    plan = optimized(registry.queries()["mapping_suggestions"](spark, SF))
    # the plain words are looked for below the count, before anything is sanitised
    below = plan[plan.index("Aggregate") :]
    condition = next(x for x in below.splitlines() if "Filter" in x and "regexp_replace" in x)
    assert "RLIKE" in condition and condition.index("RLIKE") < condition.index("regexp_replace")


def test_hints_lose_no_suggestion(spark):
    heads = ["3.1 CLINICAL 　Significance", "– \tAims", "iv. radiographic  analyses", "aim", "x", "", "Clinicalsignificance", "Protocols:", "ANALYSİS analysis", "clinical\nsignificance of it"]
    rows = spark.createDataFrame([(h, 2) for h in heads], "head string, n int")
    want = {(r["head"], r["key"]) for r in rows.select("head", headings.suggestion(F.col("head")).alias("key")).collect() if r["key"]}
    assert {(r["head"], r["key"]) for r in headings.suggestions(rows).collect()} == want and len(want) == 7


def test_words_move_once_and_without_their_text(spark):
    words = spark.range(10).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("pos"), F.concat(F.lit("word"), F.col("id")).alias("word"), *[F.lit(float(n)).alias(c) for n, c in enumerate(("x0", "y0", "page_width", "page_height"))])
    words = words.localCheckpoint()
    plan = media.label_crops(words)._jdf.queryExecution().executedPlan().toString()
    # one exchange of words, one of a document's crops
    assert plan.count("Exchange hash") == 2 and "Join" not in plan
    assert "word" not in plan[: plan.index("Exchange hashpartitioning(doc_id", plan.index("Exchange hashpartitioning(doc_id") + 1)]


def test_anchors_keep_columns_and_count_words_by_their_order(spark):
    rows = [(1, 10, "Fig.", "a"), (1, 20, " 3 ", "b"), (1, 30, "tab", "c"), (1, 40, "x", "d"), (1, 50, "y", "e"), (1, 60, "7", "f"), (1, 70, "Table", "g"), (2, 1, "fig", "h"), (2, 2, "8", "i"), (2, 3, "9", "j")]
    words = spark.createDataFrame(rows, "doc_id int, pos int, word string, note string")
    got = [tuple(r) for r in media.label_anchors(words, keep=("note",)).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 10, "figure", "3", "a"), (1, 30, "table", "7", "c"), (2, 1, "figure", "8", "h")]
    labels = spark.createDataFrame([(1, "7"), (2, "9"), (2, "9")], "doc_id int, number string")
    got = [tuple(r) for r in media.label_anchors(words, labels=labels, keep=("note",)).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 30, "table", "7", "c"), (2, 1, "figure", "9", "h")]

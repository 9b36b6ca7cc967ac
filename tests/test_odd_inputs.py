"""Rounding, and empty and null texts, against Python and SQL."""

import random

import duckdb
from pyspark.sql import functions as F

from quirelake.operators import enrich
from quirelake.plans import registry
from quirelake.sources import records


def test_fixed_rounds_the_exact_value(spark):
    draw = random.Random(5)
    xs = [0.0, 0.08125, 0.23125, 0.00125, 0.03125, 0.09375, 0.99995, 0.99994999, 1.00005, 12345.00005, 2.0**53 / 3, 1e-300, -0.00125, -2.5, 0.99999, 123456789012.34375, 1e17, 1.5e300]
    xs += [k / n for n in (160, 800, 1600, 20000, 32000) for k in range(0, n, 3)] + [draw.random() for _ in range(3000)] + [draw.randrange(20001) / 20000 for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    wrong = [(r["x"], r["s"]) for r in rows.select("x", records.fixed(F.col("x")).alias("s")).collect() if r["s"] != f"{r['x']:.4f}" and r["x"] < 1e300]
    assert wrong == []
    assert spark.range(1).select(records.fixed(F.lit(None).cast("double"))).first()[0] is None


def test_reviews_of_empty_and_null_texts_match_sql(spark, tmp_path):
    long = "x" * 300
    rows = [(1, "", "en"), (2, None, "en"), (3, "short", None), (4, long, None), (5, "short", ""), (6, "", None), (7, " ", "de"), (8, long[1:], "en"), (9, "\n", "en"), (10, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, materials_and_methods, discussion FROM ({registry.oracle_sql()['review_augment']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in registry.queries()["review_augment"](spark, str(tmp_path)).orderBy("doc_id").collect()] == want


def test_reviews_without_own_methods(spark):
    one = "array<struct<head: string, text: string>>"
    rows = [([("Study selection", "a"), ("Notes", "n"), ("Data extraction", "b")], None, None), ([("Notes", "n")], None, "d"), ([], "m", ""), ([("Study selection", "a")], "", "")]
    df = spark.createDataFrame(rows, f"o {one}, m string, d string")
    got = [tuple(r) for r in df.select(enrich.augmented(F.col("o"), F.col("m"), F.col("d")).alias("r")).select("r.*").collect()]
    assert got == [("a\n\nb", "Notes\nn"), (None, "d\n\nNotes\nn"), ("m", ""), ("\n\na", "")]

"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._shared import text_of, written

#: Buckets that unigrams and bigrams share.
BUCKETS = 10_000
#: Target documents that the target model is fitted on, about, at most; drawn by a hash of the id.
TARGETS = 100_000
#: Keys that the last step of the search for the k-th largest looks at in one place.
AT_ONCE = 10_000
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_REMEMBERED = 400_000
_known: dict[str, int] = {}


def _hash(token: str) -> int:
    value = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    if len(token) <= 40:
        if len(_known) >= _REMEMBERED:
            _known.clear()
        _known[token] = value
    return value


def buckets(text: str) -> np.ndarray:
    """The buckets of all unigrams and bigrams of a whole text, repeats included."""
    tokens = _TOKENS.findall(text.lower())
    h = list(map(_known.get, tokens))
    for i, v in enumerate(h):
        if v is None:
            h[i] = _hash(tokens[i])
    one = np.array(h, np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    both = np.concatenate((one * np.uint64(0xD6E8FEB86659FD93), two))
    return ((both >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def _tally(batches):
    raw, target, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            c = np.bincount(buckets(text.as_py()), minlength=BUCKETS)
            raw += c
            n += 1
            if wanted.as_py():
                target += c
    if n:
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS, dtype=np.int32), "raw": raw, "target": target})


def log_ratios(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """log p_target - log p_raw of each bucket, the raw model counted over all documents.

    ``target`` names the target documents by id.  Their ids go out as a
    broadcast, so the texts are not moved; if there are more than TARGETS of
    them, a hash of the id draws about that many, which bounds its size.  Each
    task adds up its own counts: BUCKETS rows a task are shuffled and BUCKETS
    rows come back.  One is added to each count.
    """
    wanted = target.select(F.col(doc_id).alias("_target")).where("_target is not null").distinct()
    share = TARGETS / max(1, wanted.count())
    if share < 1:
        wanted = wanted.where(F.pmod(F.xxhash64(F.lit("target"), "_target"), F.lit(1 << 40)) < int(share * (1 << 40)))
    marked = docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("t"))
    marked = marked.join(F.broadcast(wanted), F.col("_id") == F.col("_target"), "left").select("t", F.col("_target").isNotNull().alias("wanted"))
    sums = marked.mapInArrow(_tally, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, goal = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in sums.collect():
        raw[r["bucket"]] += r["raw"]
        goal[r["bucket"]] += r["target"]
    return np.log(goal / goal.sum()) - np.log(raw / raw.sum())


def with_weight(df: DataFrame, ratios: np.ndarray, text: str = "text", into: str = "log_weight") -> DataFrame:
    """Adds ``into``: the log importance weight, the sum of the ratios over a text's n-grams (no words: 0)."""
    sent = df.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf(DoubleType())
    def weighed(texts: pa.Array) -> pa.Array:
        r = sent.value
        return pa.array([float(r[buckets(t.as_py())].sum()) for t in texts], pa.float64())

    return df.withColumn(into, weighed(text_of(text)))


def kth_largest(keys: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a column, exactly; minus infinity if there are fewer.

    Histograms over ever narrower ranges find the range that holds it; only when
    at most AT_ONCE values are left (or all are equal) are they looked at.
    """
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if n < k or not n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    rest = k
    part = keys.select(F.col(key).alias("x")).where("x is not null")
    while n > AT_ONCE and high > low:
        width = (high - low) / 256
        if width <= 0 or low + width <= low:
            break
        bin_ = F.least(F.lit(255), F.floor((F.col("x") - low) / width)).cast("int")
        rows = part.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy(F.desc("b")).collect()
        for r in rows:
            if rest <= r["n"]:
                break
            rest -= r["n"]
        if r["n"] == n and (r["low"], r["high"]) == (low, high):
            break
        low, high, n = r["low"], r["high"], r["n"]
        part = part.where((F.col("x") >= low) & (F.col("x") <= high))
    if high == low:
        return high
    return part.orderBy(F.desc("x")).limit(rest).agg(F.min("x")).first()[0]


def resampled(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fraction: float | None = None, seed: int = 7
) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected): one row per row of ``docs``.

    Target documents are those with label 1.  The log importance weight plus
    Gumbel noise is the key; the k rows with the largest keys are a sample
    without replacement in proportion to the weights.  k is ``fraction`` of the
    rows, by default the share of 1 among the labels (half without labels).
    The noise is a function of id and seed, so a run can be repeated.

    Null and empty texts have weight 0; null ids get noise like any other and
    are never a target; ties at the k-th key are all selected; repeated rows
    are drawn alike; extra columns aren't read; an empty table gives no rows.
    """
    known = labels.where(F.col(label).isNotNull())
    if fraction is None:
        share = known.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
        fraction = 0.5 if share is None else share
    ratios = log_ratios(docs, known.where(F.col(label) > 0), doc_id, text)
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("none"))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = with_weight(docs.select(doc_id, text), ratios, text).select(
        F.col(doc_id).alias("doc_id"), "log_weight", (F.col("log_weight") - F.log(-F.log(unit))).alias("gumbel_key")
    )
    scored = written(scored, "weights")
    k = round(fraction * scored.count())
    return scored.withColumn("selected", F.col("gumbel_key") >= F.lit(kth_largest(scored, "gumbel_key", k)))

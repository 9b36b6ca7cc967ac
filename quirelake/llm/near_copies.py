"""Near copies of whole texts: SimHash links by the grid range-join, links of exact Jaccard similarity by MinHash banding, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ._shared import free_names, text_of, written
from .components import bucket_links, components
from .paragraphs import SHINGLE, _alike, _rolled
from .simhash import fingerprint, fingerprint_links

#: 12 bands of 3 rows find a pair of Jaccard similarity 0.8 with probability 0.9998.
BANDS, ROWS = 12, 3
#: Shingles that are hashed at a time.
CHUNK = 1 << 15

_rng = np.random.default_rng(21)
_MULTIPLIER = _rng.integers(1, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_OFFSET = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REMEMBERED = 400_000
_hashes: dict[bytes, int] = {}


def _words(text: str | None) -> list[bytes]:
    """Words as ``simhash`` takes them: between blanks, ASCII letters in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """The set of 64-bit hashes of five-word shingles; fewer words are one shingle, none have none."""
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 13)] if words else [], np.uint64)
    h = list(map(_hashes.get, words))
    for i, v in enumerate(h):
        if v is None:
            if len(_hashes) >= _REMEMBERED:
                _hashes.clear()
            h[i] = _hashes[words[i]] = xxhash.xxh64_intdigest(words[i], 12)
    return np.unique(_rolled(np.array(h, np.uint64)))


def bands(s: np.ndarray) -> np.ndarray | None:
    """One key per band of a shingle set; none for the empty set."""
    if not len(s):
        return None
    least = np.min([(s[at : at + CHUNK] * _MULTIPLIER + _OFFSET).min(1) for at in range(0, len(s), CHUNK)], axis=0).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = ((key ^ (key >> np.uint64(32))) * _MIX) ^ least[:, r]
    return key.view(np.int64)


def _node(words: list[bytes]) -> int:
    value = xxhash.xxh64_intdigest(b" ".join(words), 14)
    return value - (1 << 64) if value >> 63 else value


@F.arrow_udf(LongType())
def _content(texts: pa.Array) -> pa.Array:
    return pa.array([None if (text := t.as_py()) is None else _node(_words(text)) for t in texts], pa.int64())


@F.arrow_udf(StructType([StructField("node", LongType()), StructField("fp", LongType()), StructField("bands", ArrayType(LongType()))]))
def _printed(texts: pa.Array) -> pa.Array:
    nodes, prints, keys = [], [], []
    for t in texts:
        text = t.as_py()
        words = _words(text)
        nodes.append(_node(words))
        prints.append(fingerprint(text))
        keys.append(bands(shingles(words)))
    arrays = [pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(arrays, names=["node", "fp", "bands"])


@F.arrow_udf(ArrayType(LongType()))
def _sets(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(_words(t.as_py())).view(np.int64) for t in texts], pa.list_(pa.int64()))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, one for each group of near copies: that with the smallest id.

    Texts are near copies if their SimHash fingerprints (three-word shingles)
    differ in 2 bits at most, all such pairs being found by the grid range-join
    of ``simhash``, and also at a Jaccard similarity of at least 0.8 of their
    five-word shingles, found among texts that collide in a band: such pairs
    mostly differ in more bits than a grid can be wide.  Groups are the
    components of both relations.  Texts of the same words count once in the
    search.  Null and empty texts are copies of each other; texts of fewer than
    five words match if their words do; null ids come last; among rows that
    share the smallest id one text stays, and one of repeated rows; other
    columns pass through; an empty table gives an empty result.

    Texts move to the words of their ids twice: where candidates are compared,
    and where the rows that stay are picked.
    """
    # a struct, so that a null id is a key like any other
    named = df.select(F.struct(F.col(doc_id).alias("id")).alias("id"), text_of(text).alias("text"))
    prints = written(named.select("id", _printed("text").alias("p")).select("id", "p.*"), "prints")
    nodes = written(prints.groupBy("node").agg(_first_id("id").alias("least"), F.min("fp").alias("fp")), "nodes")
    collided = prints.select(F.explode("bands").alias("key"), "node").distinct()

    def sets(wanted: DataFrame) -> DataFrame:
        chosen = nodes.join(wanted, "node", "left_semi").select(F.col("node").alias("n"), F.col("least").alias("id"))
        # rows of an id may differ in text: the content decides
        texts = named.join(chosen, "id").withColumn("node", _content("text")).where("node = n")
        return texts.groupBy("node").agg(F.any_value("text").alias("text")).select("node", _sets("text").alias("data"))

    grouped = components(bucket_links(collided, _alike, sets).unionByName(_print_links(nodes)))
    kept = (
        nodes.join(grouped, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("group"))
        .agg(F.min(F.struct(F.col("least.id").isNull().alias("none"), "least", "node")).alias("k"))
        .select(F.col("k.least").alias("id"), F.col("k.node").alias("node"))
    )
    times = prints.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    key, keep, node, number = free_names(df, "_key", "_keep", "_node", "_number")
    picked = kept.join(times, "id").select(F.col("id").alias(key), F.struct("node", "times").alias(keep))
    joined = df.withColumn(key, F.struct(F.col(doc_id).alias("id"))).join(picked, key)
    # only ids that occur more than once need their contents
    repeated = F.col(keep)["times"] > 1
    chosen = joined.withColumn(node, _content(F.when(repeated, text_of(text)))).where(~repeated | (F.col(node) == F.col(keep)["node"]))
    once = F.row_number().over(W.partitionBy(key, keep).orderBy(key))
    return chosen.withColumn(number, once).where(F.col(number) == 1).select(*df.columns)


def _print_links(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of near fingerprints; nodes of one fingerprint are linked to the smallest of them, which stands for it."""
    stands = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.hint("merge").join(stands, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = fingerprint_links(stands)
    for end in "ab":
        near = near.hint("merge").join(stands.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}")), end)
    return same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _first_id(column: str):
    """The least of some ids, null last."""
    return F.min(F.struct(F.col(column)["id"].isNull().alias("none"), column))[column]

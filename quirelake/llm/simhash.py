"""SimHash near-duplicates: segment-popcount embedding and a grid range-join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._shared import free_names, text_of, written
from .components import bucket_links, components

SEED = 42
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 20
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SPACE = b" \t\n\r\x0b\x0c"


def _chunks(data: bytes):
    """The words of ``data``, about CHUNK bytes at a time."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text, as a signed integer; 0 without words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    votes, total, kept = np.zeros(64, np.int64), 0, []
    for words in _chunks(data):
        kept += words
        if len(kept) < shingle:
            continue
        joined = b" ".join(kept)
        size = np.fromiter(map(len, kept), np.int64, len(kept))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(kept) - shingle + 1].tolist()
        end = end[shingle - 1 :].tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(start, end, strict=True)), np.uint64, len(start))
        columns = hashes.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            votes[8 * j : 8 * j + 8] += np.bincount(columns[:, j], minlength=256) @ _BITS
        total += len(start)
        kept = kept[len(kept) - shingle + 1 :] if shingle > 1 else []
    if not total:
        if not kept:
            return 0
        value = xxhash.xxh64_intdigest(b" ".join(kept), SEED)
    else:
        value = sum(1 << int(b) for b in np.flatnonzero(2 * votes > total))
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """Adds ``into``: the fingerprint of each whole text (null: the empty text) as a long."""

    @F.arrow_udf(LongType())
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return df.withColumn(into, hashed(text_of(text)))


def embedded(fp: Column) -> Column:
    """16 counts of set bits, one for each 4 bits of a fingerprint, packed 4 bits each.

    Each count is one too high, so that a neighbour in the grid never borrows.
    """
    fives, threes = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    a, b = fp.bitwiseAND(fives), F.shiftrightunsigned(fp, 1).bitwiseAND(fives)
    pairs = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    fours = pairs.bitwiseAND(threes) + F.shiftrightunsigned(pairs, 2).bitwiseAND(threes)
    return fours + F.lit(0x1111111111111111)


#: The cell itself and those one step away along each of the 16 axes.
_STEPS = [0] + [s << (4 * j) for j in range(16) for s in (1, -1)]


def fingerprint_links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): pairs of different fingerprints, at most 2 bits apart, that join up all such pairs.

    A flipped bit moves one count by one, so the Manhattan distance of two
    embeddings is at most the number of differing bits.  Points within
    distance 2 on the integer grid always have a point within 1 of both; every
    fingerprint therefore enters its own cell and the 32 next to it, and pairs
    meet in a cell they share.  The bits themselves are compared there.
    """
    cells = prints.select(
        F.explode(F.transform(F.array(*[F.lit(s).cast("long") for s in _STEPS]), lambda s: embedded(F.col(fp)) + s)).alias("key"),
        F.col(fp).alias("node"),
    )
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2
    return bucket_links(cells, near)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``df``.

    Texts link at 2 or fewer differing bits of their fingerprints; component_id
    is the smallest id reachable over links.  Exact copies share a fingerprint
    and count once in the search, so a group of copies of any size costs one
    entry.  Null and empty texts have fingerprint zero, linked like any other;
    null ids are kept but never name a component, unless no id does (null);
    repeated rows stay repeated; other columns are not read; an empty table
    gives an empty result.
    """
    prints = written(
        with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle).select("doc_id", "fp"),
        "fingerprints",
    )
    named = groups(prints)
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def groups(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for the fingerprints of a (doc_id, fp) table."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    named = components(fingerprint_links(distinct))
    rooted = distinct.join(named.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(rooted.join(least, "root").select("fp", "component_id"), "groups")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``df``, one for each component of ``near_duplicates``: that with the smallest id.

    Among rows that share this id the smallest fingerprint stays, and one of
    repeated rows.  Null and empty texts are copies of each other; components
    without any id keep one row too; other columns pass through; an empty table
    gives an empty result.
    """
    key, fp, keep, number = free_names(df, "_key", "_fp", "_keep", "_number")
    # a struct, so that a null id is a key like any other
    marked = with_fingerprint(df, text, fp, shingle).withColumn(key, F.struct(F.col(doc_id).alias("id"), F.col(fp).alias("fp")))
    prints = written(marked.select(F.col(key)["id"].alias("doc_id"), F.col(key)["fp"].alias("fp")), "fingerprints")
    kept = (
        prints.join(groups(prints), "fp")
        .groupBy(F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("no id: "), "fp")).alias("group"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k"))
        .select(F.struct(F.col("k.doc_id").alias("id"), F.col("k.fp").alias("fp")).alias(keep))
    )
    joined = marked.join(kept, marked[key] == kept[keep], "left_semi")
    return joined.withColumn(number, F.row_number().over(W.partitionBy(key).orderBy(key))).where(F.col(number) == 1).select(*df.columns)

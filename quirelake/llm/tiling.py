"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ._shared import free_names, text_of, written

#: Words of a seed, and of the shortest tile.
SEED = 5
#: Bytes of benchmark text in a block, and blocks whose indexes a worker holds at once; more blocks take more passes over the documents.
BLOCK_BYTES, HELD = 8 << 20, 4
_WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PRIME, _ROOT = (1 << 61) - 1, 0x1F0A5C2B3D49

FOUND = ArrayType(
    StructType(
        [
            StructField("item_id", LongType()),
            StructField("coverage", DoubleType()),
            StructField("first_word", LongType()),
            StructField("last_word", LongType()),
        ]
    )
)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def tiles(pattern: list, text: list, least: int = SEED) -> list[tuple[int, int, int]]:
    """Running Karp-Rabin greedy string tiling: (start in pattern, start in text, length).

    Longest matches of unmarked tokens are marked first; ``text`` may hold None,
    which matches nothing.  Tiles never overlap in either sequence, so the order
    of the passages doesn't matter.
    """
    p_free, t_free = [True] * len(pattern), [x is not None for x in text]
    out = []
    size = max(least, len(pattern))
    while True:
        found: list[tuple[int, int, int]] = []
        longest = size
        where: dict[int, list[int]] = {}
        for i, h in _windows(pattern, p_free, size):
            where.setdefault(h, []).append(i)
        if where:
            for j, h in _windows(text, t_free, size):
                for i in where.get(h, ()):
                    k = 0
                    while i + k < len(pattern) and j + k < len(text) and p_free[i + k] and t_free[j + k] and pattern[i + k] == text[j + k]:
                        k += 1
                    if k >= size:
                        found.append((k, i, j))
                        longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(p_free[i : i + k]) and all(t_free[j : j + k]):
                for x in range(k):
                    p_free[i + x] = t_free[j + x] = False
                out.append((i, j, k))
            elif any(p_free[i : i + k]) and any(t_free[j : j + k]):
                # what an earlier tile left of the match
                run = 0
                for x in range(k + 1):
                    if x < k and p_free[i + x] and t_free[j + x]:
                        run += 1
                        continue
                    if run >= size:
                        for y in range(x - run, x):
                            p_free[i + y] = t_free[j + y] = False
                        out.append((i + x - run, j + x - run, run))
                    run = 0
        if size <= least or not any(p_free):
            return out
        size = max(least, size // 2)


def _windows(words: list, free: list[bool], size: int):
    """(start, hash) of all windows of free words; the hash rolls from a window to the next."""
    run, value, top = 0, 0, pow(_ROOT, size, _PRIME)
    for end, ok in enumerate(free):
        if not ok:
            run = value = 0
            continue
        value = (value * _ROOT + words[end] + 1) % _PRIME
        if run >= size:
            value = (value - (words[end - size] + 1) * top) % _PRIME
        run += 1
        if run >= size:
            yield end - size + 1, value


class Index:
    """The seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int], int]] = []
        seeds: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if not ids:
                continue
            size = min(SEED, len(ids))
            self.items.append((item_id, ids, size))
            at = len(self.items) - 1
            for h in set(self.rolled(np.array(ids, np.int64), size).tolist()):
                seeds.setdefault(size, {}).setdefault(h, []).append(at)
        self.seeds = {size: (np.array(sorted(by), np.uint64), by) for size, by in seeds.items()}

    @staticmethod
    def rolled(ids: np.ndarray, size: int) -> np.ndarray:
        """Polynomial hashes of all windows; meaningless where a window holds an unknown word."""
        n = len(ids) - size + 1
        h = np.zeros(max(n, 0), np.uint64)
        for k in range(size):
            h = h * _BASE + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        return h

    def search(self, text: str | None, threshold: float) -> list[dict]:
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
        touched: dict[int, list[int]] = {}
        for size, (known, by) in self.seeds.items():
            if len(ids) < size:
                continue
            gaps = np.cumsum(np.concatenate(([0], ids < 0)))
            starts = np.flatnonzero(gaps[size:] == gaps[:-size])
            if not len(starts):
                continue
            h = self.rolled(ids, size)[starts]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            for start, key in zip(starts[hit].tolist(), h[hit].tolist(), strict=True):
                for item in by[key]:
                    touched.setdefault(item, []).append(start)
        out = []
        for item, starts in touched.items():
            item_id, pattern, size = self.items[item]
            # only words inside a seed of this item can be part of a tile
            line, places, end = [], [], -1
            for s in starts:
                if s > end:
                    line.append(None)
                    places.append(-1)
                for x in range(max(s, end), s + size):
                    line.append(int(ids[x]))
                    places.append(x)
                end = s + size
            found = tiles(pattern, line, size)
            covered = sum(k for _, _, k in found)
            if covered and covered >= threshold * len(pattern):
                out.append(
                    {
                        "item_id": item_id,
                        "coverage": covered / len(pattern),
                        "first_word": min(places[j] for _, j, _ in found),
                        "last_word": max(places[j + k - 1] for _, j, k in found),
                    }
                )
        return sorted(out, key=lambda r: (-r["coverage"], r["item_id"]))


def matches(
    df: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leaks", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8
) -> DataFrame:
    """Adds ``into``: the benchmark items of which each text holds ``threshold`` of the words in tiles.

    A tile is a run of at least five words (the whole item, if shorter) that text
    and item share; tiles don't overlap, their order is free, so reordered
    passages count.  Items come in the order of falling coverage.  The benchmark
    is taken in blocks of about BLOCK_BYTES of text, each of which is sent to
    all executors; a pass over the rows searches HELD blocks, and what it found
    is a written table for the next one.  Rows never shuffle.

    Items without words or without id match nothing; null and empty texts hold
    nothing; repeated items count once (the ids are compared); very long texts
    are one pass over their words; an existing column ``into`` is replaced;
    other columns and repeated rows pass through; an empty benchmark or an
    empty table gives empty lists or no rows.
    """
    spark = df.sparkSession
    items = (
        benchmark.select(F.col(item_id).cast("long").alias("i"), text_of(item_text).alias("t"))
        .where(F.col("i").isNotNull())
        .distinct()
        .withColumn("b", F.octet_length("t"))
    )
    total, longest = items.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()
    blocks = -(-total // max(1, BLOCK_BYTES - min(longest, BLOCK_BYTES // 2))) or 1
    if into.lower() != text.lower():
        df = df.drop(into)
    columns = free_names(df, *[f"_leaks_{n}" for n in range(blocks)])
    for n, name in enumerate(columns):
        # rows spread evenly over the blocks, so that one block stays near BLOCK_BYTES
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n).select("i", "t").toLocalIterator()
        sent = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part])
        if n and n % HELD == 0:
            df = written(df, "leaks")
        df = df.withColumn(name, _searcher(sent, threshold)(text_of(text)))
    falling = F.array_sort(F.transform(F.flatten(F.array(*columns)), lambda x: F.struct((-x["coverage"]).alias("o"), x["item_id"].alias("i"), x.alias("x"))))
    return df.withColumn(into, F.transform(falling, lambda r: r["x"])).drop(*columns)


_indexes: dict[int, tuple] = {}


def _searcher(sent, threshold: float):
    @F.arrow_udf(FOUND)
    def search(texts: pa.Array) -> pa.Array:
        items = sent.value
        if _indexes.get(id(items), (None,))[0] is not items:
            while len(_indexes) >= HELD:
                del _indexes[next(iter(_indexes))]
            _indexes[id(items)] = (items, Index(items))
        index = _indexes[id(items)][1]
        kind = pa.list_(
            pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
        )
        return pa.array([index.search(t.as_py(), threshold) for t in texts], kind)

    return search


def clean(df: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``df`` whose text leaks no benchmark item, with its columns.

    Null and empty texts leak nothing and stay, repeated rows stay or go
    together, an empty benchmark removes nothing, an empty table gives an empty
    result; see ``matches``.
    """
    (leaks,) = free_names(df, "_leaks")
    return matches(df, benchmark, into=leaks, **how).where(F.size(leaks) == 0).select(*df.columns)

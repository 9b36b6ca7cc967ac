"""Exact top-k inner-product search by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import written

#: Vectors of one packed block (fewer if they are long), bytes of its doubles, dimensions of one step.
CANDIDATES, QUERIES, BLOCK, STEP = 4096, 1024, 4 << 20, 16
#: Bytes of packed queries that a task holds, so many pieces of work for each core.
HELD, PIECES = 48 << 20, 8
_LONG = 2**63 - 1
_PACKED = "dim int, n int, ids binary, cols binary, width int, wide boolean"
_TYPES = {2: np.int16, 4: np.int32, 8: np.float64}


def _quantized(df: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector, as doubles."""
    x = F.col(embedding)
    usable = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    )
    return df.where(usable).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("double")).alias("v"),
    )


def _packer(size: int):
    """Packs rows of a partition into blocks in vertical layout: one run of values per dimension, in 2 or 4 bytes where they fit."""

    def pack(batches):
        held: dict[int, list] = {}

        def emit(dim, ids, rows):
            m = np.array(rows, dtype=np.float64).reshape(len(ids), dim)
            most = float(np.abs(m).max()) if m.size else 0.0
            width = 2 if most < 2**15 else 4 if most < 2**31 else 8
            return pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()),
                    "n": pa.array([len(ids)], pa.int32()),
                    "ids": pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                    "cols": pa.array([np.ascontiguousarray(m.T).astype(_TYPES[width]).tobytes()], pa.binary()),
                    "width": pa.array([width], pa.int32()),
                    "wide": pa.array([dim * most**2 >= 2.0**52], pa.bool_()),
                }
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) >= min(size, max(1, BLOCK // (8 * max(1, len(v))))):
                    yield emit(len(v), ids, rows)
                    held[len(v)] = ([], [])
        for dim, (ids, rows) in held.items():
            if ids:
                yield emit(dim, ids, rows)

    return pack


def _rest(c):
    """Where the steps of dimensions begin, and the masses of each candidate from there on (a little is added against rounding)."""
    dims = len(c)
    cuts = [*range(0, dims, STEP), dims] if dims else [0]
    return cuts, [np.sqrt((c[a:] ** 2).sum(0)) * (1 + 1e-9) for a in cuts]


def search_block(qi, q, ci, c, k: int, rest=None, least=None):
    """The k best candidates of each query: (query, candidate ids, scores), where there are any; a query is its place in ``qi``.

    ``q`` is (queries, dims), ``c`` is (dims, candidates), both whole numbers so
    small that sums of doubles are exact.  Scores grow one step of dimensions at
    a time; a candidate is dropped as soon as its score so far plus the product
    of the remaining masses (Cauchy-Schwarz) is below the k-th best found.
    ``least`` has the k-th best that each query found elsewhere (-inf: none).
    """
    dims, n = c.shape
    cuts, c_rest = rest or _rest(c)
    first = cuts[1] if dims else 0
    out = []
    for low in range(0, len(qi), 64):
        part = q[low : low + 64].astype(np.float64)
        q_rest = [np.sqrt((part[:, a:] ** 2).sum(1)) * (1 + 1e-9) for a in cuts]
        start = part[:, :first] @ c[:first]
        reach = start + np.outer(q_rest[1], c_rest[1]) if dims else start
        known = np.full(len(part), -np.inf) if least is None else least[low : low + 64]
        probe = min(n, 4 * k + 1)
        for r in np.flatnonzero((reach >= known[:, None]).any(1)).tolist():
            own, bound = int(qi[low + r]), known[r]
            if bound == -np.inf:
                best = np.argpartition(reach[r], n - probe)[n - probe :]
                best = best[ci[best] != own]
                if len(best) >= k:
                    bound = np.partition(part[r] @ c[:, best], len(best) - k)[len(best) - k]
            alive = np.flatnonzero(reach[r] >= bound)
            alive = alive[ci[alive] != own]
            score = start[r, alive]
            for s in range(1, len(cuts) - 1):
                if not len(alive):
                    break
                a, b = cuts[s], cuts[s + 1]
                score = score + part[r, a:b] @ c[a:b, alive]
                keep = score + q_rest[s + 1][r] * c_rest[s + 1][alive] >= bound
                if not keep.all():
                    alive, score = alive[keep], score[keep]
            if len(alive):
                order = np.lexsort((ci[alive], -score))[:k]
                out.append((low + r, ci[alive[order]], score[order]))
    return out


class _Asked:
    """A block of queries and the best that it has met so far."""

    def __init__(self, row: dict, k: int):
        self.k, self.wide = k, row["wide"]
        self.ids, self.vectors = np.frombuffer(row["ids"], np.int64), _matrix(row).T
        self.found, self.scores = np.zeros((len(self.ids), k), np.int64), np.zeros((len(self.ids), k), np.int64)
        self.n, self.least = np.zeros(len(self.ids), np.int32), np.full(len(self.ids), -np.inf)

    def meet(self, ci, c, wide: bool, rest) -> None:
        if wide or self.wide:
            new = [(r, *x[1:]) for r, x in enumerate(_search_wide(self.ids, self.vectors, ci, c, self.k))]
        else:
            new = search_block(self.ids, self.vectors, ci, c, self.k, rest, self.least)
        for r, ids, scores in new:
            ids = np.concatenate((self.found[r, : self.n[r]], ids))
            scores = np.concatenate((self.scores[r, : self.n[r]], np.asarray(scores).astype(np.int64)))
            # not by -scores, which the smallest long has none of
            order = np.lexsort((ids, ~scores))[: self.k]
            self.n[r] = len(order)
            self.found[r, : len(order)], self.scores[r, : len(order)] = ids[order], scores[order]
            if len(order) == self.k:
                self.least[r] = float(self.scores[r, -1])

    def rows(self) -> pa.RecordBatch:
        has = np.arange(self.k) < self.n[:, None]
        columns = [np.repeat(self.ids, self.n), self.found[has], self.scores[has]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "vec_id", "score"])


def _matrix(row: dict):
    return np.frombuffer(row["cols"], _TYPES[row["width"]]).reshape(row["dim"], row["n"])


def _search(k: int):
    """Of each cell (dim, part, group) the query blocks come first and are held, then candidate blocks pass one by one."""

    def search(batches):
        cell, asked = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (at := (row["dim"], row["part"], row["g"])) != cell:
                    yield from (x.rows() for x in asked)
                    cell, asked = at, []
                if row["side"] == 0:
                    asked.append(_Asked(row, k))
                elif asked:
                    ci, c = np.frombuffer(row["ids"], np.int64), _matrix(row).astype(np.float64)
                    rest = _rest(c)
                    for x in asked:
                        x.meet(ci, c, row["wide"], rest)
        yield from (x.rows() for x in asked)

    return search


def _search_wide(qi, q, ci, c, k: int):
    """The same, for all queries, for values whose sums doubles can't hold: whole numbers of any size."""
    out = []
    columns = [[int(x) for x in col] for col in c.T]
    for own, row in zip(qi, q, strict=True):
        row = [int(x) for x in row]
        scored = sorted(
            (-max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(row, col, strict=True)))), int(i))
            for i, col in zip(ci, columns, strict=True)
            if i != own
        )[:k]
        out.append((int(own), np.array([i for _, i in scored], np.int64), np.array([-s for s, _ in scored], np.int64)))
    return out


def spread(query_bytes: int, partitions: int, cores: int) -> tuple[int, int]:
    """(parts, groups): into how many the packed queries and the candidates are dealt; each part meets each group.

    All candidates are moved once a part and all queries once a group, so both
    are few: parts by what a task holds, groups by what keeps the cores busy.
    """
    parts = max(1, -(-query_bytes // HELD))
    return parts, max(2, min(partitions, PIECES * cores) // parts)


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, by integer inner product.

    Queries are the rows for which ``queries`` holds; candidates are all rows
    with another id.  Components are floor(scale * x).  Vectors meet only
    vectors of their own length.  Both sides are packed into bounded blocks in
    vertical layout, queries into parts of about HELD bytes and candidates into
    groups.  A task sorts the blocks of a part and a group, holds the queries
    with their best so far, whose k-th bounds the search, and lets the
    candidates pass block by block; each query leaves at most k rows there, from
    which the best k are taken.  Neither side is broadcast or collected.

    Null ids, null vectors and vectors with null or non-finite components take
    no part; ties go to the smaller id; every repeat of a row is a candidate of
    its own; rows of one id ask together, once for each different vector;
    components and scores beyond a long are held at its ends; columns besides
    the two named ones are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = _quantized(vectors, vec_id, embedding, scale)
    asked = written(
        _quantized(vectors.where(queries), vec_id, embedding, scale).dropDuplicates(["id", "v"]).mapInArrow(_packer(QUERIES), _PACKED), "asked"
    )
    size = asked.agg(F.sum(F.octet_length("ids") + F.octet_length("cols"))).first()[0] or 0
    parts, groups = spread(size, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    drawn = F.xxhash64("ids")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = asked.select("*", F.lit(0).alias("side"), F.pmod(drawn, F.lit(parts)).alias("part"), every(groups).alias("g"))
    blocks = rows.mapInArrow(_packer(CANDIDATES), _PACKED)
    c = blocks.select("*", F.lit(1).alias("side"), every(parts).alias("part"), F.pmod(drawn, F.lit(groups)).alias("g"))
    cell = ["dim", "part", "g"]
    met = q.unionByName(c).repartition(max(2, parts * groups), *cell).sortWithinPartitions(*cell, "side")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )

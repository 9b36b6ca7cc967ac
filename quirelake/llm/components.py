"""Connected components of a link table, distributed and restartable."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, written

#: Members of a bucket that all others meet at once after the smallest; each further round takes so many times more.
HUBS = 8
#: Links that one task joins up by itself.
CHUNK = 1 << 18


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Tasks of at most CHUNK links each first join up their own links; a table
    that fits one task is settled by that.  What is left alternates this with
    the large-star and small-star steps of Kiveris et al. ("Connected Components
    in MapReduce and Beyond", 2014), which need O(log^2 n) rounds.
    Every step first takes a minimum per node (combined before the shuffle) and
    joins it back, so no task gathers the neighbours of a hub, and nothing is
    broadcast, so nothing passes through the driver.  Each round is a written
    table: a lost executor costs one round at most, and the plan doesn't grow.
    Links with a null end, self links and repeats are harmless; an empty link
    table gives an empty result.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "links",
    )
    while n := edges.count():
        parts = -(-n // CHUNK)
        dealt = edges.repartition(1) if parts == 1 else edges.repartition(parts, "u", "v")
        old, edges = edges, written(dealt.mapInArrow(_joined_up, edges.schema), "joined")
        dropped(old)
        if parts == 1 or _stars(edges):
            break
        old, edges = edges, written(_small_star(_large_star(edges)), "round")
        dropped(old)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def _joined_up(batches):
    """Links of each node of about CHUNK links to the smallest that they reach."""
    parent: dict = {}
    schema, seen = None, 0

    def root(x):
        up = parent.setdefault(x, x)
        while up != (over := parent[up]):
            parent[x] = over
            x, up = up, over
        return up

    def settled():
        rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
        for low in range(0, len(rows), 1 << 16):
            u, v = zip(*rows[low : low + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, schema.types[0]), pa.array(v, schema.types[1])], schema=schema)

    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        seen += batch.num_rows
        if seen >= 2 * CHUNK:
            yield from settled()
            parent, seen = {}, 0
    yield from settled()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link at most to a smaller one, which has none itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    node = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not node.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.hint("merge").join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.hint("merge").join(least, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(joined.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def bucket_links(buckets: DataFrame, alike, data=None) -> DataFrame:
    """(a, b), a < b: links that join up all that meets in a bucket.

    ``buckets`` has (key, node) rows.  ``alike`` is a condition on the data of
    two nodes; ``data`` takes the table of nodes that share a bucket and returns
    (node, data) rows.  Without it a node is its own data.

    Emitting all pairs of a bucket would be quadratic in groups of copies.
    Instead each member first meets the smallest of its bucket; that settles
    the groups whose members are all alike.  In a bucket that is still in
    several components all members then meet about HUBS members drawn by hash,
    then HUBS times as many, until they settle or all are drawn; members that
    are in one component by then don't meet again.  So a group of alike members
    gives out about HUBS links a member however large it is, and the components
    are exactly those of all linked pairs of all buckets.  Comparing (not what
    is given out) stays quadratic in a bucket whose members are mostly unlike.
    """
    hubs = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = written(buckets.hint("merge").join(hubs, "key"), "crowded")
    known = None if data is None else written(data(crowded.select("node").distinct()), "data")

    def with_data(df: DataFrame, node: str, into: str) -> DataFrame:
        if known is None:
            return df.withColumn(into, F.col(node))
        return df.hint("merge").join(known.select(F.col("node").alias(node), F.col("data").alias(into)), node)

    pairs = crowded.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    if known is not None:
        pairs = written(pairs.distinct(), "pairs")
    first = with_data(with_data(pairs, "a", "_da"), "b", "_db").where(alike(F.col("_da"), F.col("_db"))).select("a", "b")
    first = written(first.distinct(), "links")
    named = components(first)
    member = (
        crowded.where("n > 2")
        .hint("merge").join(named, "node", "left")
        .select("key", "node", "hub", F.coalesce("component", "node").alias("c"))
    )
    split = member.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", "n")
    # pairs with the hub were checked already
    open_ = written(with_data(member.where("node <> hub").hint("merge").join(split, "key"), "node", "d").select("key", "node", "c", "d", "n"), "open")
    dropped(crowded, *([] if known is None else [known, pairs]))
    links, hubs_now = first, HUBS
    while (largest := open_.agg(F.max("n")).first()[0]) is not None:
        drawn = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 30)) * F.col("n") < F.lit(hubs_now << 30)
        x, y = open_.where(drawn | (F.col("n") <= hubs_now)).alias("x"), open_.alias("y")
        meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & alike(F.col("x.d"), F.col("y.d"))
        ends = [F.struct(F.col(f"{side}.node").alias("node"), F.col(f"{side}.c").alias("c")) for side in "xy"]
        found = written(x.hint("merge").join(y, meets).select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct(), "links")
        links = links.unionByName(found.select("a.node", "b.node").toDF("a", "b"))
        if largest <= hubs_now:
            break
        joined = components(found.select("a.c", "b.c").toDF("a", "b")).withColumnsRenamed({"node": "c", "component": "into"})
        left = open_.where(F.col("n") > hubs_now).hint("merge").join(joined, "c", "left").select("key", "node", F.coalesce("into", "c").alias("c"), "d", "n")
        still = left.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        old, open_ = open_, written(left.hint("merge").join(still, "key", "left_semi"), "open")
        dropped(old)
        hubs_now *= HUBS
    dropped(open_)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

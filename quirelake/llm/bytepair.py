"""Byte-level BPE: encoding by a fold of ranked merges in higher-order functions, and decoding."""

from __future__ import annotations

import base64
import heapq
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ._shared import free_names, text_of, written

#: Buckets of the table of words: a bucket holds a few entries, so a lookup takes constant time.
WORDS = 1 << 18
#: Frequent words that are folded once and looked up, their longest, and the texts (bytes, about) in which they are counted.
#: The table only saves time: any word not in it is folded in its row, with the same result.
FREQUENT, FREQUENT_BYTES, COUNTED_BYTES = 500_000, 32, 160 << 20
#: Words of a text that share one table of folded words.
STRETCH = 1000
#: Longer words (bytes) are encoded by a heap of merges: the fold takes quadratic time in a word's length.
LONG = 4096
#: What stands for the ids of a word that is still to be encoded.
MISSED = "-"
#: An id takes so many bits; a pair that doesn't merge has the rank NONE, above all others.
BITS = 17
NONE, MASK = 1 << 20, (1 << BITS) - 1


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _mark(byte: int) -> Column:
    """A byte that no UTF-8 text holds, so no word either."""
    return F.lit(bytes([byte])).cast("string")


def _looked_up(table: Column, word: Column) -> Column:
    """The value of a word in a table by buckets; MISSED if it has none."""
    cut = lambda x, mark, n: F.call_function("substring_index", x, mark, F.lit(n))
    after = cut(F.get(table, _word_bucket(word)), F.concat(_mark(0xFF), word, _mark(0xFE)), -1)
    # a bucket without the word is left whole and begins with MISSED
    return cut(after, _mark(0xFF), 1)


def _word_bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(WORDS - 1))


def _as_table(entries: DataFrame, name: str) -> DataFrame:
    """One row with one column: the (bucket, key, value, times) rows of words as an array of buckets, each a string of marked keys and values.

    Lookups search from the end, so the words that occur most come last.
    """
    none = F.lit(None).cast("string")
    places = entries.sparkSession.range(WORDS).select(F.col("id").cast("int").alias("bucket"), none.alias("key"), none.alias("value"), F.lit(0).cast("long").alias("times"))
    marked = F.concat(_mark(0xFF), F.col("key"), _mark(0xFE), F.col("value"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("times", marked.alias("m")))))
    texts = F.array_join(F.transform(pairs, lambda p: p["m"]), "")
    held = entries.unionByName(places).groupBy("bucket").agg(F.concat(F.lit(MISSED), texts, _mark(0xFF)).alias("held"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "held")))
    return written(held.agg(F.transform(ordered, lambda b: b["held"]).alias("t")), name)


def displaced(rows: dict[int, dict[int, int]], ids: int) -> np.ndarray:
    """A map of pairs of ids below ``ids`` as one array: place a holds the start of a's row, place start + b the value, with a above it.

    Rows are laid over each other where their places are free (row
    displacement), the longest first; a place that another id's row fills
    shows that id.
    """
    rng = np.random.default_rng(10)
    places = 2 * (sum(map(len, rows.values())) + ids)
    out = np.full(2 * ids + places, -1, np.int64)
    out[:ids] = ids
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        b, value = np.array([*row], np.int64), np.array([*row.values()], np.int64)
        while (out[(start := ids + int(rng.integers(places))) + b] >= 0).any():
            pass
        out[a], out[start + b] = start, a << BITS | value
    return out


class Encoder:
    """Expressions over one rank file.

    Rank map, pieces and frequent words are one value each, of bounded size: a
    scalar subquery over a written table, which the executed plan holds as a
    literal.  Functions over arrays can't hold subqueries, so ``applied`` passes
    them as columns that are used once: the optimizer puts the literal in their
    place and no row ever holds it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ranks = spark, path, read_ranks(path)
        self.bytes = F.from_json(F.lit(str([self.ranks[bytes([b])] for b in range(256)])), "array<bigint>")

    def _one_row(self, value, kind: pa.DataType, name: str, cast: str | None = None) -> DataFrame:
        row = self.spark.createDataFrame(pa.table({"t": pa.array([value], kind)}))
        return written(row.select(F.col("t").cast(cast)) if cast else row, name)

    @cached_property
    def rank_map(self) -> DataFrame:
        """The rank of every pair of tokens whose bytes together are a token."""
        rows: dict[int, dict[int, int]] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    rows.setdefault(a, {})[b] = rank
        return self._one_row(displaced(rows, max(self.ranks.values()) + 1), pa.list_(pa.int64()), "ranks")

    @cached_property
    def pieces(self) -> DataFrame:
        """The bytes of every id, as an array by id (of strings, that is bytes of any kind, so that they can be joined)."""
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            by_id[rank] = token
        return self._one_row(by_id, pa.list_(pa.binary()), "pieces", "array<string>")

    @cached_property
    def whole(self) -> DataFrame:
        """Tokens that are texts, each with its id: such a word is one token, whatever its merges give."""
        texts = {}
        for token, rank in self.ranks.items():
            try:
                texts[token.decode()] = str(rank)
            except UnicodeDecodeError:
                continue
        return self.spark.createDataFrame(pa.table({"key": pa.array(texts.keys(), pa.string()), "value": pa.array(texts.values(), pa.string())}))

    def frequent(self, texts: DataFrame, pattern: str) -> DataFrame:
        """Tokens that are texts and frequent words of the column ``t``, each with its ids as text, by bucket of the word."""
        drawn = texts.where(F.octet_length("t") < 1 << 20)
        size = drawn.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
        if size > COUNTED_BYTES:
            drawn = drawn.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(COUNTED_BYTES / size * (1 << 30)))
        counted = (
            drawn.select(F.explode(words_of(F.col("t"), pattern)).alias("key"))
            .groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"))
            .where((F.col("n") > 1) & (F.octet_length("key") <= FREQUENT_BYTES))
            .orderBy(F.desc("n"), "key")
            .limit(FREQUENT)
        )
        chosen = written(counted.select("key", F.col("n").alias("times")), "frequent")
        # what is a token as a whole isn't folded
        rest = chosen.join(self.whole, "key", "left_anti").repartition(self.spark.sparkContext.defaultParallelism, "key")
        folded = self.applied(rest, "value", lambda ranks: as_text(self.fold(ranks, F.col("key"))), self.rank_map)
        whole = self.whole.join(chosen, "key", "left").select("key", "value", F.coalesce("times", F.lit(0)).alias("times"))
        entries = folded.unionByName(whole).select(_word_bucket(F.col("key")).alias("bucket"), "key", "value", "times")
        return _as_table(entries, "words")

    def applied(self, df: DataFrame, into: str, body, *tables: DataFrame) -> DataFrame:
        """``df`` with the column ``into``, which ``body`` makes from the tables' values."""
        names = free_names(df, *[f"_table{n}" for n in range(len(tables))])

        def bound(held: tuple, left: list[str]) -> Column:
            return _let(F.col(left[0]), lambda value: bound((*held, value), left[1:])) if left else body(*held)

        held = df.select("*", *[t.scalar().alias(n) for t, n in zip(tables, names, strict=True)])
        return held.withColumn(into, bound((), names)).drop(*names)

    @staticmethod
    def _packed(ranks: Column, a: Column, b: Column) -> Column:
        """Token ``a`` with the rank of its merge with ``b`` above it."""
        found = F.get(ranks, (F.get(ranks, a.cast("int")) + b).cast("int"))
        rank = F.when(F.shiftright(found, BITS) == a, found.bitwiseAND(_long(MASK))).otherwise(_long(NONE))
        return F.shiftleft(rank, BITS).bitwiseOR(a)

    def fold(self, ranks: Column, word: Column) -> Column:
        """Token ids of one word, given the rank map: the leftmost pair of the lowest rank merges, step by step.

        The state holds for each token its id and, above it, the rank of its
        merge with the next one; so the least entry is the next merge.  A
        token's id is the rank of the merge that makes it.  A word has fewer
        merges than bytes.
        """
        codes = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(self.bytes, F.ascii(c)))
        # the last token has a neighbour that merges with nothing
        alone, none, gone = _long(NONE << BITS), _long(MASK), _long(-1)

        def token(x):
            return x.bitwiseAND(_long(MASK))

        def begun(t):
            return F.transform(t, lambda x, i: self._packed(ranks, x, F.coalesce(F.get(t, i + 1), none)))

        def merged(state, at, new):
            left, right = token(F.get(state, at - 1)), F.coalesce(token(F.get(state, at + 2)), none)
            # what stands at the places at - 1, at and at + 1
            fresh = F.array(self._packed(ranks, left, new), self._packed(ranks, new, right), gone)
            return _let(fresh, lambda f: F.array_remove(F.transform(state, lambda x, i: F.coalesce(F.get(f, i - at + 1), x)), gone))

        def step(state, _):
            def next_(least):
                place = (F.array_position(state, least) - 1).cast("int")
                return F.when(least >= alone, state).otherwise(_let(place, lambda at: merged(state, at, F.shiftright(least, BITS))))

            return _let(F.array_min(state), next_)

        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(word) - 1))
        return F.aggregate(steps, _let(codes, begun), step, lambda state: F.transform(state, token))


def as_text(ids: Column) -> Column:
    """Ids as decimal numbers joined by commas."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def put_in(ids: Column, of) -> Column:
    """``ids`` with ``of(n)`` in the place of the n-th MISSED, from 1."""
    parts = F.transform(F.split(ids, MISSED), lambda part, n: F.when(n == 0, part).otherwise(F.concat(of(n), part)))
    return F.array_join(parts, "")


def words_of(text: Column, pattern: str) -> Column:
    """The pieces of a text that are merged separately; white space is what Unicode calls so."""
    return F.regexp_extract_all(text, F.lit("(?U)" + _possessive(pattern)), F.lit(0))


def _possessive(pattern: str) -> str:
    """The same pattern, where the repeat that ends an alternative gives nothing back: nothing follows that could want it."""
    if "(" in pattern.replace("(?!", "").replace("(?=", ""):
        return pattern
    return re.sub(r"(\\p\{\w+\}|\\[a-zA-Z]|[^\\+*?}])\+(?=\||$)", r"\1++", pattern)


def heap_encode(word: str, ranks: dict[bytes, int]) -> str:
    """The ids of a word as text, by a heap and linked lists (for very long words)."""
    data = word.encode("utf-8", "surrogatepass")
    if (whole := ranks.get(data)) is not None:
        return str(whole)
    part: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
    n = len(part)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if part[i] is None or (j := right[i]) >= n or ranks.get(part[i] + part[j]) != r:
            continue
        part[i], part[j] = part[i] + part[j], None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i))
        if (h := left[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
            heapq.heappush(heap, (r, h))
    return ",".join(str(ranks[p]) for p in part if p is not None)


def encoded(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids", back: str | None = None) -> DataFrame:
    """Adds ``into``: the token ids of each whole text as decimal numbers joined by commas; and ``back``, the bytes they decode to.

    Words that are tokens as a whole, and frequent words, are looked up in a
    table of bounded size; each other distinct word of a stretch of a row is
    folded once, and its ids then take its places.  Rows never move.  Words of
    over LONG bytes are encoded by a heap of merges in Python, which gives the
    same ids in n log n time; all other words of their texts are folded.

    Null and empty texts have no ids (empty text); repeated rows, other columns
    and empty tables pass through; existing columns ``into`` and ``back`` are
    replaced.
    """
    encoder = Encoder(df.sparkSession, ranks_path)
    t = text_of(text)
    known = encoder.frequent(df.select(t.alias("t")), pattern)
    begun, late, done = free_names(df, "_begun", "_late", "_done")

    def stretch(words: Column, known: Column, ranks: Column) -> Column:
        def filled(found: Column) -> Column:
            ids = F.array_join(found, ",")

            def folded_in(missed: Column, fresh: Column) -> Column:
                own = F.transform(fresh, lambda w: F.when(F.octet_length(w) <= LONG, as_text(encoder.fold(ranks, w))).otherwise(MISSED))
                place = lambda n: (F.array_position(fresh, F.get(missed, n - 1)) - 1).cast("int")
                return _let(own, lambda o: put_in(ids, lambda n: F.get(o, place(n))))

            def put_back(missed: Column) -> Column:
                return F.when(F.size(missed) == 0, ids).otherwise(_let(F.array_distinct(missed), lambda fresh: folded_in(missed, fresh)))

            return _let(F.filter(words, lambda _, i: F.get(found, i) == MISSED), put_back)

        return _let(F.transform(words, lambda w: _looked_up(known, w)), filled)

    def whole(words: Column, known: Column, ranks: Column) -> Column:
        # a stretch of words at a time, so that the row's own table stays small in texts of any length
        last = F.greatest(F.lit(0), F.ceil(F.size(words) / F.lit(STRETCH)) - 1).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda n: _let(F.slice(words, n * STRETCH + 1, STRETCH), lambda part: stretch(part, known, ranks)))
        return F.array_join(parts, ",")

    def folded(known: Column, ranks: Column) -> Column:
        # a word that is left out has MISSED for its ids
        left_out = lambda words: F.filter(words, lambda w: F.octet_length(w) > LONG)
        held = lambda words: F.struct(whole(words, known, ranks).alias("ids"), F.when(F.octet_length(t) > LONG, left_out(words)).alias("long"))
        return _let(words_of(t, pattern), held)

    sent = df.sparkSession.sparkContext.broadcast(encoder.ranks)

    @F.arrow_udf(ArrayType(StringType()))
    def by_heap(lists: pa.Array) -> pa.Array:
        found = [None if (words := row.as_py()) is None else [heap_encode(w, sent.value) for w in words] for row in lists]
        return pa.array(found, pa.list_(pa.string()))

    def completed() -> Column:
        return F.when(F.col(late).isNull(), F.col(begun)["ids"]).otherwise(put_in(F.col(begun)["ids"], lambda n: F.get(F.col(late), n - 1)))

    def both(pieces: Column) -> Column:
        return _let(completed(), lambda i: F.struct(i.alias("ids"), joined(pieces, i).alias("back")))

    first = encoder.applied(df, begun, folded, known, encoder.rank_map)
    some = F.when(F.size(F.col(begun)["long"]) > 0, F.col(begun)["long"])
    marked = first.withColumn(late, by_heap(some))
    if back is None:
        return marked.withColumn(into, completed()).drop(begun, late)
    out = encoder.applied(marked, done, both, encoder.pieces)
    return out.withColumns({into: F.col(done)["ids"], back: F.col(done)["back"]}).drop(begun, late, done)


def joined(pieces: Column, ids: Column) -> Column:
    """The bytes of ids written as by ``encoded``; ids without a piece give none."""
    each = F.transform(F.from_json(F.concat(F.lit("["), ids, F.lit("]")), "array<int>"), lambda i: F.get(pieces, i))
    return F.when(ids == "", F.lit(b"")).otherwise(F.array_join(each, "").cast("binary"))


def _all_known(pieces: Column, ids: Column) -> Column:
    return (ids == "") | F.forall(F.split(ids, ","), lambda i: F.get(pieces, i.try_cast("int")).isNotNull())


def decoded(df: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into``: the bytes of ids written as by ``encoded``, each id's piece concatenated.

    Null ids give null, no ids no bytes, and an id that the file lacks makes
    the row's bytes null.  ``df`` should be a stored table: ids that are
    still to be worked out are decoded by ``encoded`` itself (``back``).
    """
    encoder = Encoder(df.sparkSession, ranks_path)
    checked = lambda pieces: F.when(_all_known(pieces, F.col(ids)), joined(pieces, F.col(ids)))
    return encoder.applied(df, into, checked, encoder.pieces)

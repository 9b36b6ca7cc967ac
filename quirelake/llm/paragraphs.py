"""Substring dedup: exact repeats of long passages, then paragraph MinHash banding."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ._shared import free_names, text_of, written
from .components import bucket_links, components

#: Words of a shingle and of the shortest line that is compared.
SHINGLE, LEAST_WORDS = 5, 20
#: Words of the shortest passage that is a repeat wherever it stands, and of its marks.  A mark is the run of MARK words
#: with the least hash among LEAST_RUN - MARK + 1 neighbours, thus every passage of LEAST_RUN words holds one that
#: depends on nothing else (winnowing).
LEAST_RUN, MARK = 51, 26
#: 6 bands of 3 rows find a pair of Jaccard similarity 0.8 with probability 0.986, of 0.9 with 0.9996.
BANDS, ROWS = 6, 3
SIMILAR = 0.8

_rng = np.random.default_rng(20)
_MULTIPLIER = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_OFFSET = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: What is neither a letter nor a digit.
_OTHER = re.compile(r"[\W_]+")
#: ASCII letters and digits in lower case; nothing else.
_NORMAL = np.array([ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 0 for c in range(256)], np.uint8)
_LETTER_BASE = 0x9FB21C651E98DF25
_kept_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of texts that are taken at once (a longer text by itself), shingles that are hashed at once.
_AT_ONCE, _SHINGLES_AT_ONCE = 1 << 16, 1 << 16
_REMEMBERED = 100_000
_hashes: dict[bytes, int] = {}


def normal(word: bytes) -> str:
    """A word as it is compared: lower case, letters and digits only."""
    form = word.decode("utf-8", "replace").lower()
    return form if form.isalnum() else _OTHER.sub("", form)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, modulo 2^64, and of its inverse."""
    kept = _kept_powers.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(n, 1 << 16)
        kept = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)))) for x in (base, pow(base, -1, 2**64)))
        if size <= 1 << 20:
            _kept_powers[base] = kept
    return kept


def _totals(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of the values before each place, each times a power of the base."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values) + 1)[0][: len(values)], out=total[1:])
    return total


def _polynomial(total: np.ndarray, base: int, start, end) -> np.ndarray:
    """A rolling polynomial, modulo 2^64, of the values from each start to its end."""
    value = (total[end] - total[start]) * _powers(base, len(total))[1][start]
    value = (value ^ (value >> np.uint64(32))) * _MIX
    return value ^ (value >> np.uint64(29))


def _letter_hashes(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word in normal form."""
    return _polynomial(_totals(letters, _LETTER_BASE), _LETTER_BASE, start, end)


def _word_hashes(data: bytes, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the normal form of each word; ASCII words are taken all at once, others are remembered."""
    low = _NORMAL[raw]
    use = low != 0
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(use, out=place[1:])
    h = _letter_hashes(low[use], place[first], place[last])
    if not data.isascii():
        np.cumsum(raw >= 128, out=place[1:])
        own = np.flatnonzero(place[last] > place[first])
        words = [data[a:b] for a, b in zip(first[own].tolist(), last[own].tolist(), strict=True)]
        new = list({w for w in words if w not in _hashes})
        if len(_hashes) + len(new) > _REMEMBERED:
            _hashes.clear()
            new = list(set(words))
        forms = [normal(w).encode("utf-8", "surrogatepass") for w in new]
        end = np.cumsum([0, *map(len, forms)])
        _hashes.update(zip(new, _letter_hashes(np.frombuffer(b"".join(forms) or b"\0", np.uint8), end[:-1], end[1:]).tolist(), strict=True))
        h[own] = np.array([_hashes[w] for w in words], np.uint64)
        if len(_hashes) > _REMEMBERED or any(len(w) > 1000 for w in new):
            _hashes.clear()
    return h


def _rolled(h: np.ndarray) -> np.ndarray:
    """Hashes of all shingles of a row of word hashes."""
    n = max(0, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + n]
    return (out ^ (out >> np.uint64(31))) * _MIX


def _signatures(rolled: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One key per band for each unit (all have SHINGLE words at least)."""
    out = np.zeros((len(start), BANDS), np.int64)
    size = end - start - SHINGLE + 1
    step = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), _SHINGLES_AT_ONCE), side="right")
    step = np.unique(np.append(step, len(start)))
    low = 0
    for high in step.tolist():
        if high == low:
            continue
        part = size[low:high]
        cut = np.cumsum(part) - part
        place = np.arange(int(part.sum())) + np.repeat(start[low:high] - cut, part)
        # 32 bits are enough for a minimum, and are multiplied several at a time
        s = (rolled[place] >> np.uint64(32)).astype(np.uint32)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (high - low, 1))
        value = np.empty_like(s)
        for r in range(BANDS * ROWS):
            np.multiply(s, _MULTIPLIER[r], out=value)
            np.add(value, _OFFSET[r], out=value)
            least = np.minimum.reduceat(value, cut)
            band = key[:, r // ROWS]
            key[:, r // ROWS] = ((band ^ (band >> np.uint64(32))) * _MIX) ^ least
        out[low:high] = ((key ^ (key >> np.uint64(32))) * _MIX).view(np.int64)
        low = high
    return out


def _runs(total: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, given the totals of their hashes."""
    n = max(0, len(total) - size)
    return _polynomial(total, _BASE, slice(0, n), slice(size, size + n)) * _MIX


def _split(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte and hash of each word, and the first word of each line that has words."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    np.take(_BLANK, raw, out=blank[1:-1])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edge[::2], edge[1::2]
    line = np.unique(np.concatenate(([0], np.searchsorted(first, np.flatnonzero(raw == 10)))))
    return first, last, _word_hashes(data, raw, first, last), line[line < len(first)]


class Words:
    """The words of some texts, which are taken at once as most are short.

    ``first`` and ``last`` are the bytes in ``data``, ``h`` the hashes, ``lines``
    the first words of the lines; the words of the text n are those from
    ``begin[n]`` to ``begin[n + 1]``.
    """

    def __init__(self, texts: list[bytes]):
        # a line end between them, so that no line is of two texts
        self.data = b"\n".join(texts)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.base = np.cumsum(size) - size
        self.first, self.last, self.h, self.lines = _split(self.data)
        self.begin = np.append(np.searchsorted(self.first, self.base), len(self.first))
        self.total = _totals(self.h, _BASE)
        self._place = None

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The text of each of some words."""
        return np.searchsorted(self.begin, words, side="right") - 1

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word the first word of its text, and of the next text."""
        size = np.diff(self.begin)
        return np.repeat(self.begin[:-1], size), np.repeat(self.begin[1:], size)

    def characters(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """From places in ``data`` to places in characters of their texts, also where characters take several bytes."""
        if self.data.isascii():
            return at - self.base[text]
        if self._place is None:
            self._place = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum((np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80, out=self._place[1:])
        return self._place[at] - self._place[self.base[text]]


def _marks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the marks of the word sequences of some texts, at least one in each LEAST_RUN words."""
    n = len(words.h) - LEAST_RUN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = _runs(words.total, MARK)
    near = LEAST_RUN - MARK + 1
    start, stop = words.bounds()
    place = np.arange(len(value)) - start[: len(value)]
    # equal hashes (words that repeat) are told apart by place, so that few of them become marks
    least = (value & ~np.uint64(31)) | (place % near).astype(np.uint64)
    width = 1
    while width < near:
        step = min(width, near - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    # the place of the least is known by those bits
    window = np.flatnonzero(np.arange(n) + LEAST_RUN <= stop[:n])
    at = window + ((least[window] & np.uint64(31)).astype(np.int64) - place[window]) % near
    at = at[np.diff(at, prepend=-1) != 0]
    # a run that overlaps itself may have one mark for both places: the nearest equal hash before it is a mark too
    before = at[:, None] - np.arange(1, near)
    equal = (value[np.maximum(before, 0)] == value[at][:, None]) & (before >= start[at][:, None])
    own = np.flatnonzero(equal.any(1))
    if len(own):
        at = np.union1d(at, before[own, equal[own].argmax(1)])
    return at, value[at].view(np.int64)


class Units:
    """The lines of some texts that are long enough to compare, and the marks of their word sequences.

    ``line_*`` are arrays with an entry for each line: its text, first and
    last byte, content hash; ``bands`` has the keys of lines.  ``marks`` are
    places (among all words) and hashes; lines end nothing there.
    """

    def __init__(self, *texts: bytes):
        self.words = words = Words(list(texts))
        self.marks = _marks(words)
        stop = np.append(words.lines[1:], len(words.first))[: len(words.lines)]
        keep = stop - words.lines >= LEAST_WORDS
        a, b = words.lines[keep], stop[keep]
        self.bands = np.zeros((0, BANDS), np.int64)
        self.line_text = self.line_start = self.line_end = self.line_content = np.zeros(0, np.int64)
        if not len(a):
            return
        self.line_text, self.line_start, self.line_end = words.text_of(a), words.first[a], words.last[b - 1]
        self.line_content = _polynomial(words.total, _BASE, a, b).view(np.int64)
        self.bands = _signatures(_rolled(words.h), a, b)


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard similarity of the five-word shingle sets of two paragraphs."""
    x, y = ([normal(w) for w in t.encode("utf-8", "surrogatepass").split()] for t in (a, b))
    if len(x) < SHINGLE or len(y) < SHINGLE:
        return float(x == y)
    p = {tuple(x[i : i + SHINGLE]) for i in range(len(x) - SHINGLE + 1)}
    q = {tuple(y[i : i + SHINGLE]) for i in range(len(y) - SHINGLE + 1)}
    both = len(p & q)
    return both / (len(p) + len(q) - both)


_UNITS = "doc long, key long, start int, end int, content long, bands array<long>, words string, at array<int>"


def _groups(batch: pa.RecordBatch, column: int):
    """(rows, their texts) of neighbours that have about _AT_ONCE bytes together."""
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    low = size = 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= _AT_ONCE or n + 1 == len(texts):
            yield batch.slice(low, n + 1 - low), texts[low : n + 1]
            low, size = n + 1, 0


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of lists that end at the given places."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, kind))


def _cut_up(batches):
    kind = pa.schema(
        [("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]
        + [("content", pa.int64()), ("bands", pa.list_(pa.int64())), ("words", pa.string()), ("at", pa.list_(pa.int32()))]
    )

    def rows_of(group, text, columns):
        text = pa.array(text)
        made = [group.column(0).take(text), group.column(1).take(text), *columns]
        return pa.RecordBatch.from_arrays([pa.nulls(len(text), f.type) if c is None else pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(made, kind, strict=True)], schema=kind)

    for batch in batches:
        held: list[pa.RecordBatch] = []
        size = 0
        for group, texts in _groups(batch, 2):
            u = Units(*texts)
            words = u.words
            if n := len(u.line_text):
                a, b = u.line_start, u.line_end
                lines = pa.array([words.data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()).cast(pa.string())
                bands = _lists(u.bands.ravel(), np.arange(BANDS, BANDS * n + 1, BANDS), pa.int64())
                held.append(rows_of(group, u.line_text, [words.characters(a, u.line_text), words.characters(b, u.line_text), u.line_content, bands, lines, None]))
            at, hashes = u.marks
            if len(at):
                # one row with all marks of a text
                of = words.text_of(at)
                cut = np.flatnonzero(np.diff(of, prepend=-1))
                t, ends = of[cut], np.append(cut[1:], len(at))
                a, b = words.characters(words.first[words.begin[t]], t), words.characters(words.last[words.begin[t + 1] - 1], t)
                held.append(rows_of(group, t, [a, b, None, _lists(hashes, ends, pa.int64()), None, _lists(at - words.begin[of], ends, pa.int32())]))
            size += len(words.data) + 12 * len(at)
            if size > 8 << 20:
                yield from pa.Table.from_batches(held, kind).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held, kind).combine_chunks().to_batches()


@F.arrow_udf(ArrayType(LongType()))
def _shingles(lines: pa.Array) -> pa.Array:
    """The set of 64-bit hashes of the five-word shingles of each line."""
    out = []
    for group, texts in _groups(pa.RecordBatch.from_arrays([lines], names=["line"]), 0):
        words = Words(texts)
        rolled = _rolled(words.h)
        size = np.maximum(np.diff(words.begin) - SHINGLE + 1, 0)
        ends = np.cumsum(size)
        flat = rolled[np.arange(int(size.sum())) + np.repeat(words.begin[:-1] - (ends - size), size)]
        new = np.ones(len(flat), bool)
        for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
            flat[a:b].sort()
            new[a + 1 : b] = flat[a + 1 : b] != flat[a : b - 1] if b > a else True
        kept = np.cumsum(new)
        out.append(_lists(flat[new].view(np.int64), np.append(0, kept)[ends], pa.int64()))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def _alike(a, b):
    """Jaccard similarity of two sets of at least SIMILAR, in whole numbers."""
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    bar = round(SIMILAR * 100)
    # sizes alone rule out most
    return (F.least(F.size(a), F.size(b)) * 100 >= F.greatest(F.size(a), F.size(b)) * bar) & (both * (100 + bar) >= total * bar)


_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kept_doc", LongType())])


@F.arrow_udf(ArrayType(_SPAN))
def _merged(lists: pa.Array) -> pa.Array:
    """Spans in order, none of which overlap; where they do the one that begins first stays whole."""
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept_doc", pa.int64())])
    out = []
    for spans in lists:
        # field by field: a long run has a span for each of its words
        flat = spans.values
        starts, ends, kept = (flat.field(n).to_pylist() for n in ("start", "end", "kept_doc"))
        done: list[dict] = []
        for a, b, k in sorted(zip(starts, ends, kept, strict=True), key=lambda x: (x[0], -x[1], x[2] is None, x[2] or 0)):
            at = done[-1]["end"] if done else -1
            if b <= at:
                continue
            if a <= at and done[-1]["kept_doc"] == k:
                done[-1]["end"] = b
            else:
                done.append({"start": max(a, at), "end": b, "kept_doc": k})
        out.append(done)
    return pa.array(out, pa.list_(kind))


_RUNS = "hash long, doc long, key long, at int, start int, last int, end int"


def _long_runs(batches):
    """All runs of LEAST_RUN words that hold one of the given marks of their text."""
    names = ["hash", "doc", "key", "at", "start", "last", "end"]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 4
    for batch in batches:
        for group, texts in _groups(batch, 2):
            words = Words(texts)
            value = _runs(words.total, LEAST_RUN).view(np.int64)
            hot = group.column(3)
            of = np.repeat(np.arange(len(texts)), hot.value_lengths().to_numpy())
            place = hot.flatten().to_numpy() + words.begin[of]
            # neither end of a run is in another text
            low, high = np.maximum(place - (LEAST_RUN - MARK), words.begin[of]), np.minimum(place, words.begin[of + 1] - LEAST_RUN)
            change = np.zeros(len(words.h) + 2, np.int64)
            np.add.at(change, low, 1)
            np.add.at(change, high + 1, -1)
            found = np.flatnonzero(np.cumsum(change)[: len(value)] > 0)
            for at in np.split(found, range(1 << 16, len(found), 1 << 16)):
                t, end = words.text_of(at), at + LEAST_RUN - 1
                places = [at - words.begin[t]] + [words.characters(x, t) for x in (words.first[at], words.first[end], words.last[end])]
                row = pa.array(t)
                columns = [value[at], group.column(0).take(row), group.column(1).take(row), *places]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, kinds, strict=True)], names=names)


def _paired(high, low):
    """Two numbers that are not negative, of 31 bits, in one; its order is that of the first."""
    high, low = (F.col(c) if isinstance(c, str) else c for c in (high, low))
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def _both(column: str):
    """The two numbers of ``_paired``."""
    c = F.col(column)
    return F.shiftright(c, 32).cast("int"), c.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def passages(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, key, spans): each word of a run of LEAST_RUN words that stands at an earlier (id, position) too.

    ``texts`` has the marks of ``rows``.  A run of LEAST_RUN words that occurs
    twice holds the same mark both times, so only runs around marks that occur
    twice are looked at; of those every one is, thus a repeat goes from its
    first to its last word, also across lines.  A run that overlaps its own
    first place loses its last word only.  Copies of a whole text are settled
    by its hash.
    """
    copied = texts.groupBy("key").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first_doc", F.lit(True).alias("copied"))
    texts = texts.join(copied, "key", "left").withColumn("copy", F.coalesce("copied", F.lit(False)) & ~F.col("doc").eqNullSafe(F.col("first_doc")))
    marks = texts.where("not copy").select("doc", "key", F.explode(F.arrays_zip("at", "bands"))).select("doc", "key", "col.at", F.col("col.bands").alias("hash"))
    place, alike = F.xxhash64("doc", "key", "at"), W.partitionBy("hash")
    twice = marks.select("doc", "key", "at", F.min(place).over(alike).alias("low"), F.max(place).over(alike).alias("high")).where("low <> high")
    hot = written(twice.groupBy("doc", "key").agg(F.collect_set("at").alias("hot")), "hot")
    chosen = rows.join(hot.withColumnsRenamed({"doc": "d", "key": "k"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    runs = chosen.select("doc", "key", "text", "hot").mapInArrow(_long_runs, _RUNS)
    # two numbers in one: the shuffle of these rows takes the most disk
    runs = runs.select("hash", "doc", "key", _paired("at", "start").alias("place"), _paired(F.col("last") - F.col("start"), F.col("end") - F.col("start")).alias("size"))
    order = W.partitionBy("hash").orderBy(F.col("doc").isNull(), "doc", "key", "place")
    first = F.first(F.struct("doc", "key", "place")).over(order).alias("first")
    seen = runs.select("doc", "key", "place", "size", first)
    within = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("key") == F.col("first.key"))
    (at, start), (first_at, _), (last, end) = _both("place"), _both("first.place"), _both("size")
    overlaps = within & (at < first_at + LEAST_RUN)
    later = seen.where(~(within & (F.col("place") == F.col("first.place")))).select(
        "doc", "key", F.struct((start + F.when(overlaps, last).otherwise(0)).alias("start"), (start + end).alias("end"), F.col("first.doc").alias("kept_doc")).alias("span")
    )
    whole = texts.where("copy").select("doc", "key", F.struct("start", "end", F.col("first_doc").alias("kept_doc")).alias("span"))
    return written(later.unionByName(whole).groupBy("doc", "key").agg(_merged(F.collect_list("span")).alias("spans")), "passages")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, key, start, end, kept_doc): what to remove, and the document that keeps it.

    First, passages of LEAST_RUN words or more that stand somewhere before
    (see ``passages``).  Then lines of LEAST_WORDS words or more are alike at a
    Jaccard similarity of at least 0.8 of their five-word shingles; groups are
    the components of that relation, found among lines that collide in a band.
    Of each group the occurrence with the smallest (id, position) stays, first
    among the lines that lose no passage.  ``key`` is a hash of the text that
    tells rows of one id apart.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text_of(text)).alias("key"), text_of(text).alias("text"))
    found = written(rows.mapInArrow(_cut_up, _UNITS), "units")
    lines, texts = found.where("at is null"), found.where("at is not null").select("doc", "key", "start", "end", "at", "bands")
    cut = passages(rows, texts)
    collided = lines.select(F.explode("bands").alias("key"), F.col("content").alias("node")).distinct()

    def sets(nodes: DataFrame) -> DataFrame:
        # one text for each content: equal contents have equal words
        texts = lines.select(F.col("content").alias("node"), "words").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("words").alias("words"))
        return texts.select("node", _shingles("words").alias("data"))

    named = components(bucket_links(collided, _alike, sets)).withColumnRenamed("node", "content")
    c = cut.withColumnsRenamed({"doc": "d", "key": "k"})
    left = lines.select("doc", "key", "start", "end", "content").join(c, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").drop("d", "k")
    spans = F.coalesce("spans", F.array().cast(ArrayType(_SPAN)))
    gone = F.exists(spans, lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end")))
    touched = F.exists(spans, lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    left = written(left.where(~gone).select("doc", "key", "start", "end", "content", touched.alias("touched")), "left")
    passed = cut.select("doc", "key", F.explode("spans").alias("s")).select("doc", "key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kept_doc").alias("kept_doc"))
    return _later(left, named).unionByName(passed)


def _later(found: DataFrame, named: DataFrame) -> DataFrame:
    """All occurrences of a group but the first; ``named`` joins contents into groups."""
    place = F.struct("touched", F.col("doc").isNull().alias("none"), "doc", "key", "start").alias("place")
    first = found.groupBy("content").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("times"))
    first = written(
        first.join(named, "content", "left")
        .where("times > 1 or component is not null")
        .select("content", "place", F.coalesce("component", "content").alias("group")),
        "contents",
    )
    least = first.groupBy("group").agg(F.min("place").alias("keeper"))
    keepers = written(first.join(least, "group").select("content", "keeper"), "keepers")
    own = F.col("doc").eqNullSafe(F.col("keeper.doc")) & (F.col("key") == F.col("keeper.key")) & (F.col("start") == F.col("keeper.start"))
    gone = found.select("doc", "key", "start", "end", "content").join(keepers, "content")
    return gone.where(~own).select("doc", "key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("keeper.doc").alias("kept_doc"))




def _without(text: str, spans) -> str:
    """``text`` less the spans; a span that is a whole line takes its line end with it."""
    joined: list[list[int]] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if joined and s["start"] <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], s["end"])
        else:
            joined.append([s["start"], s["end"]])
    out, at = [], 0
    for a, b in joined:
        a = max(a, at)
        if (a == 0 or text[a - 1] == "\n") and b < len(text) and text[b] == "\n":
            b += 1
        elif b == len(text) and a and text[a - 1] == "\n" and a - 1 >= at:
            a -= 1
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return "".join(out)


@F.arrow_udf(StringType())
def _removed(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([_without(t.as_py() or "", s.as_py() or []) for t, s in zip(texts, spans, strict=True)], pa.string())


def per_document(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, key, spans): what each document loses, spans (start, end, kept_doc) in characters."""
    return (
        repeats(docs, doc_id, text)
        .distinct()
        .groupBy("doc", "key")
        .agg(_merged(F.collect_list(F.struct("start", "end", "kept_doc"))).alias("spans"))
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "removed") -> DataFrame:
    """``docs`` with each repeated passage and paragraph removed from ``text`` but for its first place; adds ``into``, the spans.

    Every row stays, even if nothing of its text does.  Lines of fewer than
    LEAST_WORDS words go only as part of a passage of LEAST_RUN words.  Null texts stay null and lose nothing;
    rows that repeat id and text count as one document and get the same
    result; null ids come last in the choice of the place that stays; texts of
    any length are cut whole; an existing column ``into`` is replaced, other
    columns pass through; an empty table gives an empty result.
    """
    docs = docs.drop(into) if into.lower() != text.lower() else docs
    doc, key, found, own = free_names(docs, "_doc", "_key", "_spans", "_text_key")
    spans = written(per_document(docs, doc_id, text), "spans").withColumnsRenamed({"doc": doc, "key": key, "spans": found})
    marked = docs.withColumn(own, F.xxhash64(text_of(text)))
    joined = marked.join(spans, marked[doc_id].cast("long").eqNullSafe(spans[doc]) & (marked[own] == spans[key]), "left")
    cleaned = F.when(F.col(found).isNull(), F.col(text)).otherwise(_removed(F.col(text), F.col(found)))
    return joined.withColumn(text, cleaned).withColumn(into, F.coalesce(found, F.array().cast(ArrayType(_SPAN)))).drop(doc, key, found, own)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: how many characters and passages it loses, and to which documents.

    The texts themselves are not shuffled.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("_k"), F.length(text_of(text)).cast("long").alias("n_chars"))
    lost = per_document(docs, doc_id, text)
    joined = rows.join(lost, rows["doc_id"].eqNullSafe(lost["doc"]) & (rows["_k"] == lost["key"]), "left")
    none = F.array().cast(ArrayType(_SPAN))
    spans = F.coalesce("spans", none)
    return joined.select(
        "doc_id",
        "n_chars",
        F.size(spans).alias("n_removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("removed_chars"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("removed_spans"),
        F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["kept_doc"]))).alias("kept_in"),
    )



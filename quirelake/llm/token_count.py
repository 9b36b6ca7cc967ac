"""Token counts by heap-and-linked-list byte-pair merging, without emitting ids."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._shared import text_of

#: Distinct words a worker remembers; when full it starts afresh (speed only, never the count).
REMEMBERED = 400_000
#: Longer words aren't remembered.
REMEMBERED_CHARS = 64


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shift, out = 0, [""] * 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + shift)
            shift += 1
    return out


def _ranges(wanted) -> str:
    """A regular-expression character class body for the code points with ``wanted(category)``."""
    out, start, last = [], None, None
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        if wanted(unicodedata.category(chr(cp))):
            if start is None:
                start = cp
            last = cp
        elif start is not None:
            out.append((start, last))
            start = None
    if start is not None:
        out.append((start, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=2)
def _pattern() -> tuple[re.Pattern, re.Pattern]:
    letter, number = _ranges(lambda c: c[0] == "L"), _ranges(lambda c: c[0] == "N")
    words = re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{SPACE}{letter}{number}]+")
    return words, re.compile(f"[^{SPACE}]+")


class WordPieceCounter:
    """Counts tokens as the vocabulary's own library does, from the merges alone.

    Built from the JSON of a byte-level BPE with an end-of-word suffix:
    NFC, lower case, white space dropped, special strings one token each.
    """

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model = spec["model"]
        suffix, ids = model["end_of_word_suffix"], model["vocab"]
        chars = _byte_chars()
        self.inner = [ids[c] for c in chars]
        self.final = [ids[c + suffix] for c in chars]
        self.merges: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges.setdefault(ids[left] << 20 | ids[right], rank << 20 | ids[left + right])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.marks = tuple(special)
        self.words, self.blocks = _pattern()
        self.known: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one word: initial symbols minus merges."""
        data = word.encode("utf-8", "surrogatepass")
        n = len(data)
        if n < 2:
            return n
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        merges = self.merges
        heap = []
        for i in range(n - 1):
            m = merges.get(ids[i] << 20 | ids[i + 1])
            if m is not None:
                heap.append((m, i))
        if not heap:
            return n
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        count, pop, push = n, heapq.heappop, heapq.heappush
        while heap:
            m, i = pop(heap)
            j = right[i]
            # an entry is stale once either of its symbols has been merged
            if ids[i] < 0 or j >= n or merges.get(ids[i] << 20 | ids[j]) != m:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            k = right[i] = right[j]
            count -= 1
            if k < n:
                left[k] = i
                after = merges.get(ids[i] << 20 | ids[k])
                if after is not None:
                    push(heap, (after, i))
            h = left[i]
            if h >= 0:
                before = merges.get(ids[h] << 20 | ids[i])
                if before is not None:
                    push(heap, (before, h))
        return count

    def block(self, block: str) -> int:
        """Tokens of a run without white space."""
        n = sum(map(self.merged, self.words.findall(block)))
        if len(block) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[block] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if text.isascii():
            text = text.lower()
        else:
            # lower case goes by single characters: a final sigma is no exception
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # split() also splits at the four separators U+001C-001F, which the pattern keeps
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            blocks = self.blocks.findall(text)
        else:
            blocks = text.split()
        known, block, total = self.known, self.block, 0
        for b in blocks:
            n = known.get(b)
            total += block(b) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(m in text for m in self.marks):
            return self.plain(text)
        return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))


_counters: dict[int, WordPieceCounter] = {}


def count_tokens(df: DataFrame, vocabulary_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Adds ``into``: how many tokens the vocabulary's library gives for each whole text.

    The vocabulary file has a fixed size (1.7 MB) and goes out as a broadcast.
    Rows stay where they are: no shuffle.  Null and empty texts have 0 tokens;
    very long texts are one pass over their words; an existing column ``into``
    is replaced; other columns, repeated rows and empty tables pass through.
    """
    spark = df.sparkSession
    with open(vocabulary_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf(LongType())
    def counted(texts: pa.Array) -> pa.Array:
        key = hash(sent.value)
        if key not in _counters:
            _counters.clear()
            _counters[key] = WordPieceCounter(sent.value)
        count = _counters[key].count
        return pa.array([count(t.as_py()) for t in texts], pa.int64())

    return df.withColumn(into, counted(text_of(text)))

"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._shared import free_names, text_of, written

#: Labelled rows that are used at most; those with the smallest hash of the id.
POSITIVES, NEGATIVES = 4000, 8000
#: Words and word beginnings that the learned lexicon holds at most.
LEXICON = 4000
FOLDS = 3
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32

#: Common insults; the lexicon learned from labels is added to it.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash clown clowns pathetic worthless disgusting "
    "fool fools jerk creep freak imbecile cretin bastard ugly filthy vermin garbage hate shut "
    "idiote imbécile crétin connard salaud ordure débile stupide pourriture minable "
    "dumm dummkopf trottel arschloch abschaum widerlich versager blöd schwachkopf "
    "estúpido imbécil tonto basura asqueroso patético inútil escoria payaso".split()
)
YOU = frozenset("you your yours yourself ur u tu te toi vous votre ton du dich dir dein ihr euch tú usted ustedes vosotros".split())

_WORDS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$*!|+]+[^\W\d_]+")
_LEET = str.maketrans("013457@$!|+", "oieastasilt")
_REMEMBERED = 400_000
_BEGINNINGS = (4, 5, 6)


def entries(word: str):
    """The lexicon entries that a word can hit: itself and its beginnings."""
    yield word
    for k in _BEGINNINGS:
        if len(word) > k:
            yield word[:k] + "-"


class Featurizer:
    """Dense features of a text, given the two tiers of a learned lexicon."""

    def __init__(self, strong: frozenset, medium: frozenset):
        self.strong, self.medium, self.known = strong, medium, {}

    def code(self, word: str) -> int:
        found = set(entries(word))
        code = (1 if found & self.strong else 0) | (2 if found & self.medium else 0) | (4 if word in INSULTS else 0)
        if len(word) <= 40:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[word] = code
        return code

    def __call__(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORDS.findall(low)
        get, code = self.known.get, self.code
        strong = medium = common = near = 0
        for i, c in enumerate(map(get, words)):
            if c is None:
                c = code(words[i])
            if c:
                strong += c & 1
                medium += c >> 1 & 1
                common += c >> 2
                if not YOU.isdisjoint(words[max(0, i - 3) : i + 4]):
                    near += 1
        hidden = 0
        mixed = _MIXED.findall(low)
        for m in mixed:
            if code(m.translate(_LEET).replace("*", "")):
                hidden += 1
        n = max(1, len(words))
        count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        size = max(1, int(count.sum()))
        upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
        marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
        hits = strong + medium + common + hidden
        return [
            np.log1p(len(words)),
            strong / n, np.log1p(strong),
            medium / n, np.log1p(medium),
            common / n, np.log1p(common),
            near / n, near / max(1, hits),
            upper / max(1, upper + lower),
            int(count[33]) / size, int(count[63]) / size, marks / size,
            len(mixed) / n, np.log1p(hidden),
        ]


def _tree(binned, grad, hess, depth: int):
    """One regression tree on binned features: arrays (feature, bin, left, right, value)."""
    nodes: list[list] = []

    def grow(rows, level):
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0, 0, 0, -g / (h + 1.0)])
        at = len(nodes) - 1
        if level == depth or len(rows) < 8:
            return at
        best, base = (1e-6, -1, 0), g * g / (h + 1.0)
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            gs, hs = np.bincount(b, grad[rows], BINS)[:-1].cumsum(), np.bincount(b, hess[rows], BINS)[:-1].cumsum()
            gain = np.where((hs > 0.2) & (h - hs > 0.2), gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - base, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] >= 0:
            left = binned[rows, best[1]] <= best[2]
            nodes[at][0], nodes[at][1] = best[1], best[2]
            nodes[at][2] = grow(rows[left], level + 1)
            nodes[at][3] = grow(rows[~left], level + 1)
        return at

    grow(np.arange(len(grad)), 0)
    return [np.array(c) for c in zip(*nodes, strict=True)]


class Trees:
    """Logistic gradient boosting on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        # a rare feature has all its quantiles at one value: keep a cut just above it
        self.cuts = [np.unique(np.append(c, c[-1] + 1e-12)) if len(c) < BINS - 2 else c for c in self.cuts]
        for f, column in enumerate(x.T):
            above = column[column > self.cuts[f][-1]]
            if len(above) and len(self.cuts[f]) < BINS - 1:
                extra = np.quantile(above, np.linspace(0, 1, BINS - len(self.cuts[f]) + 1)[1:-1])
                self.cuts[f] = np.unique(np.append(self.cuts[f], extra))[: BINS - 1]
        prior = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(prior / (1 - prior))), []
        binned, margin = self.binned(x), np.full(len(y), self.base)
        scaled = weight / weight.mean()
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = _tree(binned, scaled * (p - y), scaled * p * (1 - p), DEPTH)
            self.trees.append(tree)
            margin = margin + RATE * self._leaf(tree, binned)

    def binned(self, x):
        return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)], 1)

    @staticmethod
    def _leaf(tree, binned):
        feature, cut, left, right, value = tree
        at = np.zeros(len(binned), np.int64)
        for _ in range(DEPTH):
            inner = feature[at] >= 0
            goes = binned[np.arange(len(at)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return value[at]

    def margin(self, x):
        b = self.binned(x)
        return self.base + RATE * sum(self._leaf(t, b) for t in self.trees)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Pool-adjacent-violators: knots (x, value) of the best non-decreasing fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([a, a, b * w, w])
        while len(blocks) > 1 and (blocks[-2][1] == blocks[-1][0] or blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]):
            _, high, s, w2 = blocks.pop()
            blocks[-1][1] = high
            blocks[-1][2] += s
            blocks[-1][3] += w2
    xs = [v for low, high, _, _ in blocks for v in (low, high)]
    ys = [s / w for _, _, s, w in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)


class Model:
    """Score of a text: 99 parts calibrated probability, 1 part margin (so that ties stay ranked)."""

    def __init__(self, features: Featurizer, trees: Trees | None, xs=None, ys=None):
        self.features, self.trees, self.xs, self.ys = features, trees, xs, ys

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([self.features(t) for t in texts], np.float64)
        if self.trees is None:
            # too few labels of a kind: any insult next to a second person, or several insults
            return 1 / (1 + np.exp(3 - 4 * x[:, 6] - 2 * x[:, 8]))
        m = self.trees.margin(x)
        return np.clip(0.99 * np.interp(m, self.xs, self.ys) + 0.01 / (1 + np.exp(-m)), 0, 1)


def _lexicon(rows: list, pos, neg, n_pos: int, n_neg: int) -> tuple[frozenset, frozenset]:
    strong, medium = [], []
    for token, p, q in zip(rows, pos, neg, strict=True):
        if p < max(3, 0.001 * n_pos):
            continue
        odds = np.log((p + 0.5) / (n_pos + 1)) - np.log((q + 0.5) / (n_neg + 1))
        if odds >= 4:
            strong.append((-odds, token))
        elif odds >= 2.5:
            medium.append((-odds, token))
    return tuple(frozenset(t for _, t in sorted(x)[: LEXICON // 2]) for x in (strong, medium))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on labelled rows whose crc32(id as text) mod 5 isn't 0.

    At most POSITIVES and NEGATIVES rows are used, those with the smallest hash
    of their id; weights restore the true shares.  The lexicon and the
    calibration are cross-fitted in three folds, so no row is scored by what
    was learned from itself.  Of several labels of one id the largest counts,
    of several texts the smallest, so that repeated ids keep the bound; null
    labels, ids and texts take no part; with too few labels of a kind, or
    empty tables, a fixed rule over the features takes the model's place.
    """
    seen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) != 0))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("id"))
    )
    total = {r["y"] > 0: r["n"] for r in seen.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = seen.where("y > 0").orderBy("h", "id").limit(POSITIVES).unionByName(seen.where("y <= 0").orderBy("h", "id").limit(NEGATIVES))
    # at most POSITIVES + NEGATIVES rows of three numbers: a proven bound for the broadcast
    sample = written(
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
        .where("t is not null")
        .join(F.broadcast(drawn), "id")
        .groupBy("id")
        .agg(F.min("t").alias("t"), F.min("y").alias("y"), F.min("h").alias("h"))
        .select("t", (F.col("y") > 0).cast("int").alias("y"), F.pmod(F.shiftright("h", 8), F.lit(FOLDS)).cast("int").alias("fold")),
        "sample",
    )
    counts = sample.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.zeros((2, FOLDS), int)
    for r in counts:
        n[r["y"], r["fold"]] = r["n"]
    if min(n[0].sum(), n[1].sum()) < 10 or (n == 0).any():
        return Model(Featurizer(frozenset(), frozenset()), None)

    def tokens(batches):
        tally: dict[str, list[int]] = {}
        for batch in batches:
            for t, y, fold in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for token in {e for w in set(_WORDS.findall(t.lower())) if len(w) <= 40 for e in entries(w)}:
                    tally.setdefault(token, [0] * (2 * FOLDS))[y * FOLDS + fold] += 1
        items = list(tally.items())
        for low in range(0, len(items), 50_000):
            part = items[low : low + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], pa.string()), *[pa.array([v[i] for _, v in part], pa.int64()) for i in range(2 * FOLDS)]],
                names=["token", *[f"c{i}" for i in range(2 * FOLDS)]],
            )

    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(2 * FOLDS)]
    positive, negative = (sum(F.col(f"c{y * FOLDS + i}") for i in range(FOLDS)) for y in (1, 0))
    odds = (positive + 0.5) / float(n[1].sum() + 1) / ((negative + 0.5) / float(n[0].sum() + 1))
    told = (
        sample.select("t", "y", "fold")
        .mapInArrow(tokens, "token string, " + ", ".join(f"c{i} long" for i in range(2 * FOLDS)))
        .groupBy("token")
        .agg(*sums)
        .where((positive >= 3) & (odds >= 8))
        .orderBy(F.desc(odds), "token")
        .limit(5 * LEXICON)
        .toPandas()
    )
    c = told[[f"c{i}" for i in range(2 * FOLDS)]].to_numpy().reshape(-1, 2, FOLDS)
    names = told["token"].tolist()
    without = [_lexicon(names, *[np.delete(c[:, y], f, 1).sum(1) for y in (1, 0)], *[np.delete(n[y], f).sum() for y in (1, 0)]) for f in range(FOLDS)]

    def dense(batches):
        makers = [Featurizer(*x) for x in without]
        for batch in batches:
            rows = [[float(y), float(f), *makers[f](t)] for t, y, f in zip(*[col.to_pylist() for col in batch.columns], strict=True)]
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.list_(pa.float64()))})

    data = np.array([r["row"] for r in sample.select("t", "y", "fold").mapInArrow(dense, "row array<double>").collect()])
    data = data[np.lexsort(data.T)]
    y, fold, x = data[:, 0], data[:, 1].astype(int), data[:, 2:]
    weight = np.where(y > 0, total[True] / n[1].sum(), total[False] / n[0].sum())
    apart = np.zeros(len(y))
    for f in range(FOLDS):
        apart[fold == f] = Trees(x[fold != f], y[fold != f], weight[fold != f]).margin(x[fold == f])
    xs, ys = isotonic(apart, y, weight)
    final = _lexicon(names, c[:, 1].sum(1), c[:, 0].sum(1), n[1].sum(), n[0].sum())
    return Model(Featurizer(*final), Trees(x, y, weight), xs, ys)


_models: dict[bytes, Model] = {}


def with_score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into``: the probability that the label is 1, from the text alone.

    No shuffle: the model (a few hundred KB, bounded by LEXICON and TREES) goes
    out as a broadcast.  Null and empty texts are scored like texts without
    words; very long texts are one pass; an existing column ``into`` is
    replaced; other columns, repeated rows and empty tables pass through.
    """
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        key = hashlib.md5(sent.value).digest()
        if key not in _models:
            _models.clear()
            _models[key] = pickle.loads(sent.value)
        return pa.array(_models[key].scores(texts.to_pylist()), pa.float64())

    return df.withColumn(into, scored(text_of(text)))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that a model trained on ``labels`` doesn't call toxic, with their columns.

    Null and empty texts are scored like texts without words (and stay, unless
    nearly all labels are toxic); repeated rows stay or go together; ties at
    the threshold go; an empty table gives an empty result; see ``train``.
    """
    (score,) = free_names(docs, "_score")
    return with_score(docs, train(docs, labels), into=score).where(F.col(score) < threshold).select(*docs.columns)

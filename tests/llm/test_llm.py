"""Operators of the training-data subpackage against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from quirelake.llm import bytepair, components, knn, license_scan, near_copies, paragraphs, queries, resample, simhash, tiling, token_count, toxicity, warc

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
_r = random.Random(5)
LEXICON = ["".join(_r.choice("bcdfglmnprst") + _r.choice("aeiou") for _ in range(_r.randint(1, 4))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(LEXICON) for _ in range(n))


#: Nulls, empty texts, repeats, long words and a clashing column.
EDGES = [
    (1, "The quick  brown\tfox, it's 42 ½ días", "x"), (2, "", "x"), (3, None, None), (None, "no id", "x"), (4, "same", "x"), (4, "same", "x"),
    (5, "q" * 700 + " z", "x"), (6, " " * 300 + "中文😀 <|endoftext|> \x1c\x85", "x"), (7, "Σίσυφος ΣΑΣ İK é", "x"),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, c, c) for i, t, c in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string")


def empty(df):
    return df.limit(0)


def test_token_counts_equal_the_library(edges):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got = token_count.count_tokens(edges, WORDS)
    assert got.columns == edges.columns[:2] + ["n_tokens", "ids"]
    for r in got.collect():
        assert r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_count.count_tokens(empty(edges), WORDS).collect() == []


def test_byte_bpe_round_trip(edges):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytepair.read_ranks(RANKS), special_tokens={})
    long = [(20, "a " + "xyzzy0" * 900 + " b"), (21, "qé" * 3000 + " ?!?!" + " " * 5000 + "z"), (22, "-" * 5000 + " one-two -"), (23, " ".join(["w"] * 2500) + " quux")]
    rows = edges.unionByName(spark_rows(edges, long), allowMissingColumns=True)
    out = bytepair.encoded(rows, RANKS, P.PATTERN, back="n_tokens")
    assert out.columns == ["doc_id", "text", "n_tokens", "ids"] and out.count() == rows.count()
    for r in bytepair.decoded(out, RANKS, into="again").collect():
        assert r["ids"] == ",".join(map(str, enc.encode_ordinary(r["text"] or "")))
        assert bytes(r["n_tokens"]) == bytes(r["again"]) == (r["text"] or "").encode()
    assert bytepair.encoded(empty(edges), RANKS, P.PATTERN, back="b").collect() == []
    unknown = spark_rows(edges, [(1, "5,99999999"), (2, None), (3, "")])
    assert [r["b"] and bytes(r["b"]) for r in bytepair.decoded(unknown, RANKS, "text", "b").orderBy("doc_id").collect()] == [None, None, b""]


def spark_rows(like, rows):
    return like.sparkSession.createDataFrame(rows, "doc_id long, text string")


def test_fold_equals_the_heap_without_a_table(edges, monkeypatch):
    monkeypatch.setattr(bytepair, "FREQUENT", 0)
    monkeypatch.setattr(bytepair.Encoder, "whole", property(lambda e: e.spark.createDataFrame([], "key string, value string")))
    ranks = bytepair.read_ranks(RANKS)
    r = random.Random(9)
    words = [t for t in (b.decode("utf-8", "ignore") for b in r.sample(sorted(ranks), 300)) if re.fullmatch("[a-z]+", t)]
    words += ["".join(r.choice("aabnt") for _ in range(r.randint(1, 40))) for _ in range(100)] + ["a" * n for n in range(1, 30)]
    got = bytepair.encoded(spark_rows(edges, list(enumerate(words))), RANKS, "[^ ]+").collect()
    for row in got:
        assert row["ids"] == bytepair.heap_encode(row["text"], ranks)


def test_top_k_is_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 20)]) for i in range(400)]
    rows += [(400, None), (401, [float("nan")] * 20), (402, [None] * 20), (None, [0.1] * 20), (50, rows[50][1]), (403, rows[7][1]), (404, [0.5, 0.5])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, k=5)
    use = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and not np.isnan(v).any()]
    want = []
    for q, v in {i: v for i, v in use if i % 50 == 0}.items():
        s = sorted((-int(v @ w), i) for i, w in use if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_in_several_parts_moves_few_copies(spark, monkeypatch):
    """Before, each query block went to as many groups as there are shuffle partitions, and was buffered in a join."""
    for gb in (0.02, 6, 30):
        parts, groups = knn.spread(int(gb * 1e9 / 100), round(100 * gb) + 12, 6)
        # whole numbers of two bytes: half the input
        assert parts * gb / 2 + groups * gb / 100 < 4 * gb
    monkeypatch.setattr(knn, "HELD", 700)
    monkeypatch.setattr(knn, "QUERIES", 3)
    monkeypatch.setattr(knn, "CANDIDATES", 16)
    r = np.random.default_rng(4)
    v = np.concatenate((r.integers(-200, 200, (300, 20)), r.integers(-(2**30), 2**30, (40, 20)), [[2**40] + [0] * 19] * 3, np.zeros((4, 20), int)))
    rows = [(i, [float(x) for x in x]) for i, x in enumerate(v.tolist())] + [(900, []), (910, []), (911, [])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=5, scale=1)
    want = [(900, 1, 910, 0), (900, 2, 911, 0), (910, 1, 900, 0), (910, 2, 911, 0)]
    for q in range(0, len(v), 10):
        clipped = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[q].tolist(), x)))), i) for i, x in enumerate(v.tolist()) if i != q]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(sorted(clipped)[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_wide_scores_stay_whole():
    c = np.array([[2.0**60], [1.0]])
    [(own, ids, score)] = knn._search_wide(np.array([1]), np.array([[1.0, 3.0]]), np.array([2]), c, 5)
    assert (own, ids.tolist(), score.tolist()) == (1, [2], [2**60 + 3])


def brute_components(n, links):
    at = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(at[a], at[b])
            if at[a] != m or at[b] != m:
                at[a] = at[b] = m
                changed = True
    return at


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 360)]
    want = brute_components(361, links)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(361))
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_many_chunks_broadcast_nothing(spark, monkeypatch):
    """Before, each round's minima were broadcast, by way of the driver, and a last round only found that nothing changed."""
    r = random.Random(8)
    links = [(r.randrange(900), r.randrange(900)) for _ in range(700)] + [(i, i + 1) for i in range(900, 1100)]
    table = spark.createDataFrame(links, "a long, b long")
    want = brute_components(1101, links)
    names, plans = [], []
    write = components.written

    def written(df, name):
        out = write(df, name)
        names.append(name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(components, "written", written)
    for chunk, most in ((1 << 18, 0), (40, 12)):
        monkeypatch.setattr(components, "CHUNK", chunk)
        names.clear()
        got = {x["node"]: x["component"] for x in components.components(table).collect()}
        assert all(got.get(i, i) == want[i] for i in range(1101)) and names.count("round") <= most
    assert names.count("round") and "Broadcast" not in "".join(plans)


def print_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    base = [prose(200, s) for s in range(15)]
    texts = [*base, *[b.replace(" ", "  ", 3) for b in base[:5]], *[b + " x" for b in base[5:12]], "", None, "one", "TWO words", *base[:3]]
    rows = list(enumerate(texts)) + [(None, base[0])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [print_of(t) for t in texts]
    want = brute_components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    found = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows)
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [found[i]["component_id"] for i in range(len(texts))] == want
    kept = simhash.one_of_each(spark.createDataFrame([*rows, rows[1]], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_grid_finds_all_links_within_two_bits(spark):
    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(60)]
    prints = sorted({s ^ sum(1 << b for b in r.sample(range(64), k)) for s in seeds for k in (0, 1, 2, 3, 4)} | {0, 2**64 - 1, 2**63, 1, 3})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    got = components.components(simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    found = {x["node"]: x["component"] for x in got.collect()}
    want = brute_components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    groups = collections.defaultdict(set)
    for i, w in enumerate(want):
        groups[w].add(found.get(signed[i], signed[i]))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_paragraphs_that_repeat_go(spark):
    p, q = prose(70, 100), prose(60, 101)
    near = p.split(" ")
    near[30] = "changed"
    rows = [
        (1, prose(40, 1) + "\n" + p + "\n" + prose(30, 2)), (2, prose(50, 3) + "\n" + " ".join(near)), (3, prose(80, 4) + " " + q + " " + prose(80, 5)),
        (4, prose(33, 6) + " " + q + " " + prose(44, 7)), (5, prose(400, 8)), (6, None), (7, ""), (8, p.upper()), (None, prose(30, 9)), (5, prose(400, 8)),
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, removed string")
    got = collections.defaultdict(list)
    for r in paragraphs.deduplicated(df).collect():
        got[r["doc_id"]].append(r)
    assert len(got[5]) == 2 and all(r["text"] == prose(400, 8) for r in got[5])
    assert got[1][0]["text"] == rows[0][1] and got[6][0]["text"] is None and got[7][0]["text"] == ""
    assert got[2][0]["text"] == prose(50, 3) and got[8][0]["text"] == ""
    assert len(got[4][0]["text"]) < len(rows[3][1]) - 60 and [s["kept_doc"] for s in got[4][0]["removed"]][0] == 3
    assert paragraphs.deduplicated(df.limit(0)).collect() == []
    assert {r["doc_id"]: r["n_removed"] for r in paragraphs.digest(df).collect()}[1] == 0


def test_ascii_words_are_hashed_at_once(monkeypatch):
    """Before, each word that was not remembered was brought to its normal form one by one."""
    normal, asked = paragraphs.normal, []
    monkeypatch.setattr(paragraphs, "normal", lambda w: asked.append(w) or normal(w))
    monkeypatch.setattr(paragraphs, "_hashes", {})
    words = "Don't dont DONT. -- 42 été ÉTÉ, \u201cdont\u201d x\x1cY xy a--b ab \u2014 \u212aelvin kelvin".split(" ")
    h = paragraphs._split(" ".join(words).encode())[2].tolist()
    assert sorted(w.decode() for w in asked) == sorted(w for w in words if not w.isascii())
    for x, p in zip(words, h):
        assert [p == q for q in h] == [normal(x.encode()) == normal(y.encode()) for y in words]


def test_short_texts_are_cut_up_together(monkeypatch):
    """Before, each text, each line of a candidate and each text with repeats was split and hashed by itself."""
    import pyarrow as pa

    p, split, asked = prose(70, 240), paragraphs._split, []
    monkeypatch.setattr(paragraphs, "_split", lambda data: asked.append(data) or split(data))
    texts = ["", "\n \n", "lo " * 200, "ra ru ri " * 40, f"é {p}\n{p}\n\u4e2d\u6587", "-- " * 60, prose(51, 241), prose(50, 242) + "\n"]
    texts += [f"{prose(n, 300 + n)}{chr(10) * (n % 3)} {p if n % 7 == 0 else 'ü'}" for n in range(150)] + [prose(20_000, 243), "", p]
    ids = [None if n % 9 == 4 else n // 2 for n in range(len(texts))]
    names, kinds = ["doc", "key", "text", "hot"], [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]

    def rows_of(f, picked, hot):
        columns = [[ids[n] for n in picked], picked, [texts[n] for n in picked], [hot.get(n) for n in picked]]
        return [r for b in f(iter([pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)])) for r in b.to_pylist()]

    def both(f, picked, hot):
        asked.clear()
        together, calls = rows_of(f, picked, hot), len(asked)
        alone = [r for n in picked for r in rows_of(f, [n], hot)]
        assert sorted(map(repr, together)) == sorted(map(repr, alone)) and calls < len(picked) / 5
        return together

    units = both(paragraphs._cut_up, list(range(len(texts))), {})
    lines, marks = [r for r in units if r["at"] is None], {r["key"]: r["at"] for r in units if r["at"] is not None}
    for r in lines:
        assert texts[r["key"]][r["start"] : r["end"]] == r["words"] and ids[r["key"]] == r["doc"]
    normal = [[paragraphs.normal(w) for w in t.encode().split()] for t in texts]
    assert set(marks) == {n for n, w in enumerate(normal) if len(w) >= 51}
    for n, at in marks.items():
        assert max(np.diff([-1, *at, len(normal[n]) - 25])) <= 26
    runs = both(paragraphs._long_runs, list(marks), {n: at[::2] for n, at in marks.items()})
    words_of = {}
    for r in runs:
        words = normal[r["key"]][r["at"] : r["at"] + 51]
        assert len(words) == 51 and words_of.setdefault(r["hash"], words) == words
        assert [paragraphs.normal(w) for w in texts[r["key"]][r["start"] : r["end"]].encode().split()] == words
    assert {(r["key"], r["at"]) for r in runs} == {(n, i) for n, at in marks.items() for m in at[::2] for i in range(max(m - 25, 0), min(m, len(normal[n]) - 51) + 1)}
    asked.clear()
    own = [r["words"] for r in lines] + ["few words"]
    sets = paragraphs._shingles.func(pa.array(own)).to_pylist()
    assert len(asked) < len(own) / 5
    for line, got in zip(own, sets):
        assert sorted(got) == np.unique(paragraphs._rolled(split(line.encode())[2]).view(np.int64)).tolist()


def test_two_numbers_in_one(spark):
    """Runs go through their shuffle so; before, each number was a column of its own."""
    top = 2**31 - 1
    rows = [(a, b) for a in (0, 1, 70_000, top) for b in (0, 3, 2**30, top)]
    df = spark.createDataFrame(rows, "a int, b int").select("a", "b", paragraphs._paired("a", "b").alias("p"))
    got = df.orderBy("p").select("a", "b", *paragraphs._both("p")).collect()
    assert [tuple(r) for r in got] == [(a, b, a, b) for a, b in rows]


def wrapped(text, n):
    w = text.split(" ")
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def left_by_brute_force(texts, run=51):
    """Words that stay where each word of a run that stands earlier goes; a run that overlaps its first place loses its last word."""
    first, out = {}, []
    for d, text in enumerate(texts):
        w = text.split()
        gone = set()
        for i in range(len(w) - run + 1):
            at = first.setdefault(tuple(w[i : i + run]), (d, i))
            if at != (d, i):
                gone |= {i + run - 1} if at[0] == d and i < at[1] + run else set(range(i, i + run))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_a_pasted_passage_goes_from_end_to_end(spark):
    p = prose(51, 200)
    texts = [f"{prose(60, 201)} {p} {prose(60, 202)}", f"{prose(45, 203)} {p} {prose(70, 204)}", f"{prose(41, 205)} {' '.join(p.split(' ')[:50])} {prose(41, 206)}"]
    rows = paragraphs.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["text"].split() for r in rows}
    assert got == dict(enumerate(left_by_brute_force(texts)))
    assert len(got[0]) == 171 and len(got[1]) == 115 and len(got[2]) == 132


def test_passages_over_short_lines_go(spark):
    p, q = prose(90, 210), prose(140, 211)
    head = lambda n, s: wrapped(prose(n, s), 9)
    texts = [
        f"{head(30, 212)}\n{wrapped(p, 12)}\n{head(31, 213)}\n{wrapped(q, 19)}", f"{head(33, 214)}\n{wrapped(p, 7)}\n{head(20, 215)}", wrapped(q, 15) + "\n" + wrapped(p, 11),
        head(25, 216) + "\n" + wrapped(q, 19), wrapped(q[: len(q) // 2], 10) + "\n" + head(14, 217), f"{head(31, 218)}\n{wrapped(p, 5)}\né {wrapped(p, 6)} ü",
    ]
    rows = paragraphs.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"].split() for r in rows} == dict(enumerate(left_by_brute_force(texts)))


def test_short_runs_stay_and_repetitive_ones_go(spark):
    p, w = prose(36, 220), "lo"
    texts = [f"{prose(50, 221)} {p} {prose(50, 222)}", f"{prose(50, 223)} {p} {prose(50, 224)}", " ".join([w] * 300), f"{prose(50, 225)} {' '.join([w] * 200)} {prose(50, 226)}"]
    texts += [f"{prose(50 + n, 227 + n)} {' '.join(['ra', 'ru', x] * 20)} {prose(50, 228 + n)}" for n, x in enumerate(["ri", "ro"])]
    rows = paragraphs.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["text"].split() for r in rows}
    assert got == dict(enumerate(left_by_brute_force(texts)))
    assert [len(got[i]) for i in range(4)] == [136, 136, 51, 100]


def test_minhash_bands_find_similar_pairs():
    hits = []
    for s in range(300):
        a = prose(60, s).split(" ")
        b = a[:-6] + prose(4, 10_000 + s).split(" ")
        if paragraphs.jaccard(" ".join(a), " ".join(b)) >= 0.8:
            x, y = (paragraphs.Units(" ".join(w).encode()).bands[0] for w in (a, b))
            hits.append(bool((x == y).any()))
    assert len(hits) > 100 and np.mean(hits) > 0.95


def brute_tiles(p, t, least):
    """Greedy tiling by comparing everything: total length of the tiles."""
    pf, tf, total = [True] * len(p), [True] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and pf[i + k] and tf[j + k] and p[i + k] == t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        for x in range(k):
            pf[i + x] = tf[j + x] = False
        total += k


def test_tiling(spark):
    r = random.Random(4)
    for n in range(150):
        p = [r.randrange(3 + n % 40) for _ in range(25)]
        t = p[13:] + [r.randrange(12) for _ in range(9)] + p[:12]
        got = tiling.tiles(p, t, 5)
        assert sum(k for _, _, k in got) == brute_tiles(p, t, 5)
        assert all(p[i : i + k] == t[j : j + k] for i, j, k in got)
    item = prose(40, 50).split(" ")
    swapped = item[20:] + prose(10, 51).split(" ") + item[:20]
    half = prose(30, 52).split(" ") + item[:20]
    docs = [(1, " ".join(swapped)), (2, " ".join(half)), (3, None), (4, ""), (5, "Tiny ITEM here"), (6, prose(500, 53)), (6, " ".join(item * 30))]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "tiny item"), (9, None), (None, "x"), (10, "")], "item_id long, text string")
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, leaks int")
    got = [(r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in tiling.matches(df, bench).collect()]
    assert sorted(got) == [(1, [7]), (2, []), (3, []), (4, []), (5, [8]), (6, []), (6, [7])]
    assert tiling.matches(df, bench.limit(0)).where(F.size("leaks") > 0).count() == 0


def test_max_coverage_over_several_blocks(spark, tmp_path, monkeypatch):
    items = [prose(40, 300 + n).split(" ") for n in range(12)]
    texts = [" ".join(items[n][:34] + items[(n + 1) % 12] + items[(n + 2) % 12][:36]) for n in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 600)
    for r in queries.op2_benchmark_decontamination(spark, str(tmp_path)).collect():
        assert (r["max_coverage"], r["n_items"]) == (1.0, 3)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for r in tiling.matches(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect():
        found = [(-x["coverage"], x["item_id"]) for x in r["leaks"]]
        assert found == sorted(found) and len(found) == 3


CLASHES = ["_leaks", "_leaks_0", "_score", "_fp", "_key", "_keep", "_number", "_node", "_doc", "_spans", "_text_key", "_begun", "_late", "_done", "_table0"]


def test_private_columns_of_the_user_stay(spark):
    docs = spark.createDataFrame([(1, prose(60, 1)), (2, prose(60, 1)), (3, None), (3, None)], "doc_id long, text string")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    bench = spark.createDataFrame([(1, prose(30, 2))], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    made = [
        tiling.clean(docs, bench), toxicity.clean(docs, labels), near_copies.one_of_each(docs), simhash.one_of_each(docs),
        paragraphs.deduplicated(docs, into="lost").drop("lost"), bytepair.encoded(docs, RANKS, P.PATTERN, into="i", back="b").drop("i", "b"),
    ]
    for out, n in zip(made, (4, 4, 2, 2, 4, 4), strict=True):
        assert out.columns == docs.columns and out.count() == n
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES)


def test_licenses(spark):
    docs = [
        (1, "Released under the MIT License."), (2, "GNU General Public License gnu general public license mit license mit license"), (3, None), (4, ""),
        (5, prose(500, 60) + " licensed under the Apache License, Version 2.0 " + prose(300, 61)), (6, "permission is hereby granted"), (1, "Released under the MIT License."),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    got = license_scan.scan(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, labels int"))
    rows = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r))
    assert [r[:2] + r[2:7] for r in rows if r[0] == 1] == [(1, 5, 1, 3, 3, "mit", "mit")] * 2
    by = {r[0]: r for r in rows}
    assert by[2][1:6] == (12, 4, 0, 10, "gpl,mit") and by[3][1:5] == (0, 0, None, None) and by[6][6] == ""
    assert by[5][5:7] == ("apache", "apache") and by[None][5:7] == ("cc-by", "cc-by,cc-by-nc")
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = prose(r.randint(10, 120), i).split(" ")
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), "zorrk" + r.choice(["el", "an", "o", "ish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int"))
    scored = {x["doc_id"]: x["score"] for x in toxicity.with_score(docs, model).collect()}
    held = [i for i, _ in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in scored.values()) and scored[5000] < 0.5
    nothing = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.scores(["", "you idiot moron"])[1] > 0.5 > nothing.scores(["fine"])[0]


def test_repeated_ids_keep_the_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 30)
    monkeypatch.setattr(toxicity, "NEGATIVES", 60)
    sizes = []
    fit = toxicity.Trees.__init__
    monkeypatch.setattr(toxicity.Trees, "__init__", lambda self, x, *a, **k: (sizes.append(len(x)), fit(self, x, *a, **k))[1])
    docs = spark.createDataFrame([(i, prose(20, i) + (" zorrkel" * 3 if i % 3 == 0 else "")) for i in range(400)] * 5, "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int"))
    assert max(sizes) == 90


def test_isotonic_never_falls():
    r = np.random.default_rng(1)
    xs, ys = toxicity.isotonic(r.normal(size=200), r.integers(0, 2, 200).astype(float), np.ones(200))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>é\r\n\r\n" + "x" * 1200, "tiny"
    rows = [(1, "http://a.b/c d?e#f", big), (2, None, big), (3, "u", small), (4, "http://a.b", small), (5, "v", None), (6, "v", ""), (7, "w", big), (None, "n", big), (3, "u", small)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, type int")
    got = warc.captured(pages).select("capture.*", "request", "metadata.fields").collect()
    assert len(got) == len(rows)
    sha = hashlib.sha1(big.encode()).hexdigest()
    by = collections.defaultdict(list)
    for r in got:
        by[r["fields"].get("page-id")].append(r)
    assert by["7"][0]["type"] == "response" and by["7"][0]["payload_sha1"] == sha and by["7"][0]["payload_bytes"] == len(big.encode())
    for i in ("1", "2", None):
        assert by[i][0]["type"] == "revisit" and by[i][0]["payload_digest"] == sha and by[i][0]["fields"]["refers-to-page-id"] == "7"
    assert [r["type"] for r in by["3"]] == ["response"] * 2 and by["5"][0]["payload_bytes"] == 0
    assert by["1"][0]["request"]["first_line"] == "GET /c%20d?e HTTP/1.1" and by["1"][0]["target_uri"].startswith("http://a.b/c%20d")
    assert warc.captured(pages.limit(0)).collect() == []
    for i in ("1", "2", None):
        assert by[i][0]["refers_to"] == by["7"][0]["record_id"] and by[i][0]["refers_to_uri"] == "w"
    assert len({r["record_id"] for r in got}) == len(rows)


def test_warc_files_of_other_writers(spark, tmp_path):
    import gzip

    def record(kind, name, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Target-URI: http://x", *more, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    members = [
        record("warcinfo", "i", b"software: x"), record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\none"), record("response", "r2", b"HTTP/1.1 200 OK\r\n\r\ntwo!"),
        record("metadata", "m", b"via: y", "WARC-Concurrent-To: <r1>", "WARC-Concurrent-To: <r2>"),
    ]
    (tmp_path / "crawl-0001.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    (tmp_path / "plain.warc").write_bytes(record("response", "r3", b"HTTP/1.1 200 OK\r\n\r\n"))
    got = {r["capture"]["record_id"]: r for r in warc.transactions(warc.read_warc(spark, str(tmp_path))).collect()}
    assert {k: r["capture"]["payload_bytes"] for k, r in got.items()} == {"<r1>": 3, "<r2>": 4, "<r3>": 0}
    assert got["<r1>"]["metadata"]["fields"] == got["<r2>"]["metadata"]["fields"] == {"via": "y"} and got["<r3>"]["metadata"] is None


def test_resampling_prefers_the_target(spark):
    good = [(i, prose(80, i)) for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}%%% ***" for w in prose(40, 5000 + i).split(" "))) for i in range(100)]
    docs = spark.createDataFrame([*good, *junk, (None, None), (2000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 3)] + [(1000 + i, 0) for i in range(0, 100, 3)] + [(5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in resample.resampled(docs, labels).collect()}
    assert np.mean([got[i]["selected"] for i, _ in good]) > 0.95 and np.mean([got[i]["selected"] for i, _ in junk]) < 0.1
    assert got[2000]["log_weight"] == 0
    # the whole result by brute force, from the documents alone
    texts = dict([*good, *junk, (None, None), (2000, "")])

    def grams(text):
        h = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        whole = [x * 0xD6E8FEB86659FD93 for x in h] + [(x * 0x9E3779B97F4A7C15 % 2**64) ^ (y * 0xC2B2AE3D27D4EB4F % 2**64) for x, y in zip(h, h[1:])]
        return [(x % 2**64 >> 20) % 10_000 for x in whole]

    raw, goal = collections.Counter(range(10_000)), collections.Counter(range(10_000))
    for i, text in texts.items():
        raw.update(grams(text))
        if i is not None and i % 3 == 0 and i < 300:
            goal.update(grams(text))
    all_raw, all_goal = sum(raw.values()), sum(goal.values())
    ratio = {b: math.log(goal[b] / all_goal) - math.log(raw[b] / all_raw) for b in range(10_000)}
    for i, text in texts.items():
        assert got[i]["log_weight"] == pytest.approx(sum(ratio[b] for b in grams(text)))
    keys = sorted((r["gumbel_key"] for r in got.values()), reverse=True)
    bar = keys[round(len(texts) * 100 / 134) - 1]
    assert all(r["selected"] == (r["gumbel_key"] >= bar) for r in got.values())
    # the noise is standard Gumbel: of the form -log(-log(u)) with u spread evenly
    noise = np.sort([math.exp(-math.exp(r["log_weight"] - r["gumbel_key"])) for r in got.values()])
    assert np.abs(noise - (np.arange(len(noise)) + 0.5) / len(noise)).max() < 0.08


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(resample, "AT_ONCE", 10)
    r = np.random.default_rng(2)
    xs = [*r.normal(size=500).tolist(), *[1.5] * 40]
    keys = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 20, 300, 540):
        assert resample.kth_largest(keys, "x", k) == sorted(xs, reverse=True)[k - 1]
    assert resample.kth_largest(keys, "x", 541) == float("-inf")


@pytest.mark.parametrize("near", [0, 3, 40])
def test_buckets_give_few_links_and_all_components(spark, near):
    """Members alike within ``near``; the smallest of the large bucket is unlike all others."""
    rng = random.Random(near)
    large = [1_000_000 + n if near == 40 else 1_000_000 + rng.randrange(4000) for n in range(400)]
    rows = [("large", n) for n in {0, *large}] + [(f"b{n % 60}", rng.randrange(3000)) for n in range(600)]
    rows = sorted(set(rows))
    alike = lambda a, b: F.abs(a - b) <= near
    links = components.bucket_links(spark.createDataFrame(rows, "key string, node long"), alike)
    got = {(r.a, r.b) for r in links.collect()}
    pairs = {(a, b) for k, a in rows for j, b in rows if k == j and a < b and b - a <= near}
    assert got <= pairs
    name = {n: n for _, n in rows}

    def root(n, parent):
        while parent[n] != n:
            n = parent[n]
        return n

    def parted(edges):
        parent = dict(name)
        for a, b in edges:
            x, y = root(a, parent), root(b, parent)
            parent[max(x, y)] = min(x, y)
        return {n: root(n, parent) for n in name}

    assert parted(got) == parted(pairs)


def test_a_group_unlike_its_bucket_s_smallest_gives_linear_links(spark):
    rows = [("k", 0)] + [("k", n) for n in range(1000, 1400)]
    links = components.bucket_links(spark.createDataFrame(rows, "key string, node long"), lambda a, b: F.abs(a - b) < 500)
    assert links.distinct().count() < 20 * len(rows)

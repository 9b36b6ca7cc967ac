"""Stages of the pipeline on planted fixtures, against brute force."""

import hashlib
import os
import random

import corpus_pipeline
import public_tokenizers as P
from test_llm import RANKS, brute_components, brute_tiles, left_by_brute_force, print_of, prose

from quirelake.llm import _shared, bytepair

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], COLUMNS)


def toxic(n):
    r = random.Random(n)
    return " ".join(prose(20 + n % 50, n).split(" ") + ["you", "zorrk" + r.choice(["el", "an", "o"]), "zorrkish"])


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_near_copies_of_jaccard_0_8_go(spark):
    r = random.Random(3)
    texts = [prose(200, 700 + s) for s in range(12)]
    for s in range(12):
        for changes in (1, 3, 4, 9, 20):
            w = texts[s].split(" ")
            for at in r.sample(range(200), changes):
                w[at] = f"edit{s}x{changes}"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), texts[1].replace(" ", "\n"), "", None, "*** ***", "%%% %%%", "one two", "ONE  two", "one three"]
    sets = [shingle_set(t) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = sorted(set(brute_components(len(texts), alike)))
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[5])], "doc_id long, text string")
    got = corpus_pipeline.STAGES[1][1](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == want


def test_near_copies_by_fingerprint_go(spark):
    """Before, the stage had no fingerprints: texts within 2 bits stayed if their sets of shingles were unlike."""
    texts = [prose(150, 40 + s) for s in range(5)]
    for s in range(5):
        p = prose(40, 800 + s)
        texts += [" ".join([p] * 20 + [prose(60, 810 + 10 * s + n)]) for n in range(3)]
    texts.append(" ".join([*texts[7].split(" ")[:-1], "other"]))
    sets, prints = [shingle_set(t) for t in texts], [print_of(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    near = [(i, j) for i, j in pairs if bin(prints[i] ^ prints[j]).count("1") <= 2]
    alike = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = sorted(set(brute_components(len(texts), near + alike)))
    assert len(want) < len(set(brute_components(len(texts), alike)))
    got = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in got) == want


def test_toxic_documents_go(spark, tmp_path):
    texts = [toxic(n) if n % 5 == 0 else prose(20 + n % 50, n) for n in range(600)] + ["", None]
    spark.createDataFrame([(n, int(n % 5 == 0)) for n in range(0, 500)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, texts)
    out = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    # rows without a label are rejected or kept by the same rule
    assert sorted(r["doc_id"] for r in out.collect()) == [n for n in range(602) if n % 5 or n >= 600]


def test_repeats_are_cut(spark):
    p, q = prose(60, 1), prose(75, 2)
    texts = [f"{prose(30, 3)} {p} {prose(31, 4)}", f"{prose(15, 5)} {p} {prose(19, 6)}", f"{q}", f"{prose(19, 7)} {q}", None, "", f"{p} {q}"]
    out = corpus_pipeline.STAGES[2][1](spark, documents(spark, texts), "")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert {i: (r["text"] or "").split() for i, r in rows.items()} == dict(enumerate(left_by_brute_force([t or "" for t in texts])))
    assert out.columns == COLUMNS.replace("long", "").replace("string", "").replace(" ", "").split(",")
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows.values())


def test_leaks_go(spark, tmp_path):
    r, items = random.Random(6), [prose(n, 50 + n) for n in (3, 12, 30, 45)]
    spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["", None]
    for n in range(60):
        w = r.choice(items).split(" ")
        cut = r.randrange(len(w))
        for at in r.sample(range(len(w)), r.randrange(len(w) // 3 + 1)):
            w[at] = "other"
        texts.append(" ".join([*prose(20, n).split(" "), *w[cut:], *prose(6, 99 + n).split(" "), *w[:cut]]))

    def leaks(text, item):
        p, t = item.split(" "), text.split(" ")
        return brute_tiles(p, t, min(5, len(p))) >= 0.8 * len(p)

    want = [i for i, t in enumerate(texts) if not any(leaks(t or "", item) for item in items)]
    got = corpus_pipeline.STAGES[3][1](spark, documents(spark, texts), str(tmp_path))
    assert 2 < len(want) < 60 and sorted(x["doc_id"] for x in got.collect()) == want


def test_run(spark, tmp_path):
    import tiktoken

    item, p = prose(40, 900), prose(80, 901)
    near = prose(100, 902).split(" ")
    texts = [prose(60, n) for n in range(90)] + [toxic(n) for n in range(10)]
    texts += [f"{prose(30, 903)} {item} {prose(30, 904)}", " ".join(near), " ".join(near[:50] + ["x"] + near[51:]), f"{prose(30, 905)} {p}", f"{p} {prose(33, 906)}", texts[4], None]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    marked = [(n, int(n >= 90)) for n in range(100)] + [(1000 + n, n % 2) for n in range(400)]
    extra = documents(spark, [toxic(500 + n) if n % 2 else prose(40, 3000 + n) for n in range(400)], 1000)
    extra.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marked, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # toxic ones, the second near copy and the copy, and the leak are gone; the repeat is cut
    want = {n: texts[n] for n in [*range(90), 101, 103, 106]} | {104: prose(33, 906)}
    want |= {1000 + n: prose(40, 3000 + n) for n in range(0, 400, 2)}
    assert sorted(got) == sorted(want)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytepair.read_ranks(RANKS), special_tokens={})
    for n, text in want.items():
        data = (text or "").strip()
        ids = enc.encode_ordinary(data)
        assert got[n]["ids"].strip() in (",".join(map(str, ids)), ",".join(map(str, enc.encode_ordinary(" " + data))))
        if n != 104:
            assert got[n]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() and got[n]["n_tokens"] == len(ids)


def test_a_stage_drops_the_steps_before_it_but_not_what_its_docs_read(spark):
    with _shared.stage(spark.range(1)):
        gone, read = _shared.written(spark.range(3), "gone"), _shared.written(spark.range(5), "read")
    gone_file, read_file = gone.inputFiles()[0], read.inputFiles()[0]
    with _shared.stage(read.where("id > 0"), last=True):
        kept = _shared.written(spark.range(2), "kept")
    assert not os.path.exists(gone_file.removeprefix("file://")) and os.path.exists(read_file.removeprefix("file://"))
    with _shared.stage(spark.range(1), last=True):
        assert kept.count() == 2
    assert spark.conf.get(_shared.CLEANED, None) is None


def test_a_stage_returns_native_memory_that_the_driver_freed(spark):
    """Before, the driver's JVM kept what it had freed, and grew from stage to stage."""
    jvm, size = spark.sparkContext._jvm, 64 << 10
    with open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup") as f:

        def resident():
            f.seek(0)
            return next(int(x.split()[1]) for x in f.read().splitlines() if x.startswith("Pss_Anon:")) << 10

        memory = jvm.org.apache.spark.unsafe.Platform
        held = [memory.allocateMemory(size) for _ in range(3000)]
        for at in held:
            memory.setMemory(at, 1, size)
        # the last block stays, or the allocator may give back the end by itself
        for at in held[:-1]:
            memory.freeMemory(at)
        before = resident()
        with _shared.stage(spark.range(1), last=True):
            after = resident()
        memory.freeMemory(held[-1])
    assert before - after > 1500 * size

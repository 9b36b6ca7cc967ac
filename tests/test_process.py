"""Whole records, fallback, reports, command line and files."""

import csv
import json

import pytest
from pyspark.sql import functions as F
from test_operators import TEI

from quirelake import engine
from quirelake.operators import corpus, media, metrics, process, validate
from quirelake.sources import records
from quirelake.sources import tei as xml

BROKEN = "<TEI><text>"
REVIEW = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A systematic review</title></titleStmt></fileDesc></teiHeader><text><body>
<div><head>Study selection</head><p>Two readers.</p></div><div><head>Notes</head><p>Some.</p></div><div><head>Discussion</head><p>Brief.</p></div></body></text></TEI>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tei")
    for name, text in (("a", TEI), ("b", BROKEN), ("c", REVIEW)):
        (path / f"{name}.tei.xml").write_text(text)
    (path / "x.PDF").write_bytes(b"%PDF")
    (path / "note.txt").write_text("no")
    return path


def test_every_input_gives_a_record(spark):
    tei = spark.createDataFrame([(1, "in/a.xml", TEI), (2, "in/b.xml", BROKEN), (3, "in/c.xml", REVIEW), (4, "in/d.xml", None)], "doc_id long, path string, xml string")
    look = spark.createDataFrame([("10.1234/abc", None, "J", "y" * 40)], "doi string, title string, journal string, abstract string")
    got = {r["doc_id"]: r for r in process.process(tei, process.Lookups(by_doi=look)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for n in (2, 4):
        r = got[n]
        assert r["meta"]["source_path"] == f"in/{'b' if n == 2 else 'd'}.xml" and r["meta"]["title"] is None
        assert r["sections"] == {} and r["figures"] == [] and r["references"] == []
    one = got[1]
    assert one["meta"].asDict(True) == {
        "source_path": "in/a.xml", "title": "Sample Title", "journal": "Journal Name", "doi": "10.1234/abc", "authors": [{"name": "Ada Poe", "affiliation": "Inst, X"}], "keywords": ["a", "b"],
    }
    # the document's own abstract is shorter than thirty characters
    assert one["sections"] == {"introduction": "Outer text , p < 0.05. Inner.\n\nInner.", "abstract": "y" * 40} and one["other_sections"] == {"Novel Protocol": "New."}
    assert [f["label"] for f in one["figures"]] == ["Figure 1"] and [t["label"] for t in one["tables"]] == ["Table 1", "Table 3", "Table 2"]
    assert [r["title"] for r in one["references"]] == ["Ref", "Book"]
    assert got[3]["sections"] == {"materials_and_methods": "Two readers.", "discussion": "Brief.\n\nNotes\nSome."}


def test_media_of_records(spark):
    m = "array<struct<label string, caption string, path string, source string, coords string, pdf_bbox struct<page_index int, bbox array<double>>, csv_path string>>"
    item = lambda label, caption, path, source, box=None: (label, caption, path, source, None, box, None)
    rows = [(1, [item(None, None, "m/page001_img01.png", "embedded-image"), item(None, None, "m/page001_crop01.png", "grobid+crop"), item(None, None, "m/page002_img01.png", "embedded-image"), item("3", "c", None, "tei")],
             [item("Table 1", "Cap", None, "tei"), item(None, "cap", "p.png", "detector-table", (4, [1.0, 2.0]))]), (2, [], [])]
    papers = spark.createDataFrame(rows, f"doc_id long, figures {m}, tables {m}")
    out = {r["doc_id"]: r for r in process.prefixed_labels(process.filtered_media(process.merged_media(papers))).collect()}
    assert [f["path"] for f in out[1]["figures"]] == ["m/page001_crop01.png", "m/page002_img01.png", None] and out[1]["figures"][2]["label"] == "Figure 3"
    (table,) = out[1]["tables"]
    assert (table["source"], table["path"], table["pdf_bbox"]["page_index"]) == ("detector-table+tei", "p.png", 4) and out[2]["tables"] == []


def test_crops_end_before_the_next_anchor(spark):
    rows = [(1, 1, 0, "Table", 5.0, 100.0), (1, 1, 1, "2", 9.0, 100.0), (1, 1, 2, "Fig.", 5.0, 300.0), (1, 1, 3, "x", 9.0, 300.0), (1, 1, 4, "7", 9.0, 300.0), (1, 2, 0, "figure", 5.0, 10.0), (1, 2, 1, "8", 9.0, 10.0)]
    words = spark.createDataFrame([(*r, 600.0, 800.0) for r in rows], "doc_id int, page int, pos int, word string, x0 double, y0 double, page_width double, page_height double")
    labels = spark.createDataFrame([(1, "2"), (1, "7")], "doc_id int, number string")
    got = [(r["page"], r["kind"], r["number"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in media.label_crops(words, labels).orderBy("page", "n").collect()]
    assert got == [(1, "table", "2", 24.0, 76.0, 576.0, 288.0), (1, "figure", "7", 24.0, 276.0, 576.0, 756.0)]
    assert media.label_crops(words).count() == 3 and media.label_crops(words, most=1).count() == 1
    assert media.in_pages(spark.createDataFrame([(0, 2), (1, 2), (2, 2), (3, 2)], "p int, n int"), "p", "n").count() == 2


def test_documents_without_headings_keep_their_row(spark, tmp_path):
    tei = spark.createDataFrame([(1, "in/a.xml", TEI), (2, "in/b.xml", BROKEN)], "doc_id long, path string, xml string")
    papers = records.stored(process.process(tei), "papers")
    heads = spark.createDataFrame([("a", n, h) for n, h in enumerate(["Introduction", "Abstract", "Funding", "Odd one", "Results"])], "stem string, ord int, head string")
    m = metrics.document_metrics(papers, heads)
    got = {r["doc_id"]: r for r in m.collect()}
    a, b = got[1], got[2]
    # an abstract heading is no mapped section
    assert (a["heads_total"], a["mapped_heads"], a["unmapped_heads"], a["noncontent_heads"], a["unmapped_samples"]) == (5, 2, 2, 1, ["Abstract", "Odd one"])
    assert a["coverage"]["introduction"] and not a["coverage"]["results"] and a["images_sources"] == {"tei": 2, "tei-ref": 1, "tei-text": 1}
    assert (b["heads_total"], b["noise"], b["images_sources"], b["unmapped_samples"]) == (0, 0.0, {}, [])
    gated = corpus.with_gates(corpus.summary(m)).first()
    assert gated["docs"] == 2 and not gated["gate_mapping"] and not gated["gates_pass"]
    often = metrics.sample_frequencies(m)
    records.write_corpus_reports(m, corpus.with_gates(corpus.summary(m)), often, often.select("head", F.lit("k").alias("key"), "n"), str(tmp_path))
    lines = [row for p in sorted((tmp_path / "corpus_quality_csv").glob("*.csv")) for row in csv.reader(p.open())]
    assert len(lines[0]) == 22 and lines[0][:4] == ["file", "title", "doi", "journal"]
    unmapped = "".join(p.read_text() for p in sorted((tmp_path / "unmapped_heads").glob("*.txt")))
    assert unmapped == "1\tAbstract\n1\tOdd one\n"


def test_metadata_points_count_six_checks(spark):
    s = "title string, doi string, journal string"
    rows = spark.createDataFrame([(("A Title", "D", "J"), ("title", "D", None)), (("A", "d", ""), ("B", "D", "J"))], f"meta struct<{s}>, want struct<{s}>")
    got = [r[0] for r in rows.select(validate.metadata_points(validate.metadata_checks(F.col("meta"), F.col("want")))).collect()]
    assert got == [25.0, 10.0]


def test_command_line(spark, folder, tmp_path):
    got = engine.run(spark, engine.EngineConfig(f"{folder}", f"{tmp_path}/out", reports=True, tei_out=f"{tmp_path}/kept"))
    assert sorted(str(r["meta"]["title"]) for r in got.collect()) == ["A systematic review", "None", "Sample Title"]
    assert (tmp_path / "out/reports/figures_csv").exists() and spark.read.text(f"{tmp_path}/kept").count() > 3
    records.write_json_array(got, f"{tmp_path}/array")
    (text,) = [p.read_text() for p in (tmp_path / "array").glob("part-*") if p.stat().st_size]
    assert len(json.loads(text)) == 3 and records.read_papers(spark, f"{tmp_path}/array", "*").count() == 3
    given = vars(engine.parser().parse_args(["p", "--out", "o", "--dedup"]))
    assert engine.EngineConfig(**given) == engine.EngineConfig("p", "o", dedup=True)
    with pytest.raises(ValueError):
        engine.EngineConfig("p", "o", "pictures")


def test_scans(spark, folder, tmp_path):
    assert [r["path"].rsplit("/", 1)[1] for r in xml.read_pdf_listing(spark, str(folder)).collect()] == ["x.PDF"]
    assert sorted(r["stem"] for r in xml.read_tei(spark, str(folder)).collect()) == ["a", "b", "c"]
    (tmp_path / "p_extraction_map.json").write_text(json.dumps({"file_name": "p.pdf", "structural_info": {"total_figures": 2}}))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "r.json").write_text(json.dumps({"meta": {"title": "T"}, "sections": {"results": "x"}}))
    (got,) = records.read_truth(spark, str(tmp_path)).collect()
    assert got["stem"] == "p" and got["structural_info"]["total_figures"] == 2
    assert [r["meta"]["title"] for r in records.read_papers(spark, str(tmp_path)).collect()] == ["T"]
    records.write_report(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int"), str(tmp_path / "report"))
    assert spark.read.json(f"{tmp_path}/report/summary").columns == ["b", "generated_at"]


def test_folders_and_lists_are_read_by_many_tasks(spark, tmp_path):
    """Written and read back the way large corpora are: no partition by stem in Spark, no file that one task must hold."""
    rows = [({"source_path": f"in/{n % 40}.pdf" if n < 80 else f"in/z{n}.pdf", "title": f"T{n}\n\"é"}, {"results": str(n)}, "a/b=%" if n == 99 else f"s{n % 40 if n < 80 else n}") for n in range(100)]
    papers = spark.createDataFrame(rows, "meta struct<source_path: string, title: string>, sections map<string, string>, stem string").repartition(7)
    for _ in range(2):  # what stood there goes
        records.write_json_by_stem(papers.withColumn("meta", F.col("meta").withField("source_path", F.concat("meta.source_path", F.col("meta.title")))), f"{tmp_path}/stem")
        records.write_json_array(papers.drop("stem"), f"{tmp_path}/array")
    back = records.read_json_by_stem(spark, f"{tmp_path}/stem")
    # of two records with one stem the last by source path stays
    want = {f"T{max((n, n + 40), key=lambda k: f'T{k}')}\n\"é" for n in range(40)} | {f"T{n}\n\"é" for n in range(80, 100)}
    assert sorted(r["meta"]["title"] for r in back.collect()) == sorted(want)
    assert back.schema == spark.read.schema(records.PAPER).json(f"{tmp_path}/stem").drop("stem").schema
    # other readers find a folder per stem
    assert {r["stem"] for r in spark.read.schema(records.PAPER + ", stem string").json(f"{tmp_path}/stem").select("stem").collect()} == {r[2] for r in rows}
    (file,) = [p for p in (tmp_path / "array").iterdir() if p.name.startswith("part-")]
    listed = json.loads(file.read_text())
    assert [r["meta"]["source_path"] for r in listed] == sorted(r[0]["source_path"] for r in rows)
    assert sorted(r["meta"]["title"] for r in listed) == sorted(r[0]["title"] for r in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        again = records.read_json_array(spark, f"{tmp_path}/array")
        assert again.rdd.getNumPartitions() > 3 and sorted(r["meta"]["title"] for r in again.collect()) == sorted(r["meta"]["title"] for r in listed)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    records.write_json_array(papers.where("false"), f"{tmp_path}/none")
    assert json.loads((tmp_path / "none" / "part-00000.json").read_text()) == [] and records.read_json_array(spark, f"{tmp_path}/none").count() == 0


def test_stem_folders_in_other_stores(spark, tmp_path, monkeypatch):
    papers = spark.createDataFrame([({"source_path": "a"}, "x"), ({"source_path": "b"}, "x"), ({"source_path": "c"}, "y")], "meta struct<source_path: string>, stem string")
    monkeypatch.setattr(records, "_mounted", lambda *_: None)
    records.write_json_by_stem(papers, f"{tmp_path}/stem")
    assert sorted(r["meta"]["source_path"] for r in records.read_json_by_stem(spark, f"{tmp_path}/stem").collect()) == ["b", "c"]

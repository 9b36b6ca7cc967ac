"""Golden cases of documents, headings, labels, media and records."""

import pytest
from pyspark.sql import functions as F

from quirelake.functions import headings, text
from quirelake.operators import corpus, enrich, extract, media, validate
from quirelake.sources import records
from quirelake.sources import tei as xml

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Sample Title</title></titleStmt><sourceDesc><biblStruct>
<analytic><author><persName><forename>Ada</forename><surname>Poe</surname></persName><affiliation><orgName>Inst</orgName><address><country>X</country></address></affiliation></author></analytic>
<monogr><title>Journal Name</title></monogr><idno type="DOI">10.1234/abc</idno></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short abstract.</p></abstract><textClass><keywords><term>a</term><term>A</term><term>b</term></keywords></textClass></profileDesc></teiHeader>
<facsimile><surface n="4"><zone xml:id="z1" ulx="1" uly="2" lrx="11" lry="7"/></surface></facsimile>
<text><body><pb n="3"/>
<div><head>1. Introduction</head><p>Outer <hi>text</hi>, p &lt; 0.05.</p><div><head>Aims</head><p>Inner.</p></div></div>
<div><head>Novel Protocol</head><p>New.</p></div><div><head>Funding</head><p>Money.</p></div><div><head>Fig. 2</head><p>no</p></div>
<figure><head>Figure 1 .</head><label>51</label><figDesc>A figure.</figDesc><graphic coords="10,20,30,40"/></figure>
<figure><head>Figure 1 .</head><figDesc>Again.</figDesc></figure>
<figure type="table" facs="#z1"><head>Table 1</head><figDesc>First table.</figDesc></figure>
<p>As shown in Table <ref type="table">3</ref> , values increased.</p><p>Table 2. Caption for two.</p></body>
<back><listBibl><biblStruct xml:id="b0"><analytic><title type="main">Ref</title><author><persName>P. Q.</persName></author></analytic><monogr><title>M</title><date type="published">1999</date></monogr></biblStruct>
<biblStruct xml:id="b1"><monogr><title>Book</title></monogr></biblStruct></listBibl></back></text></TEI>"""


@pytest.fixture(scope="module")
def nodes(spark):
    parsed = xml.parse_tei(spark.createDataFrame([(1, TEI), (2, "<a><b></a>"), (3, None), (4, "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>")], "doc_id long, xml string"))
    assert {r["doc_id"] for r in xml.errors(parsed).collect()} == {2, 3, 4}
    return xml.nodes(parsed).persist()


def test_metadata(nodes):
    assert extract.titles(nodes).collect() == [(1, "Sample Title")]
    assert extract.journals(nodes).collect() == [(1, "Journal Name")]
    assert extract.dois(nodes).collect() == [(1, "10.1234/abc")]
    assert extract.authors(nodes).collect() == [(1, 1, "Ada Poe", "Inst, X")]
    assert extract.keywords(nodes).collect() == [(1, ["a", "b"])]


def test_sections_count_nested_text_twice(nodes):
    got = {(r["key"], r["text"]) for r in extract.body_sections(nodes).collect()}
    assert got == {("introduction", "Outer text , p < 0.05. Inner.\n\nInner."), ("novel_protocol", "New.")}
    assert extract.abstracts(nodes, extract.body_sections(nodes)).collect() == [(1, "Short abstract. a, b ")]


def test_media(nodes):
    got = {(r["kind"], r["label"], r["source"], r["caption"], r["coords"]) for r in extract.media(nodes).collect()}
    assert got == {
        ("figure", "Figure 1", "tei", "A figure.", "3,10.0,20.0,30.0,40.0"),
        ("table", "Table 1", "tei", "First table.", "4,1.0,2.0,10.0,5.0"),
        ("table", "Table 3", "tei-ref", "As shown in  , values increased.", None),
        ("table", "Table 2", "tei-text", "Caption for two.", None),
    }


def test_references_and_record(nodes):
    refs = [(r["index"], r["id"], r["title"], r["year"], r["authors"]) for r in extract.references(nodes).orderBy("index").collect()]
    assert refs == [(1, "b0", "Ref", "1999", ["P. Q."]), (2, "b1", "Book", None, None)]
    paper = extract.papers(nodes).first()
    assert set(paper["sections"]) == {"introduction", "abstract"} and set(paper["other_sections"]) == {"Novel Protocol"}
    assert len(paper["tables"]) == 3 and len(paper["figures"]) == 1


HEADINGS = [
    ("| 1. Methods", "materials_and_methods"), ("3d theory", "d_theory"), ("C. x", "x"), ("", ""), ("Results of methods", "materials_and_methods"),
    ("Conclusion and limitations", "conclusions"), ("Background", "introduction"), ("Results & Discussion", "results_and_discussion"), (None, ""),
]


def test_headings(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HEADINGS)], "i int, head string")
    got = {r["i"]: r["key"] for r in headings.classify(df, "head").collect()}
    assert [got[i] for i in range(len(HEADINGS))] == [k for _, k in HEADINGS]


LABELS = [
    ("figure", "51", "Figure 1 .", "", "Figure 1"), ("figure", "1", "Fig. 1", "", "Figure 1"), ("figure", None, "Figure.", "", "Figure ure"),
    ("table", None, "Table:", "", "Table le"), ("table", "x", "", "", None), ("table", None, "Caption", "", "Table"),
]


def test_labels(spark):
    for kind, raw, head, caption, want in LABELS:
        cols = [F.lit(x).cast("string") for x in (raw, head, caption)]
        assert spark.range(1).select(text.media_label(kind, *cols)).first()[0] == want


def test_merge_and_dedup(spark):
    items = spark.createDataFrame(
        [(1, 0, "T", "Cap", None, None, "tei"), (1, 1, None, "cap", "p.png", "1,2", "detector-table"), (1, 2, None, None, None, None, None), (1, 3, None, None, None, None, None)],
        "doc_id int, ord int, label string, caption string, path string, coords string, source string",
    )
    got = sorted(media.merge_tables(items).collect(), key=lambda r: r["ord"])
    assert got[0]["source"] == "detector-table+tei" and got[0]["path"] == "p.png" and got[0]["coords"] == "1,2" and len(got) == 3
    papers = spark.createDataFrame([("a", "D", "t"), ("b", " d", "u"), ("c", None, "t"), ("d", "", "T "), ("e", None, None), ("f", None, "")], "path string, doi string, title string")
    assert sorted(r["path"] for r in corpus.dedup_papers(papers).collect()) == ["a", "c", "e", "f"]


def test_abstract_needs_thirty_characters(spark):
    papers = spark.createDataFrame([(1, "d1", "t", "short"), (2, "d2", "t2", "x" * 30), (3, "d3", "t3", "")], "id int, doi string, title string, abstract string").withColumn("journal", F.lit(None).cast("string"))
    look = "doi string, title string, abstract string, journal string"
    by_doi = spark.createDataFrame([("d1", "T", "y" * 29, "J"), ("d3", "T", "<p>" + "z" * 30 + "</p>", "J")], look)
    pubmed = spark.createDataFrame([("d1", "p" * 31)], "doi string, abstract string")
    got = {r["id"]: (r["abstract"], r["journal"]) for r in enrich.ensure_abstract(papers, by_doi, by_doi.limit(0), pubmed).collect()}
    assert got == {1: ("p" * 31, None), 2: ("x" * 30, None), 3: ("z" * 30, "J")}


def test_scores_of_missing_abstract(spark):
    none = F.lit(None).cast("string")
    got = spark.range(1).select(validate.abstract_points(F.lit(True), none, F.lit("a"), F.lit("b"), F.lit(0), F.lit(9)), validate.abstract_points(F.lit(False), none, none, none, F.lit(0), F.lit(0))).first()
    assert tuple(got) == (5.0, 20.0)


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde", 0.75), ("", "", 1.0), (None, "x", 0.0), ("same text", "same text", 1.0), ("ab", "ba", 0.5)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["r"] for r in rows.select("i", validate.sequence_ratio("a", "b").alias("r")).collect()}
    assert [got[i] for i in range(len(pairs))] == [want for *_, want in pairs]


def test_empty_corpus_passes_all_gates(spark):
    flags = "has_title boolean, has_doi_or_journal boolean, has_abstract boolean, n_sections int, figures_count int, tables_count int, images_existing long, "
    m = spark.createDataFrame([], flags + "heads_total long, mapped_heads long, unmapped_heads long, noncontent_heads long, noise double")
    assert corpus.with_gates(corpus.summary(m)).first()["gates_pass"]


def test_records_round_trip(spark, tmp_path, nodes):
    papers = extract.papers(nodes).drop("doc_id")
    records.write_jsonl(papers, str(tmp_path / "out"))
    again = spark.read.schema(records.PAPER).json(str(tmp_path / "out"))
    assert again.first()["meta"]["title"] == "Sample Title"


def test_stream_drops_repeats(spark, tmp_path):
    from quirelake.streaming import papers as streamed

    rows = [{"meta": {"source_path": p, "doi": d}} for p, d in (("a", "D1"), ("b", "d1 "), ("c", "d2"))]
    (tmp_path / "in").mkdir()
    import json

    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    stream = streamed.paper_stream(spark, str(tmp_path / "in")).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    q = streamed.first_by_key(stream, "at").select("dedup_key").writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("kept").collect()) == ["d1", "d2"]

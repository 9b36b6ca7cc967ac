"""Documents one at a time: no document meets another, and both forms of a document give the same."""

import pytest
from pyspark.sql import functions as F
from test_operators import HEADINGS, LABELS, TEI
from test_process import BROKEN

from quirelake.functions import headings, text
from quirelake.operators import extract, process
from quirelake.plans import registry
from quirelake.sources import tei as xml

SF = "/root/testdata/sf0.001"
#: Nested texts, divisions, authors and addresses, breaks without number, zones with and without numbers, blank and repeated parts.
ODD = """<TEI xmlns:x="y"><teiHeader><titleStmt><title> </title></titleStmt><sourceDesc><biblStruct><analytic>
<author><persName> A  B </persName><affiliation><address><orgName>One</orgName><country>ONE</country><label>no</label></address>two</affiliation><affiliation>one</affiliation></author>
<author/><author><affiliation> </affiliation><persName>C</persName></author><author><affiliation>Two <b>three</b></affiliation></author></analytic><monogr><title>J</title></monogr></biblStruct></sourceDesc>
<profileDesc><abstract/><textClass><keywords><term/></keywords></textClass></profileDesc></teiHeader>
<facsimile><surface n="x"><zone xml:id="z" ulx="1" uly="1" lrx="2" lry="2"/></surface><surface n=" 2 "><zone xml:id="z" ulx="5" uly="1" lrx="2" lry="3"/><zone xml:id="q" ulx="?"/></surface></facsimile>
<text><front><p>Table 8: of the front.</p></front><body><div><pb n=" 7 "/><head/><head>2.1 Methods</head><p>lost</p></div><div><head>2.1 Methods</head><div><p>in <p>deep</p></p><ab>ab</ab></div></div>
<div><head>Table of things</head><p>x</p></div><div><head>Abstract</head><p>Own.</p></div><div><head>Own way</head><p>1</p></div><div><head>Own  way</head><p>2</p></div><pb/>
<figure facs="#z"><figDesc>see FIG.4</figDesc><label>3</label></figure><figure type=" Table "><label>٣</label></figure><figure><graphic coords="1,2"/></figure><figure><head>Fig 5</head><graphic/><graphic coords="1,2,3,4,5"/></figure>
<pb n="9"/><figure><head>Fig 6</head><graphic coords="1;2 3,4"/></figure><table facs="#q"><head>Table A.</head></table><p>See table  <ref type="table">A</ref>. or <ref type="table">B(1)</ref>: here <ref type="table"/>.</p>
<text><figure><head>Fig 7</head></figure></text></body><back><listBibl><biblStruct/><biblStruct><monogr><title/><title>T</title><idno type="DOI">d</idno></monogr><analytic><author>P</author><author/></analytic></biblStruct></listBibl></back></text></TEI>"""
EMPTY = "<TEI/>"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(1, TEI), (2, ODD), (3, EMPTY), (4, BROKEN), (5, None), (6, TEI)], "doc_id long, xml string")


PARTS = {
    "titles": extract.titles, "dois": extract.dois, "journals": extract.journals, "metadata": extract.metadata, "authors": extract.authors, "heads": extract.heads, "body_sections": extract.body_sections,
    "keywords": extract.keywords, "abstracts": extract.abstracts, "pages": extract.pages, "media": extract.media, "references": extract.references, "papers": extract.papers,
}


@pytest.mark.parametrize("name", PARTS)
def test_documents_and_their_nodes_give_the_same(documents, name):
    nodes = xml.nodes(xml.parse_tei(documents)).repartition(3, "pre")
    found = [sorted(map(str, PARTS[name](source).collect())) for source in (documents, nodes)]
    assert found[0] == found[1] and found[0]
    if name == "abstracts":
        assert found[0] == sorted(map(str, extract.abstracts(nodes, extract.body_sections(nodes)).collect()))


def test_odd_document(documents):
    odd = documents.where("doc_id = 2")
    assert [tuple(r)[1:] for r in extract.authors(odd).collect()] == [(1, "A B", "One"), (2, "C", None), (3, None, "Two three")]
    assert [tuple(r)[1:] for r in extract.metadata(odd).collect()] == [(None, None, "J")]
    assert [(r["head"], r["key"], r["text"]) for r in extract.body_sections(odd).collect()] == [
        ("2.1 Methods", "materials_and_methods", "in deep deep ab"), ("Abstract", "abstract", "Own."), ("Own way", "own_way", "1\n\n2"),
    ]
    assert [(r["kind"], r["label"], r["caption"], r["source"], r["coords"]) for r in extract.media(odd).collect()] == [
        ("figure", "Figure 3", "see FIG.4", "tei", "2,5.0,1.0,0.0,2.0"), ("table", "Table ٣", None, "tei", None), ("figure", "Figure 5", "Fig 5", "tei", None),
        ("figure", "Figure 6", "Fig 6", "tei", "9,1.0,2.0,3.0,4.0"), ("figure", "Figure 7", "Fig 7", "tei", None), ("table", "Table A", "Table A.", "tei", None),
        ("table", "Table B(1)", "See table A . or B(1) : here .", "tei-ref", None), ("table", "Table 8", "of the front.", "tei-text", None),
    ]
    assert [(r["index"], r["title"], r["doi"], r["authors"]) for r in extract.references(odd).collect()] == [(1, None, None, None), (2, None, "d", ["P"])]


def test_one_heading_and_label_as_columns_have_them(spark):
    more = ["IV.  Results", "3.1.2.- Aims", "– • C. x", "\x1f12 Population study", "ii.iv. Odd", "Funding", "1", "...", "İstanbul methods"]
    rows = spark.createDataFrame([(h,) for h in [h or "" for h, _ in HEADINGS] + more], "head string")
    assert [r for r in headings.classify(rows, "head").collect() if headings.key_of(r["head"]) != r["key"]] == []
    odd = [("figure", " 12 ", "", ""), ("figure", "1234", " ", ""), ("table", "", "x", "see tab. 3, Tab 4"), ("table", "٣", "", ""), ("figure", None, "Config 3", "fIgUre S2"), ("table", None, "Table", "Stable 3")]
    for kind, raw, head, caption in [x[:4] for x in LABELS] + odd:
        cols = [F.lit(x).cast("string") for x in (raw, head, caption)]
        assert spark.range(1).select(text.media_label(kind, *cols)).first()[0] == text.label_of(kind, raw, head, caption)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEI_QUERIES = [n for n in registry.queries() if n.startswith("tei_") and n != "tei_heads"] + ["nearest_page"]


@pytest.mark.parametrize("name", TEI_QUERIES)
def test_extraction_moves_and_keeps_nothing(spark, name):
    plan = plan_of(registry.queries()[name](spark, SF))
    assert "Exchange" not in plan and "InMemoryTableScan" not in plan and plan.count("MapInArrow") == 1


def test_headings_are_counted_where_they_are_found(spark):
    plan = plan_of(registry.queries()["tei_heads"](spark, SF))
    assert plan.count("Exchange hash") == 1 and "InMemoryTableScan" not in plan and "SortMergeJoin" not in plan


def test_processing_moves_no_record(spark):
    plan = plan_of(registry.queries()["process_papers"](spark, SF))
    assert "Exchange" not in plan and "Join" not in plan

"""Structured-document XML as a node table."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "doc_id long, pre int, end int, parent int, depth int, tag string, attrs map<string,string>, text string, error string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("pre", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string())]
    + [("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("error", pa.string())]
)
TEXT = "#text"
#: What a document that can't be parsed raises.
XML_ERRORS = (expat.ExpatError, ValueError)


def flatten_xml(xml: str | bytes):
    """[pre, end, parent, depth, tag, attrs, text] of each element and text chunk, in document order.

    ``end`` is the last ``pre`` inside the subtree.  Names lose their prefix;
    document type declarations are refused, so no entity can expand.
    """
    out: list[list] = []
    open_: list[int] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True
    local = lambda name: name if name.startswith("xml:") else name.rpartition(":")[2]

    def start(name, attrs):
        out.append([len(out), 0, open_[-1] if open_ else -1, len(open_), local(name), [(local(k), v) for k, v in attrs.items()], None])
        open_.append(len(out) - 1)

    def end(_):
        out[open_.pop()][1] = len(out) - 1

    def chars(data):
        out.append([len(out), len(out), open_[-1], len(open_), TEXT, None, data])

    def refuse(*_):
        raise ValueError("document type declarations are not accepted")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.StartDoctypeDeclHandler = refuse
    parser.Parse(xml, True)
    return out


def _flatten(batches):
    for batch in batches:
        held: list[tuple] = []
        for doc, xml in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            try:
                if xml is None:
                    raise ValueError("no document")
                held += [(doc, *row, None) for row in flatten_xml(xml)]
            except XML_ERRORS as why:
                held.append((doc, -1, -1, -1, -1, None, None, None, str(why)))
            if len(held) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


def parse_tei(tei: DataFrame, doc_id: str = "doc_id", xml: str = "xml") -> DataFrame:
    """The node table of all documents, with a row of its own (``error``) for each that can't be parsed."""
    return tei.select(F.col(doc_id).cast("long"), F.col(xml)).mapInArrow(_flatten, NODES)


def nodes(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").drop("error")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("doc_id", "error")


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """(stem, path, xml) of the ``*.tei.xml`` files below ``path``, in any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tei.xml").load(path)
    return files.select(
        F.regexp_extract("path", "([^/]+)\\.tei\\.xml$", 1).alias("stem"), "path", F.decode("content", "UTF-8").alias("xml")
    )


def read_pdf_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of PDF files, suffix in any case, sorted by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.lower("path").endswith(".pdf")).orderBy("path")

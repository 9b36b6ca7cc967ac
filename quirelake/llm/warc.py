"""WARC archives: writing with revisits, reading back, and transaction assembly."""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import own_folder, text_of, written

#: A record ends with two line ends; the text writer puts them after each row.
END = "\r\n\r\n"
#: Captures of one archive file, three records each.
CAPTURES = 1000
#: Smaller payloads are never revisits.
LEAST_BYTES = 1000

RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, date string, payload_digest string, "
    "refers_to string, refers_to_uri string, fields map<string,string>, first_line string, payload_bytes long, payload_sha1 string"
)


def _header(kind: Column | str, record_id: Column, uri: Column, date: Column, content: str | Column, block: Column, extra: list) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), as_col(kind), F.lit("\r\nWARC-Record-ID: "), record_id]
    for part in extra:
        lines.append(part)
    lines += [
        F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Date: "), date, F.lit("\r\nContent-Type: "), as_col(content),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    ]
    return F.concat(*lines)


def _urn(digest: Column) -> Column:
    cut = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _uri_of(page_id: str, url: str) -> Column:
    named = F.coalesce(F.col(url), F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit(""))))
    return F.regexp_replace(named, "[\\x00-\\x20\\x7f]", "%20")


def winners(pages: DataFrame, page_id: str, payload: Column, uri: Column) -> DataFrame:
    """(_digest, _winner, _sole, _first_uri): the largest id of each group of equal payloads that has revisits, whether one row alone has it, and its address."""
    small = pages.select(F.col(page_id).alias("p"), F.sha1(F.encode(payload, "UTF-8")).alias("_digest"), F.octet_length(payload).alias("b"), uri.alias("u"))
    counted = small.where((F.col("b") >= LEAST_BYTES)).groupBy("_digest", "p").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"))
    return (
        counted.groupBy("_digest")
        .agg(F.max(F.when(F.col("p").isNotNull(), F.struct("p", "n", "u"))).alias("w"), F.sum("n").alias("n"))
        .where("n > 1 and w is not null")
        .select("_digest", F.col("w.p").alias("_winner"), (F.col("w.n") == 1).alias("_sole"), F.col("w.u").alias("_first_uri"))
    )


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None, compression: str = "gzip"
) -> str:
    """Writes a request, a response (or revisit) and a metadata record for each row; returns ``path``.

    Of rows with equal payloads of at least LEAST_BYTES that with the largest
    id is the response, the others are revisits of it; a null id is never the
    largest.  A revisit names its response by WARC-Refers-To (unless several
    equal rows are that response), target URI and date.  Records of one
    capture are linked by WARC-Concurrent-To.  Files are
    plain text output (whole-file gzip by default) of CAPTURES captures, so
    that each can be read by one task, and go through Spark's writer to any
    store.  Null payloads are empty; null urls become ``urn:page:<id>``;
    control characters and blanks in urls are escaped; repeated rows are
    captures of their own; an empty table leaves an archive without records.
    """
    payload = text_of(html)
    dup = written(winners(pages, page_id, payload, _uri_of(page_id, url)), "winners")
    rows = pages.select(
        F.col(page_id).cast("string").alias("_id"),
        F.col(page_id).alias("_page"),
        _uri_of(page_id, url).alias("_uri"),
        payload.alias("_payload"),
        F.sha1(F.encode(payload, "UTF-8")).alias("_digest"),
        F.regexp_replace(F.expr("uuid()"), "-", "").alias("_key"),
    )
    rows = rows.join(dup, "_digest", "left").withColumn(
        "_old", F.col("_winner").isNotNull() & (F.octet_length("_payload") >= LEAST_BYTES) & ~F.col("_page").eqNullSafe(F.col("_winner"))
    )
    stamp = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # the one response that revisits refer to has an id that follows from its payload and page
    first = _urn(F.md5(F.concat(F.col("_digest"), F.lit(" "), F.col("_winner").cast("string"))))
    is_first = F.coalesce(F.col("_sole") & ~F.col("_old"), F.lit(False))
    own = {k: _urn(F.md5(F.concat(F.col("_key"), F.lit(k)))) for k in ("response", "request", "metadata")}
    own["response"] = F.when(is_first, first).otherwise(own["response"])
    status = F.when(F.col("_old"), "HTTP/1.1 304 Not Modified\r\n").otherwise("HTTP/1.1 200 OK\r\n")
    http = F.concat(
        status,
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("_payload").cast("string"),
        F.lit("\r\n\r\n"),
        F.when(F.col("_old"), "").otherwise(F.col("_payload")),
    )
    digest = [F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest")]
    revisit = F.when(
        F.col("_old"),
        F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To-Date: "),
            stamp,
            F.lit("\r\nWARC-Refers-To-Target-URI: "),
            F.col("_first_uri"),
            F.when(F.col("_sole"), F.concat(F.lit("\r\nWARC-Refers-To: "), first)).otherwise(""),
        ),
    ).otherwise("")
    response = _header(
        F.when(F.col("_old"), "revisit").otherwise("response"), own["response"], F.col("_uri"), stamp, "application/http; msgtype=response", http, [*digest, revisit]
    )
    concurrent = [F.lit("\r\nWARC-Concurrent-To: "), own["response"]]
    host = F.regexp_extract("_uri", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract("_uri", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    request = _header("request", own["request"], F.col("_uri"), stamp, "application/http; msgtype=request", asked, concurrent)
    fields = F.concat(
        F.lit("payload-length: "),
        F.octet_length("_payload").cast("string"),
        F.coalesce(F.concat(F.lit("\r\npage-id: "), F.col("_id")), F.lit("")),
        F.when(F.col("_old"), F.concat(F.lit("\r\nrefers-to-page-id: "), F.col("_winner").cast("string"))).otherwise(""),
        F.lit("\r\n"),
    )
    metadata = _header("metadata", own["metadata"], F.col("_uri"), stamp, "application/warc-fields", fields, concurrent)
    records = rows.select(F.explode(F.array(response, request, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", 3 * CAPTURES).option(
        "zlib.compress.level", "BEST_SPEED"
    ).text(path)
    return path


def parse(stream):
    """(headers, block) of each record of an open archive; headers have lower-case names, the values of a repeated one stand side by side."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        headers = {"": line.decode("utf-8", "replace").strip()}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            headers[name] = f"{headers[name]} {value.strip()}" if name in headers else value.strip()
        size = int(headers.get("content-length") or 0)
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get('warc-record-id')} ends after {len(block)} of {size} bytes")
        yield headers, block


def _rows(batches):
    schema = pa.schema(
        [(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "target_uri", "date", "payload_digest", "refers_to", "refers_to_uri")]
        + [("fields", pa.map_(pa.string(), pa.string())), ("first_line", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string())]
    )
    for batch in batches:
        for content in batch.column(0):
            data = content.as_buffer()
            raw = io.BytesIO(data)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if bytes(data[:2]) == b"\x1f\x8b" else raw
            held = []
            for h, block in parse(stream):
                kind, fields, first, size, sha1 = h.get("warc-type"), None, None, None, None
                if kind == "metadata":
                    pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
                    fields = [(k.strip().lower(), v.strip()) for k, _, v in pairs]
                else:
                    head, _, body = block.partition(b"\r\n\r\n")
                    first = head.partition(b"\r\n")[0].decode("utf-8", "replace")
                    if kind == "response":
                        size, sha1 = len(body), hashlib.sha1(body).hexdigest()
                digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                held.append(
                    (h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), digest,
                     h.get("warc-refers-to"), h.get("warc-refers-to-target-uri"), fields, first, size, sha1)
                )
                if len(held) == 3000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record below ``path`` (plain or gzip), with what was computed from its payload.

    All files are read but those whose names begin with a dot or an underscore.
    A file is held by one task.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_rows, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request and metadata records joined by concurrent-to ids.

    A capture is a response or revisit record.  Missing requests or metadata
    are null; of several, that with the smallest record id is taken; a record
    may name several captures; records that belong to no capture are left out.
    """
    captures = records.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("id"),
        F.struct("record_id", "type", "target_uri", "date", "first_line", "payload_digest", "payload_bytes", "payload_sha1", "refers_to", "refers_to_uri").alias("capture"),
    )

    def beside(kind, *columns):
        rows = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        rows = rows.withColumn("id", F.explode(F.split("concurrent_to", " ")))
        return rows.groupBy("id").agg(F.min_by(F.struct("record_id", *columns), "record_id").alias(kind))

    return (
        captures.join(beside("request", "target_uri", "first_line"), "id", "left")
        .join(beside("metadata", "fields"), "id", "left")
        .select("capture", "request", "metadata")
    )


def captured(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes ``pages`` as an archive in the shared folder and gives its transactions, read back."""
    spark = pages.sparkSession
    path = write_warc(pages, f"{own_folder(spark)}/warc", page_id, url, html)
    return transactions(written(read_warc(spark, path), "records"))

"""JSON sources and the writers of records, reports and summaries."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = "struct<label string, caption string, path string, source string, coords string, pdf_bbox struct<page_index int, bbox array<double>>, csv_path string>"
REFERENCE = "struct<index int, text string, id string, title string, doi string, year string, authors array<string>>"
PAPER = (
    "meta struct<source_path string, title string, journal string, doi string, authors array<struct<name string, affiliation string>>, keywords array<string>>, "
    f"sections map<string,string>, other_sections map<string,string>, figures array<{MEDIA}>, tables array<{MEDIA}>, references array<{REFERENCE}>"
)
TRUTH = (
    "file_name string, metadata struct<title string, authors array<string>, journal string, doi string, year int, total_pages int>, "
    "abstract struct<present boolean, first_50_chars string, last_50_chars string, word_count int, char_count int>, "
    "sections map<string, struct<heading string, first_100_chars string, last_100_chars string, word_count int>>, "
    "figures array<struct<label string, caption string>>, tables array<struct<label string, caption string>>, "
    "structural_info struct<total_sections int, total_figures int, total_tables int, total_references int>"
)


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the folder that the cluster names in ``spark.checkpoint.dir``; in a local session, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quirelake-")
    return f"{named.rstrip('/')}/quirelake-records-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the scratch folder, read back: cuts the lineage and survives lost executors."""
    path = f"{scratch_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_papers(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """Paper records, one JSON object or list of objects a file; what isn't such an object is left out."""
    rows = spark.read.schema(PAPER).option("multiLine", True).option("pathGlobFilter", names).json(path)
    return rows.where("meta is not null")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Paper records, one a line."""
    return spark.read.schema(PAPER).json(path).where("meta is not null")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth maps, with the ``stem`` that their file is named for."""
    rows = spark.read.schema(TRUTH).option("multiLine", True).option("pathGlobFilter", "*_extraction_map.json").json(path)
    return rows.withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), "^(.*)_extraction_map\\.json$", 1))


def write_jsonl(papers: DataFrame, path: str) -> None:
    """One record a line; absent fields are left out."""
    papers.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def _at(spark: SparkSession, path: str):
    """The JVM's file system of a path, and its class of paths."""
    sc = spark.sparkContext
    named = sc._jvm.org.apache.hadoop.fs.Path
    return named(path).getFileSystem(sc._jsc.hadoopConfiguration()), named


def _mounted(spark: SparkSession, path: str) -> str | None:
    """A path of the nodes' own file system as Python opens it; None in any other store."""
    fs, named = _at(spark, path)
    full = fs.makeQualified(named(path)).toUri()
    return full.getPath() if full.getScheme() == "file" else None


#: The list of a stem folder's files, by which it is read without listing it; Spark's readers pass over its name.
LISTED = "_stems"
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


class _StemFiles:
    """Writes (stem, json) rows, each as a file in its own folder, and returns the files' names below the path."""

    def __init__(self, path: str, stem: str):
        self.path, self.stem = path, stem

    def __call__(self, batches):
        for batch in batches:
            names = []
            for i in range(batch.num_rows):
                stem, line = (c[i].as_py() for c in batch.columns)
                folder = f"{self.stem}=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", stem) if stem else "__HIVE_DEFAULT_PARTITION__")
                os.makedirs(f"{self.path}/{folder}", exist_ok=True)
                # whole or not at all, also where a task runs again
                begun = f"{self.path}/{folder}/.{uuid.uuid4().hex}"
                with open(begun, "w", encoding="utf-8", newline="") as out:
                    out.write(line + "\n")
                os.replace(begun, f"{self.path}/{folder}/part-00000.json")
                names.append(f"{folder}/part-00000.json")
            yield pa.RecordBatch.from_pydict({"value": names}, schema=pa.schema([("value", pa.string())]))


class _Contents:
    """The contents of files, named below a path."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for k in range(0, len(names), 256):
                held = []
                for name in names[k : k + 256]:
                    with open(f"{self.path}/{name}", encoding="utf-8", newline="") as file:
                        held.append(file.read())
                yield pa.RecordBatch.from_pydict({"value": held}, schema=pa.schema([("value", pa.string())]))


def write_json_by_stem(papers: DataFrame, path: str, stem: str = "stem") -> None:
    """A folder per stem; of records with one stem the last by source path stays.

    On a file system that the nodes mount, the tasks write the files themselves
    and list them: Spark's writer and its commit take milliseconds a folder,
    and its readers hold every file's name in the driver.
    """
    last = papers.groupBy(stem).agg(F.max_by(F.struct(*[c for c in papers.columns if c != stem]), F.col("meta.source_path")).alias("r"))
    local = _mounted(papers.sparkSession, path)
    if local is None:
        last.select(stem, "r.*").write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(stem).json(path)
        return
    fs, named = _at(papers.sparkSession, path)
    fs.delete(named(path), True)
    files = last.select(F.col(stem).cast("string"), F.to_json("r").alias("j")).mapInArrow(_StemFiles(local, stem), "value string")
    files.write.text(f"{path}/{LISTED}")


def read_json_by_stem(spark: SparkSession, path: str) -> DataFrame:
    """The records that ``write_json_by_stem`` wrote, or those in a folder's subfolders, one a line."""
    local = _mounted(spark, path)
    fs, named = _at(spark, path)
    if local is None or not fs.exists(named(f"{path}/{LISTED}/_SUCCESS")):
        return spark.read.schema(PAPER).option("recursiveFileLookup", True).json(path).where("meta is not null")
    names = spark.read.text(f"{path}/{LISTED}").repartition(4 * spark.sparkContext.defaultParallelism)
    return _of_lines(names.mapInArrow(_Contents(local), "value string"))


def _of_lines(lines: DataFrame) -> DataFrame:
    """Paper records of a table of JSON objects (value)."""
    return lines.select(F.from_json("value", PAPER).alias("r")).select("r.*").where("meta is not null")


def write_json_array(papers: DataFrame, path: str) -> None:
    """All records as one JSON list in one file, ordered by source path, a record a line.

    Tasks sort and write the parts; only their bytes are then put together, as the form demands.
    """
    spark = papers.sparkSession
    rows = papers.select(F.to_json(F.struct(*papers.columns)).alias("j"), F.col("meta.source_path").alias("p"))
    parts = scratch_folder(spark)
    rows.repartitionByRange("p", "j").sortWithinPartitions("p", "j").select(F.concat(F.lit(","), "j").alias("value")).write.text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (source, named), (target, _) = _at(spark, parts), _at(spark, path)
    target.delete(named(path), True)
    out = target.create(named(f"{path}/_begun"), True)
    begun = False
    try:
        found = [f.getPath() for f in source.listStatus(named(parts)) if f.getLen() and f.getPath().getName().startswith("part-")]
        for part in sorted(found, key=lambda p: p.getName()):
            written = source.open(part)
            try:
                if not begun:  # the list opens in place of the first comma
                    written.seek(1)
                    out.write(ord("["))
                    begun = True
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(written, out, conf, False)
            finally:
                written.close()
            source.delete(part, False)
        for c in "]\n" if begun else "[]\n":
            out.write(ord(c))
    finally:
        out.close()
    target.rename(named(f"{path}/_begun"), named(f"{path}/part-00000.json"))
    source.delete(named(parts), True)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """The records that ``write_json_array`` wrote: a line each, so that tasks share the file."""
    return _of_lines(spark.read.text(path).select(F.regexp_replace("value", "^[\\[,]", "").alias("value")).where("value not in (']', '')"))


def corpus_rows(metrics: DataFrame) -> DataFrame:
    """The 22 columns of the corpus table, from ``metrics.document_metrics``; nulls are empty, noise has four digits."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    flag = lambda key, name: F.col("coverage")[key].cast("int").alias(name)
    return metrics.select(
        "file", text("title"), text("doi"), text("journal"), "abstract_len", F.when(F.col("has_abstract"), "True").otherwise("False").alias("abstract_present"), "sections_count", "other_sections_count",
        flag("introduction", "intro"), flag("materials_and_methods", "methods"), flag("results", "results"), flag("discussion", "discussion"), flag("conclusions", "conclusions"),
        "figures_count", "tables_count", "images_with_paths", "images_existing", F.col("heads_total").alias("tei_heads_total"), F.col("mapped_heads").alias("tei_mapped"),
        F.col("unmapped_heads").alias("tei_unmapped"), F.col("noncontent_heads").alias("tei_noncontent"), fixed(F.col("noise")).alias("noise_ratio"),
    )


def write_corpus_reports(metrics: DataFrame, summary: DataFrame, frequencies: DataFrame, suggestions: DataFrame, path: str) -> None:
    """The four corpus reports below ``path``: summary (JSON), a row a document (CSV), unmapped headings and suggestions (text; JSON too).

    ``frequencies`` are (head, n, first_doc, first_ord), written in the order
    of falling n, then of first sight; ``suggestions`` are (head, key, n).
    """
    summary.write.mode("overwrite").json(f"{path}/corpus_quality_json")
    write_csv(corpus_rows(metrics), f"{path}/corpus_quality_csv")
    common = frequencies.orderBy(F.desc("n"), "first_doc", "first_ord")
    common.select(F.concat(F.col("n").cast("string"), F.lit("\t"), "head").alias("value")).write.mode("overwrite").text(f"{path}/unmapped_heads")
    ordered = suggestions.orderBy(F.desc("n"), "head")
    ordered.select(F.concat("head", F.lit(" -> "), "key").alias("value")).write.mode("overwrite").text(f"{path}/mapping_suggestions")
    suggestions.select("head", "key").write.mode("overwrite").json(f"{path}/mapping_suggestions_json")


def media_rows(papers: DataFrame, kind: str) -> DataFrame:
    """(pdf, label, caption, path, source[, csv_path]) of all figures or tables; nulls are empty."""
    columns = ["label", "caption", "path", "source"] + (["csv_path"] if kind == "tables" else [])
    rows = papers.select(F.col("meta.source_path").alias("pdf"), F.explode(kind).alias("m"))
    return rows.select(F.coalesce("pdf", F.lit("")).alias("pdf"), *[F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in columns])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def fixed(x: Column, digits: int = 4) -> Column:
    """``digits`` (7 at most) decimal places of the exact value of a double, ties to even, as printf has them.

    Most decimal fractions are no doubles: 0.00125 is a little more, so it
    rounds up; only such as 0.03125 are ties.  The product with a power of ten
    is rounded, so what it lost is computed too (as a sum of exact products).
    """
    scale = float(10**digits)
    size = F.when(F.abs(x) < 2.0**62, F.abs(x))
    whole = F.floor(size)
    part = size - whole.cast("double")
    product = part * scale
    # the part's upper 26 bits and the rest: their products are exact
    upper = part * (2.0**27 + 1) - (part * (2.0**27 + 1) - part)
    lost = (upper * scale - product) + (part - upper) * scale
    near = F.rint(product)
    off = product - near
    n = (near + F.when((off == 0.5) & (lost > 0), 1.0).when((off == -0.5) & (lost < 0), -1.0).otherwise(0.0)).cast("long")
    sign, carried = F.when(x < 0, "-").otherwise(""), (n == 10**digits).cast("long")
    shown = F.concat(sign, (whole + carried).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))
    return F.when(x.isNotNull(), F.coalesce(shown, F.format_string(f"%.{digits}f", x)))


def write_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    """A validation report: time, summary and detailed results in two tables."""
    summary.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.mode("overwrite").json(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/detailed_results")


def write_tei(tei: DataFrame, path: str) -> None:
    """TEI documents as text files, one folder per stem."""
    tei.select("stem", F.col("xml").alias("value")).write.mode("overwrite").partitionBy("stem").text(path)

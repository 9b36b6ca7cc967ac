"""Record files as a stream, through the transforms of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..sources.records import PAPER


def paper_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Paper records of JSON-lines files that arrive below ``path``."""
    return spark.readStream.schema(PAPER).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_by_key(stream: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """Drops papers whose DOI (title, without DOI) came within ``delay`` before; state older than that is let go."""
    key = F.coalesce(match_key(F.col("meta.doi")), match_key(F.col("meta.title")), F.col("meta.source_path"), F.expr("uuid()"))
    return stream.withColumn("dedup_key", key).withWatermark(at, delay).dropDuplicatesWithinWatermark(["dedup_key"])


def counts_by_window(stream: DataFrame, at: str, size: str = "10 minutes", delay: str = "1 hour", *by: str) -> DataFrame:
    """Tumbling counts; rows later than ``delay`` are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n"))

"""What several operators of this folder need: tables, the shared folder, written steps."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset,
    in a local session (as in tests), a temporary folder takes its place;
    elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quirelake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        named = spark.sparkContext.getCheckpointDir()
    return named


#: With it Spark deletes a query's shuffle files as the query ends, not when the driver next collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the steps that pipeline stages wrote and that still stand; whether new ones are added.
_noted: list[str] = []
_noting = False


def _removed(process: int, jvm, conf, path: str) -> None:
    if os.getpid() != process:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may be gone: what is left is a folder of steps
        return


def own_folder(spark: SparkSession) -> str:
    """A new name in the shared folder; what is put there goes when the driver's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quirelake-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    atexit.register(_removed, os.getpid(), sc._jvm, sc._jsc.hadoopConfiguration(), path)
    if _noting:
        _noted.append(path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    _removed(os.getpid(), sc._jvm, sc._jsc.hadoopConfiguration(), path)


def dropped(*steps: DataFrame) -> None:
    """Deletes written steps whose readers are all written by now."""
    for step in steps:
        for folder in {os.path.dirname(os.path.dirname(file)) for file in step.inputFiles()}:
            _drop(step.sparkSession, folder)


#: Seconds from one return of native memory to the next while steps are written.
TRIMMED_EVERY = 5.0
_trimmed = 0.0


def trimmed(spark: SparkSession) -> bool:
    """Gives native memory that the driver's JVM has freed back to the system; whether the JVM knows how to.

    The allocator keeps what was freed, thread by thread, so a driver that
    plans and compiles hundreds of queries grows by it.  py4j doesn't reach the
    server's own class, which no module exports, hence its interface's method.
    """
    global _trimmed
    _trimmed = time.monotonic()
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    try:
        kinds = new_array(jvm.java.lang.Class, 4)
        for n, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[n] = named(kind)
        given = new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Exception:  # noqa: BLE001  other JVMs and systems lack it: their memory is as it was
        return False
    return True


@contextmanager
def stage(docs: DataFrame, last: bool = False):
    """Begins a pipeline stage: deletes the steps of the stages before it, but for those that ``docs`` still reads, and returns freed memory.

    Steps written inside are noted for the next stage, except those of the last
    one, whose result nobody may have written yet.
    """
    global _noting
    read = {folder_name(file) for file in docs.inputFiles()} if _noted else set()
    for path in [p for p in _noted if folder_name(p) not in read]:
        _drop(docs.sparkSession, path)
        _noted.remove(path)
    trimmed(docs.sparkSession)
    _noting = not last
    try:
        yield
    finally:
        _noting = False


def folder_name(path: str) -> str:
    """The name of the step's own folder in a path: ``quirelake-`` and digits; empty if it has none."""
    return next((part for part in reversed(path.split("/")) if part.startswith("quirelake-") and len(part) == 42), "")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = f"{own_folder(df.sparkSession)}/{name}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)
    if time.monotonic() - _trimmed >= TRIMMED_EVERY:
        trimmed(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many more underscores as it takes to clash with no column of ``df``."""
    used, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def text_of(column: str | Column) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))

"""The folder that the driver and all executors share, and the tables staged there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is not set, a temporary folder if driver and executors are one
    process (master local[..]), removed at exit; on a cluster an error, since executors don't see such a folder."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidewin-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def stage(df: DataFrame, label: str, codec: str = "uncompressed") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later plans start from the files,
    so a lost executor costs a re-read and not the work above. Tables of ids and counts gain little from a
    codec, whose native buffers add up over many small files; pass one for texts. What is not discarded goes
    when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Rows in an Arrow batch between the JVM and a Python worker.
ARROW_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ARROW_BYTES, where the session says nothing else: at Spark's 64 MB each running task takes
    that several times over outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, ARROW_BYTES)

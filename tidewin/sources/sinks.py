"""Sinks: tables that appear whole or not at all, run folders used once, checkpoints and manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import pending


def write_table(rows: DataFrame, path: str) -> None:
    """Parquet under a new path; the commit makes all files visible together, and an existing path is an error."""
    rows.write.mode("errorifexists").parquet(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One JSON document with sorted keys, through Spark's file systems."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def run_folder(root: str, run_id: str) -> str:
    """The folder of a run. The id must be one path component; `claim` makes it the caller's alone."""
    if not run_id or run_id in (".", "..") or "/" in run_id or "\\" in run_id:
        raise ValueError("a run id must be one path component")
    return f"{root.rstrip('/')}/{run_id}"


def claim(spark: SparkSession, folder: str) -> str:
    """The folder, which this call alone has taken: its marker is created exclusively, so a second run with the same
    id fails before it writes anything."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_claimed")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(marker):
        raise FileExistsError(f"[PATH_ALREADY_EXISTS] another run has taken {folder}")
    return folder


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_missing(work: DataFrame, path: str, keys: list[str]) -> int:
    """Append the work that `path` does not hold yet, by keys; the number of rows written, counted as they are
    written, whatever others write. The work's plan runs once. Where the work is dear, take `unfinished` keys first and compute only those."""
    have = _stored(work.sparkSession, path)
    written = Observation()
    todo = work if have is None else pending(work, have, keys)
    todo.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return written.get["rows"]


def _checksums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key, and a hash that any changed, lost or added row changes."""
    values = sorted(c for c in rows.columns if c not in keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*values).cast("decimal(38,0)")).cast("string").alias("checksum"))


def checkpointed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The stored rows, with keys as text; None if there are none."""
    rows = _stored(spark, path)
    return rows if rows is None else rows.withColumns({k: F.col(k).cast("string") for k in keys})


def unfinished(items: DataFrame, path: str, keys: list[str], identity: str = "identity") -> DataFrame:
    """The items (keys, identity) without a valid checkpoint below `path`: a marker of the same identity whose rows
    are stored whole. Only keys are joined, so finished items cost no work before they are left out."""
    spark = items.sparkSession
    marks, rows = _stored(spark, f"{path}/_done"), checkpointed(spark, path, keys)
    if marks is None or rows is None:
        return items
    last = marks.groupBy(*keys).agg(F.max(F.struct("at", identity, "rows", "checksum")).alias("m")).select(*keys, "m.*")
    valid = last.join(_checksums(rows, keys), [*keys, "rows", "checksum"])
    return items.join(valid.select(*keys, identity), [*keys, identity], "left_anti")


def checkpoint(work: DataFrame, items: DataFrame, path: str, keys: list[str], identity: str = "identity") -> int:
    """Store the work of these items, each key's rows in a folder of its own that is replaced whole, and then a marker
    with their number, hash and identity; the number of rows. What a run that stops between the two leaves has no
    marker, and is replaced when the items are done again."""
    spark = work.sparkSession
    work.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    stored = checkpointed(spark, path, keys).join(items.select(*keys), keys, "left_semi")
    marks = _checksums(stored, keys).join(items, keys).withColumn("at", F.current_timestamp())
    marks.write.mode("append").parquet(f"{path}/_done")
    return stored.count()


def markdown_lines(rows: DataFrame, order: list[str], most: int = 1000, digits: int = 4) -> DataFrame:
    """line (from 0) and text: a report's table as Markdown, in this order; more than `most` rows is an error, as reports
    are small. Cells are formatted where the rows are."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double"))) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit(""))
    text = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    nth = F.row_number().over(Window.orderBy(*order)) + 1  # of at most most + 1 rows
    fault = F.raise_error(F.lit(f"a report must not exceed {most} rows"))
    found = rows.orderBy(*order).limit(most + 1).select(nth.alias("line"), text([cell(c) for c in rows.columns]).alias("text"))
    body = found.select(F.when(F.col("line") <= most + 1, F.col("line")).otherwise(fault).alias("line"), "text")
    head = rows.sparkSession.range(2).select(F.col("id").cast("int").alias("line"), F.when(F.col("id") == 0, text([F.lit(c) for c in rows.columns])).otherwise(text([F.lit("---")] * len(rows.columns))).alias("text"))
    return head.unionByName(body)


def markdown(rows: DataFrame, most: int = 1000, digits: int = 4) -> str:
    """The lines of a small table as one text, in the order of its columns."""
    found = markdown_lines(rows, rows.columns, most, digits).collect()
    return "\n".join(r.text for r in sorted(found, key=lambda r: r.line))


def unpaired(rows: DataFrame) -> DataFrame:
    """Rows with label 1, as they are (the archived copy filter)."""
    return rows.where(F.col("label") == 1)

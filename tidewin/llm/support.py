"""Shared plumbing of the training-data operators: staged tables, sizes, Arrow byte access."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches, file_system, shared_dir, stage  # noqa: F401

T = TypeVar("T")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucketed(df: DataFrame, label: str, key: str, codec: str = "zstd") -> DataFrame:
    """As `stage`, dealt into buckets by a key whose rows are few and large: a later join or cogroup by that key shuffles
    only its other side. It must be dropped by `unbucket`."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    df.write.bucketBy(shuffle_width(spark), key).option("compression", codec).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._staged, out._named = path, name
    return out


def unbucket(df: DataFrame) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._named}")
    discard(df)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no plan reads any more."""
    for df in tables:
        fs, at = file_system(df.sparkSession, df._staged)
        fs.delete(at, True)


#: Rows of a few longs that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count finds at most BROADCAST_ROWS rows of ids in it; joins are the same either way."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def to_tasks(spark: SparkSession, value: T) -> Callable[[], T]:
    """A function that gives tasks a value of a bounded size. Spark broadcasts it as bytes in which this package's
    classes travel by value, so executors need no copy of the package."""
    held, here = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> T:
        if not here:
            here.append(pickle.loads(held.value))
        return here[0]

    return get


def in_turn(spark: SparkSession, value: T) -> Callable[[], T]:
    """As `to_tasks`, for one of many values that a task takes one after another: each call loads it from the broadcast's
    file again, so a task holds one at a time."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.load_from_path(held._path))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about `most` bytes (a longer text stands alone)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def with_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names: other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray], most: int = 4 << 20) -> DataFrame:
    """The rows, with all their columns, whose text `keep` marks; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, most):
                yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether a row is held out: the CRC of its id, as text, modulo the folds. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node.

    Each round sends every node to its smallest neighbour (twice), renames the edges' ends and drops
    the loops, so the graph shrinks at least by half. Nothing but row counts comes to the driver. New names
    are broadcast where they are few; beyond that a hub's edges are spread by the skew join.
    """
    e = stage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "cc-edges")
    labels = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    while not e.isEmpty():
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        above = low.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = stage(low.join(above, "up").select("node", F.col("top").alias("up")), "cc-parent")
        to = small(parent.select(F.col("node").alias("component"), F.col("up")))
        labels = labels.join(to, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        left, right = small(parent.select(F.col("node").alias("a"), F.col("up").alias("x"))), small(parent.select(F.col("node").alias("b"), F.col("up").alias("y")))
        e = e.join(left, "a").join(right, "b").where("x <> y")
        e = stage(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    return labels

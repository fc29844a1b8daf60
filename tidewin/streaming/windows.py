"""Windows, labels and events on streams of samples (an extension: the batch semantics, with late data bounded)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_counts(samples: DataFrame, by: list[str], ts: str, length: str, positive: Column, share: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows by event time: samples, positive samples, and a label by the share of positives."""
    rows = samples.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(*by, F.window("_t", length).alias("w")).agg(F.count(F.lit(1)).alias("samples"), F.count_if(positive).alias("positive"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples", "positive", (F.col("positive") / F.col("samples") >= share).cast("int").alias("label"))


def sessions(samples: DataFrame, by: list[str], ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of samples no more than the gap apart."""
    rows = samples.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(*by, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("samples"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples")


def run_once(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Process all input that is there into a table below the shared folder, and return it. Each batch writes a
    part of its own, so one that is run again replaces what it had written; in complete mode the last part holds all."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    table = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/table")
    if mode == "complete":
        last = table.agg(F.max("batch")).first()[0]
        table = table.where(F.col("batch") == last)
    return table.drop("batch")

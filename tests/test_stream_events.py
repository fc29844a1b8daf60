import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewin.operators import windows as W
from tidewin.streaming import events as V

BASE = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "patient string, file string, t timestamp, u timestamp, prediction int"


def row(patient, k, prediction, length=4):
    return (patient, "f", BASE + dt.timedelta(seconds=4 * k), BASE + dt.timedelta(seconds=4 * k + length), prediction)


@pytest.fixture
def store(spark):
    old = spark.conf.get(V.STATE_STORE[0])
    spark.conf.set(*V.STATE_STORE)
    yield
    spark.conf.set(V.STATE_STORE[0], old)


def run(spark, source, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    found = V.events(stream, ["patient", "file"], "t", "u", "60 seconds")
    query = found.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema("patient string, file string, start double, end double, windows long").parquet(f"{folder}/out").collect())


def wanted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).select("patient", "file", (F.unix_micros("t") / 1e6 - BASE.timestamp()).alias("start_sec"), (F.unix_micros("u") / 1e6 - BASE.timestamp()).alias("end_sec"), "prediction")
    return sorted((r.patient, r.file, r.start_sec + BASE.timestamp(), r.end_sec + BASE.timestamp(), r.windows) for r in W.islands(df).collect())


def test_unordered_batches_and_a_restart_give_the_batch_result(spark, store, tmp_path):
    rng = np.random.default_rng(1)
    rows = [row(p, k, int(x)) for p in ("a", "b") for k, x in enumerate(rng.random(60) < 0.7)]
    # Windows come up to ten places late, which the watermark's 60 seconds allow.
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2].timestamp() + float(rng.uniform(0, 40)), i))
    end = [row("z", 1000, 0)]  # moves the watermark past all of them
    for n, part in enumerate(np.array_split(order, 4)):
        if n == 2:  # the query has stopped here, and is started again from its checkpoint
            half = run(spark, tmp_path / "in", tmp_path / "q")
            assert 0 < len(half) < len(wanted(spark, rows))
        spark.createDataFrame([rows[i] for i in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path / "in", tmp_path / "q")
    assert got == wanted(spark, rows) and len(got) > 10
    # A window behind the watermark changes nothing.
    spark.createDataFrame([row("a", 3, 1), row("c", 5, 1), row("z", 2000, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path / "in", tmp_path / "q") == got

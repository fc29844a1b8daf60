"""The reference roles over the driver's tables: recordings, samples, windows, scores; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows as W

SIZE = 16
MODELS = ("alpha", "beta", "gamma")
SEEDS = (42, 43, 44)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """One sample per event: a user is a recording, in time order; patients are user_id modulo 5."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select((F.col("user_id") % 5).alias("patient"), F.col("user_id").alias("file"), (F.row_number().over(order) - 1).cast("long").alias("idx"), "value", "event_type")


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("patient"), F.col("user_id").alias("file")).agg(F.count(F.lit(1)).alias("n_samples")).withColumn("sfreq", F.lit(1.0))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Each run of neighbouring `error` and `purchase` events is an annotated interval."""
    s = samples(spark, sf).where("event_type in ('error', 'purchase')")
    run = F.col("idx") - F.row_number().over(Window.partitionBy("patient", "file").orderBy("idx"))
    runs = s.withColumn("run", run).groupBy("patient", "file", "run")
    return runs.agg(F.min("idx").cast("double").alias("start_sec"), (F.max("idx") + 1).cast("double").alias("end_sec")).drop("run")


def labelled(spark: SparkSession, sf: str, seconds: float = SIZE, threshold: float = 0.5) -> DataFrame:
    return W.labelled(W.tumbling(recordings(spark, sf), seconds, 1.0), intervals(spark, sf), float(seconds), threshold)


def window_values(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of complete windows with their window's start."""
    s, r = samples(spark, sf), recordings(spark, sf)
    s = s.join(r.drop("sfreq"), ["patient", "file"]).withColumn("start_sample", F.col("idx") - F.col("idx") % SIZE)
    return s.where(F.col("start_sample") + SIZE <= F.col("n_samples")).drop("n_samples")


def nearest(x: Column, digits: int) -> Column:
    """x rounded as SQL's doubles are: the nearest whole number of units, halves away from zero. Spark's own rounding goes by
    the double's decimal text, so it differs where a product's half lies beside the text's."""
    return F.round(x * 10.0**digits) / 10.0**digits


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every labelled document by 3 models and 3 seeds: arithmetic on ids and lengths."""
    d = read(spark, sf, "documents").select("doc_id", "n_chars", "source").join(read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("shift"), F.lit(s).alias("seed")) for i, m in enumerate(MODELS) for s in SEEDS]))
    rows = d.withColumn("g", grid).select("doc_id", F.substring("source", 4, 9).cast("int").alias("src"), "label", "g.model", "g.seed", "g.shift", "n_chars")
    wobble = F.pmod(F.col("doc_id") * 7919 + F.col("seed") * 104729 + F.col("shift") * 1299709, F.lit(1000)) / 1000.0
    # Six tenths of a length in whole numbers, as SQL's decimals have them: 0.6 has no exact double.
    score = F.col("n_chars") * 6 / 10.0 / (F.col("n_chars") + 1500.0) + 0.3 * wobble + 0.1 * F.col("label") * F.col("shift") / 2.0
    return rows.select("doc_id", (F.col("src") % 5).cast("int").alias("patient"), "label", "model", "seed", nearest(score, 6).alias("score")).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


#: The same as SQL, to be put after WITH.
SAMPLES_SQL = """samples AS (SELECT user_id % 5 AS patient, user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value, event_type FROM events),
recordings AS (SELECT user_id % 5 AS patient, user_id AS file, count(*) AS n_samples FROM events GROUP BY 1, 2),
marked AS (SELECT patient, file, idx, idx - row_number() OVER (PARTITION BY patient, file ORDER BY idx) AS run FROM samples WHERE event_type IN ('error', 'purchase')),
intervals AS (SELECT patient, file, min(idx)::DOUBLE AS start_sec, (max(idx) + 1)::DOUBLE AS end_sec FROM marked GROUP BY patient, file, run)"""


def labelled_sql(seconds: int = SIZE, threshold: float = 0.5, name: str = "labelled") -> str:
    return f"""{name}_w AS (SELECT patient, file, unnest(generate_series(0, n_samples - {seconds}, {seconds})) AS start_sample FROM recordings WHERE n_samples >= {seconds}),
{name}_t AS (SELECT patient, file, start_sample, start_sample + {seconds} AS end_sample, start_sample::DOUBLE AS start_sec, (start_sample + {seconds})::DOUBLE AS end_sec FROM {name}_w),
{name}_o AS (SELECT w.patient, w.file, w.start_sample, w.end_sample, w.start_sec, w.end_sec, coalesce(sum(CASE WHEN i.start_sec IS NOT NULL THEN least(w.end_sec, i.end_sec) - greatest(w.start_sec, i.start_sec) END), 0.0)::DOUBLE AS overlap_sec
 FROM {name}_t w LEFT JOIN intervals i ON w.patient = i.patient AND w.file = i.file AND w.start_sec < i.end_sec AND i.start_sec < w.end_sec GROUP BY ALL),
{name} AS (SELECT *, (overlap_sec / {seconds} >= {threshold})::INT AS label, (overlap_sec > 0 AND overlap_sec < {seconds}) AS mixed FROM {name}_o)"""


PREDICTIONS_SQL = """scored AS (SELECT d.doc_id, (substr(d.source, 4)::INT % 5)::INT AS patient, l.quality AS label, m.model, s.seed,
 round(0.6 * d.n_chars / (d.n_chars + 1500.0) + 0.3 * (((d.doc_id * 7919 + s.seed * 104729 + m.shift * 1299709) % 1000) / 1000.0) + 0.1 * l.quality * m.shift / 2.0, 6)::DOUBLE AS score
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('alpha', 0), ('beta', 1), ('gamma', 2)) m(model, shift), (VALUES (42), (43), (44)) s(seed)),
predictions AS (SELECT *, (score >= 0.5)::INT AS prediction FROM scored)"""

META = "patient, file, start_sec, end_sec, label"

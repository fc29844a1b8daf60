"""Queries on windows, labels, contexts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions import table
from ..operators import hysteresis
from ..operators import stats as T
from ..operators import windows as W
from . import base as B

S, D = SparkSession, DataFrame


def window_census(spark: S, sf: str) -> D:
    r = B.recordings(spark, sf).groupBy("patient").agg(F.sum(F.col("n_samples") % B.SIZE).alias("discarded_sec"))
    w = B.labelled(spark, sf).groupBy("patient").agg(F.count(F.lit(1)).alias("windows"), F.sum("label").alias("positive"), F.count_if("mixed").alias("mixed"), F.count_if(F.col("mixed") & (F.col("label") == 0)).alias("mixed_negative"))
    return w.join(r, "patient")


def window_label_index(spark: S, sf: str) -> D:
    return B.labelled(spark, sf).select("patient", "file", "start_sec", "end_sec", "label", "overlap_sec", "mixed")


def sliding_windows(spark: S, sf: str) -> D:
    r = B.recordings(spark, sf).withColumn("duration_sec", F.col("n_samples") / F.col("sfreq"))
    return W.sliding(r, 16.0, 0.5)


def duration_sweep(spark: S, sf: str) -> D:
    """Census at two grains, duration and duration by patient, for windows of 8, 16 and 32."""
    parts = [B.labelled(spark, sf, n).withColumn("duration_sec", F.lit(n)) for n in (8, 16, 32)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = rows.withColumn("mixed", F.col("mixed").cast("int"))
    sets = rows.groupingSets([["duration_sec"], ["duration_sec", "patient"]], "duration_sec", "patient")
    return sets.agg(F.count(F.lit(1)).alias("windows"), F.sum("label").alias("positive"), F.sum("mixed").alias("mixed"), F.grouping("patient").cast("int").alias("all_patients"))


def context_windows(spark: S, sf: str) -> D:
    w, r = B.labelled(spark, sf).select("patient", "file", "start_sec", "end_sec"), B.recordings(spark, sf)
    both = W.contexts(w, r, "centered", 12.0, 12.0, 1.0).unionByName(W.contexts(w, r, "trailing", 24.0, 0.0, 1.0))
    return both.drop("context_size")


def context_audit(spark: S, sf: str) -> D:
    """How far usable contexts, targets and what follows the target meet annotated intervals, by mode and label."""
    w, r, i = B.labelled(spark, sf).select("patient", "file", "start_sec", "end_sec", "label"), B.recordings(spark, sf), B.intervals(spark, sf)
    c = W.contexts(w, r, "centered", 12.0, 12.0, 1.0).unionByName(W.contexts(w, r, "trailing", 24.0, 0.0, 1.0)).where("context_reason = 'ok'")
    c = c.select("patient", "file", "start_sec", "end_sec", "label", "mode", F.col("context_start").cast("double").alias("c_start"), F.col("context_stop").cast("double").alias("c_stop"))
    c = W.overlap_seconds(c, i, 16.0, "context_overlap", "c_start", "c_stop")
    c = W.overlap_seconds(c, i, 16.0, "target_overlap")
    c = W.overlap_seconds(c, i, 16.0, "after_overlap", "end_sec", "c_stop")
    return c.groupBy("mode", "label").agg(F.count(F.lit(1)).alias("windows"), F.sum("context_overlap").alias("context_overlap"), F.sum("target_overlap").alias("target_overlap"), F.sum("after_overlap").alias("after_overlap"), F.count_if(F.col("after_overlap") > 0).alias("with_later"))


def contiguous_events(spark: S, sf: str) -> D:
    w = B.labelled(spark, sf, 8, 0.25).withColumnRenamed("label", "prediction")
    return W.islands(w)


def event_coverage(spark: S, sf: str) -> D:
    return W.event_coverage(B.intervals(spark, sf), B.labelled(spark, sf, 8, 0.25))


def event_coverage_summary(spark: S, sf: str) -> D:
    c = event_coverage(spark, sf).withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))
    summary = c.groupBy("duration_sec").agg(F.count(F.lit(1)).alias("intervals"), F.count_if("represented").alias("represented"), F.max("delay_sec").alias("delay_max"))
    return T.with_median(summary, c, ["duration_sec"], F.col("delay_sec"), "delay_median")


def interval_validity(spark: S, sf: str) -> D:
    """Faults among the intervals, with some shifted to leave the recording or overlap."""
    i = B.intervals(spark, sf)
    shifted = i.select("patient", "file", (F.col("start_sec") - 1.5).alias("start_sec"), F.when(F.col("file") % 7 == 0, F.col("start_sec") - 1.5).otherwise(F.col("end_sec") + 1.0).alias("end_sec"))
    return W.interval_faults(shifted, B.recordings(spark, sf))


def patient_zscore(spark: S, sf: str) -> D:
    s = B.samples(spark, sf).withColumn("same", F.lit(3.0))
    z = W.zscores(s, ["patient"], ["value", "same"])
    return z.select("file", "idx", F.round("value", 6).alias("z_value"), F.round("same", 6).alias("z_same"))


def first_windows(spark: S, sf: str) -> D:
    return W.first_rows(B.labelled(spark, sf).select("patient", "file", "start_sec", "label"), ["patient", "file"], ["start_sec"], 2)


def first_middle_last(spark: S, sf: str) -> D:
    return W.first_middle_last(B.labelled(spark, sf).select("patient", "file", "start_sec"), ["patient", "file"], ["start_sec"])


def quarter_picks(spark: S, sf: str) -> D:
    return W.at_fractions(B.labelled(spark, sf, 8).select("patient", "file", "start_sec"), ["patient", "file"], "start_sec", (0.25, 0.75))


def disjoint_contexts(spark: S, sf: str) -> D:
    """Trailing contexts near the quarter positions that avoid annotated intervals of three samples or more."""
    w = W.contexts(B.labelled(spark, sf, 8).select("patient", "file", "start_sec", "end_sec"), B.recordings(spark, sf), "trailing", 8.0, 0.0, 1.0).where("context_reason = 'ok'")
    c = w.select("patient", "file", "start_sec", "end_sec", F.col("context_start").cast("double").alias("context_start_sec"), F.col("context_stop").cast("double").alias("context_end_sec"))
    targets = W.at_fractions(c, ["patient", "file"], "start_sec", (0.25, 0.75)).select("patient", "file", "fraction", F.col("start_sec").alias("target_sec"))
    used = B.intervals(spark, sf).where("end_sec - start_sec >= 3")
    return W.nearest_disjoint(c, used, targets)


def hysteresis_crossings(spark: S, sf: str) -> D:
    """Crossings of the centred samples by recording, at least two samples apart."""
    s = B.samples(spark, sf)
    arrays = s.groupBy("patient", "file").agg(F.sort_array(F.collect_list(F.struct("idx", ((F.col("value") - 250.0) / 100.0).alias("v")))).alias("a"))
    return W.refractory_crossings(arrays.select("patient", "file", F.col("a.v").alias("samples")), ["patient", "file"], 0.5, 2)


def chunk_crossings(spark: S, sf: str) -> D:
    """The same crossings, one row each, of recordings in chunks of 16 samples."""
    s = B.samples(spark, sf).select("patient", "file", "idx", ((F.col("value") - 250.0) / 100.0).alias("v"), F.floor(F.col("idx") / 16).alias("chunk"))
    held = s.groupBy("patient", "file", "chunk").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("a"))
    chunks = held.select("patient", "file", (F.col("chunk") * 16).alias("first_sample"), F.col("a.v").alias("samples"))
    return hysteresis.chunk_crossings(chunks, ["patient", "file"], 0.5, 2)


def sql_gaps(spark: S, sf: str) -> D:
    """Gaps of two seconds or more between a recording's annotated starts, by SQL from a table function."""
    table.register(spark)
    held = B.intervals(spark, sf).groupBy("patient", "file").agg(F.collect_list("start_sec").alias("starts"))
    return spark.sql("SELECT h.patient, h.file, g.at, g.gap FROM {h} h, LATERAL gaps(h.starts, 2.0D) g", h=held)


def event_gaps(spark: S, sf: str) -> D:
    """Times between neighbouring annotated starts, with regularity (deviation over mean) by recording."""
    from ..operators.stats import regularity

    return regularity(B.intervals(spark, sf), ["patient", "file"], "start_sec", least=3, ddof=1, shortest=2.0)


def finite_windows(spark: S, sf: str) -> D:
    """Rows whose ratio is finite: infinite and missing ones drop out."""
    s = B.samples(spark, sf).withColumn("x", F.when(F.col("idx") % 3 == 0, F.lit(float("inf"))).when(F.col("idx") % 3 == 1, F.lit(None)).otherwise(F.col("value")))
    return s.where(finite("x")).groupBy("patient").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("x"), 6).alias("total"))


QUERIES = {f.__name__: f for f in (window_census, window_label_index, sliding_windows, duration_sweep, context_windows, context_audit, contiguous_events, event_coverage, event_coverage_summary, interval_validity, patient_zscore, first_windows, first_middle_last, quarter_picks, disjoint_contexts, hysteresis_crossings, chunk_crossings, sql_gaps, event_gaps, finite_windows)}

_L = f"WITH {B.SAMPLES_SQL},\n{B.labelled_sql()}"
_L8 = f"WITH {B.SAMPLES_SQL},\n{B.labelled_sql(8)}"
_E8 = f"WITH {B.SAMPLES_SQL},\n{B.labelled_sql(8, 0.25)}"
_CONTEXTS = """contexts AS (SELECT patient, file, start_sec, end_sec, label, m.mode, (start_sec - m.before)::BIGINT AS context_start, (end_sec + m.after)::BIGINT AS context_stop,
 CASE WHEN start_sec - m.before < 0 THEN 'recording_start' WHEN end_sec + m.after > n_samples THEN 'recording_end' ELSE 'ok' END AS context_reason
 FROM labelled JOIN recordings USING (patient, file), (VALUES ('centered', 12, 12), ('trailing', 24, 0)) m(mode, before, after))"""
_COVER = """coverage AS (SELECT i.patient, i.file, i.start_sec, i.end_sec, count(w.start_sec) > 0 AS represented, coalesce(sum(CASE WHEN w.start_sec IS NOT NULL THEN least(i.end_sec, w.end_sec) - greatest(i.start_sec, w.start_sec) END), 0.0)::DOUBLE AS covered_sec, min(w.end_sec) - i.start_sec AS delay_sec
 FROM intervals i LEFT JOIN labelled w ON i.patient = w.patient AND i.file = w.file AND w.label = 1 AND w.start_sec < i.end_sec AND i.start_sec < w.end_sec GROUP BY i.patient, i.file, i.start_sec, i.end_sec)"""


def _meet(a: str, b: str) -> str:
    return f"coalesce((SELECT sum(greatest(least({b}, i.end_sec) - greatest({a}, i.start_sec), 0)) FROM intervals i WHERE i.patient = c.patient AND i.file = c.file), 0.0)::DOUBLE"


ORACLES = {
    "window_census": f"{_L} SELECT patient, windows, positive, mixed, mixed_negative, discarded_sec FROM (SELECT patient, count(*) AS windows, sum(label)::BIGINT AS positive, count(*) FILTER (mixed) AS mixed, count(*) FILTER (mixed AND label = 0) AS mixed_negative FROM labelled GROUP BY patient) JOIN (SELECT patient, sum(n_samples % 16)::BIGINT AS discarded_sec FROM recordings GROUP BY patient) USING (patient)",
    "window_label_index": f"{_L} SELECT {B.META}, overlap_sec, mixed FROM labelled",
    "sliding_windows": f"WITH {B.SAMPLES_SQL} SELECT patient, file, (k * 8)::DOUBLE AS start_sec, (k * 8 + 16)::DOUBLE AS end_sec FROM (SELECT patient, file, unnest(generate_series(0, (n_samples - 16) // 8)) AS k FROM recordings WHERE n_samples >= 16)",
    "duration_sweep": f"WITH {B.SAMPLES_SQL},\n" + ",\n".join(B.labelled_sql(n, 0.5, f"l{n}") for n in (8, 16, 32)) + ", everything AS (" + " UNION ALL ".join(f"SELECT {n}::INT AS duration_sec, patient, label, mixed::INT AS mixed FROM l{n}" for n in (8, 16, 32)) + ") SELECT duration_sec, patient, count(*) AS windows, sum(label)::BIGINT AS positive, sum(mixed)::BIGINT AS mixed, 0::INT AS all_patients FROM everything GROUP BY duration_sec, patient UNION ALL SELECT duration_sec, NULL, count(*), sum(label)::BIGINT, sum(mixed)::BIGINT, 1::INT FROM everything GROUP BY duration_sec",
    "context_windows": f"{_L}, {_CONTEXTS} SELECT patient, file, start_sec, end_sec, mode, context_start, context_stop, context_reason FROM contexts",
    "context_audit": f"{_L}, {_CONTEXTS}, met AS (SELECT mode, label, {_meet('c.context_start', 'c.context_stop')} AS a, {_meet('c.start_sec', 'c.end_sec')} AS b, {_meet('c.end_sec', 'c.context_stop')} AS d FROM contexts c WHERE context_reason = 'ok') SELECT mode, label, count(*) AS windows, sum(a)::DOUBLE AS context_overlap, sum(b)::DOUBLE AS target_overlap, sum(d)::DOUBLE AS after_overlap, count(*) FILTER (d > 0) AS with_later FROM met GROUP BY mode, label",
    "contiguous_events": f"{_E8}, flagged AS (SELECT *, start_sec - row_number() OVER (PARTITION BY patient, file ORDER BY start_sec) * 8 AS run FROM labelled WHERE label = 1) SELECT patient, file, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS windows, count(*) >= 2 AS sustained FROM flagged GROUP BY patient, file, run",
    "event_coverage": f"{_E8}, {_COVER} SELECT * FROM coverage",
    "event_coverage_summary": f"{_E8}, {_COVER} SELECT end_sec - start_sec AS duration_sec, count(*) AS intervals, count(*) FILTER (represented) AS represented, median(delay_sec)::DOUBLE AS delay_median, max(delay_sec) AS delay_max FROM coverage GROUP BY 1",
    "interval_validity": f"WITH {B.SAMPLES_SQL}, shifted AS (SELECT patient, file, start_sec - 1.5 AS start_sec, CASE WHEN file % 7 = 0 THEN start_sec - 1.5 ELSE end_sec + 1.0 END AS end_sec FROM intervals), seen AS (SELECT *, lag(end_sec) OVER (PARTITION BY patient, file ORDER BY start_sec, end_sec) AS before FROM shifted) SELECT * FROM (SELECT patient, file, start_sec::DOUBLE AS start_sec, end_sec::DOUBLE AS end_sec, CASE WHEN start_sec < 0 THEN 'before_start' WHEN end_sec <= start_sec THEN 'empty' WHEN end_sec > n_samples THEN 'after_end' WHEN start_sec < before THEN 'overlapping' ELSE 'ok' END AS reason FROM seen JOIN recordings USING (patient, file)) WHERE reason <> 'ok'",
    "patient_zscore": f"WITH {B.SAMPLES_SQL} SELECT file, idx, round((value - avg(value) OVER p) / stddev_samp(value) OVER p, 6) AS z_value, 0.0::DOUBLE AS z_same FROM samples WINDOW p AS (PARTITION BY patient)",
    "first_windows": f"{_L} SELECT patient, file, start_sec, label FROM labelled WHERE start_sec < 32",
    "first_middle_last": f"{_L}, n AS (SELECT patient, file, start_sec, row_number() OVER (PARTITION BY patient, file ORDER BY start_sec) - 1 AS nth, count(*) OVER (PARTITION BY patient, file) AS n FROM labelled) SELECT patient, file, start_sec FROM n WHERE nth IN (0, n // 2, n - 1)",
    "quarter_picks": f"{_L8}, n AS (SELECT patient, file, start_sec, row_number() OVER (PARTITION BY patient, file ORDER BY start_sec) - 1 AS nth, count(*) OVER (PARTITION BY patient, file) AS n FROM labelled) SELECT patient, file, start_sec, fraction FROM n, (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) f(fraction) WHERE nth = CASE WHEN (n - 1) * fraction - floor((n - 1) * fraction) = 0.5 THEN 2 * round((n - 1) * fraction / 2) ELSE round((n - 1) * fraction) END",
    "sql_gaps": f"WITH {B.SAMPLES_SQL}, g AS (SELECT patient, file, start_sec AS at, lead(start_sec) OVER (PARTITION BY patient, file ORDER BY start_sec) - start_sec AS gap FROM intervals) SELECT * FROM g WHERE gap >= 2",
    "hysteresis_crossings": f"WITH RECURSIVE {B.SAMPLES_SQL}, side AS (SELECT patient, file, idx, CASE WHEN (value - 250.0) / 100.0 >= 0.5 THEN 1 WHEN (value - 250.0) / 100.0 <= -0.5 THEN -1 ELSE 0 END AS side FROM samples), walk AS (SELECT patient, file, idx, side AS state, -2 AS last, false AS flip FROM side WHERE idx = 0 UNION ALL SELECT s.patient, s.file, s.idx, CASE WHEN w.state = 0 OR s.side = -w.state AND s.idx - w.last >= 2 THEN s.side ELSE w.state END, CASE WHEN w.state <> 0 AND s.side = -w.state AND s.idx - w.last >= 2 THEN s.idx ELSE w.last END, w.state <> 0 AND s.side = -w.state AND s.idx - w.last >= 2 FROM walk w JOIN side s ON s.patient = w.patient AND s.file = w.file AND s.idx = w.idx + 1) SELECT patient, file, coalesce(list(idx::INT ORDER BY idx) FILTER (flip), []::INT[]) AS events FROM walk GROUP BY patient, file",
    "chunk_crossings": f"WITH RECURSIVE {B.SAMPLES_SQL}, side AS (SELECT patient, file, idx, CASE WHEN (value - 250.0) / 100.0 >= 0.5 THEN 1 WHEN (value - 250.0) / 100.0 <= -0.5 THEN -1 ELSE 0 END AS side FROM samples), walk AS (SELECT patient, file, idx, side AS state, -2 AS last, false AS flip FROM side WHERE idx = 0 UNION ALL SELECT s.patient, s.file, s.idx, CASE WHEN w.state = 0 OR s.side = -w.state AND s.idx - w.last >= 2 THEN s.side ELSE w.state END, CASE WHEN w.state <> 0 AND s.side = -w.state AND s.idx - w.last >= 2 THEN s.idx ELSE w.last END, w.state <> 0 AND s.side = -w.state AND s.idx - w.last >= 2 FROM walk w JOIN side s ON s.patient = w.patient AND s.file = w.file AND s.idx = w.idx + 1) SELECT patient, file, idx::BIGINT AS event FROM walk WHERE flip",
    "disjoint_contexts": f"{_L8}, c AS (SELECT patient, file, start_sec, end_sec, start_sec - 8 AS context_start_sec, end_sec AS context_end_sec FROM labelled JOIN recordings USING (patient, file) WHERE start_sec >= 8 AND end_sec <= n_samples), n AS (SELECT *, row_number() OVER (PARTITION BY patient, file ORDER BY start_sec) - 1 AS nth, count(*) OVER (PARTITION BY patient, file) AS n FROM c), t AS (SELECT patient, file, fraction, start_sec AS target_sec FROM n, (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) f(fraction) WHERE nth = CASE WHEN (n - 1) * fraction - floor((n - 1) * fraction) = 0.5 THEN 2 * round((n - 1) * fraction / 2) ELSE round((n - 1) * fraction) END), free AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE i.patient = c.patient AND i.file = c.file AND i.end_sec - i.start_sec >= 3 AND i.start_sec < c.context_end_sec AND c.context_start_sec < i.end_sec)), one AS (SELECT patient, file, fraction, abs(start_sec - target_sec) AS distance, start_sec, end_sec, context_start_sec, context_end_sec FROM free JOIN t USING (patient, file) WHERE fraction = 0.25 QUALIFY row_number() OVER (PARTITION BY patient, file ORDER BY abs(start_sec - target_sec), start_sec) = 1), two AS (SELECT f.patient, f.file, t.fraction, abs(f.start_sec - target_sec) AS distance, f.start_sec, f.end_sec, f.context_start_sec, f.context_end_sec FROM free f JOIN t ON f.patient = t.patient AND f.file = t.file AND t.fraction = 0.75 LEFT JOIN one o ON o.patient = f.patient AND o.file = f.file WHERE o.file IS NULL OR f.context_end_sec <= o.context_start_sec OR f.context_start_sec >= o.context_end_sec QUALIFY row_number() OVER (PARTITION BY f.patient, f.file ORDER BY abs(f.start_sec - target_sec), f.start_sec) = 1) SELECT * FROM one UNION ALL SELECT * FROM two",
    "event_gaps": f"WITH {B.SAMPLES_SQL}, gaps AS (SELECT patient, file, lead(start_sec) OVER (PARTITION BY patient, file ORDER BY start_sec) - start_sec AS gap FROM intervals), g AS (SELECT patient, file, count(*) AS events, count(gap) FILTER (gap >= 2) AS intervals, count(gap) FILTER (gap < 2) AS discarded, avg(gap) FILTER (gap >= 2) AS m, stddev_samp(gap) FILTER (gap >= 2) AS s FROM gaps GROUP BY patient, file) SELECT patient, file, events, intervals, discarded, CASE WHEN intervals < 3 THEN NULL ELSE round(s / m, 6) END AS cv, CASE WHEN intervals < 3 OR s = 0 THEN NULL ELSE round(m / s, 6) END AS coherence, intervals >= 3 AND s > 0 AS valid, CASE WHEN intervals < 3 THEN 'insufficient_intervals' WHEN s = 0 THEN 'zero_cv_unbounded' ELSE 'ok' END AS reason FROM g",
    "finite_windows": f"WITH {B.SAMPLES_SQL} SELECT patient, count(*) AS rows, round(sum(value), 6) AS total FROM samples WHERE idx % 3 = 2 GROUP BY patient",
}

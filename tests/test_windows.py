import pytest
from pyspark.errors import PySparkException

from tidewin.operators import windows as W

REC = "patient string, file string, sfreq double, n_samples long"
INT = "patient string, file string, start_sec double, end_sec double"


def recording(spark, n, sfreq=256.0):
    return spark.createDataFrame([("a", "f", sfreq, n)], REC)


def test_exact_recording_has_all_windows_and_labels(spark):
    r = recording(spark, 3600 * 256)
    i = spark.createDataFrame([("a", "f", 2996.0, 3036.0)], INT)
    w = W.labelled(W.tumbling(r, 4.0, 256.0), i, 4.0).toPandas()
    assert len(w) == 900 and w.end_sec.max() == 3600 and w.label.sum() == 10


@pytest.mark.parametrize("n", [0, 2559, 2560, 2561, 7680])
def test_incomplete_tail_is_dropped(spark, n):
    assert W.tumbling(recording(spark, n), 10.0, 256.0).count() == n // 2560


def test_window_must_hold_whole_samples():
    with pytest.raises(ValueError):
        W.window_size(0.0015, 256)


def test_overlap_label_and_mixed(spark):
    i = spark.createDataFrame([("a", "f", 5.0, 10.0), ("a", "f", 20.0, 26.0), ("b", "f", 0.0, 30.0)], INT)
    w = W.labelled(W.tumbling(recording(spark, 7680), 10.0, 256.0), i, 10.0).orderBy("start_sec").toPandas()
    assert w.label.tolist() == [1, 0, 1] and w.overlap_sec.tolist() == [5, 0, 6] and w.mixed.tolist() == [True, False, True]


def test_long_interval_covers_many_windows(spark):
    i = spark.createDataFrame([("a", "f", 3.0, 97.5)], INT)
    w = W.overlap_seconds(W.tumbling(recording(spark, 25600), 10.0, 256.0), i, 10.0)
    assert sum(r.overlap_sec for r in w.collect()) == pytest.approx(94.5)


def test_islands_stop_at_recordings_and_gaps(spark):
    rows = [("a", "f", 0.0, 4.0, 1), ("a", "f", 4.0, 8.0, 1), ("a", "g", 8.0, 12.0, 1), ("a", "g", 12.0, 16.0, 0), ("a", "g", 20.0, 24.0, 1)]
    e = W.islands(spark.createDataFrame(rows, INT + ", prediction int")).orderBy("file", "start_sec").toPandas()
    assert e.windows.tolist() == [2, 1, 1] and e.sustained.tolist() == [True, False, False] and e.end_sec.tolist() == [8, 12, 24]


def test_context_bounds_and_reasons(spark):
    w = spark.createDataFrame([("a", "f", 8.0, 12.0), ("a", "f", 0.0, 4.0), ("a", "f", 16.0, 20.0)], INT)
    r = recording(spark, 5120)
    c = {x.start_sec: x for x in W.contexts(w, r, "centered", 3.0, 3.0, 256.0).collect()}
    assert (c[8].context_start, c[8].context_stop, c[8].context_reason) == (1280, 3840, "ok")
    assert c[0].context_reason == "recording_start" and c[16].context_reason == "recording_end"
    t = {x.start_sec: x for x in W.contexts(w, r, "trailing", 6.0, 0.0, 256.0).collect()}
    assert (t[8].context_start, t[8].context_stop, t[8].context_reason) == (512, 3072, "ok")


def test_interval_faults(spark):
    i = spark.createDataFrame([("a", "f", 1.0, 2.0), ("a", "f", 1.5, 3.0), ("a", "f", 5.0, 5.0), ("a", "f", 18.0, 21.0), ("a", "f", -1.0, 0.5)], INT)
    got = {r.start_sec: r.reason for r in W.interval_faults(i, recording(spark, 5120)).collect()}
    assert got == {1.5: "overlapping", 5.0: "empty", 18.0: "after_end", -1.0: "before_start"}


def test_crossings_fold(spark):
    s = spark.createDataFrame([(1, [0.0, 0.0, 0.6, 0.6, -0.6, -0.6, 0.6])], "k int, samples array<double>")
    assert W.refractory_crossings(s, ["k"], 0.5, 1).first().events == [4, 6]
    assert W.refractory_crossings(s, ["k"], 0.5, 3).first().events == [4]


def test_zscore_constant_column(spark):
    z = W.zscores(spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0)], "p string, x double, c double"), ["p"], ["x", "c"]).orderBy("x").collect()
    assert z[1].x == pytest.approx(2**-0.5) and z[0].c == 0


def test_fractions_round_half_to_even(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(7)], "f string, t double")  # (7 - 1) * .25 = 1.5 -> 2; 4.5 -> 4
    assert sorted(r.t for r in W.at_fractions(rows, ["f"], "t", (0.25, 0.75)).collect()) == [2.0, 4.0]


def test_nearest_disjoint_avoids_used_and_chosen(spark):
    c = spark.createDataFrame([("a", "f", float(s), s + 4.0, s - 6.0, s + 4.0) for s in range(6, 60, 4)], INT + ", context_start_sec double, context_end_sec double")
    used = spark.createDataFrame([("a", "f", 10.0, 14.0)], INT)
    targets = spark.createDataFrame([("a", "f", 0.25, 14.0), ("a", "f", 0.75, 22.0)], "patient string, file string, fraction double, target_sec double")
    got = {r.fraction: (r.context_start_sec, r.context_end_sec) for r in W.nearest_disjoint(c, used, targets).collect()}
    assert got[0.25] == (0.0, 10.0) and got[0.75] == (16.0, 26.0)


def test_unknown_threshold(spark):
    with pytest.raises((ValueError, PySparkException)):
        W.labelled(recording(spark, 10), recording(spark, 10), 1.0, 0.0)

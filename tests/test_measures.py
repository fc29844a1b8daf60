import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewin.functions import kernels as K
from tidewin.operators import measures as M

rng = np.random.default_rng(5)
SIGNALS = {"noise": rng.normal(3, 2, 200), "steps": np.cumsum(rng.normal(size=150)), "ties": rng.integers(0, 3, 90).astype(float), "constant": np.full(20, 7.0), "two": np.array([1.0, 4.0]), "line": np.arange(40.0) * 0.5, "far": 1e9 + rng.normal(size=300)}
ODD = {"null": None, "empty": [], "one": [1.0], "nan": [1.0, float("nan"), 2.0], "inf": [1.0, float("inf"), 2.0], "hole": [1.0, None, 2.0]}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, None if x is None else list(x), 1.0) for k, x in {**{k: v.tolist() for k, v in SIGNALS.items()}, **ODD}.items()], "name string, samples array<double>, mean double").repartition(3)


def measured(df):
    return {r["name"]: {c: r[c] for c in df.columns if c != "name"} for r in df.collect()}


def test_time_and_hjorth_measures_are_the_kernels(rows):
    time, hjorth = measured(M.time_features(rows, ["name"], "samples")), measured(M.hjorth_features(rows, ["name"], "samples"))
    for k, x in SIGNALS.items():
        assert list(time[k].values()) == pytest.approx(list(K.time_features(x)), rel=1e-9, abs=1e-9)
        if len(x) > 2:
            assert list(hjorth[k].values()) == pytest.approx(list(K.hjorth(x)), rel=1e-6, abs=1e-9)
    assert hjorth["two"] == {"activity": 2.25, "mobility": 0.0, "complexity": 0.0} and hjorth["constant"] == {"activity": 0.0, "mobility": 0.0, "complexity": 0.0}
    assert all(v is None for k in ODD for v in (*time[k].values(), *hjorth[k].values()))


def test_entropy_and_reconstruction_are_the_kernels(rows):
    perm = measured(M.permutation_entropy(rows, ["name"], "samples"))
    for k, x in SIGNALS.items():
        assert perm[k]["perm"] == (pytest.approx(float(K.permutation_entropy(x)), abs=1e-12) if len(x) > 2 else None)
    z = measured(M.standardised(rows, ["name"], "samples"))
    for k, x in SIGNALS.items():
        assert z[k]["samples"] == pytest.approx(K.standardised(x).tolist(), rel=1e-6, abs=1e-6)
    for factor in (1, 4, 7):
        for antialiased, method in ((False, "legacy_stride"), (True, "antialiased")):
            got = measured(M.reconstructed(rows, ["name"], "samples", factor, antialiased))
            kept = measured(M.preservation(M.reconstructed(rows, ["name"], "samples", factor, antialiased), ["name"]))
            for k, x in SIGNALS.items():
                if factor > len(x):
                    continue
                y = K.reconstruct(x, factor, method)
                assert got[k]["y"] == pytest.approx(y.tolist(), rel=1e-9, abs=1e-9)
                want = K.preservation(x, y)
                if k not in ("constant", "far"):
                    assert [kept[k][c] for c in want] == pytest.approx([None if np.isnan(v) else v for v in want.values()], rel=1e-7, abs=1e-9)
            assert kept["constant"]["normalized_rmse"] is None or antialiased


@pytest.mark.parametrize(("size", "panes", "step"), [(10, 4, 1), (8, 3, 2), (5, 1, 1), (2, 5, 7), (25, 8, 8)])
def test_windows_merged_from_panes_are_those_of_the_samples(spark, size, panes, step):
    x = {"a": np.cumsum(rng.normal(size=400)) + 100, "b": rng.normal(size=400), "c": np.full(400, 2.0)}
    rows = spark.createDataFrame([(k, p, v[p * size : (p + 1) * size].tolist()) for k, v in x.items() for p in range(len(v) // size)], "name string, pane long, samples array<double>").repartition(4)
    out = M.window_measures(M.pane_summaries(rows, ["name"], "pane", "samples"), ["name"], panes, step).collect()
    n = len(range(0, 400 // size - panes + 1, step))
    assert sorted((r["name"], r.window) for r in out) == [(k, w) for k in "abc" for w in range(n)]
    for r in out:
        part = x[r["name"]][r.window * step * size :][: panes * size]
        assert list(r)[2:7] == pytest.approx(list(K.time_features(part)), rel=1e-9, abs=1e-9)
        if len(part) > 2:
            assert list(r)[7:] == pytest.approx(list(K.hjorth(part)), rel=1e-6, abs=1e-9)


def test_each_pane_is_read_once_and_no_python_runs(spark):
    rows = spark.range(100).select(F.col("id").alias("pane"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.sin(k + F.col("id") * 10)).alias("samples"))
    out = M.window_measures(M.pane_summaries(rows, [], "pane", "samples"), [], 4, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 97 and "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
    with pytest.raises(Exception, match="all finite"):
        M.pane_summaries(rows.withColumn("samples", F.array(F.lit(1.0))), [], "pane", "samples").collect()

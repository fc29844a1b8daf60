"""Work that grows with the input alone: kernels walk many signals at once, tasks hold little more than their rows."""

import numpy as np
import pytest

from tidewin.functions import kernels as K
from tidewin.operators import chunks as H
from tidewin.operators import models as M
from tidewin.plans import relational_queries as Q


@pytest.fixture
def signals():
    rng = np.random.default_rng(3)
    return np.sin(np.arange(2560) * 0.24) * 2e-5 + rng.integers(1, 50, (6, 2560)) * 1e-6


def counted(monkeypatch, name):
    calls, real = [], getattr(K, name)
    monkeypatch.setattr(K, name, lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


def test_perturbed_signals_are_walked_together(signals, monkeypatch):
    one = [K.perturbed(x, 256.0, "sr_voltage_referenced", np.random.default_rng(k)) for k, x in enumerate(signals)]
    calls = counted(monkeypatch, "bistable")
    both = K.all_perturbed(signals, 256.0, "sr_voltage_referenced", [np.random.default_rng(k) for k in range(6)])
    assert len(calls) == 1 and np.allclose(both, np.stack(one), rtol=1e-12, atol=1e-18)


def test_doses_and_trials_are_measured_together(spark, signals, monkeypatch):
    drives, _ = K.characteristic_components(signals, 256.0)
    calls = counted(monkeypatch, "regularities")
    found = K.cr_trials(drives, 0.35, 0.5, 52)
    assert len(found) == 6 and len(calls) == 1


def plain_transitions(x, threshold, dwell):
    state, last, out = 0, -dwell, []
    for i, v in enumerate(x):
        side = 1 if v >= threshold else -1 if v <= -threshold else 0
        if state == 0:
            state = side
        elif side == -state and i - last >= dwell:
            out.append(i)
            state, last = side, i
    return out


@pytest.mark.parametrize("dwell", [0.0, 0.02, 0.3])
def test_transitions_by_stays(dwell):
    x = np.cumsum(np.random.default_rng(5).normal(size=4000)) % 4 - 2
    assert K.transitions(x, 256.0, 0.5, dwell).tolist() == plain_transitions(x, 0.5, max(1, int(dwell * 256)))


def test_students_take_columns_and_not_frames(spark):
    f = spark.range(40).selectExpr("id AS k", "concat('p', id % 2) AS patient", "cast(id % 3 = 0 AS int) AS label", "if(id % 7 > 0, id / 3.0D, null) AS a", "cast(id % 5 AS double) AS b")
    scores = M.student_folds(f, ["a", "b"], "patient", "k", (1,), epochs=2)
    assert "FlatMapGroupsInPandas" not in scores._jdf.queryExecution().toString()
    assert sorted((r.k, r.test_group) for r in scores.collect()) == [(k, f"p{k % 2}") for k in range(40)]


def test_contexts_travel_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    Q._contexts(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "4m" and H.ROWS <= 64


def test_search_fits_each_folds_transform_once(spark, monkeypatch):
    fits, real = [], M.FeatureTransform.fit
    monkeypatch.setattr(M.FeatureTransform, "fit", staticmethod(lambda *a, **k: fits.append(1) or real(*a, **k)))
    f = spark.range(60).selectExpr("concat('p', id % 2) AS patient", "cast(id % 3 = 0 AS int) AS label", "id / 3.0D AS a", "cast(id % 5 AS double) AS b")
    found = M.random_search(f, ["a", "b"], "patient", "random_forest", {"numTrees": [1, 2], "maxDepth": [1, 2]}, 2)
    assert len(found.collect()) == 2 and len(fits) == 2

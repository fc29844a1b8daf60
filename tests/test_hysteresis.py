import numpy as np
import pytest

from tidewin.operators import hysteresis as H
from tidewin.operators import windows as W


def fold(x, threshold, dwell):
    state, last, out = 0, -dwell, []
    for i, v in enumerate(x):
        side = 1 if v is not None and v >= threshold else -1 if v is not None and v <= -threshold else 0
        if state == 0:
            state = side
        elif side == -state and i - last >= dwell:
            state, last = side, i
            out.append(i)
    return out


def signals():
    rng = np.random.default_rng(3)
    out = {f"n{k}": rng.normal(size=int(rng.integers(1, 300))) for k in range(12)}
    out |= {"slow": 2 * np.sin(np.arange(400) / 17), "edge": rng.choice([-0.5, 0.0, 0.5], 300), "none": np.zeros(100), "high": np.ones(90), "late": np.r_[np.zeros(150), rng.normal(size=100)], "fast": np.tile([1.0, -1.0], 120)}
    return {k: [None if k == "n3" and i % 5 == 0 else float(v) for i, v in enumerate(x)] for k, x in out.items()}


@pytest.mark.parametrize("dwell", [0, 1, 2, 7, 40, 1000])
def test_composed_chunks_are_the_fold(dwell):
    """Summaries alone, without Spark, on every signal and many chunk lengths."""
    for x in signals().values():
        want = fold(x, 0.5, dwell)
        values = np.array([np.nan if v is None else v for v in x])
        for size in (1, 2, 5, 16, 64, 400):
            state, last, got = 0, H.NONE, []
            for first in range(0, len(x), size):
                chunk = H.Chunk(values[first : first + size], 0.5, dwell)
                wait = max(0, last + max(dwell, 1) - first) if last != H.NONE else 0
                events = chunk.events(state, wait)
                got += [first + e for e in events]
                state, last = H.composed(state, last, first, chunk.summary(), dwell)
                assert last == (got[-1] if got else H.NONE)
                assert len(chunk.summary()) <= 2 * (max(dwell, 1) + 1) + 1
            assert got == want


@pytest.mark.parametrize(("dwell", "size"), [(1, 16), (3, 50), (20, 7)])
def test_crossings_through_spark(spark, dwell, size):
    rows = [(k, "f", a, x[a : a + size]) for k, x in signals().items() for a in range(0, len(x), size)]
    chunks = spark.createDataFrame(rows[::-1], "patient string, file string, first_sample long, samples array<double>").repartition(6)
    got = sorted((r.patient, r.event) for r in H.chunk_crossings(chunks, ["patient", "file"], 0.5, dwell).collect())
    assert got == sorted((k, e) for k, x in signals().items() for e in fold(x, 0.5, dwell))
    whole = spark.createDataFrame([(k, "f", x) for k, x in signals().items()], "patient string, file string, samples array<double>")
    assert got == sorted((r.patient, e) for r in W.refractory_crossings(whole, ["patient", "file"], 0.5, dwell).collect() for e in r.events)


def test_one_signal_without_keys_and_empty(spark):
    x = signals()["fast"]
    rows = spark.createDataFrame([(a, x[a : a + 30]) for a in range(0, len(x), 30)], "first_sample long, samples array<double>")
    assert sorted(r.event for r in H.chunk_crossings(rows, [], 0.5, 4).collect()) == fold(x, 0.5, 4)
    assert H.chunk_crossings(rows.limit(0), [], 0.5, 4).collect() == []

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewin.functions import kernels as K
from tidewin.operators import chunks as C
from tidewin.operators import features as X


def cut(name, x, size, shuffle=True):
    rows = [(name, a // size, a, len(x), x[a : a + size].tolist()) for a in range(0, len(x), size)]
    return rows[::-1] if shuffle else rows


SCHEMA = "channel string, chunk long, first_sample long, n_samples long, samples array<double>"


def joined(rows, column="samples"):
    out = {}
    for r in sorted(rows, key=lambda r: r.chunk):
        out.setdefault(r.channel, []).append(r[column])
    return {k: np.concatenate(v) for k, v in out.items()}


def test_chunks_are_filtered_as_the_whole_signal(spark):
    rng = np.random.default_rng(1)
    signals = {"long": rng.normal(size=9001), "short": rng.normal(size=40), "rim": rng.normal(size=2000 + 3), "one chunk": rng.normal(size=2000), "steps": np.cumsum(rng.normal(size=6000))}
    rows = spark.createDataFrame([r for k, x in signals.items() for r in cut(k, x, 2000)], SCHEMA).repartition(5)
    got = C.filtered(rows, ["channel"], K.cleaning(256.0))
    assert got.columns == rows.columns and got.agg(F.max(F.size("samples"))).first()[0] == 2000
    for k, x in joined(got.collect()).items():
        assert np.abs(x - K.preprocess(signals[k], 256.0)).max() < 1e-9 * max(1, np.abs(signals[k]).max())
    band = [K.Stage(K.fir_bandpass(4.0, 12.0, 64.0, (2.0, 2.0)))]
    for k, x in joined(C.filtered(rows, ["channel"], band).collect()).items():
        assert np.abs(x - K.zero_phase(band[0].taps, signals[k])).max() < 1e-9 * max(1, np.abs(signals[k]).max())


def test_no_row_holds_more_than_a_chunk_and_its_halos(spark):
    x = np.random.default_rng(2).normal(size=200_000)
    rows = spark.createDataFrame(cut("a", x, 4096), SCHEMA).repartition(8)
    held = C.with_halos(rows, ["channel"], 846)
    most = held.agg(*[F.max(F.coalesce(F.size(c), F.lit(0))).alias(c) for c in ("samples", "before", "after")]).first()
    assert tuple(most) == (4096, 846, 846) and held.count() == 49


def test_faults_of_chunks(spark):
    x = np.arange(100.0)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    stage = [K.Stage(np.ones(21) / 21)]
    with pytest.raises(Exception, match="fewer than 10 samples"):
        C.filtered(frame(cut("a", x, 5)), ["channel"], stage).collect()
    with pytest.raises(Exception, match="missing beside"):
        C.filtered(frame([r for r in cut("a", x, 20) if r[1] != 2]), ["channel"], stage).collect()
    with pytest.raises(Exception, match="finite"):
        C.filtered(frame(cut("a", np.r_[x, np.nan], 20)), ["channel"], stage).collect()
    assert C.filtered(frame([]), ["channel"], stage).collect() == []


def test_pieces_become_chunks(spark):
    x = np.arange(1000.0)
    edges = [0, 1, 7, 300, 301, 650, 1000]
    pieces = [("a", a, x[a:b].tolist()) for a, b in zip(edges, edges[1:], strict=False)] + [("b", 0, [5.0])]
    df = spark.createDataFrame(pieces, "channel string, first_sample long, samples array<double>").repartition(3)
    rows = C.rechunked(df, ["channel"], 128).collect()
    assert (joined(rows)["a"] == x).all() and {r.n_samples for r in rows if r.channel == "a"} == {1000} and all(len(r.samples) <= 128 for r in rows)
    with pytest.raises(Exception, match="gap or overlap"):
        C.rechunked(df.where("first_sample <> 301"), ["channel"], 128).collect()
    with pytest.raises(Exception, match="gap or overlap"):
        C.rechunked(df.union(df.where("first_sample = 7")), ["channel"], 128).collect()


def test_features_of_chunks_are_those_of_the_recording(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 256 * 37))
    rows = [(p, "r.edf", *r) for p in ("p1", "p2") for k, c in enumerate("AB") for r in cut(c, x[k] * (1 + (p == "p2")), 4096)]
    chunked = spark.createDataFrame(rows, f"patient string, file string, {SCHEMA}").repartition(4)
    clean = C.filtered(chunked, ["patient", "file", "channel"], K.cleaning(256.0))
    got = {(r.patient, r.start_sec): r for r in C.chunk_features(clean, ["patient", "file"], ["A", "B"], 256.0).collect()}
    whole = spark.createDataFrame([(p, "r.edf", (x * (1 + (p == "p2"))).tolist()) for p in ("p1", "p2")], "patient string, file string, signals array<array<double>>")
    want = X.recording_features(whole, ["patient", "file"], ["A", "B"], 256.0).collect()
    assert len(got) == len(want) == 18
    for r in want:
        assert list(got[r.patient, r.start_sec])[2:] == pytest.approx(list(r)[2:], rel=1e-7)
    with pytest.raises(Exception, match="whole windows"):
        C.chunk_features(spark.createDataFrame([("p", "f", *r) for r in cut("A", x[0], 1500)], f"patient string, file string, {SCHEMA}"), ["patient", "file"], ["A"], 256.0).collect()

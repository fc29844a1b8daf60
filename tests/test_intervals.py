import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewin.operators import windows as W

INT = "patient string, file string, start_sec double, end_sec double"


def test_cover_is_exact_and_logarithmic(spark):
    rng = np.random.default_rng(0)
    pairs = [(float(a), float(a + n)) for a in (-37, -1, 0, 5, 1000) for n in (0.5, 1, 2, 3, 7, 64, 100, 4097)]
    pairs += [(float(a), float(a + b)) for a, b in rng.uniform(0, 500, (40, 2))]
    rows = spark.createDataFrame(pairs, "a double, b double").select("*", W.cover(F.col("a"), F.col("b"), 1.0).alias("c")).collect()
    for r in rows:
        cells = sorted(k for x in r.c for k in range(x.node << x.level, (x.node + 1) << x.level))
        assert cells == list(range(int(np.floor(r.a)), max(int(np.floor(r.a)) + 1, int(np.ceil(r.b)))))
        assert len(r.c) <= 2 * np.log2(len(cells) + 1) + 1


def brute(windows, intervals):
    return [(p, f, a, b, sum(max(0.0, min(b, d) - max(a, c)) for q, g, c, d in intervals if (p, f) == (q, g) and d > c)) for p, f, a, b in windows]


@pytest.mark.parametrize("cell", [0.7, 4.0, 500.0])
def test_overlaps_of_any_lengths_match_brute_force(spark, cell):
    rng = np.random.default_rng(1)
    draw = lambda n, most: [(f"p{k % 2}", "f", float(a), float(a + b)) for k, (a, b) in enumerate(zip(rng.uniform(-20, 300, n), rng.exponential(most, n), strict=True))]
    windows, intervals = draw(60, 10) + [("p9", "f", 0.0, 4.0)], draw(25, 40) + [("p0", "f", 5.0, 5.0), ("p1", "f", -1e4, 1e4)]
    got = sorted(tuple(r) for r in W.overlap_seconds(spark.createDataFrame(windows, INT), spark.createDataFrame(intervals, INT), cell).collect())
    for g, w in zip(got, sorted(brute(windows, intervals)), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-7)
    cover = {r.start_sec: r for r in W.event_coverage(spark.createDataFrame(intervals, INT), spark.createDataFrame([(*w, 1) for w in windows], INT + ", label int"), cell).collect()}
    for p, f, a, b in intervals:
        met = [w for w in windows if w[:2] == (p, f) and min(b, w[3]) > max(a, w[2])]
        assert cover[a].represented == bool(met) and cover[a].covered_sec == pytest.approx(sum(min(b, w[3]) - max(a, w[2]) for w in met), abs=1e-7)


def test_an_interval_of_ten_million_seconds(spark):
    recording = spark.createDataFrame([("a", "f", 1.0, 400_000)], "patient string, file string, sfreq double, n_samples long")
    windows = W.tumbling(recording, 4.0, 1.0).select(*W.KEYS)
    intervals = spark.createDataFrame([("a", "f", 2.0, 1e7), ("a", "f", 100.0, 103.0)], INT)
    nodes = intervals.select(F.explode(W.cover(F.col("start_sec"), F.col("end_sec"), 4.0)))
    assert nodes.count() <= 50  # for 2,500,000 multiples
    out = W.overlap_seconds(windows, intervals, 4.0)
    assert out.count() == 100_000 and out.agg(F.sum("overlap_sec")).first()[0] == 400_000 - 2 + 3
    met = W._met(windows, intervals, 4.0, "start_sec", "end_sec", "inner")
    assert met.count() == 100_001  # one meeting for each window and interval, and one more


def runs(rows, least=2):
    out = []
    for rec in sorted({r[:2] for r in rows}):
        before = None
        for _, _, a, b, p in sorted(r for r in rows if r[:2] == rec):
            if p == 1:
                if before is not None and before[4] == 1 and abs(a - before[3]) <= 1e-8 + 1e-5 * abs(before[3]):
                    out[-1][3], out[-1][4] = max(out[-1][3], b), out[-1][4] + 1
                else:
                    out.append([*rec, a, b, 1])
            before = (*rec, a, b, p)
    return sorted((*e, e[4] >= least) for e in out)


@pytest.mark.parametrize("cell", [4.0, 10.0, 3600.0, 1e6])
def test_events_are_stitched_over_cells(spark, cell):
    rng = np.random.default_rng(2)
    rows = [("hot", "f", 4.0 * k, 4.0 * k + 4, int(x)) for k, x in enumerate(rng.random(1500) < 0.8)]
    rows += [(f"p{k}", "f", 3.0 * j, 3.0 * j + (3 if j % 7 else 2.5), int(rng.random() < 0.6)) for k in range(20) for j in range(40)]
    rows += [("long", "f", 0.0, 5000.0, 1), ("long", "f", 5000.0, 5004.0, 1), ("long", "f", 9000.0, 9004.0, 1), ("neg", "f", -8.0, -4.0, 1), ("neg", "f", -4.0, 0.0, 1), ("neg", "f", 0.0, 4.0, None)]
    df = spark.createDataFrame(rows, INT + ", prediction int").repartition(5)
    got = sorted(tuple(r) for r in W.islands(df, cell_sec=cell).select(*W.KEYS, "windows", "sustained").collect())
    assert got == runs(rows)
    plan = W.islands(df, cell_sec=cell)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_cell" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))

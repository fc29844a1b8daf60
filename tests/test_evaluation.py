import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidewin.operators import evaluation as E
from tidewin.operators import relational as R
from tidewin.operators import stats as T
from tidewin.operators.transforms import FeatureTransform


def scored(spark, rows):
    return spark.createDataFrame([(p, y, s, int(s >= 0.5)) for p, y, s in rows], "p string, label int, score double, prediction int")


def test_macro_and_pooled_differ(spark):
    rows = scored(spark, [("p1", 1, 0.9), ("p1", 0, 0.1), ("p2", 1, 0.2), ("p2", 1, 0.2), ("p2", 0, 0.9), ("p2", 0, 0.9)])
    per = E.confusion(rows, ["p"])
    assert E.macro(per, [], ("f1",)).first().f1_mean == pytest.approx(0.5)
    assert E.confusion(rows, []).first().f1 == pytest.approx(1 / 3)


def naive(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        called = s >= t
        recall = (called & (y == 1)).sum() / len(pos)
        ap += (recall - last) * (called & (y == 1)).sum() / called.sum()
        last = recall
    return auc, ap


def test_areas_with_ties(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 2)
    got = E.areas(scored(spark, [("a", int(a), float(b)) for a, b in zip(y, s, strict=True)]), ["p"]).first()
    assert (got.roc_auc, got.average_precision) == pytest.approx(naive(y, s))


def test_areas_need_both_classes(spark):
    got = E.areas(scored(spark, [("a", 0, 0.3), ("a", 0, 0.4)]), ["p"]).first()
    assert got.roc_auc is None and got.average_precision is None


def test_sweep_matches_brute_force_and_takes_first_best(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    rows = scored(spark, [("a", int(a), float(b)) for a, b in zip(y, s, strict=True)])
    got = {round(r.threshold, 2): r.f1 for r in E.threshold_sweep(rows, ["p"]).collect()}
    want = {}
    for k in range(5, 96):
        c = s >= k / 100
        tp = (c & (y == 1)).sum()
        want[k / 100] = 2 * tp / max(1, c.sum() + (y == 1).sum())
    assert got == pytest.approx(want)
    assert E.best_threshold(rows, ["p"]).first().threshold == pytest.approx(min(k for k, v in want.items() if v == max(want.values())))


def test_paired_effects_need_both_arms(spark):
    rows = spark.createDataFrame([("a", 1, "x", 0.5), ("a", 1, "y", 0.25), ("b", 1, "x", 0.5)], "patient string, seed int, arm string, f1 double")
    assert E.paired_effects(rows.where("patient = 'a'"), ["seed", "patient"], "arm", [("x", "y")], ("f1",)).first().f1 == 0.25
    with pytest.raises(PySparkException):
        E.paired_effects(rows, ["seed", "patient"], "arm", [("x", "y")], ("f1",)).collect()


def test_seeds_do_not_add_groups(spark):
    rows = spark.createDataFrame([(s, p, v) for s in (1, 2, 3) for p, v in (("p1", 0.1), ("p2", -0.2))], "seed int, patient string, f1 double")
    got = {r.patient: r.f1 for r in E.seed_averaged(rows, ["patient"], "seed", ("f1",)).collect()}
    assert got == pytest.approx({"p1": 0.1, "p2": -0.2})


def test_grid_optimum(spark):
    rows = spark.createDataFrame([("u", level, v) for level, v in ((0.0, None), (0.1, 1.0), (0.5, 3.5), (1.0, 2.0))], "u string, noise double, m double")
    r = T.grid_optima(rows, ["u"], "noise", "m").first()
    assert (r.noise, r.value, r.status) == (0.5, 3.5, "interior_grid_maximum")
    none = T.grid_optima(rows.where("noise = 0"), ["u"], "noise", "m").first()
    assert none.status == "no_valid_measurement" and none.noise is None


def test_trial_summary_keeps_invalid_trials(spark):
    inf = float("inf")
    rows = [(0.5, True, 3.0, 1.0, 4, 0.0), (0.5, True, 4.0, None, 6, 0.1), (0.5, False, inf, 2.0, 1, 0.0), (None, False, None, None, 0, 0.0)]
    got = {r.noise: r for r in T.trial_summary(spark.createDataFrame(rows, "noise double, valid boolean, coherence double, snr_db double, events int, clipped_fraction double"), ["noise"]).collect()}
    assert (got[0.5].trials, got[0.5].valid_trials, got[0.5].coherence_median, got[0.5].snr_valid_trials) == (3, 2, 3.5, 2)
    assert (got[None].invalid_trials, got[None].coherence_median) == (1, None)


def test_strict_mean(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "u string, value double")
    got = {r.u: r["mean"] for r in T.block_means(rows, ["u"], "seed", "value", F.lit(0), 2).collect()}
    assert got == {"a": 2.0, "b": None}


def test_regularity_cases(spark):
    def run(events, **how):
        return T.regularity(spark.createDataFrame([("a", float(e)) for e in events], "u string, t double"), ["u"], "t", **how).first()

    assert run([1, 5, 9]).reason == "insufficient_intervals"
    zero = run(range(0, 700, 100))
    assert zero.reason == "zero_cv_unbounded" and zero.cv == 0 and not zero.valid
    short = run([0, 51 / 256, 103 / 256, 155 / 256, 207 / 256], least=3, ddof=0, shortest=0.2)
    assert (short.discarded, short.events, short.intervals) == (1, 5, 3)


def test_spearman_with_ties(spark):
    rows = [(u, s, v) for u, (x, y) in enumerate([(1.0, 2.0), (2.0, 1.0), (2.0, 4.0), (5.0, 4.0)]) for s, v in ((1, x), (2, y))]
    r = T.spearman_pairs(spark.createDataFrame(rows, "unit int, seed int, value double"), ["unit"], "seed", "value").first()
    assert r.rank_correlation == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [2, 1, 3.5, 3.5])[0, 1])


def test_transform_fits_on_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 7.0), (None, 7.0), (3.0, 7.0)], "a double, b double")
    t = FeatureTransform.fit(train, ["a", "b"])
    assert t.median == [2.0, 7.0] and t.mean == [2.0, 7.0] and t.deviation[1] == 0
    out = t.transform(spark.createDataFrame([(999.0, 8.0)], "a double, b double"), []).first()
    assert out.b == 1.0 and FeatureTransform.from_json(t.to_json()) == t
    with pytest.raises(ValueError):
        FeatureTransform.fit(spark.createDataFrame([(None,), (None,)], "a double"), ["a"])
    with pytest.raises(ValueError):
        FeatureTransform.fit(spark.createDataFrame([(float("inf"),)], "a double"), ["a"])
    with pytest.raises(ValueError):
        t.transform(train.select("a"), [])
    with pytest.raises(PySparkException):
        t.transform(spark.createDataFrame([(float("inf"), 8.0)], "a double, b double"), []).collect()


def test_transform_keeps_tiny_scales(spark):
    t = FeatureTransform.fit(spark.createDataFrame([(1e-14,), (2e-14,), (4e-14,), (8e-14,)], "a double"), ["a"])
    z = [r.a for r in t.transform(spark.createDataFrame([(1e-14,), (2e-14,), (4e-14,), (8e-14,)], "a double"), []).collect()]
    assert np.std(z) == pytest.approx(1)


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert R.joined(a, b, ["k"], "many_to_one").count() == 2
    with pytest.raises(PySparkException):
        R.joined(a, b, ["k"], "one_to_one").collect()


def test_dedupe_names(spark):
    rows = spark.createDataFrame([("f", n) for n in ("T8-P8-0", "T8-P8-1", "FT9-FT10", "X-0", "C3")], "file string, name string")
    got = {r.name: r.final_name for r in R.dedupe_names(rows, ["file"], "name").collect()}
    assert got == {"T8-P8-0": "T8-P8", "FT9-FT10": "FT9-FT10", "X-0": "X-0", "C3": "C3"}


def test_differences_and_masks(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in R.differences(a, b).collect()) == [(1, "left"), (3, "right")]
    m = spark.createDataFrame([(1.0, 0), (None, 0), (None, 1)], "v double, m int")
    assert R.mask_faults(m, "v", "m").count() == 1
    with pytest.raises(ValueError):
        R.require_columns(m, ["v"])


def test_scores_round_as_sql_does(spark, tmp_path):
    import duckdb

    from tidewin.plans import evaluation_queries as Q

    # Lengths and ids whose score is a half of the last digit: decimals and doubles, and their texts, part there.
    n = 40_000
    spark.range(n).selectExpr("id AS doc_id", "if(id % 7 = 0, 100, 500) + id % 2900 * 1 AS n_chars", "'src' || id % 9 AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("pr_curve", "roc_curve"):
        got = Q.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(duck.sql(Q.ORACLES[name]).select(*got.columns).fetchall())

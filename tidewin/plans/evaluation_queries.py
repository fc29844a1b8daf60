"""Queries on scores, folds, effects, trials and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import decision, soft_target
from ..operators import evaluation as E
from ..operators import stats as T
from . import base as B

S, D = SparkSession, DataFrame
ARM = ["model", "seed"]
DIGITS = 6


def rounded(df: D, digits: int = DIGITS) -> D:
    return df.select(*[B.nearest(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def class_balance(spark: S, sf: str) -> D:
    return B.labelled(spark, sf, 8, 0.25).groupBy("patient").agg(F.count(F.lit(1)).alias("windows"), F.sum("label").alias("positive"))


def class_ratio(spark: S, sf: str) -> D:
    return rounded(B.labelled(spark, sf, 8, 0.25).agg(F.try_divide(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("class_ratio")))


def confusion_metrics(spark: S, sf: str) -> D:
    return rounded(E.confusion(B.predictions(spark, sf), [*ARM, "patient"]))


def roc_auc(spark: S, sf: str) -> D:
    return rounded(E.areas(B.predictions(spark, sf), [*ARM, "patient"]).drop("average_precision"))


def average_precision(spark: S, sf: str) -> D:
    return rounded(E.areas(B.predictions(spark, sf), [*ARM, "patient"]).drop("roc_auc"))


def pr_curve(spark: S, sf: str) -> D:
    return rounded(E.pr_curve(B.predictions(spark, sf), ARM))


def roc_curve(spark: S, sf: str) -> D:
    return rounded(E.roc_curve(B.predictions(spark, sf), ARM))


def threshold_sweep(spark: S, sf: str) -> D:
    return rounded(E.threshold_sweep(B.predictions(spark, sf), ARM))


def tuned_thresholds(spark: S, sf: str) -> D:
    """For each model, seed and held-out patient, the threshold with the best F1 over the other patients."""
    return rounded(E.tuned_thresholds(B.predictions(spark, sf), ARM, "patient"))


def pooled_metrics(spark: S, sf: str) -> D:
    return rounded(E.measured(B.predictions(spark, sf), ARM))


def macro_metrics(spark: S, sf: str) -> D:
    return rounded(E.macro(E.measured(B.predictions(spark, sf), [*ARM, "patient"]), ARM))


def paired_effects(spark: S, sf: str) -> D:
    per = E.measured(B.predictions(spark, sf), [*ARM, "patient"])
    return rounded(E.paired_effects(per, ["seed", "patient"], "model", [("gamma", "alpha"), ("gamma", "beta"), ("beta", "alpha")]))


def seed_averaged_effects(spark: S, sf: str) -> D:
    per = E.measured(B.predictions(spark, sf), [*ARM, "patient"])
    effects = E.paired_effects(per, ["seed", "patient"], "model", [("gamma", "alpha"), ("gamma", "beta")], ("f1", "roc_auc"))
    return rounded(E.seed_averaged(effects, ["comparison", "patient"], "seed", ("f1", "roc_auc")))


def effect_wins(spark: S, sf: str) -> D:
    """Spread of the effects, and for how many patients and seeds the first arm is better."""
    per = E.measured(B.predictions(spark, sf), [*ARM, "patient"])
    effects = E.paired_effects(per, ["seed", "patient"], "model", [("gamma", "alpha"), ("beta", "alpha")], ("f1",))
    return rounded(effects.groupBy("comparison").agg(F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"), F.min("f1").alias("f1_min"), F.max("f1").alias("f1_max"), F.count_if(F.round("f1", 9) > 0).alias("wins")))


def lopo_split_counts(spark: S, sf: str) -> D:
    return E.fold_counts(B.labelled(spark, sf, 8, 0.25), "patient")


def nested_fold_audit(spark: S, sf: str) -> D:
    return rounded(E.nested_folds(B.labelled(spark, sf, 8, 0.25), "patient"))


def generalisation_gap(spark: S, sf: str) -> D:
    """Macro F1 over patients against F1 over all rows at once, by model."""
    p = B.predictions(spark, sf)
    apart = E.macro(E.confusion(p, [*ARM, "patient"]), ["model"], ("f1",)).select("model", F.lit("by_patient").alias("split"), "f1_mean", "f1_std")
    pooled = E.macro(E.confusion(p, ARM), ["model"], ("f1",)).select("model", F.lit("pooled").alias("split"), "f1_mean", "f1_std")
    return rounded(apart.unionByName(pooled))


def robustness_summary(spark: S, sf: str) -> D:
    """Seeds as conditions, the first as the clean one."""
    p = B.predictions(spark, sf)
    clean = p.where("seed = 42").select("doc_id", "model", F.col("score").alias("clean_score"), F.col("prediction").alias("clean_prediction"))
    return rounded(E.robustness(p.join(clean, ["doc_id", "model"]), ["model", "seed"]))


def patient_behaviour(spark: S, sf: str) -> D:
    p = B.predictions(spark, sf).where("seed = 42")
    a = p.where("model = 'alpha'").select("doc_id", "patient", F.col("score").alias("a"), F.col("prediction").alias("pa"))
    b = p.where("model = 'beta'").select("doc_id", F.col("score").alias("b"), F.col("prediction").alias("pb"))
    return rounded(a.join(b, "doc_id").groupBy("patient").agg(F.count_if(F.col("pa") != F.col("pb")).alias("changed"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_change")))


def distill_soft_targets(spark: S, sf: str) -> D:
    p = B.predictions(spark, sf).where("model = 'beta'")
    return rounded(p.select("doc_id", "seed", soft_target(F.col("score")).alias("soft"), decision("score", 0.7).alias("hard")))


def trials(spark: S, sf: str) -> D:
    """Trials on a grid: suppliers' line items as trials, discounts as noise levels."""
    rows = B.read(spark, sf, "lineitem")
    trial = F.col("l_orderkey") % 4
    level = F.round("l_discount", 2)
    return rows.groupBy((F.col("l_suppkey") % 12).cast("int").alias("unit"), trial.cast("int").alias("trial"), level.alias("noise")).agg(
        F.avg("l_quantity").alias("coherence"), F.when(F.max("l_quantity") >= 30, F.sum(F.round(F.col("l_tax") * 100).cast("int")).cast("double") / F.count(F.lit(1))).alias("snr_db"), F.count(F.lit(1)).alias("events"), F.round(F.max("l_tax"), 2).alias("clipped_fraction"), (F.count(F.lit(1)) >= 3).alias("valid")
    )


def trial_summary(spark: S, sf: str) -> D:
    return rounded(T.trial_summary(trials(spark, sf), ["unit", "noise"]), 9)


def grid_optima(spark: S, sf: str) -> D:
    s = T.trial_summary(trials(spark, sf), ["unit", "noise"]).withColumns({m: F.round(m, 9) for m in ("coherence_median", "snr_mean")})
    return T.grid_optima(s, ["unit"], "noise", "coherence_median").unionByName(T.grid_optima(s, ["unit"], "noise", "snr_mean"))


def zero_baseline_delta(spark: S, sf: str) -> D:
    return rounded(T.less_baseline(trials(spark, sf), ["unit", "trial"], "noise", ["coherence"]).select("unit", "trial", "noise", "coherence_change"), 9)


def reason_counts(spark: S, sf: str) -> D:
    t = trials(spark, sf)
    reason = F.when(F.col("clipped_fraction") >= 0.08, "clipped_dynamics").when(~F.col("valid"), "insufficient_intervals").otherwise("ok")
    return t.groupBy("noise", reason.alias("reason")).agg(F.count(F.lit(1)).alias("trials"))


def _seeded(spark: S, sf: str) -> D:
    """A value for each supplier and month (as seed 1 to 12): mean quantity."""
    return B.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.month("l_shipdate").alias("seed")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))


def strict_mean_blocks(spark: S, sf: str) -> D:
    rows = _seeded(spark, sf).withColumn("value", F.when((F.col("unit") + F.col("seed")) % 29 != 0, F.col("value")))
    return rounded(T.block_means(rows, ["unit"], "seed", "value", ((F.col("seed") - 1) / 4).cast("int"), 4), 9)


def spearman_pairs(spark: S, sf: str) -> D:
    return rounded(T.spearman_pairs(_seeded(spark, sf), ["unit"], "seed", "value"))


def spearman_summary(spark: S, sf: str) -> D:
    return rounded(T.spearman_pairs(_seeded(spark, sf), ["unit"], "seed", "value").agg(F.median("rank_correlation").alias("rank_median"), F.min("rank_correlation").alias("rank_min"), F.max("rank_correlation").alias("rank_max")))


def within_unit_spread(spark: S, sf: str) -> D:
    return rounded(T.quantiles(_seeded(spark, sf).groupBy("unit").agg(F.stddev_samp("value").alias("sd")), [], "sd", {"median_within_sd": 0.5}))


def _halves(spark: S, sf: str) -> D:
    return _seeded(spark, sf).groupBy("unit").agg(F.avg(F.when(F.col("seed") <= 6, F.col("value"))).alias("x"), F.avg(F.when(F.col("seed") > 6, F.col("value"))).alias("y"))


def split_half_agreement(spark: S, sf: str) -> D:
    h = _halves(spark, sf).select("unit", (F.col("x") - 25.5).alias("x"), (F.col("y") - 25.5).alias("y"))
    return rounded(T.agreement(h, "x", "y"))


def driven_control_delta(spark: S, sf: str) -> D:
    h = _halves(spark, sf).withColumn("half", F.col("unit") % 2)
    return rounded(T.deltas(h, ["half"], F.col("x"), F.col("y")))


def timing_percentiles(spark: S, sf: str) -> D:
    e = B.read(spark, sf, "events")
    most = e.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.countDistinct("user_id").alias("users"))
    at = T.quantiles(e, ["event_type"], "value", {"median": 0.5, "p95": 0.95})
    return rounded(T.same_keys(most, at, ["event_type"], "left").select("event_type", "median", "p95", "least", "most", "users"))


QUERIES = {f.__name__: f for f in (class_balance, class_ratio, confusion_metrics, roc_auc, average_precision, pr_curve, roc_curve, threshold_sweep, tuned_thresholds, pooled_metrics, macro_metrics, paired_effects, seed_averaged_effects, effect_wins, lopo_split_counts, nested_fold_audit, generalisation_gap, robustness_summary, patient_behaviour, distill_soft_targets, trial_summary, grid_optima, zero_baseline_delta, reason_counts, strict_mean_blocks, spearman_pairs, spearman_summary, within_unit_spread, split_half_agreement, driven_control_delta, timing_percentiles)}

_P = f"WITH {B.PREDICTIONS_SQL}"
_E8 = f"WITH {B.SAMPLES_SQL},\n{B.labelled_sql(8, 0.25)}"


def _counts(by: str, name: str) -> str:
    return f"{name} AS (SELECT {by}, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) AS windows FROM predictions GROUP BY {by})"


_RATES = """(tp + tn) / windows AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
 CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity, (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END) / 2 AS balanced_accuracy"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, {DIGITS})::DOUBLE AS {n}" for n in names)


def _areas(by: str, name: str) -> str:
    return f"""{name}_s AS (SELECT {by}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM predictions GROUP BY {by}, score),
{name}_c AS (SELECT *, sum(pos) OVER u AS tp, sum(neg) OVER u AS fp, sum(pos) OVER w AS positives, sum(neg) OVER w AS negatives FROM {name}_s WINDOW u AS (PARTITION BY {by} ORDER BY score DESC), w AS (PARTITION BY {by})),
{name} AS (SELECT {by}, CASE WHEN max(positives) * max(negatives) > 0 THEN sum(pos * (negatives - fp + neg / 2.0)) / (max(positives) * max(negatives)) END AS roc_auc, CASE WHEN max(positives) > 0 THEN sum(pos * (tp / (tp + fp))) / max(positives) END AS average_precision FROM {name}_c GROUP BY {by})"""


_PER = f"{_P}, {_counts('model, seed, patient', 'pc')}, {_areas('model, seed, patient', 'pa')}, per AS (SELECT pc.*, {_RATES}, roc_auc, average_precision FROM pc JOIN pa USING (model, seed, patient))"
_SIX = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")


def _effects(pairs: list[tuple[str, str]], metrics: tuple[str, ...]) -> str:
    return "effects AS (" + " UNION ALL ".join(f"SELECT a.seed, a.patient, '{x}-{y}' AS comparison, " + ", ".join(f"a.{m} - b.{m} AS {m}" for m in metrics) + f" FROM per a JOIN per b ON a.seed = b.seed AND a.patient = b.patient AND a.model = '{x}' AND b.model = '{y}'" for x, y in pairs) + ")"


_TRIALS = "WITH trials AS (SELECT (l_suppkey % 12)::INT AS unit, (l_orderkey % 4)::INT AS trial, round(l_discount, 2) AS noise, avg(l_quantity) AS coherence, CASE WHEN max(l_quantity) >= 30 THEN sum(round(l_tax * 100)::INT)::DOUBLE / count(*) END AS snr_db, count(*) AS events, round(max(l_tax), 2) AS clipped_fraction, count(*) >= 3 AS valid FROM lineitem GROUP BY 1, 2, 3)"
_SUMMARY = _TRIALS + ", summary AS (SELECT unit, noise, count(*) AS trials, count(*) FILTER (valid) AS valid_trials, count(*) FILTER (NOT valid) AS invalid_trials, count(*) FILTER (valid) / count(*) AS valid_fraction, median(coherence) FILTER (valid) AS coherence_median, stddev_samp(coherence) FILTER (valid) AS coherence_sd, avg(snr_db) AS snr_mean, count(snr_db) AS snr_valid_trials, avg(events) AS events_mean, max(clipped_fraction) AS clipped_fraction_max FROM trials GROUP BY unit, noise)"
_SEEDED = "WITH seeded AS (SELECT l_suppkey AS unit, month(l_shipdate)::INT AS seed, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2)"
_PAIRS = _SEEDED + ", pairs AS (SELECT a.seed AS seed_a, b.seed AS seed_b, a.value AS x, b.value AS y FROM seeded a JOIN seeded b ON a.unit = b.unit AND a.seed < b.seed), ranked AS (SELECT seed_a, seed_b, rank() OVER (PARTITION BY seed_a, seed_b ORDER BY x) + (count(*) OVER (PARTITION BY seed_a, seed_b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY seed_a, seed_b ORDER BY y) + (count(*) OVER (PARTITION BY seed_a, seed_b, y) - 1) / 2 AS ry FROM pairs), spearman AS (SELECT seed_a, seed_b, count(*) AS units, corr(rx, ry) AS rank_correlation FROM ranked GROUP BY 1, 2)"
_HALVES = _SEEDED + ", halves AS (SELECT unit, avg(value) FILTER (seed <= 6) AS x, avg(value) FILTER (seed > 6) AS y FROM seeded GROUP BY unit)"
_SWEEP = "ks AS (SELECT unnest(generate_series(5, 95)) AS k)"

ORACLES = {
    "class_balance": f"{_E8} SELECT patient, count(*) AS windows, sum(label)::BIGINT AS positive FROM labelled GROUP BY patient",
    "class_ratio": f"{_E8} SELECT round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6)::DOUBLE AS class_ratio FROM labelled",
    "confusion_metrics": f"{_P}, {_counts('model, seed, patient', 'c')}, m AS (SELECT *, {_RATES} FROM c) SELECT model, seed, patient, tn, fp, fn, tp, windows, {_r('accuracy', 'precision', 'recall', 'f1', 'specificity', 'balanced_accuracy')} FROM m",
    "roc_auc": f"{_P}, {_areas('model, seed, patient', 'a')} SELECT model, seed, patient, {_r('roc_auc')} FROM a",
    "average_precision": f"{_P}, {_areas('model, seed, patient', 'a')} SELECT model, seed, patient, {_r('average_precision')} FROM a",
    "pr_curve": f"{_P}, {_areas('model, seed', 'a')} SELECT model, seed, score AS threshold, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / positives, 6)::DOUBLE AS recall FROM a_c",
    "roc_curve": f"{_P}, {_areas('model, seed', 'a')} SELECT model, seed, score AS threshold, round(fp / negatives, 6)::DOUBLE AS fpr, round(tp / positives, 6)::DOUBLE AS tpr FROM a_c",
    "threshold_sweep": f"{_P}, {_SWEEP} SELECT model, seed, k / 100.0::DOUBLE AS threshold, round(2 * count(*) FILTER (label = 1 AND score >= k / 100.0::DOUBLE) / greatest(count(*) FILTER (score >= k / 100.0::DOUBLE) + count(*) FILTER (label = 1), 1), 6)::DOUBLE AS f1 FROM predictions, ks GROUP BY model, seed, k",
    "tuned_thresholds": f"{_P}, {_SWEEP}, t AS (SELECT DISTINCT patient AS test_group FROM predictions), f AS (SELECT model, seed, test_group, k / 100.0::DOUBLE AS threshold, 2 * count(*) FILTER (label = 1 AND score >= k / 100.0::DOUBLE) / greatest(count(*) FILTER (score >= k / 100.0::DOUBLE) + count(*) FILTER (label = 1), 1) AS f1 FROM predictions, ks, t WHERE patient <> test_group GROUP BY model, seed, test_group, k) SELECT model, seed, test_group, threshold, round(f1, 6)::DOUBLE AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY model, seed, test_group ORDER BY f1 DESC, threshold) = 1",
    "pooled_metrics": f"{_P}, {_counts('model, seed', 'c')}, {_areas('model, seed', 'a')}, m AS (SELECT c.*, {_RATES}, roc_auc, average_precision FROM c JOIN a USING (model, seed)) SELECT model, seed, tn, fp, fn, tp, windows, {_r(*_SIX, 'specificity', 'balanced_accuracy')} FROM m",
    "macro_metrics": f"{_PER} SELECT model, seed, " + ", ".join(f"round(avg({m}), 6)::DOUBLE AS {m}_mean, round(stddev_samp({m}), 6)::DOUBLE AS {m}_std" for m in _SIX) + " FROM per GROUP BY model, seed",
    "paired_effects": f"{_PER}, {_effects([('gamma', 'alpha'), ('gamma', 'beta'), ('beta', 'alpha')], _SIX)} SELECT seed, patient, comparison, {_r(*_SIX)} FROM effects",
    "seed_averaged_effects": f"{_PER}, {_effects([('gamma', 'alpha'), ('gamma', 'beta')], ('f1', 'roc_auc'))} SELECT comparison, patient, count(DISTINCT seed) AS seeds, round(avg(f1), 6)::DOUBLE AS f1, round(avg(roc_auc), 6)::DOUBLE AS roc_auc FROM effects GROUP BY comparison, patient",
    "effect_wins": f"{_PER}, {_effects([('gamma', 'alpha'), ('beta', 'alpha')], ('f1',))} SELECT comparison, round(avg(f1), 6)::DOUBLE AS f1_mean, round(stddev_samp(f1), 6)::DOUBLE AS f1_std, round(min(f1), 6)::DOUBLE AS f1_min, round(max(f1), 6)::DOUBLE AS f1_max, count(*) FILTER (round(f1, 9) > 0) AS wins FROM effects GROUP BY comparison",
    "lopo_split_counts": f"{_E8}, e AS (SELECT patient AS test_group, count(*) AS n, sum(label)::BIGINT AS p FROM labelled GROUP BY patient) SELECT test_group, ((SELECT sum(n) FROM e) - n)::BIGINT AS train_rows, ((SELECT sum(p) FROM e) - p)::BIGINT AS train_positive, n AS test_rows, p AS test_positive FROM e",
    "nested_fold_audit": f"{_E8}, g AS (SELECT DISTINCT patient FROM labelled) SELECT a.patient AS outer_group, b.patient AS inner_group, count(*) AS training_rows, sum(label)::BIGINT AS training_positive, round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6)::DOUBLE AS class_ratio FROM g a, g b, labelled l WHERE a.patient <> b.patient AND l.patient NOT IN (a.patient, b.patient) GROUP BY 1, 2",
    "generalisation_gap": f"{_P}, {_counts('model, seed, patient', 'c1')}, {_counts('model, seed', 'c2')}, m AS (SELECT model, 'by_patient' AS split, CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c1 UNION ALL SELECT model, 'pooled', CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END FROM c2) SELECT model, split, round(avg(f1), 6)::DOUBLE AS f1_mean, round(stddev_samp(f1), 6)::DOUBLE AS f1_std FROM m GROUP BY model, split",
    "robustness_summary": f"{_P} SELECT p.model, p.seed, count(*) AS windows, count(*) FILTER (p.prediction <> c.prediction) AS decision_changes, round(avg(abs(p.score - c.score)), 6)::DOUBLE AS mean_absolute_change, count(*) FILTER (p.prediction <> p.label) AS errors, sum(p.label)::BIGINT AS positive FROM predictions p JOIN predictions c ON p.doc_id = c.doc_id AND p.model = c.model AND c.seed = 42 GROUP BY p.model, p.seed",
    "patient_behaviour": f"{_P} SELECT a.patient, count(*) FILTER (a.prediction <> b.prediction) AS changed, round(avg(abs(a.score - b.score)), 6)::DOUBLE AS mean_abs_change FROM predictions a JOIN predictions b ON a.doc_id = b.doc_id AND a.model = 'alpha' AND b.model = 'beta' AND a.seed = 42 AND b.seed = 42 GROUP BY a.patient",
    "distill_soft_targets": f"{_P}, q AS (SELECT *, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM predictions WHERE model = 'beta') SELECT doc_id, seed, round(1 / (1 + exp(-ln(p / (1 - p)) / 3.0)), 6)::DOUBLE AS soft, (score >= 0.7)::INT AS hard FROM q",
    "trial_summary": f"{_SUMMARY} SELECT unit, noise, trials, valid_trials, invalid_trials, snr_valid_trials, " + ", ".join(f"round({m}, 9)::DOUBLE AS {m}" for m in ('valid_fraction', 'coherence_median', 'coherence_sd', 'snr_mean', 'events_mean', 'clipped_fraction_max')) + " FROM summary",
    "grid_optima": f"{_SUMMARY}, g AS (SELECT unit, noise, min(noise) OVER u AS low, max(noise) OVER u AS high, 'coherence_median' AS metric, round(coherence_median, 9) AS v FROM summary WINDOW u AS (PARTITION BY unit) UNION ALL SELECT unit, noise, min(noise) OVER u, max(noise) OVER u, 'snr_mean', round(snr_mean, 9) FROM summary WINDOW u AS (PARTITION BY unit)) SELECT unit, metric, CASE WHEN v IS NULL THEN NULL ELSE noise END AS noise, v::DOUBLE AS value, CASE WHEN v IS NULL THEN 'no_valid_measurement' WHEN noise IN (low, high) THEN 'boundary_maximum' ELSE 'interior_grid_maximum' END AS status FROM g QUALIFY row_number() OVER (PARTITION BY unit, metric ORDER BY v DESC NULLS LAST, noise) = 1",
    "zero_baseline_delta": f"{_TRIALS} SELECT t.unit, t.trial, t.noise, round(t.coherence - z.coherence, 9)::DOUBLE AS coherence_change FROM trials t LEFT JOIN trials z ON t.unit = z.unit AND t.trial = z.trial AND z.noise = 0",
    "reason_counts": f"{_TRIALS} SELECT noise, CASE WHEN clipped_fraction >= 0.08 THEN 'clipped_dynamics' WHEN NOT valid THEN 'insufficient_intervals' ELSE 'ok' END AS reason, count(*) AS trials FROM trials GROUP BY 1, 2",
    "strict_mean_blocks": f"{_SEEDED}, b AS (SELECT unit, (seed - 1) // 4 AS block, CASE WHEN (unit + seed) % 29 <> 0 THEN value END AS value FROM seeded) SELECT unit, block::INT AS block, round(CASE WHEN count(value) = count(*) AND count(*) = 4 THEN avg(value) END, 9)::DOUBLE AS mean FROM b GROUP BY unit, block",
    "spearman_pairs": f"{_PAIRS} SELECT seed_a, seed_b, units, {_r('rank_correlation')} FROM spearman",
    "spearman_summary": f"{_PAIRS} SELECT round(median(rank_correlation), 6)::DOUBLE AS rank_median, round(min(rank_correlation), 6)::DOUBLE AS rank_min, round(max(rank_correlation), 6)::DOUBLE AS rank_max FROM spearman",
    "within_unit_spread": f"{_SEEDED} SELECT round(median(sd), 6)::DOUBLE AS median_within_sd FROM (SELECT stddev_samp(value) AS sd FROM seeded GROUP BY unit)",
    "split_half_agreement": f"{_HALVES} SELECT count(*) AS pairs, round(avg(abs(x - y)), 6)::DOUBLE AS mean_absolute_difference, round(avg((sign(x - 25.5) = sign(y - 25.5))::INT), 6)::DOUBLE AS sign_agreement FROM halves WHERE x IS NOT NULL AND y IS NOT NULL",
    "driven_control_delta": f"{_HALVES} SELECT unit % 2 AS half, count(x - y) AS pairs, round(avg(x - y), 6)::DOUBLE AS delta_mean, round(median(x - y), 6)::DOUBLE AS delta_median, round(avg(abs(x - y)), 6)::DOUBLE AS delta_abs_mean, round(avg((x - y > 0)::INT), 6)::DOUBLE AS positive_fraction FROM halves GROUP BY 1",
    "timing_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6)::DOUBLE AS median, round(quantile_cont(value, 0.95), 6)::DOUBLE AS p95, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
}

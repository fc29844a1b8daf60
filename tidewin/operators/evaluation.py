"""Evaluation algebra over scored rows (label, score, prediction): exact, grouped, and without Python.

Curves and areas start from counts by distinct score, so ties are one step and repeated scores cost one row.
Running counts are taken in two levels, totals of score bins and sums inside a bin, so that no group has to
stand in one task: the bins' totals are bounded by groups x BINS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .stats import same_keys

BINS = 1024
THRESHOLDS = range(5, 96)  # hundredths
METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")


def confusion_counts(label: str = "label", prediction: str = "prediction") -> list[Column]:
    hit = lambda y, p: F.count_if((F.col(label) == y) & (F.col(prediction) == p))
    return [hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"), F.count(F.lit(1)).alias("windows")]


def rates() -> dict[str, Column]:
    """Columns from tn, fp, fn, tp; a ratio without denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn), "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2}


def confusion(rows: DataFrame, by: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(*by).agg(*confusion_counts(label, prediction)).withColumns(rates())


def steps(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """For each group and distinct score: pos and neg there, tp and fp at or above it, and the group's totals."""
    at = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    at = at.withColumn("_bin", F.floor(F.col("score") * BINS))
    totals = at.groupBy(*by, "_bin").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(*by, "_bin", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_pa"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_na"), F.sum("_p").over(whole).alias("positives"), F.sum("_n").over(whole).alias("negatives"))
    inside = Window.partitionBy(*by, "_bin").orderBy(F.col("score").desc())
    both = at.join(totals, [*by, "_bin"]) if by else at.join(totals, "_bin")
    return both.withColumns({"tp": F.col("_pa") + F.sum("pos").over(inside), "fp": F.col("_na") + F.sum("neg").over(inside)}).drop("_bin", "_pa", "_na")


def areas(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """roc_auc (ties count half; NULL with one class) and step-wise average_precision (NULL without positives)."""
    at = steps(rows, by, label, score)
    below = F.col("negatives") - F.col("fp")
    auc = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    ap = F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    out = at.groupBy(*by).agg(auc.alias("_a"), ap.alias("_b"), F.max("positives").alias("_p"), F.max("negatives").alias("_n"))
    return out.select(*by, ratio(F.col("_a"), F.col("_p") * F.col("_n"), None).alias("roc_auc"), ratio(F.col("_b"), F.col("_p"), None).alias("average_precision"))


def measured(rows: DataFrame, by: list[str], label: str = "label", score: str = "score", prediction: str = "prediction") -> DataFrame:
    """Counts, rates and areas of each group; decisions come from the stored prediction."""
    joined = confusion(rows, by, label, prediction).alias("c").join(areas(rows, by, label, score).alias("a"), on=by, how="left")
    return joined


def pr_curve(rows: DataFrame, by: list[str]) -> DataFrame:
    at = steps(rows, by)
    return at.select(*by, F.col("score").alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall"))


def roc_curve(rows: DataFrame, by: list[str]) -> DataFrame:
    at = steps(rows, by)
    return at.select(*by, F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("negatives")).alias("fpr"), ratio(F.col("tp"), F.col("positives")).alias("tpr"))


def reached(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Positives and rows of each group by the highest hundredth from 0.05 to 0.95 that their score reaches (0.04: none)."""
    low, high = THRESHOLDS[0], THRESHOLDS[-1]
    near = F.floor(F.col(score) * 100)
    reach = reduce(lambda out, k: F.when((near + k) / F.lit(100.0) <= F.col(score), near + k).otherwise(out), (-1, 0, 1), near - 2)
    reach = F.least(F.greatest(reach, F.lit(low - 1)), F.lit(high)).cast("int")
    return rows.groupBy(*by, reach.alias("_k")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count(F.lit(1)).alias("_n"))


def _sweep(counts: DataFrame, by: list[str]) -> DataFrame:
    """F1 at every threshold from `reached` counts: sums over at most 92 rows of a group."""
    low, high = THRESHOLDS[0], THRESHOLDS[-1]
    # Every threshold appears for each group, also where no row ends at it.
    every = counts.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(low - 1), F.lit(high))).alias("_k"))
    filled = every.join(counts, [*by, "_k"], "left").na.fill(0, ["_p", "_n"])
    up = Window.partitionBy(*by).orderBy(F.col("_k").desc())
    tp, called, positives = F.sum("_p").over(up), F.sum("_n").over(up), F.sum("_p").over(Window.partitionBy(*by))
    out = filled.withColumns({"tp": tp, "fp": called - tp, "fn": positives - tp}).where(F.col("_k") >= low)
    return out.select(*by, (F.col("_k") / F.lit(100.0)).alias("threshold"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def threshold_sweep(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """F1 at each hundredth from 0.05 to 0.95, in one pass over the rows."""
    return _sweep(reached(rows, by, label, score), by)


def _first_best(sweep: DataFrame, by: list[str]) -> DataFrame:
    best = sweep.groupBy(*by).agg(F.min(F.struct((-F.col("f1")).alias("minus"), "threshold")).alias("m"))
    return best.select(*by, F.col("m.threshold").alias("threshold"), (-F.col("m.minus")).alias("f1"))


def best_threshold(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first threshold with the greatest F1."""
    return _first_best(threshold_sweep(rows, by), by)


def tuned_thresholds(rows: DataFrame, by: list[str], group: str) -> DataFrame:
    """For each held-out group (test_group) the best threshold over the rows of all the others: the counts of all less
    the group's own, so no row is copied into folds."""
    own = reached(rows, [*by, group])
    whole = own.groupBy(*by, "_k").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    folds_of = own.select(*by, F.col(group).alias("test_group")).distinct()
    all_rows = folds_of.join(whole, by) if by else folds_of.crossJoin(whole)
    mine = own.select(*by, F.col(group).alias("test_group"), "_k", F.col("_p").alias("_mp"), F.col("_n").alias("_mn"))
    left = all_rows.join(mine, [*by, "test_group", "_k"], "left").na.fill(0, ["_mp", "_mn"])
    outside = left.select(*by, "test_group", "_k", (F.col("_p") - F.col("_mp")).alias("_p"), (F.col("_n") - F.col("_mn")).alias("_n"))
    return _first_best(_sweep(outside, [*by, "test_group"]), [*by, "test_group"])


def macro(per_group: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and sample deviation of each metric over the groups' rows, as <metric>_mean and <metric>_std."""
    return per_group.groupBy(*by).agg(*[f(m).alias(f"{m}_{name}") for m in metrics for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def paired_effects(per_group: DataFrame, key: list[str], arm: str, pairs: list[tuple[str, str]], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """For each pair of arms and each key, the first arm's metrics less the second's. One conditional aggregate;
    an arm that is missing or repeated for a key is an error."""
    out = None
    for a, b in pairs:
        one = lambda name, m: F.max(F.when(F.col(arm) == name, F.col(m)))
        whole = (F.count_if(F.col(arm) == a) == 1) & (F.count_if(F.col(arm) == b) == 1)
        fault = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit(f"arms {a} and {b} must each have one row for a key")))
        rows = per_group.where(F.col(arm).isin(a, b)).groupBy(*key).agg(fault.alias("_ok"), *[(one(a, m) - one(b, m)).alias(m) for m in metrics])
        rows = rows.where("_ok").drop("_ok").withColumn("comparison", F.lit(f"{a}-{b}"))
        out = rows if out is None else out.unionByName(rows)
    return out


def seed_averaged(effects: DataFrame, group: list[str], seeds: str, metrics: tuple[str, ...]) -> DataFrame:
    """Means over seeds within each group first, so seeds don't add to the number of groups."""
    return effects.groupBy(*group).agg(F.countDistinct(seeds).alias("seeds"), *[F.avg(m).alias(m) for m in metrics])


def fold_counts(rows: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Rows and positives in train and test of each fold, from totals: no row is copied."""
    each = rows.groupBy(F.col(group).alias("test_group")).agg(F.count(F.lit(1)).alias("test_rows"), F.sum(label).alias("test_positive"))
    total = rows.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))  # one row
    return each.crossJoin(F.broadcast(total)).select("test_group", (F.col("_n") - F.col("test_rows")).alias("train_rows"), (F.col("_p") - F.col("test_positive")).alias("train_positive"), "test_rows", "test_positive")


def nested_folds(rows: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Training rows, positives and class ratio for every (outer, inner) pair of held-out groups."""
    each = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    total = each.agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    a, b = each.alias("a"), each.alias("b")
    # Groups, not rows, are paired here.
    pairs = a.join(b, F.col(f"a.{group}") != F.col(f"b.{group}")).crossJoin(F.broadcast(total))
    n, p = F.col("_n") - F.col("a.n") - F.col("b.n"), F.col("_p") - F.col("a.p") - F.col("b.p")
    return pairs.select(F.col(f"a.{group}").alias("outer_group"), F.col(f"b.{group}").alias("inner_group"), n.alias("training_rows"), p.alias("training_positive"), ratio(n - p, p, None).alias("class_ratio"))


def stratified_split(rows: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """part = test for exactly round(test_share * n) rows of each label, those with the least hashes of (seed, key);
    of equal hashes the smaller key. Rows of one key share a part if they fall on one side of the cut.

    Hashes are uniform, so they are binned by their leading bits: bins are summed and rows are ranked inside their
    bin, and no label is gathered in a task.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")
    at = rows.withColumn("_h", h).withColumn("_bin", F.shiftright("_h", 36))  # 4,096 bins
    below = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = at.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    bins = bins.select(label, "_bin", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    nth = F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_h", key))
    placed = same_keys(at, bins, [label, "_bin"]).withColumn("_nth", F.col("_before") + nth)
    part = F.when(F.col("_nth") <= F.round(F.col("_all") * test_share), "test").otherwise("train")
    return placed.withColumn("part", part).drop("_h", "_bin", "_before", "_all", "_nth")


def robustness(rows: DataFrame, by: list[str]) -> DataFrame:
    """Decision changes, mean absolute change of the score and errors against the clean rows' columns."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("prediction") != F.col("clean_prediction")).alias("decision_changes"), F.avg(F.abs(F.col("score") - F.col("clean_score"))).alias("mean_absolute_change"), F.count_if(F.col("prediction") != F.col("label")).alias("errors"), F.sum("label").alias("positive"))


def feature_changes(long: DataFrame, clean: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Mean absolute change of each feature against its clean value, and the mean absolute clean value, by `by`."""
    both = long.join(clean.select(*keys, "feature", F.col("value").alias("_clean")), [*keys, "feature"])
    return both.groupBy(*by, "feature").agg(F.avg(F.abs(F.col("value") - F.col("_clean"))).alias("mean_absolute_change"), F.avg(F.abs("_clean")).alias("mean_clean_absolute_value"))

"""Statistics over trials, seeds and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, first_reason, ratio, strict_mean
from ..sources.shared import stage


CUTS = [i / 64 for i in range(1, 64)]


def same_keys(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join in which NULL keys are equal; the left side's keys are kept. Without keys the right side is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by])
    return left.join(right, on, how).drop(*[f"_right_{c}" for c in by])


def binned(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, _n, _total, _bin, _before, _upto): distinct values with their number, the group's number of values, and
    how many values stand in earlier bins, and up to and with them in their own.

    Values fall into bins between a group's approximate quantiles, bins are summed (at most 64 for a group), and
    values are counted inside their bin, so no group stands in a task. The approximate quantiles go by the order in which
    parts arrive, so they are stored (at most 63 for a group): bins and values must be dealt by the same ones.
    """
    at = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = stage(rows.groupBy(*by).agg(F.percentile_approx(value, CUTS, 1000).alias("_cuts"), F.count(value).alias("_total")), "cuts")
    at = same_keys(at, cuts, by).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
    below = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = at.groupBy(*by, "_bin").agg(F.sum("_n").alias("_m")).select(*by, "_bin", F.coalesce(F.sum("_m").over(below), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bin").orderBy(value)
    return same_keys(at, bins, [*by, "_bin"]).withColumn("_upto", F.sum("_n").over(inside))


def quantiles(rows: DataFrame, by: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """For each group the exact quantiles of the non-NULL values, on straight lines between neighbours, as columns of
    these names; a group without a value has no row."""
    at = binned(rows.where(F.col(value).isNotNull()), by, value)
    last = F.col("_before") + F.col("_upto") - 1  # places from 0 of a value's first and last row
    first = last - F.col("_n") + 1
    at = at.withColumns({"_first": first, "_last": last})
    sums = []
    for name, q in named.items():
        place = (F.col("_total") - 1) * q
        for side, nearest in (("low", F.floor(place)), ("high", F.ceil(place))):
            sums.append(F.max(F.when((F.col("_first") <= nearest) & (nearest <= F.col("_last")), F.col(value))).alias(f"_{side}_{name}"))
    found = at.groupBy(*by, "_total").agg(*sums)

    def between(name: str, q: float) -> Column:
        place = (F.col("_total") - 1) * q
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return found.select(*by, *[between(name, q) for name, q in named.items()])


def with_median(summary: DataFrame, rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """A group's summary with the median of a value; NULL where there is none."""
    medians = quantiles(rows.withColumn("_value", value), by, "_value", {name: 0.5})
    # Without keys an empty table still has its one row.
    return same_keys(summary, medians if by else medians.agg(F.max(name).alias(name)), by, "left")


def regularity(events: DataFrame, by: list[str], at: str, least: int = 5, ddof: int = 1, shortest: float = 0.0) -> DataFrame:
    """Deviation over mean (cv) of the gaps between a group's events, its inverse (coherence), and whether
    there are enough gaps; gaps under `shortest` are counted and left out."""
    if least < 2 or ddof not in (0, 1) or shortest < 0:
        raise ValueError("least >= 2, ddof 0 or 1 and shortest >= 0 are needed")
    gap = F.lead(at).over(Window.partitionBy(*by).orderBy(at)) - F.col(at)
    kept = F.when(F.col("_gap") >= shortest, F.col("_gap"))
    sd = F.stddev_samp(kept) if ddof else F.stddev_pop(kept)
    rows = events.withColumn("_gap", gap).groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.count(kept).alias("intervals"), F.count_if(F.col("_gap") < shortest).alias("discarded"), F.avg(kept).alias("_mean"), sd.alias("_sd"))
    few = F.col("intervals") < least
    reason = first_reason((few, "insufficient_intervals"), (F.col("_sd") == 0, "zero_cv_unbounded"))
    cv = F.when(~few, F.round(ratio(F.col("_sd"), F.col("_mean"), None), 6))
    out = rows.withColumns({"cv": cv, "coherence": F.when(~few & (F.col("_sd") > 0), F.round(ratio(F.col("_mean"), F.col("_sd"), None), 6)), "reason": reason})
    return out.withColumn("valid", F.col("reason") == "ok").drop("_mean", "_sd")


def trial_summary(trials: DataFrame, by: list[str]) -> DataFrame:
    """Counts of all, valid and invalid trials, and statistics of the valid ones only; NULL keys are groups."""
    good = F.col("valid") & finite("coherence")
    value, snr = F.when(good, F.col("coherence")), F.when(finite("snr_db"), F.col("snr_db"))
    n = F.count(F.lit(1))
    summary = trials.groupBy(*by).agg(
        n.alias("trials"), F.count_if(good).alias("valid_trials"), F.count_if(~good).alias("invalid_trials"), (F.count_if(good) / n).alias("valid_fraction"),
        F.stddev_samp(value).alias("coherence_sd"), F.avg(snr).alias("snr_mean"), F.count(snr).alias("snr_valid_trials"),
        F.avg("events").alias("events_mean"), F.max("clipped_fraction").alias("clipped_fraction_max"),
    )
    return with_median(summary, trials, by, value, "coherence_median")


def grid_optima(summary: DataFrame, by: list[str], level: str, metric: str) -> DataFrame:
    """The level with the greatest metric (ties: the lowest level) and whether it is at the grid's edge."""
    ok = finite(metric)
    best = F.min(F.when(ok, F.struct((-F.col(metric)).alias("minus"), F.col(level).alias("level"))))
    rows = summary.groupBy(*by).agg(best.alias("m"), F.min(level).alias("_low"), F.max(level).alias("_high"))
    edge = (F.col("m.level") == F.col("_low")) | (F.col("m.level") == F.col("_high"))
    status = F.when(F.col("m").isNull(), "no_valid_measurement").when(edge, "boundary_maximum").otherwise("interior_grid_maximum")
    return rows.select(*by, F.lit(metric).alias("metric"), F.col("m.level").alias(level), (-F.col("m.minus")).alias("value"), status.alias("status"))


def less_baseline(trials: DataFrame, by: list[str], level: str, values: list[str], baseline: float = 0.0) -> DataFrame:
    """Each row's values less those of the same trial at the baseline level. One window by trial: the baseline is
    looked up without a self-join, and a trial holds only the grid's levels."""
    trial = Window.partitionBy(*by)
    return trials.withColumns({f"{v}_change": F.col(v) - F.max(F.when(F.col(level) == baseline, F.col(v))).over(trial) for v in values})


def block_means(rows: DataFrame, by: list[str], seed: str, value: str, block: Column, members: int) -> DataFrame:
    """Strict means over blocks of seeds: NULL unless all `members` values of a block are there and finite."""
    return rows.groupBy(*by, block.alias("block")).agg(strict_mean(F.col(value), members).alias("mean"))


def ranked(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rows with their rank from 1 in the group, equal values sharing the mean of their places (see binned)."""
    place = F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2
    ranks = binned(rows, by, value).select(*by, value, place.alias(name))
    return rows.join(ranks, [*by, value])


def spearman_pairs(rows: DataFrame, unit: list[str], seed: str, value: str) -> DataFrame:
    """Spearman's correlation over the shared units for every pair of seeds. Seeds pair within a unit, and a
    unit has one row for each seed, so the join grows with units x seeds^2; ranks are taken by pair, over the units that
    both seeds have."""
    a = rows.where(F.col(value).isNotNull()).select(*unit, F.col(seed).alias("seed_a"), F.col(value).alias("x"))
    b = a.withColumnsRenamed({"seed_a": "seed_b", "x": "y"})
    pairs = a.join(b, unit).where("seed_a < seed_b")
    by = ["seed_a", "seed_b"]
    both = ranked(ranked(pairs, by, "x", "rx"), by, "y", "ry")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.corr("rx", "ry").alias("rank_correlation"))


def agreement(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Of two columns: rows with both, mean absolute difference and share of equal signs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return rows.where(both).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mean_absolute_difference"), F.avg((F.signum(x) == F.signum(y)).cast("double")).alias("sign_agreement"))


def deltas(rows: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """Statistics of a - b over the rows where it is finite."""
    d = F.when(finite(a - b), a - b)
    summary = rows.groupBy(*by).agg(F.count(d).alias("pairs"), F.avg(d).alias("delta_mean"), F.avg(F.abs(d)).alias("delta_abs_mean"), F.avg((d > 0).cast("double")).alias("positive_fraction"))
    return with_median(summary, rows, by, d, "delta_median")

"""Measures of signals without Python: array expressions on rows, and mergeable summaries of panes for overlapping windows.

A row holds a signal's samples as an array. A signal that is NULL, shorter than two samples or not finite has NULL
results, as in `features`. All folds run inside the row, in the JVM and without a shuffle; only windows of panes
group, and what they group are summaries of some twenty numbers, not samples.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = ("mean", "std", "rms", "ptp", "line_length")
HJORTH = ("activity", "mobility", "complexity")


def usable(samples: Column) -> Column:
    """The samples as doubles, or NULL for a signal that can't be measured."""
    x = samples.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.when((F.size(x) >= 2) & finite, x)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def variance(x: Column) -> Column:
    """Of the whole: the mean stands in the fold's state, so it is computed once."""
    start = F.struct(F.lit(0.0).alias("s"), mean(x).alias("m"))
    return F.aggregate(x, start, lambda a, v: F.struct((a["s"] + (v - a["m"]) * (v - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["s"]) / F.size(x)


def steps(x: Column) -> Column:
    """Differences of neighbours."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(2), n), F.slice(x, F.lit(1), n), lambda b, a: b - a)


def over(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is not positive."""
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0.0))).otherwise(F.when(bottom.isNotNull(), F.lit(0.0)))


def _with_arrays(rows: DataFrame, keep: list[str], samples: str) -> DataFrame:
    out = rows.select(*keep, usable(F.col(samples)).alias("_x"))
    return out.withColumn("_d", steps(F.col("_x"))).withColumn("_e", steps(F.col("_d")))


def time_features(rows: DataFrame, keep: list[str], samples: str) -> DataFrame:
    """mean, std, rms, ptp and line_length of each row's signal."""
    x = F.col("_x")
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    length = F.aggregate("_d", F.lit(0.0), lambda a, v: a + F.abs(v))
    # A NULL array has size -1: its results are NULL by the sums.
    return _with_arrays(rows, keep, samples).select(*keep, mean(x).alias("mean"), F.sqrt(variance(x)).alias("std"), F.sqrt(squares).alias("rms"), (F.array_max(x) - F.array_min(x)).alias("ptp"), length.alias("line_length"))


def hjorth_features(rows: DataFrame, keep: list[str], samples: str) -> DataFrame:
    """activity, mobility and complexity; 0 where a variance below the bar is 0. Two samples have one step, of no
    variance."""
    second = F.when(F.size("_e") > 0, variance(F.col("_e"))).when(F.col("_e").isNotNull(), F.lit(0.0))
    out = _with_arrays(rows, keep, samples).select(*keep, variance(F.col("_x")).alias("_v0"), variance(F.col("_d")).alias("_v1"), second.alias("_v2"))
    return _hjorth(out, keep)


def _hjorth(rows: DataFrame, keep: list[str]) -> DataFrame:
    mobility, step = F.sqrt(over(F.col("_v1"), F.col("_v0"))), F.sqrt(over(F.col("_v2"), F.col("_v1")))
    return rows.select(*keep, F.col("_v0").alias("activity"), mobility.alias("mobility"), over(step, mobility).alias("complexity"))


def permutation_entropy(rows: DataFrame, keep: list[str], samples: str) -> DataFrame:
    """perm: the entropy of the orders of three neighbours (equal values in order of time) over log2 6; NULL for fewer
    than three samples."""
    x, n = F.col("_x"), F.size("_x") - 2
    at = lambda k: F.slice(x, F.lit(k), F.greatest(n, F.lit(0)))
    triples = F.arrays_zip(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    code = F.transform(triples, lambda t: (t["b"] < t["a"]).cast("int") + 2 * (t["c"] < t["a"]).cast("int") + 4 * (t["c"] < t["b"]).cast("int"))
    # One pass over the codes; 2 and 5 contradict themselves.
    counts = F.aggregate(code, F.array(*[F.lit(0)] * 8), lambda a, v: F.transform(a, lambda m, k: m + (k == v).cast("int")))
    shares = F.transform(F.filter(counts, lambda m: m > 0), lambda m: m / F.col("_n"))
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)) / math.log2(6)
    out = rows.select(*keep, usable(F.col(samples)).alias("_x")).withColumn("_n", F.when(n > 0, n))
    return out.select(*keep, F.when(F.col("_n").isNotNull(), entropy).alias("perm"))


def standardised(rows: DataFrame, keep: list[str], samples: str) -> DataFrame:
    """samples with zero mean and unit deviation; zeros for a constant signal."""
    out = rows.select(*keep, usable(F.col(samples)).alias("_x")).withColumns({"_m": mean(F.col("_x")), "_s": F.sqrt(variance(F.col("_x")))})
    return out.select(*keep, F.transform("_x", lambda v: over(v - F.col("_m"), F.col("_s"))).alias("samples"))


def kept_every(samples: Column, factor: int) -> Column:
    return F.filter(samples, lambda _, i: i % factor == 0)


def low_passed(samples: Column, factor: int) -> Column:
    """Every factor-th sample after a Kaiser-windowed low-pass (beta 5, ten periods each side), zeros beyond the ends."""
    if factor == 1:
        return samples
    half = 10 * factor
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / factor) * np.kaiser(2 * half + 1, 5.0)
    held = F.array(*[F.lit(float(t)) for t in taps / taps.sum()])
    last = F.size(samples) - 1
    near = lambda k: F.sequence(F.greatest(k - half, F.lit(0)), F.least(k + half, last))
    value = lambda k: F.aggregate(near(k), F.lit(0.0), lambda a, j: a + F.get(samples, j) * F.get(held, k - j + half))
    return F.transform(F.sequence(F.lit(0), last, F.lit(factor)), value)


def reconstructed(rows: DataFrame, keep: list[str], samples: str, factor: int, antialiased: bool = False) -> DataFrame:
    """samples, and y: the signal from every factor-th sample of itself, or of its low-pass: straight lines between the
    kept samples, and the last one held to the end."""
    if factor < 1:
        raise ValueError("a whole factor of at least 1 is needed")
    x = F.col("_x")
    out = rows.select(*keep, usable(F.col(samples)).alias("_x")).withColumn("_k", low_passed(x, factor) if antialiased else kept_every(x, factor))

    def line(_: Column, i: Column) -> Column:
        whole = F.floor(i / factor).cast("int")
        here = F.get(F.col("_k"), whole)
        return here + (F.coalesce(F.get(F.col("_k"), whole + 1), here) - here) * ((i % factor) / F.lit(float(factor)))

    return out.select(*keep, x.alias("samples"), F.transform("_x", line).alias("y"))


def preservation(rows: DataFrame, keep: list[str], x: str = "samples", y: str = "y") -> DataFrame:
    """What y keeps of x: rmse, rmse over x's deviation and correlation; NULL where a deviation is 0."""
    out = rows.select(*keep, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumns({"_n": F.size("_x"), "_sx": F.sqrt(variance(F.col("_x"))), "_sy": F.sqrt(variance(F.col("_y"))), "_mx": mean(F.col("_x")), "_my": mean(F.col("_y"))})
    pairs = F.arrays_zip(F.col("_x").alias("a"), F.col("_y").alias("b"))
    rmse = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - p["b"]) * (p["a"] - p["b"])) / F.col("_n"))
    both = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - F.col("_mx")) * (p["b"] - F.col("_my"))) / F.col("_n")
    out = out.select(*keep, rmse.alias("rmse"), both.alias("_xy"), "_sx", "_sy")
    return out.select(*keep, "rmse", (F.col("rmse") / F.nullif("_sx", F.lit(0.0))).alias("normalized_rmse"), (F.col("_xy") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0))).alias("correlation"))


# -- panes -----------------------------------------------------------------------------------------------------


def _moments(x: Column) -> Column:
    """Number, mean and sum of squares about the mean."""
    n = F.size(x)
    return F.struct(n.cast("double").alias("n"), F.when(n > 0, mean(x)).otherwise(0.0).alias("m"), F.when(n > 0, variance(x) * n).otherwise(0.0).alias("q"))


def pane_summaries(panes: DataFrame, by: list[str], pane: str, samples: str) -> DataFrame:
    """by.., pane and a summary of each pane's samples, of which there must be two or more, all finite: moments of the samples
    and of their first and second steps, extremes, the length of the line, and two samples at either end."""
    fault = F.raise_error(F.concat(F.lit("a pane needs two samples or more, all finite: pane "), F.col(pane).cast("string")))
    x = F.when(usable(F.col(samples)).isNotNull(), usable(F.col(samples))).otherwise(fault.cast("array<double>"))
    rows = panes.select(*by, F.col(pane).cast("long").alias("pane"), x.alias("_x")).withColumn("_d", steps(F.col("_x"))).withColumn("_e", steps(F.col("_d")))
    ends = [F.element_at("_x", k).alias(name) for k, name in ((1, "a0"), (2, "a1"), (-2, "z1"), (-1, "z0"))]
    length = F.aggregate("_d", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("length")
    return rows.select(*by, "pane", F.struct(_moments(F.col("_x")).alias("x"), _moments(F.col("_d")).alias("d"), _moments(F.col("_e")).alias("e"), F.array_min("_x").alias("low"), F.array_max("_x").alias("high"), length, *ends).alias("s"))


def _merged(parts: Column) -> Column:
    """Moments of the union of parts."""
    n = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"])
    start = F.struct(F.lit(0.0).alias("q"), (F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"] * p["m"]) / F.nullif(n, F.lit(0.0))).alias("m"))
    found = F.aggregate(parts, start, lambda a, p: F.struct((a["q"] + p["q"] + p["n"] * (p["m"] - a["m"]) * (p["m"] - a["m"])).alias("q"), a["m"].alias("m")))
    return F.struct(n.alias("n"), found["m"].alias("m"), found["q"].alias("q"))


def window_measures(summaries: DataFrame, by: list[str], panes: int, step: int) -> DataFrame:
    """by.., window, and the time and Hjorth measures of every complete window of `panes` panes, one at every `step` panes:
    what a window needs of its samples is merged from its panes' summaries and from the steps across their borders,
    so each sample is read once, however much windows overlap."""
    if panes < 1 or step < 1:
        raise ValueError("windows need panes, and a step")
    first = F.greatest(F.ceil((F.col("pane") - panes + 1) / step), F.lit(0))
    last = F.floor(F.col("pane") / step)
    each = summaries.withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    held = each.groupBy(*by, "window").agg(F.sort_array(F.collect_list(F.struct("pane", "s"))).alias("p")).where(F.size("p") == panes)
    held = held.select(*by, "window", F.transform("p", lambda x: x["s"]).alias("s"))
    borders = F.zip_with(F.slice("s", 1, panes - 1), F.slice("s", 2, panes - 1), lambda a, b: F.struct((a["z0"] - a["z1"]).alias("l"), (b["a0"] - a["z0"]).alias("c"), (b["a1"] - b["a0"]).alias("r"))) if panes > 1 else F.expr("cast(array() as array<struct<l: double, c: double, r: double>>)")
    held = held.withColumn("_b", borders)
    one = lambda v: F.struct(F.lit(1.0).alias("n"), v.alias("m"), F.lit(0.0).alias("q"))
    parts = {
        "x": F.transform("s", lambda s: s["x"]),
        "d": F.concat(F.transform("s", lambda s: s["d"]), F.transform("_b", lambda b: one(b["c"]))),
        "e": F.concat(F.transform("s", lambda s: s["e"]), F.transform("_b", lambda b: one(b["c"] - b["l"])), F.transform("_b", lambda b: one(b["r"] - b["c"]))),
    }
    held = held.withColumns({f"_{k}": _merged(v) for k, v in parts.items()})
    length = F.aggregate("s", F.lit(0.0), lambda a, s: a + s["length"]) + F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.abs(b["c"]))
    spread = lambda k: F.coalesce(F.col(f"_{k}.q") / F.nullif(F.col(f"_{k}.n"), F.lit(0.0)), F.lit(0.0))
    rms = F.sqrt(spread("x") + F.col("_x.m") * F.col("_x.m"))
    ptp = F.array_max(F.transform("s", lambda s: s["high"])) - F.array_min(F.transform("s", lambda s: s["low"]))
    keep = [*by, "window"]
    out = held.select(*keep, F.col("_x.m").alias("mean"), F.sqrt(spread("x")).alias("std"), rms.alias("rms"), ptp.alias("ptp"), length.alias("line_length"), spread("x").alias("_v0"), spread("d").alias("_v1"), spread("e").alias("_v2"))
    return _hjorth(out, [*keep, *TIME])

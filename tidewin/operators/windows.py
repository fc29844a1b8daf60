"""Windows over recordings: cutting, labelling by overlap, contexts, islands and picks by position.

Recordings are rows of (patient, file, sfreq, n_samples); times are seconds from the recording's start.
All operators are joins, windows by recording or aggregates, so their cost grows with the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_reason

RECORDING = ["patient", "file"]
KEYS = [*RECORDING, "start_sec", "end_sec"]
OVERLAP = 0.5


def window_size(seconds: float, sfreq: float) -> int:
    """Samples in a window; an error unless the duration is a whole number of them."""
    size = round(seconds * sfreq)
    if size <= 0 or abs(size / sfreq - seconds) > 1e-8 + 1e-5 * seconds:
        raise ValueError("a window must hold a whole number of samples")
    return size


def tumbling(recordings: DataFrame, seconds: float, sfreq: float) -> DataFrame:
    """Complete windows by sample count; an incomplete tail gives none."""
    size = window_size(seconds, sfreq)
    full = recordings.where(F.col("n_samples") >= size)
    starts = full.select(*RECORDING, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - size, F.lit(size).cast("long"))).alias("start_sample"))
    return starts.select(*RECORDING, "start_sample", (F.col("start_sample") + size).alias("end_sample"), (F.col("start_sample") / sfreq).alias("start_sec"), ((F.col("start_sample") + size) / sfreq).alias("end_sec"))


def sliding(recordings: DataFrame, seconds: float, overlap: float, duration: str = "duration_sec") -> DataFrame:
    """Windows of `seconds` that start every seconds * (1 - overlap) and end within the duration."""
    if seconds <= 0 or not 0 <= overlap < 1:
        raise ValueError("a window needs a positive duration and an overlap in [0, 1)")
    step = seconds * (1 - overlap)
    last = F.floor((F.col(duration) - seconds) / step + F.lit(1e-9)).cast("long")
    rows = recordings.where(F.col(duration) >= seconds).select(*RECORDING, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    return rows.select(*RECORDING, (F.col("k") * step).alias("start_sec"), (F.col("k") * step + seconds).alias("end_sec"))


def _shift(x: Column, bits: Column) -> Column:
    """x / 2 ** bits, rounded down."""
    return F.call_function("shiftright", x, bits.cast("int"))


def cover(start: Column, end: Column, seconds: float) -> Column:
    """The dyadic nodes (level, node) that make up the multiples of `seconds` which [start, end) touches: a node of
    level k stands for 2 ** k multiples from node * 2 ** k on. Any interval needs at most two nodes of each level, so
    their number is logarithmic in its length."""
    first = F.floor(start / seconds)
    stop = F.greatest(first + 1, F.ceil(end / seconds))

    def level(k: Column) -> Column:
        left, right = -_shift(-first, k), _shift(stop, k)  # whole nodes of this level inside: left to right
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        node = lambda n: F.struct(k.cast("int").alias("level"), n.alias("node"))
        return F.array(F.when(odd(left) & (left < right), node(left)), F.when(odd(right) & (left + left.bitwiseAND(F.lit(1)) < right), node(right - 1)))

    levels = F.sequence(F.lit(0), F.ceil(F.log2((stop - first).cast("double"))).cast("int") + 1)
    return F.filter(F.flatten(F.transform(levels, level)), lambda x: x.isNotNull())


def _met(rows: DataFrame, intervals: DataFrame, seconds: float, start: str, end: str, how: str = "left") -> DataFrame:
    """`rows`, cut at multiples of `seconds`, with each of the recording's intervals (_a, _b) that covers some of the same
    multiple, and _shared, the seconds that both have within it.

    Intervals are covered by dyadic nodes, so one of any length costs its logarithm; a row's multiples look for the nodes
    above them, at the levels that the intervals have. Sides meet on (recording, node), so a recording with many rows and
    many intervals costs their sum and not their product. Rows should be no longer than some multiples."""
    first = F.floor(F.col(start) / seconds)
    w = rows.withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col(end) / seconds) - 1))))
    i = intervals.where("end_sec > start_sec").select(*RECORDING, F.col("start_sec").alias("_a"), F.col("end_sec").alias("_b"), F.explode(cover(F.col("start_sec"), F.col("end_sec"), seconds)).alias("_i"))
    levels = i.agg(F.collect_set("_i.level").alias("_levels"))  # one row
    i = i.select(*RECORDING, "_a", "_b", F.col("_i.level").alias("_level"), F.col("_i.node").alias("_node"))
    w = w.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode_outer("_levels")).withColumn("_node", _shift(F.col("_cell"), F.col("_level"))).drop("_levels")
    low = F.greatest(F.col(start), F.col("_a"), F.col("_cell") * seconds)
    high = F.least(F.col(end), F.col("_b"), (F.col("_cell") + 1) * seconds)
    shared = F.when(F.col("_a").isNotNull(), F.greatest(high - low, F.lit(0.0))).otherwise(0.0)
    return w.join(i, [*RECORDING, "_level", "_node"], how).withColumn("_shared", shared).drop("_cell", "_level", "_node")


def overlap_seconds(windows: DataFrame, intervals: DataFrame, seconds: float, name: str = "overlap_sec", start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """`windows` with the seconds that the recording's intervals (start_sec, end_sec) cover of each, summed over
    multiples of `seconds` (see _met). Equal windows are measured once and come out as often as they went in."""
    once = windows.groupBy(*windows.columns).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    over = _met(once, intervals, seconds, start, end).groupBy(*windows.columns, "_copies").agg(F.sum("_shared").alias(name))
    return over.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy")


def labelled(windows: DataFrame, intervals: DataFrame, seconds: float, threshold: float = OVERLAP) -> DataFrame:
    """Windows with overlap_sec, label (1 if the overlap is at least `threshold` of the window) and mixed."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    length = F.col("end_sec") - F.col("start_sec")
    over = overlap_seconds(windows, intervals, seconds)
    return over.withColumns({"label": (F.col("overlap_sec") / length >= threshold).cast("int"), "mixed": (F.col("overlap_sec") > 0) & (F.col("overlap_sec") < length)})


def interval_faults(intervals: DataFrame, recordings: DataFrame) -> DataFrame:
    """Intervals that are empty, leave [0, duration] or overlap the one before, with the reason."""
    order = Window.partitionBy(*RECORDING).orderBy("start_sec", "end_sec")
    rows = intervals.withColumn("_before", F.lag("end_sec").over(order)).join(recordings.select(*RECORDING, (F.col("n_samples") / F.col("sfreq")).alias("_duration")), RECORDING, "left")
    reason = first_reason(
        (F.col("_duration").isNull(), "unknown_recording"),
        (F.col("start_sec") < 0, "before_start"),
        (F.col("end_sec") <= F.col("start_sec"), "empty"),
        (F.col("end_sec") > F.col("_duration"), "after_end"),
        (F.coalesce(F.col("start_sec") < F.col("_before"), F.lit(False)), "overlapping"),
    )
    return rows.withColumn("reason", reason).where("reason <> 'ok'").drop("_before", "_duration")


def contexts(windows: DataFrame, recordings: DataFrame, mode: str, before: float, after: float, sfreq: float) -> DataFrame:
    """Windows with the stretch [start - before, end + after) around them and why it is unusable, if so: a
    context is never moved, padded or taken from another recording. `before` may exceed the window
    (trailing contexts end with it, so after = 0 and before counts from the window's start)."""
    size = window_size(before + after, sfreq)
    rows = windows.join(recordings.select(*RECORDING, "n_samples"), RECORDING)
    a, b = F.col("start_sec") - before, F.col("end_sec") + after
    start, stop = F.bround(a * sfreq).cast("long"), F.bround(b * sfreq).cast("long")
    reason = first_reason((start < 0, "recording_start"), (stop > F.col("n_samples"), "recording_end"))
    out = rows.withColumns({"mode": F.lit(mode), "context_start": start, "context_stop": stop, "context_reason": reason})
    return out.withColumn("context_size", F.lit(size).cast("long")).drop("n_samples")


#: Windows of a recording meet in cells of an hour.
CELL_SEC = 3600.0


def islands(scored: DataFrame, least_windows: int = 2, cell_sec: float = CELL_SEC) -> DataFrame:
    """Events: runs of positive windows whose start meets the end of the window before, by recording.

    Ends and starts meet within 1e-8 + 1e-5 * |end|. Windows that are not positive break a run, and so does a
    recording's end. Runs are found inside cells of time and numbered on through cells, so a recording with a third of
    all windows is spread over its hours; a cell's length changes no result.
    """
    by, cell = RECORDING, [*RECORDING, "_cell"]
    order, along = Window.partitionBy(*cell).orderBy("start_sec", "end_sec"), Window.partitionBy(*by).orderBy("_cell")
    meets = lambda before, end, start: F.coalesce((before == 1) & (F.abs(start - end) <= 1e-8 + 1e-5 * F.abs(end)), F.lit(False))
    rows = scored.select(*by, "start_sec", "end_sec", "prediction", F.floor(F.col("start_sec") / cell_sec).alias("_cell"))
    goes_on = meets(F.lag("prediction").over(order), F.lag("end_sec").over(order), F.col("start_sec"))
    # Whether a cell's first window opens a run is settled between cells.
    rows = rows.withColumn("_fresh", F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise((~goes_on).cast("int")).cast("long"))
    rows = rows.withColumn("_nth", F.sum("_fresh").over(order))
    cells = rows.groupBy(*cell).agg(F.min("start_sec").alias("_start"), F.max(F.struct("start_sec", "end_sec", "prediction")).alias("_last"), F.sum("_fresh").alias("_n"))
    before = F.lag("_last").over(along)  # a recording's hours, not its windows
    cells = cells.withColumn("_opens", (~meets(before["prediction"], before["end_sec"], F.col("_start"))).cast("long"))
    cells = cells.select(*cell, (F.sum(F.col("_opens") + F.col("_n")).over(along) - F.col("_n")).alias("_base"))
    runs = rows.where("prediction = 1").join(cells, cell).withColumn("_run", F.col("_base") + F.col("_nth"))
    events = runs.groupBy(*by, "_run").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count(F.lit(1)).alias("windows"))
    return events.withColumn("sustained", F.col("windows") >= least_windows).drop("_run")


def event_coverage(intervals: DataFrame, windows: DataFrame, seconds: float = 16.0) -> DataFrame:
    """For each interval: whether a positive window meets it, the seconds covered by positive windows, and
    how long after its start the first of them ends. Windows are cut at multiples of `seconds`, any length of which
    gives the same result."""
    key = [*RECORDING, "start_sec", "end_sec"]
    met = _met(windows.where("label = 1").select(*key), intervals.select(*key).distinct(), seconds, "start_sec", "end_sec", "inner").where("_shared > 0")
    found = met.groupBy(*RECORDING, F.col("_a").alias("start_sec"), F.col("_b").alias("end_sec")).agg(F.sum("_shared").alias("covered_sec"), F.min(met["end_sec"]).alias("_first"))
    rows = intervals.join(found, key, "left")
    return rows.select(*key, F.col("_first").isNotNull().alias("represented"), F.coalesce("covered_sec", F.lit(0.0)).alias("covered_sec"), (F.col("_first") - F.col("start_sec")).alias("delay_sec"))


def zscores(rows: DataFrame, by: list[str], columns: list[str], floor: float = 1e-8) -> DataFrame:
    """Columns less their group's mean over its sample deviation; a deviation of zero counts as `floor`."""
    stats = rows.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
    stats = stats.withColumnsRenamed({c: f"_by_{c}" for c in by})
    # Groups are joined to their statistics instead of being gathered: a group may hold any share of the rows.
    both = rows.join(stats, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]))

    def z(c: str) -> Column:
        sd = F.col(f"_s_{c}")
        return (F.col(c) - F.col(f"_m_{c}")) / F.when(sd == 0, F.lit(floor)).otherwise(sd)

    return both.select(*[z(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def first_rows(rows: DataFrame, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def first_middle_last(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows 0, n // 2 and n - 1 of each group."""
    nth, n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*by))
    return rows.withColumns({"_nth": nth, "_n": n}).where("_nth = 0 or _nth = floor(_n / 2) or _nth = _n - 1").drop("_nth", "_n")


def at_fractions(rows: DataFrame, by: list[str], order: str, fractions: tuple[float, ...]) -> DataFrame:
    """The rows of each group that stand at round((n - 1) * fraction), halves to even."""
    nth, n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*by))
    wanted = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.bround((F.col("_n") - 1) * f).cast("int").alias("at")) for f in fractions]))
    return rows.withColumns({"_nth": nth, "_n": n}).withColumn("_w", wanted).where("_nth = _w.at").withColumn("fraction", F.col("_w.fraction")).drop("_nth", "_n", "_w")


def nearest_disjoint(contexts: DataFrame, used: DataFrame, targets: DataFrame, seconds: float = 16.0) -> DataFrame:
    """For each target (recording, fraction, target_sec) the context nearest to it that overlaps neither a
    used stretch nor the choice for a smaller fraction; ties go to the earlier one. Contexts and used stretches
    meet in multiples of `seconds`, any length of which gives the same result.

    Fractions are few and taken in turn, each a join, so no recording is gathered in a task.
    """
    span = [*RECORDING, "context_start_sec", "context_end_sec"]
    taken = _met(contexts.select(*span).distinct(), used.select(*RECORDING, "start_sec", "end_sec"), seconds, "context_start_sec", "context_end_sec", "inner")
    free = contexts.join(taken.where("_shared > 0").select(*span).distinct(), span, "left_anti")
    fractions = [r.fraction for r in targets.select("fraction").distinct().orderBy("fraction").collect()]
    chosen = None
    for f in fractions:
        near = free.join(targets.where(F.col("fraction") == f), RECORDING)
        best = near.groupBy(*RECORDING, "fraction").agg(F.min(F.struct(F.abs(F.col("start_sec") - F.col("target_sec")).alias("distance"), "start_sec", "end_sec", "context_start_sec", "context_end_sec")).alias("m"))
        best = best.select(*RECORDING, "fraction", "m.*")
        chosen = best if chosen is None else chosen.unionByName(best)
        mine = best.select(*RECORDING, F.col("context_start_sec").alias("_x"), F.col("context_end_sec").alias("_y"))
        free = free.join(mine, RECORDING, "left").where("_x is null or context_end_sec <= _x or context_start_sec >= _y").drop("_x", "_y")
    return chosen


#: Events that a fold gathers before it puts them away: an append copies at most so many.
GATHERED = 64


def refractory_crossings(samples: DataFrame, by: list[str], threshold: float = 0.5, dwell: int = 1) -> DataFrame:
    """Hysteresis crossings of +/- threshold, at least `dwell` samples apart, for rows with `samples` arrays.

    The state machine is a fold over the array inside the row: it needs no shuffle and no Python. Events are appended
    to a short array, and short arrays to a list of them, so many events don't copy each other at every step.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("state"), F.lit(-dwell).alias("last"), F.lit(0).alias("i"), none.alias("fresh"), F.array().cast("array<array<int>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        side = F.when(x >= threshold, 1).when(x <= -threshold, -1).otherwise(0)
        flips = (acc["state"] != 0) & (side == -acc["state"]) & (acc["i"] - acc["last"] >= dwell)
        # A level of exactly -threshold starts the low state, as the first level of at least +threshold the high.
        state = F.when(acc["state"] == 0, side).when(flips, side).otherwise(acc["state"])
        full = flips & (F.size(acc["fresh"]) >= GATHERED)
        fresh = F.when(full, F.array(acc["i"])).when(flips, F.array_append(acc["fresh"], acc["i"])).otherwise(acc["fresh"])
        kept = F.when(full, F.array_append(acc["kept"], acc["fresh"])).otherwise(acc["kept"])
        return F.struct(state.cast("int").alias("state"), F.when(flips, acc["i"]).otherwise(acc["last"]).alias("last"), (acc["i"] + 1).alias("i"), fresh.alias("fresh"), kept.alias("kept"))

    return samples.select(*by, F.aggregate("samples", start, step, lambda acc: F.concat(F.flatten(acc["kept"]), acc["fresh"])).alias("events"))

"""Checks, set operations, joins with stated cardinality, grids and pivots."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; an error at run time if a key repeats. Keys are counted with partial sums, and at most one repeated key
    meets the rows, so no row is sorted or moved for the check."""
    fault = duplicate_keys(rows, keys).limit(1).select(F.to_json(F.struct(*keys)).alias("_repeated"))
    ok = F.when(F.col("_repeated").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col("_repeated"))))
    return rows.join(F.broadcast(fault), F.lit(True), "left").where(ok).drop("_repeated")


def require_columns(rows: DataFrame, expected: list[str]) -> DataFrame:
    """The rows with exactly the expected columns, in that order; an error if one is missing, extra or doubled."""
    have = rows.columns
    if len(set(have)) != len(have) or set(have) != set(expected):
        raise ValueError(f"missing {sorted(set(expected) - set(have))}, extra {sorted(set(have) - set(expected))}, doubled {sorted({c for c in have if have.count(c) > 1})}")
    return rows.select(*expected)


def joined(left: DataFrame, right: DataFrame, on: list[str], validate: str, how: str = "inner") -> DataFrame:
    """A join whose cardinality is checked at run time: one_to_one, many_to_one or one_to_many."""
    a, b = validate.split("_to_")
    left = require_unique(left, on) if a == "one" else left
    right = require_unique(right, on) if b == "one" else right
    return left.join(right, on, how)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a finished counterpart."""
    return work.join(done.select(*keys), keys, "left_anti")


def column_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column the counts of missing, NaN and infinite values, and whether its finite values vary: one
    aggregate over the unpivoted columns."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    ok = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.isnan("value")).alias("nans"), F.count_if(F.abs("value") == float("inf")).alias("infinite"), F.coalesce(F.max(ok) == F.min(ok), F.lit(True)).alias("constant"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counting repeats, with the side they are on; none if equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def shared(groups: list[str], rows: DataFrame) -> DataFrame:
    """Keys that are in both parts of `rows` (column part: train, test)."""
    return rows.groupBy(*groups).agg(F.countDistinct("part").alias("parts")).where("parts > 1").select(*groups)


def mask_faults(rows: DataFrame, value: str, mask: str) -> DataFrame:
    """Rows whose missingness mask disagrees with the value."""
    return rows.where(~F.col(mask).eqNullSafe(F.col(value).isNull().cast("int")))


def common_items(rows: DataFrame, container: str, item: str) -> DataFrame:
    """Items that every container holds."""
    containers = rows.agg(F.countDistinct(container).alias("_all"))  # one row
    held = rows.groupBy(item).agg(F.countDistinct(container).alias("_n"))
    return held.crossJoin(F.broadcast(containers)).where("_n = _all").select(item)


def is_subset(part: DataFrame, whole: DataFrame, on: list[str]) -> bool:
    return part.join(whole.select(*on), on, "left_anti").isEmpty()


def jaccard_pairs(rows: DataFrame, container: str, item: str) -> DataFrame:
    """Shared items and Jaccard index of each unordered pair of containers (folds: few), disjoint pairs too."""
    sets = rows.select(container, item).distinct()
    size = sets.groupBy(container).agg(F.count(F.lit(1)).alias("n"))
    a, b = sets.select(F.col(container).alias("a"), item), sets.select(F.col(container).alias("b"), item)
    both = a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    names = size.select(F.col(container).alias("a"), F.col("n").alias("na")), size.select(F.col(container).alias("b"), F.col("n").alias("nb"))
    pairs = names[0].join(names[1], F.col("a") < F.col("b")).join(both, ["a", "b"], "left").na.fill(0, ["shared"])
    return pairs.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def dedupe_names(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Names with their final name: of two or more names base-1, base-2 .. of one group the first (as text) becomes
    the base and the others are dropped; every other name stays."""
    base = F.when(F.col(name).rlike(r"^.*-\d+$"), F.regexp_extract(name, r"^(.*)-(\d+)$", 1))
    w = Window.partitionBy(*by, "_base")
    rows = rows.withColumn("_base", base).withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.row_number().over(w.orderBy(name))})
    twins = F.col("_base").isNotNull() & (F.col("_n") >= 2)
    return rows.where(~twins | (F.col("_k") == 1)).withColumn("final_name", F.when(twins, F.col("_base")).otherwise(F.col(name))).drop("_base", "_n", "_k")


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of literal axes, as rows."""
    return spark.createDataFrame(list(product(*axes.values())), list(axes))


def replace_block(rows: DataFrame, prefix: str, new_prefix: str, value) -> DataFrame:
    """Columns that begin with the prefix are computed anew (value: column name -> Column) and renamed."""
    return rows.select(*[value(c).alias(new_prefix + c.removeprefix(prefix)) if c.startswith(prefix) else F.col(c) for c in rows.columns])


def with_prefix(rows: DataFrame, keep: list[str], *prefixes: str) -> DataFrame:
    return rows.select(*keep, *[c for c in rows.columns if c.startswith(prefixes) and c not in keep])


def top(rows: DataFrame, k: int, value: str, tie: str) -> DataFrame:
    """The k rows with the greatest values, ties by name."""
    return rows.orderBy(F.col(value).desc(), F.col(tie)).limit(k)


def top_by_group(rows: DataFrame, by: list[str], k: int, value: str, tie: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(tie)))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")


def pivoted(rows: DataFrame, keys: list[str], column: str, values: list, measure: Column) -> DataFrame:
    return rows.groupBy(*keys).pivot(column, values).agg(measure)


def pivot_by_total(rows: DataFrame, key: str, column: str, values: list, measure: str) -> DataFrame:
    """Sums with 0 for what is absent, and the row's total, greatest first."""
    wide = pivoted(rows, [key], column, values, F.sum(measure)).na.fill(0)
    return wide.withColumn("total", reduce(Column.__add__, [F.col(f"`{v}`") for v in values])).orderBy(F.col("total").desc(), key)

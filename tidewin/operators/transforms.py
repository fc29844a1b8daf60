"""Training-only imputation and scaling, as expressions fitted by one aggregate."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import known
from .relational import require_columns
from .stats import quantiles


@dataclass
class FeatureTransform:
    """Medians, means and population deviations of the training rows. Columns are matched by name."""

    columns: list[str]
    median: list[float]
    mean: list[float]
    deviation: list[float]
    scale: bool = True

    @staticmethod
    def fit(train: DataFrame, columns: list[str], scale: bool = True) -> FeatureTransform:
        """Exact medians first, then moments of the imputed columns. A column without any value, or with an infinite
        one, is an error; a constant column is centred and keeps its scale."""
        rows = require_columns(train.select(*columns), columns)
        long = rows.unpivot([], columns, "c", "x").withColumn("x", known("x"))
        stats = {r.c: r for r in long.groupBy("c").agg(F.count_if(F.abs("x") == float("inf")).alias("inf"), F.count("x").alias("n")).collect()}
        if bad := [c for c in columns if c not in stats or not stats[c].n or stats[c].inf]:
            raise ValueError(f"columns without values or with infinite ones: {bad}")
        medians = {r.c: r.m for r in quantiles(long, ["c"], "x", {"m": 0.5}).collect()}  # one row for each column
        median = [float(medians[c]) for c in columns]
        filled = F.coalesce(F.col("x"), F.element_at(F.create_map(*[F.lit(v) for p in zip(columns, median, strict=True) for v in p]), F.col("c")))
        moments = {r.c: r for r in long.select("c", filled.alias("x")).groupBy("c").agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("s")).collect()}
        return FeatureTransform(list(columns), median, [float(moments[c].a) for c in columns], [float(moments[c].s) for c in columns], scale)

    def some(self, columns: list[str], scale: bool = True) -> FeatureTransform:
        """The transform of some of the columns, fitted on the same rows: a column's statistics are its own."""
        at = [self.columns.index(c) for c in columns]
        return FeatureTransform(list(columns), *[[v[k] for k in at] for v in (self.median, self.mean, self.deviation)], scale)

    def transform(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """The kept columns and the transformed ones; an infinite value is an error at run time."""
        rows = require_columns(rows, [*keep, *self.columns])
        out = []
        for c, median, mean, sd in zip(self.columns, self.median, self.mean, self.deviation, strict=True):
            x = F.coalesce(known(c), F.lit(median))
            x = F.when(F.abs(x) == float("inf"), F.raise_error(F.lit(f"infinite value in {c}")).cast("double")).otherwise(x)
            out.append(((x - mean) / (sd if sd > 0 else 1.0) if self.scale else x).alias(c))
        return rows.select(*keep, *out)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> FeatureTransform:
        return FeatureTransform(**json.loads(text))

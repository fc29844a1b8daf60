"""Column expressions shared by the operators: missing values, guarded ratios, masks and decisions.

Missing measurements are NULL, never NaN: Spark counts NaN and orders it above every number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column | str) -> Column:
    """NaN becomes NULL."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x), x)


def finite(x: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite; never NULL."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """top / bottom, or `empty` where the bottom is zero."""
    return F.when(bottom != 0, top.cast("double") / F.nullif(bottom, F.lit(0)).cast("double")).otherwise(F.lit(empty).cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def decision(score: Column | str, threshold: Column | float) -> Column:
    """1 at or above the threshold, else 0; NULL scores stay NULL."""
    score = F.col(score) if isinstance(score, str) else score
    return (score >= threshold).cast("int")


def missing_mask(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.isNull().cast("int")


def first_reason(*rules: tuple[Column, str], otherwise: str = "ok") -> Column:
    """The text of the first rule that holds; list the overriding rules first."""
    out = F.lit(otherwise)
    for holds, text in reversed(rules):
        out = F.when(holds, F.lit(text)).otherwise(out)
    return out


def strict_mean(x: Column, members: int | None = None) -> Column:
    """The mean, or NULL unless every row (and exactly `members` rows, if given) has a finite value."""
    whole = F.count_if(finite(x)) == F.count(F.lit(1))
    if members is not None:
        whole = whole & (F.count(F.lit(1)) == members)
    return F.when(whole, F.avg(x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def soft_target(p: Column, temperature: float = 3.0, floor: float = 1e-6) -> Column:
    """A teacher's probability softened by a temperature on its logit."""
    p = clip(p, floor, 1 - floor)
    return sigmoid(F.log(p / (1 - p)) / temperature)


def feature_part(name: Column | str, part: str) -> Column:
    """family, measure or channel of a family__measure__channel name; `unknown` where a part is absent."""
    at = ("family", "measure", "channel").index(part)
    return F.coalesce(F.get(F.split(name, "__"), F.lit(at)), F.lit("unknown"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))

"""Table functions for SQL: spectra, band powers, gaps and events of a row's array, to be used with LATERAL.

    register(spark)
    SELECT r.id, s.* FROM recordings r, LATERAL spectrum(r.samples, 256.0D, 256) s

The schema is known when a query is analysed, from the arguments' types and constant values; wrong arguments are an
error then. An array that is NULL, or can't be measured, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, NumericType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import kernels as K


def _array(argument: AnalyzeArgument, name: str) -> None:
    if not isinstance(argument.dataType, ArrayType) or not isinstance(argument.dataType.elementType, NumericType):
        raise ValueError(f"{name} must be an array of numbers, not {argument.dataType.simpleString()}")


def _positive(argument: AnalyzeArgument, name: str, least: float = 0.0) -> float:
    if not argument.isConstantExpression or argument.value is None or not float(argument.value) > least:
        raise ValueError(f"{name} must be a constant above {least:g}")
    return float(argument.value)


def _signal(samples: list | None) -> np.ndarray | None:
    if samples is None or len(samples) < 2 or any(v is None for v in samples):
        return None
    x = np.asarray(samples, np.float64)
    return x if np.isfinite(x).all() else None


class Spectrum:
    """frequency_hz and density: Welch's estimate."""

    @staticmethod
    def analyze(samples: AnalyzeArgument, sfreq: AnalyzeArgument, nperseg: AnalyzeArgument) -> AnalyzeResult:
        _array(samples, "samples")
        _positive(sfreq, "sfreq")
        _positive(nperseg, "nperseg", 1)
        return AnalyzeResult(schema=StructType().add("frequency_hz", DoubleType()).add("density", DoubleType()))

    def eval(self, samples: list, sfreq: float, nperseg: int) -> Iterator[tuple[float, float]]:
        x = _signal(samples)
        if x is not None:
            f, p = K.welch(x[None], float(sfreq), int(nperseg))
            yield from zip(f.tolist(), p[0].tolist(), strict=True)


class BandPowers:
    """One row with a column for each of the named bands (a constant list such as 'alpha, beta')."""

    @staticmethod
    def analyze(samples: AnalyzeArgument, sfreq: AnalyzeArgument, nperseg: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        Spectrum.analyze(samples, sfreq, nperseg)
        schema = StructType()
        for name in _bands(names.value if names.isConstantExpression else None):
            schema = schema.add(name, DoubleType())
        return AnalyzeResult(schema=schema)

    def eval(self, samples: list, sfreq: float, nperseg: int, names: str) -> Iterator[tuple]:
        x = _signal(samples)
        if x is not None:
            found = dict(zip(K.BANDS, K.band_powers(*K.welch(x[None], float(sfreq), int(nperseg)))[0].tolist(), strict=True))
            yield tuple(found[name] for name in _bands(names))


def _bands(names: str | None) -> list[str]:
    found = [x.strip() for x in (names or "").split(",") if x.strip()]
    if not found or set(found) - set(K.BANDS) or len(set(found)) < len(found):
        raise ValueError(f"names must be a constant list of {', '.join(K.BANDS)}")
    return found


class Gaps:
    """at and gap: every time but the last in order, and the time to the next, where that is at least `shortest`."""

    @staticmethod
    def analyze(times: AnalyzeArgument, shortest: AnalyzeArgument) -> AnalyzeResult:
        _array(times, "times")
        _positive(shortest, "shortest", -1e-300)
        return AnalyzeResult(schema=StructType().add("at", DoubleType()).add("gap", DoubleType()))

    def eval(self, times: list, shortest: float) -> Iterator[tuple[float, float]]:
        known = sorted(float(t) for t in times or () if t is not None)
        for a, b in zip(known, known[1:], strict=False):
            if b - a >= float(shortest):
                yield a, b - a


class Crossings:
    """event: the samples at which the signal crosses between +threshold and -threshold, at least `dwell` apart."""

    @staticmethod
    def analyze(samples: AnalyzeArgument, threshold: AnalyzeArgument, dwell: AnalyzeArgument) -> AnalyzeResult:
        _array(samples, "samples")
        _positive(threshold, "threshold")
        return AnalyzeResult(schema=StructType().add("event", IntegerType()))

    def eval(self, samples: list, threshold: float, dwell: int) -> Iterator[tuple[int]]:
        from ..operators.hysteresis import Chunk

        values = np.array([np.nan if v is None else float(v) for v in samples or ()])
        for event in Chunk(values, float(threshold), int(dwell)).events(0, 0):
            yield (event,)


FUNCTIONS = {"spectrum": Spectrum, "band_powers": BandPowers, "gaps": Gaps, "crossings": Crossings}


def register(spark: SparkSession) -> None:
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, useArrow=True))

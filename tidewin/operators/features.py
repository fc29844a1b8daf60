"""Window features and spectra: one Arrow pass over rows that hold their samples, with no shuffle.

Rows of a batch are grouped by length, so kernels run on whole matrices. A signal that is NULL, shorter than
two samples or not finite has NULL results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .windows import window_size


def _signals(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of usable signals in a list column."""
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, value in enumerate(column):
        x = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64) if value.is_valid else np.zeros(0)
        if len(x) >= 2 and np.isfinite(x).all():
            by_size.setdefault(len(x), []).append((i, x))
    for found in by_size.values():
        yield np.array([i for i, _ in found]), np.stack([x for _, x in found])


def per_signal(rows: DataFrame, keep: list[str], samples: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """The kept columns and one double for each name, from a kernel on (signals, samples) matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: np.full(batch.num_rows, np.nan) for n in names}
            for at, x in _signals(batch.column(len(keep))):
                for n, v in kernel(x).items():
                    out[n][at] = v
            values = [pa.array(out[n], pa.float64(), from_pandas=True) for n in names]  # NaN becomes NULL
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *values], [*keep, *names])

    chosen = rows.select(*keep, F.col(samples).cast("array<double>"))
    schema = ", ".join([f"`{c}` {t}" for c, t in chosen.dtypes[: len(keep)]] + [f"`{n}` double" for n in names])
    return chosen.mapInArrow(run, schema)


def window_features(rows: DataFrame, keep: list[str], samples: str, sfreq: float, nperseg: int = 256) -> DataFrame:
    """The fifteen measures of each signal as family__measure columns."""
    names = [f"{family}__{m}" for family, ms in K.MEASURES.items() for m in ms]
    return per_signal(rows, keep, samples, lambda x: K.window_features(x, sfreq, nperseg), names)


def features_long(features: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, feature, value): the form that selections, ablations and importances work on."""
    names = [c for c in features.columns if c not in keep]
    return features.unpivot(keep, names, "feature", "value")


def features_wide(long: DataFrame, keys: list[str], channel: str, channels: list[str]) -> DataFrame:
    """family__measure__channel columns, by family, then channel, then measure; the names are known, so the pivot
    needs no pass to find them."""
    named = long.withColumn("_name", F.concat_ws("__", "feature", channel))
    return named.groupBy(*keys).pivot("_name", K.feature_names(channels)).agg(F.first("value"))


def spectra(rows: DataFrame, keep: list[str], samples: str, sfreq: float, nperseg: int = 256) -> DataFrame:
    """(keep, frequency_hz, density): Welch's estimate, one row for each frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _signals(batch.column(len(keep))):
                f, p = K.welch(x, sfreq, nperseg)
                kept = [c.take(pa.array(np.repeat(at, len(f)))) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.tile(f, len(at))), pa.array(p.ravel())], [*keep, "frequency_hz", "density"])

    chosen = rows.select(*keep, F.col(samples).cast("array<double>"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[: len(keep)]) + ", frequency_hz double, density double"
    return chosen.mapInArrow(run, schema)


def relative_powers(rows: DataFrame, keep: list[str], samples: str, sfreq: float, nperseg: int = 256, wide: bool = False) -> DataFrame:
    """Band power over total power, by the closed bands or by the half-open ones with the wide gamma."""
    bands = K.WIDE_BANDS if wide else K.BANDS

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        f, p = K.welch(x, sfreq, nperseg)
        return dict(zip(bands, np.moveaxis(K.relative_powers(f, p, bands, not wide), -1, 0), strict=True))

    return per_signal(rows, keep, samples, kernel, list(bands))


def recording_features(recordings: DataFrame, keep: list[str], channels: list[str], sfreq: float, seconds: float = 4.0, clean: Callable[[np.ndarray, float], np.ndarray] | None = K.preprocess, nperseg: int = 256) -> DataFrame:
    """keep, start_sec, end_sec and a family__measure__channel column for each measure and channel, one row for each
    complete window of each recording: rows hold `signals`, the named channels' whole signals in that order. A
    recording is cleaned first and cut then, so windows have no filter edges. One Arrow pass, no pivot and no shuffle."""
    size, names = window_size(seconds, sfreq), K.feature_names(channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, signals in enumerate(batch.column(len(keep))):
                x = np.stack([np.asarray(s.values.to_numpy(zero_copy_only=False), np.float64) for s in signals])
                if len(x) != len(channels):
                    raise ValueError(f"a recording of {len(x)} signals for {len(channels)} channels")
                for k in range(len(x) if clean else 0):  # one channel's spectrum at a time
                    x[k] = clean(x[k], sfreq)
                n = x.shape[1] // size
                values: dict[str, list[np.ndarray]] = {}
                for begin in range(0, n, WINDOWS):  # some windows at a time, of all channels
                    stop = min(n, begin + WINDOWS)
                    pieces = x[:, begin * size : stop * size].reshape(len(x), stop - begin, size)
                    for name, v in K.window_features(pieces, sfreq, nperseg).items():
                        for k, c in enumerate(channels):
                            values.setdefault(f"{name}__{c}", []).append(v[k])
                if n:
                    start = np.arange(n) * size / sfreq
                    kept = [c.take(pa.array(np.full(n, i))) for c in batch.columns[: len(keep)]]
                    found = [pa.array(np.concatenate(values[name]), from_pandas=True) for name in names]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(start), pa.array(start + size / sfreq), *found], [*keep, "start_sec", "end_sec", *names])

    chosen = recordings.select(*keep, F.col("signals").cast("array<array<double>>"))
    schema = [f"`{c}` {t}" for c, t in chosen.dtypes[: len(keep)]] + [f"`{n}` double" for n in ("start_sec", "end_sec", *names)]
    return chosen.mapInArrow(run, ", ".join(schema))


#: Windows whose spectra a task holds at once.
WINDOWS = 64

KINDS = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def per_batch(rows: DataFrame, keep: list[str], arguments: list[str], function: Callable[..., Iterator[tuple[int, dict]]], schema: str, most: int = 256) -> DataFrame:
    """The kept columns and, for each (row, dict) that function(*columns) gives, the dict's values; floats that are NaN
    are NULL. The function gets the arguments' columns as lists for up to `most` rows, so kernels that walk signals
    sample by sample walk many at once."""
    types = {part.split()[0]: KINDS[part.split()[1]] for part in schema.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, most):
                batch = whole.slice(begin, most)
                at, out = [], {f: [] for f in types}
                for i, found in function(*(c.to_pylist() for c in batch.columns[len(keep) :])):
                    at.append(i)
                    for f in types:
                        v = found.get(f)
                        out[f].append(None if isinstance(v, float) and np.isnan(v) else v)
                kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[f], t) for f, t in types.items())], [*keep, *types])

    chosen = rows.select(*keep, *arguments)
    return chosen.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in chosen.dtypes[: len(keep)]] + [schema]))


def per_row(rows: DataFrame, keep: list[str], arguments: list[str], function: Callable[..., list[dict]], schema: str) -> DataFrame:
    """`per_batch` for a function of one row's arguments that lists its dicts."""
    return per_batch(rows, keep, arguments, lambda *columns: ((i, found) for i, values in enumerate(zip(*columns, strict=True)) for found in function(*values)), schema)

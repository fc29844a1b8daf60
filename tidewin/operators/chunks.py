"""Recordings of any length in rows of bounded size: chunks with halos, filters by overlap-save, windows from chunks.

A signal is rows of (by.., chunk, first_sample, n_samples, samples): chunk numbers count from 0, first_sample is the
chunk's place and n_samples the whole signal's length. What needs samples beyond a chunk gets them as a halo from
the neighbouring chunks, one shuffle of the chunks and their ends; no signal is ever gathered in a row or a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import features
from .windows import window_size

PLACE = ["chunk", "first_sample", "n_samples"]
#: Chunks that a task filters before it gives them out.
ROWS = 32


def rechunked(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """Pieces (by.., first_sample, samples), in any order and of any length, as chunks of `size` samples (the last one
    shorter). The pieces must cover the signal without gap or overlap: otherwise an error."""
    first, n = F.col("first_sample"), F.size("samples").cast("long")
    cells = F.sequence(F.floor(first / size), F.floor((first + F.greatest(n, F.lit(1)) - 1) / size))
    parts = rows.select(*by, "first_sample", F.col("samples").cast("array<double>").alias("samples")).withColumn("chunk", F.explode(cells))
    low = F.greatest(F.col("chunk") * size - first, F.lit(0)).cast("int")
    high = F.least((F.col("chunk") + 1) * size - first, n).cast("int")
    cut = parts.select(*by, "chunk", (first + low).alias("first_sample"), F.slice("samples", low + 1, F.greatest(high - low, F.lit(0))).alias("samples"))
    held = cut.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(F.struct("first_sample", "samples"))).alias("p"))
    chunks = held.select(*by, "chunk", F.get("p", F.lit(0))["first_sample"].alias("first_sample"), F.flatten(F.transform("p", lambda x: x["samples"])).alias("samples"), "p")
    ends = F.transform("p", lambda x: x["first_sample"] + F.size(x["samples"]))
    whole = F.forall(F.arrays_zip(F.slice("p", 2, 1 << 30).alias("b"), F.slice(ends, 1, F.size("p") - 1).alias("a")), lambda z: z["b"]["first_sample"] == z["a"])
    sizes = chunks.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max(F.col("first_sample") + F.size("samples")).alias("n_samples"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    out = chunks.join(F.broadcast(sizes) if not by else sizes, same) if by else chunks.crossJoin(F.broadcast(sizes))
    right = whole & (F.col("first_sample") == F.col("chunk") * size) & (F.size("samples") == F.least(F.lit(size), F.col("n_samples") - F.col("first_sample")))
    fault = F.raise_error(F.concat(F.lit("the pieces have a gap or overlap in chunk "), F.col("chunk").cast("string")))
    return out.where(F.when(right, F.lit(True)).otherwise(fault)).select(*by, *PLACE, "samples")


def with_halos(chunks: DataFrame, by: list[str], halo: int) -> DataFrame:
    """by.., chunk, first_sample, n_samples, samples, before and after: up to `halo` samples of the neighbours on either
    side. A chunk that is not the last must hold at least `halo` samples."""
    n = F.size("samples")
    tail, head = F.slice("samples", F.greatest(n - halo + 1, F.lit(1)), F.lit(halo)), F.slice("samples", F.lit(1), F.lit(halo))
    last = F.col("first_sample") + n >= F.col("n_samples")
    short = ~last & (n < halo)
    fault = F.raise_error(F.concat(F.lit(f"a chunk of fewer than {halo} samples stands before others: chunk "), F.col("chunk").cast("string")))
    rows = chunks.where(F.when(short, fault).otherwise(F.lit(True)))
    none = F.lit(None)
    place = lambda which, shift, samples: F.struct((F.col("chunk") + shift).alias("to"), F.lit(which).alias("side"), F.when(F.lit(which == 0), F.col("first_sample")).alias("first_sample"), F.when(F.lit(which == 0), F.col("n_samples")).alias("n_samples"), samples.alias("samples"))
    sent = F.filter(F.array(place(0, 0, F.col("samples")), F.when(~last, place(-1, 1, tail)).otherwise(none), F.when(F.col("chunk") > 0, place(1, -1, head)).otherwise(none)), lambda x: x.isNotNull())
    each = rows.select(*by, F.explode(sent).alias("s")).select(*by, F.col("s.to").alias("chunk"), "s.side", "s.first_sample", "s.n_samples", "s.samples")
    side = lambda which: F.first(F.when(F.col("side") == which, F.col("samples")), True)
    out = each.groupBy(*by, "chunk").agg(F.max("first_sample").alias("first_sample"), F.max("n_samples").alias("n_samples"), side(0).alias("samples"), side(-1).alias("before"), side(1).alias("after"))
    return out.where("samples is not null")


def filtered(chunks: DataFrame, by: list[str], stages: list[K.Stage]) -> DataFrame:
    """The chunks of the signals through zero-phase filters in turn, with the values that filtering each signal whole
    gives (odd reflection at its ends): every chunk is filtered with halos of the filters' halves together. Samples that
    are not finite are an error."""
    halo = sum(len(s.taps) // 2 for s in stages)
    held = with_halos(chunks, by, halo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            at = batch.schema.names.index("samples")
            places = [batch.column(c).to_pylist() for c in ("first_sample", "n_samples")]
            sides = [batch.column(c) for c in ("samples", "before", "after")]
            out = []
            for i, (first, n) in enumerate(zip(*places, strict=True)):
                own, before, after = (c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else np.zeros(0) for c in sides)
                if len(before) != min(halo, first) or len(after) != min(halo, n - first - len(own)):
                    raise ValueError("a chunk is missing beside another")
                whole = np.concatenate([before, own, after])
                if not np.isfinite(whole).all():
                    raise ValueError("a signal's samples must be finite")
                out.append(K.fir_part(whole, first - len(before), first, first + len(own), n, stages))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.list_(pa.float64()))], batch.schema.names[: at + 1])

    plain = held.select(*by, *PLACE, *[F.col(c).cast("array<double>").alias(c) for c in ("samples", "before", "after")])
    schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes[: len(by) + len(PLACE) + 1])
    return plain.mapInArrow(run, schema)


def chunk_features(chunks: DataFrame, by: list[str], channels: list[str], sfreq: float, seconds: float = 4.0, nperseg: int = 256) -> DataFrame:
    """`features.recording_features` of signals in chunks (by.., channel, ..) that are clean already: one row for each
    complete window. Chunks whose length is no whole number of windows are cut anew first."""
    size = window_size(seconds, sfreq)
    fault = F.raise_error(F.lit("chunks must hold whole windows: see rechunked"))
    aligned = F.when(F.col("first_sample") % size == 0, F.lit(True)).otherwise(fault)
    beside = chunks.where(aligned).groupBy(*by, "chunk", "first_sample").agg(F.map_from_entries(F.collect_list(F.struct("channel", "samples"))).alias("m"))
    rows = beside.select(*by, (F.col("first_sample") / sfreq).alias("_offset"), F.array(*[F.col("m")[c] for c in channels]).alias("signals"))
    wide = features.recording_features(rows, [*by, "_offset"], channels, sfreq, seconds, None, nperseg)
    moved = {c: F.col(c) + F.col("_offset") for c in ("start_sec", "end_sec")}
    return wide.withColumns(moved).drop("_offset")

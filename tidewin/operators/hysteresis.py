"""Hysteresis crossings of signals in chunks: each chunk's state machine as a summary, composed in order.

A level of +threshold or more is the high side, of -threshold or less the low side. The first side sets the state; later
the other side flips it, at least `dwell` samples after the flip before. After a flip, what follows depends on its
place alone, so a chunk is summed up by where its flips end for each first flip that an entry can lead to: at most
dwell + 1 places for either state. Summaries are composed along the signal in order, one row for each chunk streamed
through a task that holds a state and no array; then every chunk finds its own events from the state it is entered
in. Samples are read twice, in parallel, and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = -(1 << 62)


class Chunk:
    """The sides of a chunk's samples, and the flip that follows each flip."""

    def __init__(self, x: np.ndarray, threshold: float, dwell: int):
        side = np.where(x >= threshold, 1, np.where(x <= -threshold, -1, 0))
        self.at = np.flatnonzero(side)
        self.side, self.dwell = side[self.at], max(dwell, 1)
        self.of = {s: np.flatnonzero(self.side == s) for s in (1, -1)}
        # After a flip at a place to its side, the next is the first of the other side that is `dwell` on.
        self.next = np.arange(len(self.at))
        for s in (1, -1):
            self.next[self.of[s]] = self._first(-s, self.at[self.of[s]] + self.dwell, self.of[s])

    def _first(self, s: int, place: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        """The first on side s at or after each place, as a number among the sides."""
        k = np.searchsorted(self.at[self.of[s]], place)
        found = k < len(self.of[s])
        out = np.array(otherwise)
        out[found] = self.of[s][k[found]]
        return out

    def ends(self) -> np.ndarray:
        """The last flip that each flip leads to."""
        end = self.next
        while len(end) and (end != (further := end[end])).any():
            end = further
        return end

    def summary(self) -> list[tuple[int, int, int, int]]:
        """(entry state, first flip, last flip, state then) for each first flip that an entry can lead to; entry state 0
        has one, or (0, NONE, NONE, side) if the first side is all there is."""
        end, out = self.ends(), []
        for s in (1, -1):
            other = self.of[-s]
            most = np.searchsorted(self.at[other], self.dwell) + 1
            out += [(s, int(self.at[i]), int(self.at[end[i]]), int(self.side[end[i]])) for i in other[:most].tolist()]
        if len(self.at):
            s = int(self.side[0])
            if len(other := self.of[-s]):
                i = int(other[0])
                out.append((0, int(self.at[i]), int(self.at[end[i]]), int(self.side[end[i]])))
            else:
                out.append((0, NONE, NONE, s))
        return out

    def events(self, state: int, wait: int) -> list[int]:
        """The flips from an entry in this state, none of them before `wait`."""
        if not len(self.at):
            return []
        state = state or int(self.side[0])
        first = self._first(-state, np.array([wait]), np.array([-1]))[0]
        out = []
        while first >= 0:
            out.append(int(self.at[first]))
            first = self.next[first] if self.next[first] != first else -1
        return out


def composed(state: int, last: int, first: int, rows: list[tuple[int, int, int, int]], dwell: int) -> tuple[int, int]:
    """(state, last flip) after a chunk that begins at `first`, from the state and the last flip before it."""
    wait = max(0, last + max(dwell, 1) - first) if last != NONE else 0
    for s, flip, end, then in rows:
        if s == state and (flip >= wait or flip == NONE):
            return then, (first + end if end != NONE else last)
    return state, last


def chunk_crossings(chunks: DataFrame, by: list[str], threshold: float = 0.5, dwell: int = 1) -> DataFrame:
    """by.. and event (a sample's number), one row for each crossing of signals in chunks; the results of
    `windows.refractory_crossings` for signals of any length. NULL and NaN samples are on no side."""

    def values(column: pa.Array, i: int) -> np.ndarray:
        return column[i].values.to_numpy(zero_copy_only=False).astype(np.float64)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Chunk(values(batch.column("samples"), i), threshold, dwell).summary() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([np.array(r, np.int64).tobytes() for r in found], pa.binary())], [*batch.schema.names[:-1], "summary"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, last = None, 0, NONE
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            for k, first, raw in zip(keys, batch.column("first_sample").to_pylist(), batch.column("summary").to_pylist(), strict=True):
                if k != key:
                    key, state, last = k, 0, NONE
                out.append((state, last))
                state, last = composed(state, last, first, np.frombuffer(raw, np.int64).reshape(-1, 4).tolist(), dwell)
            entry = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *entry], [*batch.schema.names[:-1], "state", "last"])

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (first, state, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("first_sample", "state", "last")), strict=True)):
                wait = max(0, last + max(dwell, 1) - first) if last != NONE else 0
                own = Chunk(values(batch.column("samples"), i), threshold, dwell).events(state, wait)
                rows += [i] * len(own)
                found += [first + e for e in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in by), pa.array(found, pa.int64())], [*by, "event"])

    if dwell < 0:
        raise ValueError("a dwell is not negative")
    kinds = dict(chunks.dtypes)
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)
    rows = chunks.select(*by, "first_sample", F.col("samples").cast("array<double>").alias("samples"))
    summed = rows.mapInArrow(summaries, f"{keys}first_sample long, summary binary")
    # A signal's summaries stream through one task in order: one row for each chunk.
    order = summed.repartition(*by).sortWithinPartitions(*by, "first_sample") if by else summed.coalesce(1).sortWithinPartitions("first_sample")
    entries = order.mapInArrow(walk, f"{keys}first_sample long, state long, last long")
    same = [rows[c].eqNullSafe(entries[c]) for c in [*by, "first_sample"]]
    entered = rows.join(entries, same).select(*[rows[c] for c in by], rows["first_sample"], "samples", "state", "last")
    return entered.mapInArrow(events, f"{keys}event long")



"""Vector codes by product quantisation, with a vantage-point tree over the entries of every part position.

A vector's components become integers, floor(256 x), and the vector is cut into equal consecutive parts. Each
part position has a codebook, which starts as that part of the smallest ids' vectors. A round assigns every part
to the nearest entry and moves each entry to the floored mean of its parts; tasks send one sum and count for
each (position, entry, place), so a round shuffles nothing that grows with the vectors in a task.

A search is metric branch and bound. A tree holds a vantage entry in each inner node and the other entries in a
near and a far half, each with the least and the greatest distance from the vantage entry, rounded outwards. A query
first goes down to one leaf for a close bound, then visits every half that the triangle inequality doesn't
exclude; a half at exactly the bound is visited, since an entry of a lower index may wait there. What is visited is
compared in whole numbers: squared distance, then index.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped. Rows without an id are
coded but give no entry; rows that share an id are rows of their own, and where they are among the smallest ids
they come in the order of their vectors. Fewer vectors than entries make fewer entries, an entry without a part stays
as it is, and equal entries go to the lower index. The dimension is that of the first entry's vector and must be a
multiple of the parts (otherwise ValueError). A vector of another dimension, or with a component so large that an
error could pass 64 bits, keeps its row with a null code and error and teaches nothing. If there is no entry at all,
codes and errors are null. An empty table gives an empty result. Only the id, vector and label are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import read, small, stage, to_tasks

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf at most.
LEAF = 6
#: Distances are rounded outwards by far more than a square root or a difference can be wrong.
SLACK = 2.0**-48


class VantageTree:
    """Vantage-point tree over integer points."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._node(np.arange(len(points))) if len(points) else None

    def _node(self, members: np.ndarray) -> tuple:
        """(vantage, halves) of an inner node, (members, None) of a leaf; a half is (least, greatest distance, node)."""
        if len(members) <= LEAF:
            return members, None
        vantage, rest = members[:1], members[1:]
        away = squares(self.points[rest], self.points[vantage[0]])
        order = np.argsort(away, kind="stable")
        halves = []
        for half in np.array_split(order, 2):
            halves.append((math.sqrt(away[half[0]]) * (1 - SLACK), math.sqrt(away[half[-1]]) * (1 + SLACK), self._node(np.sort(rest[half]))))
        return vantage, halves

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest point, ties to the lower index."""
        best, at = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(self.points))

        def verify(asked: np.ndarray, members: np.ndarray) -> np.ndarray:
            for m in members.tolist():
                away = squares(queries[asked], self.points[m])
                better = (away < best[asked]) | (away == best[asked]) & (m < at[asked])
                best[asked[better]], at[asked[better]] = away[better], m
            return away

        def go(node: tuple, asked: np.ndarray, descend: bool) -> None:
            members, halves = node
            away = verify(asked, members)
            if halves is None:
                return
            root = np.sqrt(away.astype(np.float64))
            low, high = root * (1 - SLACK), root * (1 + SLACK)
            if descend:
                near = low <= halves[0][1]
                for (_, _, child), part in zip(halves, (asked[near], asked[~near]), strict=True):
                    if len(part):
                        go(child, part, True)
                return
            for least, greatest, child in halves:
                bound = np.maximum(low - greatest, least - high) * (1 - SLACK)
                part = asked[bound <= np.sqrt(best[asked].astype(np.float64)) * (1 + SLACK)]
                if len(part):
                    go(child, part, False)

        if self.root is not None and len(queries):
            go(self.root, np.arange(len(queries)), True)
            go(self.root, np.arange(len(queries)), False)
        return at, best


def squares(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    away = points - other
    return (away * away).sum(axis=-1)


def finite(column: pa.Array) -> np.ndarray:
    """Which vectors are there, without null or non-finite components."""
    offsets, values = _flat(column)
    wrong = np.r_[0, np.cumsum(~np.isfinite(values))]
    return column.is_valid().to_numpy(zero_copy_only=False) & (wrong[offsets[1:]] == wrong[offsets[:-1]])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.offsets).astype(np.int64), pc.cast(column.values, pa.float64()).to_numpy(zero_copy_only=False)


def integers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors can be coded, their integer components) of finite vectors."""
    offsets, values = _flat(column)
    size = np.diff(offsets)
    fits = size == dimension
    # A squared distance over all components stays below 2 ** 62.
    most = math.isqrt((1 << 62) // max(dimension, 1)) // 2 - 1
    taken = values[offsets[:-1][fits][:, None] + np.arange(dimension)]
    taken = np.floor(taken * SCALE)
    modest = (np.abs(taken) <= most).all(axis=1)
    fits[fits] = modest
    return fits, taken[modest].astype(np.int64)


def _kept(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(finite(batch.column("vector")), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def first_entries(kept: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """(parts, entries, places): the parts of the smallest ids' vectors; no more than `entries` rows come to the driver."""
    named = kept.where("vec_id is not null").select("vec_id", "vector")
    first = named.orderBy("vec_id", "vector").first()
    if first is None:
        return np.zeros((parts, 0, 0), np.int64)
    dimension = len(first.vector)
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components can't be cut into {parts} equal parts")
    modest = named.where(F.size("vector") == dimension).mapInArrow(lambda batches: (b.filter(pa.array(integers(b.column("vector"), dimension)[0])) for b in batches), named.schema)
    rows = modest.orderBy("vec_id", "vector").limit(entries).collect()
    whole = np.floor(np.array([r.vector for r in rows], np.float64).reshape(len(rows), dimension) * SCALE).astype(np.int64)
    return np.ascontiguousarray(whole.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def _assigned(held, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which vectors have a code, their parts, codes, errors); `held` gives (codebooks, trees)."""
    books, trees = held
    fits, whole = integers(vectors, books.shape[0] * books.shape[2])
    if not books.shape[1]:  # a vector has nothing to be coded with
        fits, whole = np.zeros(len(vectors), bool), whole[:0]
    whole = whole.reshape(len(whole), books.shape[0], books.shape[2])
    codes, error = np.zeros(whole.shape[:2], np.int64), np.zeros(len(whole), np.int64)
    for part, tree in enumerate(trees):
        codes[:, part], away = tree.nearest(whole[:, part])
        error += away
    return fits, whole, codes, error


def refined(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round."""
    held = to_tasks(kept.sparkSession, (books, [VantageTree(b) for b in books]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, places = books.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, places), np.int64)
        for batch in batches:
            _, whole, codes, _ = _assigned(held(), batch.column("vector"))
            for part in range(parts):
                np.add.at(count[part], codes[:, part], 1)
                np.add.at(total[part], codes[:, part], whole[:, part])
        part, entry = np.nonzero(count)
        for place in range(places):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, entry, np.full(len(part), place), count[part, entry], total[part, entry, place])], ["part", "entry", "place", "n", "total"])

    sums = kept.select("vector").mapInArrow(run, "part long, entry long, place long, n long, total long")
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = books.copy()
    for r in sums.collect():  # one row for each component of an entry
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code in bytes, error) of every kept row, and the final codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte for each part: 1 to 256 entries")
    kept = _kept(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")))
    books = first_entries(kept, entries, parts)
    for _ in range(rounds if books.shape[1] else 0):
        books = refined(kept, books)
    held = to_tasks(kept.sparkSession, (books, [VantageTree(b) for b in books]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, _, found, error = _assigned(held(), batch.column("vector"))
            of = np.cumsum(fits) - 1
            raw = [r.tobytes() for r in found.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([raw[k] if f else None for k, f in zip(of.tolist(), fits.tolist(), strict=True)], pa.binary()), pa.array(error[of] if len(error) else np.zeros(len(fits), np.int64), mask=~fits)],
                ["vec_id", "label", "code", "error"],
            )

    return kept.mapInArrow(run, f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code binary, error long"), books


def compress(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, code (hex), error, label_error (the errors' sum over equal labels) and codebooks_sha256."""
    found, books = codes(vectors, **settings)
    found = stage(found, "vector-codes", "zstd")
    # One row for each label; a label with a third of all rows meets a single row, and a skewed join is split.
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = found.join(small(sums), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings."""
    return compress(read(spark, sf_dir, "embeddings"))

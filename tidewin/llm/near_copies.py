"""All texts with a five-word Jaccard similarity of 0.8 or more, grouped transitively, without a lossy search.

SimHash comes first: pairs of texts whose fingerprints lie within the radius, as the BK-trees of op9 name them, are
verified and joined. At a Jaccard similarity of 0.8 the distance of two 64-bit SimHashes spreads from about 3 to over
11 bits, so a radius that loses no pair can't be dealt out by blocks. What lies beyond it is found by prefixes: put every
text's shingles in one fixed order, and two texts that reach the similarity share one of the first
n - ceil(0.8 n) + 1 of each. Any order is exact; shingles that a sixteenth of the texts find common come last, so
that common lines and passages rarely lie in a prefix. The first shingle that two texts share stands behind i and
j others, none of them shared, so they share at most min(n - i, m - j): pairs that this excludes don't meet there.
Texts with equal shingle sets are one node, so copies never meet. Prefixes are dealt by shingle in packed rows, and
only shingles of several nodes go on.

A candidate pair is first bounded from above by the nodes' sketches, which count each set's shingles by hash
bucket: two sets share at most the sum of the lesser counts. Only pairs that this bound lets through are verified
on whole sets, so sets travel for near copies and not for texts that have a passage in common. After the trees' pairs a round
compares each node of a shingle only with the one there that has the fewest rare shingles before it: the text that
the others were made from, if it is there, so a large group of near copies is joined at a cost in proportion to its
size. The last round compares all pairs that share a shingle and are not in one component yet. No pair is left out
for its number.

Defined cases: words are split and lowered as in SimHash; fewer words than the width make one shingle; texts
without a word are equal. Words and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import connected_components, discard, shuffle_width, slices, small, stage
from .words import plain_hashes, shingle_hashes

WIDTH = 5
#: The similarity as a fraction, so that it is compared in whole numbers.
TIMES, OF = 4, 5
SEED = 42
#: One text in so many, and at least LEAST texts, tell which shingles are common; that moves work, and no result.
SHARE, LEAST = 16, 4000
#: Common shingles that travel with the tasks, the most frequent ones: 16 bytes each.
COMMON = 1 << 19
#: Rounds that compare with one node of a shingle only.
STARS = 1
BATCH_BYTES = 1 << 20
FLUSH = 1 << 18
#: How prefix shingles travel: column by column.
PACKED = {"h": np.int64, "node": np.int64, "n": np.int32, "at": np.int32}


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    words, at = plain_hashes(texts)
    whole, out = shingle_hashes(words, width), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        short = min(width, b - a)  # fewer words make one shingle, and none makes none
        out.append(np.unique(whole[a : b - width + 1] if short == width else shingle_hashes(words[a:b], short)[: min(short, 1)]))
    return out


def name(found: np.ndarray) -> int:
    """The node of a shingle set."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) >> 2


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order (rank, hash); `common` is sorted, and all others rank zero."""
    n = len(found)
    most = n - -(-TIMES * n // OF) + 1 if n else 0
    if not len(common):
        return found[:most]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.lexsort((found, np.where(common[at] == found, rank[at], 0)))[:most]]


def reaches(both: int, a: int, b: int) -> bool:
    """Whether `both` shared shingles of sets of these sizes reach the similarity."""
    return OF * both >= TIMES * (a + b - both)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return reaches(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))


def sketch(found: np.ndarray) -> bytes:
    """Shingles by hash bucket, a power of two of buckets, about four in each; empty if a count needs over a byte."""
    buckets = 1 << max(5, len(found).bit_length() - 2)
    counts = np.bincount((found & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(a: bytes, b: bytes) -> int | None:
    """No two sets with these sketches share more shingles; None if a sketch is empty."""
    if not a or not b:
        return None
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if len(y) > len(x):
        y = y.reshape(-1, len(x)).sum(axis=0, dtype=np.int64)
    return int(np.minimum(x, y).sum(dtype=np.int64))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more of the sampled texts, sorted, and their number of texts there."""
    share = max(1 / SHARE, LEAST / max(docs.count(), 1))
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(batch.column(0))).view(np.int64))], ["h"])

    seen = some.distinct().mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON)
    top = seen.toArrow()
    common, rank = (np.asarray(top.column(k).combine_chunks()).astype(np.int64) for k in (0, 1))
    common = common.view(np.uint64)
    order = np.argsort(common)
    return common[order], rank[order]


def named(docs: DataFrame, fingerprint: Callable[[str | None], int]) -> DataFrame:
    """The columns other than the text, and node, n (its number of shingles), its sketch and fp, the text's fingerprint."""
    at, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, BATCH_BYTES):
                sets = shingle_sets(batch.column(at))
                found = [pa.array([name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary())]
                found.append(pa.array(np.array([fingerprint(t.as_py()) for t in batch.column(at)], np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, "node", "n", "sketch", "fp"])

    return docs.mapInArrow(run, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept) + ", node long, n int, sketch binary, fp long")


def shared_shingles(docs: DataFrame) -> DataFrame:
    """h, node, n (its number of shingles) and at (h's place among them) for the prefix shingles of two nodes or more."""
    common, rank = common_shingles(docs)
    width = shuffle_width(docs.sparkSession)
    parts = 2 * width

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            size = [len(p) for p, _ in held.values()]
            h = np.concatenate([p for p, _ in held.values()])
            node, n = np.repeat(np.array(list(held), np.int64), size), np.repeat(np.array([n for _, n in held.values()], np.int32), size)
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
            part = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            parts_here, begin = np.unique(part[order], return_index=True)
            cut = [np.split(x[order], begin[1:]) for x in (h, node, n, at)]
            return pa.RecordBatch.from_arrays([pa.array(parts_here), *(pa.array([v.tobytes() for v in c], pa.binary()) for c in cut)], ["part", *PACKED])

        for whole in batches:
            for batch in slices(whole, 0, BATCH_BYTES):
                for found in shingle_sets(batch.column(0)):
                    if len(found) and (node := name(found)) not in held:
                        held[node] = (prefix(found, common, rank), len(found))
                        count += len(held[node][0])
                if count > FLUSH:
                    yield flush()
                    held, count = {}, 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[bytes]] = [[] for _ in PACKED]
        for batch in batches:
            for k in range(len(PACKED)):
                got[k] += batch.column(k + 1).to_pylist()
        rows = [np.frombuffer(b"".join(x), kind) for x, kind in zip(got, PACKED.values(), strict=True)]
        del got
        order = np.lexsort((rows[1], rows[0]))
        rows = [x[order] for x in rows]
        first = np.ones(len(order), bool)
        first[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [x[first] for x in rows]
        same = rows[0][1:] == rows[0][:-1]
        several = np.r_[same, False] | np.r_[False, same] if len(rows[0]) else np.zeros(0, bool)
        rows = [x[several] for x in rows]
        for k in range(0, len(rows[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in rows], list(PACKED))

    dealt = docs.select("text").mapInArrow(deal, "part long, " + ", ".join(f"{c} binary" for c in PACKED))
    return dealt.repartition(width, "part").mapInArrow(meet, "h long, node long, n int, at int")


def _may_reach(n: Column, at: Column, m: Column, at2: Column) -> Column:
    """Whether sets of n and m shingles can reach the similarity if the first that they share stands at these places:
    they share no more than the lesser rest, and OF / TIMES of it must be the union."""
    return F.least(n - at, m - at2) * (OF + TIMES) >= (n + m) * TIMES


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity, with a text key of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(k).to_pylist() for k in (4, 5, 6, 7))
            most = map(most_shared, x, y)
            keep = [at_most is None or reaches(min(at_most, i, j), i, j) for at_most, i, j in zip(most, n, m, strict=True)]
            yield batch.select(["a", "b", "ka", "kb"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("k").alias(f"k{c}"), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "kb", "na", "nb", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long, ka long, kb long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the similarity. Sets are made only of the texts that a pair names."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())], ["node", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k) for k in (2, 3))
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("node"), F.col("ka").alias("k")).union(pairs.select("b", "kb")).distinct()
    # Rows that are equal in id and text share k: one of them is enough.
    sets = docs.join(small(wanted), "k").select("node", "text").mapInArrow(hashed, "node long, found binary").dropDuplicates(["node"])
    sets = stage(sets, "near-sets")
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b").select("a", "b", "x", "y")
    out = stage(joined.mapInArrow(run, "a long, b long"), "near-links")
    discard(sets)
    return out


def components(docs: DataFrame, keys: DataFrame, likely: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have a near copy. `docs` has the key k and text, `keys` k and `named`'s columns,
    `likely` the pairs of nodes (a, b) to begin with. All pairs are verified."""
    shared = stage(shared_shingles(docs), "near-shared")
    nodes = keys.join(small(shared.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.min(F.struct("k", "n", "sketch")).alias("m")).select("node", "m.*")
    nodes = stage(nodes, "near-nodes")

    def reached(pairs: DataFrame) -> DataFrame:
        asked = stage(possible(pairs, nodes), "near-pairs")
        found = verified(asked, docs)
        discard(asked)
        return found

    links = reached(likely)
    joined = stage(connected_components(links), "near-components")
    for turn in range(STARS + 1):
        rows = shared.join(small(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = rows.groupBy("h").agg(F.min(F.struct((F.col("at") / F.col("n")).alias("key"), "node", "n", "at", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
        open_ = open_.where("low <> high")
        if turn < STARS:
            other = open_.select("h", *[F.col(f"hub.{c}").alias(f"{c}2") for c in ("node", "n", "at", "component")])
            met = rows.join(other, "h").where("node <> node2")
        else:
            left = stage(rows.join(open_.select("h"), "h", "left_semi"), "near-open")
            met = left.join(left.toDF("h", *[f"{c}2" for c in left.columns[1:]]), "h").where("node < node2")
        met = met.where((F.col("component") != F.col("component2")) & _may_reach(F.col("n"), F.col("at"), F.col("n2"), F.col("at2")))
        pairs = met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        found = reached(pairs)
        if not found.isEmpty():
            links = links.union(found)
            joined = stage(connected_components(links), "near-components")
    discard(shared, nodes, left)
    return joined

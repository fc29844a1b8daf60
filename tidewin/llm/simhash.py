"""SimHash near-duplicates with BK-trees in pigeonhole shards.

A document's 64-bit fingerprint sets a bit that is set in over half of its shingle hashes. Equal
fingerprints become one class first, so copies cost one row each and never meet. Two fingerprints that
differ in at most two of 64 bits agree in at least two of four 16-bit blocks; each class therefore goes
to the six shards named by a pair of blocks and their values. Each shard holds a BK-tree, whose children
are keyed by their integer Hamming distance to the parent, and a search follows only edges within the
radius of the query's distance. The trees are not broadcast to every task, since all of them together
grow with the data; each query is sent to the only six shards that can hold a neighbour. Links are
reduced to a spanning forest in the shard, and the components come from a distributed contraction.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words than
the shingle width make one shingle; rows with a null doc_id get a fingerprint and their class's
component, which is null if no row of the component has an id; repeated rows stay repeated; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .support import connected_components, shuffle_width, small, stage, with_ids

WIDTH = 3
RADIUS = 2
SEED = 42
PIECE = 1 << 18
NAMELESS = 1 << 62  # ids are below
#: Blocks of 16 bits; a pair within RADIUS bits differs in at most two of the four.
BLOCKS = [(i, j) for i, j in combinations(range(4), 2)]


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text cut at white space, about PIECE bytes each (a longer word stays whole)."""
    at = 0
    while at < len(raw):
        space = _SPACE.search(raw, at + PIECE)
        stop = space.start() if space else len(raw)
        yield raw[at:stop]
        at = stop


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Walks the text piece by piece, with the last words of a piece before those of the next."""
    counts, n, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    words: list[bytes] = []

    def count(found: list[int]) -> None:
        bits = np.unpackbits(np.array(found, np.dtype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add(counts, bits.sum(axis=0, dtype=np.int64), out=counts)

    for piece in pieces((text or "").encode("utf-8").lower()):  # bytes: A-Z only, and the six ASCII spaces
        words += piece.split()
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        found = [digest(joined[a:b], SEED) for a, b in zip(starts, ends.tolist()[width - 1 :], strict=False)]
        count(found)
        n += len(found)
        words = words[len(words) - width + 1 :]
    if not n:
        if not words:
            return 0
        count([digest(b" ".join(words), SEED)])
        n = 1
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return with_ids(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over an array of 64-bit values, built and searched in sets rather than value by value."""

    def __init__(self, values: np.ndarray):
        self.values, self.children = values, {}
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            members = todo.pop()
            root, rest = int(members[0]), members[1:]
            self.children[root] = edges = []
            if len(rest):
                away = np.bitwise_count(values[rest] ^ values[root])
                order = np.argsort(away, kind="stable")
                at, begin = np.unique(away[order], return_index=True)
                for d, child in zip(at.tolist(), np.split(rest[order], begin[1:]), strict=True):
                    edges.append((d, int(child[0])))
                    todo.append(child)

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius of it), for each node that has any."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, asked = todo.pop()
            away = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int64)
            if len(hit := asked[away <= radius]):
                yield node, hit
            for edge, child in self.children[node]:
                if len(onward := asked[np.abs(away - edge) <= radius]):
                    todo.append((child, onward))


def forest(values: np.ndarray, radius: int, near: bool = False) -> list[tuple[int, int]]:
    """(member, root) links that connect what lies within the radius, at most one for each member; with `near` as many
    pairs that lie within the radius themselves."""
    up, met = list(range(len(values))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for node, hits in BKTree(values).near(values, radius):
        for h in hits.tolist():
            if (a := root(node)) != (b := root(h)):
                up[max(a, b)] = min(a, b)
                met.append((h, node))
    return met if near else [(x, root(x)) for x in range(len(values)) if up[x] != x]


def links(classes: DataFrame, radius: int = RADIUS, near: bool = False) -> DataFrame:
    """Links (a, b) between class representatives, enough to connect every pair within the radius; with `near` each of
    them lies within it."""
    if radius > 2:
        raise ValueError("two of four blocks agree only up to radius 2")
    block = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*[F.struct(F.lit(n).alias("pair"), (block(i) * F.lit(65536) + block(j)).alias("block")) for n, (i, j) in enumerate(BLOCKS)])
    dealt = classes.select("fp", "rep", F.explode(keys).alias("k")).select("k.pair", "k.block", "fp", "rep")
    dealt = dealt.repartition(shuffle_width(classes.sparkSession), "pair", "block").sortWithinPartitions("pair", "block", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last shard's rows so far, for it may go on in the next batch

        def trees(rows: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            begin, end = np.r_[0, cut], np.r_[cut, rows.shape[1]]
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(end - begin > 1):
                rep = rows[3, begin[i] : end[i]]
                out += [(int(rep[x]), int(rep[r])) for x, r in forest(rows[2, begin[i] : end[i]].view(np.uint64), radius, near)]
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)])
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
            if held and (held[-1][0, -1], held[-1][1, -1]) != (rows[0, 0], rows[1, 0]):
                yield trees(np.concatenate(held, axis=1))
                held = []
            if len(change):
                done = int(change[-1]) + 1
                yield trees(np.ascontiguousarray(np.concatenate([*held, rows[:, :done]], axis=1)))
                held, rows = [], rows[:, done:]
            held.append(rows)
        if held:
            yield trees(np.ascontiguousarray(np.concatenate(held, axis=1)))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of at most `radius` bits."""
    prints = stage(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    # A class whose rows all lack an id takes part under a name of its own above every id.
    named = classes.withColumn("rep", F.coalesce("rep", F.lit(NAMELESS) + F.shiftrightunsigned("fp", 2)))
    joined = connected_components(links(named, radius)).withColumnRenamed("node", "rep")
    known = named.join(joined, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    known = known.select("fp", F.when(F.col("component_id") < NAMELESS, F.col("component_id")).alias("component_id"))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def near_nodes(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of nodes that fingerprints and their BK-trees name, a below b: nodes of one fingerprint with the least of
    them, and these within the radius. `keys` has node and fp."""
    prints = keys.select("node", "fp").distinct()
    classes = stage(prints.groupBy("fp").agg(F.min("node").alias("rep")), "near-classes")
    same = prints.join(classes, "fp").where("node <> rep").select("node", "rep")
    both = same.union(links(classes, radius, near=True)).toDF("a", "b").where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, less all but one of each group of texts with a five-word Jaccard
    similarity of 0.8 or more (transitively): fingerprints and BK-trees name pairs first, which are verified, and prefixes
    find what lies beyond the radius (see near_copies). The one with the smallest id stays, and of the rows
    without an id one as well. A row goes only for its text, so other texts under a repeated id stay; of rows that
    are equal in id and text the one with the least hash of all columns stays. No text is sorted or aggregated,
    but for rows that are equal to another in id and text."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("_id", F.col(names[docs.columns.index(id_col)]).cast("long"))
    text = F.col(names[docs.columns.index(text_col)]).cast("string")
    rows = rows.withColumn("_k", F.xxhash64("_id", F.col("_id").isNull(), text))  # names a row by id and text
    texts = rows.select(F.col("_k").alias("k"), F.col("_id").alias("id"), text.alias("text"))
    keys = stage(near_copies.named(texts, fingerprint), "near-keys")
    groups = near_copies.components(texts.select("k", "text"), keys, near_nodes(keys))
    known = keys.join(small(groups), "node", "left").select("id", "k", F.coalesce("component", "node").alias("component"))
    first = known.groupBy("component", F.col("id").isNull().alias("none")).agg(F.min(F.struct("id", "k")).alias("row"), F.count(F.lit(1)).alias("rows"))
    several = stage(first.where("rows > 1").select(F.col("component").alias("c"), F.col("none"), F.col("row.k").alias("kept")), "near-groups")
    known = known.join(small(several), (F.col("component") == F.col("c")) & (F.col("id").isNull() == F.col("none")))
    gone = stage(known.where("k <> kept").select(F.col("k").alias("_k")).distinct(), "near-gone")
    left = rows.join(small(gone), "_k", "left_anti")
    twice = stage(keys.groupBy(F.col("k").alias("_k")).count().where("count > 1").select("_k"), "near-twice")
    if not twice.isEmpty():
        side = small(twice)
        one = left.join(side, "_k", "left_semi").groupBy("_k").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("r")).select("r.*")
        left = left.join(side, "_k", "left_anti").select(*names).unionByName(one)
    return left.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

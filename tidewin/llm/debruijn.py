"""Removal of repeated word spans by compaction of a De Bruijn graph.

The graph's edges are the corpus's windows of WINDOW words: an edge leads from its first WINDOW - 1 words to its last
ones. Only edges that two documents share matter, and only they are made one by one.

1. Runs. Every window has a least hash among its pieces of PIECE words (its anchor); neighbouring windows with one
   anchor are a run, a stretch of path, about one for 20 words. Equal windows have equal anchors, so runs whose anchor
   stands in one document only hold no shared edge and go no further.
2. Compaction. Equal runs of several documents are shared stretches; the least document that holds one owns it, with its
   coordinates. A stretch is joined to the next if, over all documents, each has only the other beside it (no branch)
   and the owner holds them end to end. Pointers to the path's head double with each join, so a path of n stretches
   takes log2(n) joins. A document's stretches of one path at one distance from the owner's coordinates, end to
   end, are a span; spans that an earlier document owns are removed.
3. Ends. Runs that differ but have an anchor in common may share windows. Of every such run the least document's is
   cut into windows; a window that an earlier document's run also holds is removed.
4. Coordinates verify. Every span carries the owner's coordinates; a digest of its words must equal that of the words
   there, otherwise the span is dropped. (Single windows are equal by their own 64-bit hash and their anchor's.)

No document, group of copies or path is gathered in a task: a hot anchor's runs are counted with partial sums, a batch
of texts sends one row for each window and least document, and joins on hot stretches are skew joins of Spark.

Defined cases: words are runs of bytes other than the six ASCII spaces, unchanged; a null text has none; a text of
fewer words than a window keeps all. Documents that share an id are not earlier than each other: their rows are
judged one by one against smaller ids; rows without an id keep all their words and remove none. Equal rows
get equal results. An empty table gives an empty result. Long texts are walked in pieces. Only the id and the text are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .simhash import pieces
from .suffix_dedup import joined, window_hashes
from .support import discard, read, slices, stage, with_ids
from .words import exact_hashes, spread

WINDOW = 50
PIECE = 12
#: Windows in a run at most, so that its first and last window hold all its words.
RUN = 48
BATCH_BYTES = 1 << 19
#: A text is walked in pieces of so many words.
WALK_WORDS = 1 << 18
#: Windows that a task settles before it sends them.
HELD = 1 << 18
_U = np.uint64


def runs(words: np.ndarray, at: np.ndarray, window: int = WINDOW, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(anchor, hash, text, first window in the text, number of windows) of the runs of several texts, whose words
    lie end to end with n + 1 offsets `at`."""
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashes = window_hashes(words, [piece, window])
    whole, low, wide, width = hashes[window], hashes[piece], window - piece + 1, 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[wide - width : wide - width + n])
    last = at[1:] - window
    held = last >= at[:-1]
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, at[:-1][held], 1)
    np.add.at(inside, last[held] + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    fresh = valid.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    fresh[at[:-1][held]] = True
    begin = np.flatnonzero(fresh)
    text = np.searchsorted(at, begin, side="right") - 1
    end = np.minimum(np.r_[begin[1:], n], last[text] + 1)
    most = min(RUN, window)
    parts = -(-(end - begin) // most)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, end, text = np.repeat(begin, parts) + nth * most, np.repeat(end, parts), np.repeat(text, parts)
    count = np.minimum(end - begin, most)
    key = spread(whole[begin] * _U(7) + whole[begin + count - 1] * _U(11) + count.astype(np.uint64))
    return low[begin], key, text, begin - at[text], count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def run_table(rows: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """a (anchor), r (hash), k (row), doc, start and n of every run of rows (k, doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, BATCH_BYTES):
                words, at = exact_hashes(batch.column(2))
                k, doc = (np.asarray(batch.column(c)) for c in (0, 1))
                if len(words) <= 2 * WALK_WORDS:
                    parts = [(words, at, 0, k, doc)]
                else:  # pieces overlap, so that every window stands whole in one of them
                    parts = [(words[i : min(i + WALK_WORDS + window - 1, b)], None, i - a, k[t : t + 1], doc[t : t + 1]) for t, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) for i in range(a, max(b - window + 1, a), WALK_WORDS)]
                for own, ends, shift, ks, docs in parts:
                    a, r, text, start, n = runs(own, np.array([0, len(own)]) if ends is None else ends, window, piece)
                    yield pa.RecordBatch.from_arrays([_signed(a), _signed(r), pa.array(ks[text]), pa.array(docs[text]), pa.array(start + shift), pa.array(n.astype(np.int32))], ["a", "r", "k", "doc", "start", "n"])

    return rows.mapInArrow(run, "a long, r long, k long, doc long, start long, n int")


def paths(stretches: DataFrame) -> DataFrame:
    """a, r of every shared stretch and its path: head_a, head_r, and head_start, the owner's start of it. `stretches` has
    the occurrences (a, r, k, start, n, owner_k, owner_start) of shared stretches."""
    here = stretches.select("a", "r", "k", (F.col("start") + F.col("n")).alias("at"), "owner_k", (F.col("owner_start") + F.col("n")).alias("owner_at"))
    after = stretches.select(F.col("a").alias("a2"), F.col("r").alias("r2"), "k", F.col("start").alias("at"), F.col("owner_k").alias("owner_k2"), F.col("owner_start").alias("owner_at2"))
    straight = (F.col("owner_k") == F.col("owner_k2")) & (F.col("owner_at") == F.col("owner_at2"))
    pairs = stage(here.join(after, ["k", "at"]).select("a", "r", "a2", "r2", straight.alias("straight")).distinct(), "path-pairs")
    # A stretch with two neighbours on a side is a branch.
    ahead = pairs.groupBy("a", "r").agg(F.count(F.lit(1)).alias("out"), F.min("a2").alias("a2"), F.min("r2").alias("r2"), F.min("straight").alias("straight"))
    behind = pairs.groupBy("a2", "r2").agg(F.count(F.lit(1)).alias("in"))
    links = ahead.where("out = 1 and straight").join(behind.where("in = 1"), ["a2", "r2"]).select(F.col("a2").alias("a"), F.col("r2").alias("r"), F.col("a").alias("head_a"), F.col("r").alias("head_r"))
    own = stretches.groupBy("a", "r").agg(F.min("owner_start").alias("owner_start"))
    state = own.join(links, ["a", "r"], "left").select("a", "r", "owner_start", F.coalesce("head_a", "a").alias("head_a"), F.coalesce("head_r", "r").alias("head_r"))
    state = stage(state, "path-heads")
    while True:
        up = state.select(F.col("a").alias("head_a"), F.col("r").alias("head_r"), F.col("head_a").alias("up_a"), F.col("head_r").alias("up_r"), F.col("owner_start").alias("head_start"))
        moved = (F.col("up_a") != F.col("head_a")) | (F.col("up_r") != F.col("head_r"))
        step = stage(state.select("a", "r", "owner_start", "head_a", "head_r").join(up, ["head_a", "head_r"]).select("a", "r", "owner_start", F.col("up_a").alias("head_a"), F.col("up_r").alias("head_r"), "head_start", moved.alias("moved")), "path-heads")
        done = step.where("moved").isEmpty()
        discard(state)
        if done:
            discard(pairs)
            return step.select("a", "r", "head_a", "head_r", "head_start")
        state = step


def spans(stretches: DataFrame) -> DataFrame:
    """The documents' spans: k, doc, start, n (windows), owner, owner_k and owner_start, and the path's head."""
    placed = stretches.join(paths(stretches), ["a", "r"])
    path = ["k", "doc", "owner", "owner_k", "head_a", "head_r", "shift"]
    placed = placed.withColumn("shift", F.col("start") - F.col("owner_start"))
    along = Window.partitionBy(*path).orderBy("start")
    cut = F.coalesce(F.lag(F.col("start") + F.col("n")).over(along) < F.col("start"), F.lit(True))
    placed = placed.withColumn("cut", cut.cast("int")).withColumn("island", F.sum("cut").over(along))
    out = placed.groupBy(*path, "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"))
    return out.select("k", "doc", "start", (F.col("stop") - F.col("start")).alias("n"), "owner", "owner_k", (F.col("start") - F.col("shift")).alias("owner_start"), "head_a", "head_r")


def span_digests(raw: bytes, wanted: list[tuple[int, int]]) -> list[bytes]:
    """A digest of the words [start, stop) for each wanted span."""
    found, n = [hashlib.blake2b(digest_size=16) for _ in wanted], 0
    for piece in pieces(raw):
        words = piece.split()
        for own, (start, stop) in zip(found, wanted, strict=True):
            if start < n + len(words) and stop > n:
                own.update(b" ".join(words[max(start - n, 0) : stop - n]) + b" ")
        n += len(words)
    return [own.digest() for own in found]


def verified(rows: DataFrame, claims: DataFrame, window: int = WINDOW) -> DataFrame:
    """The claims (k, start, n, owner_k, owner_start) whose words are those at the owner's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                out = []
                for k, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "wanted")), strict=True):
                    digests = span_digests((text or "").encode(), [(x["start"], x["start"] + x["n"] + window - 1) for x in wanted])
                    out += [(k, x["start"], x["n"], d) for x, d in zip(wanted, digests, strict=True)]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["k", "start", "n", "digest"])

    asked = claims.select("k", "start", "n").union(claims.select("owner_k", "owner_start", "n")).distinct()
    wanted = asked.groupBy("k").agg(F.collect_list(F.struct("start", "n")).alias("wanted"))
    one = rows.join(wanted, "k").select("k", "doc", "text", "wanted").mapInArrow(run, "k long, start long, n long, digest binary").dropDuplicates(["k", "start", "n"])
    owner = one.select(F.col("k").alias("owner_k"), F.col("start").alias("owner_start"), "n", F.col("digest").alias("owner_digest"))
    return claims.join(one, ["k", "start", "n"]).join(owner, ["owner_k", "owner_start", "n"]).where("digest = owner_digest").select(*claims.columns)


def shared_windows(rows: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """a, w (the window's hash), doc, k, at (where it starts there) and settled (an earlier document of the same batch
    has it) for the windows of the asked runs (k, a, start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            a, w, doc, k, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, k, doc, a, w))
            a, w, doc, k, at = (x[order] for x in (a, w, doc, k, at))
            first = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]
            least = doc[np.flatnonzero(first)[np.cumsum(first) - 1]]
            row = np.flatnonzero(first | np.r_[True, k[1:] != k[:-1]])
            offsets = pa.array(np.r_[row, len(a)].astype(np.int32))
            return pa.RecordBatch.from_arrays([_signed(a[row]), _signed(w[row]), pa.array(doc[row]), pa.array(k[row]), pa.ListArray.from_arrays(offsets, pa.array(at)), pa.array(doc[row] > least[row])], ["a", "w", "doc", "k", "at", "settled"])

        size = 0
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                words, at = exact_hashes(batch.column("text"))
                hashes = window_hashes(words, [window])[window]
                for t, (k, doc, wanted) in enumerate(zip(batch.column("k").to_pylist(), batch.column("doc").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                    a, start, n = (np.array([x[c] for x in wanted], np.int64) for c in ("a", "start", "n"))
                    own = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    held.append((np.repeat(a, n).view(np.uint64), hashes[at[t] + own], np.full(len(own), doc), np.full(len(own), k), own))
                    size += len(own)
                    if size > HELD:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    wanted = asked.groupBy("k").agg(F.collect_list(F.struct("a", "start", "n")).alias("wanted"))
    return rows.join(wanted, "k").select("k", "doc", "text", "wanted").mapInArrow(run, "a long, w long, doc long, k long, at array<long>, settled boolean")


def repeats(rows: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """k, start and n (windows) of what earlier documents also hold, of rows (k, doc, text)."""
    if not piece <= window:
        raise ValueError("a piece can't be longer than the window")
    every = stage(run_table(rows.where("doc is not null"), window, piece), "runs", "zstd")
    # Written tables, so that both sides of a join are plain exchanges and a hot anchor's rows are split by the skew join.
    common = stage(every.groupBy("a").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("a"), "runs-anchors")
    found = stage(every.join(common, "a", "left_semi"), "runs-common", "zstd")
    discard(every, common)
    kinds = stage(found.groupBy("a", "r").agg(F.min(F.struct("doc", "k", "start")).alias("own"), F.max("doc").alias("hi")), "runs-kinds")
    mixed = stage(kinds.groupBy("a").count().where("count > 1").select("a", F.lit(True).alias("mixed")), "runs-mixed")
    kinds_ = kinds.join(mixed, "a", "left").select("a", "r", (F.col("own.doc") < F.col("hi")).alias("shared"), F.coalesce("mixed", F.lit(False)).alias("mixed"), F.col("own.doc").alias("owner"), F.col("own.k").alias("owner_k"), F.col("own.start").alias("owner_start"))
    placed = stage(found.join(kinds_.where("shared or mixed"), ["a", "r"]).where("shared or doc = owner"), "runs-placed", "zstd")
    discard(found, kinds, mixed)
    claims = spans(placed.where("shared")).where("owner < doc").select("k", "start", "n", "owner_k", "owner_start")
    whole = verified(rows, stage(claims, "spans"), window).select("k", "start", "n")
    asked = placed.where("mixed and doc = owner").select("k", "a", "start", "n")
    single = shared_windows(rows.where("doc is not null"), asked, window)
    least = F.min("doc").over(Window.partitionBy("a", "w"))
    single = single.withColumn("least", least).where("settled or least < doc").select("k", F.explode("at").alias("start"), F.lit(1).alias("n"))
    return whole.unionByName(single)


def kept_words(raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[int, int, str]:
    """(words, words removed, SHA-256 of the others joined by spaces); [start, stop) are ordered and apart."""
    digest, n, removed, joint = hashlib.sha256(), 0, 0, b""
    for piece in pieces(raw):
        words = piece.split()
        lo, hi = np.clip(start - n, 0, len(words)), np.clip(stop - n, 0, len(words))
        inside = hi > lo
        edges = [0, *np.stack([lo[inside], hi[inside]], axis=1).reshape(-1).tolist(), len(words)]
        kept = words if len(edges) == 2 else [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
        if kept:
            digest.update(joint + b" ".join(kept))
            joint = b" "
        n += len(words)
        removed += len(words) - len(kept)
    return n, removed, digest.hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows = with_ids(docs, id_col, text_col).select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").alias("doc"), "text")
    found = repeats(rows, window, piece).groupBy("k").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + F.lit(window - 1)).alias("stop"))).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                out = []
                for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                    pairs = np.array([(c["start"], c["stop"]) for c in cuts or []], np.int64).reshape(-1, 2)
                    _, start, stop = joined(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                    out.append(kept_words((text or "").encode(), start, stop))
                n, removed, digest = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.join(found, "k", "left").select("k", "doc", "text", "cuts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op12_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without spans of 50 words or more of earlier documents."""
    return remove_repeats(read(spark, sf_dir, "documents"))

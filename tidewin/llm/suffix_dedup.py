"""Exact substring dedup with a common-prefix interval tree over an enhanced suffix array.

Two strings of `length` bytes that are equal have the same least hash among their pieces of PIECE bytes
(a minimizer). Every run of neighbouring start positions with one minimizer is a span, the stretch of text
that its strings cover; spans go to shards by minimizer, so equal strings always meet, wherever they
stand, and no shard ever sees more than the spans of its minimizers.

1. Spans: each text gives spans (minimizer, hash of the span's bytes, document, start), about one for 35
   bytes, packed in arrays. A task drops what it can settle itself: of equal spans it sends the earliest.
2. Copies: a shard sorts its spans. Of equal spans all but the earliest are repeats. Spans that differ but
   share a minimizer may still share strings, and a span may hold a string twice: the earliest of each
   sends for its bytes.
3. Trees: a shard builds the suffix array of those bytes by prefix doubling, the common prefixes of
   neighbours, and scans them with a stack: the intervals with a common prefix of at least `length` form
   a tree. An interval whose occurrences differ in the byte to their left (or stand at a span's start) is a
   maximal repeat, given out with all its occurrences; any other is covered by a longer one.
4. Of each group's occurrences all but the earliest are removed: bytes covered by strings that start
   earlier elsewhere. Earlier is by document, then start, on the input.

Minimizers with more than HOT different spans (the rim of a passage that a third of all documents share)
are not gathered: their spans are cut into single strings, which go to shards by their own hash and are
settled as in step 2, with equal strings of a batch of texts settled before they are sent. Of such a string
its hash travels and not its bytes: 26 bytes for each start position, which is what a larger corpus has more of.

Hashes have 64 bits and are compared only within one minimizer. Defined cases: a null text is empty; a
text under `length` bytes has no repeat; rows that share a doc_id are taken as one document and get its
result each, one with its own text if texts differ (positions of either count); rows without a doc_id are
documents by their text, in the order of its hash, and come before all others; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import read, shuffle_width, slices, stage, text_bytes, with_ids
from .words import spread

LENGTH = 100
PIECE = 32
#: Start positions in a span at most, so that a span's first and last string together cover it.
RUN = 96
HOT = 2_000
#: Shards in a partition: a task holds one shard's arrays at a time.
SHARDS = 8
#: Bytes of a batch for each shard, from which on shards' shares are rows of their own.
SHARE_BYTES = 1 << 10
BATCH_BYTES = 4 << 20
#: Hashing works on pieces that fit a core's cache.
SCAN_BYTES = 1 << 18
HELD_BYTES = 8 << 20
#: A text longer than twice this is walked in pieces.
WALK_BYTES = 1 << 18
SPAN = np.dtype([("min", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("size", "<i4"), ("self", "?")])
NO_ID = -(1 << 63)
_U = np.uint64


def window_hashes(data: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Hashes of the strings of each size from each position, by doubling: h(2k) mixes h(k) here and k on."""
    level, out, k = {1: spread(data.astype(np.uint64) + _U(0x51))}, {}, 1
    while 2 * k <= max(sizes):
        a = level[k]
        level[2 * k] = spread(a[: max(len(a) - k, 0)] * _U(3) + a[k:])
        k *= 2
    for size in sizes:
        at, done = np.zeros(max(len(data) - size + 1, 0), np.uint64), 0
        for k in sorted(level, reverse=True):
            if size & k:
                at = spread(at * _U(5) + level[k][done : done + len(at)])
                done += k
        out[size] = at
    return out


def spans(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> np.ndarray:
    """The spans of the texts, in text order."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, SPAN)
    hashes = window_hashes(data, [piece, length])
    low, width = hashes[piece], 1
    wide = length - piece + 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[wide - width : wide - width + n])
    last = offsets[1:] - length  # the last start position of each text
    inside = np.zeros(n + 1, np.int32)
    held = last >= offsets[:-1]
    np.add.at(inside, offsets[:-1][held], 1)
    np.add.at(inside, last[held] + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    fresh = valid.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    fresh[offsets[:-1][held]] = True
    begin = np.flatnonzero(fresh)
    # A run ends where the next begins or the text's strings end; long runs are cut.
    text = np.searchsorted(offsets, begin, side="right") - 1
    end = np.minimum(np.r_[begin[1:], n], last[text] + 1)
    parts = -(-(end - begin) // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, end, text = np.repeat(begin, parts) + nth * RUN, np.repeat(end, parts), np.repeat(text, parts)
    count = np.minimum(end - begin, RUN)
    out = np.zeros(len(begin), SPAN)
    whole = hashes[length]
    out["min"], out["doc"], out["start"], out["size"] = low[begin], docs[text], begin - offsets[text], count + length - 1
    # A string may stand twice within a span, at most RUN - 1 apart. Then the piece at each multiple of PIECE
    # in its first stand comes again as far behind, so looking there finds every such span.
    pieces, every = hashes[piece], hashes[piece][::piece]
    again = np.zeros(len(every), bool)
    for lag in range(1, RUN):
        behind = pieces[lag::piece]
        again[: len(behind)] |= behind == every[: len(behind)]
    total = np.r_[0, np.cumsum(again)]
    out["self"] = total[np.minimum(-(-(begin + count + length - piece) // piece), len(every))] > total[np.minimum(-(-begin // piece), len(every))]
    out["hash"] = spread(whole[begin] * _U(7) + whole[begin + count - 1] * _U(11) + count.astype(np.uint64))
    return out


def walk(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The spans of the texts; a long text is walked in pieces that overlap by length - 1 bytes, so that every string
    stands whole in exactly one of them. A span that an edge cuts only becomes two."""
    if len(data) <= 2 * WALK_BYTES:
        yield spans(data, offsets, docs, length)
        return
    for doc, a, b in zip(docs.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for at in range(a, max(b - length + 1, a), WALK_BYTES):
            part = data[at : min(at + WALK_BYTES + length - 1, b)]
            found = spans(part, np.array([0, len(part)]), np.array([doc]), length)
            found["start"] += at - a
            yield found


def settle(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest of equal spans, the later ones); both sorted by minimizer, hash, document, start."""
    found = found[np.lexsort((found["start"], found["doc"], found["hash"], found["min"]))]
    first = np.ones(len(found), bool)
    first[1:] = (found["min"][1:] != found["min"][:-1]) | (found["hash"][1:] != found["hash"][:-1])
    # The same occurrence may come twice (rows that share a doc_id): it is no repeat of itself.
    owner = np.flatnonzero(first)[np.cumsum(first) - 1] if len(found) else np.zeros(0, int)
    itself = (found["doc"] == found["doc"][owner]) & (found["start"] == found["start"][owner])
    return found[first], found[~first & ~itself]


def joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the same document that overlap or touch as one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    # Documents by rank, so that one running maximum serves all of them.
    rank = np.r_[0, np.cumsum(doc[1:] != doc[:-1])]
    lift = rank * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift)
    fresh = np.r_[True, (start + lift)[1:] > reach[:-1]]
    at = np.flatnonzero(fresh)
    ends = np.r_[at[1:], len(doc)] - 1
    return doc[at], start[at], (reach - lift)[ends]


class SuffixTree:
    """The enhanced suffix array of several byte strings, down to a depth, and its interval tree."""

    def __init__(self, texts: list[bytes], depth: int, among: np.ndarray | None = None):
        """`among` limits the suffix array to these positions of the texts end to end."""
        self.texts, sizes = texts, np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        n = len(data)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.begin = np.r_[0, np.cumsum(sizes)]
        self.left = self.begin[self.text + 1] - np.arange(n)  # bytes up to the text's end
        rank = np.zeros(n, np.int64)
        # Seven symbols of nine bits; zero stands for all beyond the text's end.
        for j in range(7):
            symbol = np.zeros(n, np.int64)
            symbol[: max(n - j, 0)] = np.where(self.left[: max(n - j, 0)] > j, data[j:], 0)
            rank = rank << 9 | symbol
        ranked = lambda key: (np.unique(key, return_inverse=True)[1] + 1).astype(np.int32)
        self.ranks, size = {7: ranked(rank)}, 7
        while size < depth:
            step = min(size, depth - size)
            rank = self.ranks[size]
            after = np.zeros(n, np.int32)
            after[: max(n - step, 0)] = np.where(self.left[: max(n - step, 0)] > step, rank[step:], 0)
            size += step
            self.ranks[size] = ranked(rank.astype(np.int64) * (n + 2) + after)
        among = np.arange(n) if among is None else among
        self.array = among[np.argsort(self.ranks[size][among], kind="stable")]
        a, b = self.array[:-1], self.array[1:]
        most = np.minimum(np.minimum(self.left[a], self.left[b]), depth)
        self.common = np.zeros(len(a), np.int64)
        for size in sorted(self.ranks, reverse=True):
            i, j = a + self.common, b + self.common
            fits = self.common + size <= most
            fits[fits] = self.ranks[size][i[fits]] == self.ranks[size][j[fits]]
            self.common += size * fits
        for _ in range(6):  # the last symbols one by one
            i, j = a + self.common, b + self.common
            fits = self.common < most
            fits[fits] = data[i[fits]] == data[j[fits]]
            self.common += fits
        before = np.r_[0, data[:-1]]
        self.before = np.where(np.arange(n) == self.begin[self.text], -1 - np.arange(n), before)  # no two starts alike

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, all positions) of each maximal repeat of at least `least` bytes."""
        long = np.flatnonzero(self.common >= least)
        if not len(long):
            return
        cuts = np.flatnonzero(np.diff(long) > 1) + 1
        for part in np.split(long, cuts):
            lo = int(part[0])
            common = self.common[part].tolist() + [0]
            before = self.before[self.array[lo : lo + len(common)]].tolist()
            # Stack entries: (common prefix, first leaf, left byte or None if diverse).
            stack: list[list] = []
            for k, value in enumerate(common):
                first, left = k, before[k]
                while stack and stack[-1][0] > value:
                    size, first, own = stack.pop()
                    own = own if own == left else None
                    if own is None:
                        yield size, self.array[lo + first : lo + k + 1]
                    left = own
                if value >= least:
                    if stack and stack[-1][0] == value:
                        stack[-1][2] = stack[-1][2] if stack[-1][2] == left else None
                    else:
                        stack.append([value, first, left])


def tree_repeats(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of all but the earliest occurrence in each maximal repeat of the texts. Strings of the least length
    that have no equal by hash can't be in one: texts without such a string stay out of the tree."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.maximum(sizes - length + 1, 0)
    of = np.repeat(np.arange(len(texts)), starts)
    at = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    hashes = window_hashes(np.frombuffer(b"".join(texts), np.uint8), [length])[length]
    _, same, count = np.unique(hashes[(np.cumsum(sizes) - sizes)[of] + at], return_inverse=True, return_counts=True)
    twin = count[same] > 1
    of, at = of[twin], at[twin]
    used = np.unique(of)
    texts, doc, start, sizes = [texts[i] for i in used.tolist()], doc[used], start[used], sizes[used]
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree = SuffixTree(texts, max(map(len, texts)), (np.cumsum(sizes) - sizes)[np.searchsorted(used, of)] + at)
    whose, where = doc[tree.text], start[tree.text] + np.arange(len(tree.text)) - tree.begin[tree.text]
    order = np.empty(len(whose), np.int64)
    order[np.lexsort((where, whose))] = np.arange(len(whose))
    # Groups nest, so a position stands in many of them: the longest in which it is not the earliest counts.
    longest = np.zeros(len(whose), np.int64)
    for size, at in tree.maximal_repeats(length):
        first = at[np.argmin(order[at])]
        own = longest[first]
        longest[at] = np.maximum(longest[at], size)
        longest[first] = own
    again = np.flatnonzero(longest)
    return whose[again], where[again], where[again] + longest[again]


def _intervals(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Joined intervals, one row for each document with its packed starts and stops."""
    doc, start, stop = joined(np.asarray(doc, np.int64), np.asarray(start, np.int64), np.asarray(stop, np.int64))
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
    packed = [p.tobytes() for p in np.split(np.stack([start, stop], axis=1), at[1:])] if len(doc) else []
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(packed, pa.binary())], ["doc", "cut"])


#: How spans travel: column by column, the minimizer by 32 bits (others that share them only ask for more bytes).
_TRAVEL = (("min", "<u4"), ("hash", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u2"))
_WIDTH = sum(np.dtype(kind).itemsize for _, kind in _TRAVEL)


def pack(found: np.ndarray) -> bytes:
    marked = found["size"] | found["self"].astype(np.int32) << 15
    return b"".join((marked if name == "size" else found[name]).astype(kind).tobytes() for name, kind in _TRAVEL)


def unpack(raw: bytes) -> np.ndarray:
    n, at = len(raw) // _WIDTH, 0
    out = np.zeros(n, SPAN)
    for name, kind in _TRAVEL:
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    out["self"] = out["size"] >> 15
    out["size"] &= 0x7FFF
    return out


def _deal(found: np.ndarray, shards: int, by: str = "min") -> tuple[list[int], list[bytes]]:
    """Spans packed by shard."""
    shard = (spread(found[by]) % _U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    found, shard = found[order], shard[order]
    at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(found) else np.zeros(0, int)
    return shard[at].tolist(), [pack(p) for p in np.split(found, at[1:])] if len(found) else []


#: How what a task sends to the shards of a partition travels, beside what only travels along (doc, cut).
_PACKED = "part int, shards array<long>, metas array<binary>, raws array<binary>, doc long, cut binary"


def packed_rows(sent: list[tuple[int, bytes, bytes]], along: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """Rows of _PACKED for what is sent (shard, meta, raw) and for what travels along (doc, cut). A shard's share is a row
    where shares are large; small ones go together by partition, or tasks times shards tiny rows would be sent."""
    apart = sum(len(m) + len(r) for _, m, r in sent) >= SHARE_BYTES * SHARDS * width
    rows: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for one in sent:
        rows.setdefault(one[0] if apart else one[0] % width, []).append(one)
    kinds = (pa.int64(), pa.binary(), pa.binary())
    lists = [pa.concat_arrays([pa.array([[one[k] for one in row] for row in rows.values()], pa.list_(kind)), pa.nulls(along.num_rows, pa.list_(kind))]) for k, kind in enumerate(kinds)]
    part = pa.concat_arrays([pa.array([shard % width for shard in rows], pa.int32()), pa.array((along.column(0).to_numpy() % width).astype(np.int32))])
    beside = [pa.concat_arrays([pa.nulls(len(rows), kind), along.column(k)]) for k, kind in enumerate((pa.int64(), pa.binary()))]
    return pa.RecordBatch.from_arrays([part, *lists, *beside], ["part", "shards", "metas", "raws", "doc", "cut"])


def dealt(rows: DataFrame, width: int) -> DataFrame:
    """Rows of _PACKED by partition, as `by_shard` takes them: rows of several shards come first."""
    alone = F.size("shards") == 1
    return rows.repartitionById(width, "part").sortWithinPartitions(alone, F.when(alone, F.col("shards")[0])).select("shards", "metas", "raws", "doc", "cut")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, list[tuple[bytes, bytes]]]]:
    """Of a partition's rows: batches (doc, cut) of those that only travel along, and for each shard all its (meta, raw)
    together. A shard's own rows are held while it lasts, and the small shares of all shards till then."""
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    current = None
    for batch in batches:
        named = batch.column(3).is_valid()
        yield batch.filter(named).select(["doc", "cut"]), []
        rest = batch.filter(pc.invert(named))
        for shards, *lists in zip(*(rest.column(k).to_pylist() for k in range(3)), strict=True):
            if len(shards) == 1:
                if current not in (None, shards[0]):
                    yield None, held.pop(current)
                current = shards[0]
            for shard, *share in zip(shards, *lists, strict=True):
                held.setdefault(shard, []).append(tuple(share))
    while held:
        yield None, held.pop(next(iter(held)))


def _identified(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def repeats(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, cut): packed intervals of repeats by document, in pieces, of rows (doc, doc_id, text)."""
    if not PIECE <= length <= 30_000:
        raise ValueError(f"the length must be from {PIECE} to 30000 bytes")
    width = shuffle_width(rows.sparkSession)
    shards = SHARDS * width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            first, again = settle(np.concatenate(held) if held else np.zeros(0, SPAN))
            own = _intervals(again["doc"], again["start"], again["start"] + again["size"])
            # Repeats that are settled already travel along, spread over the partitions by document.
            yield packed_rows([(shard, p, b"") for shard, p in zip(*_deal(first, shards), strict=True)], own, width)

        size = 0
        for whole in batches:
            for batch in slices(whole, "text", SCAN_BYTES):
                data, offsets = text_bytes(batch.column(1))
                for found in walk(data, offsets, _identified(batch.column(0)), length):
                    held.append(found)
                    size += found.nbytes
                    if size > HELD_BYTES:
                        yield from flush()
                        held.clear()
                        size = 0
        yield from flush()

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, parts in by_shard(batches):
            if done is not None:
                yield pa.RecordBatch.from_arrays([done.column(0), done.column(1), pa.nulls(done.num_rows, pa.binary()), pa.nulls(done.num_rows, pa.binary())], ["doc", "cut", "want", "hot"])
                continue
            first, again = settle(np.concatenate([unpack(p) for p, _ in parts]))
            cut = _intervals(again["doc"], again["start"], again["start"] + again["size"])
            # Different spans under one minimizer: their bytes are wanted.
            group = np.r_[0, np.cumsum(first["min"][1:] != first["min"][:-1])] if len(first) else np.zeros(0, int)
            many = np.bincount(group)[group] if len(first) else group
            asked_for = (many > 1) | first["self"]
            want = first[asked_for]
            hot = many[asked_for] > HOT
            order = np.argsort(want["doc"], kind="stable")
            want, hot = want[order], hot[order]
            at = np.flatnonzero(np.r_[True, want["doc"][1:] != want["doc"][:-1]]) if len(want) else np.zeros(0, int)
            asked = [(pack(w), h.tobytes()) for w, h in zip(np.split(want, at[1:]), np.split(hot, at[1:]), strict=True)] if len(want) else []
            n, m = cut.num_rows, len(asked)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([cut.column(0), pa.array(want["doc"][at] if m else [], pa.int64())]), pa.concat_arrays([cut.column(1), pa.nulls(m, pa.binary())]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([a for a, _ in asked], pa.binary())]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([h for _, h in asked], pa.binary())])],
                ["doc", "cut", "want", "hot"],
            )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, int, int, bytes]]] = {}
        singles: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            # Of equal strings the earliest is sent; the others are repeats of it, whatever else there is.
            first, again = settle(np.concatenate(singles) if singles else np.zeros(0, SPAN))
            cut = _intervals(again["doc"], again["start"], again["start"] + length)
            sent = [(shard, pack(np.array([(k, 0, d, s, z, False) for k, d, s, z, _ in rows], SPAN)), b"".join(p for *_, p in rows)) for shard, rows in held.items()]
            sent += [(shard, p, b"") for shard, p in zip(*_deal(first, shards, "hash"), strict=True)]
            out = packed_rows(sent, cut, width)
            held.clear()
            singles.clear()
            return out

        size = 0
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                for row in range(batch.num_rows):
                    doc, text, wants, hots = (batch.column(c)[row].as_py() for c in ("doc", "text", "wants", "hots"))
                    raw = (text or "").encode("utf-8")
                    for packed, marks in zip(wants, hots, strict=True):
                        for (low, _, _, start, n, _), single in zip(unpack(packed).tolist(), np.frombuffer(marks, bool).tolist(), strict=True):
                            piece = raw[start : start + n]
                            if len(piece) < length:
                                continue
                            if not single:
                                size += len(piece)
                                held.setdefault(low % shards, []).append((low, doc, start, n, piece))
                                continue
                            found = np.zeros(len(piece) - length + 1, SPAN)
                            found["min"], found["doc"], found["start"], found["size"] = low, doc, start + np.arange(len(found)), length
                            found["hash"] = window_hashes(np.frombuffer(piece, np.uint8), [length])[length]
                            singles.append(found)
                            size += found.nbytes
                        if size > BATCH_BYTES:
                            yield flush()
                            size = 0
        yield flush()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, parts in by_shard(batches):
            if done is not None:
                yield done
                continue
            # Single strings come without bytes.
            _, alone = settle(np.concatenate([np.zeros(0, SPAN), *(unpack(m) for m, r in parts if not r)]))
            meta, raw = np.concatenate([np.zeros(0, SPAN), *(unpack(m) for m, r in parts if r)]), b"".join(r for _, r in parts)
            at = np.r_[0, np.cumsum(meta["size"])]
            order = np.lexsort((meta["start"], meta["doc"]))
            texts, doc, start, seen = [], [], [], {}
            extra: list[tuple[int, int, int]] = []
            for i in order.tolist():  # in order of occurrence, so the first of equal strings stands
                piece = raw[at[i] : at[i + 1]]
                where = int(meta["doc"][i]), int(meta["start"][i])
                if piece not in seen:
                    seen[piece] = where
                    texts.append(piece)
                    doc.append(where[0])
                    start.append(where[1])
                elif seen[piece] != where:
                    extra.append((*where, where[1] + len(piece)))
            d, s, e = tree_repeats(texts, np.array(doc, np.int64), np.array(start, np.int64), length)
            more = np.array(extra, np.int64).reshape(-1, 3)
            yield _intervals(np.r_[d, more[:, 0], alone["doc"]], np.r_[s, more[:, 1], alone["start"]], np.r_[e, more[:, 2], alone["start"] + length])

    found = rows.select("doc", "text").mapInArrow(scan, _PACKED)
    settled = stage(dealt(found, width).mapInArrow(copies, "doc long, cut binary, want binary, hot binary"), "repeat-copies", "zstd")
    asked = settled.where("want is not null").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("want", "hot"))).alias("w")).select("doc", F.col("w.want").alias("wants"), F.col("w.hot").alias("hots"))
    # doc_id rides along unread: so this shuffle of the texts is the one that the caller's join needs again.
    pieces = rows.join(asked, "doc").select("doc", "doc_id", "text", "wants", "hots").mapInArrow(fetch, _PACKED)
    grown = dealt(pieces, width).mapInArrow(trees, "doc long, cut binary")
    return settled.where("cut is not null").select("doc", "cut").unionByName(grown)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (the remaining bytes)."""
    # Rows without an id are documents by their text, below every id.
    nameless = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    rows = with_ids(docs, id_col, text_col).select(F.coalesce("doc_id", nameless).alias("doc"), "doc_id", "text")
    cuts = repeats(rows, length).groupBy("doc").agg(F.collect_list("cut").alias("cuts"))
    both = rows.join(cuts, "doc", "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                out: list[tuple[int, int, int, str, bytes | None]] = []
                for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8")
                    pairs = np.frombuffer(b"".join(cuts or []), np.int64).reshape(-1, 2)
                    _, start, stop = joined(np.zeros(len(pairs), np.int64), pairs[:, 0], np.minimum(pairs[:, 1], len(raw)))
                    kept = b"".join(raw[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(raw)], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if keep_text else 4]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeats of 100 bytes."""
    return remove_repeats(read(spark, sf_dir, "documents"), keep_text=False)

"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Five-word seeds shared with a benchmark item name the pairs worth tiling. A pair is tiled on words: the
longest common run of unmarked words is marked in both, again and again, down to runs of five words;
candidates of a length are found with rolling hashes and compared word by word. A document is
contaminated by an item if the tiles cover at least 80 % of the item's words, in whatever order the
passages stand. Every tile holds a seed, so the seeds' own cover bounds the tiles' cover from above, and
pairs below the threshold by that bound need no tiling.

The benchmark is the stated query set: it is counted first, and dealt in blocks of a bounded number of
items and bytes, each a broadcast; in a task, texts are joined with a block's items by the hashes of their shared
seeds. Documents are read and hashed once, never shuffled, and looked at by one block after another, so no key, source
or common passage can gather rows.

Defined cases: items without a word match nothing, items under five words match as one whole run; null
or empty texts match nothing; repeated document rows are reported each; several items may match one
document; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import in_turn, read, slices, stage, to_tasks, with_ids
from .words import HashSet, powers, shingle_hashes, word_hashes

SEED_WORDS = 5
COVERAGE = 0.8
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
BATCH_BYTES = 1 << 19
#: Words, by their hashes, that a task holds while the blocks take their turns.
HELD_WORDS = 1 << 21
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each run of `size` words, modulo 2 ** 64."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    up = powers(_BASE, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    down = powers(_INVERSE, len(words) + 1 - size)  # brings every run back to power zero
    return (total[size:] - total[:-size]) * down


def _free_runs(marked: np.ndarray, size: int) -> np.ndarray:
    total = np.r_[0, np.cumsum(marked)]
    return np.flatnonzero(total[size:] == total[:-size]) if len(marked) >= size else np.zeros(0, np.int64)


def tiles(item: np.ndarray, text: np.ndarray, least: int, used_t: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in text, words), the longest first and of equals the first in item, then in
    text; none overlaps another. Words of the text that `used_t` marks take no part.

    Lengths are worked off from the longest at which unmarked runs agree, so all matches of a length are whole: none
    of them can be extended. A run of the text that has become marked is dead for all runs of the item, so
    equal runs are walked once on each side, however often they repeat.
    """
    least = min(least, len(item))
    if not least or len(text) < least:
        return []
    used_i, used_t = np.zeros(len(item), bool), np.zeros(len(text), bool) if used_t is None else used_t.copy()
    done: list[tuple[int, int, int]] = []
    size = _longest(item, text, used_i, used_t, min(len(item), len(text)), least)
    while True:
        free_i, free_t = _free_runs(used_i, size), _free_runs(used_t, size)
        if len(free_i) and len(free_t):
            hashes_i, hashes_t = _rolling(item, size)[free_i], _rolling(text, size)[free_t]
            order = np.argsort(hashes_t, kind="stable")
            hashes_t, free_t = hashes_t[order], free_t[order]
            begin, end = np.searchsorted(hashes_t, hashes_i, side="left"), np.searchsorted(hashes_t, hashes_i, side="right")
            at: dict[int, int] = {}  # the first run of the text that may be alive, by hash
            for k in np.flatnonzero(begin < end).tolist():
                i, first, stop = int(free_i[k]), int(begin[k]), int(end[k])
                # Tiles of this length mark either none or an end of a run.
                if used_i[i] or used_i[i + size - 1]:
                    continue
                n = at.get(first, first)
                while n < stop and (used_t[free_t[n]] or used_t[free_t[n] + size - 1]):
                    n += 1
                at[first] = n
                if n < stop and (item[i : i + size] == text[(t := int(free_t[n])) : t + size]).all():
                    used_i[i : i + size] = used_t[t : t + size] = True
                    done.append((i, t, size))
        if size == least:
            return done
        # What a longer tile has cut may still hold shorter ones, so every length down to the least is tried
        # once no longer run is left.
        size = _longest(item, text, used_i, used_t, size - 1, least)


def _longest(item: np.ndarray, text: np.ndarray, used_i: np.ndarray, used_t: np.ndarray, most: int, least: int) -> int:
    """The largest size up to `most` at which unmarked runs still agree by hash (a binary search)."""
    low, high = least, most
    while low < high:
        mid = (low + high + 1) // 2
        free_i, free_t = _free_runs(used_i, mid), _free_runs(used_t, mid)
        if len(free_i) and len(free_t) and np.isin(_rolling(item, mid)[free_i], _rolling(text, mid)[free_t]).any():
            low = mid
        else:
            high = mid - 1
    return low


class Benchmark:
    """One block of items: their word hashes and the seeds that lead to them."""

    def __init__(self, ids: list[int], texts: list[str | None], seed_words: int = SEED_WORDS):
        words, at = word_hashes(pa.array(texts, pa.string()))
        self.ids, self.seed_words = ids, seed_words
        self.items = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.sets: dict[int, HashSet] = {}
        # Seeds of one width: item and position of each, and where each distinct seed's owners begin.
        self.owners: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({min(seed_words, len(w)) for w in self.items} - {0}):
            mine = [k for k, w in enumerate(self.items) if min(seed_words, len(w)) == width]
            seeds = [shingle_hashes(self.items[k], width) for k in mine]
            size = [len(x) for x in seeds]
            found = np.concatenate(seeds)
            order = np.argsort(found, kind="stable")
            self.sets[width] = HashSet(found)
            item, place = np.repeat(mine, size)[order], np.concatenate([np.arange(n) for n in size])[order]
            self.owners[width] = (item, place, np.r_[np.searchsorted(found[order], self.sets[width].members), len(found)])

    def matches(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, share of the item's words covered, tiles, words of the longest tile)."""
        return self.found(*word_hashes(texts), coverage)

    def found(self, words: np.ndarray, at: np.ndarray, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
        """The same for texts whose words are hashed already."""
        for width, members in self.sets.items():
            where, rank = members.hits(shingle_hashes(words, width))
            row = np.searchsorted(at, where, side="right") - 1
            whole = where + width <= at[row + 1]
            where, rank, row = where[whole], rank[whole], row[whole]
            cut = np.searchsorted(row, np.arange(len(at)))
            for r in np.unique(row).tolist():
                yield from self._tiled(r, words, where[cut[r] : cut[r + 1]], rank[cut[r] : cut[r + 1]], width, coverage)

    def _tiled(self, r: int, words: np.ndarray, where: np.ndarray, rank: np.ndarray, width: int, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
        item, place, begin = self.owners[width]
        seen = np.unique(rank)
        size = begin[seen + 1] - begin[seen]
        at = np.repeat(begin[seen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        # Seeds and items that share them, by item: the join of the text with the block's items.
        of, seed = item[at], np.repeat(seen, size)
        order = np.argsort(of, kind="stable")
        of, seed, place = of[order], seed[order], place[at][order]
        edge = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            k = int(of[a])
            n = len(self.items[k])
            covered = np.zeros(n, bool)
            covered[(place[a:b, None] + np.arange(width)).ravel()] = True
            if covered.sum() < coverage * n:
                continue
            # Every tile is made of the item's seeds, so only the words that they cover are laid out, with a marked
            # word wherever others were between them.
            starts = where[np.isin(rank, seed[a:b])]
            mine = np.unique((starts[:, None] + np.arange(width)).ravel()) if width > 1 else starts
            gap = np.flatnonzero(np.diff(mine) > 1) + 1
            text = np.insert(words[mine], gap, np.uint64(0))
            out = np.insert(np.zeros(len(mine), bool), gap, True)
            laid = tiles(self.items[k], text, self.seed_words, out)
            if (share := sum(x for *_, x in laid) / n) >= coverage:
                yield r, k, share, len(laid), max(x for *_, x in laid)


def blocks(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", seed_words: int = SEED_WORDS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> list[Callable[[], Benchmark]]:
    """The items in blocks of about block_items items and block_bytes of text, dealt by hash (an item that is longer
    alone fills a block). The driver and a task hold one block at a time; each is broadcast, and read from disk."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    total = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-total.n // block_items), -(-(total.bytes or 0) // block_bytes))
    if n > 1:
        items = stage(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition(n, "block").sortWithinPartitions("block"), "benchmark-blocks", "zstd")
    out = []
    for b in range(n):
        part = [(r.item_id, r.text) for r in (items if n == 1 else items.where(F.col("block") == b)).select("item_id", "text").toLocalIterator()]
        part.sort(key=lambda x: (x[0] is None, x[0], x[1] or ""))
        send = to_tasks if n == 1 else in_turn
        out.append(send(benchmark.sparkSession, Benchmark([x[0] for x in part], [x[1] for x in part], seed_words)))
    return out


def _searched(batches: Iterator[pa.RecordBatch], text: int, held: list[Callable[[], Benchmark]], coverage: float) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int | None, float, int, int]]]]:
    """(rows, their hits as (row, item id, share, tiles, longest)) for all rows: texts are hashed once and kept as hashes
    until there are HELD_WORDS of them, or one block is all there is; then every block in turn looks at them."""
    kept: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

    def search() -> Iterator[tuple[pa.RecordBatch, list]]:
        hits: list[list] = [[] for _ in kept]
        for get in held:
            block = get()
            for own, (_, words, at) in zip(hits, kept, strict=True):
                own += [(row, block.ids[item], *rest) for row, item, *rest in block.found(words, at, coverage)]
        yield from zip((rows for rows, _, _ in kept), hits, strict=True)

    size = 0
    for whole in batches:
        for batch in slices(whole, text, BATCH_BYTES):
            kept.append((batch, *word_hashes(batch.column(text))))
            size += len(kept[-1][1])
            if len(held) == 1 or size > HELD_WORDS:
                yield from search()
                kept.clear()
                size = 0
    if kept:
        yield from search()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, **how) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles and longest_tile of every contaminated document and its items. Documents are
    read and hashed once, whatever the number of blocks."""
    held = blocks(benchmark, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hits in _searched(batches, 1, held, coverage):
            ids = rows.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64()), pa.array([h[3] for h in hits], pa.int32()), pa.array([h[4] for h in hits], pa.int32())],
                ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"],
            )

    return with_ids(docs, id_col, text_col).mapInArrow(run, "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", coverage: float = COVERAGE, **how) -> DataFrame:
    """The documents, with all their columns, that no item contaminates; they are read once and not shuffled."""
    held, at = blocks(benchmark, **how), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hits in _searched(batches, at, held, coverage):
            clean = np.ones(rows.num_rows, bool)
            clean[[h[0] for h in hits]] = False
            yield rows.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and how much of it is covered."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

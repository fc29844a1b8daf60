"""Phrase collocations from vertical positional inverted lists.

1. Lists. A task turns its texts into blocks of at most BLOCK word occurrences. A block is kept as an inverted index: its
   distinct words and for each the list of its positions. Pieces and documents are a position apart, so words of
   two pieces never stand side by side.
2. Frequency. The length of a word's list is its frequency in the block. Blocks send (word, length) in packed rows to
   the word's shard; the sum over all blocks is the exact frequency. The shard answers each block which of its words
   are frequent, and asks one block for the word's letters.
3. Extension. In each block the position lists of frequent phrases are merge-joined with the postings of the words that
   stand right behind them: a phrase of m words goes on where the phrase of its last m - 1 words starts a position later
   and is frequent too (no frequent phrase has a rare part). The new lists' lengths go to shards as before.
4. Scores. Frequent phrases of all lengths are joined with the frequencies of their parts at every cut.

A block and a shard's share are all that a task holds; a phrase is sent once by a block however frequent it is, so no
word, language or document is hot.

Defined cases: a null text is empty; A-Z are lower-cased, other letters stay; a null language counts as `und`; equal
rows count as often as they stand; an empty table gives an empty result. A text is cut only between pieces, so a piece is
held whole. Words and phrases are compared by 64-bit hashes that include the language; a word's letters are those of
the first block. Only the text and the language are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import bucketed, discard, read, shuffle_width, slices, small, stage, text_bytes, unbucket
from .words import FOLDED, spread, walk_runs

LONGEST, LEAST, SHARE, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: Word occurrences in a block.
BLOCK = 1 << 20
#: Shards in a partition: a task holds one shard's lengths at a time.
SHARDS = 4
BATCH_BYTES = 1 << 20
NO_LANGUAGE = "und"
_U = np.uint64
#: What ends a piece: . , ; : ! ? and the line ends \\x0A-\\x0D. Space and tab part words.
_STOP = np.array([chr(b) in ".,;:!?" or 10 <= b <= 13 for b in range(256)])
_MEMBER = ~(_STOP | np.array([b in (9, 32) for b in range(256)]))
#: Gaps in a list of positions from here on are written in four bytes more.
WIDE = 0xFFFF


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, first byte, end, whether it begins a piece) of every word of the texts, and n + 1 offsets of their words."""
    hashes, begin, end = walk_runs(data, offsets, _MEMBER, FOLDED)
    stops, at = np.flatnonzero(_STOP[data]), np.searchsorted(begin, offsets)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = np.searchsorted(stops, begin[1:]) > np.searchsorted(stops, end[:-1])
    fresh[at[:-1][at[:-1] < len(fresh)]] = True
    return hashes, begin, end, fresh, at


def extended(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase and a word behind it."""
    return spread(phrase * _U(3) + word)


class Block:
    """An inverted index of a stretch of text: sorted word keys, their languages and letters, and their positions."""

    COLUMNS = ("keys", "counts", "short", "wide", "names", "language", "size", "letters")

    def __init__(self, keys: np.ndarray, counts: np.ndarray, positions: np.ndarray, names: list[str], language: np.ndarray, letters: list[bytes]):
        self.keys, self.counts, self.positions = keys, counts, positions
        self.names, self.language, self.letters = names, language, letters

    @classmethod
    def of(cls, keys: np.ndarray, fresh: np.ndarray, language: np.ndarray, names: list[str], letters: Callable[[int], bytes]) -> Block:
        """From occurrences in text order; letters(i) gives the i-th occurrence's word."""
        place = np.arange(len(keys)) + np.cumsum(fresh)  # a gap before every piece
        order = np.argsort(keys, kind="stable")
        found = keys[order]
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        used, language = np.unique(language[order[first]], return_inverse=True)
        return cls(found[first], np.diff(np.r_[first, len(found)]), place[order], [names[i] for i in used.tolist()], language, [letters(i) for i in order[first].tolist()])

    def pack(self) -> tuple[bytes, ...]:
        """The positions as gaps of two bytes, wider ones apart."""
        first = np.cumsum(self.counts) - self.counts
        gap = np.diff(self.positions, prepend=0)
        gap[first] = self.positions[first]
        wide = gap >= WIDE
        size = np.fromiter(map(len, self.letters), np.int64, len(self.letters))
        names = "\0".join(self.names).encode()
        return self.keys.tobytes(), self.counts.astype("<i4").tobytes(), np.where(wide, WIDE, gap).astype("<u2").tobytes(), gap[wide].astype("<u4").tobytes(), names, self.language.astype("<i4").tobytes(), size.astype("<i4").tobytes(), b"".join(self.letters)

    @classmethod
    def unpack(cls, keys: bytes, counts: bytes, short: bytes, wide: bytes, names: bytes, language: bytes, size: bytes, letters: bytes) -> Block:
        lengths, gap = np.frombuffer(counts, "<i4").astype(np.int64), np.frombuffer(short, "<u2").astype(np.int64)
        gap[gap == WIDE] = np.frombuffer(wide, "<u4")
        first, total = np.cumsum(lengths) - lengths, np.cumsum(gap)
        ends = np.cumsum(np.frombuffer(size, "<i4")).tolist()  # none if the letters were not asked for
        cut = [letters[a:b] for a, b in zip([0, *ends[:-1]] if ends else [], ends, strict=True)]
        return cls(np.frombuffer(keys, "<u8"), lengths, total - np.repeat((total - gap)[first], lengths), names.decode().split("\0"), np.frombuffer(language, "<i4"), cut)

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """All positions in order, and the number of the word at each."""
        order = np.argsort(self.positions, kind="stable")
        return self.positions[order], np.repeat(np.arange(len(self.keys)), self.counts)[order]


def extend(start: np.ndarray, width: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of the starts of phrases of `width` words with the postings right behind them, both in order: which
    starts go on, and the posting behind each."""
    behind = np.searchsorted(place, start + width)
    goes = behind < len(place)
    goes[goes] = place[behind[goes]] == start[goes] + width
    return np.flatnonzero(goes), behind[goes]


class Lists:
    """The position lists of a block's frequent phrases of `width` words, in the order of the positions."""

    def __init__(self, block: Block, width: int, frequent: np.ndarray):
        """`frequent` holds the sorted keys of the phrases."""
        self.block, self.width = block, width
        self.place, self.word = block.postings()
        keys = block.keys[self.word]
        self.start, self.key = self.place, keys
        for m in range(1, width):
            goes, behind = extend(self.start, m, self.place)
            self.start, self.key = self.start[goes], extended(self.key[goes], keys[behind])
        rank = np.minimum(np.searchsorted(frequent, self.key), max(len(frequent) - 1, 0))
        known = frequent[rank] == self.key if len(frequent) else np.zeros(len(self.key), bool)
        self.start, self.key = self.start[known], self.key[known]

    def longer(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, lengths of the lists) of the phrases of a word more whose first and last `width` words are frequent."""
        goes, behind = extend(self.start, self.width, self.place)
        start, key = self.start[goes], extended(self.key[goes], self.block.keys[self.word[behind]])
        at = np.searchsorted(self.start, start + 1)  # the last words are a frequent phrase that starts a position later
        both = at < len(self.start)
        both[both] = self.start[at[both]] == start[both] + 1
        return np.unique(key[both], return_counts=True)

    def named(self, wanted: np.ndarray) -> Iterator[tuple[int, str, str, list[int], list[int]]]:
        """(key, language, phrase, keys of its first words, keys of its last words) for the wanted keys, cut after each
        of its words but the last."""
        found, first = np.unique(self.key, return_index=True)
        first = first[np.isin(found, wanted)]
        words = self.word[np.searchsorted(self.place, self.start[first])[:, None] + np.arange(self.width)]
        keys = self.block.keys[words]
        ends = []  # [a][b]: the key of the words from a to b
        for a in range(self.width):
            of, row = keys[:, a], {}
            for b in range(a, self.width):
                of = extended(of, keys[:, b]) if b > a else of
                row[b] = of.view(np.int64).tolist()
            ends.append(row)
        for i, row in enumerate(words.tolist()):
            phrase = b" ".join(self.block.letters[w] for w in row).decode("utf-8")
            lefts, rights = [ends[0][k - 1][i] for k in range(1, self.width)], [ends[k][self.width - 1][i] for k in range(1, self.width)]
            yield ends[0][self.width - 1][i], self.block.names[self.block.language[row[0]]], phrase, lefts, rights


def blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = BLOCK) -> DataFrame:
    """One row for each block."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        names: dict[str, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(x[5]) for x in held)]).tolist()
            keys, fresh, language = (np.concatenate([x[c] for x in held]) for c in range(3))
            begin, end = (np.concatenate([x[c] + b for x, b in zip(held, base, strict=False)]) for c in (3, 4))
            raw = b"".join(x[5] for x in held)
            row = Block.of(keys, fresh, language, list(names), lambda i: raw[begin[i] : end[i]].lower()).pack()
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in row)], ["block", *Block.COLUMNS])

        for whole in batches:
            for batch in slices(whole, 0, BATCH_BYTES):
                data, offsets = text_bytes(batch.column(0))
                hashes, begin, end, fresh, at = words_of(data, offsets)
                spoken = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
                salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names], np.uint64)
                of = np.repeat(spoken, np.diff(at))
                keys, starts = spread(hashes ^ salt[of]), np.flatnonzero(fresh)
                cuts = np.unique(np.r_[_cuts(starts, len(keys), most), len(keys)])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    lo, hi = int(begin[a]), int(end[b - 1])
                    held.append((keys[a:b], fresh[a:b], of[a:b], begin[a:b] - lo, end[a:b] - lo, data[lo:hi].tobytes()))
                    size += b - a
                    if size >= most:
                        yield flush()
                        held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return rows.mapInArrow(run, "block long, " + ", ".join(f"{c} binary" for c in Block.COLUMNS))


def _cuts(starts: np.ndarray, n: int, most: int) -> np.ndarray:
    """Starts of pieces, each the first at or after a multiple of `most`."""
    at = np.searchsorted(starts, np.arange(0, n, most))
    return starts[at[at < len(starts)]]


def _dealt(block: int, keys: np.ndarray, lengths: np.ndarray, shards: int) -> list[tuple]:
    """(shard, block, keys, lengths) rows."""
    shard = (keys % _U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    cut = [np.split(x[order], first[1:]) for x in (keys, lengths.astype("<i4"))]
    return [(s, block, k.tobytes(), n.tobytes()) for s, k, n in zip(found.tolist(), *cut, strict=True)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_LENGTHS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary())])
_NAMES = pa.schema([("shard", pa.int64()), ("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("lefts", pa.list_(pa.int64())), ("rights", pa.list_(pa.int64())), ("n", pa.int64())])
_NAMED = "key long, lang string, phrase string, lefts array<long>, rights array<long>, n long"
#: Lengths, or a phrase with its parts' keys, or a language with its number of words.
_SENT = f"shard long, block long, keys binary, lengths binary, {_NAMED}"
#: A shard's answer to a block (keys, and which of them it shall name), its frequent keys and totals, or what came named.
_TOLD = f"block long, keys binary, speak binary, totals binary, {_NAMED}"


def tally(sent: DataFrame, least: int = LEAST) -> DataFrame:
    """The shards' answers to the lengths that the blocks have sent; names pass."""
    width = shuffle_width(sent.sparkSession)

    def settle(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(k, "<u8") for _, k, _ in rows])
        owner = np.repeat(np.array([b for b, _, _ in rows]), [len(k) // 8 for _, k, _ in rows])
        lengths = np.concatenate([np.frombuffer(n, "<i4") for _, _, n in rows]).astype(np.int64)
        order = np.lexsort((owner, keys))
        keys, owner, lengths = keys[order], owner[order], lengths[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        total = np.add.reduceat(lengths, np.flatnonzero(first))
        often = total >= least
        mine = often[np.cumsum(first) - 1]
        own, told, speak = owner[mine], keys[mine], first[mine]
        order = np.argsort(own, kind="stable")
        block, begin = np.unique(own[order], return_index=True)
        parts = [np.split(x[order], begin[1:]) for x in (told, speak)] if len(block) else [[], []]
        rows = [(b, k.tobytes(), s.tobytes(), None) for b, k, s in zip(block.tolist(), *parts, strict=True)]
        return _rows([*rows, (None, keys[first][often].tobytes(), None, total[often].tobytes())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(rows), f.type) for f in list(_NAMES)[1:])], ["block", "keys", "speak", "totals", *_NAMES.names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        current = None
        for batch in batches:
            lengths = batch.column("block").is_valid()
            said, batch = batch.filter(pc.invert(lengths)), batch.filter(lengths)
            if said.num_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(said.num_rows, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())] + [said.column(c) for c in _NAMES.names[1:]], ["block", "keys", "speak", "totals", *_NAMES.names[1:]])
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "keys", "lengths")), strict=True):
                if shard != current and held:
                    yield settle(held)
                    held = []
                current = shard
                held.append(tuple(row))
        if held:
            yield settle(held)

    return sent.repartition(width, "shard").sortWithinPartitions("shard").mapInArrow(run, _TOLD)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases of 2 to `longest` words."""
    shards = SHARDS * shuffle_width(docs.sparkSession)
    index = bucketed(blocks(docs, lang_col, text_col, block), "blocks", "block")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys, counts, names, language in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                keys, counts = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i4").astype(np.int64)
                total = np.bincount(np.frombuffer(language, "<i4"), counts)
                said = [(number % shards, None, name, None, None, None, int(n)) for name, n in zip(names.decode().split("\0"), total.tolist(), strict=True)]
                yield from _beside(_dealt(number, keys, counts, shards), said).to_batches()

    def step(width: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(mine: pa.Table, told: pa.Table) -> pa.Table:
            if not mine.num_rows or not told.num_rows:
                return _beside([], [])
            row = mine.to_pylist()[0]
            keys = np.frombuffer(b"".join(told.column("keys").to_pylist()), "<u8")
            speak = np.frombuffer(b"".join(told.column("speak").to_pylist()), bool)
            lists = Lists(Block.unpack(*(row.get(c, b"") for c in Block.COLUMNS)), width, np.sort(keys))
            dealt = [] if last else _dealt(row["block"], *lists.longer(), shards)
            said = [] if width == 1 else [(x[0] % shards, *x, None) for x in lists.named(keys[speak])]
            return _beside(dealt, said)

        return run

    told = [stage(tally(index.select("block", "keys", "counts", "names", "language").mapInArrow(lengths, _SENT), least), "tally", "zstd")]
    for width in range(1, longest + 1):
        asked = told[-1].where("block is not null").select(F.col("block").alias("to"), "keys", "speak")
        needed = index if width > 1 else index.select("block", *Block.COLUMNS[:4])  # words are named by longer phrases
        sent = needed.groupBy("block").cogroup(asked.groupBy("to")).applyInArrow(step(width, width == longest), _SENT)
        told.append(stage(tally(sent, least) if width < longest else sent.select(*[F.lit(None).cast(t).alias(n) for n, t in (("block", "long"), ("keys", "binary"), ("speak", "binary"), ("totals", "binary"))], *_NAMES.names[1:]), "tally", "zstd"))
    unbucket(index)
    out = stage(_ranked(_totals(told), told, share, top), "collocations")
    discard(*told)
    return out


def _beside(dealt: list[tuple], said: list[tuple]) -> pa.Table:
    """Rows of either kind, the other columns null."""
    whole = pa.schema([*_LENGTHS, *list(_NAMES)[1:]])
    tables = [_table(dealt, _LENGTHS), _table(said, _NAMES)]
    rows = [pa.Table.from_arrays([t.column(f.name) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in whole], schema=whole) for t in tables]
    return pa.concat_tables(rows).combine_chunks()


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def _totals(told: list[DataFrame]) -> DataFrame:
    """key, f of every frequent word and phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, totals in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")), pa.array(np.frombuffer(totals, "<i8"))], ["key", "f"])

    return _union([t.where("totals is not null").select("keys", "totals") for t in told]).mapInArrow(run, "key long, f long")


def _ranked(totals: DataFrame, sent: list[DataFrame], share: int, top: int) -> DataFrame:
    said = _union([t.select(*_NAMES.names[1:]) for t in sent])
    words = said.where("key is null and n is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    found = said.where("key is not null").select("key", "lang", "phrase", "lefts", "rights").join(totals.withColumnRenamed("f", "a"), "key")
    cuts = found.select("key", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "cut")).select("key", "a", "k", F.col("cut.lefts").alias("left"), F.col("cut.rights").alias("right"))
    cuts = cuts.join(totals.toDF("left", "l"), "left").join(totals.toDF("right", "r"), "right")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", exact("a") * exact("a") * F.lit(SCALE).cast("decimal(7,0)"), exact("l") * exact("r"))
    best = cuts.groupBy("key").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    # What a phrase is part of is part of, or is, a candidate of one word more, which is at least as frequent.
    longer = found.where(F.size("lefts") > 1)
    longer = longer.select(F.element_at("lefts", -1).alias("key"), "a").union(longer.select(F.element_at("rights", 1), "a")).groupBy("key").agg(F.max("a").alias("within"))
    out = found.select("key", "lang", "phrase", "a").join(best, "key").join(longer, "key", "left").where(f"within is null or 100 * within < {share} * a")
    # A language's first phrases come from the first of each of its parts, so that the last task gets parts x top rows at
    # most, however many tasks the phrases come from.
    parts = math.isqrt(shuffle_width(out.sparkSession)) + 1
    for by in (["lang", F.pmod(F.xxhash64("key"), F.lit(parts))], ["lang"]):
        first = Window.partitionBy(*by).orderBy(F.desc("best.score"), F.desc("a"), "phrase")
        out = out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return out.join(small(words), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of every language."""
    return collocations(read(spark, sf_dir, "documents"))

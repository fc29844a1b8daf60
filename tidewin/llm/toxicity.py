"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit. Of the labelled rows offered, at most `examples` of each class (those with the smallest id hashes), with at
most `most_bytes` of text (two documented bounds), once for each text, become examples. All their words are index terms. Document frequencies,
and the number of documents, are counted over all documents. A term's weight in a text is
(1 + ln tf) * idf * rf, where idf = ln((1 + N) / (1 + df)) and rf = log2(2 + toxic examples / clean examples that hold it) is the term's relevance
factor; plain TF-IDF finds texts on the same subject, whether toxic or not (figures in the README).

Search. Postings are held by term and block of consecutive examples, each pair with its largest weight. A query
adds up, for each block, its own weights times the pairs' largest: no example of the block can be nearer than that.
Blocks are opened from the highest bound down, some at a time, and the search ends when the bounds left fall below
the k-th best similarity, so the k nearest are exact. Ties go to the smaller example number.

Score. Neighbours vote with the square of their similarity; a prior vote stands in where nothing is near. An
example with the query's own text is left out, so a text's label is no input of its score. The votes of the
examples themselves, each searched like that, fix the map from votes to probabilities (class shares in vote bins,
made monotone, weighted back to the labels' class balance), so scores are calibrated. The nearest examples are
returned as evidence.

Defined cases: a null, empty or wordless text, or one without an index term, has no neighbour and gets
the prior's score; without labels of both classes every score is the share of toxic labels (0 if none);
repeated label rows count once, and so do examples with one text, as toxic if any says so; of labelled documents that
share an id the text that sorts first teaches, and a text longer than the bound teaches nothing; repeated rows are scored
each, and equal texts alike; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import held_out, keep_rows, read, slices, stage, to_tasks, with_ids
from .words import HashSet, word_hashes

EXAMPLES = 1024
#: Text of each class's examples.
MOST_BYTES = 16 << 20
NEIGHBOURS = 15
BLOCK = 64
#: Blocks opened first; each later step may open four times as many.
OPENED = 4
PRIOR_VOTE = 0.05
EVIDENCE = 3
THRESHOLD = 0.7
BATCH_BYTES = 1 << 19
#: Commonest words by which examples are put next to each other.
ALIKE = 3
#: Scores of the latest texts that a task keeps, since copies often stand together.
KEPT = 4096
#: Parts in which term counts travel.
PARTS = 16


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 .. for size[0] numbers, then from begin[1] on, and so on."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


class BlockMaxIndex:
    """Postings of unit vectors by (term, block of BLOCK consecutive examples), each pair with its largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        pair = term * max(self.blocks, 1) + self.example // BLOCK
        self.begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        self.size = np.diff(np.r_[self.begin, len(pair)])
        self.block = (self.example[self.begin] // BLOCK).astype(np.int64)
        self.top = np.maximum.reduceat(self.weight, self.begin) if len(pair) else np.zeros(0)
        # of[t] .. of[t + 1] are the pairs of term t.
        self.of = np.searchsorted(term[self.begin], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> list[tuple[float, int]]:
        """The k (similarity, example) with the greatest positive similarity, of equals the smaller example."""
        count = self.of[terms + 1] - self.of[terms]
        pairs, mine = ranges(self.of[terms], count), np.repeat(weights, count)
        block = self.block[pairs]
        bound = np.bincount(block, mine * self.top[pairs], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        best_s, best_e = np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, OPENED
        while at < self.blocks:
            chosen = order[at : at + step]
            # Sums in another order may differ in the last bits: a bound this close is still opened.
            least = best_s[-1] - 1e-9 if len(best_s) == k else 0.0
            chosen = chosen[(bound[chosen] >= least) & (bound[chosen] > 0)]
            at, step = at + step, 4 * step
            if not len(chosen):
                break
            opened = np.zeros(self.blocks, bool)
            opened[chosen] = True
            some = opened[block]
            size = self.size[pairs[some]]
            where = ranges(self.begin[pairs[some]], size)
            near = np.round(np.bincount(self.example[where], np.repeat(mine[some], size) * self.weight[where], minlength=self.n), 12)
            if but >= 0:
                near[but] = 0
            found = np.flatnonzero(near)
            s, e = np.r_[best_s, near[found]], np.r_[best_e, found]
            first = np.lexsort((e, -s))[:k]
            best_s, best_e = s[first], e[first]
        return list(zip(best_s.tolist(), best_e.tolist(), strict=True))


class Model:
    """What scoring needs: the terms, their weights, the index, the examples' labels and the map to probabilities."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, ids: list[int], toxic: np.ndarray, own: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], share: float, k: int):
        """`own` holds the hashes of the examples' texts."""
        self.terms, self.weight, self.ids, self.toxic, self.share, self.k = HashSet(hashes), weight, ids, toxic, share, k
        self.own = {h: e for e, h in enumerate(own)}
        # Classes vote as if they had as many examples each.
        self.say = np.where(toxic == 1, 1 / max(1, (toxic == 1).sum()), 1 / max(1, (toxic == 0).sum())) * len(toxic) / 2
        self.index = BlockMaxIndex([self.unit(t, n) for t, n in vectors], len(weight))
        self.edges, self.value = np.zeros(0), np.array([share])
        self.memory: dict[int, tuple[float, list]] = {}

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w

    def near(self, text: int, terms: np.ndarray, counts: np.ndarray) -> list[tuple[float, int]]:
        """The nearest examples of a text with this hash and these terms, but for one with the same text."""
        return self.index.nearest(*self.unit(terms, counts), self.k, self.own.get(text, -1)) if len(terms) else []

    def vote(self, near: list[tuple[float, int]]) -> float:
        votes = [(s * s * self.say[e], self.toxic[e]) for s, e in near]
        return float((sum(v * y for v, y in votes) + PRIOR_VOTE * self.share) / (sum(v for v, _ in votes) + PRIOR_VOTE))

    def calibrate(self, votes: np.ndarray) -> None:
        """`votes`: of the examples, in their order."""
        self.edges, self.value = calibration(votes, self.toxic, np.where(self.toxic == 1, self.share / self.toxic.mean(), (1 - self.share) / (1 - self.toxic.mean())))

    def score(self, text: int, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float, int]]]:
        if text not in self.memory:
            near = self.near(text, terms, counts)
            probability = float(self.value[np.searchsorted(self.edges, self.vote(near), side="right")])
            if len(self.memory) >= KEPT:
                self.memory.clear()
            self.memory[text] = probability, [(self.ids[e], s, int(self.toxic[e])) for s, e in near[:EVIDENCE]]
        return self.memory[text]


def calibration(votes: np.ndarray, truth: np.ndarray, weight: np.ndarray, bins: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(edges, value): the probability of label 1 as a non-decreasing step function of the vote."""
    edges = np.unique(np.quantile(votes, np.linspace(0, 1, bins + 1)[1:-1]))
    at = np.searchsorted(edges, votes, side="right")
    mass, ones = np.bincount(at, weight, len(edges) + 1), np.bincount(at, weight * truth, len(edges) + 1)
    prior = ones.sum() / mass.sum()
    pools: list[list[float]] = []  # adjacent violators: [ones, mass, bins]
    for one, all_ in zip((ones + prior / 10).tolist(), (mass + 0.1).tolist(), strict=True):
        pools.append([one, all_, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    return edges, np.concatenate([np.full(int(n), o / m) for o, m, n in pools])


def term_counts(texts: pa.Array, terms: HashSet) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text its hash, the ranks of the index terms in it, and how often each stands there."""
    words, at = word_hashes(texts)
    where, rank = terms.hits(words)
    cut = np.searchsorted(where, at)
    for text, a, b in zip(texts, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield xxhash.xxh64_intdigest(text.as_buffer() or b"" if text.is_valid else b""), *np.unique(rank[a:b], return_counts=True)


def document_frequencies(rows: DataFrame, terms: HashSet) -> tuple[int, np.ndarray]:
    """The number of rows (text: second column), and of those that hold each term. A task sends its counts in PARTS
    packed pieces, which are added up by part, so one array of the terms comes to the driver."""
    cuts = np.linspace(0, len(terms.members) + 1, PARTS + 1).astype(int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(terms.members) + 1, np.int64)  # the last one counts rows
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                seen[-1] += batch.num_rows
                for _, t, _ in term_counts(batch.column(1), terms):
                    seen[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([seen[a:b].astype(np.int64).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                piece = np.frombuffer(n, np.int64)
                total[part] = total[part] + piece if part in total else piece
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "n"])

    schema = "part int, n binary"
    sums = rows.mapInArrow(count, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect()
    seen = np.zeros(len(terms.members) + 1, np.int64)
    for r in sums:
        seen[cuts[r.part] : cuts[r.part + 1]] += np.frombuffer(r.n, np.int64)
    return int(seen[-1]), seen[:-1]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, k: int = NEIGHBOURS, most_bytes: int = MOST_BYTES) -> Model:
    """A model from the labelled rows given; what is held out must be left out of `labels`. At most `examples` documents of
    each class teach, with at most `most_bytes` of text: by a hash of their ids, as many as fit."""
    rows = with_ids(docs, id_col, text_col)
    truth = labels.select(F.col("doc_id").cast("long"), F.col(label_col).alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    totals = {r.y: r["count"] for r in truth.groupBy("y").count().collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    pick = [truth.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    chosen = stage(pick[0].union(pick[1]), "tox-examples")  # at most 2 x examples rows
    size, text = F.octet_length("text"), F.coalesce("text", F.lit(""))
    # Of documents that share an id the text that sorts first teaches, and equal texts are one example.
    each = rows.join(F.broadcast(chosen), "doc_id").where(F.octet_length(text) <= most_bytes).groupBy("doc_id", "y").agg(F.min(text).alias("text"))
    once = stage(each.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")).select("doc_id", "text", "y"), "tox-once", "zstd")
    upto = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most `examples` rows each
    taught = once.select("doc_id", "y", size.alias("size")).withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id")
    sample = stage(once.join(F.broadcast(taught), "doc_id").select("doc_id", "text", "y"), "tox-texts", "zstd")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                words, at = word_hashes(batch.column(1))
                own = [np.unique(words[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
                texts = [xxhash.xxh64_intdigest((t.as_py() or "").encode("utf-8")) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(texts, np.uint64).view(np.int64)), pa.array([t.tobytes() for t, _ in own], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in own], pa.binary())], ["doc_id", "y", "own", "t", "c"])

    # The distinct words of at most 2 x most_bytes of text, 12 bytes each.
    held = sorted(sample.mapInArrow(vectors, "doc_id long, y int, own long, t binary, c binary").toLocalIterator(), key=lambda r: (r.y, r.doc_id, r.own))
    words = [np.frombuffer(r.t, np.uint64) for r in held]
    toxic = np.array([r.y for r in held], np.int64)
    found = HashSet(np.concatenate(words) if words else np.zeros(0, np.uint64))
    documents, df = document_frequencies(rows.select("doc_id", "text"), found)
    # Texts with the same commonest words (of one language, say) stand together, so that other blocks' bounds are low.
    ranks = [np.searchsorted(found.members, w) for w in words]
    order = sorted(range(len(held)), key=lambda e: ([int(t) for t in ranks[e][np.lexsort((ranks[e], -df[ranks[e]]))[:ALIKE]]], e))
    held, words, ranks = ([x[e] for e in order] for x in (held, words, ranks))
    toxic = toxic[order]
    by_class = np.zeros((2, len(found.members)))
    for y, t in zip(toxic.tolist(), ranks, strict=True):
        by_class[y, t] += 1
    weight = np.log((1 + documents) / (1 + df)) * np.log2(2 + by_class[1] / np.maximum(1, by_class[0]))
    model = Model(found.members, weight, [r.doc_id for r in held], toxic, [r.own & (1 << 64) - 1 for r in held], [(t, np.frombuffer(r.c, np.int32)) for t, r in zip(ranks, held, strict=True)], share, k)
    if len(set(toxic.tolist())) == 2:
        shared = to_tasks(docs.sparkSession, model)  # bounded by the examples' words

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared()
            for whole in batches:
                for batch in slices(whole, 1, BATCH_BYTES):
                    asked = list(term_counts(batch.column(1), model.terms))
                    yield pa.RecordBatch.from_arrays([pa.array([model.own[x] for x, _, _ in asked], pa.int64()), pa.array([model.vote(model.near(*x)) for x in asked], pa.float64())], ["example", "vote"])

        out = sample.select("doc_id", "text").repartition(PARTS).mapInArrow(votes, "example long, vote double").collect()  # a row for each example
        model.calibrate(np.array([r.vote for r in sorted(out, key=lambda r: r.example)]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and evidence (the nearest examples with similarity and label) of every document."""
    shared = to_tasks(docs.sparkSession, model)  # bounded by the examples' words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                out = [model.score(*x) for x in term_counts(batch.column(1), model.terms)]
                evidence = [[{"doc_id": i, "similarity": s, "label": y} for i, s, y in near] for _, near in out]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in out], pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return with_ids(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    shared = to_tasks(docs.sparkSession, model)  # bounded by the examples' words

    def keep(texts: pa.Array) -> np.ndarray:
        return np.array([shared().score(*x)[0] < threshold for x in term_counts(texts, shared().terms)], bool)

    return keep_rows(docs, text_col, keep, BATCH_BYTES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with labels learnt only outside the held-out fold."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")

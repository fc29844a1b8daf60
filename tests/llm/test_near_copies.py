import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewin.llm import near_copies as N
from tidewin.llm import simhash as S

SF = "/root/testdata/sf0.001"


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(rows):
    """The smallest id of each component, by comparing all pairs."""
    sets, up = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {root(i) for i in sets}


def copies(prose):
    """Texts with up to 30 changed words of 400 on both sides of the bar, with a line that all share."""
    rng, texts = np.random.default_rng(3), []
    line = prose(99, 40)
    for k in range(12):
        words = prose(k, 400).split()
        for edits in range(0, 31, 3):
            some = list(words)
            for at in rng.choice(400, edits, replace=False):
                some[at] = f"zz{at}q{edits}"
            texts.append(" ".join(some) + " " + line)
    texts += [line, line.upper(), None, "", "one", "One", "a b c d e f", "a b c d e"]
    order = rng.permutation(len(texts))
    return [(int(i) * 3 + 1, t) for i, t in zip(order, texts, strict=True)]


def test_near_copies_match_brute_force(spark, prose):
    rows = copies(prose)
    want = kept(rows)
    assert {r.doc_id for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    near = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] and b[1] and 0.8 <= jaccard(grams(a[1]), grams(b[1])) < 1]
    assert sum((S.fingerprint(a[1]) ^ S.fingerprint(b[1])).bit_count() > S.RADIUS for a, b in near) > 20


@pytest.mark.parametrize("order", ["hash", "common"])
def test_prefixes_of_similar_sets_meet(order):
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    common, rank = (pool[::3], rng.integers(3, 9, len(pool[::3]))) if order == "common" else (pool[:0], np.zeros(0, np.int64))
    for _ in range(300):
        base = rng.choice(pool, rng.integers(1, 60), replace=False)
        a, b = np.unique(base[rng.random(len(base)) < 0.95]), np.unique(base[rng.random(len(base)) < 0.95])
        if len(a) and len(b) and N.similar(a, b):
            assert set(N.prefix(a, common, rank)) & set(N.prefix(b, common, rank))


def test_the_bar_is_met_at_exactly_four_fifths():
    a = np.arange(10, dtype=np.uint64)
    assert N.similar(a[:8], a) and not N.similar(a[:7], a[:9]) and N.similar(a[:4], a[:5])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_planted_near_copies_leave_the_pipeline(spark, prose):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for k in range(4):
        words = prose(50 + k, 300).split()
        for j in range(3):
            some = [f"zz{k}{j}{i}" if i % 60 == 9 * j and j else w for i, w in enumerate(words)]
            rows.append((100 * k + j, " ".join(some), "en", "s", 1))
    sets = {i: grams(t) for i, t, *_ in rows}
    assert all(0.8 <= jaccard(sets[100 * k], sets[100 * k + j]) < 1 for k in range(4) for j in (1, 2))
    step = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    left = {r.doc_id for r in step(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert left == kept([(i, t) for i, t, *_ in rows])


def test_rows_go_only_for_their_text(spark, prose):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (None, c), (None, c), (None, a), (4, prose(4))]
    left = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, a), (1, b), (None, c), (None, a), (4, prose(4))], key=str)


def test_fingerprints_and_trees_come_first(spark, prose, monkeypatch):
    """Pairs within the radius are joined by the trees alone; prefixes find what lies beyond it."""

    def pair(seed, near):
        """A text and another with one word or more changed, within the radius or beyond it."""
        for turn in range(200):
            words = prose(seed + turn, 300).split()
            other = list(words)
            for k in range(1 if near else 6):
                other[20 + 45 * k] = f"changed{turn}"
            a, b = " ".join(words), " ".join(other)
            if (S.fingerprint(a) ^ S.fingerprint(b)).bit_count() <= S.RADIUS if near else (S.fingerprint(a) ^ S.fingerprint(b)).bit_count() > S.RADIUS:
                return a, b

    texts = [*pair(1000, True), *pair(2000, False), prose(1, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in S.deduplicate(docs).collect()) == [0, 2, 4]
    monkeypatch.setattr(N, "_may_reach", lambda *_: F.lit(False))
    assert sorted(r.doc_id for r in S.deduplicate(docs).collect()) == [0, 2, 3, 4]
    names = spark.createDataFrame([(7, 0), (3, 1), (5, 1), (9, -1)], "node long, fp long")
    assert {tuple(r) for r in S.near_nodes(names).collect()} == {(3, 5), (3, 7)}  # the fourth differs in 63 bits or more

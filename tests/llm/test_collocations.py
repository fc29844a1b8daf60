import re
from collections import Counter

import numpy as np
import pytest

from tidewin.llm import collocations as C


def brute(rows, longest=3, least=10, share=50, top=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] in plain Python."""
    count, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", folded):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            words[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i : i + m])] += 1
    kept = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, g), a in kept.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                inside[lang, g[i : i + m]] = max(inside[lang, g[i : i + m]], a)
    out = {}
    for (lang, g), a in kept.items():
        if 100 * inside[lang, g] >= share * a:
            continue
        cuts = [(1_000_000 * a * a // (count[lang, g[:k]] * count[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), count[lang, g[:k]], count[lang, g[k:]]))
    return [(lang, rank, p.decode(), -a, left, right, words[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    names = [*"abcdefghij", "É", "é", "Zoë", "new", "York", "of", "the"]
    share = 1 / np.arange(1, len(names) + 1)
    rows = []
    for k in range(n):
        w = rng.choice(names, 60, p=share / share.sum()).tolist()
        for _ in range(3):
            at = int(rng.integers(0, 55))
            w[at : at + 3] = ["New", "york", "City"][: int(rng.integers(2, 4))]
        marks = rng.choice([" ", "  ", "\t", ", ", ". ", ",", "\n", "; "], 60, p=[0.8, 0.05, 0.05, 0.03, 0.03, 0.01, 0.02, 0.01])
        rows.append(([None, "und", "en", "fr"][k % 4], "".join(a + b for a, b in zip(w, marks, strict=False))))
    return rows


def got(spark, rows, **how):
    return [tuple(r) for r in C.collocations(spark.createDataFrame([(t, x, k) for k, (x, t) in enumerate(rows)], "text string, lang string, n long").repartition(3), **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


def test_phrases_match_brute_force(spark):
    rows = corpus(1)
    want = brute(rows)
    assert sorted(got(spark, rows)) == sorted(want) and len(want) > 60 and any("new york city" == w[2] for w in want)


def test_longer_phrases_small_blocks_and_ranks(spark):
    rows = corpus(2, 60)
    assert sorted(got(spark, rows, longest=4, least=3, share=80, top=25, block=97)) == sorted(brute(rows, 4, 3, 80, 25))
    assert sorted(got(spark, rows, longest=2, least=5, block=40)) == sorted(brute(rows, 2, 5))


def test_hot_words_and_odd_texts(spark):
    rows = [("en", "the " * 3000), ("en", None), (None, ""), ("fr", " \t\n . "), ("en", "a." * 50), ("de", "x y " * 5 + "x y"), ("de", "x y " * 7), ("en", "the the\x0bthe"), ("en", "\x00 nul " * 12), ("en", "the the the. " * 30), ("en", "é É " * 20)]
    assert sorted(got(spark, rows)) == sorted(brute(rows))
    assert got(spark, [("en", "a b")] * 3) == []
    assert C.collocations(spark.createDataFrame([], "text string, lang string, key long, phrase string")).collect() == []


def test_clashing_columns(spark, odd, odd_rows):
    rows = [(r[2], r[1]) for r in odd_rows]
    assert sorted(tuple(r) for r in C.collocations(odd, least=5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == sorted(brute(rows, least=5))


def test_large_counts_are_exact(spark):
    big = 3_000_000_019
    totals = spark.createDataFrame([(1, big), (2, big + 6), (3, 2 * big)], "key long, f long")
    said = spark.createDataFrame([(1, "en", "a b", [2], [3], None), (None, "en", None, None, None, 10)], "key long, lang string, phrase string, lefts array<long>, rights array<long>, n long")
    row = C._ranked(totals, [said], 50, 10).first()
    assert row.score == 1_000_000 * big * big // ((big + 6) * 2 * big)


def test_blocks_survive_packing():
    rng = np.random.default_rng(4)
    keys = rng.choice(rng.integers(1, 1 << 62, 50).astype(np.uint64), 200_000)
    keys[::70_000] = np.uint64(7)  # gaps of over two bytes
    fresh = rng.random(len(keys)) < 0.1
    block = C.Block.of(keys, fresh, (keys % np.uint64(3)).astype(np.int64), ["a", "b", "c"], lambda i: str(keys[i]).encode())
    again = C.Block.unpack(*block.pack())
    for name in ("keys", "counts", "positions", "language"):
        assert (getattr(block, name) == getattr(again, name)).all()
    assert again.letters == block.letters and again.names == block.names
    place, word = again.postings()
    assert (again.keys[word] == keys).all() and (np.diff(place) >= 1).all()


@pytest.mark.parametrize("width", [1, 2, 3])
def test_merge_join(width):
    start, place = np.array([1, 2, 5, 9]), np.array([2, 3, 4, 6, 9, 12])
    goes, behind = C.extend(start, width, place)
    assert [(int(start[g]), int(place[b])) for g, b in zip(goes, behind, strict=True)] == [(s, s + width) for s in start.tolist() if s + width in place]

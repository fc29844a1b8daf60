import hashlib
import math

import numpy as np
import pytest

from tidewin.llm import vector_codes as V


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract in plain Python integers: {row number: (code, error)} and the codebooks."""
    kept = [(i, v, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = [w for _, _, w in sorted((i, v, w) for i, v, w in kept if i is not None)[:entries]]
    d = len(first[0]) // parts
    cut = lambda w, p: w[p * d : (p + 1) * d]
    books = [[cut(w, p) for w in first] for p in range(parts)]
    near = lambda w, p: min((sum((a - b) ** 2 for a, b in zip(cut(w, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(w, p)[1] for _, _, w in kept] for p in range(parts)]
        for p in range(parts):
            for k in set(own[p]):
                mine = [cut(w, p) for (_, _, w), o in zip(kept, own[p], strict=True) if o == k]
                books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for i, _, w in kept:
        found = [near(w, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<double>, label int, vector string, code string, part int, n long, error string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], SCHEMA).repartition(3)


def test_tree_equals_a_full_search_with_ties():
    rng = np.random.default_rng(3)
    for spread in (2, 40, 1 << 20):
        points = rng.integers(-spread, spread, (64, 4))
        points[10], points[40] = points[30], points[5]
        queries = np.concatenate([rng.integers(-spread, spread, (500, 4)), points])
        away = ((queries[:, None] - points) ** 2).sum(axis=2)
        at, best = V.VantageTree(points).nearest(queries)
        assert (at == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()
    at, best = V.VantageTree(np.zeros((64, 0), np.int64)).nearest(np.zeros((3, 0), np.int64))
    assert at.tolist() == [0, 0, 0] and best.tolist() == [0, 0, 0]


def test_large_distances_are_compared_in_whole_numbers():
    points = np.array([[k << 27, (k * k) % 7] for k in range(-8, 8)] * 2)
    queries = points + np.array([1, -1])
    away = ((queries[:, None] - points) ** 2).sum(axis=2)
    at, best = V.VantageTree(points).nearest(queries)
    assert (at == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 32)], int(i) % 3 if i % 5 else None) for i in rng.permutation(300)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(20)]  # a hot vector
    out = V.compress(table(spark, rows)).collect()
    want, books = brute(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in out) == sorted(want)
    assert {r.codebooks_sha256 for r in out} == {books}
    label = {i: y for i, _, y in rows}
    for r in out:
        assert r.label_error == sum(e for i, _, e in want if label[i] == label[r.vec_id])


def test_odd_vectors(spark):
    rng = np.random.default_rng(8)
    good = [(k, [float(x) for x in rng.normal(0, 1, 16)], 0) for k in range(5)]
    odd = [(7, None, 0), (8, [float("nan")] * 16, 0), (9, [float("inf")] + [0.0] * 15, 1), (10, [None] + [0.0] * 15, 1), (None, [0.5] * 16, None), (3, [0.25] * 16, 0), (3, [0.25] * 16, 0)]
    out = V.compress(table(spark, good + odd)).collect()
    want, books = brute(good + odd)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted([(r.vec_id, r.code, r.error) for r in out], key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in out} == {books}
    more = V.compress(table(spark, good + [(50, [1.0] * 8, 0), (51, [], 0), (52, [1e300] * 16, 2)])).collect()
    assert {r.vec_id: r.code for r in more if r.vec_id >= 50} == {50: None, 51: None, 52: None}
    assert {r.codebooks_sha256 for r in more} == {brute(good)[1]} and all(r.error is None for r in more if r.vec_id >= 50)


def test_empty_tables_and_bad_dimensions(spark):
    assert V.compress(table(spark, []).limit(0)).collect() == []
    only = V.compress(table(spark, [(None, [1.0] * 16, 1)])).collect()
    assert [(r.code, r.error) for r in only] == [(None, None)]
    with pytest.raises(ValueError, match="equal parts"):
        V.compress(table(spark, [(1, [1.0] * 9, 1)]))

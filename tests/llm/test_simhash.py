import numpy as np
import pytest
import xxhash

from tidewin.llm import simhash as S
from tidewin.llm.support import connected_components


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_spark_uses_the_same_hash(spark):
    assert spark.sql("select xxhash64('an en é') h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest("an en é".encode(), 42)


def test_tree_finds_all_neighbours():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ np.uint64((1 << int(rng.integers(62))) | (1 << int(rng.integers(62)))) for _ in range(20)] + [base]))
    queries = rng.permutation(values)
    got = {(n, int(q)) for n, hits in S.BKTree(values).near(queries, 2) for q in hits}
    assert got == {(n, q) for n in range(len(values)) for q in range(len(queries)) if int(values[n] ^ queries[q]).bit_count() <= 2}
    assert list(S.BKTree(values[:0]).near(queries, 2)) == []


def test_documents_match_brute_force(spark, prose):
    words = [prose(k, 200).split() for k in range(12)]
    texts = []
    for k, w in enumerate(words):
        for j in range(5):
            v = list(w)
            for p in range(j):
                v[(37 * p + k) % len(v)] = f"zz{p}"
            texts.append(" ".join(v))
    texts += texts[:7] + [None, "", "one", "one", "One", "a b"]
    ids = [3 * i + 1 for i in range(len(texts))][::-1]
    out = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()}
    prints = [plain(t) for t in texts]
    assert {i: out[i].fp & (1 << 64) - 1 for i in ids} == dict(zip(ids, prints, strict=True))
    assert {i: out[i].component_id for i in ids} == components(ids, prints)


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_radius_beyond_the_blocks_is_refused(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([], "fp long, rep long"), 3)


def test_odd_and_empty_tables(odd, none, odd_rows):
    out = S.near_duplicates(odd).collect()
    assert len(out) == len(odd_rows)
    by = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert by[0] == by[1] == by[2] == 0 and by[5] == by[6] == by[7] == 5
    assert {r.component_id for r in out if r.doc_id is None} == {0, 5}
    assert S.near_duplicates(none).count() == 0
    left = S.deduplicate(odd)
    assert left.columns == odd.columns
    kept = sorted((r.doc_id for r in left.collect()), key=lambda i: (i is not None, i))
    assert kept.count(None) == 2 and kept.count(5) == 1 and 6 not in kept and 1 not in kept
    assert S.deduplicate(none).count() == 0


def test_only_rows_without_ids(spark):
    out = S.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")).collect()
    assert [r.component_id for r in out] == [None, None]

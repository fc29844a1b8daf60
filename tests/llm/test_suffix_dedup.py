import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tidewin.llm import suffix_dedup as S


def plain(ids, texts, length=100):
    seen, out = {}, {}
    for i in sorted(range(len(ids)), key=lambda i: ids[i]):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen.setdefault(raw[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        out[ids[i]] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def maximal(texts, least):
    at = defaultdict(list)
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + least, len(x) + 1):
                at[x[i:j]].append((t, i))
    out = set()
    for w, o in at.items():
        left = {texts[t][i - 1] if i else (t, i) for t, i in o}
        right = {texts[t][i + len(w)] if i + len(w) < len(texts[t]) else (t, i) for t, i in o}
        if len(o) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(w), tuple(sorted(o))))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_tree_gives_the_maximal_repeats_with_all_occurrences(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.choice(list(b"ab\x00"), rng.integers(1, 40)).tolist()) for _ in range(rng.integers(1, 5))]
    least = int(rng.integers(2, 6))
    tree = S.SuffixTree(texts, max(map(len, texts)))
    got = {(n, tuple(sorted((int(tree.text[p]), int(p - tree.begin[tree.text[p]])) for p in at))) for n, at in tree.maximal_repeats(least)}
    assert got == maximal(texts, least)


def rows(prose):
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, ids = letters(300), [7 * i - 20 for i in range(56)]
    texts = []
    for i in range(len(ids)):
        a, c = letters(rng.integers(0, 150)), letters(rng.integers(0, 150))
        texts.append([a + shared + c, a + shared[50:220] + c, "x" * int(rng.integers(0, 700)), ("ab" * 200)[int(rng.integers(0, 5)) :], a, None, a + "é" * 90 + shared, prose(i % 3, 80) + a][i % 8])
    return ids, texts


@pytest.mark.parametrize("hot", [50_000, 3])
def test_documents_match_brute_force(spark, prose, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    ids, texts = rows(prose)
    out = S.remove_repeats(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(7)).collect()
    want = plain(ids, texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out)


def test_packing_round_trip():
    found = np.zeros(3, S.SPAN)
    found["min"], found["hash"], found["doc"], found["start"], found["size"], found["self"] = [1, 2, 3], [2**63, 5, 6], [-5, 0, 7], [0, 9, 2**31], [100, 195, 120], [True, False, True]
    assert (S.unpack(S.pack(found)) == found).all()


def test_odd_and_empty_tables(odd, none, odd_rows):
    out = S.remove_repeats(odd, keep_text=False).collect()
    assert len(out) == len(odd_rows)
    by = {r.doc_id: r for r in out}
    assert by[9].n_bytes == 300_000 and by[9].n_removed == 299_999 and by[6].n_removed == by[6].n_bytes
    assert S.remove_repeats(none).count() == 0


def test_length_is_checked(none):
    with pytest.raises(ValueError):
        S.remove_repeats(none, length=10)


def test_bytes_of_single_strings_stay_at_home(spark, monkeypatch):
    def without(texts, *_):
        if texts:
            raise ValueError("bytes came along")
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    monkeypatch.setattr(S, "HOT", 0)
    monkeypatch.setattr(S, "tree_repeats", without)
    passage = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 150).tolist()))
    rows = spark.createDataFrame([(k, f"{k * 7919:08d}{'ABCDE'[k]}{passage}{'ABCDE'[k]}{k * 104729:08d}") for k in range(5)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.remove_repeats(rows).collect()}
    assert got == {0: (0, 0)} | {k: (150, 1) for k in range(1, 5)}


@pytest.mark.parametrize("share", [0, 1 << 20])
def test_small_shares_travel_together(spark, prose, monkeypatch, share):
    import pyarrow as pa

    monkeypatch.setattr(S, "SHARE_BYTES", share)
    monkeypatch.setattr(S, "HOT", 3)
    along = pa.RecordBatch.from_arrays([pa.array([-7, 3], pa.int64()), pa.array([b"a", b"b"])], ["doc", "cut"])
    sent = [(k, bytes([k]), b"") for k in range(8 * S.SHARDS)]
    packed = S.packed_rows(sent, along, 8)
    assert packed.num_rows == 2 + (len(sent) if not share else 8)  # partitions, and not shards, if shares are small
    table = spark.createDataFrame(pa.Table.from_batches([packed] * 3))
    got = {}
    for row in S.dealt(table, 8).mapInArrow(lambda b: (pa.RecordBatch.from_arrays([pa.array([parts[0][0][0]]), pa.array([len(parts)])], ["shard", "n"]) for _, parts in S.by_shard(b) if parts), "shard long, n long").collect():
        assert row.shard not in got  # a shard's shares meet once
        got[row.shard] = row.n
    assert got == {k: 3 for k, *_ in sent}
    ids, texts = rows(prose)
    out = S.remove_repeats(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == plain(ids, texts)

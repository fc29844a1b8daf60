"""Decontamination, toxicity, quality, mixing, token counts and chat."""

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewin.llm import chat as C
from tidewin.llm import decontamination as D
from tidewin.llm import mixing as X
from tidewin.llm import passages as P
from tidewin.llm import quality_mil as Q
from tidewin.llm import token_counts as T
from tidewin.llm import toxicity as V
from tidewin.llm import words as W

FRAME = "doc_id long, text string"


# -- word hashes and tiles


def test_word_hashes_follow_words(odd_rows):
    import re

    texts = [r[1] for r in odd_rows]
    words, at = W.word_hashes(pa.array(texts, pa.string()))
    plain = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    assert np.diff(at).tolist() == [len(p) for p in plain]
    name = {}
    for h, w in zip(words.tolist(), [w for p in plain for w in p], strict=True):
        assert name.setdefault(h, w) == w
    assert len(set(name.values())) == len(name)


def greedy(item, text, least):
    used_i, used_t, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and i + n not in used_i and t + n not in used_t:
                    n += 1
                best = max(best, (n, -i, -t))
        n, i, t = best[0], -best[1], -best[2]
        if n < least:
            return out
        out.append((i, t, n))
        used_i |= set(range(i, i + n))
        used_t |= set(range(t, t + n))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_are_the_greedy_ones(seed):
    rng = np.random.default_rng(seed)
    item, text = rng.integers(0, 3, 25).astype(np.uint64), rng.integers(0, 3, 60).astype(np.uint64)
    got = D.tiles(item, text, 3)
    want = greedy(item.tolist(), text.tolist(), 3)
    assert [n for *_, n in got][:1] == [n for *_, n in want][:1]
    assert all((item[i : i + n] == text[t : t + n]).all() and n >= 3 for i, t, n in got)
    for side in (0, 1):
        spans = sorted((g[side], g[side] + g[2]) for g in got)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    # Nothing of the least length is left unmarked in both.
    free = lambda n, side: [all(not g[side] <= k < g[side] + g[2] for g in got) for k in range(n)]
    fi, ft = free(25, 0), free(60, 1)
    assert not any((item[i : i + 3] == text[t : t + 3]).all() and all(fi[i : i + 3]) and all(ft[t : t + 3]) for i in range(23) for t in range(58))


def test_leaks_are_found_in_any_order_and_clean_texts_are_left(spark, prose, odd, none):
    items = [(k, prose(900 + k, 40)) for k in range(6)] + [(50, "Only Three Words"), (51, ""), (52, None), (53, "of the and")]
    parts = items[0][1].split()
    shuffled = " ".join(parts[20:] + ["so"] + parts[:20])
    half = " ".join(parts[:20]) + " " + prose(3, 30)
    docs = [(1, prose(1) + " " + items[1][1].upper().replace(" ", " - ") + " " + prose(2)), (2, shuffled), (3, half), (4, prose(4, 400)), (5, "He said: only three words!"), (6, items[2][1] + " " + items[3][1]), (6, items[2][1] + " " + items[3][1]), (None, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, FRAME)
    for block in (20_000, 3):
        got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(frame, bench, block_items=block).collect()), key=str)
        assert got == sorted([(1, 1), (2, 0), (5, 50), (6, 2), (6, 3), (6, 2), (6, 3), (None, 4)], key=str)
        assert sorted(r.doc_id for r in D.decontaminate(frame, bench, block_items=block).collect()) == [3, 4]
    assert D.contaminated(none, bench).count() == 0 and D.contaminated(odd, bench).count() == 0
    assert D.contaminated(frame, bench.limit(0)).count() == 0
    assert D.decontaminate(odd, bench).columns == odd.columns


# -- toxicity


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = V.BlockMaxIndex(vectors, 40)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 9):
        s = np.round(dense @ dense[i], 12)
        want = sorted((e for e in range(700) if s[e] > 0 and e != i), key=lambda e: (-s[e], e))[:15]
        got = index.nearest(*vectors[i], 15, but=i)
        assert [e for _, e in got] == want and [x for x, _ in got] == pytest.approx(s[want].tolist())


def test_calibration_is_monotone():
    rng = np.random.default_rng(1)
    v = rng.random(500)
    edges, value = V.calibration(v, (rng.random(500) < v).astype(int), np.ones(500))
    assert (np.diff(value) >= -1e-12).all() and len(value) == len(edges) + 1 and 0 <= value.min() and value.max() <= 1


def test_toxic_words_are_learnt(spark, prose, odd, none, no_labels, odd_labels, odd_rows):
    bad = ["scrunch", "blargh", "fnord"]
    rows = []
    for i in range(600):
        text = prose(i, 60).split()
        if i % 5 == 0:
            for k in range(3):
                text[7 * k + 3] = bad[(i // 5 + k) % 3]
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], FRAME)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, toxic int")
    model = V.fit(docs, labels)
    out = {r.doc_id: r for r in V.score(docs, model).collect()}
    assert all((out[i].score >= 0.7) == bool(y) for i, _, y in rows if i % 3 == 0)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[0].evidence[0].label == 1
    kept = V.reject(docs, model).collect()
    assert {r.doc_id for r in kept} == {i for i, r in out.items() if r.score < 0.7}
    assert len(V.score(odd, model).collect()) == len(odd_rows) and V.reject(odd, model).columns == odd.columns
    assert V.score(none, model).count() == 0
    assert {r.score for r in V.score(odd, V.fit(odd, no_labels)).collect()} == {0.0}
    assert V.score(odd, V.fit(odd, odd_labels)).count() == len(odd_rows)


# -- quality


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, cut, y = rng.normal(size=(9, P.WIDTH)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    net = Q.GatedAttention(0.5)
    net.weights = {"P": rng.normal(size=(P.WIDTH, 4)) * 0.1, "V": rng.normal(size=(4, 4)), "U": rng.normal(size=(4, 4)), "w": rng.normal(size=4), "c": rng.normal(size=4), "p": rng.normal(size=4), "b": np.zeros(1)}
    weight = np.array([1.0, 2.0, 0.5])

    def loss():
        s = net._forward(x, cut)["s"]
        return float((weight * (np.logaddexp(0, s) - y * s)).sum() / 3)

    grads = net._gradients(x, cut, y, weight)
    for name, w in net.weights.items():
        at = tuple(d // 2 for d in w.shape)
        keep = w[at]
        w[at] = keep + 1e-5
        up = loss()
        w[at] = keep - 1e-5
        down = loss()
        w[at] = keep
        assert np.asarray(grads[name])[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), name


def test_passages_cover_the_whole_text():
    x, at = P.encode(pa.array(["a" * 2500, None, "b", "é" * 1000]))
    assert np.diff(at).tolist() == [3, 1, 1, 2] and x.shape == (7, P.WIDTH) and np.isfinite(x).all()
    assert x[2, -1] == pytest.approx((2500 - 2048) / 1024) and x[3, -1] == 0
    assert (P.encode(pa.array(["z" * 30 + "a" * 2500]))[0][1:2] == P.encode(pa.array(["a" * 1024]))[0]).all()


def test_quality_is_learnt_and_attention_finds_the_junk(spark, prose, odd, none, no_labels, odd_labels, odd_rows):
    rows = []
    for i in range(300):
        text = prose(i, 400)
        if i % 3 == 0:
            cut = len(text) // 2
            text = text[:cut] + "#$%& " * 120 + text[cut:]
        rows.append((i, text, int(i % 3 > 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], FRAME)
    net = Q.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4], "doc_id long, quality int"))
    out = {r.doc_id: r for r in Q.score(docs, net).collect()}
    held = [(out[i].score >= 0.7) == bool(y) for i, _, y in rows if i % 4 == 0]
    assert np.mean(held) > 0.95
    assert len(Q.score(odd, net).collect()) == len(odd_rows) and Q.score(none, net).count() == 0
    assert {r.score for r in Q.score(odd, Q.fit(odd, no_labels)).collect()} == {0.5}
    assert Q.score(odd, Q.fit(odd, odd_labels)).count() == len(odd_rows)


# -- mixing


def test_rates_meet_the_targets(spark, prose, odd, none, no_labels, odd_rows):
    alphabets = {"en": str.lower, "fr": lambda t: t.replace("e", "é").replace("a", "à"), "de": lambda t: t.replace("o", "ö").replace("s", "ß")}
    rows = [(i, f(prose(i, 30 + i % 40)), k) for i in range(240) for k, f in [list(alphabets.items())[(i % 10 > 5) + (i % 10 > 7)]]]
    docs = spark.createDataFrame([r[:2] for r in rows], FRAME)
    labelled = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, domain string")
    targets = {"en": 2.0, "fr": 1.0, "de": 1.0}
    out = X.mix(docs, labelled, targets).collect()
    tokens = np.array([r.tokens for r in out])
    assert [len(rows[r.doc_id][1].split()) for r in out] == tokens.tolist()
    p = np.array([r.posterior for r in out])
    total = (p * (tokens * [r.rate for r in out])[:, None]).sum(axis=0)
    assert total / tokens.sum() == pytest.approx([0.25, 0.5, 0.25]) and min(r.rate for r in out) >= 0
    assert np.mean(p.argmax(axis=1) == [["de", "en", "fr"].index(rows[r.doc_id][2]) for r in out]) > 0.95
    kept = X.sample(docs, labelled, targets).collect()
    assert len({r.doc_id for r in kept}) == len(kept) < 240
    langs = [rows[r.doc_id][2] for r in kept]
    assert 0.7 < langs.count("fr") / 48 <= 1 or langs.count("de") / 48 > 0.7
    empty = labelled.limit(0)
    assert len(X.mix(odd, empty, targets).collect()) == len(odd_rows) and X.mix(none, empty, targets).count() == 0
    assert X.sample(odd, labelled, targets).columns == odd.columns and X.sample(none, labelled, targets).count() == 0


def test_rates_are_cut_at_zero(spark):
    table = spark.createDataFrame([(1, 100, 1.0, 0.0), (2, 100, 0.5, 0.5), (3, 100, 0.0, 1.0)], "doc_id long, tokens long, p0 double, p1 double")
    rate, fit = X.fit_rates(table, {"a": 0.0, "b": 1.0}, budget=100.0)
    got = [r[0] for r in table.orderBy("doc_id").select(rate).collect()]
    assert min(got) == 0 and fit["totals"] == pytest.approx([0, 100], abs=0.05)
    with pytest.raises(ValueError):
        X.fit_rates(table, {"a": -1.0, "b": 1.0})


# -- token counts


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary here")
def test_sections_add_up_and_majority_decides(spark, odd, none, odd_rows):
    encoder, size = T.encoding(T.VOCABULARY)
    texts = ["one two\nthree\n", "a\n\n\nb", "é\nü", "", None, "no end"]
    for rule in T.RULES:
        out = T.section_tokens(spark.createDataFrame(list(enumerate(texts)), FRAME), rule=rule).orderBy("doc_id", "section").collect()
        for i, text in enumerate(texts):
            mine, text = [r for r in out if r.doc_id == i], text or ""
            assert "".join(text[r.start_char : r.end_char] for r in mine) == text
            assert sum(r.n_tokens for r in mine) == len(encoder.encode_ordinary(text)) == mine[0].doc_tokens
            assert all(text[: r.end_char].endswith("\n") for r in mine[:-1])
    assert {r.doc_id for r in T.section_tokens(odd.where("length(text) < 200000 or text is null")).collect()} == {r[0] for r in odd_rows if r[1] is None or len(r[1]) < 200_000}
    assert T.section_tokens(none).count() == 0
    with pytest.raises(ValueError):
        T.section_tokens(none, rule="x")


def test_crossing_tokens_follow_the_rule():
    ends, lengths = np.array([4, 6, 10]), np.array([3, 4, 3])  # the second token covers 3..7: one, two and one byte
    assert [T.attribute(ends, lengths, r)[0].tolist() for r in T.RULES] == [[1, 1, 1], [2, 0, 1], [1, 0, 2]]
    assert T.attribute(ends, lengths)[1].tolist() == [1, 0, 0]
    assert T.attribute(np.array([1, 2]), np.array([2]))[0].tolist() == [1, 0]  # a tie: the earlier section


def test_fifty_blocks_read_the_documents_once(spark, prose, monkeypatch):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    items = [(k, prose(1000 + k, 20)) for k in range(100)]
    rows = [(i, prose(i, 80) + (" " + items[i][1] if i < 100 else "")) for i in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for held in (1 << 21, 300):
        monkeypatch.setattr(D, "HELD_WORDS", held)
        seen, kept = Observation(), Observation()
        got = {(r.doc_id, r.item_id) for r in D.contaminated(frame.observe(seen, F.count(F.lit(1)).alias("n")), bench, block_items=2).collect()}
        left = {r.doc_id for r in D.decontaminate(frame.observe(kept, F.count(F.lit(1)).alias("n")), bench, block_items=2).collect()}
        assert got == {(i, i) for i in range(100)} and left == set(range(100, 200))
        assert seen.get["n"] == kept.get["n"] == 200
    assert len(D.blocks(bench, block_items=2)) == 50


def test_examples_are_bounded_in_bytes(spark, prose):
    rows = [(i, prose(i, 30) + (" zzbad zzworse" if i % 2 else "")) for i in range(60)] + [(100, "zzbad " * 400_000), (101, "mild " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (101, 0)], "doc_id long, toxic int")
    most = 2000
    model = V.fit(docs, labels, most_bytes=most)
    held = {i: t for i, t in rows}
    for y in (0, 1):
        mine = [d for d, t in zip(model.ids, model.toxic, strict=True) if t == y]
        assert mine and sum(len(held[d].encode()) for d in mine) <= most and not {100, 101} & set(mine)
    got = {r.doc_id: r.score for r in V.score(docs, model).collect()}  # long texts are scored all the same
    assert len(got) == len(rows) and got[100] > got[101]


# -- chat


def test_calls_and_results_without_an_identifier_stay(spark):
    calls = spark.createDataFrame([(1, None, 1, "f", '{"x":1}', ["a"], "k"), (1, None, 3, "f", '{"x":2}', [], "k"), (1, "a", 2, "f", '{"x":3}', [], "k"), (2, None, None, None, None, None, None)], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, status string")
    results = spark.createDataFrame([(1, None, 4, "r"), (1, None, 4, "r"), (1, "a", 3, "z" * 3_000_000)], "conv_id long, call_id string, turn long, content string")
    out = C.formatted(calls, results.withColumn("position", results.turn), {"f": {"type": "object"}}).collect()
    assert len(out) == 6 and sorted((r.conv_id, r.position) for r in out) == [(1, k) for k in range(5)] + [(2, 0)]
    mine = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)
    assert [r.status for r in mine] == ["unanswered", "linked", "unanswered", "orphan", "orphan"]
    assert [json.loads(r.json)["call"]["arguments"]["x"] for r in mine[:3]] == [1, 3, 2] and all(r.n_calls == 1 for r in mine[:3])
    assert len(json.loads(mine[1].json)["result"]["content"]) == 3_000_000


def test_calls_are_linked_ordered_and_validated(spark):
    calls = spark.createDataFrame([(1, "a", 5, "f", '{"x":1}', ["b"]), (1, "b", 7, "f", '{"x":2}', ["c"]), (1, "c", 9, "f", "{}", []), (1, "d", 1, "f", "oops", ["zz"]), (2, "p", 1, "g", "{}", ["q"]), (2, "q", 2, "f", '{"x": 3}', ["p"]), (3, "s", 1, "f", '{"x":4,"é":null}', None), (3, "s", 1, "f", '{"x":4,"é":null}', None), (None, "t", 1, "f", None, [])], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 6, "ra"), (1, "a", 8, "rb"), (1, "y", 8, "o"), (2, "p", 4, None), (3, None, 5, "n")], "conv_id long, call_id string, turn long, content string")
    out = {(r.conv_id, r.call_id): r for r in C.formatted(calls, results, {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}).collect()}
    at = {k[1]: r.position for k, r in out.items() if k[0] == 1}
    assert at["d"] == 0 and at["c"] < at["b"] < at["a"] and sorted(at.values()) == list(range(5))
    assert out[1, "a"].n_results == 2 and json.loads(out[1, "a"].json)["result"]["content"] == "ra"
    assert out[1, "d"].error == "not JSON" and out[1, "d"].dangling and out[1, "c"].error == "$: no x" and out[1, "b"].valid
    assert out[2, "p"].cyclic and out[2, "q"].cyclic and out[2, "p"].error == "no schema"
    assert out[1, "y"].status == "orphan" and out[3, None].status == "orphan" and out[3, "s"].n_calls == 2
    assert out[3, "s"].json == '{"call":{"arguments":{"x":4,"é":null},"id":"s","name":"f"},"result":null}'
    assert out[None, "t"].error == "not JSON"


def test_schema_checks():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 0, "maximum": 9}, "b": {"type": "array", "items": {"enum": ["x", "y"]}, "minItems": 1}, "c": {"type": "string", "maxLength": 2}, "d": {"type": "boolean"}}}
    assert all(C.violation(v, schema) is None for v in ({"a": 1}, {"a": None, "b": ["x"]}, {"a": 2.0, "c": "zz", "d": True}))
    bad = [3, {}, {"a": 1.5}, {"a": True}, {"a": 10}, {"a": 1, "e": 0}, {"a": 1, "b": []}, {"a": 1, "b": ["z"]}, {"a": 1, "c": "zzz"}, {"a": 1, "d": 1}]
    assert all(C.violation(v, schema) for v in bad)


def test_plain_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", ""), (2, 0, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (None, 0, "user", "q"), (3, None, "user", "q")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.formatted(*C.turns_as_calls(conv), {"reply": C.REPLY}).orderBy("conv_id", "position").collect()
    one = [r for r in out if r.conv_id == 1]
    assert [(r.status, r.valid, r.error) for r in one] == [("orphan", False, None), ("linked", True, None), ("unanswered", False, "$.prompt: length")]
    assert [r.n_results for r in out if r.conv_id == 2] == [2]
    assert C.formatted(*C.turns_as_calls(conv.limit(0)), {}).count() == 0


def test_held_out_fold(spark):
    from tidewin.llm.support import held_out

    got = {r.doc_id: r.h for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out("doc_id", 3, 1).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}

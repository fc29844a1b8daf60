"""Results of the text operators against plain recomputation, on small tables and on long and hostile texts."""

import math
import os
import re
import subprocess
import sys
import time
from collections import Counter, defaultdict
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewin.llm import chat as C
from tidewin.llm import decontamination as D
from tidewin.llm import mixing as X
from tidewin.llm import near_copies as N
from tidewin.llm import passages as P
from tidewin.llm import quality_mil as Q
from tidewin.llm import sharding as H
from tidewin.llm import simhash as S
from tidewin.llm import suffix_dedup as U
from tidewin.llm import support
from tidewin.llm import token_counts as T
from tidewin.llm import toxicity as V
from tidewin.llm import words as W

FRAME = "doc_id long, text string"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


# -- toxicity: TF-IDF, neighbours, votes and calibrated scores


def toxic_rows(prose, n=160):
    bad, rows = ["scrunch", "blargh", "fnord"], []
    for i in range(n):
        text = prose(i % (n - 12), 25 + i % 30).split()  # the last ones are copies
        if i % 4 == 0:
            for k in range(1 + i % 3):
                text[5 * k + 2] = bad[(i // 4 + k) % 3]
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return rows


def plain_scores(rows, labels, k):
    texts = {}
    for i, text, _ in rows:
        if i in labels:
            y, first = texts.get(text, (0, i))
            texts[text] = (max(y, labels[i]), min(first, i))
    examples = [(t, y) for t, (y, _) in texts.items()]
    df = Counter(w for _, t, _ in rows for w in set(words_of(t)))
    toxic, clean = (Counter(w for t, y in examples if y == z for w in set(words_of(t))) for z in (1, 0))
    weight = {w: math.log((1 + len(rows)) / (1 + df[w])) * math.log2(2 + toxic[w] / max(1, clean[w])) for w in set(toxic) | set(clean)}

    def unit(text):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in Counter(words_of(text)).items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    vectors = [unit(t) for t, _ in examples]
    totals = Counter(labels.values())
    share = totals[1] / sum(totals.values())
    n = Counter(y for _, y in examples)
    say = {y: len(examples) / 2 / n[y] for y in (0, 1)}

    def vote(text):
        mine = unit(text)
        near = sorted(((round(sum(x * v.get(w, 0) for w, x in mine.items()), 12), e) for e, v in enumerate(vectors) if examples[e][0] != text), key=lambda r: -r[0])
        near = [(s, e) for s, e in near if s > 0]
        if len(near) > k and near[k - 1][0] - near[k][0] < 1e-9:
            return None  # a tie at the k-th place is settled by the order of the examples
        v = [(s * s * say[examples[e][1]], examples[e][1]) for s, e in near[:k]]
        return (sum(a * y for a, y in v) + V.PRIOR_VOTE * share) / (sum(a for a, _ in v) + V.PRIOR_VOTE)

    return vote


def test_toxicity_scores_follow_the_definition(spark, prose):
    rows = toxic_rows(prose)
    labels = {i: y for i, _, y in rows if i % 3}
    docs = spark.createDataFrame([r[:2] for r in rows], FRAME)
    model = V.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), k=5)
    vote = plain_scores(rows, labels, 5)
    got = {r.doc_id: r for r in V.score(docs, model).collect()}
    compared = 0
    for i, text, _ in rows:
        if (v := vote(text)) is not None:
            # Sums in another order may put a vote on the other side of a step of the map.
            near = [float(model.value[np.searchsorted(model.edges, v + e, side="right")]) for e in (-1e-9, 0, 1e-9)]
            assert min(abs(got[i].score - x) for x in near) < 1e-12
            compared += 1
    assert compared > 100
    # The map is monotone and calibrated on the examples: its mean is the labels' share.
    assert (np.diff(model.value) >= -1e-12).all()


def test_a_texts_own_label_is_not_an_input(spark, prose):
    rows = toxic_rows(prose)
    docs = spark.createDataFrame([r[:2] for r in rows], FRAME)
    labels = [(i, y) for i, _, y in rows if i < 120]
    model = V.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for r in V.score(docs, model).collect():
        text = rows[r.doc_id][1]
        assert all(rows[e.doc_id][1] != text for e in r.evidence)


# -- quality: encodings, attention and scores


def plain_passage(raw, size):
    kinds = [int(P.CLASS[b]) for b in raw]
    n = max(1, len(raw))
    single, double = np.zeros(P.SINGLES), np.zeros(P._PAIRS)
    for k in kinds:
        single[k] += 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        double[int(P._BUCKET[a * P.SINGLES + b])] += 1
    pieces = [raw[i : i + 8] for i in range(len(raw) - 7)]
    again = len(pieces) - len(set(pieces))
    spaces = sum(b == 32 for b in raw) + sum(b == 10 for b in raw)
    return np.concatenate([np.sqrt(single / n), np.sqrt(double / n), [again / n, len(raw) / (spaces + 1) / 10, len(raw) / size]])


def test_encodings_follow_the_definition(prose, odd_rows, monkeypatch):
    texts = [prose(1, 500), "", None, "x" * 3000, prose(2, 40), "é∑ " * 700, *(r[1] for r in odd_rows if r[1] is None or len(r[1]) < 5000)]
    for group in (2, 256):
        monkeypatch.setattr(P, "GROUP", group)
        x, at = P.encode(pa.array(texts, pa.string()), 512)
        for k, t in enumerate(texts):
            raw = (t or "").encode()
            parts = [raw[i : i + 512] for i in range(0, max(1, len(raw)), 512)]
            assert at[k + 1] - at[k] == len(parts)
            assert np.allclose(x[at[k] : at[k + 1]], [plain_passage(p, 512) for p in parts], atol=1e-6)
        whole = P.encode_whole(pa.array(texts, pa.string()))
        assert all(np.allclose(w, plain_passage((t or "").encode(), 1 << 40), atol=1e-6) for w, t in zip(whole, texts, strict=True))


def test_quality_scores_follow_the_definition(spark, prose):
    rng = np.random.default_rng(3)
    net = Q.GatedAttention(0.5)
    net.mean, net.scale = rng.normal(size=P.WIDTH).astype(np.float32) * 0.1, np.ones(P.WIDTH, np.float32)
    h = 5
    net.weights = {k: rng.normal(size=n).astype(np.float32) for k, n in {"P": (P.WIDTH, h), "V": (h, h), "U": (h, h), "w": h, "c": h, "p": h, "b": 1}.items()}
    texts = [prose(k, 30 + 300 * (k % 4)) for k in range(10)] + ["", None]
    out = {r.doc_id: r for r in Q.score(spark.createDataFrame(list(enumerate(texts)), FRAME), net).collect()}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    w = net.weights
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        bag = []
        for part in [raw[k : k + 1024] for k in range(0, max(1, len(raw)), 1024)]:
            hidden = np.tanh((plain_passage(part, 1024) - net.mean) @ w["P"] + w["p"])
            gate = sum(math.tanh(hidden @ w["V"][:, j]) * sigmoid(hidden @ w["U"][:, j]) * w["w"][j] for j in range(h))
            bag.append((hidden, gate))
        total = sum(math.exp(g) for _, g in bag)
        weighted = sum(math.exp(g) / total * hidden for hidden, g in bag)
        assert out[i].score == pytest.approx(sigmoid(float(weighted @ w["c"] + w["b"][0])), abs=1e-5)
        assert out[i].n_passages == len(bag) and out[i].top_passage == max(range(len(bag)), key=lambda k: bag[k][1])


def test_every_passage_of_a_taught_text_teaches(spark, prose):
    rows = []
    for i in range(120):
        parts = [prose(1000 * i + k, 150)[:1024].ljust(1024) for k in range(40)]
        if i % 2:
            parts[37] = ("#$%& " * 300)[:1024]  # beyond any small number of first passages
        rows.append((i, "".join(parts), int(i % 2 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], FRAME)
    net = Q.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i % 4 < 2], "doc_id long, quality int"))
    out = {r.doc_id: r for r in Q.score(docs, net).collect()}
    held = [i for i, *_ in rows if i % 4 >= 2]
    assert np.mean([(out[i].score >= 0.5) == bool(rows[i][2]) for i in held]) > 0.9
    few = Q.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), most_bytes=5 * 40960)
    assert few.weights is not None


# -- mixing: an independent solver


def solved(tokens, p, aim, most):
    """Rates clip(1 + p u, 0, most) whose totals are `aim`, by damped Newton steps on u."""
    u = np.zeros(p.shape[1])
    rate = lambda u: np.clip(1 + p @ u, 0, math.inf if most is None else most)
    miss = lambda u: aim - (tokens * rate(u)) @ p
    for _ in range(500):
        free = (rate(u) > 0) & (rate(u) < (math.inf if most is None else most))
        free |= (1 + p @ u == 0) | (1 + p @ u == (most or math.inf))
        step = np.linalg.pinv((p[free] * tokens[free, None]).T @ p[free] + 1e-9 * np.eye(len(u))) @ miss(u)
        size = 1.0
        while size > 1e-6 and np.abs(miss(u + size * step)).sum() > np.abs(miss(u)).sum():
            size /= 2
        u = u + size * step
        if np.abs(miss(u)).max() < 1e-7 * aim.sum():
            break
    return rate(u), np.abs(miss(u)).max() / aim.sum()


@pytest.mark.parametrize("most", [None, 1.0])
def test_rates_match_an_independent_solver(spark, most):
    rng = np.random.default_rng(8)
    n = 300
    tokens, p = rng.integers(1, 500, n), np.round(rng.dirichlet([0.3, 0.3, 0.3], n), 9)
    table = spark.createDataFrame([(i, int(tokens[i]), *map(float, p[i])) for i in range(n)], "doc_id long, tokens long, p0 double, p1 double, p2 double")
    targets = {"a": 0.62, "b": 0.3, "c": 0.08} if most is None else {"a": 0.45, "b": 0.35, "c": 0.2}
    budget = None if most is None else 0.6 * tokens.sum()
    rate, found = X.fit_rates(table, targets, budget, most)
    got = np.array([r[0] for r in table.orderBy("doc_id").select(rate).collect()])
    aim = np.array(list(targets.values())) * (tokens.sum() if budget is None else budget)
    want, residual = solved(tokens, p, aim, most)
    assert residual < 1e-6 and found["residual"] < 1e-8
    assert got.min() >= 0 and (most is None or got.max() <= most)
    assert (tokens * got) @ p == pytest.approx(aim, rel=1e-6) and np.abs(got - want).max() < 2e-2 * max(1.0, want.max())


def test_targets_out_of_reach_are_told(spark):
    table = spark.createDataFrame([(1, 100, 1.0, 0.0), (2, 100, 1.0, 0.0)], "doc_id long, tokens long, p0 double, p1 double")
    rate, found = X.fit_rates(table, {"a": 0.5, "b": 0.5})
    assert found["residual"] > 0.4 and len(table.select(rate).collect()) == 2
    # The budget that no domain exceeds is nothing here; the least share of all tokens stands instead.
    _, found = X.fit_rates(table, {"a": 0.5, "b": 0.5}, budget=-1, most=1.0, least=0.5)
    assert found["totals"] == pytest.approx([50.0, 0.0], abs=1.0) and found["residual"] == pytest.approx(0.5, abs=0.02)


def test_kept_tokens_follow_the_targets_and_shrink_evenly_with_a_scarce_domain(spark, prose):
    """Token totals of what is sampled, for a domain from plenty to nothing: no step in what is kept."""
    rows = [(i, (prose(i, 60) if i % 2 else prose(i, 60).replace("e", "é").replace("a", "à")), "en" if i % 2 else "fr") for i in range(600)]
    shares = []
    for many in (300, 120, 40, 12, 4, 0):
        some = [r for r in rows if r[2] == "en" or r[0] < 2 * many]
        docs = spark.createDataFrame([r[:2] for r in some], "doc_id long, text string")
        labelled = spark.createDataFrame([(r[0], r[2]) for r in rows[:80]], "doc_id long, domain string")
        kept, found = X.sampled(docs, labelled, {"en": 0.6, "fr": 0.4})
        tokens = {"en": 0, "fr": 0}
        for r in kept.collect():
            tokens[rows[r.doc_id][2]] += len(r.text.split())
        whole = sum(len(r[1].split()) for r in some)
        shares.append(sum(tokens.values()) / whole)
        for lang, want in zip(("en", "fr"), found["totals"], strict=True):
            assert abs(tokens[lang] - want) < 0.12 * whole  # a sample's own chance
        if found["residual"] <= X.SAMPLED:
            assert abs(tokens["fr"] / sum(tokens.values()) - 0.4) < 0.08
        assert sum(found["targets"]) >= 0.49 * whole
    assert min(shares) > 0.25 and all(b > 0.55 * a for a, b in zip(shares, shares[1:], strict=False))


# -- decontamination: tiles and coverage


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


@pytest.mark.parametrize("seed", range(60))
def test_all_tiles_are_the_greedy_ones(seed):
    rng = np.random.default_rng(seed)
    k, least = int(rng.integers(1, 5)), int(rng.integers(1, 5))
    item, text = rng.integers(0, k, int(rng.integers(1, 40))).astype(np.uint64), rng.integers(0, k, int(rng.integers(0, 70))).astype(np.uint64)
    assert D.tiles(item, text, least) == greedy(item.tolist(), text.tolist(), min(least, len(item)))


def test_coverage_matches_brute_force(spark, prose):
    rng = np.random.default_rng(6)
    items = [(k, prose(300 + k, 20 + k)) for k in range(8)] + [(20, "la " * 30), (21, "one two three")]
    docs = []
    for i in range(60):
        parts = prose(i, 30).split()
        for k in rng.choice(len(items), 2, replace=False):
            w = items[k][1].split()
            cut = sorted(rng.choice(len(w) + 1, 2, replace=False).tolist()) if i % 3 else [0, len(w)]
            piece = w[cut[0] :] + w[: cut[0]] if i % 2 else w[cut[0] : cut[1]] + ["so"] + w[cut[1] :]
            if i % 5 == 0:
                piece[len(piece) // 2] = "changed"
            parts[10:10] = piece
        docs.append((i, " ".join(parts)))
    docs += [(90, "la " * 200), (91, None), (92, "")]
    want = {}
    for i, text in docs:
        for k, item in items:
            a, b = words_of(item), words_of(text)
            if a and len(b) >= min(5, len(a)):
                laid = greedy(a, b, min(5, len(a)))
                if sum(n for *_, n in laid) >= 0.8 * len(a):
                    want[i, k] = (sum(n for *_, n in laid) / len(a), len(laid), max(n for *_, n in laid))
    frame, bench = spark.createDataFrame(docs, FRAME), spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"block_items": 4}, {"block_bytes": 200}):
        got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.longest_tile) for r in D.contaminated(frame, bench, **how).collect()}
        assert got == {k: (pytest.approx(c), n, m) for k, (c, n, m) in want.items()} and len(want) > 20
        left = sorted(r.doc_id for r in D.decontaminate(frame, bench, **how).collect())
        assert left == sorted({i for i, _ in docs} - {i for i, _ in want})


def test_repeated_words_take_linear_time():
    block = D.Benchmark([1, 2], ["word " * 60, "a b c d e f g h i j k"])
    began = time.perf_counter()
    got = list(block.matches(pa.array(["word " * 100_000, "x a b c d e f g h i j k"]), 0.8))
    assert [g[:4] for g in got] == [(0, 0, 1.0, 1), (1, 1, 1.0, 1)]
    for n, m in ((100_000, 100_000), (1_000, 100_000)):
        assert len(D.tiles(np.full(n, 7, np.uint64), np.full(m, 7, np.uint64), 5)) == 1
    assert time.perf_counter() - began < 10


# -- token counts


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary here")
@pytest.mark.parametrize("chunk", [3, 1 << 18])
def test_token_counts_match_plain_spans(spark, odd, odd_rows, prose, monkeypatch, chunk):
    encoder, size = T.encoding(T.VOCABULARY)
    monkeypatch.setattr(T, "CHUNK", chunk)
    texts = [prose(1, 80), "a\n\n\n\nb  \n\n c", "é\nü∑\n", "\n\n\n", "", None, "x\r\n\r\ny"]
    fields = [[5, 5, 9000], [2, None, 4], [1, 2], [], [3], None, [100, 1]]
    frame = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(zip(texts, fields, strict=True))], "doc_id long, text string, cuts array<int>")
    for rule in T.RULES:
        for ends_col in (None, "cuts"):
            if ends_col is None:  # the chunk is read where the test runs, so the function is called here
                got = {i: T.attribute(T.line_ends((t or "").encode()), size[encoder.encode_to_numpy(t or "")], rule)[0].tolist() for i, t in enumerate(texts)}
            else:
                out = T.section_tokens(frame, rule=rule, ends_col=ends_col).orderBy("doc_id", "section").collect()
                got = {i: [r.n_tokens for r in rs] for i, rs in groupby(out, key=lambda r: r.doc_id)}
                assert all("".join((texts[i] or "")[r.start_char : r.end_char] for r in out if r.doc_id == i) == (texts[i] or "") for i in got)
            for i, text in enumerate(texts):
                raw = (text or "").encode()
                if ends_col:
                    at = [len((text or "")[: max([0, *(e for e in fields[i][: k + 1] if e is not None)])].encode()) for k, e in enumerate(fields[i] or []) if e is not None]
                else:
                    at = [k + 1 for k, b in enumerate(raw) if b == 10]
                at = at if at and at[-1] == len(raw) else [*at, len(raw)]
                want, done = [0] * len(at), 0
                for t in encoder.encode_ordinary(text or ""):
                    owner = [next(k for k, e in enumerate(at) if e > b) for b in range(done, done + int(size[t]))]
                    done += int(size[t])
                    most = max(Counter(owner).items(), key=lambda kv: (kv[1], -kv[0]))[0]
                    want[{"start": owner[0], "end": owner[-1], "majority": most}[rule]] += 1
                assert got[i] == want, (rule, ends_col, i)


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary here")
def test_long_texts_are_counted_like_others(odd, odd_rows):
    encoder, _ = T.encoding(T.VOCABULARY)
    out = defaultdict(list)
    for r in T.section_tokens(odd).collect():
        out[r.doc_id].append(r)
    assert set(out) == {r[0] for r in odd_rows}
    for i in (9, 10):
        assert sum(r.n_tokens for r in out[i]) == len(encoder.encode_ordinary(odd_rows[i][1]))


# -- chat


def plain_order(calls):
    """calls: id -> (turn, dependencies). Settles what can be settled, one call after another."""
    key, left, circle = {c: (t, 0) for c, (t, _) in calls.items()}, dict(calls), set()
    settled = {}
    while left:
        free = [c for c, (_, on) in left.items() if all(d not in left for d in on)]
        if not free:
            circle = set(left)
            break
        for c in free:
            settled[c] = key[c]
            del left[c]
            for d, (_, on) in left.items():
                if c in on and settled[c] >= key[d]:
                    key[d] = (settled[c][0], settled[c][1] + 1)
    order = sorted(calls, key=lambda c: (c in circle, key[c], c))
    return {c: (k, c in circle) for k, c in enumerate(order)}


def test_small_conversations_are_ordered_where_they_arrive(spark, monkeypatch):
    """Random graphs with circles, null turns, identifiers, conversations and dependencies: by joins alone, by both ways and
    by one dealing out, which stages nothing but the list of larger conversations."""
    rng, rows = np.random.default_rng(11), []
    for conv in [*range(40), None]:
        n = int(rng.integers(1, 12))
        for c in range(n):
            on = [None if rng.random() < 0.05 else f"c{d}" for d in rng.integers(0, n + 2, int(rng.choice([0, 1, 1, 2, 3])))]
            rows.append((conv, None if rng.random() < 0.05 else f"c{c}", None if rng.random() < 0.1 else int(rng.integers(0, 6)), "f", "{}", None if rng.random() < 0.05 else on))
    for c in range(30):
        rows.append((77, f"c{c}", 30 - c, "f", "{}", [f"c{c - 1}"] if c else []))
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>").repartition(5)
    results = calls.limit(0).select("conv_id", "call_id", "turn", F.col("name").alias("content"))
    staged, real, found = [], C.stage, {}
    monkeypatch.setattr(C, "stage", lambda df, label, *more: staged.append(label) or real(df, label, *more))
    for few in (0, 5, 200):
        monkeypatch.setattr(C, "FEW_CALLS", few)
        linked = C.linked(calls, results)
        out = C.arranged(linked, calls.select("conv_id")).select("conv_id", "turn", "call_id", "position", "cyclic", "dangling").collect()
        assert len(out) == linked.count()
        found[few] = sorted(map(str, out))
    assert found[0] == found[5] == found[200]
    staged.clear()
    known = calls.where("conv_id is not null and call_id is not null and turn is not null")
    got = {(r.conv_id, r.call_id): (r.position, r.cyclic) for r in C.formatted(known, results, {}).collect()}
    assert staged == ["chat-many"]
    by_conv = defaultdict(dict)
    for r in known.collect():
        by_conv[r.conv_id][r.call_id] = (r.turn, set(r.depends_on or ()))
    for conv, graph in by_conv.items():
        graph = {c: (t, on & set(graph)) for c, (t, on) in graph.items()}
        assert {c: got[conv, c] for c in graph} == plain_order(graph)


def test_settling_by_joins_is_the_peeling(spark, monkeypatch):
    """Many random graphs with chains, circles, self-loops and null turns at once, and a chain of 3,000 calls."""
    rng = np.random.default_rng(9)
    rows, want = [], {}

    def add(conv, turns, pairs):
        node = {c: conv * 10_000 + c for c in turns}
        for a, b in sorted(pairs):
            rows.append((conv, f"c{a}", f"c{b}", turns[a], turns[b], node[a], node[b]))
        known = {c for p in pairs for c in p}
        got = C.peeled([node[c] for c in known], {node[c]: turns[c] for c in known}, [(node[a], node[b]) for a, b in pairs])
        want.update({(conv, f"c{c}"): got[node[c]] for c in known})

    for conv in range(60):
        n = int(rng.integers(2, 14))
        turns = {c: None if rng.random() < 0.1 else int(rng.integers(0, 6)) for c in range(n)}
        pairs = {(c, int(d)) for c in range(n) for d in rng.choice(n, int(rng.choice([0, 1, 1, 1, 2])), replace=False) if conv % 3 or d < c}
        if pairs:
            add(conv, turns, pairs)
    add(900, {c: 3000 - c for c in range(3000)}, {(c, c - 1) for c in range(1, 3000)})
    e = spark.createDataFrame(rows, "conv_id long, call_id string, on string, turn long, on_turn long, a long, b long")
    staged, real = [], C.stage
    monkeypatch.setattr(C, "stage", lambda df, label, *more: staged.append(label) or real(df, label, *more))
    got = {(r.conv_id, r.call_id): (r.ready, r.depth, r.cyclic) for r in C._relaxed(e).collect()}
    assert got == want and any(v[2] for v in want.values()) and len(staged) < 60


@pytest.mark.parametrize("most", [500_000, 0])
def test_call_order_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(C, "MOST_CALLS", most)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for conv in range(12 if most else 5):
        n = int(rng.integers(1, 12))
        turns = rng.permutation(n) if conv % 2 else rng.integers(0, 5, n)
        calls = {}
        for k in range(n):
            on = [f"c{d}" for d in rng.choice(n + 1, min(n, int(rng.integers(0, 3))), replace=False) if conv % 3 or turns[d % n] < turns[k] or d > k]
            rows.append((conv, f"c{k}", int(turns[k]), "f", "{}", on, "clash", 1))
            calls[f"c{k}"] = (int(turns[k]), [d for d in on if int(d[1:]) < n])
        for c, found in plain_order(calls).items():
            want[conv, c] = found
    frame = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, status string, depth int")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    out = C.formatted(frame, results, {}).collect()
    assert {(r.conv_id, r.call_id): (r.position, r.cyclic) for r in out} == want
    assert any(c for _, c in want.values()) and not all(c for _, c in want.values())


def test_long_circles_and_chains_take_few_rounds(spark):
    n = 400
    chain = [(1, f"c{k:03d}", k, "f", '{"x":"' + "y" * 300_000 + '"}' if k == 3 else "{}", [f"c{k + 1:03d}"] if k < n - 1 else []) for k in range(n)]
    circle = [(2, f"c{k:03d}", k, "f", "{}", [f"c{(k + 1) % n:03d}"]) for k in range(n)]
    frame = spark.createDataFrame(chain + circle, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    began = time.perf_counter()
    out = C.formatted(frame, results, {}).collect()
    assert time.perf_counter() - began < 120
    assert [r.call_id for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)] == [f"c{k:03d}" for k in reversed(range(n))]
    assert all(r.cyclic for r in out if r.conv_id == 2) and not any(r.cyclic for r in out if r.conv_id == 1)


# -- sharding


def test_rows_follow_the_stored_map(spark, prose, tmp_path):
    folder = f"file://{tmp_path}/maps"
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 60)) for i in range(500)], FRAME)
    place = lambda m: {r.doc_id: (r.shard, r.slot, r.map_version) for r in H.place(H.sized(docs, slots=256), m, 256).collect()}
    first = {r.doc_id: (r.shard, r.slot, r.map_version) for r in H.shard(docs, 4, slots=256, folder=folder).collect()}
    assert first == place(H.load_map(spark, folder)) and {v for *_, v in first.values()} == {1}
    assert {r.doc_id: (r.shard, r.slot, r.map_version) for r in H.shard(docs, 4, slots=256, folder=folder).collect()} == first
    second = place(H.grow(spark, folder))
    moved = {i for i in first if first[i][0] != second[i][0]}
    assert moved and {second[i][0] for i in moved} == {4} and {v for *_, v in second.values()} == {2}
    assert place(H.load_map(spark, folder, 1)) == first and place(H.load_map(spark, folder)) == second
    for placed in (first, second):
        slots = defaultdict(list)
        for shard, slot, _ in placed.values():
            slots[shard].append(slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Other loads get a version of their own.
    assert {r.map_version for r in H.shard(docs.limit(300), 4, slots=256, folder=folder).collect()} == {3}
    with pytest.raises(ValueError):
        H.grow(spark, f"file://{tmp_path}/none")


def test_rows_without_a_key_are_spread(spark, prose):
    docs = spark.createDataFrame([(None if i % 2 else 7, prose(i, 20)) for i in range(400)], FRAME)
    loads = Counter()
    for r in H.shard(docs).collect():
        loads[r.shard] += r.size
    assert len(loads) == 8 and max(loads.values()) < 1.2 * min(loads.values())


# -- repeats, near copies, plans


def plain_repeats(ids, texts, length=100):
    seen, out = {}, {}
    for i in sorted(range(len(ids)), key=lambda i: ids[i]):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen.setdefault(raw[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = True
        out[ids[i]] = int(gone.sum())
    return out


def test_long_texts_are_walked_in_pieces(prose):
    rng = np.random.default_rng(5)
    text = prose(1, 400)
    texts = [text * 3, "".join(rng.choice(list("abcdef "), 5000)), text[50:] + text[:900], "x" * 4000]
    data, offsets = support.text_bytes(pa.array(texts))
    whole = np.concatenate(list(U.walk(data, offsets, np.arange(4))))
    keep, U.WALK_BYTES = U.WALK_BYTES, 300
    try:
        parts = np.concatenate(list(U.walk(data, offsets, np.arange(4))))
    finally:
        U.WALK_BYTES = keep
    strings = lambda found: sorted((int(f["doc"]), s) for f in found for s in range(int(f["start"]), int(f["start"]) + int(f["size"]) - 99))
    assert strings(whole) == strings(parts) == [(d, s) for d, t in enumerate(texts) for s in range(len(t.encode()) - 99)]


def test_rows_without_an_id_are_documents_by_their_text(spark, prose):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(None, a), (None, a), (None, b), (3, a + b), (4, prose(3, 60))]
    out = U.remove_repeats(spark.createDataFrame(rows, FRAME), keep_text=False).collect()
    got = sorted((r.doc_id or 0, r.n_removed) for r in out)
    assert got[:3] == [(0, 0)] * 3 and got[3][1] == len(a) + len(b) and got[4] == (4, 0)


def test_sketches_and_places_never_exclude_similar_sets():
    rng = np.random.default_rng(1)
    for _ in range(400):
        base = rng.integers(0, 1 << 62, int(rng.integers(1, 400)), dtype=np.uint64)
        a, b = (np.unique(np.r_[base[rng.random(len(base)) < q], rng.integers(0, 1 << 62, int(rng.integers(0, 30)), dtype=np.uint64)]) for q in rng.choice([0.5, 0.9, 0.97, 1.0], 2))
        if not len(a) or not len(b):
            continue
        both = np.intersect1d(a, b)
        assert N.most_shared(N.sketch(a), N.sketch(b)) >= len(both)
        if N.similar(a, b) and len(both):
            i, j = (int(np.searchsorted(x, both[0])) for x in (a, b))
            assert min(len(a) - i, len(b) - j) * (N.OF + N.TIMES) >= (len(a) + len(b)) * N.TIMES
    assert N.sketch(np.zeros(300, np.uint64)) == b"" and N.most_shared(b"", b"x") is None


def test_shingle_sets_are_those_of_the_words(odd_rows, prose):
    texts = [r[1] for r in odd_rows] + [prose(1), "a b", "A b", "a b c d e", "a b c d e a b c d e"]
    sets = N.shingle_sets(pa.array(texts, pa.string()))
    plain = []
    for t in texts:
        w = (t or "").encode().lower().split()
        plain.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


@pytest.mark.parametrize("piece", [1, 7, 100])
def test_fingerprints_do_not_depend_on_pieces(odd_rows, prose, monkeypatch, piece):
    texts = [t for _, t, *_ in odd_rows if t is None or len(t) < 5000] + [prose(3, 150), "a", "a b", "a b c", " a  b c d "]
    want = [[S.fingerprint(t, w) for t in texts] for w in (1, 3, 5)]
    monkeypatch.setattr(S, "PIECE", piece)
    assert [[S.fingerprint(t, w) for t in texts] for w in (1, 3, 5)] == want


def test_no_text_is_aggregated_or_sorted(spark, prose):
    docs = spark.createDataFrame([(i, prose(i % 7, 50), "s") for i in range(20)], "doc_id long, text string, source string")
    out = S.deduplicate(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan and out.count() == 7


@pytest.mark.parametrize("what", ["plain_hashes", "word_hashes", "encode", "encode_whole", "spans", "shingles", "fingerprint", "benchmark", "tokens"])
def test_a_text_of_64_mb(what):
    code = f"""
import resource, sys
sys.path.insert(0, {ROOT!r})
import numpy as np, pyarrow as pa
from tidewin.llm import words as W, passages as P, simhash as S, suffix_dedup as U, near_copies as N, decontamination as D, support, token_counts as T
text = pa.array(["".join(f"w{{k % 99991}} " + "lorem ipsum dolor sit amet, " for k in range(1 << 16)) * 30])
assert len(text[0].as_buffer()) >= 1 << 26
def spans():
    data, offsets = support.text_bytes(text)
    for found in U.walk(data, offsets, np.array([1])):
        U.settle(found)
def tokens():
    encoder, size = T.encoding(T.VOCABULARY)
    T.attribute(T.line_ends(text[0].as_buffer().to_pybytes()), size[encoder.encode_to_numpy(text[0].as_py()[: 1 << 25])])
run = dict(plain_hashes=lambda: W.plain_hashes(text), word_hashes=lambda: W.word_hashes(text), encode=lambda: P.encode(text), encode_whole=lambda: P.encode_whole(text), spans=spans, shingles=lambda: N.shingle_sets(text), fingerprint=lambda: S.fingerprint(text[0].as_py()), benchmark=lambda: list(D.Benchmark([1], ["one two three four five six"]).matches(text, 0.8)), tokens=tokens)
run[{what!r}]()
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""
    if what == "tokens" and not os.path.exists(T.VOCABULARY):
        pytest.skip("no vocabulary here")
    began = time.perf_counter()
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
    assert float(done.stdout) < 1024 and time.perf_counter() - began < 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["chat_call_order", "op1_sharding", "op2_quality_rules", "op5_chat"])
def test_queries_agree_with_sql(spark, name):
    from tidewin.llm.queries import ORACLES, QUERIES

    duck = duckdb.connect()
    for t in ("documents", "labels", "conversations", "lineitem"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want)) and want


def test_a_folder_that_executors_share_is_asked_for(spark):
    assert support.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = support.stage(spark.range(3).toDF("x"), "gone")
    assert df.count() == 3
    support.discard(df)
    assert not os.path.exists(df._staged.removeprefix("file://"))

import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from tidewin.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_a_plain_loop(spark, odd, odd_rows, prose):
    texts = [r[1] for r in odd_rows if r[1] is None or len(r[1]) < 130_000] + [prose(k, 40) + "\n\n#*$" + prose(k, 40) for k in range(5)] + ["a b a b a b a", "a b c a b c", "a\x0bb\x1fc\x85d e", "l\nl\n l\nl\n\n \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.text_counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id]), repr(texts[r.doc_id])[:80]


@pytest.mark.parametrize("alpha", [0.005, 0.1])
def test_binomial_bound_is_exact(spark, alpha):
    ns, level = [0, 1, 50, 400, 2000], 0.001
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", Q.most_allowed(F.col("n"), alpha, F.lit(level)).alias("k")).collect()}
    for n in ns:
        total, k = 0.0, -1
        for i in range(n + 1):
            total += comb(n, i) * alpha**i * (1 - alpha) ** (n - i)
            if total > level:
                break
            k = i
        assert got[n] == k


def test_cutoffs_need_evidence_and_bound_false_rejections(spark, prose):
    clean = [(i, prose(i, 60), "en", 1) for i in range(2400)]
    junk = [(10_000 + i, " ".join(w + "###" for w in prose(i, 60).split()), "en", 0) for i in range(200)]
    few = [(20_000 + i, t, "fr", y) for i, (_, t, _, y) in enumerate(clean[:50] + junk[:50])]
    rows = clean + junk + few
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    out = {r.doc_id: r for r in Q.quality_filter(docs, labels, risk=0.04).collect()}
    assert all(out[r[0]].kept for r in clean) and not any(out[r[0]].kept for r in junk)
    assert all(out[r[0]].kept for r in few)  # too few labels to certify anything


def test_odd_and_empty_tables(odd, none, odd_labels, no_labels, odd_rows):
    assert Q.quality_filter(odd, odd_labels).count() == len(odd_rows)
    assert all(r.base_failed and not r.kept for r in Q.quality_filter(odd, no_labels).collect() if r.n_words < 50)
    assert Q.quality_filter(none, odd_labels).count() == 0

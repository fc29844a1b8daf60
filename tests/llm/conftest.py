import numpy as np
import pytest

SYLLABLES = "an en er th in on re ed st es ing ou ble tion ly ha at nd sh".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, words): invented words, the same for the same arguments."""

    def make(seed, words=120):
        rng = np.random.default_rng(seed)
        out = ["".join(rng.choice(SYLLABLES, rng.integers(1, 5))) for _ in range(words)]
        return " ".join(w.capitalize() + "." if i % 11 == 10 else w + "\n" * (i % 37 == 36) for i, w in enumerate(out))

    return make


#: Names that operators use inside: they must not clash.
EXTRA = "lang string, source string, n_chars long, tokens long, p0 double, _0 string, _id long, doc string, fp long, shard string, score string, stratum string, size string, cuts string"


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in any column, empty, blank, very long and repeated texts, repeated rows, an id without a text."""
    a, b = prose(1), prose(2, 60)
    texts = [None, "", " \t\n ", "word", "Word", a, a, a.upper(), b, "x" * 300_000, "ab " * 40_000, "é∑𝄞 " * 50, "\x00 nul", a + "\n" + a, b + " " + a]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, a), (None, None), (5, a), (-3, b)]
    return [(i, t, [None, "en", "fr", "de"][k % 4], None if k % 3 else "s", k, k, 0.5, "z", k, "d", k, "s", "q", "t", "u", "c") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(15)] + [(None, 1, 1), (3, None, None), (99, 1, 0), (4, 1, 1), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

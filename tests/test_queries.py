"""Every query with SQL agrees with DuckDB on the small tables; every other one runs."""

import math
import os

import duckdb
import pytest

from tidewin.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow on any data: they are run at full size by the driver.
SLOW = {"lr_lopo", "forest_lopo", "boosted_teacher", "teacher_students", "four_arms", "hyperparameter_search", "recording_features", "recording_filter"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in r])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalogue.ORACLES:
        found = duck.sql(catalogue.ORACLES[name])
        assert sorted(found.columns) == columns
        at = [list(found.columns).index(c) for c in columns]
        want = ordered(tuple(plain(r[i]) for i in at) for r in found.fetchall())
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g == pytest.approx(w, rel=1e-9, abs=2e-6) if all(isinstance(v, (int, float)) for v in (*g, *w)) else all(a == b or isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, abs=2e-6) for a, b in zip(g, w, strict=True))

import numpy as np
import pytest

from tidewin.functions import kernels as K
from tidewin.functions import table as T


@pytest.fixture(scope="module")
def rows(spark):
    T.register(spark)
    x = np.random.default_rng(0).normal(size=128).tolist()
    return spark.createDataFrame([(1, x), (2, None), (3, [1.0]), (4, [1.0, float("nan"), 2.0]), (5, [1.0, None, 2.0]), (6, [])], "id int, x array<double>")


def test_spectra_and_bands(spark, rows):
    got = spark.sql("SELECT r.id, s.* FROM {r} r, LATERAL spectrum(r.x, 64.0D, 32) s", r=rows).collect()
    x = np.array(rows.where("id = 1").first().x)
    f, p = K.welch(x[None], 64.0, 32)
    assert {r.id for r in got} == {1} and [(r.frequency_hz, r.density) for r in got] == list(zip(f.tolist(), p[0].tolist(), strict=True))
    bands = spark.sql("SELECT r.id, b.* FROM {r} r, LATERAL band_powers(r.x, 64.0D, 32, 'beta,delta') b", r=rows)
    assert bands.columns == ["id", "beta", "delta"]
    want = dict(zip(K.BANDS, K.band_powers(f, p)[0], strict=True))
    assert tuple(bands.first())[1:] == pytest.approx((want["beta"], want["delta"]))


def test_gaps_and_crossings(spark):
    T.register(spark)
    one = spark.createDataFrame([([5.0, 1.0, None, 1.5, 9.0], [0.0, 1.0, -1.0, 1.0, 0.2, -0.5])], "t array<double>, x array<double>")
    assert [tuple(r) for r in spark.sql("SELECT g.* FROM {o} o, LATERAL gaps(o.t, 1.0D) g", o=one).collect()] == [(1.5, 3.5), (5.0, 4.0)]
    assert [r.event for r in spark.sql("SELECT c.event FROM {o} o, LATERAL crossings(o.x, 0.5D, 2) c", o=one).collect()] == [2]


@pytest.mark.parametrize("call", ["spectrum(r.id, 64.0D, 32)", "spectrum(r.x, 0.0D, 32)", "spectrum(r.x, 64.0D, 1)", "band_powers(r.x, 64.0D, 32, 'omega')", "band_powers(r.x, 64.0D, 32, '')", "gaps(r.x, -1.0D)", "crossings(r.x, 0.0D, 1)"])
def test_wrong_arguments_are_errors_of_the_analysis(spark, rows, call):
    with pytest.raises(Exception, match="must be"):
        spark.sql(f"SELECT * FROM {{r}} r, LATERAL {call} s", r=rows)

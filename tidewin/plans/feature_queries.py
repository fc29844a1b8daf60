"""Queries on window features, spectra and reconstruction: embeddings are windows of 64 samples at 64 Hz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import table
from ..functions.columns import feature_part, ratio
from ..operators import chunks as H
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import measures as M
from ..operators import relational as R
from . import base as B
from .evaluation_queries import rounded

S, D = SparkSession, DataFrame
RATE, SEGMENT = 64.0, 32


def signals(spark: S, sf: str) -> D:
    return B.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def time_features(spark: S, sf: str) -> D:
    return rounded(M.time_features(signals(spark, sf), ["vec_id"], "samples"))


def hjorth_features(spark: S, sf: str) -> D:
    return rounded(M.hjorth_features(signals(spark, sf), ["vec_id"], "samples"))


def permutation_entropy(spark: S, sf: str) -> D:
    return rounded(M.permutation_entropy(signals(spark, sf), ["vec_id"], "samples"))


def sliding_measures(spark: S, sf: str) -> D:
    """Time and Hjorth measures of windows of 256 samples, one at every 64, over the recording of 22 channels that holds every
    stored vector: a vector is a pane."""
    width = len(CHANNELS)
    panes = signals(spark, sf).select((F.col("vec_id") % width).cast("int").alias("channel"), F.floor(F.col("vec_id") / width).alias("pane"), "samples")
    return rounded(M.window_measures(M.pane_summaries(panes, ["channel"], "pane", "samples"), ["channel"], 4, 1))


def welch_spectrum(spark: S, sf: str) -> D:
    return rounded(X.spectra(signals(spark, sf), ["vec_id"], "samples", RATE, SEGMENT), 9)


def sql_spectra(spark: S, sf: str) -> D:
    """The spectra by SQL, from a table function."""
    table.register(spark)
    return rounded(spark.sql(f"SELECT e.vec_id, s.frequency_hz, s.density FROM {{e}} e, LATERAL spectrum(e.samples, {RATE}D, {SEGMENT}) s", e=signals(spark, sf)), 9)


def sql_bands(spark: S, sf: str) -> D:
    """Two bands' powers by SQL: the function's columns follow from its arguments."""
    table.register(spark)
    return rounded(spark.sql(f"SELECT e.vec_id, b.alpha, b.theta FROM {{e}} e, LATERAL band_powers(e.samples, {RATE}D, {SEGMENT}, 'theta, alpha') b", e=signals(spark, sf)), 9)


def band_powers(spark: S, sf: str) -> D:
    def kernel(x):
        return dict(zip(K.BANDS, K.band_powers(*K.welch(x, RATE, SEGMENT)).T, strict=True))

    return rounded(X.per_signal(signals(spark, sf), ["vec_id"], "samples", kernel, list(K.BANDS)), 9)


def relative_band_powers(spark: S, sf: str) -> D:
    return rounded(X.relative_powers(signals(spark, sf), ["vec_id"], "samples", RATE, SEGMENT))


def relative_band_powers_wide(spark: S, sf: str) -> D:
    return rounded(X.relative_powers(signals(spark, sf), ["vec_id"], "samples", RATE, 64, wide=True))


def spectral_entropy(spark: S, sf: str) -> D:
    return rounded(X.per_signal(signals(spark, sf), ["vec_id"], "samples", lambda x: {"spectral": K.spectral_entropy(K.welch(x, RATE, SEGMENT)[1])}, ["spectral"]))


def spectral_snr(spark: S, sf: str) -> D:
    return rounded(X.per_row(signals(spark, sf), ["vec_id"], ["samples"], lambda x: [{"snr_db": K.spectral_snr(X.np.array(x), RATE, 10.0)}], "snr_db double"))


def spectral_slope(spark: S, sf: str) -> D:
    return rounded(X.per_row(signals(spark, sf), ["vec_id"], ["samples"], lambda x: [{"slope": K.spectral_slope(X.np.array(x), RATE)}], "slope double"))


def psd_validity(spark: S, sf: str) -> D:
    p = X.spectra(signals(spark, sf), ["vec_id"], "samples", RATE, SEGMENT).groupBy("vec_id")
    return p.agg((F.bool_and(F.col("density") >= 0) & (F.sum("density") > 0)).alias("valid"), F.count(F.lit(1)).alias("bins"))


def standardised_mean(spark: S, sf: str) -> D:
    """Standardised samples have mean zero and unit deviation."""
    z = M.standardised(signals(spark, sf), ["vec_id"], "samples")
    return rounded(z.select("vec_id", F.get("samples", F.lit(0)).alias("first"), F.sqrt(M.variance(F.col("samples"))).alias("sd")))


def stride_preservation(spark: S, sf: str) -> D:
    """What a stride of four and straight lines keep of each signal."""
    return rounded(M.preservation(M.reconstructed(signals(spark, sf), ["vec_id"], "samples", 4), ["vec_id"]))


def antialiased_preservation(spark: S, sf: str) -> D:
    """The same of each signal's low-pass."""
    return rounded(M.preservation(M.reconstructed(signals(spark, sf), ["vec_id"], "samples", 4, True), ["vec_id"]))


def _channels(spark: S, sf: str) -> D:
    """Each embedding as four channels of 16 samples."""
    slices = F.explode(F.array(*[F.struct(F.lit(f"C{k}").alias("channel"), F.slice("samples", 16 * k + 1, 16).alias("samples")) for k in range(4)]))
    return signals(spark, sf).select("vec_id", slices.alias("c")).select("vec_id", "c.channel", "c.samples")


def features_long(spark: S, sf: str) -> D:
    return rounded(X.features_long(X.window_features(_channels(spark, sf), ["vec_id", "channel"], "samples", RATE, 16), ["vec_id", "channel"]), 9)


def features_wide(spark: S, sf: str) -> D:
    """60 columns, family__measure__channel, one row for each window."""
    return X.features_wide(features_long(spark, sf), ["vec_id"], "channel", [f"C{k}" for k in range(4)])


def family_ablation(spark: S, sf: str) -> D:
    """Columns of two families only, by prefix."""
    return R.with_prefix(features_wide(spark, sf), ["vec_id"], "hjorth__", "entropy__")


def relative_block(spark: S, sf: str) -> D:
    """The frequency columns replaced by their share of the channel's band total; all others unchanged."""
    wide = features_wide(spark, sf)

    def share(name: str):
        channel = name.rsplit("__", 1)[1]
        return ratio(F.col(name), sum((F.col(f"freq__{b}__{channel}") for b in K.BANDS), F.lit(0.0)))

    return rounded(R.replace_block(wide, "freq__", "freq_relative__", share), 9)


def family_importance(spark: S, sf: str) -> D:
    """Spread of each feature as its importance, summed by family, and each measure's mean over channels."""
    long = features_long(spark, sf).withColumn("name", F.concat_ws("__", "feature", "channel"))
    each = long.groupBy("name").agg(F.stddev_pop("value").alias("importance"))
    return rounded(each.groupBy(feature_part("name", "family").alias("family")).agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("features")))


def top_features(spark: S, sf: str) -> D:
    long = features_long(spark, sf).withColumn("name", F.concat_ws("__", "feature", "channel"))
    each = long.groupBy("name").agg(F.round(F.stddev_pop("value"), 6).alias("importance"))
    return R.top(each, 20, "importance", "name")


def feature_changes(spark: S, sf: str) -> D:
    """Time features of strided signals against the clean ones, by stride."""

    def measured(stride: int) -> D:
        wide = M.time_features(signals(spark, sf).withColumn("samples", M.kept_every(F.col("samples"), stride)), ["vec_id"], "samples")
        return X.features_long(wide, ["vec_id"]).withColumn("stride", F.lit(stride))

    return rounded(E.feature_changes(measured(2).unionByName(measured(4)), measured(1), ["vec_id"], ["stride"]))


#: A recording of 22 channels at 256 Hz: at least an hour of it, 900 windows of 1,024 samples, in pieces of fifteen.
CHANNELS, HOUR, WHOLE, PIECE = [f"C{k:02d}" for k in range(22)], 900, 1024, 15


def _blocks(spark: S, sf: str) -> D:
    """Stored blocks of 1,024 samples, sixteen embeddings each, numbered from 0; an incomplete last one is left out, as the
    incomplete tail of a recording gives no window."""
    e = B.read(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 16).alias("block"))
    whole = e.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("e")).where("n = 16")
    return whole.select("block", F.flatten(F.transform("e", lambda x: x["embedding"])).cast("array<double>").alias("samples"))


def _recording(spark: S, sf: str) -> D:
    """(window, channel, samples): the stored blocks in turn, again and again for an hour, or once each if they are more."""
    blocks = _blocks(spark, sf)
    n = blocks.count()
    places = spark.range(max(HOUR * len(CHANNELS), n)).select(F.floor(F.col("id") / len(CHANNELS)).cast("int").alias("window"), (F.col("id") % len(CHANNELS)).cast("int").alias("channel"), (F.col("id") % max(n, 1)).alias("block"))
    return places.join(blocks, "block").drop("block")


def recording_features(spark: S, sf: str) -> D:
    """All 330 features of every window that has all 22 channels, in pieces of a minute."""
    rows = _recording(spark, sf).select(F.floor(F.col("window") / PIECE).alias("piece"), F.col("channel"), (F.col("window") % PIECE * WHOLE).alias("first_sample"), "samples")
    beside = rows.groupBy("piece", "first_sample").agg(F.sort_array(F.collect_list(F.struct("channel", "samples"))).alias("c")).where(F.size("c") == len(CHANNELS))
    # A minute's windows stand end to end in a row; the windows of a cut last minute stand there as well.
    piece = beside.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("first_sample", "c"))).alias("w"))
    signal = lambda k: F.flatten(F.transform("w", lambda x: x["c"][k]["samples"]))
    wide = X.recording_features(piece.select("piece", F.array(*map(signal, range(len(CHANNELS)))).alias("signals")).repartition("piece"), ["piece"], CHANNELS, 256.0, clean=None)
    names = K.feature_names(CHANNELS)
    return rounded(wide.select((F.col("piece") * PIECE + F.col("start_sec") / 4).cast("int").alias("window"), *names), 9)


#: Embeddings of 64 samples in a chunk of a recording.
CHUNK = 64


def recording_filter(spark: S, sf: str) -> D:
    """Notch and band-pass over a recording of 22 channels at 256 Hz that holds every stored vector, 64 samples each, by
    overlap-save: each second's mean square before and after."""
    width = len(CHANNELS)
    e = B.read(spark, sf, "embeddings").select((F.col("vec_id") % width).cast("int").alias("channel"), F.floor(F.col("vec_id") / width).alias("place"), F.col("embedding").cast("array<double>").alias("samples"))
    pieces = e.select("channel", (F.col("place") * 64).alias("first_sample"), "samples")
    chunks = H.rechunked(pieces, ["channel"], 64 * CHUNK)
    clean = H.filtered(chunks, ["channel"], K.cleaning(256.0)).select("channel", "chunk", F.col("samples").alias("clean"))
    both = chunks.join(clean, ["channel", "chunk"]).select("channel", "first_sample", F.posexplode(F.arrays_zip("samples", "clean")).alias("k", "x"))
    second = F.floor((F.col("first_sample") + F.col("k")) / 256).cast("int").alias("second")
    mean = lambda c: F.avg(F.col(f"x.{c}") * F.col(f"x.{c}"))
    return rounded(both.groupBy("channel", second).agg(mean("samples").alias("before"), mean("clean").alias("after")), 9)


def short_filter(spark: S, sf: str) -> D:
    """Each signal through a zero-phase band-pass of 4 to 12 Hz, sample by sample."""
    taps = K.fir_bandpass(4.0, 12.0, RATE, (2.0, 2.0))

    def study(x):
        return [{"k": k, "y": float(v)} for k, v in enumerate(K.zero_phase(taps, X.np.array(x)))]

    return rounded(X.per_row(signals(spark, sf), ["vec_id"], ["samples"], study, "k int, y double"))


def coloured_noise(spark: S, sf: str) -> D:
    """Noise of each colour with stored spectra: samples 0, 7 and 31 of 60."""
    def study(x):
        spectrum = X.np.array(x[:31]) + 1j * X.np.array(x[31:62])
        return [{"beta": beta, "k": k, "x": float(K.coloured(spectrum, 60, RATE, beta)[k])} for beta in (0, 1, 3) for k in (0, 7, 31)]

    return rounded(X.per_row(signals(spark, sf), ["vec_id"], ["samples"], study, "beta int, k int, x double"))


QUERIES = {f.__name__: f for f in (sql_spectra, sql_bands, sliding_measures, short_filter, coloured_noise, feature_changes, recording_features, recording_filter, time_features, hjorth_features, permutation_entropy, welch_spectrum, band_powers, relative_band_powers, relative_band_powers_wide, spectral_entropy, spectral_snr, spectral_slope, psd_validity, standardised_mean, stride_preservation, antialiased_preservation, features_long, features_wide, family_ablation, relative_block, family_importance, top_features)}

_X = "x AS (SELECT vec_id, i - 1 AS k, embedding[i]::DOUBLE AS v FROM embeddings, generate_series(1, 64) t(i))"


def _dft(size: int, step: int, starts: str) -> str:
    """Welch's estimate by a join of samples with cosines and sines."""
    return f"""{_X}, seg AS (SELECT vec_id, s, k - s AS j, v FROM x, (SELECT unnest({starts}) AS s) WHERE k >= s AND k < s + {size}),
cut AS (SELECT vec_id, s, j, (v - avg(v) OVER (PARTITION BY vec_id, s)) * (0.5 - 0.5 * cos(2 * pi() * j / {size})) AS u FROM seg),
co AS (SELECT vec_id, s, m, sum(u * cos(2 * pi() * m * j / {size})) AS a, sum(u * sin(2 * pi() * m * j / {size})) AS b FROM cut, (SELECT unnest(generate_series(0, {size // 2})) AS m) GROUP BY vec_id, s, m),
psd AS (SELECT vec_id, m * 64.0 / {size} AS f, avg((a * a + b * b) * CASE WHEN m IN (0, {size // 2}) THEN 1 ELSE 2 END / (64.0 * {size} * 0.375)) AS p FROM co GROUP BY vec_id, m)"""


_W32 = "WITH " + _dft(32, 16, "[0, 16, 32]")
_W64 = "WITH " + _dft(64, 32, "[0]")


def _areas(bands: dict, inclusive: bool, name: str) -> str:
    return f"pairs AS (SELECT vec_id, f, lead(f) OVER w AS g, (p + lead(p) OVER w) / 2 * (lead(f) OVER w - f) AS area FROM psd WINDOW w AS (PARTITION BY vec_id ORDER BY f)), {name} AS (SELECT vec_id, sum(area) AS total, " + ", ".join(f"coalesce(sum(area) FILTER (f >= {a} AND g {'<=' if inclusive else '<'} {b}), 0.0) AS {n}" for n, (a, b) in bands.items()) + " FROM pairs GROUP BY vec_id)"


_LINES = "WITH " + _X + ", line AS (SELECT a.vec_id, a.k, a.v AS x, l.v + (coalesce(r.v, l.v) - l.v) * ((a.k % 4) / 4.0) AS y FROM x a JOIN x l ON a.vec_id = l.vec_id AND l.k = a.k - a.k % 4 LEFT JOIN x r ON a.vec_id = r.vec_id AND r.k = a.k - a.k % 4 + 4)"

# All fifteen measures of each embedding's four channels of 16 samples, by the same definitions.
_LONG = f"""WITH {_X}, c AS (SELECT vec_id, 'C' || (k // 16) AS channel, k % 16 AS j, v FROM x),
d AS (SELECT *, v - lag(v) OVER w AS d1, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS e FROM c WINDOW w AS (PARTITION BY vec_id, channel ORDER BY j)),
dd AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY vec_id, channel ORDER BY j) AS d2 FROM d),
t AS (SELECT vec_id, channel, avg(v) AS mean, stddev_pop(v) AS std, sqrt(avg(v * v)) AS rms, max(v) - min(v) AS ptp, sum(abs(d1)) AS line_length, var_pop(v) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM dd GROUP BY 1, 2),
o AS (SELECT vec_id, channel, (b < v)::INT + 2 * (e < v)::INT + 4 * (e < b)::INT AS code, count(*) / 14 AS p FROM d WHERE e IS NOT NULL GROUP BY 1, 2, 3),
pe AS (SELECT vec_id, channel, -sum(p * log2(p)) / log2(6) AS perm FROM o GROUP BY 1, 2),
u AS (SELECT vec_id, channel, j, (v - avg(v) OVER (PARTITION BY vec_id, channel)) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS u FROM c),
co AS (SELECT vec_id, channel, m, sum(u * cos(2 * pi() * m * j / 16)) AS a, sum(u * sin(2 * pi() * m * j / 16)) AS b FROM u, (SELECT unnest(generate_series(0, 8)) AS m) GROUP BY 1, 2, 3),
psd AS (SELECT vec_id, channel, m * 4.0 AS f, (a * a + b * b) * CASE WHEN m IN (0, 8) THEN 1 ELSE 2 END / (64.0 * 16 * 0.375) AS p FROM co),
se AS (SELECT vec_id, channel, -sum(r * log2(r)) / log2(9) AS spectral FROM (SELECT *, p / sum(p) OVER (PARTITION BY vec_id, channel) AS r FROM psd) GROUP BY 1, 2),
ar AS (SELECT vec_id, channel, f, lead(f) OVER w AS g, (p + lead(p) OVER w) / 2 * 4.0 AS area FROM psd WINDOW w AS (PARTITION BY vec_id, channel ORDER BY f)),
ba AS (SELECT vec_id, channel, {", ".join(f"coalesce(sum(area) FILTER (f >= {a} AND g <= {b}), 0.0) AS {n}" for n, (a, b) in K.BANDS.items())} FROM ar GROUP BY 1, 2),
every AS (SELECT *, v0 AS activity, sqrt(v1 / v0) AS mobility, sqrt(v2 / v1) / sqrt(v1 / v0) AS complexity FROM t JOIN pe USING (vec_id, channel) JOIN se USING (vec_id, channel) JOIN ba USING (vec_id, channel)),
long AS ({" UNION ALL ".join(f"SELECT vec_id, channel, '{family}__{m}' AS feature, round({m}, 9)::DOUBLE AS value FROM every" for family, ms in K.MEASURES.items() for m in ms)})"""
_NAMES = K.feature_names([f"C{k}" for k in range(4)])


def _wide(name: str) -> str:
    family, measure, channel = name.split("__")
    return f"max(value) FILTER (feature = '{family}__{measure}' AND channel = '{channel}')"


def _share(name: str) -> str:
    family, measure, channel = name.split("__")
    total = f"sum(value) FILTER (feature LIKE 'freq%' AND channel = '{channel}')"
    return f"round(CASE WHEN {total} = 0 THEN 0.0 ELSE {_wide(name)} / {total} END, 9)::DOUBLE AS freq_relative__{measure}__{channel}"


_EACH = f"{_LONG}, each AS (SELECT feature || '__' || channel AS name, stddev_pop(value) AS importance FROM long GROUP BY 1)"

# The hour's features by block of 1,024 samples, by the same definitions; segments of 256 overlap by half.
_HOUR = f"""WITH x AS (SELECT vec_id // 16 AS b, (vec_id % 16) * 64 + i - 1 AS j, embedding[i]::DOUBLE AS v FROM embeddings, generate_series(1, 64) t(i) WHERE vec_id // 16 IN (SELECT vec_id // 16 FROM embeddings GROUP BY 1 HAVING count(*) = 16)),
d AS (SELECT *, v - lag(v) OVER w AS d1, lead(v, 1) OVER w AS n1, lead(v, 2) OVER w AS n2 FROM x WINDOW w AS (PARTITION BY b ORDER BY j)),
dd AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY b ORDER BY j) AS d2 FROM d),
t AS (SELECT b, avg(v) AS mean, stddev_pop(v) AS std, sqrt(avg(v * v)) AS rms, max(v) - min(v) AS ptp, sum(abs(d1)) AS line_length, var_pop(v) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM dd GROUP BY 1),
o AS (SELECT b, (n1 < v)::INT + 2 * (n2 < v)::INT + 4 * (n2 < n1)::INT AS code, count(*) / 1022 AS p FROM d WHERE n2 IS NOT NULL GROUP BY 1, 2),
pe AS (SELECT b, -sum(p * log2(p)) / log2(6) AS perm FROM o GROUP BY 1),
seg AS (SELECT b, s, j - s AS k, v FROM x, (SELECT unnest(generate_series(0, 768, 128)) AS s) WHERE j >= s AND j < s + 256),
u AS (SELECT b, s, k, (v - avg(v) OVER (PARTITION BY b, s)) * (0.5 - 0.5 * cos(2 * pi() * k / 256)) AS u FROM seg),
co AS (SELECT b, s, m, sum(u * cos(2 * pi() * (m * k % 256) / 256)) AS re, sum(u * sin(2 * pi() * (m * k % 256) / 256)) AS im FROM u, (SELECT unnest(generate_series(0, 128)) AS m) GROUP BY 1, 2, 3),
psd AS (SELECT b, m AS f, avg((re * re + im * im) * CASE WHEN m IN (0, 128) THEN 1 ELSE 2 END / (256.0 * 256 * 0.375)) AS p FROM co GROUP BY 1, 2),
se AS (SELECT b, -sum(r * log2(r)) / log2(129) AS spectral FROM (SELECT *, p / sum(p) OVER (PARTITION BY b) AS r FROM psd) GROUP BY 1),
ar AS (SELECT b, f, lead(f) OVER w AS g, (p + lead(p) OVER w) / 2 AS area FROM psd WINDOW w AS (PARTITION BY b ORDER BY f)),
ba AS (SELECT b, {", ".join(f"coalesce(sum(area) FILTER (f >= {a} AND g <= {z}), 0.0) AS {n}" for n, (a, z) in K.BANDS.items())} FROM ar GROUP BY 1),
every AS (SELECT *, v0 AS activity, sqrt(v1 / v0) AS mobility, sqrt(v2 / v1) / sqrt(v1 / v0) AS complexity FROM t JOIN pe USING (b) JOIN se USING (b) JOIN ba USING (b)),
place AS (SELECT w, c, (w * {len(CHANNELS)} + c) % (SELECT count(*) FROM every) AS b FROM (SELECT unnest(generate_series(0, greatest({HOUR}, (SELECT count(*) FROM every) // {len(CHANNELS)}) - 1)) AS w), (SELECT unnest(generate_series(0, {len(CHANNELS) - 1})) AS c))"""


def _hour_column(name: str) -> str:
    _, measure, channel = name.split("__")
    return f"round(max({measure}) FILTER (c = {int(channel[1:])}), 9)::DOUBLE AS {name}"


#: Zero-phase band-pass of 4 to 12 Hz at 64 Hz with edges of 2 Hz: 107 taps, odd reflection at both ends.
_TAPS = "taps AS (SELECT n, (CASE WHEN n = 0 THEN 26.0 / 64 - 6.0 / 64 ELSE (sin(pi() * n * 26 / 64) - sin(pi() * n * 6 / 64)) / (pi() * n) END) * (0.54 - 0.46 * cos(2 * pi() * (n + 53) / 106)) AS h FROM (SELECT unnest(generate_series(-53, 53)) AS n))"
#: A quarter of the rate: sinc times a Kaiser window (beta 5) of ten periods each side, by the series of its Bessel function.
_BESSEL = "(SELECT sum(power({z} / 2, 2 * m) / power(gamma(m + 1), 2)) FROM generate_series(0, 30) s(m))"
_DECIMATED = f"""kaiser AS (SELECT n, CASE WHEN n = 0 THEN 1.0 ELSE sin(pi() * n / 4) / (pi() * n / 4) END * {_BESSEL.format(z="(5 * sqrt(1 - (n / 40.0) * (n / 40.0)))")} AS h FROM (SELECT unnest(generate_series(-40, 40)) AS n)),
scaled AS (SELECT n, h / sum(h) OVER () AS h FROM kaiser),
kept AS (SELECT vec_id, a.k, sum(h * b.v) AS v FROM (SELECT DISTINCT vec_id, k FROM x WHERE k % 4 = 0) a JOIN x b USING (vec_id) JOIN scaled ON n = a.k - b.k GROUP BY 1, 2),
line AS (SELECT a.vec_id, a.k, a.v AS x, l.v + (coalesce(r.v, l.v) - l.v) * ((a.k % 4) / 4.0) AS y FROM x a JOIN kept l ON a.vec_id = l.vec_id AND l.k = a.k - a.k % 4 LEFT JOIN kept r ON a.vec_id = r.vec_id AND r.k = a.k - a.k % 4 + 4)"""
_KEPT = "SELECT vec_id, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(sqrt(avg((x - y) * (x - y))) / stddev_pop(x), 6) AS normalized_rmse, round(corr(x, y), 6) AS correlation FROM line GROUP BY vec_id"



def fir_sql(name: str, low: float, high: float, half: int) -> str:
    """Taps of a Hamming-windowed band-pass at 256 Hz, from -half to half."""
    return f"{name} AS (SELECT n, (CASE WHEN n = 0 THEN 2 * {high} / 256 - 2 * {low} / 256 ELSE (sin(pi() * n * 2 * {high} / 256) - sin(pi() * n * 2 * {low} / 256)) / (pi() * n) END) * (0.54 - 0.46 * cos(2 * pi() * (n + {half}) / (2.0 * {half}))) AS h FROM (SELECT unnest(generate_series(-{half}, {half})) AS n))"


def through_sql(out: str, x: str, taps: str, half: int, removed: bool) -> str:
    """Signals (c, k, v) through a filter, with odd reflection of up to half a filter at both ends."""
    value = "a.v - sum(t.h * w.v)" if removed else "sum(t.h * w.v)"
    return f"""{out}_e AS (SELECT c, max(k) AS z, arg_min(v, k) AS vl, arg_max(v, k) AS vr, least({half}, max(k)) AS m FROM {x} GROUP BY c),
{out}_w AS (SELECT c, k, v FROM {x} UNION ALL SELECT c, -k, 2 * vl - v FROM {x} JOIN {out}_e USING (c) WHERE k BETWEEN 1 AND m UNION ALL SELECT c, 2 * z - k, 2 * vr - v FROM {x} JOIN {out}_e USING (c) WHERE k BETWEEN z - m AND z - 1),
{out} AS (SELECT a.c, a.k, {value} AS v FROM {x} a JOIN {out}_e USING (c) JOIN {taps} t ON abs(t.n) <= m JOIN {out}_w w ON w.c = a.c AND w.k = a.k + t.n GROUP BY a.c, a.k, a.v)"""


ORACLES = {
    "sliding_measures": f"""WITH x AS (SELECT vec_id % {len(CHANNELS)} AS channel, vec_id // {len(CHANNELS)} * 64 + i - 1 AS k, embedding[i]::DOUBLE AS v FROM embeddings, generate_series(1, 64) t(i)),
n AS (SELECT channel, max(k) // 64 + 1 AS n FROM x GROUP BY 1),
w AS (SELECT channel, "window", k, v FROM x JOIN n USING (channel), unnest(generate_series(greatest(k // 64 - 3, 0), least(k // 64, n - 4))) u("window")),
d AS (SELECT *, v - lag(v) OVER o AS d FROM w WINDOW o AS (PARTITION BY channel, "window" ORDER BY k)),
e AS (SELECT *, d - lag(d) OVER o AS e FROM d WINDOW o AS (PARTITION BY channel, "window" ORDER BY k)),
m AS (SELECT channel, "window", avg(v) AS mean, stddev_pop(v) AS std, sqrt(avg(v * v)) AS rms, max(v) - min(v) AS ptp, sum(abs(d)) AS line_length, var_pop(v) AS v0, var_pop(d) AS v1, var_pop(e) AS v2 FROM e GROUP BY 1, 2)
SELECT channel::INT AS channel, "window", round(mean, 6) AS mean, round(std, 6) AS std, round(rms, 6) AS rms, round(ptp, 6) AS ptp, round(line_length, 6) AS line_length, round(v0, 6) AS activity, round(sqrt(v1 / v0), 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) AS complexity FROM m""",
    "recording_filter": f"""WITH x AS (SELECT vec_id % {len(CHANNELS)} AS c, vec_id // {len(CHANNELS)} * 64 + i - 1 AS k, embedding[i]::DOUBLE AS v FROM embeddings, generate_series(1, 64) t(i)),
{fir_sql("hum", 59.35, 60.65, 423)}, {fir_sql("band", 0.5, 45.0, 423)},
{through_sql("y", "x", "hum", 423, True)}, {through_sql("z", "y", "band", 423, False)}
SELECT x.c::INT AS channel, (x.k // 256)::INT AS second, round(avg(x.v * x.v), 9) AS before, round(avg(z.v * z.v), 9) AS after FROM x JOIN z USING (c, k) GROUP BY 1, 2""",
    "recording_features": f"{_HOUR} SELECT w::INT AS \"window\", " + ", ".join(_hour_column(n) for n in K.feature_names(CHANNELS)) + " FROM place JOIN every USING (b) GROUP BY w",
    "antialiased_preservation": f"WITH {_X}, {_DECIMATED} {_KEPT}",
    "short_filter": f"WITH {_X}, {_TAPS}, ends AS (SELECT vec_id, max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 63) AS z FROM x GROUP BY 1), wide AS (SELECT vec_id, k, v FROM x UNION ALL SELECT vec_id, -k, 2 * a - v FROM x JOIN ends USING (vec_id) WHERE k > 0 UNION ALL SELECT vec_id, 126 - k, 2 * z - v FROM x JOIN ends USING (vec_id) WHERE k < 63) SELECT a.vec_id, a.k::INT AS k, round(sum(h * w.v), 6) AS y FROM x a JOIN taps ON true JOIN wide w ON w.vec_id = a.vec_id AND w.k = a.k + n GROUP BY 1, 2",
    "coloured_noise": f"WITH {_X}, beta AS (SELECT unnest([0, 1, 3]) AS beta), s AS (SELECT a.vec_id, beta, a.k AS m, a.v * power(a.k * 64.0 / 60, -beta / 2.0) AS re, b.v * power(a.k * 64.0 / 60, -beta / 2.0) AS im FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.k = a.k + 31, beta WHERE a.k BETWEEN 1 AND 30), y AS (SELECT vec_id, beta, j, sum(CASE WHEN m = 30 THEN re * cos(pi() * j) ELSE 2 * (re * cos(2 * pi() * m * j / 60) - im * sin(2 * pi() * m * j / 60)) END) AS y FROM s, (SELECT unnest(generate_series(0, 59)) AS j) GROUP BY 1, 2, 3), z AS (SELECT vec_id, beta, j, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS z FROM y WINDOW w AS (PARTITION BY vec_id, beta)) SELECT vec_id, beta::INT AS beta, j::INT AS k, round(z, 6) AS x FROM z WHERE j IN (0, 7, 31)",
    "features_long": f"{_LONG} SELECT vec_id, channel, feature, value FROM long",
    "features_wide": f"{_LONG} SELECT vec_id, " + ", ".join(f"{_wide(n)} AS {n}" for n in _NAMES) + " FROM long GROUP BY vec_id",
    "family_ablation": f"{_LONG} SELECT vec_id, " + ", ".join(f"{_wide(n)} AS {n}" for n in _NAMES if n.startswith(("hjorth__", "entropy__"))) + " FROM long GROUP BY vec_id",
    "relative_block": f"{_LONG} SELECT vec_id, " + ", ".join(_share(n) if n.startswith("freq__") else f"{_wide(n)} AS {n}" for n in _NAMES) + " FROM long GROUP BY vec_id",
    "family_importance": f"{_EACH} SELECT string_split(name, '__')[1] AS family, round(sum(importance), 6)::DOUBLE AS importance, count(*) AS features FROM each GROUP BY 1",
    "top_features": f"{_EACH} SELECT name, round(importance, 6)::DOUBLE AS importance FROM each ORDER BY 2 DESC, 1 LIMIT 20",
    "time_features": f"WITH {_X}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id ORDER BY k) AS dv FROM x) SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(sqrt(avg(v * v)), 6) AS rms, round(max(v) - min(v), 6) AS ptp, round(sum(abs(dv)), 6) AS line_length FROM d GROUP BY vec_id",
    "hjorth_features": f"WITH {_X}, d AS (SELECT *, v - lag(v) OVER w AS d1 FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY k)), e AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY vec_id ORDER BY k) AS d2 FROM d), s AS (SELECT vec_id, var_pop(v) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM e GROUP BY vec_id) SELECT vec_id, round(v0, 6) AS activity, round(sqrt(v1 / v0), 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) AS complexity FROM s",
    "permutation_entropy": f"WITH {_X}, t AS (SELECT vec_id, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY k)), o AS (SELECT vec_id, (b < a)::INT + 2 * (c < a)::INT + 4 * (c < b)::INT AS code FROM t WHERE c IS NOT NULL), n AS (SELECT vec_id, code, count(*) / 62 AS p FROM o GROUP BY vec_id, code) SELECT vec_id, round(-sum(p * log2(p)) / log2(6), 6) AS perm FROM n GROUP BY vec_id",
    "welch_spectrum": f"{_W32} SELECT vec_id, f::DOUBLE AS frequency_hz, round(p, 9)::DOUBLE AS density FROM psd",
    "sql_spectra": f"{_W32} SELECT vec_id, f::DOUBLE AS frequency_hz, round(p, 9)::DOUBLE AS density FROM psd",
    "sql_bands": f"{_W32}, {_areas(K.BANDS, True, 'a')} SELECT vec_id, round(alpha, 9)::DOUBLE AS alpha, round(theta, 9)::DOUBLE AS theta FROM a",
    "band_powers": f"{_W32}, {_areas(K.BANDS, True, 'a')} SELECT vec_id, " + ", ".join(f"round({b}, 9)::DOUBLE AS {b}" for b in K.BANDS) + " FROM a",
    "relative_band_powers": f"{_W32}, {_areas(K.BANDS, True, 'a')} SELECT vec_id, " + ", ".join(f"round({b} / total, 6)::DOUBLE AS {b}" for b in K.BANDS) + " FROM a",
    "relative_band_powers_wide": f"{_W64}, {_areas(K.WIDE_BANDS, False, 'a')} SELECT vec_id, " + ", ".join(f"round({b} / total, 6)::DOUBLE AS {b}" for b in K.BANDS) + " FROM a",
    "spectral_entropy": f"{_W32}, q AS (SELECT vec_id, p / sum(p) OVER (PARTITION BY vec_id) AS r FROM psd) SELECT vec_id, round(-sum(r * log2(r)) / log2(17), 6)::DOUBLE AS spectral FROM q GROUP BY vec_id",
    "spectral_snr": f"{_W64} SELECT vec_id, round(10 * log10(avg(p) FILTER (abs(f - 10) <= 0.2) / avg(p) FILTER (abs(f - 10) > 0.2 AND abs(f - 10) <= 2)), 6)::DOUBLE AS snr_db FROM psd GROUP BY vec_id",
    "spectral_slope": f"{_W64} SELECT vec_id, round(regr_slope(log10(p), log10(f)), 6)::DOUBLE AS slope FROM psd WHERE f >= 1 AND f <= 32 GROUP BY vec_id",
    "psd_validity": f"{_W32} SELECT vec_id, bool_and(p >= 0) AND sum(p) > 0 AS valid, count(*) AS bins FROM psd GROUP BY vec_id",
    "standardised_mean": f"WITH {_X} SELECT vec_id, round((max(v) FILTER (k = 0) - avg(v)) / stddev_pop(v), 6) AS first, 1.0::DOUBLE AS sd FROM x GROUP BY vec_id",
    "feature_changes": f"WITH {_X}, k AS (SELECT x.*, s.n AS stride, lag(v) OVER (PARTITION BY vec_id, s.n ORDER BY k) AS b FROM x, (VALUES (1), (2), (4)) s(n) WHERE k % s.n = 0), m AS (SELECT vec_id, stride, avg(v) AS mean, stddev_pop(v) AS std, sqrt(avg(v * v)) AS rms, max(v) - min(v) AS ptp, sum(abs(v - b)) AS line_length FROM k GROUP BY 1, 2), l AS (" + " UNION ALL ".join(f"SELECT vec_id, stride, '{n}' AS feature, {n} AS value FROM m" for n in K.MEASURES["time"]) + ") SELECT a.stride::INT AS stride, a.feature, round(avg(abs(a.value - c.value)), 6) AS mean_absolute_change, round(avg(abs(c.value)), 6) AS mean_clean_absolute_value FROM l a JOIN l c ON a.vec_id = c.vec_id AND a.feature = c.feature AND c.stride = 1 AND a.stride > 1 GROUP BY 1, 2",
    "stride_preservation": f"{_LINES} SELECT vec_id, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(sqrt(avg((x - y) * (x - y))) / stddev_pop(x), 6) AS normalized_rmse, round(corr(x, y), 6) AS correlation FROM line GROUP BY vec_id",
}

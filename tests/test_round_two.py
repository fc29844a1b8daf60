"""Repeated windows, quantiles, splits, bundles, checkpoints and the commands that use them."""

import json
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewin import cli
from tidewin.functions import kernels as K
from tidewin.operators import evaluation as V
from tidewin.operators import models as M
from tidewin.operators import stats as T
from tidewin.operators import windows as W
from tidewin.sources import recordings as E
from tidewin.sources import sinks
from tidewin.sources.shared import shared_dir


def test_equal_windows_keep_their_number_and_overlap(spark):
    w = spark.createDataFrame([("p", "f", 0.0, 4.0)] * 3 + [("p", "f", 4.0, 8.0)], "patient string, file string, start_sec double, end_sec double")
    i = spark.createDataFrame([("p", "f", 1.0, 5.5)], "patient string, file string, start_sec double, end_sec double")
    for cell in (4.0, 1.5, 100.0):
        got = sorted((r.start_sec, r.overlap_sec, r.label) for r in W.labelled(w, i, cell).collect())
        assert got == [(0.0, 3.0, 1)] * 3 + [(4.0, 1.5, 0)]


def test_coverage_and_disjointness_do_not_depend_on_the_cell(spark):
    rng = np.random.default_rng(4)
    starts = np.sort(rng.integers(0, 900, 60)).tolist()
    i = spark.createDataFrame([("p", "f", float(s), float(s + n)) for s, n in zip(starts, rng.integers(1, 40, 60).tolist(), strict=True)], "patient string, file string, start_sec double, end_sec double")
    w = spark.createDataFrame([("p", "f", 8.0 * k, 8.0 * k + 8, int(k % 3 == 0)) for k in range(120)], "patient string, file string, start_sec double, end_sec double, label int")
    plain = {}
    for r in i.collect():
        hits = [x for x in w.where("label = 1").collect() if x.start_sec < r.end_sec and r.start_sec < x.end_sec]
        plain[r.start_sec, r.end_sec] = (bool(hits), sum(min(x.end_sec, r.end_sec) - max(x.start_sec, r.start_sec) for x in hits), min((x.end_sec for x in hits), default=None))
    for cell in (5.0, 16.0, 2000.0):
        got = W.event_coverage(i, w, cell).collect()
        assert len(got) == 60
        for r in got:
            met, covered, first = plain[r.start_sec, r.end_sec]
            assert (r.represented, r.covered_sec) == (met, covered) and (r.delay_sec is None if first is None else r.delay_sec == first - r.start_sec)
    c = w.select("patient", "file", "start_sec", "end_sec", (F.col("start_sec") - 3).alias("context_start_sec"), (F.col("end_sec") + 3).alias("context_end_sec"))
    targets = spark.createDataFrame([("p", "f", 0.2, 100.0), ("p", "f", 0.7, 110.0)], "patient string, file string, fraction double, target_sec double")
    found = [sorted(map(tuple, W.nearest_disjoint(c, i.limit(20), targets, cell).collect())) for cell in (5.0, 16.0, 2000.0)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 2


def test_a_busy_recording_costs_the_sum_of_its_sides(spark):
    n = 100_000
    row = lambda shift, length: spark.range(n).select(F.lit("p").alias("patient"), F.lit("f").alias("file"), (F.col("id") * 2 + shift).cast("double").alias("start_sec"), (F.col("id") * 2 + shift + length).cast("double").alias("end_sec"))
    over = W.overlap_seconds(row(0, 2), row(1, 0.5), 2.0)
    assert [tuple(r) for r in over.groupBy("overlap_sec").count().collect()] == [(0.5, n)]
    cover = W.event_coverage(row(1, 0.5), row(0, 2).withColumn("label", F.lit(1)), 2.0)
    assert [tuple(r) for r in cover.groupBy("covered_sec", "represented").count().collect()] == [(0.5, True, n)]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, n in ((None, 5), ("a", 1), ("b", 400), ("c", 333)) for v in (rng.integers(0, 50, n) if g == "c" else rng.normal(size=n))] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.low, r.mid, r.top) for r in T.quantiles(df, ["g"], "v", {"low": 0.05, "mid": 0.5, "top": 1.0}).collect()}
    for g in (None, "a", "b", "c"):
        assert got.pop(g) == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], [0.05, 0.5, 1.0]))
    assert not got and T.quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_quantiles_and_ranks_hold_when_approximate_cuts_differ(spark, monkeypatch):
    # Approximate percentiles go by the order in which parts arrive: a second evaluation may find other ones.
    other = F.udf(lambda v: sorted(random.SystemRandom().sample(v, 20)), "array<double>").asNondeterministic()
    monkeypatch.setattr(T.F, "percentile_approx", lambda value, *_: other(F.collect_list(value)))
    rows = [(g, float(v)) for g in "ab" for v in np.random.default_rng(5).permutation(501)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for _ in range(3):
        assert {r.g: (r.m, r.top) for r in T.quantiles(df, ["g"], "v", {"m": 0.5, "top": 0.9}).collect()} == {g: (250.0, 450.0) for g in "ab"}
        assert all(r.place == r.v + 1 for r in T.ranked(df, ["g"], "v", "place").collect())


def test_split_takes_exact_shares(spark):
    rows = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(1000)] + [(2000 + k, None) for k in range(11)], "k long, label int").repartition(6)
    out = V.stratified_split(rows, "label", "k")
    counts = {(r.label, r.part): r["count"] for r in out.groupBy("label", "part").count().collect()}
    assert counts == {(0, "test"): 171, (0, "train"): 686, (1, "test"): 29, (1, "train"): 114, (None, "test"): 2, (None, "train"): 9}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, V.stratified_split(rows.repartition(2), "label", "k").collect()), key=str)


def test_reconstruction_in_batches():
    x = np.random.default_rng(0).normal(size=(3, 50))
    for method in K.METHODS:
        both = K.reconstruct(x, 4, method)
        assert all((both[k] == K.reconstruct(x[k], 4, method)).all() for k in range(3)) and both.shape == x.shape
    assert (K.reconstruct(x, 4)[:, ::4] == x[:, ::4]).all() and (K.reconstruct(x, 4)[:, 48:] == x[:, 48:49]).all()
    assert K.reconstruct(np.arange(9.0), 4) == pytest.approx(np.arange(9.0))
    targets = np.array([4.0, 9.0, 11.0])
    assert K.target_ratios(x, 25.0, targets) == pytest.approx([K.spectral_snr(v, 25.0, t) for v, t in zip(x, targets, strict=True)], nan_ok=True)


def test_many_crossings_are_all_kept_in_order(spark):
    x = np.where(np.arange(2000) % 2, 1.0, -1.0)
    rows = spark.createDataFrame([("a", x.tolist()), ("b", [0.0])], "u string, samples array<double>")
    got = {r.u: r.events for r in W.refractory_crossings(rows, ["u"], 0.5, 3).collect()}
    assert got["a"] == K.transitions(x, 1000.0, 0.5, 0.003).tolist() and len(got["a"]) > 10 * W.GATHERED // 2 and got["b"] == []


def frame(spark, n=90):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, n)
    return spark.createDataFrame([(i, f"p{i % 3}", int(y[i]), *(float(y[i] * (k == 0) + rng.normal() * 0.3) if (i + k) % 9 else None for k in range(4))) for i in range(n)], "k long, patient string, label int, a double, b double, c double, d double")


def test_student_bundle_round_trip(spark, tmp_path):
    f = frame(spark)
    m = M.StudentModel.fit(f.where("patient <> 'p0'"), ["a", "b"], "k", epochs=80)
    m.save(str(tmp_path / "s"), threshold=0.4, train_groups=["p1", "p2"], test_groups=["p0"], feature_columns=["a", "b", "c", "d"])
    b = M.Bundle(spark, str(tmp_path / "s"))
    held = f.where("patient = 'p0'")
    got = b.decide(held, ["k", "patient"]).collect()
    want = {r.k: r.score for r in m.score(held, ["k"]).collect()}
    assert {r.k: r.score for r in got} == want and all(r.prediction == int(r.score >= 0.4) for r in got)
    y = {r.k: r.label for r in held.collect()}
    assert np.mean([(want[k] >= 0.5) == y[k] for k in y]) > 0.85
    assert b.sizes() == {"parameters": 2 * 32 + 32 + 32 * 16 + 16 + 16 + 1, "payload": 4 * (2 * 32 + 32 + 32 * 16 + 16 + 16 + 1)}
    for wrong in (held.drop("d"), held.withColumn("e", F.lit(1.0))):
        with pytest.raises(ValueError):
            b.decide(wrong, ["k", "patient"])
    with pytest.raises(ValueError):
        M.Student.restored(m.net.state(), [3, 32, 16, 1])
    with pytest.raises(ValueError):
        M.StudentModel.fit(f, ["a"], "k", most_rows=10)


def test_four_arms_score_every_row(spark, tmp_path):
    f = frame(spark)
    out = M.four_arms(f, ["a", "b", "c", "d"], "patient", "k", ["k", "patient", "label"], (1, 2), 2, 5, str(tmp_path / "b"), maxIter=2, maxDepth=2).cache()
    assert {(r.model, r.seed): r["count"] for r in out.groupBy("model", "seed").count().collect()} == {(a, s): 90 for a in M.ARMS for s in (1, 2)}
    assert [r.n for r in out.where("model = 'teacher'").groupBy("k").agg(F.countDistinct("score").alias("n")).select("n").distinct().collect()] == [1]
    effects = V.paired_effects(V.measured(out, ["model", "seed", "patient"]), ["seed", "patient"], "model", M.COMPARISONS)
    assert effects.count() == 3 * 2 * 3
    facts = M.read_manifest(spark, str(tmp_path / "b/seed1/p0/random_supervised"))
    assert facts["train_groups"] == ["p1", "p2"] and len(json.loads(facts["transform"])["columns"]) == 2
    again = M.Bundle(spark, str(tmp_path / "b/seed2/p1/selected_kd")).decide(f.where("patient = 'p1'").select("k", "a", "b", "c", "d"), ["k"])
    assert M.parity(again, out.where("model = 'selected_kd' and seed = 2 and patient = 'p1'"), ["k"]).count() == 0


def test_four_arms_fit_one_transform_for_each_fold(spark, monkeypatch):
    f, fits, real = frame(spark), [], M.FeatureTransform.fit
    monkeypatch.setattr(M.FeatureTransform, "fit", staticmethod(lambda train, columns, *a, **k: fits.append(list(columns)) or real(train, columns, *a, **k)))
    M.four_arms(f, ["a", "b", "c", "d"], "patient", "k", ["k", "patient", "label"], (1,), 2, 1, maxIter=1, maxDepth=1, only=["p0"])
    assert fits == [["a", "b", "c", "d"]]
    some, alone = real(f, ["a", "b", "c", "d"], False).some(["d", "b"]), real(f, ["d", "b"])
    assert (some.columns, some.median, some.scale) == (alone.columns, alone.median, True)
    assert some.mean == pytest.approx(alone.mean, rel=1e-12) and some.deviation == pytest.approx(alone.deviation, rel=1e-12)


def test_checkpoints_resume_and_replace(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["p"]
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "p string, identity string")
    work = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "p string, v int")
    assert sinks.unfinished(items, path, keys).count() == 3
    assert sinks.checkpoint(work.where("p <> 'c'"), items.where("p <> 'c'"), path, keys) == 3
    assert [r.p for r in sinks.unfinished(items, path, keys).collect()] == ["c"]
    # Rows without a marker (a run that stopped) are done again and replaced, and so are changed items.
    work.where("p = 'c'").write.mode("append").partitionBy("p").parquet(path)
    changed = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], "p string, identity string")
    assert sorted(r.p for r in sinks.unfinished(changed, path, keys).collect()) == ["a", "c"]
    assert sinks.checkpoint(work.where("p <> 'b'"), changed.where("p <> 'b'"), path, keys) == 3
    assert sinks.unfinished(changed, path, keys).count() == 0
    assert sorted(map(tuple, sinks.checkpointed(spark, path, keys).select("p", "v").collect())) == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]


def test_a_folder_is_claimed_once(spark, tmp_path):
    folder = sinks.claim(spark, str(tmp_path / "r"))
    with pytest.raises(FileExistsError):
        sinks.claim(spark, folder)


def test_headers_of_many_signals(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    many = {f"C{k}": np.zeros(4) + k * 1e-6 for k in range(300)}
    (folder / "r.edf").write_bytes(E.encode(many, 4))
    head = E.edf_headers(E.edf_files(spark, str(tmp_path))).first()
    assert head.channels == list(many) and head.n_samples == 4
    assert E.base_names(["A", "T8-P8-0", "T8-P8-1", "B-2"]) == {"A": 0, "T8-P8": 1, "B-2": 3}


def test_commands_from_recording_to_robustness(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    for p in ("p1", "p2", "p3"):
        (tmp_path / "edf" / p).mkdir(parents=True)
        x = rng.normal(size=(2, 256 * 41)) * 1e-5
        x[:, 256 * 8 : 256 * 24] += 5e-5 * np.sin(2 * np.pi * 6 * np.arange(256 * 16) / 256)
        (tmp_path / "edf" / p / f"{p}.edf").write_bytes(E.encode({"A": x[0], "B": x[1]}, 256))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "all.txt").write_text("".join(f"File Name: {p}.edf\r\nNumber of Seizures in File: 1\r\nSeizure 1 Start Time:  8 seconds\r\nSeizure 1 End Time: 24 seconds\r\n" for p in ("p1", "p2", "p3")))
    f, edf = str(tmp_path / "features"), str(tmp_path / "edf")
    assert cli.main(["prepare", "--recordings", edf, "--summaries", str(tmp_path / "s"), "--output", f]) == 0
    names = [c for c in spark.read.parquet(f).columns if c not in cli.META]
    run = str(tmp_path / "kd")
    # Two folds of small models, as the command's own settings take minutes.
    keyed = cli.table(spark, f).withColumn("_key", F.to_json(F.struct(*W.KEYS)))
    scores = M.four_arms(keyed, names, "patient", "_key", cli.META, (42,), 5, 3, f"{run}/bundles", {"specification": cli.table_specification(spark, f)}, maxIter=2, maxDepth=2)
    sinks.write_table(scores, f"{run}/predictions")
    bundle = f"{run}/bundles/seed42/p1/selected_kd"
    common = ["infer", "--bundle", bundle, "--patient", "p1", "--recording", "p1.edf", "--compare-evaluation", run]
    assert cli.main([*common, "--edf", edf, "--output", str(tmp_path / "o1")]) == 0
    assert cli.main([*common, "--features", f, "--output", str(tmp_path / "o2")]) == 0
    a, b = (spark.read.parquet(str(tmp_path / o / "scores")) for o in ("o1", "o2"))
    assert a.count() == 10 and M.parity(a, b, W.KEYS).count() == 0
    with pytest.raises(Exception, match="trained on"):
        cli.main(["infer", "--bundle", bundle, "--patient", "p2", "--features", f, "--output", str(tmp_path / "o3")])
    at = ["--edf", edf, "--patient", "p1", "--recording", "p1.edf", "--starts", "0", "8", "--output", str(tmp_path)]
    assert cli.main(["analyse", *at, "--channel", "A", "--run-id", "an", "--trials", "2", "--noise-levels", "0", "0.5"]) == 0
    trials = spark.read.parquet(str(tmp_path / "an/trials"))
    assert trials.count() == 2 * 2 * 2 * 2 * 2 and trials.where("noise_intensity = 0 and snr_db_change <> 0").count() == 0
    assert spark.read.parquet(str(tmp_path / "an/optima")).count() == 2 * 2 * 2 * 2
    assert cli.main(["robustness", *at, "--bundle", bundle, "--run-id", "ro", "--trials", "1", "--include-sr"]) == 0
    summary = {r.condition: r for r in spark.read.parquet(str(tmp_path / "ro/summary")).collect()}
    assert set(summary) == set(K.CONDITIONS) and summary["clean"].decision_changes == 0 and summary["clean"].mean_absolute_change == 0
    clean = spark.read.parquet(str(tmp_path / "ro/predictions")).where("condition = 'clean'").drop("condition", "trial")
    assert M.parity(clean, b.where("start_sec in (0, 8)"), W.KEYS).count() == 0
    with pytest.raises(SystemExit):
        cli.main(["evaluate", "--features", f, "--output", run, "--run-id", "x", "--kind", "kd", "--tune"])


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_the_package_works_away_from_its_folder(tmp_path):
    code = "import sys; sys.path.insert(0, sys.argv[1])\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nfrom tidewin.operators import features as X\nprint(X.window_features(s.createDataFrame([(1, [float(i % 5) for i in range(64)])], 'k int, samples array<double>'), ['k'], 'samples', 64.0, 32).first().time__mean)"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and float(done.stdout) > 0, done.stderr[-2000:]

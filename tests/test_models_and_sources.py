import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidewin.functions.identity import changed
from tidewin.operators import features as X
from tidewin.operators import models as M
from tidewin.sources import recordings as E
from tidewin.sources import sinks
from tidewin.functions import kernels as K


def frame(spark, n=120):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, n)
    return spark.createDataFrame([(i, f"p{i % 3}", int(y[i]), float(y[i] + rng.normal() * 0.3), float(rng.normal())) for i in range(n)], "k long, patient string, label int, a double, b double")


def auc(rows):
    pos, neg = [r.score for r in rows if r.label], [r.score for r in rows if not r.label]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


@pytest.mark.parametrize("name, how", [("logistic_regression", {}), ("random_forest", {"numTrees": 5, "maxDepth": 4}), ("boosted_trees", {"maxIter": 5})])
def test_leave_one_out_scores_every_row(spark, name, how):
    rows = M.leave_one_out(frame(spark), ["a", "b"], "patient", name, ["k", "label"], **how).collect()
    assert len({r.k for r in rows}) == len(rows) == 120 and auc(rows) > 0.95


def test_student_learns_and_can_be_distilled(spark):
    f = frame(spark)
    rows = M.student_folds(f, ["a", "b"], "patient", "k", (1,), epochs=60).collect()
    assert len(rows) == 120 and auc(rows) > 0.95
    teacher = f.selectExpr("*", "0.1 + 0.8 * label as teacher")
    assert auc(M.student_folds(teacher, ["a", "b"], "patient", "k", (1,), teacher="teacher", epochs=60).collect()) > 0.95
    assert M.Student(50, 0).parameters() == 2177


def test_student_gradients():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 2, 40)
    a, b = M.Student(3, 5), M.Student(3, 5)
    assert (a.fit(x, y, epochs=3).score(x) == b.fit(x, y, epochs=3).score(x)).all()


def test_bundle_round_trip(spark, tmp_path):
    f = frame(spark)
    c = M.Classifier.fit("logistic_regression", f, ["a", "b"])
    c.save(str(tmp_path / "b"), train_groups=["p0"], test_groups=["p1"])
    again = M.Classifier.load(spark, str(tmp_path / "b"))
    score = lambda m: m.score(f, ["k"]).selectExpr("k", "score", "cast(score >= 0.5 as int) as prediction")
    assert M.parity(score(c), score(again), ["k"]).count() == 0
    assert M.select_top(c.importance(), 1) == ["a"]
    c.save(str(tmp_path / "bad"), train_groups=["p0"], test_groups=["p0"])
    with pytest.raises(ValueError):
        M.Classifier.load(spark, str(tmp_path / "bad"))


def test_model_errors(spark):
    with pytest.raises(ValueError):
        M.class_ratio(frame(spark).where("label = 1"))
    with pytest.raises(ValueError):
        M.estimator("x", 1)
    names = [f"f{k}" for k in range(330)]
    assert M.random_features(names, ["a", "b"], "c") == M.random_features(names, ["b", "a"], "c") != M.random_features(names, ["a"], "c")
    with pytest.raises(ValueError):
        M.random_features(names, ["a"], "a")


def test_features_of_bad_signals_are_null(spark):
    rows = spark.createDataFrame([(1, [float(i % 7) for i in range(64)]), (2, None), (3, [1.0]), (4, [1.0, float("nan")] * 32)], "k int, samples array<double>")
    got = {r.k: r for r in X.window_features(rows, ["k"], "samples", 64.0, 32).collect()}
    assert got[1].time__mean is not None and all(got[k].time__mean is None for k in (2, 3, 4))
    long = X.features_long(X.window_features(rows.where("k = 1").selectExpr("k", "'C' as channel", "samples"), ["k", "channel"], "samples", 64.0, 32), ["k", "channel"])
    assert X.features_wide(long, ["k"], "channel", ["C"]).columns == ["k", *K.feature_names(["C"])]


def test_summary_parser(spark):
    text = "x\nFile Name: a.edf\nNumber of Seizures in File: 1\nSeizure Start Time: 3 seconds\nSeizure End Time: 7 seconds\nFile Name: b.edf\nNumber of Seizures in File: 0\n"
    parse = lambda t: E.parse_summaries(spark.createDataFrame([(t,)], "text string")).collect()
    assert sorted((r.file, r.start_sec, r.end_sec) for r in parse(text)) == [("a.edf", 3, 7), ("b.edf", None, None)]
    for bad in (text.replace("File: 1", "File: 2"), text + text, text.replace("Number of Seizures in File: 0", "")):
        with pytest.raises(PySparkException):
            parse(bad)


def test_edf_round_trip(spark, tmp_path):
    folder = tmp_path / "p1"
    folder.mkdir()
    x = {"A": np.sin(np.arange(2560) / 9) * 1e-4, "B": np.cos(np.arange(2560) / 5) * 3e-5}
    (folder / "r.edf").write_bytes(E.encode(x, 256))
    files = E.edf_files(spark, str(tmp_path))
    head = E.edf_headers(files).first()
    assert (head.patient, head.file, head.sfreq, head.n_samples, head.channels) == ("p1", "r.edf", 256.0, 2560, ["A", "B"])
    got = {r.channel: np.array(r.samples) for r in E.edf_signals(files).collect()}
    assert all(np.abs(got[c] - x[c]).max() < 1e-8 for c in x)
    with pytest.raises(ValueError):
        E.decode_samples(E.encode(x, 256)[:-100])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")
    path = str(tmp_path / "t")
    assert sinks.write_missing(rows.where("k = 1"), path, ["k"]) == 1
    assert sinks.write_missing(rows, path, ["k"]) == 1 and sinks.write_missing(rows, path, ["k"]) == 0
    with pytest.raises(PySparkException):
        sinks.write_table(rows, path)
    assert sinks.markdown(rows.orderBy("k")).splitlines()[2:] == ["| 1 | 0.5000 |", "| 2 |  |"]
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            sinks.run_folder("/x", bad)
    a, b = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, sha256 string"), spark.createDataFrame([("x", "1"), ("z", "2")], "path string, sha256 string")
    assert sorted(r.path for r in changed(a, b).collect()) == ["y", "z"]


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n0.1,x\n1e-300,y\n")
    assert [r.a for r in E.table(spark, str(tmp_path / "t.csv"), "a double, b string", ["a"]).collect()] == [0.1, 1e-300]
    (tmp_path / "m.json").write_text('{"status":\n "complete"}')
    assert E.documents(spark, str(tmp_path / "m.json"), "status string").first().status == "complete"
    (tmp_path / "j.xml").write_text('<testsuites><testsuite tests="69" failures="0" errors="0" skipped="1"></testsuite></testsuites>')
    assert E.test_counts(spark, str(tmp_path / "j.xml")).first().tests == 69

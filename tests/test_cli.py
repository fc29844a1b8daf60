import numpy as np
import pytest

from tidewin import cli
from tidewin.operators import models as M
from tidewin.sources import recordings as E


def test_from_recordings_to_events(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    for p in ("p1", "p2", "p3"):
        (tmp_path / "edf" / p).mkdir(parents=True)
        x = rng.normal(size=(2, 256 * 41)) * 1e-5
        x[:, 256 * 8 : 256 * 24] += 5e-5 * np.sin(2 * np.pi * 6 * np.arange(256 * 16) / 256)
        (tmp_path / "edf" / p / f"{p}.edf").write_bytes(E.encode({"A": x[0], "B": x[1]}, 256))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "all.txt").write_text("".join(f"File Name: {p}.edf\nNumber of Seizures in File: 1\nSeizure Start Time: 8 seconds\nSeizure End Time: 24 seconds\n" for p in ("p1", "p2", "p3")))
    f = str(tmp_path / "features")
    prepare = ["prepare", "--recordings", str(tmp_path / "edf"), "--summaries", str(tmp_path / "s"), "--output", f]
    assert cli.main(prepare) == 0 and cli.main(prepare) == 0
    assert capsys.readouterr().out.split() == ["30", "0"]
    rows = spark.read.parquet(f)
    assert rows.count() == 30 and len(rows.columns) == 5 + 30 and rows.where("label = 1").count() == 12
    assert cli.main(["validate", "--features", f]) == 0
    evaluate = ["evaluate", "--features", f, "--model", "logistic_regression", "--output", str(tmp_path), "--run-id", "r1", "--tune"]
    assert cli.main(evaluate) == 0
    assert spark.read.parquet(str(tmp_path / "r1/pooled")).first().f1 == 1.0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        cli.main(evaluate)
    assert cli.main(["report", "--run", str(tmp_path / "r1")]) == 0
    assert "| logistic_regression |" in capsys.readouterr().out
    names = [c for c in rows.columns if c not in cli.META]
    M.Classifier.fit("logistic_regression", rows, names).save(str(tmp_path / "b"))
    assert cli.main(["infer", "--bundle", str(tmp_path / "b"), "--features", f, "--output", str(tmp_path / "out")]) == 0
    events = spark.read.parquet(str(tmp_path / "out/events")).collect()
    assert sorted((e.patient, e.start_sec, e.end_sec, e.windows, e.sustained) for e in events) == [(p, 8.0, 24.0, 4, True) for p in ("p1", "p2", "p3")]


def test_chosen_folds_models_and_datasets(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    for p in ("p1", "p2", "p3"):
        (tmp_path / "edf" / p).mkdir(parents=True)
        x = rng.normal(size=(1, 256 * 40)) * 1e-5
        x[:, 256 * 8 : 256 * 24] *= 6
        (tmp_path / "edf" / p / f"{p}.edf").write_bytes(E.encode({"A": x[0]}, 256))
    tables = {}
    for name, end in (("one", 24), ("other", 20)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "all.txt").write_text("".join(f"File Name: {p}.edf\nNumber of Seizures in File: 1\nSeizure Start Time: 8 seconds\nSeizure End Time: {end} seconds\n" for p in ("p1", "p2", "p3")))
        tables[name] = str(tmp_path / f"features-{name}")
        assert cli.main(["prepare", "--recordings", str(tmp_path / "edf"), "--summaries", str(tmp_path / name), "--output", tables[name]]) == 0
    estimator = M.estimator
    monkeypatch.setattr(M, "estimator", lambda name, rows, seed=M.SEED, **how: estimator(name, rows, seed, **how, **({"numTrees": 3, "maxDepth": 3} if name == "random_forest" else {})))
    common = ["evaluate", "--features", tables["one"], "--output", str(tmp_path)]
    assert cli.main([*common, "--run-id", "r", "--models", "logistic_regression", "random_forest", "--test-patients", "p3", "p1", "--tune"]) == 0
    found = spark.read.parquet(str(tmp_path / "r/predictions"))
    assert {(r.model, r.patient) for r in found.select("model", "patient").distinct().collect()} == {(m, p) for m in ("logistic_regression", "random_forest") for p in ("p1", "p3")}
    with pytest.raises(ValueError, match="no group"):
        cli.main([*common, "--run-id", "s", "--test-patients", "p9"])
    with pytest.raises(SystemExit):
        cli.main([*common, "--run-id", "t", "--test-patients", "p1", "--tune"])
    rows = cli.table(spark, tables["one"])
    names = [c for c in rows.columns if c not in cli.META]
    assert cli.dataset(spark, tables["one"]) != cli.dataset(spark, tables["other"])
    M.Classifier.fit("logistic_regression", rows, names).save(str(tmp_path / "b"), specification=cli.table_specification(spark, tables["one"]), dataset=cli.dataset(spark, tables["one"]))
    infer = ["infer", "--bundle", str(tmp_path / "b"), "--features"]
    assert cli.main([*infer, tables["one"], "--output", str(tmp_path / "o1")]) == 0
    with pytest.raises(ValueError, match="another dataset"):
        cli.main([*infer, tables["other"], "--output", str(tmp_path / "o2")])


def test_small_commands(capsys):
    assert cli.main(["list"]) == 0 and "window_census" in capsys.readouterr().out
    assert cli.main(["environment"]) == 0 and "pyspark" in capsys.readouterr().out

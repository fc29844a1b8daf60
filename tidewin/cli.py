"""Command line: run a query of the catalogue, build and validate feature tables, evaluate, study and score recordings.

    python -m tidewin list
    python -m tidewin query window_census --data DIR [--output DIR]
    python -m tidewin environment
    python -m tidewin prepare --recordings DIR --summaries DIR --output DIR
    python -m tidewin validate --features DIR
    python -m tidewin evaluate --features DIR --output ROOT --run-id ID --kind ml|kd [--models NAME..] [--test-patients P..] [--tune] [--seeds 42 43] [--epochs 40]
    python -m tidewin report --run DIR
    python -m tidewin infer --bundle DIR --output DIR (--features DIR | --edf DIR) [--patient P] [--recording FILE] [--compare-evaluation RUN]
    python -m tidewin analyse --edf DIR --patient P --recording FILE --starts S.. --channel C --output ROOT --run-id ID
    python -m tidewin robustness --bundle DIR --edf DIR --patient P --recording FILE --starts S.. --output ROOT --run-id ID

A feature table is Parquet by recording; beside it stand markers of whole recordings, by which `prepare` resumes, and
its specification.
"""

from __future__ import annotations

import argparse
import json
import platform
from importlib.metadata import PackageNotFoundError, version

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as K
from .functions.identity import fingerprint
from .operators import chunks, dynamics, evaluation, features, models, relational, stats, windows
from .plans import catalogue
from .sources import recordings, sinks
from .sources.edf import edf

SECONDS, RATE = 4.0, 256.0
META = [*windows.KEYS, "label"]
FILE = ["patient", "file"]
CLEANING = {"low": 1.0, "high": 40.0, "notch": 60.0}


def environment() -> dict:
    def found(name: str) -> str:
        try:
            return version(name)
        except PackageNotFoundError:
            return "missing"

    return {"python": platform.python_version(), "platform": platform.platform(), "packages": {p: found(p) for p in ("pyspark", "numpy", "pandas", "pyarrow")}}


def specification(channels: list[str]) -> dict:
    """All that a feature's value depends on, but for the recording."""
    return {"channels": channels, "sample_rate": RATE, "seconds": SECONDS, "cleaning": CLEANING, "bands": {k: list(v) for k, v in K.BANDS.items()}, "measures": {k: list(v) for k, v in K.MEASURES.items()}}


def _signals(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """Chunks of the named channels, of whole windows each, at the one rate that windows are made for."""
    rows = edf(spark, path, channels=channels, whole_sec=SECONDS)
    wrong = F.raise_error(F.concat(F.lit("another sampling rate in "), F.col("file")))
    return rows.where(F.when(F.col("sfreq") == RATE, F.lit(True)).otherwise(wrong)).drop("sfreq")


def _features(signals: DataFrame, channels: list[str]) -> DataFrame:
    clean = chunks.filtered(signals, [*FILE, "channel"], K.cleaning(RATE, **CLEANING))
    return chunks.chunk_features(clean, FILE, channels, RATE, SECONDS)


def _summaries(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumnRenamed("value", "text")
    return recordings.parse_summaries(texts).where("start_sec is not null")


def prepare(spark: SparkSession, folder: str, summaries: str, output: str) -> int:
    """Feature rows of all recordings that `output` does not hold whole yet; the number of rows added. What is
    finished is known by the recording's bytes, its annotations and the specification, before any signal is decoded.
    Of a finished recording the header and, for its hash, the bytes are read once; of another the records once more."""
    heads = edf(spark, folder, "headers").select(*FILE, "sfreq", "n_samples", "channels").cache()
    names = heads.select(F.concat_ws("/", *FILE).alias("rec"), F.explode("channels").alias("name"))
    channels = sorted(r.channel for r in relational.common_items(relational.dedupe_names(names, ["rec"], "name").select("rec", F.col("final_name").alias("channel")), "rec", "channel").collect())
    spec = fingerprint(specification(channels))
    marks = _summaries(spark, summaries).join(heads.select(*FILE), "file").select(*FILE, F.col("start_sec").cast("double"), F.col("end_sec").cast("double"))
    faults = windows.interval_faults(marks, heads)
    if not faults.isEmpty():
        raise ValueError(f"unusable annotation: {faults.first()}")
    said = marks.groupBy(*FILE).agg(F.to_json(F.sort_array(F.collect_list(F.struct("start_sec", "end_sec")))).alias("said"))
    items = edf(spark, folder, "digests").select(*FILE, F.col("sha256").alias("raw")).join(said, FILE, "left")
    items = items.select(*FILE, F.sha2(F.concat_ws("|", "raw", F.coalesce("said", F.lit("[]")), F.lit(spec)), 256).alias("identity"))
    todo = sinks.unfinished(items, output, FILE)
    todo = spark.createDataFrame(todo.collect(), items.schema)  # names of recordings, fixed for this run
    if todo.isEmpty():
        return 0
    index = windows.labelled(windows.tumbling(heads.join(F.broadcast(todo.select(*FILE)), FILE, "left_semi"), SECONDS, RATE), marks, SECONDS)
    wide = _features(_signals(spark, folder, channels).where(_any_of(todo)).join(F.broadcast(todo.select(*FILE)), FILE, "left_semi"), channels)
    rows = index.select(*META).join(wide.drop("end_sec"), [*FILE, "start_sec"])
    if (before := table_specification(spark, output)) is None:
        sinks.write_json(spark, specification(channels), f"{output}/_specification")
    elif before != specification(channels):
        raise ValueError("the table was made with another specification")
    return sinks.checkpoint(rows, todo, output, FILE)


def _any_of(items: DataFrame) -> Column:
    """The patients and files of the items, as filters that the source takes: others are not opened."""
    names = items.select(*FILE).collect()
    return F.col("patient").isin(sorted({r.patient for r in names})) & F.col("file").isin(sorted({r.file for r in names}))


def table_specification(spark: SparkSession, path: str) -> dict | None:
    """What `prepare` wrote beside a feature table, or None for any other table."""
    try:
        return json.loads(spark.read.text(f"{path}/_specification").first().value)
    except AnalysisException:
        return None


def dataset(spark: SparkSession, path: str) -> str | None:
    """What tells a table's recordings, their bytes and annotations from any other's: the number and a sum of hashes of the
    identities that `prepare` keeps; None for a table without them."""
    marks = sinks._stored(spark, f"{path}/_done")
    if marks is None:
        return None
    last = marks.groupBy(*FILE).agg(F.max(F.struct("at", "identity")).alias("m"))
    row = last.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*FILE, "m.identity").cast("decimal(38,0)")).alias("s")).first()
    return fingerprint({"recordings": row.n, "sum": str(row.s)})


def table(spark: SparkSession, path: str) -> DataFrame:
    """A feature table, in the order of its names."""
    rows = sinks.checkpointed(spark, path, FILE)
    names = K.feature_names(spec["channels"]) if (spec := table_specification(spark, path)) else [c for c in rows.columns if c not in META]
    return rows.select(*META, *names)


def evaluate(spark: SparkSession, o: argparse.Namespace) -> None:
    rows = table(spark, o.features)
    names = [c for c in rows.columns if c not in META]
    folder = sinks.claim(spark, sinks.run_folder(o.output, o.run_id))
    if o.kind == "kd":
        keyed = rows.withColumn("_key", F.to_json(F.struct(*windows.KEYS)))
        spec = table_specification(spark, o.features)
        facts = {"specification": spec, "dataset": dataset(spark, o.features)} if spec else {}
        scores = models.four_arms(keyed, names, "patient", "_key", META, tuple(o.seeds), min(models.TOP, len(names)), o.epochs, f"{folder}/bundles", facts, o.test_patients)
    else:
        scores = None
        for name in dict.fromkeys(o.models or [o.model]):
            own = models.leave_one_out(rows, names, "patient", name, META, o.test_patients)
            scores = own if scores is None else scores.unionByName(own)
        scores = scores.withColumns({"seed": F.lit(models.SEED), "threshold": F.lit(models.THRESHOLD)})
        if o.tune:
            best = evaluation.tuned_thresholds(scores, ["model"], "patient").select("model", F.col("test_group").alias("patient"), "threshold")
            scores = scores.drop("threshold").join(best, ["model", "patient"])
        scores = scores.withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))
    sinks.write_table(scores, f"{folder}/predictions")
    stored = spark.read.parquet(f"{folder}/predictions")
    per = evaluation.measured(stored, ["model", "seed", "patient"])
    sinks.write_table(per, f"{folder}/per_patient")
    sinks.write_table(evaluation.measured(stored, ["model", "seed"]), f"{folder}/pooled")
    if o.kind == "kd":
        sinks.write_table(evaluation.paired_effects(spark.read.parquet(f"{folder}/per_patient"), ["seed", "patient"], "model", models.COMPARISONS), f"{folder}/paired_effects")
    sinks.write_json(spark, {"status": "complete", "kind": o.kind, "models": list(models.ARMS) if o.kind == "kd" else list(dict.fromkeys(o.models or [o.model])), "test_patients": o.test_patients, "tuned": o.tune, "seeds": o.seeds, "environment": environment()}, f"{folder}/manifest")


def report(spark: SparkSession, run: str) -> str:
    """Macro and pooled tables of a complete run, and its effects, as Markdown; an error for a run that did not end."""
    facts = json.loads(spark.read.text(f"{run}/manifest").first().value)
    if facts.get("status") != "complete":
        raise ValueError("the run is not complete")
    tables = [evaluation.macro(spark.read.parquet(f"{run}/per_patient"), ["model"]), spark.read.parquet(f"{run}/pooled")]
    if (effects := sinks._stored(spark, f"{run}/paired_effects")) is not None:
        tables.append(evaluation.macro(effects, ["comparison"]))
    return "\n\n".join(sinks.markdown(t) for t in tables)


def _named(rows: DataFrame, o: argparse.Namespace) -> DataFrame:
    """The rows of the named patient and recording, or of all."""
    rows = rows if o.patient is None else rows.where(F.col("patient") == o.patient)
    return rows if o.recording is None else rows.where(F.col("file") == o.recording)


def _recording(spark: SparkSession, o: argparse.Namespace) -> list[str]:
    """The channels of the one EDF file that the patient and the recording name."""
    found = _named(edf(spark, o.edf, "headers"), o).take(2)
    if len(found) != 1:
        raise ValueError("patient and recording must name one file")
    return found[0].channels


def infer(spark: SparkSession, o: argparse.Namespace) -> int:
    """Scores and events of recordings that the bundle was not trained on, at its threshold; the number of windows.
    Recordings have no labels, and must be read as the bundle's specification says."""
    bundle = models.Bundle(spark, o.bundle)
    taught = bundle.facts.get("train_groups", [])
    spec = bundle.facts.get("specification")
    if o.edf:
        if spec is None or spec != specification(spec["channels"]):
            raise ValueError("features are not computed here as the bundle's were")
        rows = _features(_named(_signals(spark, o.edf, spec["channels"]), o), spec["channels"])
    else:
        if spec is not None and spec != table_specification(spark, o.features):
            raise ValueError("the bundle and the table have different specifications")
        if (taught_on := bundle.facts.get("dataset")) is not None and taught_on != dataset(spark, o.features):
            raise ValueError("the bundle was made from another dataset than the table")
        rows = _named(table(spark, o.features), o)
    held_out = F.when(F.col("patient").isin(taught), F.raise_error(F.concat(F.lit("the bundle was trained on "), F.col("patient")))).otherwise(F.lit(True))
    rows = rows.where(held_out) if taught else rows
    known = [c for c in rows.columns if c not in META]
    scored = bundle.decide(rows.select(*windows.KEYS, *known), windows.KEYS)
    folder = sinks.claim(spark, o.output)
    sinks.write_table(scored, f"{folder}/scores")
    stored = spark.read.parquet(f"{folder}/scores")
    if not (n := stored.count()):
        raise ValueError("no recording with a window is named")
    parity = None
    if o.compare_evaluation:
        wanted = spark.read.parquet(f"{o.compare_evaluation}/predictions").where((F.col("model") == bundle.facts["model_name"]) & (F.col("seed") == bundle.facts["seed"]))
        wanted = wanted.join(stored.select("patient", "file").distinct(), ["patient", "file"], "left_semi")
        if apart := models.parity(stored, wanted, windows.KEYS).count():
            raise ValueError(f"{apart} windows differ from the evaluation")
        parity = True
    sinks.write_table(windows.islands(stored), f"{folder}/events")
    sinks.write_json(spark, {"status": "complete", "bundle": o.bundle, "threshold": bundle.threshold, "windows": n, "source": "edf" if o.edf else "features", "evaluation_parity": parity}, f"{folder}/manifest")
    return n


def _windows_of(spark: SparkSession, o: argparse.Namespace, channels: list[str] | None) -> DataFrame:
    """(patient, file, start_sec, channel, samples): the cleaned recording's windows that begin at the given starts."""
    there, size = _recording(spark, o), windows.window_size(SECONDS, RATE)
    signals = _named(_signals(spark, o.edf, channels or there), o)
    clean = chunks.filtered(signals, [*FILE, "channel"], K.cleaning(RATE, **CLEANING))
    n = signals.agg(F.max("n_samples")).first()[0] or 0
    starts = sorted(set(o.starts))
    for start in starts:
        if not 0 <= round(start * RATE) <= n - size:
            raise ValueError(f"no whole window begins at {start}")
    wanted = F.array(*[F.struct(F.lit(float(s)).alias("start_sec"), F.lit(round(s * RATE)).alias("at")) for s in starts])
    # A window may lie across two chunks: each gives its part.
    parts = clean.select(*FILE, "channel", "first_sample", "samples", F.explode(wanted).alias("w"))
    low, high = F.greatest(F.col("w.at") - F.col("first_sample"), F.lit(0)), F.least(F.col("w.at") + size - F.col("first_sample"), F.size("samples"))
    parts = parts.where(high > low).select(*FILE, "channel", "w.start_sec", "first_sample", F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("samples"))
    whole = parts.groupBy(*FILE, "channel", "start_sec").agg(F.sort_array(F.collect_list(F.struct("first_sample", "samples"))).alias("p"))
    return whole.select(*FILE, "start_sec", "channel", F.flatten(F.transform("p", lambda x: x["samples"])).alias("samples"))


def analyse(spark: SparkSession, o: argparse.Namespace) -> None:
    """Spectra of one channel's windows, oscillator trials on a grid of noise, their summary and the grid's optima."""
    if 0 not in o.noise_levels:
        raise ValueError("a noise level of 0 is needed as the control")
    rows = _windows_of(spark, o, [o.channel])
    folder = sinks.claim(spark, sinks.run_folder(o.output, o.run_id))
    sinks.write_table(features.spectra(rows, [*FILE, "start_sec", "channel"], "samples", RATE), f"{folder}/spectra")
    named = rows.withColumn("name", F.concat_ws("/", *FILE, F.col("start_sec").cast("string"), "channel"))
    trials = dynamics.oscillator_trials(named, [*FILE, "start_sec", "channel"], "samples", "name", RATE, tuple(o.noise_levels), o.trials, tuple(o.substeps), o.seed)
    sinks.write_table(trials, f"{folder}/raw_trials")
    cell = [*FILE, "start_sec", "channel", "model", "drive", "substeps"]
    trials = stats.less_baseline(spark.read.parquet(f"{folder}/raw_trials"), [*cell, "trial"], "noise_intensity", ["snr_db"])
    sinks.write_table(trials, f"{folder}/trials")
    by = [*cell, "noise_intensity"]
    summary = stats.trial_summary(trials, by)
    sinks.write_table(summary, f"{folder}/summary")
    stored = spark.read.parquet(f"{folder}/summary")
    sinks.write_table(stats.grid_optima(stored, cell, "noise_intensity", "coherence_median").unionByName(stats.grid_optima(stored, cell, "noise_intensity", "snr_mean")), f"{folder}/optima")
    sinks.write_json(spark, {"status": "complete", "command": "analyse", "environment": environment()}, f"{folder}/manifest")


def robustness(spark: SparkSession, o: argparse.Namespace) -> None:
    """A frozen bundle's scores of one recording's windows under each perturbation, against the clean ones."""
    bundle = models.Bundle(spark, o.bundle)
    if o.patient in bundle.facts.get("train_groups", []):
        raise ValueError("the patient is one of the bundle's training groups")
    channels = bundle.facts["specification"]["channels"]
    folder = sinks.claim(spark, sinks.run_folder(o.output, o.run_id))
    conditions = K.CONDITIONS if o.include_sr else tuple(c for c in K.CONDITIONS if not c.startswith("sr_"))
    named = _windows_of(spark, o, channels).withColumn("name", F.concat_ws("/", *FILE, F.col("start_sec").cast("string"), "channel"))
    changed = dynamics.perturbed_signals(named, [*FILE, "start_sec", "channel"], "samples", "name", RATE, conditions, o.trials, o.seed, share=o.noise_ratio, factor=o.factor, intensity=o.sr_noise)
    sinks.write_table(changed, f"{folder}/signals")
    changed = spark.read.parquet(f"{folder}/signals")
    keep = [*FILE, "start_sec", "condition", "trial"]
    long = features.features_long(features.window_features(changed, [*keep, "channel"], "samples", RATE), [*keep, "channel"])
    wide = features.features_wide(long, keep, "channel", channels).withColumn("end_sec", F.col("start_sec") + SECONDS)
    sinks.write_table(bundle.decide(wide, [*windows.KEYS, "condition", "trial"]), f"{folder}/predictions")
    scores = spark.read.parquet(f"{folder}/predictions")
    clean = scores.where("condition = 'clean'").select(*windows.KEYS, F.col("score").alias("clean_score"), F.col("prediction").alias("clean_prediction"))
    sinks.write_table(evaluation.robustness(scores.join(clean, windows.KEYS).withColumn("label", F.lit(None).cast("int")), ["condition", "trial"]), f"{folder}/summary")
    flat = long.withColumn("feature", F.concat_ws("__", "feature", "channel"))
    base = flat.where("condition = 'clean'").select(*FILE, "start_sec", "feature", "value")
    sinks.write_table(evaluation.feature_changes(flat.drop("channel"), base, [*FILE, "start_sec"], ["condition", "trial"]), f"{folder}/feature_changes")
    sinks.write_json(spark, {"status": "complete", "command": "robustness", "conditions": list(conditions), "environment": environment()}, f"{folder}/manifest")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidewin", description=__doc__.splitlines()[0])
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    sub.add_parser("environment")
    needed = {"query": ["data"], "prepare": ["recordings", "summaries", "output"], "validate": ["features"], "evaluate": ["features", "output", "run-id"], "report": ["run"], "infer": ["bundle", "output"], "analyse": ["edf", "patient", "recording", "output", "run-id"], "robustness": ["bundle", "edf", "patient", "recording", "output", "run-id"]}
    p = {name: sub.add_parser(name) for name in needed}
    for name, arguments in needed.items():
        for a in arguments:
            p[name].add_argument(f"--{a}", required=True)
    p["query"].add_argument("name", choices=sorted(catalogue.QUERIES))
    p["query"].add_argument("--output")
    p["evaluate"].add_argument("--kind", choices=["ml", "kd"], default="ml")
    p["evaluate"].add_argument("--model", choices=["logistic_regression", "random_forest", "boosted_trees"], default="logistic_regression")
    p["evaluate"].add_argument("--models", choices=["logistic_regression", "random_forest", "boosted_trees"], nargs="+", help="several in one run")
    p["evaluate"].add_argument("--test-patients", nargs="+", help="the folds to run; all patients teach")
    p["evaluate"].add_argument("--tune", action="store_true")
    p["evaluate"].add_argument("--seeds", type=int, nargs="+", default=[models.SEED])
    p["evaluate"].add_argument("--epochs", type=int, default=40)
    either = p["infer"].add_mutually_exclusive_group(required=True)
    either.add_argument("--features")
    either.add_argument("--edf")
    for a in ("--patient", "--recording", "--compare-evaluation"):
        p["infer"].add_argument(a)
    for name in ("analyse", "robustness"):
        p[name].add_argument("--starts", type=float, nargs="+", required=True)
        p[name].add_argument("--trials", type=int, choices=range(1, 21), default=3)
        p[name].add_argument("--seed", type=int, default=42)
    p["analyse"].add_argument("--channel", required=True)
    p["analyse"].add_argument("--noise-levels", type=float, nargs="+", default=[0.0, 0.1, 0.5, 2.0])
    p["analyse"].add_argument("--substeps", type=int, nargs="+", choices=[1, 2, 4], default=[1])
    p["robustness"].add_argument("--noise-ratio", type=float, default=0.3)
    p["robustness"].add_argument("--factor", type=int, default=4)
    p["robustness"].add_argument("--include-sr", action="store_true")
    p["robustness"].add_argument("--sr-noise", type=float, default=0.5)
    return out


def main(argv: list[str] | None = None) -> int:
    arguments = parser()
    o = arguments.parse_args(argv)
    if o.command == "evaluate" and o.kind == "kd" and o.tune:
        arguments.error("the four arms are compared at one fixed threshold; --tune is for --kind ml")
    if o.command == "evaluate" and (len(set(o.seeds)) < len(o.seeds) or o.epochs < 1):
        arguments.error("seeds must differ and epochs be positive")
    if o.command == "evaluate" and o.tune and o.test_patients and len(set(o.test_patients)) < 2:
        arguments.error("a threshold is tuned on the scores of other patients: name two or more")
    if o.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if o.command == "environment":
        print(json.dumps(environment(), indent=2, sort_keys=True))
        return 0
    spark = SparkSession.builder.appName(f"tidewin-{o.command}").getOrCreate()
    if o.command == "query":
        df = catalogue.QUERIES[o.name](spark, o.data)
        sinks.write_table(df, o.output) if o.output else df.show(50, truncate=False)
    elif o.command == "prepare":
        print(prepare(spark, o.recordings, o.summaries, o.output))
    elif o.command == "validate":
        rows = table(spark, o.features)
        relational.require_unique(rows, windows.KEYS).groupBy("patient").agg(F.count(F.lit(1)).alias("windows"), F.sum("label").alias("positive")).show()
        names = [c for c in rows.columns if c not in META]
        relational.column_report(rows, names).where("missing + nans + infinite > 0 or constant").show(len(names), truncate=False)
    elif o.command == "evaluate":
        evaluate(spark, o)
    elif o.command == "report":
        print(report(spark, o.run))
    elif o.command == "infer":
        print(infer(spark, o))
    else:
        (analyse if o.command == "analyse" else robustness)(spark, o)
    return 0

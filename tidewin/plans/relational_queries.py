"""Queries on checks, sets, joins, grids, pivots, transforms, models, dynamics, sources and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import kernels as K
from ..functions.columns import feature_part, first_reason, missing_mask
from ..operators import chunks as H
from ..operators import dynamics as Y
from ..operators import evaluation as V
from ..operators import features, measures
from ..operators import models as M
from ..operators import relational as R
from ..operators.features import per_row
from ..operators.transforms import FeatureTransform
from ..sources import edf
from ..sources import recordings as E
from ..sources import sinks
from ..sources.shared import bounded_batches, shared_dir
from ..streaming import windows as SW
from . import base as B
from .evaluation_queries import rounded
from .feature_queries import fir_sql, through_sql

S, D = SparkSession, DataFrame

# -- checks and sets -------------------------------------------------------------------------------------------


def repeated_keys(spark: S, sf: str) -> D:
    return R.duplicate_keys(B.read(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


def column_report(spark: S, sf: str) -> D:
    d = B.read(spark, sf, "lineitem").select("l_quantity", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("tax"), F.lit(2.0).alias("same"), F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("odd"))
    return R.column_report(d, d.columns)


def table_differences(spark: S, sf: str) -> D:
    c = B.read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return R.differences(c, c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 50 == 0, F.lit(99)).otherwise(F.col("c_nationkey"))))


def leaked_groups(spark: S, sf: str) -> D:
    o = B.read(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("group"), F.when(F.col("o_orderkey") % 97 == 0, "test").otherwise("train").alias("part"))
    return R.shared(["group"], o)


def mask_faults(spark: S, sf: str) -> D:
    e = B.read(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("x"), (F.col("event_id") % 3 == 0).cast("int").alias("m"))
    return R.mask_faults(e, "x", "m")


def common_channels(spark: S, sf: str) -> D:
    o = B.read(spark, sf, "orders")
    return R.common_items(o.select((F.col("o_custkey") % 7).alias("c"), F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("channel")), "c", "channel")


def jaccard_pairs(spark: S, sf: str) -> D:
    l = B.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).alias("fold"), (F.col("l_orderkey") % 9973).alias("feature"))
    return rounded(R.jaccard_pairs(l, "fold", "feature"))


def dedupe_names(spark: S, sf: str) -> D:
    p = B.read(spark, sf, "part").select((F.col("p_size") % 5).alias("file"), F.concat_ws("-", F.concat(F.lit("T"), (F.col("p_partkey") % 40).cast("string")), F.when(F.col("p_partkey") % 3 == 0, F.lit("X1")).otherwise((F.col("p_partkey") % 4).cast("string"))).alias("name")).distinct()
    return R.dedupe_names(p, ["file"], "name")


def set_difference(spark: S, sf: str) -> D:
    """Customers without an order of the first priority, and whether that is a subset of all customers."""
    c, o = B.read(spark, sf, "customer"), B.read(spark, sf, "orders").where("o_orderpriority like '1%'")
    left = c.select(F.col("c_custkey").alias("k")).subtract(o.select(F.col("o_custkey").alias("k")))
    return left.withColumn("subset", F.lit(R.is_subset(left, c.select(F.col("c_custkey").alias("k")), ["k"])))


def unions(spark: S, sf: str) -> D:
    """Tables of one layout put together by name, with what each adds."""
    s, c = B.read(spark, sf, "supplier"), B.read(spark, sf, "customer")
    a = s.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    b = c.select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(b).groupBy("nation", "kind").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("balance"), 4).alias("balance"))


def distinct_rows(spark: S, sf: str) -> D:
    return B.read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


def parameter_grid(spark: S, sf: str) -> D:
    g = R.grid(spark, model=["bistable", "fitzhugh"], level=[0.0, 0.25, 0.5], trial=[0, 1, 2, 3])
    return g.join(B.read(spark, sf, "region").select("r_regionkey")).groupBy("model", "level").agg(F.count(F.lit(1)).alias("cells"))


# -- joins -----------------------------------------------------------------------------------------------------


def pending_work(spark: S, sf: str) -> D:
    o, l = B.read(spark, sf, "orders"), B.read(spark, sf, "lineitem").where("l_quantity > 45")
    return R.pending(o.select(F.col("o_orderkey").alias("k"), "o_orderstatus"), l.select(F.col("l_orderkey").alias("k")), ["k"])


def checked_join(spark: S, sf: str) -> D:
    o, c = B.read(spark, sf, "orders"), B.read(spark, sf, "customer")
    j = R.joined(o.select(F.col("o_custkey").alias("k"), "o_totalprice"), c.select(F.col("c_custkey").alias("k"), "c_mktsegment"), ["k"], "many_to_one")
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def lookup_join(spark: S, sf: str) -> D:
    n, r, c = (B.read(spark, sf, t) for t in ("nation", "region", "customer"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"))


def arm_join(spark: S, sf: str) -> D:
    """Two arms of a table side by side, by key, with suffixes."""
    l = B.read(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    a, b = (l.where(F.col("l_returnflag") == f).select("l_suppkey", F.col("q").alias(f"q_{f}")) for f in ("A", "R"))
    return a.join(b, "l_suppkey").withColumn("difference", F.col("q_A") - F.col("q_R"))


# -- pivots, ranks, names --------------------------------------------------------------------------------------


def pivot_seeds(spark: S, sf: str) -> D:
    p = B.predictions(spark, sf).where("model = 'alpha'")
    return R.pivoted(p, ["doc_id"], "seed", list(B.SEEDS), F.first("score")).select("doc_id", *[F.col(str(s)).alias(f"seed_{s}") for s in B.SEEDS])


def pivot_models(spark: S, sf: str) -> D:
    p = B.predictions(spark, sf)
    return rounded(R.pivoted(p, ["patient"], "model", list(B.MODELS), F.avg("score")))


def pivot_totals(spark: S, sf: str) -> D:
    """Each user's events in all, and of the type that is most frequent with the user."""
    e = B.read(spark, sf, "events").withColumn("one", F.lit(1).cast("long"))
    kinds = sorted(r[0] for r in e.where("event_type is not null").select("event_type").distinct().collect())  # the pivot's columns
    wide = R.pivot_by_total(e, "user_id", "event_type", kinds, "one")
    return wide.select("user_id", "total", F.array_max(F.array(*[F.col(f"`{k}`") for k in kinds])).alias("most"))


def top_per_group(spark: S, sf: str) -> D:
    l = B.read(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return R.top_by_group(l.withColumn("part", F.lpad(F.col("l_partkey").cast("string"), 9, "0")), ["l_suppkey"], 3, "q", "part").drop("part")


def best_row(spark: S, sf: str) -> D:
    return R.top(B.read(spark, sf, "part").select("p_partkey", "p_retailprice"), 1, "p_retailprice", "p_partkey")


def name_parts(spark: S, sf: str) -> D:
    p = B.read(spark, sf, "part").select("p_partkey", F.concat_ws("__", F.lower(F.substring("p_type", 1, 4)), "p_brand", F.when(F.col("p_size") > 10, F.col("p_size").cast("string"))).alias("feature"))
    return p.select("p_partkey", *[feature_part("feature", x).alias(x) for x in ("family", "measure", "channel")])


def occurrence(spark: S, sf: str) -> D:
    """In how many of the suppliers' top three parts each part stands."""
    return top_per_group(spark, sf).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("folds"))


def reasons(spark: S, sf: str) -> D:
    """The first rule that holds names the reason; the clipping rule comes first."""
    e = B.read(spark, sf, "events")
    r = first_reason((F.col("value") > 450, "clipped_dynamics"), (F.col("value") < 20, "undefined_spectral_ratio"), (F.col("event_type") == "error", "insufficient_intervals"))
    x = F.when(r == "ok", F.col("value"))
    return e.groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("rows"), F.sum(missing_mask(x)).alias("missing"))


def content_hashes(spark: S, sf: str) -> D:
    return B.read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def identity_seeds(spark: S, sf: str) -> D:
    """Seeds named by the JSON of [42, name], as decimal text."""
    c = B.read(spark, sf, "customer")
    return c.select("c_custkey", I.seed_column(F.concat(F.lit("[42, "), F.to_json(F.array("c_name")).substr(F.lit(2), F.length(F.to_json(F.array("c_name"))) - 2), F.lit("]"))).alias("seed"))


# -- transforms and models -------------------------------------------------------------------------------------


DIMENSIONS = 64


def _frame(spark: S, sf: str) -> D:
    """The embeddings' 64 columns, with gaps; a label and five patients."""
    e = B.read(spark, sf, "embeddings")
    x = [F.when((F.col("vec_id") + 3 * k) % 17 != 0, F.col("embedding")[k].cast("double")).alias(f"f{k}") for k in range(DIMENSIONS)]
    patient = F.concat(F.lit("p"), (F.col("vec_id") % 5).cast("string"))
    return e.select("vec_id", patient.alias("patient"), (F.col("label") % 2).cast("int").alias("label"), *x)


COLUMNS = [f"f{k}" for k in range(DIMENSIONS)]


def median_impute_scale(spark: S, sf: str) -> D:
    """Patient p0 transformed with what the other patients fix."""
    f = _frame(spark, sf)
    t = FeatureTransform.fit(f.where("patient <> 'p0'"), COLUMNS)
    return rounded(t.transform(f.where("patient = 'p0'").select("vec_id", *COLUMNS), ["vec_id"]))


def lr_lopo(spark: S, sf: str) -> D:
    return rounded(M.leave_one_out(_frame(spark, sf), COLUMNS, "patient", "logistic_regression", ["vec_id", "patient", "label"]), 4)


def forest_lopo(spark: S, sf: str) -> D:
    return rounded(M.leave_one_out(_frame(spark, sf), COLUMNS, "patient", "random_forest", ["vec_id", "patient", "label"], numTrees=20, maxDepth=5), 4)


def boosted_teacher(spark: S, sf: str) -> D:
    """Importance of each column to boosted trees, best first."""
    c = M.Classifier.fit("boosted_trees", _frame(spark, sf), COLUMNS, maxIter=10)
    return rounded(spark.createDataFrame(c.importance(), "feature string, importance double"))


def student_scores(spark: S, sf: str) -> D:
    return rounded(M.student_folds(_frame(spark, sf), COLUMNS, "patient", "vec_id", (42, 43)), 4)


def distilled_student(spark: S, sf: str) -> D:
    f = _frame(spark, sf).withColumn("teacher", 0.15 + 0.7 * F.col("label"))
    return rounded(M.student_folds(f, COLUMNS, "patient", "vec_id", (42,), teacher="teacher"), 4)


def teacher_students(spark: S, sf: str) -> D:
    """Supervised and distilled students on the fifty columns that each fold's teacher names."""
    return rounded(M.distil(_frame(spark, sf), COLUMNS, "patient", "vec_id", maxIter=5, maxDepth=3), 4)


def four_arms(spark: S, sf: str) -> D:
    """The teacher, students on its columns with and without its targets, and one on random columns, by effect: three
    patients' folds."""
    frame = _frame(spark, sf).withColumn("patient", F.concat(F.lit("p"), (F.col("vec_id") % 3).cast("string")))
    scores = M.four_arms(frame, COLUMNS, "patient", "vec_id", ["vec_id", "patient", "label"], maxIter=5, maxDepth=3)
    folder = f"{shared_dir(spark)}/arms-{uuid.uuid4().hex}"
    sinks.write_table(scores, folder)  # scored once, measured often
    scores = spark.read.parquet(folder)
    return rounded(V.paired_effects(V.measured(scores, ["model", "seed", "patient"]), ["seed", "patient"], "model", M.COMPARISONS), 4)


def _bundle(spark: S, sf: str, kind: str) -> tuple[M.Bundle, D]:
    """A saved and reloaded bundle of each kind, taught by four patients, and the fifth's rows."""
    f = _frame(spark, sf)
    train, folder = f.where("patient <> 'p0'"), f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    facts = {"train_groups": ["p1", "p2", "p3", "p4"], "test_groups": ["p0"], "feature_columns": COLUMNS}
    model = M.StudentModel.fit(train, COLUMNS, "vec_id") if kind == "student" else M.Classifier.fit(kind, train, COLUMNS)
    model.save(folder, 0.45, **facts)
    return M.Bundle(spark, folder), f.where("patient = 'p0'")


def bundle_decisions(spark: S, sf: str) -> D:
    """Scores and decisions of a held-out patient's rows by reloaded bundles of a regression and of a student."""
    out = None
    for kind in ("logistic_regression", "student"):
        bundle, rows = _bundle(spark, sf, kind)
        part = bundle.decide(rows.drop("patient"), ["vec_id"]).withColumn("model", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


def column_importance(spark: S, sf: str) -> D:
    """Each column's |coefficient|, and what the reloaded bundle says of its size."""
    bundle, _ = _bundle(spark, sf, "logistic_regression")
    sizes = bundle.sizes()
    return rounded(spark.createDataFrame(bundle.model.importance(), "feature string, importance double"), 4).withColumn("parameters", F.lit(sizes["parameters"]))


def parity_faults(spark: S, sf: str) -> D:
    """Documents whose score or decision differs between two models beyond the tolerance."""
    p = B.predictions(spark, sf).where("seed = 42")
    return M.parity(p.where("model = 'alpha'"), p.where("model = 'beta'"), ["doc_id"], rtol=0.05, atol=1e-3)


def frozen_robustness(spark: S, sf: str) -> D:
    """A classifier of clean windows, frozen, on the other windows under each perturbation: changed decisions and scores."""
    e = B.read(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).cast("int").alias("label"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("samples"))
    names = [f"{family}__{m}" for family, ms in K.MEASURES.items() for m in ms]
    clean = features.window_features(e.where("vec_id % 2 = 0"), ["vec_id", "label"], "samples", 64.0, 32)
    model = M.Classifier.fit("logistic_regression", clean, names)
    changed = Y.perturbed_signals(e.where("vec_id % 2 = 1"), ["vec_id", "label"], "samples", "name", 64.0, tuple(c for c in K.CONDITIONS if not c.startswith("sr_")))
    keep = ["vec_id", "label", "condition"]
    scored = model.score(features.window_features(changed, keep, "samples", 64.0, 32), keep).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    base = scored.where("condition = 'clean'").select("vec_id", F.col("score").alias("clean_score"), F.col("prediction").alias("clean_prediction"))
    return rounded(V.robustness(scored.join(base, "vec_id"), ["condition"]), 4)


def hyperparameter_search(spark: S, sf: str) -> D:
    return rounded(M.random_search(_frame(spark, sf), COLUMNS, "patient", "random_forest", {"numTrees": [5, 10], "maxDepth": [2, 4, 6]}, 2), 4)


def stratified_split(spark: S, sf: str) -> D:
    """The part of each labelled document in a random split that takes a fifth of each label."""
    from ..operators.evaluation import stratified_split as split

    rows = B.read(spark, sf, "documents").select("doc_id").join(B.read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return split(rows, "label", "doc_id")


def recorded_contexts(spark: S, sf: str) -> D:
    """Measurements of contexts by key, one of them unusable."""
    c = _contexts(spark, sf).select(*UNIT, F.when(F.col("unit") % 2 == 0, "recording_end").otherwise("ok").alias("context_reason"), "samples")
    return rounded(Y.record_measurements(c, UNIT), 4)


def lopo_parts(spark: S, sf: str) -> D:
    """Rows and positives of train and test for a held-out patient."""
    f = _frame(spark, sf).withColumn("part", F.when(F.col("patient") == "p3", "test").otherwise("train"))
    return f.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positive"))


# -- dynamics --------------------------------------------------------------------------------------------------


#: Order keys are dealt in blocks of this many, so that items are numbered block by block and not supplier by supplier.
_BLOCK = 1 << 16


def _contexts(spark: S, sf: str) -> D:
    """Contexts of 2,560 samples: each supplier's line items in order, cut into as many parts as they fill, each a wave
    and its items' quantities, over and over where a part has fewer items.

    Items are numbered in two levels, by block of orders and inside the block, and a part holds at most 2,560 of them,
    so a supplier with any share of the items is gathered nowhere. A context takes 20 KB, so batches are bounded by bytes.
    """
    bounded_batches(spark)
    l = B.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), F.floor(F.col("l_orderkey") / _BLOCK).alias("block"), "l_orderkey", "l_linenumber", "l_quantity")
    earlier = Window.partitionBy("unit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = l.groupBy("unit", "block").agg(F.count(F.lit(1)).alias("n")).select("unit", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("unit", "block").orderBy("l_orderkey", "l_linenumber", "l_quantity")) - 1
    placed = l.withColumn("nth", nth).join(before, ["unit", "block"]).withColumn("at", F.col("before") + F.col("nth"))
    # An explicit number of partitions stays as it is: the studies are long, and the table of contexts is small.
    parts = placed.select("unit", F.floor(F.col("at") / K.CONTEXT).cast("int").alias("part"), "at", "l_quantity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit", "part")
    items = F.transform(F.sort_array(F.collect_list(F.struct("at", "l_quantity"))), lambda x: x["l_quantity"])
    a = parts.groupBy("unit", "part").agg(items.alias("q"))  # taken out here, once for each context
    wave = F.transform(F.sequence(F.lit(0), F.lit(K.CONTEXT - 1)), lambda i: F.element_at("q", (i % F.size("q") + 1).cast("int")) * 1e-6 + F.sin(i * 0.24) * 2e-5)
    return a.select("unit", "part", F.concat_ws("/", "unit", "part").alias("name"), wave.alias("samples"))


UNIT = ["unit", "part"]


def oscillator_trials(spark: S, sf: str) -> D:
    return rounded(Y.oscillator_trials(_contexts(spark, sf), UNIT, "samples", "name", 256.0, (0.0, 0.25, 0.5), 2).select(*UNIT, "model", "drive", "noise_intensity", "trial", "events", "intervals", "valid", "reason", "cv", "snr_db"), 4)


def context_measurements(spark: S, sf: str) -> D:
    return rounded(Y.context_measurements(_contexts(spark, sf), UNIT, "samples"), 4)


def replicated_means(spark: S, sf: str) -> D:
    return rounded(Y.replicated_means(_contexts(spark, sf), UNIT, "samples", tuple(range(42, 52))), 4)


def undriven_controls(spark: S, sf: str) -> D:
    m = Y.context_measurements(_contexts(spark, sf), UNIT, "samples").select(*UNIT, "frequency")
    return rounded(Y.controls(m, UNIT, "frequency", (42, 43)), 4)


def dose_trials(spark: S, sf: str) -> D:
    return rounded(Y.dose_trials(_contexts(spark, sf), UNIT, "samples", (0.0, 0.35), (0.25, 0.5), (52, 53)), 4)


def perturbations(spark: S, sf: str) -> D:
    return rounded(Y.perturbation(_contexts(spark, sf), UNIT, "samples", "name", 256.0), 4)


def filtered_recordings(spark: S, sf: str) -> D:
    """Deviation of a whole recording's channel before and after the notch and the band-pass, filtered in chunks of 1,024
    samples."""
    c = _contexts(spark, sf)
    chunks = H.rechunked(c.select(*UNIT, F.lit(0).cast("long").alias("first_sample"), "samples"), UNIT, 1024)
    clean = H.filtered(chunks, UNIT, K.cleaning(256.0)).select(*UNIT, F.explode("samples").alias("y"))
    after = clean.groupBy(*UNIT).agg(F.stddev_pop("y").alias("after"))
    return rounded(c.select(*UNIT, F.sqrt(measures.variance(F.col("samples"))).alias("before")).join(after, UNIT), 9)


# -- sources and streams ---------------------------------------------------------------------------------------

def _summaries(spark: S, sf: str) -> D:
    """Summary texts of the patients' recordings, an entry for each: its name, the number of its intervals, and their
    starts and ends, numbered where there are several."""
    i = B.intervals(spark, sf).withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("patient", "file")), "k": F.row_number().over(Window.partitionBy("patient", "file").orderBy("start_sec"))})
    number = F.when(F.col("n") > 1, F.format_string("Seizure %d", F.col("k"))).otherwise(F.lit("Seizure"))
    line = lambda which, at: F.concat(number, F.lit(f" {which} Time: "), F.col(at).cast("int").cast("string"), F.lit(" seconds\n"))
    said = i.groupBy("patient", "file").agg(F.sort_array(F.collect_list(F.struct("k", F.concat(line("Start", "start_sec"), line("End", "end_sec")).alias("t")))).alias("l"))
    entry = B.recordings(spark, sf).join(said, ["patient", "file"], "left").select("patient", "file", F.coalesce(F.size("l"), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), ""), F.lit("")).alias("t"))
    text = F.concat(F.lit("Data Sampling Rate: 1 Hz\n\nFile Name: "), F.col("file").cast("string"), F.lit(".edf\nNumber of Seizures in File: "), F.col("n").cast("string"), F.lit("\n"), F.col("t"))
    return entry.select("patient", "file", text.alias("text"))


def annotation_parse(spark: S, sf: str) -> D:
    """Every recording's annotations, written as summary texts into files and parsed again."""
    folder = f"{shared_dir(spark)}/summaries-{uuid.uuid4().hex}"
    _summaries(spark, sf).select("text").write.text(folder)
    return E.parse_summaries(spark.read.text(folder, wholetext=True).withColumnRenamed("value", "text"))


def manifest_documents(spark: S, sf: str) -> D:
    """Customers' orders as JSON documents over several lines, a hundred customers in each, and read again."""
    folder = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    o = B.read(spark, sf, "orders").select("o_custkey", F.struct("o_orderkey", "o_totalprice", "o_orderstatus").alias("o"), F.floor(F.col("o_custkey") / 100).alias("part"))
    each = o.groupBy("part", "o_custkey").agg(F.sort_array(F.collect_list("o")).alias("orders"))
    docs = each.groupBy("part").agg(F.to_json(F.sort_array(F.collect_list(F.struct("o_custkey", "orders"))), {"pretty": "true"}).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    found = E.documents(spark, folder, "o_custkey long, orders array<struct<o_orderkey: long, o_totalprice: double, o_orderstatus: string>>")
    return found.select("o_custkey", F.explode("orders").alias("o")).select("o_custkey", "o.*")


def junit_counts(spark: S, sf: str) -> D:
    """Line items as suites of JUnit reports, a suite for each order and a report for two thousand, and the reports' sums."""
    folder = f"{shared_dir(spark)}/xml-{uuid.uuid4().hex}"
    count = lambda c: F.count_if(c).cast("string")
    suites = B.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("string").alias("t"), count(F.col("l_returnflag") == "R").alias("f"), count(F.col("l_returnflag") == "A").alias("e"), count(F.col("l_linestatus") == "O").alias("s"))
    line = F.format_string('<testsuite name="%d" tests="%s" failures="%s" errors="%s" skipped="%s"><testcase/></testsuite>', "l_orderkey", "t", "f", "e", "s")
    report = suites.groupBy(F.floor(F.col("l_orderkey") / 2000)).agg(F.concat(F.lit("<testsuites>"), F.array_join(F.collect_list(line), "\n"), F.lit("</testsuites>")).alias("value"))
    report.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return E.test_counts(spark, folder)


def copy_filter(spark: S, sf: str) -> D:
    """Documents with a label of 1, as they are."""
    rows = B.read(spark, sf, "documents").select("doc_id", "n_chars").join(B.read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return sinks.unpaired(rows)


def json_manifest(spark: S, sf: str) -> D:
    """A manifest of the orders' columns, written as one JSON document and read again."""
    folder = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    o = B.read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))
    sinks.write_json(spark, {r.o_orderpriority: {"n": r.n, "least": r.least, "most": r.most} for r in o.collect()}, folder)
    found = spark.read.text(folder).select(F.explode(F.from_json("value", "map<string, struct<n: long, least: long, most: long>>")).alias("priority", "v"))
    return found.select("priority", "v.*")


def csv_round_trip(spark: S, sf: str) -> D:
    """A table written as CSV and read by a stated schema, in full precision."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    B.read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").write.option("header", True).csv(folder)
    return E.table(spark, folder, "c_custkey long, c_acctbal double, c_mktsegment string", ["c_custkey", "c_acctbal", "c_mktsegment"])


def json_round_trip(spark: S, sf: str) -> D:
    """Documents of several lines, as manifests are: one for each region, with its nations."""
    folder = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    n = B.read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("nations"))
    n.select(F.to_json(F.struct("region", "nations"), {"pretty": "true"}).alias("value")).repartition(5, "region").write.option("lineSep", "\u0000").text(folder)
    found = spark.read.text(folder, wholetext=True).select(F.explode(F.split("value", "\u0000")).alias("value")).where("value <> ''")
    return found.select(F.from_json("value", "region int, nations array<string>").alias("d")).select("d.region", F.array_join("d.nations", ",").alias("nations"))


def missing_rows(spark: S, sf: str) -> D:
    """A table written in two runs, of which the second adds what the first has left out."""
    folder = f"{shared_dir(spark)}/missing-{uuid.uuid4().hex}"
    o = B.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    first = sinks.write_missing(o.where("o_orderkey % 3 > 0"), folder, ["o_orderkey"])
    second = sinks.write_missing(o, folder, ["o_orderkey"])
    return spark.read.parquet(folder).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows")).withColumns({"first_run": F.lit(first), "second_run": F.lit(second)})


def checkpointed_items(spark: S, sf: str) -> D:
    """Items stored with markers; after some change, those that have to be done again."""
    folder = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    n = B.read(spark, sf, "nation")
    items = n.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("identity"))
    work = n.select(F.col("n_name").alias("name"), "n_nationkey")
    sinks.checkpoint(work.where("n_nationkey < 20"), items.join(work.where("n_nationkey < 20").select("name"), "name"), folder, ["name"])
    changed = items.withColumn("identity", F.when(F.col("name").rlike("^[A-C]"), F.concat("identity", F.lit("!"))).otherwise(F.col("identity")))
    return sinks.unfinished(changed, folder, ["name"])


def run_report(spark: S, sf: str) -> D:
    """Lines of a Markdown table: each clerk group's orders and mean price."""
    o = B.read(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("price"))
    return sinks.markdown_lines(o, ["o_orderpriority", "o_orderstatus"], digits=2)


def edf_round_trip(spark: S, sf: str) -> D:
    """Signals written as EDF files, found by their headers and read again in chunks of three seconds, in microvolts."""
    c = _contexts(spark, sf)
    files = per_row(c, ["name"], ["samples"], lambda x: [{"content": E.encode({"C1": np.array(x), "C2": -np.array(x)}, 256)}], "content binary")
    folder = f"{shared_dir(spark)}/edf-{uuid.uuid4().hex}"
    edf.register(spark)
    named = files.select(F.lit("p1").alias("patient"), F.concat(F.translate("name", "/", "_"), F.lit(".edf")).alias("file"), "content")
    named.write.format("edf").mode("append").save(edf.qualified(spark, folder))
    chunks = edf.edf(spark, folder, split_bytes=8192, chunk_sec=3.0)
    s = chunks.groupBy("file", "channel", "sfreq").agg(F.sum(F.size("samples")).cast("long").alias("n_samples"), F.round(F.max(F.array_max("samples")) * 1e6, 1).alias("peak_uv"))
    h = edf.edf(spark, folder, "headers").select("file", F.col("n_samples").alias("declared"))
    return s.join(h, "file")


def _events_stream(spark: S, sf: str) -> tuple[D, str]:
    """The events file as a stream, and a new folder for its query in the cluster's shared one."""
    stream = spark.readStream.schema(B.read(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_windows(spark: S, sf: str) -> D:
    """Hourly windows of each type's events from a stream of the events file."""
    stream, folder = _events_stream(spark, sf)
    out = SW.run_once(SW.window_counts(stream, ["event_type"], "ts", "1 hour", F.col("value") >= 250), folder)
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "samples", "positive", "label")


def stream_sessions(spark: S, sf: str) -> D:
    """Each user's runs of events no more than six hours apart, from a stream of the events file."""
    stream, folder = _events_stream(spark, sf)
    out = SW.run_once(SW.sessions(stream, ["user_id"], "ts", "6 hours"), folder)
    return out.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "samples")


QUERIES = {f.__name__: f for f in (manifest_documents, junit_counts, copy_filter, json_manifest, bundle_decisions, column_importance, repeated_keys, column_report, table_differences, leaked_groups, mask_faults, common_channels, jaccard_pairs, dedupe_names, set_difference, unions, distinct_rows, parameter_grid, pending_work, checked_join, lookup_join, arm_join, pivot_seeds, pivot_models, pivot_totals, top_per_group, best_row, name_parts, occurrence, reasons, content_hashes, identity_seeds, median_impute_scale, lr_lopo, forest_lopo, boosted_teacher, student_scores, distilled_student, teacher_students, hyperparameter_search, stratified_split, recorded_contexts, lopo_parts, oscillator_trials, context_measurements, replicated_means, undriven_controls, dose_trials, perturbations, filtered_recordings, annotation_parse, edf_round_trip, stream_windows, stream_sessions, four_arms, parity_faults, frozen_robustness, csv_round_trip, json_round_trip, missing_rows, checkpointed_items, run_report)}

_TOP = "tops AS (SELECT l_suppkey, l_partkey, q FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) <= 3)"
_FRAME = "frame AS (SELECT vec_id, vec_id % 5 AS patient, (label % 2)::INT AS label, " + ", ".join(f"CASE WHEN (vec_id + {3 * k}) % 17 <> 0 THEN embedding[{k + 1}]::DOUBLE END AS f{k}" for k in range(DIMENSIONS)) + " FROM embeddings)"
_FIT = "med AS (SELECT " + ", ".join(f"median(f{k}) AS m{k}" for k in range(DIMENSIONS)) + " FROM frame WHERE patient <> 0), fit AS (SELECT " + ", ".join(f"avg(coalesce(f{k}, m{k})) AS a{k}, stddev_pop(coalesce(f{k}, m{k})) AS s{k}" for k in range(DIMENSIONS)) + " FROM frame, med WHERE patient <> 0)"

ORACLES = {
    "repeated_keys": "SELECT l_orderkey, l_suppkey, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "column_report": "WITH n AS (SELECT count(*) AS rows, count(*) FILTER (l_tax <= 0.02) AS gaps, count(*) FILTER (l_linenumber = 1) AS i, count(*) FILTER (l_linenumber = 2) AS j FROM lineitem) SELECT 'l_quantity' AS feature, rows, 0::BIGINT AS missing, 0::BIGINT AS nans, 0::BIGINT AS infinite, false AS constant FROM n UNION ALL SELECT 'tax', rows, gaps, 0, 0, false FROM n UNION ALL SELECT 'same', rows, 0, 0, 0, true FROM n UNION ALL SELECT 'odd', rows, 0, j, i, false FROM n",
    "table_differences": "SELECT c_custkey, c_nationkey, 'left' AS side FROM customer WHERE c_custkey % 50 = 0 AND c_nationkey <> 99 UNION ALL SELECT c_custkey, 99::INT, 'right' FROM customer WHERE c_custkey % 50 = 0 AND c_nationkey <> 99",
    "leaked_groups": 'SELECT o_custkey % 40 AS "group" FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 97 = 0) > 0 AND count(*) FILTER (o_orderkey % 97 <> 0) > 0',
    "mask_faults": "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS x, (event_id % 3 = 0)::INT AS m FROM events WHERE (event_id % 3 = 0)::INT <> (event_type = 'error')::INT",
    "common_channels": "SELECT concat_ws('-', o_orderpriority, o_orderstatus) AS channel FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey % 7) = (SELECT count(DISTINCT o_custkey % 7) FROM orders)",
    "jaccard_pairs": "WITH s AS (SELECT DISTINCT l_suppkey % 25 AS c, l_orderkey % 9973 AS p FROM lineitem), n AS (SELECT c, count(*) AS n FROM s GROUP BY c), b AS (SELECT x.c AS a, y.c AS b, count(*) AS shared FROM s x JOIN s y ON x.p = y.p AND x.c < y.c GROUP BY 1, 2) SELECT x.c AS a, y.c AS b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 6)::DOUBLE AS jaccard FROM n x JOIN n y ON x.c < y.c LEFT JOIN b ON b.a = x.c AND b.b = y.c",
    "dedupe_names": "WITH p AS (SELECT DISTINCT (p_size % 5)::INT AS file, concat_ws('-', 'T' || (p_partkey % 40), CASE WHEN p_partkey % 3 = 0 THEN 'X1' ELSE (p_partkey % 4)::VARCHAR END) AS name FROM part), q AS (SELECT *, CASE WHEN regexp_matches(name, '^.*-[0-9]+$') THEN regexp_extract(name, '^(.*)-([0-9]+)$', 1) END AS base FROM p), r AS (SELECT *, count(*) OVER (PARTITION BY file, base) AS n, row_number() OVER (PARTITION BY file, base ORDER BY name) AS k FROM q) SELECT file, name, CASE WHEN base IS NOT NULL AND n >= 2 THEN base ELSE name END AS final_name FROM r WHERE base IS NULL OR n < 2 OR k = 1",
    "set_difference": "SELECT k, true AS subset FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    "unions": "SELECT nation, kind, count(*) AS rows, round(sum(balance), 4) AS balance FROM (SELECT s_nationkey AS nation, s_acctbal AS balance, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, 'customer' FROM customer) GROUP BY 1, 2",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "parameter_grid": "SELECT m AS model, l::DOUBLE AS level, 4 * (SELECT count(*) FROM region) AS cells FROM (VALUES ('bistable'), ('fitzhugh')) a(m), (VALUES (0.0), (0.25), (0.5)) b(l)",
    "pending_work": "SELECT o_orderkey AS k, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "checked_join": "SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "lookup_join": "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "arm_join": 'SELECT l_suppkey, a AS "q_A", r AS "q_R", a - r AS difference FROM (SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = \'A\') AS a, sum(l_quantity) FILTER (l_returnflag = \'R\') AS r FROM lineitem GROUP BY 1) WHERE a IS NOT NULL AND r IS NOT NULL',
    "pivot_seeds": f"WITH {B.PREDICTIONS_SQL} SELECT doc_id, " + ", ".join(f"max(score) FILTER (seed = {s}) AS seed_{s}" for s in B.SEEDS) + " FROM predictions WHERE model = 'alpha' GROUP BY doc_id",
    "pivot_models": f"WITH {B.PREDICTIONS_SQL} SELECT patient, " + ", ".join(f"round(avg(score) FILTER (model = '{m}'), 6)::DOUBLE AS {m}" for m in B.MODELS) + " FROM predictions GROUP BY patient",
    "pivot_totals": "SELECT user_id, sum(n)::BIGINT AS total, max(n) AS most FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) GROUP BY user_id",
    "top_per_group": f"WITH {_TOP} SELECT * FROM tops",
    "best_row": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1",
    "name_parts": "SELECT p_partkey, lower(substr(p_type, 1, 4)) AS family, p_brand AS measure, CASE WHEN p_size > 10 THEN p_size::VARCHAR ELSE 'unknown' END AS channel FROM part",
    "occurrence": f"WITH {_TOP} SELECT l_partkey, count(*) AS folds FROM tops GROUP BY 1",
    "reasons": "WITH r AS (SELECT CASE WHEN value > 450 THEN 'clipped_dynamics' WHEN value < 20 THEN 'undefined_spectral_ratio' WHEN event_type = 'error' THEN 'insufficient_intervals' ELSE 'ok' END AS reason FROM events) SELECT reason, count(*) AS rows, sum((reason <> 'ok')::INT)::BIGINT AS missing FROM r GROUP BY 1",
    "content_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "identity_seeds": "SELECT c_custkey, (('0x' || substr(sha256('[42, ' || to_json(c_name)::VARCHAR || ']'), 1, 16))::UBIGINT)::VARCHAR AS seed FROM customer",
    "median_impute_scale": f"WITH {_FRAME}, {_FIT} SELECT vec_id, " + ", ".join(f"round((coalesce(f{k}, m{k}) - a{k}) / s{k}, 6)::DOUBLE AS f{k}" for k in range(DIMENSIONS)) + " FROM frame, med, fit WHERE patient = 0",
    "stratified_split": "SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY h, doc_id) <= round(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS part FROM (SELECT doc_id, quality AS label, ('0x' || substr(md5('42 ' || doc_id), 1, 12))::BIGINT AS h FROM documents JOIN labels USING (doc_id))",
    "lopo_parts": f"WITH {_FRAME} SELECT CASE WHEN patient = 3 THEN 'test' ELSE 'train' END AS part, count(*) AS rows, sum(label)::BIGINT AS positive FROM frame GROUP BY 1",
    "edf_round_trip": """WITH i AS (SELECT l_suppkey AS unit, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS pos, l_quantity AS q FROM lineitem),
c AS (SELECT unit, pos // 2560 AS part, list(q ORDER BY pos) AS q FROM i GROUP BY 1, 2),
x AS (SELECT unit, part, q[k % len(q) + 1] + 20 * sin(k * 0.24) AS v FROM c, generate_series(0, 2559) s(k)),
p AS (SELECT unit, part, max(v) AS high, -min(v) AS low, round(ceil(greatest(max(abs(v)), 0.001) * 10) / 10 + 0.1, 1) AS m FROM x GROUP BY 1, 2),
e AS (SELECT unit, part, m, unnest([{'c': 'C1', 'v': high}, {'c': 'C2', 'v': low}]) AS e FROM p)
SELECT unit || '_' || part || '.edf' AS file, e.c AS channel, 256.0::DOUBLE AS sfreq, 2560::BIGINT AS n_samples, round(round(e.v / m * 32767) * m / 32767, 1)::DOUBLE AS peak_uv, 2560::BIGINT AS declared FROM e""",
    "filtered_recordings": f"""WITH i AS (SELECT l_suppkey AS unit, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS pos, l_quantity AS q FROM lineitem),
g AS (SELECT unit, pos // 2560 AS part, list(q ORDER BY pos) AS q FROM i GROUP BY 1, 2),
x AS (SELECT unit || '_' || part AS c, k, q[k % len(q) + 1] * 1e-6 + sin(k * 0.24) * 2e-5 AS v FROM g, generate_series(0, 2559) s(k)),
{fir_sql("hum", 59.35, 60.65, 423)}, {fir_sql("band", 0.5, 45.0, 423)},
{through_sql("y", "x", "hum", 423, True)}, {through_sql("z", "y", "band", 423, False)}
SELECT split_part(x.c, '_', 1)::BIGINT AS unit, split_part(x.c, '_', 2)::INT AS part, round(stddev_pop(x.v), 9) AS before, round(stddev_pop(z.v), 9) AS after FROM x JOIN z USING (c, k) GROUP BY x.c""",
    "parity_faults": f"WITH {B.PREDICTIONS_SQL} SELECT doc_id FROM (SELECT doc_id, max(score) FILTER (model = 'alpha') AS a, max(score) FILTER (model = 'beta') AS b, max(prediction) FILTER (model = 'alpha') AS pa, max(prediction) FILTER (model = 'beta') AS pb FROM predictions WHERE seed = 42 GROUP BY doc_id) WHERE abs(a - b) > 0.001 + 0.05 * abs(b) OR pa <> pb",
    "csv_round_trip": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
    "json_round_trip": "SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1",
    "missing_rows": "SELECT o_orderstatus, count(*) AS rows, (SELECT count(*) FILTER (o_orderkey % 3 > 0) FROM orders)::INT AS first_run, (SELECT count(*) FILTER (o_orderkey % 3 = 0) FROM orders)::INT AS second_run FROM orders GROUP BY 1",
    "checkpointed_items": "SELECT n_name AS name, n_regionkey || CASE WHEN regexp_matches(n_name, '^[A-C]') THEN '!' ELSE '' END AS identity FROM nation WHERE n_nationkey >= 20 OR regexp_matches(n_name, '^[A-C]')",
    "run_report": """WITH o AS (SELECT o_orderpriority, o_orderstatus, count(*) AS orders, round(avg(o_totalprice), 2) AS price FROM orders GROUP BY 1, 2)
SELECT line::INT AS line, text FROM (SELECT 0 AS line, '| o_orderpriority | o_orderstatus | orders | price |' AS text UNION ALL SELECT 1, '| --- | --- | --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY o_orderpriority, o_orderstatus), '| ' || o_orderpriority || ' | ' || o_orderstatus || ' | ' || orders || ' | ' || printf('%.2f', price) || ' |' FROM o)""",
    "manifest_documents": "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders",
    "junit_counts": "SELECT count(*) AS tests, count(*) FILTER (l_returnflag = 'R') AS failures, count(*) FILTER (l_returnflag = 'A') AS errors, count(*) FILTER (l_linestatus = 'O') AS skipped FROM lineitem",
    "copy_filter": "SELECT doc_id, n_chars, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality = 1",
    "json_manifest": "SELECT o_orderpriority AS priority, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders GROUP BY 1",
    "annotation_parse": f"WITH {B.SAMPLES_SQL} SELECT file || '.edf' AS file, start_sec::INT AS start_sec, end_sec::INT AS end_sec FROM recordings LEFT JOIN intervals USING (patient, file)",
    "stream_sessions": "WITH g AS (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER w) >= 21600000, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT + 21600 AS \"end\", count(*) AS samples FROM r GROUP BY user_id, run",
    "stream_windows": "SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS samples, count(*) FILTER (value >= 250) AS positive, (count(*) FILTER (value >= 250) / count(*) >= 0.5)::INT AS label FROM events GROUP BY 1, 2",
}

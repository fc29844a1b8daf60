"""Classifiers on window features: leave-one-group-out training, distillation, selection and bundles.

Logistic regression, forests and boosted trees are Spark ML on transformed vectors. The small student network
is NumPy in one task for each (fold, seed): the training set of a fold is bounded by `most_rows`, an error
beyond it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import fingerprint
from . import evaluation
from .transforms import FeatureTransform

SEED = 42
TOP = 50
HIDDEN = (32, 16)
TEMPERATURE, ALPHA = 3.0, 0.5
THRESHOLD = 0.5
#: Training rows that one student may be given: its task holds them as 32-bit floats.
MOST_ROWS = 2_000_000
#: Held-out groups that a student study may have.
MOST_FOLDS = 100
ARMS = ("teacher", "selected_supervised", "selected_kd", "random_supervised")
#: Which arm is compared with which (fixed names).
COMPARISONS = [("selected_supervised", "random_supervised"), ("selected_kd", "selected_supervised"), ("teacher", "selected_kd")]


def class_ratio(train: DataFrame, label: str = "label") -> float:
    """Negatives over positives; an error unless both classes are there."""
    r = train.agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("a")).first()
    if not r.n or not r.p or r.n + r.p != r.a:
        raise ValueError("training needs both classes, 0 and 1, and no other")
    return r.n / r.p


def weighted(train: DataFrame, name: str, label: str = "label") -> tuple[DataFrame, float]:
    """Training rows with class weights: balanced, or positives by the class ratio for boosting."""
    ratio = class_ratio(train, label)
    share = ratio / (1 + ratio)  # of negatives
    weights = (0.5 / share, 0.5 / (1 - share)) if name != "boosted_trees" else (1.0, ratio)
    return train.withColumn("_w", F.when(F.col(label) == 1, weights[1]).otherwise(weights[0])), ratio


def estimator(name: str, rows: int, seed: int = SEED, **override):
    """An unfitted classifier by name."""
    common = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_w"}
    if name == "logistic_regression":
        # C = 1: the penalty is one against the sum of balanced weights, which is the number of rows. The constant is
        # a feature, so that it is penalised like the others.
        return LogisticRegression(**common | {"standardization": False, "fitIntercept": False, "maxIter": 2000, "regParam": 1.0 / rows} | override)
    if name == "random_forest":
        return RandomForestClassifier(**common | {"numTrees": 300, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 2, "maxDepth": 20, "seed": seed} | override)
    if name == "boosted_trees":
        return GBTClassifier(**common | {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": seed} | override)
    raise ValueError(f"unknown model {name}")


class Classifier:
    """A fitted transform and model: what a bundle holds."""

    def __init__(self, name: str, transform: FeatureTransform, model: Model):
        self.name, self.transform, self.model = name, transform, model

    @staticmethod
    def vectors(rows: DataFrame, transform: FeatureTransform, keep: list[str], constant: bool) -> DataFrame:
        out = transform.transform(rows.select(*keep, *transform.columns), keep)
        inputs = list(transform.columns)
        if constant:
            out, inputs = out.withColumn("_one", F.lit(1.0)), [*inputs, "_one"]
        return VectorAssembler(inputCols=inputs, outputCol="_x").transform(out).select(*keep, "_x")

    @staticmethod
    def fit(name: str, train: DataFrame, columns: list[str], label: str = "label", seed: int = SEED, transform: FeatureTransform | None = None, **override) -> Classifier:
        """`transform` may have been fitted on these rows and columns before."""
        transform = transform or FeatureTransform.fit(train, columns, scale=name == "logistic_regression")
        rows, _ = weighted(train, name, label)
        x = Classifier.vectors(rows, transform, [label, "_w"], name == "logistic_regression").withColumn("_y", F.col(label).cast("double")).cache()
        try:
            return Classifier(name, transform, estimator(name, x.count(), seed, **override).fit(x))
        finally:
            x.unpersist()

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        x = Classifier.vectors(rows, self.transform, keep, self.name == "logistic_regression")
        return self.model.transform(x).select(*keep, vector_to_array("probability")[1].alias("score"))

    def importance(self) -> pd.DataFrame:
        """feature and importance: |coefficient| or the trees' gain."""
        values = np.abs(self.model.coefficients.toArray()) if self.name == "logistic_regression" else self.model.featureImportances.toArray()
        return pd.DataFrame({"feature": self.transform.columns, "importance": values[: len(self.transform.columns)]})

    def save(self, path: str, threshold: float = THRESHOLD, **facts) -> None:
        """The model's folder and its manifest."""
        self.model.write().save(f"{path}/model")
        write_manifest(path, {"kind": "classical", "name": self.name, "transform": self.transform.to_json(), "threshold": threshold, **facts})

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        """A saved classifier; see read_manifest."""
        facts = read_manifest(spark, path)
        kinds = {"logistic_regression": LogisticRegressionModel, "random_forest": RandomForestClassificationModel, "boosted_trees": GBTClassificationModel}
        return Classifier(facts["name"], FeatureTransform.from_json(facts["transform"]), kinds[facts["name"]].load(f"{path}/model"))


def write_manifest(path: str, facts: dict) -> None:
    """One JSON line, written last: a bundle without it is not whole."""
    rows = SparkSession.active().createDataFrame([(json.dumps({"format": 1, **facts}, sort_keys=True),)], "value string")
    rows.coalesce(1).write.text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A bundle's facts; an error for another format, or if its test groups were among its training groups."""
    facts = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if facts.get("format") != 1:
        raise ValueError("unsupported bundle")
    if both := set(facts.get("train_groups", [])) & set(facts.get("test_groups", [])):
        raise ValueError(f"groups in training and test: {sorted(both)}")
    return facts


def select_top(importance: pd.DataFrame, k: int = TOP) -> list[str]:
    return importance.sort_values(["importance", "feature"], ascending=[False, True]).head(k)["feature"].tolist()


def random_features(columns: list[str], groups: list[str], held_out: str, base_seed: int = SEED, k: int = TOP) -> list[str]:
    """k of the columns, in their order: those with the least fingerprints of (seed, training groups, column). The draw
    depends neither on the columns' order nor on the held-out group."""
    if held_out in groups or k > len(columns):
        raise ValueError("the held-out group must not train, and there must be k columns")
    drawn = sorted(columns, key=lambda c: fingerprint([base_seed, sorted(groups), c]))[:k]
    return [c for c in columns if c in set(drawn)]


def held_groups(groups: list, only: list | None) -> list:
    """The groups to hold out: all, or those named, which must be there."""
    if missing := sorted(set(only or ()) - set(groups)):
        raise ValueError(f"no group {missing}")
    return groups if only is None else [g for g in groups if g in set(only)]


def leave_one_out(rows: DataFrame, columns: list[str], group: str, name: str, keep: list[str], only: list | None = None, transforms: dict | None = None, **how) -> DataFrame:
    """Out-of-fold scores of every row (or of the groups in `only`): each group is scored by a model of all the others.
    Folds are few (groups), so the driver loops over them; each fit and each scoring is distributed. `transforms` holds the
    folds' transforms for further calls on the same rows, columns and kind of model."""
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    out = None
    for g in held_groups(groups, only):
        model = Classifier.fit(name, rows.where(F.col(group) != g), columns, transform=(transforms or {}).get(g), **how)
        if transforms is not None:
            transforms[g] = model.transform
        part = model.score(rows.where(F.col(group) == g), keep).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# -- student network -------------------------------------------------------------------------------------------


class Student:
    """Two ReLU layers and a logit, trained with Adam on weighted cross-entropy, alone or with a teacher."""

    def __init__(self, inputs: int, seed: int, hidden: tuple[int, int] = HIDDEN):
        rng = np.random.default_rng(seed)
        sizes = [inputs, *hidden, 1]
        self.layers = [[rng.uniform(-1, 1, (a, b)).astype(np.float32) / np.sqrt(a), rng.uniform(-1, 1, b).astype(np.float32) / np.sqrt(a)] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.rng = rng

    def state(self) -> list:
        return [[w.astype(float).tolist(), b.astype(float).tolist()] for w, b in self.layers]

    @staticmethod
    def restored(state: list, architecture: list[int]) -> Student:
        """A student with saved layers; an error unless they have the stated sizes, from the inputs to one output."""
        if len(architecture) != 4 or architecture[-1] != 1:
            raise ValueError("a student has two hidden layers and one output")
        net = Student(architecture[0], 0, tuple(architecture[1:3]))
        layers = [[np.array(w, np.float32), np.array(b, np.float32)] for w, b in state]
        if [w.shape for layer in layers for w in layer] != [w.shape for layer in net.layers for w in layer]:
            raise ValueError("the saved layers don't have the stated sizes")
        net.layers = layers
        return net

    def payload(self) -> int:
        """Bytes of the parameters alone."""
        return sum(w.nbytes for layer in self.layers for w in layer)

    def parameters(self) -> int:
        return sum(w.size for layer in self.layers for w in layer)

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        kept = [x]
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if k < len(self.layers) - 1:
                x = np.maximum(x, 0)
            kept.append(x)
        return x[:, 0], kept

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x.astype(np.float32))[0].astype(np.float64)))

    def fit(self, x: np.ndarray, y: np.ndarray, soft: np.ndarray | None = None, epochs: int = 40, batch: int = 256, rate: float = 1e-3, decay: float = 1e-4) -> Student:
        x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
        weight = (y == 0).sum() / max(1, (y == 1).sum())
        moments, step = [[[np.zeros_like(w) for w in layer] for layer in self.layers] for _ in range(2)], 0
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                z, kept = self.logits(x[at])
                p = sigmoid(z)
                grad = np.where(y[at] == 1, weight * (p - 1), p)
                if soft is not None:
                    # d/dz of T^2 * BCE(z / T, soft) is T * (sigmoid(z / T) - soft).
                    grad = ALPHA * grad + (1 - ALPHA) * TEMPERATURE * (sigmoid(z / TEMPERATURE) - soft[at])
                back, step = (grad / len(at)).astype(np.float32)[:, None], step + 1
                for n in reversed(range(len(self.layers))):
                    w, b = self.layers[n]
                    grads = [kept[n].T @ back + decay * w, back.sum(axis=0) + decay * b]
                    back = (back @ w.T) * (kept[n] > 0)
                    for j, g in enumerate(grads):
                        m, v = moments[0][n][j], moments[1][n][j]
                        m += 0.1 * (g - m)
                        v += 0.001 * (g * g - v)
                        self.layers[n][j] = self.layers[n][j] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def student_folds(rows: DataFrame, columns: list[str], group: str, key: str, seeds: tuple[int, ...], teacher: str | None = None, epochs: int = 40, most_rows: int = MOST_ROWS, only: list | None = None) -> DataFrame:
    """(key, test_group, seed, label, score): out-of-fold scores of a student for each held-out group and seed, with
    imputation and scaling fitted inside the fold. `teacher` names a column of probabilities to distil; `only` limits
    the held-out groups."""
    found = only if only is not None else [r[0] for r in rows.select(group).distinct().orderBy(group).limit(MOST_FOLDS + 1).collect()]
    if len(found) > MOST_FOLDS or rows.count() > most_rows:
        raise ValueError(f"at most {MOST_FOLDS} folds of {most_rows} rows each")
    # Each fold's task needs every row of the table, of which there are at most most_rows.
    jobs = [F.struct(F.lit(g).cast(rows.schema[group].dataType).alias("test_group"), F.lit(s).alias("seed")) for g in found for s in seeds]
    jobs = rows.select(key, group, "label", *columns, *([teacher] if teacher else []), F.explode(F.array(*jobs)).alias("_job")).select("*", "_job.*").drop("_job")

    def fold(table: pa.Table) -> pa.Table:
        order = np.asarray(pc.sort_indices(table[key]))
        test = np.asarray(pc.equal(table[group], table["test_group"]))[order]
        # One column is 64-bit at a time; the matrix that trains and scores holds 32 bits.
        x, n = np.empty((len(order), len(columns)), np.float32), np.count_nonzero(~test)
        for k, c in enumerate(columns):
            v = _taken(table, c, order)
            v = np.where(np.isnan(v), np.nanmedian(v[~test]), v)
            # Sums run row by row: training carries the last bit on, so another order of addition gives other scores.
            mean = np.cumsum(v[~test])[-1] / n
            sd = np.sqrt(np.cumsum((v[~test] - mean) ** 2)[-1] / n)
            x[:, k] = (v - mean) / (sd if sd > 0 else 1)
            table = table.drop_columns([c])
        soft = softened(_taken(table, teacher, order)[~test]) if teacher else None
        y = _taken(table, "label", order)
        net = Student(len(columns), table["seed"][0].as_py()).fit(x[~test], y[~test], soft, epochs)
        out = table.select([key, "test_group", "seed", "label"]).take(pa.array(order[test]))
        return out.append_column("score", pa.array(net.score(x[test])))

    kinds = dict(rows.dtypes)
    return jobs.groupBy("test_group", "seed").applyInArrow(fold, f"{key} {kinds[key]}, test_group {kinds[group]}, seed int, label {kinds['label']}, score double")


def _taken(table: pa.Table, column: str, order: np.ndarray) -> np.ndarray:
    """A column's doubles in this order; null is NaN."""
    return table[column].to_numpy().astype(np.float64)[order]


def softened(p: np.ndarray) -> np.ndarray:
    """A teacher's probabilities at the temperature."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-np.log(p / (1 - p)) / TEMPERATURE))


class StudentModel:
    """A fitted transform of its own columns and a student network: what a student's bundle holds."""

    def __init__(self, transform: FeatureTransform, net: Student):
        self.transform, self.net = transform, net

    @staticmethod
    def fit(train: DataFrame, columns: list[str], key: str, label: str = "label", seed: int = SEED, teacher: str | None = None, epochs: int = 40, most_rows: int = MOST_ROWS, transform: FeatureTransform | None = None) -> StudentModel:
        """Trained in one task on the rows in the key's order; more than most_rows of them are an error. `teacher` names a
        column of probabilities to distil; `transform` may have been fitted on these rows and columns before."""
        if train.count() > most_rows:
            raise ValueError(f"training rows must not exceed {most_rows}")
        transform = transform or FeatureTransform.fit(train, columns)
        keep = [key, label, *([teacher] if teacher else [])]
        rows = transform.transform(train.select(*keep, *columns), keep)

        def run(table: pa.Table) -> pa.Table:
            order = np.asarray(pc.sort_indices(table[key]))
            soft = softened(_taken(table, teacher, order)) if teacher else None
            y, x = _taken(table, label, order), np.empty((len(order), len(columns)), np.float32)
            for k, c in enumerate(columns):
                x[:, k] = _taken(table, c, order)
                table = table.drop_columns([c])
            net = Student(len(columns), seed).fit(x, y, soft, epochs)
            return pa.table({"state": [json.dumps(net.state())]})

        state = json.loads(rows.withColumn("_all", F.lit(True)).groupBy("_all").applyInArrow(run, "state string").first().state)  # a fixed number of weights
        return StudentModel(transform, Student.restored(state, [len(columns), *HIDDEN, 1]))

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        x = self.transform.transform(rows.select(*keep, *self.transform.columns), keep)
        net, n = self.net, len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.stack([np.asarray(c) for c in batch.columns[n:]], axis=1) if batch.num_rows else np.zeros((0, net.layers[0][0].shape[0]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(net.score(values))], [*keep, "score"])

        return x.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in x.dtypes[:n]) + ", score double")

    def save(self, path: str, threshold: float = THRESHOLD, **facts) -> None:
        architecture = [self.net.layers[0][0].shape[0], *(w.shape[1] for w, _ in self.net.layers)]
        write_manifest(path, {"kind": "student", "transform": self.transform.to_json(), "architecture": architecture, "state": self.net.state(), "threshold": threshold, **facts})

    @staticmethod
    def load(spark: SparkSession, path: str) -> StudentModel:
        facts = read_manifest(spark, path)
        transform = FeatureTransform.from_json(facts["transform"])
        if facts["architecture"][0] != len(transform.columns):
            raise ValueError("the student's inputs are not its columns")
        return StudentModel(transform, Student.restored(facts["state"], facts["architecture"]))


class Bundle:
    """A saved model of either kind with its facts: threshold, groups, feature columns and specification."""

    def __init__(self, spark: SparkSession, path: str):
        self.facts = read_manifest(spark, path)
        self.model = (StudentModel if self.facts.get("kind") == "student" else Classifier).load(spark, path)
        self.threshold = float(self.facts.get("threshold", THRESHOLD))

    def decide(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep, score and prediction at the bundle's threshold. A feature column that is missing or doubled, or one
        that the bundle doesn't know, is an error."""
        known = list(self.facts.get("feature_columns", self.model.transform.columns))
        given = [c for c in rows.columns if c not in {*keep, "label"}]
        if sorted(given) != sorted(known):
            raise ValueError(f"missing {sorted(set(known) - set(given))}, unexpected {sorted(set(given) - set(known))}, doubled {sorted({c for c in given if given.count(c) > 1})}")
        return self.model.score(rows, keep).withColumn("prediction", (F.col("score") >= self.threshold).cast("int"))

    def sizes(self) -> dict[str, int | None]:
        """Parameters and bytes of a student's weights; for trees and regressions the number of trees or coefficients."""
        if isinstance(self.model, StudentModel):
            return {"parameters": self.model.net.parameters(), "payload": self.model.net.payload()}
        inner = self.model.model
        return {"parameters": inner.getNumTrees if hasattr(inner, "getNumTrees") else len(inner.coefficients), "payload": None}


def distil(rows: DataFrame, columns: list[str], group: str, key: str, seeds: tuple[int, ...] = (SEED,), k: int = TOP, epochs: int = 40, teacher: str = "boosted_trees", **how) -> DataFrame:
    """Leave-one-group-out distillation: in each fold a teacher of the training groups names the k best columns and
    gives the soft targets, and students learn from those columns alone. `arm` is supervised or distilled."""
    out = None
    for g in [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]:
        train = rows.where(F.col(group) != g)
        fitted = Classifier.fit(teacher, train, columns, **how)
        best = select_top(fitted.importance(), k)
        soft = rows.join(fitted.score(rows, [key]).withColumnRenamed("score", "_teacher"), key)
        for arm, name in (("supervised", None), ("distilled", "_teacher")):
            part = student_folds(soft, best, group, key, seeds, name, epochs, only=[g]).withColumn("arm", F.lit(arm))
            out = part if out is None else out.unionByName(part)
    return out


def four_arms(rows: DataFrame, columns: list[str], group: str, key: str, keep: list[str], seeds: tuple[int, ...] = (SEED,), k: int = TOP, epochs: int = 40, save: str | None = None, facts: dict | None = None, only: list | None = None, **how) -> DataFrame:
    """Out-of-fold scores of the four arms (keep, model, seed, threshold, score, prediction): the teacher, students on
    its k best columns alone and with its soft targets, and a student on k random columns. Teachers, selections and draws
    are the same for all seeds. `only` limits the held-out groups. With `save`, each fold's bundles go to save/seed/group/arm. Folds are few and run one by
    one; each fit and each scoring is distributed or bounded by MOST_ROWS."""
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    out = None
    for g in held_groups(groups, only):
        rest = [h for h in groups if h != g]
        train, test = rows.where(F.col(group) != g), rows.where(F.col(group) == g)
        fitted = Classifier.fit("boosted_trees", train, columns, **how)
        chosen = {"selected": select_top(fitted.importance(), k), "random": random_features(columns, rest, g, k=k)}
        # The teacher's scores serve every student's fit; a lost block is scored again.
        soft = train.join(fitted.score(train, [key]).withColumnRenamed("score", "_teacher"), key).persist()
        fits = {name: fitted.transform.some(names) for name, names in chosen.items()}
        for seed in seeds:
            for arm in ARMS:
                which = arm.split("_")[0]
                model = fitted if arm == "teacher" else StudentModel.fit(soft, chosen[which], key, seed=seed, teacher="_teacher" if arm == "selected_kd" else None, epochs=epochs, transform=fits[which])
                if save:
                    model.save(f"{save}/seed{seed}/{g}/{arm}", train_groups=rest, test_groups=[g], feature_columns=columns, model_name=arm, seed=seed, **(facts or {}))
                part = model.score(test, keep).withColumns({"model": F.lit(arm), "seed": F.lit(seed), "threshold": F.lit(THRESHOLD)})
                out = part if out is None else out.unionByName(part)
        soft.unpersist()
    return out.withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))


def random_search(rows: DataFrame, columns: list[str], group: str, name: str, space: dict[str, list], draws: int, seed: int = SEED) -> DataFrame:
    """Mean out-of-group average precision of `draws` random settings (without repetition), best first. Settings and
    folds are few and run one by one; this is selection by outer folds, as in the archived study, and not nested."""
    rng, tried, transforms = np.random.default_rng(seed), [], {}
    size = int(np.prod([len(v) for v in space.values()]))
    for at in sorted(rng.choice(size, min(draws, size), replace=False).tolist()):
        setting = {}
        for key, values in space.items():
            at, k = divmod(at, len(values))
            setting[key] = values[k]
        scores = leave_one_out(rows, columns, group, name, [group, "label"], transforms=transforms, **setting)
        value = evaluation.areas(scores, [group]).agg(F.avg("average_precision").alias("v")).first().v
        tried.append((json.dumps(setting, sort_keys=True), value))
    tried.sort(key=lambda t: (-(t[1] or 0), t[0]))
    return rows.sparkSession.createDataFrame(tried, "setting string, average_precision double")


def parity(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-5, atol: float = 1e-7) -> DataFrame:
    """Keys on one side only, or whose score differs beyond the tolerance or whose decision differs."""
    both = a.select(*keys, F.col("score").alias("_a"), F.col("prediction").alias("_pa")).join(b.select(*keys, F.col("score").alias("_b"), F.col("prediction").alias("_pb")), keys, "full_outer")
    near = F.abs(F.col("_a") - F.col("_b")) <= atol + rtol * F.abs(F.col("_b"))
    return both.where(~F.coalesce(near & (F.col("_pa") == F.col("_pb")), F.lit(False))).select(*keys)


"""Mixing sources to target weights by soft membership.

A softmax classifier, trained on a labelled table of (doc_id, domain), gives every document a posterior over
the domains, so a document counts towards several of them. Document rates r >= 0 are then fitted so that
the expected domain token totals, sum over d of r_d * tokens_d * posterior_d, match the targets. The fit is
projected gradient on least squares, distributed: with s the totals at the current rates and t the
targets, each round adds posterior_d . G^-1 (t - s) to every rate and cuts it at the bounds, where G = sum of
tokens * posterior * posterior' over the documents inside them whitens the residual (a step of one in the norm
that weighs documents by tokens). A rate is thus a fold over the rounds' few residuals: rounds are single aggregates over the
staged posteriors, and only sums of one row come to the driver.

Bounds: at most `sample` labelled rows of each domain train the classifier; the number of domains is the
targets' number, at most 32. Posteriors, tokens and totals cover all documents.

Defined cases: a null or empty text has no tokens, the posterior of an empty passage and a rate that
changes no total; labelled rows with a null or untargeted domain are ignored; without labelled rows the
posterior is the targets; repeated rows count each; of labelled documents that share an id the text that sorts
first teaches; targets are scaled to sum to one; an empty table
gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .passages import WIDTH, encode_whole
from .support import read, slices, stage, with_ids
from .words import plain_hashes

TARGETS = {"de": 0.15, "en": 0.55, "es": 0.15, "fr": 0.15}
SAMPLE = 1000
#: Of the targets' sum; sums and rates are rounded at about this size.
TOLERANCE = 1e-9
#: For sampling, whose own chance is greater.
SAMPLED = 1e-4
#: Rounds without a better residual after which the targets count as out of reach.
PATIENCE = 8
#: Of all tokens, the share that `sample` keeps at least, whether or not that repeats no domain.
LEAST_KEPT = 0.5
STEPS = 300
MOST_DOMAINS = 32
BATCH_BYTES = 1 << 19


class DomainModel:
    """Softmax over encodings of whole texts, standardised."""

    def __init__(self, domains: list[str], share: np.ndarray):
        self.domains, self.share, self.weights = domains, share, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> DomainModel:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        aim = np.eye(len(self.domains))[y] / np.bincount(y, minlength=len(self.domains))[y][:, None] * len(y) / len(self.domains)
        self.weights, speed = np.zeros((x.shape[1], len(self.domains))), 0.0
        for _ in range(STEPS):
            p = self._softmax(x @ self.weights) * aim.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - 0.05 * (x.T @ (p - aim) / len(x) + 1e-3 * self.weights)
            self.weights = self.weights + speed
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.repeat(self.share[None, :], len(x), axis=0)
        return self._softmax(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights)


def count_tokens(texts: pa.Array) -> np.ndarray:
    r"""Runs of bytes other than \x20 and \x09-\x0D, by text."""
    return np.diff(plain_hashes(texts)[1])


def _targets(targets: dict[str, float]) -> dict[str, float]:
    if not 1 <= len(targets) <= MOST_DOMAINS or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError(f"1 to {MOST_DOMAINS} nonnegative target weights are needed, not all zero")
    return {k: v / sum(targets.values()) for k, v in sorted(targets.items())}


def fit_domains(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DomainModel:
    targets = _targets(targets)
    domains = list(targets)
    truth = labelled.select(F.col("doc_id").cast("long"), F.col("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    pick = [truth.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for d in domains]
    chosen = stage(reduce(DataFrame.union, pick), "mix-sample")  # at most sample x domains rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                x = encode_whole(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "domain", "x"])

    rows = with_ids(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("doc_id", "text", "domain")
    found = sorted(((r.doc_id, r.domain, np.frombuffer(r.x, np.float32)) for r in rows.mapInArrow(run, "doc_id long, domain string, x binary").toLocalIterator()), key=lambda r: r[0])
    model = DomainModel(domains, np.array(list(targets.values())))
    return model.fit(np.stack([r[2] for r in found]).astype(float).reshape(-1, WIDTH), np.array([domains.index(r[1]) for r in found])) if found else model


def posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """The rows with tokens and p0, p1, .. by domain; `docs` must not have columns of these names."""
    names = [f"p{k}" for k in range(len(model.domains))]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, BATCH_BYTES):
                x = encode_whole(batch.column(at))
                # Nine digits, so that sums do not depend on a machine's last bits.
                p = np.round(model.posterior(x), 9)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count_tokens(batch.column(at))), *(pa.array(c, pa.float64()) for c in p.T)], [*batch.schema.names, "tokens", *names])

    kinds = StructType([*docs.schema, StructField("tokens", LongType()), *(StructField(n, DoubleType()) for n in names)])
    return docs.mapInArrow(run, kinds)


def _rate(steps: list[np.ndarray], most: float | None = None) -> Column:
    """The rounds as a fold over a literal array, so the plan's size doesn't grow with them; rates stay between zero and
    `most`."""
    if not steps:
        return F.lit(1.0)
    rounds = F.array(*[F.array(*[F.lit(float(v)) for v in u]) for u in steps])
    cut = lambda rate: F.greatest(F.lit(0.0), rate) if most is None else F.least(F.lit(float(most)), F.greatest(F.lit(0.0), rate))
    return F.aggregate(rounds, F.lit(1.0), lambda rate, u: cut(reduce(Column.__add__, [F.col(f"p{k}") * u[k] for k in range(len(steps[0]))], rate)))


def fit_rates(table: DataFrame, targets: dict[str, float], budget: float | None = None, most: float | None = None, tolerance: float = TOLERANCE, least: float = 0.0) -> tuple[Column, dict]:
    """The rate as a column over `table` (posteriors), and the fit's totals. The budget in tokens is all tokens,
    or with budget=-1 a hundredth less than the most that gives no domain a greater total than it has, but at least the
    share `least` of all tokens. The projection
    keeps rates from zero to `most`. Each round whitens by the documents whose rates are inside these bounds, so bounds
    that hold many documents don't slow the fit; a round that misses by more is tried again with half its step. Rounds
    go on until the targets are met to the tolerance, or, where bounds keep them out of reach, until PATIENCE rounds
    have not brought the distance down by a tenth; the best rates stand. The residual is the largest miss over the targets'
    sum."""
    weights = np.array(list(_targets(targets).values()))
    n = len(weights)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    p = [F.col(f"p{k}") for k in range(n)]

    def sums(steps: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """All tokens, the totals at these steps' rates, and the Gram matrix of the documents inside the bounds."""
        rows = table.withColumn("_rate", _rate(steps, most))
        mass = F.col("tokens") * F.col("_rate")
        # At the start every document is inside, on whatever bound it stands.
        inside = F.col("tokens") if not steps else F.when((F.col("_rate") > 0) & (F.col("_rate") < (float("inf") if most is None else most)), F.col("tokens")).otherwise(0)
        row = rows.agg(F.sum("tokens"), *[F.sum(mass * x) for x in p], *[F.sum(inside * p[i] * p[j]) for i, j in pairs]).first()
        gram = np.zeros((n, n))
        for (i, j), v in zip(pairs, row[n + 1 :], strict=True):
            gram[i, j] = gram[j, i] = v or 0.0
        return float(row[0] or 0), np.array([v or 0.0 for v in row[1 : n + 1]]), gram

    tokens, now, gram = sums([])
    if not tokens:
        return F.lit(1.0), {"rounds": 0, "totals": [0.0] * n, "targets": [0.0] * n, "residual": 0.0}
    if budget == -1:
        budget = max(0.99 * float(min(h / w for h, w in zip(now, weights, strict=True) if w > 0)), least * tokens)
    aim = weights * (tokens if budget is None else budget)
    miss = lambda totals: float(np.abs(aim - totals).max() / aim.sum())
    # Steps are judged by the sum of squares: where one domain is out of reach, the others still come nearer.
    apart = lambda totals: float(np.linalg.norm(aim - totals) / aim.sum())
    steps: list[np.ndarray] = []
    size, waited = 1.0, 0
    while miss(now) > tolerance and waited < PATIENCE:
        # Residuals are rounded, so that rates do not depend on the order of a sum.
        step = size * (np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ (aim - now))
        tried = [*steps, np.array([float(f"{v:.9e}") for v in step])]
        _, totals, inner = sums(tried)
        waited = 0 if apart(totals) < 0.9 * apart(now) else waited + 1
        if apart(totals) < apart(now):
            steps, now, gram, size = tried, totals, inner, 1.0
        else:
            size /= 2
    return _rate(steps, most), {"rounds": len(steps), "totals": now.tolist(), "targets": aim.tolist(), "residual": miss(now)}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, posterior (in the order of the sorted domains) and rate of every document, and the fit's residual,
    which is above TOLERANCE only where no nonnegative rates meet the targets."""
    model = fit_domains(docs, labelled, targets, id_col, text_col)
    table = stage(posteriors(with_ids(docs, id_col, text_col), model).drop("text"), "mix-posteriors")
    rate, found = fit_rates(table, targets, budget)
    return table.select("doc_id", "tokens", F.array(*[f"p{k}" for k in range(len(model.domains))]).alias("posterior"), rate.alias("rate"), F.lit(float(f"{found['residual']:.3e}")).alias("residual"))


def sampled(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_KEPT) -> tuple[DataFrame, dict]:
    """The documents, with all their columns, each kept with the probability of its rate (by a hash of its id
    and text), and the fit. Rates are fitted between zero and one under the greatest budget that repeats no domain, so what
    is expected to be kept meets the targets; but if a domain is so scarce that this budget is below the share `least` of
    all tokens, that share is the budget and the rates come as near to the targets as whole documents allow: the
    fit's residual tells how near. Rows with equal ids and texts share a fate."""
    model = fit_domains(docs, labelled, targets, id_col, text_col)
    names = [f"_{i}" for i in range(len(docs.columns))]  # any name may clash with the posteriors'
    key = [F.col(names[docs.columns.index(c)]) for c in (id_col, text_col)]
    table = stage(posteriors(docs.toDF(*names), model, names[docs.columns.index(text_col)]), "mix-documents", "zstd")
    rate, found = fit_rates(table, targets, budget=-1, most=1.0, tolerance=SAMPLED, least=least)
    u = F.pmod(F.xxhash64(*key, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return table.where(u < rate).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]), found


def sample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_KEPT) -> DataFrame:
    """`sampled` without the fit, of which a residual above the tolerance is a warning."""
    kept, found = sampled(docs, labelled, targets, id_col, text_col, least)
    if found["residual"] > SAMPLED:
        warnings.warn(f"the targets are missed by {found['residual']:.3g} of the kept tokens: totals {found['totals']} for {found['targets']}", stacklevel=2)
    return kept


def languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the driver's data: the language of the documents that `labels` names."""
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").alias("domain")).join(labels.select(F.col("doc_id").cast("long")).distinct(), "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target token shares of the languages."""
    docs = read(spark, sf_dir, "documents")
    return mix(docs, languages(docs, read(spark, sf_dir, "labels")), TARGETS)

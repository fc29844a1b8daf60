"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded (passages.encode); a gated
attention layer, a(h) = w . (tanh(V h) * sigmoid(U h)), gives each passage a weight in its document, and
the document's score is a logistic function of the weighted passage representation. V, U, w and the
last layer are learnt together from document labels only, in NumPy with Adam on the driver.

The fit uses at most `sample` labelled documents of each class, those with the smallest id hashes whose texts
add up to at most `most_bytes` in that order (a longer text is passed over): documented bounds on labelled rows.
Of each it uses every passage, and scoring reads every passage of every text. Classes weigh by their share in all
labels, so scores are probabilities.

Defined cases: a null or empty text is one empty passage and gets its score; without labels of both
classes every score is the share of label 1 (0.5 if there are no labels); repeated label rows count
once, as 1 if any says so; of documents that share an id the text that sorts first is taught; repeated rows are
scored each; an empty table gives an empty result; only the
id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .passages import WIDTH, encode
from .support import held_out, read, slices, stage, to_tasks, with_ids

SAMPLE = 3000
#: Bytes of the texts of one class that teach: the driver holds about 1.4 bytes of features for each.
MOST_BYTES = 24 << 20
HIDDEN = 48
EPOCHS = 60
BATCH_DOCS = 256
RATE = 0.01
DECAY = 1e-4
SEED = 7
THRESHOLD = 0.7
BATCH_BYTES = 1 << 19


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """The network: standardised passages, a shared projection, gated attention and a logistic layer."""

    def __init__(self, share: float):
        self.share, self.weights = share, None

    def fit(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> GatedAttention:
        """x: passages; at: the documents' offsets in x; y, weight: by document."""
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        size = lambda *n: (rng.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
        self.weights = {"P": size(WIDTH, HIDDEN), "V": size(HIDDEN, HIDDEN), "U": size(HIDDEN, HIDDEN), "w": size(HIDDEN), "c": size(HIDDEN), "p": np.zeros(HIDDEN, np.float32), "b": np.zeros(1, np.float32)}
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH_DOCS):
                docs = order[k : k + BATCH_DOCS]
                rows = np.concatenate([np.arange(at[d], at[d + 1]) for d in docs])
                cut = np.r_[0, np.cumsum(at[docs + 1] - at[docs])]
                grads = self._gradients(x[rows], cut, y[docs], weight[docs])
                step += 1
                for name, g in grads.items():
                    g = g + DECAY * self.weights[name]
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.weights[name] = self.weights[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def _forward(self, x: np.ndarray, cut: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["P"] + w["p"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["w"]
        doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        e = np.exp(e - np.maximum.reduceat(e, cut[:-1])[doc])
        a = e / np.add.reduceat(e, cut[:-1])[doc]
        z = np.add.reduceat(a[:, None] * h, cut[:-1], axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "doc": doc, "s": z @ w["c"] + w["b"]}

    def _gradients(self, x: np.ndarray, cut: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self._forward(x, cut)
        ds = (weight * (_sigmoid(f["s"]) - y) / len(y)).astype(np.float32)
        dz = ds[:, None] * w["c"]
        dz_row = dz[f["doc"]]
        gain = (f["h"] * dz_row).sum(axis=1)  # by how much the score rises with the passage's weight
        mean = np.add.reduceat(f["a"] * gain, cut[:-1])[f["doc"]]
        de = f["a"] * (gain - mean)
        dtg = de[:, None] * w["w"]
        dt = dtg * f["g"] * (1 - f["t"] ** 2)
        dg = dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz_row + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {"P": x.T @ dh, "p": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ ds, "b": np.array([ds.sum()], np.float32)}

    def score(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score by document, attention by passage)."""
        if self.weights is None:
            return np.full(len(at) - 1, self.share), np.repeat(1 / np.diff(at), np.diff(at))
        f = self._forward((x - self.mean) / self.scale, at)
        return _sigmoid(f["s"]).astype(float), f["a"]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> GatedAttention:
    """A network from the labelled rows given; what is held out must be left out of `labels`."""
    truth = labels.select(F.col("doc_id").cast("long"), F.col(label_col).alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    totals = {r.y: r["count"] for r in truth.groupBy("y").count().collect()}
    share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    pick = [truth.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = stage(pick[0].union(pick[1]), "mil-sample")  # at most 2 x sample rows
    size = F.octet_length(F.coalesce("text", F.lit("")))
    once = with_ids(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").where(size <= most_bytes).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    once = stage(once, "mil-texts", "zstd")
    upto = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most `sample` rows each
    taught = once.select("doc_id", "y", size.alias("size")).withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                x, at = encode(batch.column(1))
                kept = [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(kept, pa.binary())], ["doc_id", "y", "x"])

    rows = once.join(F.broadcast(taught), "doc_id").select("doc_id", "text", "y")
    # At most 2 x most_bytes of texts, in pieces that the driver takes one partition at a time.
    found = sorted(((r.doc_id, r.y, np.frombuffer(r.x, np.float32).reshape(-1, WIDTH)) for r in rows.mapInArrow(run, "doc_id long, y int, x binary").toLocalIterator()), key=lambda r: r[0])
    net = GatedAttention(share)
    y = np.array([r[1] for r in found], np.float32)
    if len(set(y.tolist())) < 2:
        return net
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    return net.fit(np.concatenate([r[2] for r in found]), np.r_[0, np.cumsum([len(r[2]) for r in found])], y, weight)


def score(docs: DataFrame, net: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_passages and top_passage (the passage with the greatest attention)."""
    shared = to_tasks(docs.sparkSession, net)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                x, at = encode(batch.column(1))
                p, a = shared().score(x, at)
                top = [int(np.argmax(a[i:j])) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(np.diff(at)), pa.array(top, pa.int64())], ["doc_id", "score", "n_passages", "top_passage"])

    return with_ids(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_passages long, top_passage long")


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, with labels learnt only outside the held-out fold."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    net = fit(docs, labels.where(~held_out("doc_id", 4, 2)))
    return score(docs, net).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "top_passage")

"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words and character
3- and 4-grams, each kind with equal weight; a softmax over it gives the probability of each label. The
vectors and the softmax are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows. As the softmax has two outputs and
the average is linear, a trained model folds into one number for each bucket,
and scoring is a lookup and a sum over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing, labelled

BITS = 15
DIM = 8
EPOCHS = 8
BATCH = 32
RATE = 0.3
SEED = 17
THRESHOLD = 0.7
FOLD_MODULUS, FOLD_HELD_OUT = 4, 2
SCALE = 1 << 20


@dataclass
class Model:
    """A fixed-point number for each bucket (times SCALE), and the bias: the log-odds of label 1 are bias + average."""

    table: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        data, bounds = hashing.buffer(column)
        odds = self.bias + hashing.Features(BITS).averages(data, bounds, self.table) / SCALE
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(texts: list[str], y: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit by SGD with per-parameter (AdaGrad) steps. Without rows of both labels the score is the label's rate, 0.5 without any."""
    import pyarrow as pa

    features = hashing.Features(BITS)
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
        return Model(np.zeros(features.size, np.int64), float(np.log(p / (1 - p))))
    rows = []
    for at in range(0, len(texts), 200):
        data, bounds = hashing.buffer(pa.array(texts[at : at + 200], pa.large_string()))
        rows += features.weights(data, bounds)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (features.size, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    emb_sq, out_sq, bias_sq = np.full(features.size, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            idx = np.concatenate([rows[i][0] for i in pick])
            weight = np.concatenate([rows[i][1] for i in pick])
            of = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            mean = np.stack([np.bincount(of, weight * emb[idx, k], len(pick)) for k in range(dim)], 1).astype(np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            g_out, g_bias, g_mean = mean.T @ p, p.sum(0), p @ out.T
            used, inverse = np.unique(idx, return_inverse=True)
            g_emb = np.stack([np.bincount(inverse, weight * g_mean[of, k], len(used)) for k in range(dim)], 1).astype(np.float32)
            emb_sq[used] += (g_emb**2).mean(1)
            emb[used] -= rate * g_emb / np.sqrt(emb_sq[used])[:, None]
            out_sq += g_out**2
            out -= rate * g_out / np.sqrt(out_sq)
            bias_sq += g_bias**2
            bias -= rate * g_bias / np.sqrt(bias_sq)
    fold = emb.astype(np.float64) @ (out[:, 1] - out[:, 0]).astype(np.float64)
    return Model(np.round(fold * SCALE).astype(np.int64), float(bias[1] - bias[0]))


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the doc_id as text has that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = labelled.MAX_ROWS) -> Model:
    texts, y, _ = labelled.sample(docs, labels, "quality", ~held_out("doc_id", FOLD_MODULUS, FOLD_HELD_OUT), max_rows)
    return train(texts, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    A null or empty text has no features and gets the score of the bias alone.
    Repeated rows get equal scores. A very long text is
    read whole, alone in its batch. There are no ties to break. Other columns, whatever
    their names, are not read. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in common.sized(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")))], ["doc_id", "score"])

    scored = common.texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", FOLD_MODULUS, FOLD_HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns, whatever their names.

    A null text is scored as an empty one and stays null. Repeated rows stay or go
    together, very long texts are scored whole, a score just at the threshold stays. An
    empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in common.sized(batches, "text", 2 << 20):
            good = model.scores(pc.fill_null(batch.column("text"), "")) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema).select(*[F.col(f"`{c}`") for c in names])

"""Quality rules: counting rules, then a calibrated logistic regression, each against fixed thresholds.

The regression's inputs are hashed words and character 3- and 4-grams of the
whole text. It is fitted in numpy on a bounded sample of labelled quality rows,
and its log-odds are calibrated (a two-parameter logistic fit) on a quarter of
the sample that the fit has not seen. Texts are counted and scored in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing, labelled

BITS = 15
EPOCHS = 10
BATCH = 32
RATE = 0.5
L2 = 1e-7
SEED = 29
SCALE = 1 << 20
#: Fixed thresholds.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_PROBABILITY = 0.5

SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1


@dataclass
class Model:
    """Fixed-point weight of each bucket, and the slope and intercept of the calibrated log-odds."""

    table: np.ndarray
    slope: float
    intercept: float

    def probabilities(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        odds = self.slope * hashing.Features(BITS).averages(data, bounds, self.table) / SCALE + self.intercept
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of y on odds, with smoothed targets (Newton's method)."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(odds.std()), 1e-9)
    x = np.stack([odds / spread, np.ones(len(odds))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    if w[0] <= 0:  # no order to keep: only the intercept is used
        w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    return float(w[0] / spread), float(w[1])


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Without rows of both labels each text has the label's rate as its probability, or 0.5 without any."""
    import pyarrow as pa

    features = hashing.Features(BITS)
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
        return Model(np.zeros(features.size, np.int64), 1.0, float(np.log(p / (1 - p))))
    rows = []
    for at in range(0, len(texts), 200):
        rows += features.weights(*hashing.buffer(pa.array(texts[at : at + 200], pa.large_string())))
    apart = np.arange(len(rows)) % 4 == 3
    fit = np.flatnonzero(~apart)
    w, bias = np.zeros(features.size), 0.0
    w_sq, bias_sq = np.full(features.size, 1e-8), 1e-8
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            idx = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick])
            of = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            z = np.bincount(of, value * w[idx], len(pick)) + bias
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
            used, inverse = np.unique(idx, return_inverse=True)
            grad = np.bincount(inverse, value * g[of], len(used)) + L2 * w[used]
            w_sq[used] += grad**2
            w[used] -= rate * grad / np.sqrt(w_sq[used])
            bias_sq += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(bias_sq)
    table = np.round(w * SCALE).astype(np.int64)
    odds = np.array([float(v @ w[i]) for i, v in rows]) + bias
    check = np.flatnonzero(apart)
    if len(set(y[check].tolist())) < 2:
        check = np.arange(len(rows))
    slope, shift = calibrate(odds[check], y[check])
    return Model(table, slope, slope * bias + shift)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = labelled.MAX_ROWS) -> Model:
    texts, y, _ = labelled.sample(docs, labels, "quality", None, max_rows)
    return train(texts, y)


def repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words in windows of three words that the text has twice or more; ids are below kinds."""
    if len(ids) < 4:
        return 0
    if kinds < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pair = np.unique(ids[:-2] * kinds + ids[1:-1], return_inverse=True)[1]
        key = pair * kinds + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(ids), bool)
    marked[:-2] |= twice
    marked[1:-1] |= twice
    marked[2:] |= twice
    return int(marked.sum())


def counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a byte buffer."""
    solid = ~hashing.SPACE[data]
    first = (data & 0xC0) != 0x80  # each code point has one first byte
    chars = np.concatenate([[0], np.cumsum(solid & first)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    n = len(bounds) - 1
    n_words, dup_lines, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = data.tobytes()
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        text = whole[a:b]
        words = text.split()
        n_words[i] = len(words)
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        repeats[i] = repeat_words(ids, len(index))
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))
    return {"n_words": n_words, "word_chars": np.diff(chars[bounds]), "n_symbols": np.diff(symbols[bounds]), "n_dup_lines": dup_lines, "n_repeat_words": repeats}


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
)


def apply(docs: DataFrame, model: Model, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Counts, base_failed, kept and the calibrated probability for each row of docs (doc_id, text).

    A null text has no words, as an empty one: its base rule fails. Repeated rows
    get equal results. A very long text is counted and scored whole, alone in its
    batch. There are no ties to break. Other columns, whatever their names, are not
    read. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in common.sized(batches, "text", 2 << 20):
            data, bounds = hashing.buffer(batch.column("text"))
            c = counts(data, bounds)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            p = model.probabilities(data, bounds)
            columns = {"doc_id": batch.column("doc_id")} | {k: pa.array(v) for k, v in c.items()}
            columns |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= min_probability)), "probability": pa.array(p)}
            yield pa.RecordBatch.from_pydict(columns)

    return common.texts(docs).mapInArrow(run, SCHEMA)

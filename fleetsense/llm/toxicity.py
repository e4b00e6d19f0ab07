"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a fixed lexicon of insults and of a lexicon learned from
labelled rows (words and beginnings of words), how near the second person stands
to them, capitals, punctuation and obfuscation rates. A bounded labelled sample is
parted into folds; the trees see each row by a lexicon learned from the other
folds, so a learned word's density is as on unseen rows. Calibration uses the
scores of each fold by trees that know nothing of it: their rows are seen by
lexicons learned without that fold as well. Words are counted and features are made by the
executors; the driver gets numbers, not texts, and fits the trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing, labelled
from .quality_classifier import held_out

FOLD_MODULUS, FOLD_HELD_OUT = 3, 1
THRESHOLD = 0.7
MAX_ROWS = 4000
TREES, DEPTH, RATE, BINS, FOLDS = 60, 3, 0.2, 32, 3
MIN_LEAF, REGULAR = 3.0, 1.0
#: A learned word stands in at least so many toxic rows, with odds so many times those of other rows.
LEARN_ROWS, LEARN_ODDS = 3, 20.0
PREFIXES = (4, 5, 6)
#: Words between an insult and the second person.
NEAR = 5
#: Words a worker remembers.
CACHE_WORDS = 300_000
#: Counts that a worker keeps before it hands them on.
COUNTED_STEMS = 500_000
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_~`/\\+=@^"

INSULTS = frozenset(
    """idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile fool loser losers scum trash garbage
    worthless pathetic disgusting clown clowns jerk bastard bitch asshole shit crap fuck fucking whore slut pig filth filthy
    vermin coward liar retard creep freak ugly hate kill idiota imbecil estupido estúpido basura asqueroso payaso inútil mierda
    imbécile stupide abruti crétin ordure débile merde salaud connard idioten dumm dummkopf trottel arschloch abschaum müll
    wertlos ekelhaft versager scheiße""".split()
)
SECOND = frozenset(
    """you your yours yourself u ur youre you're du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous
    votre vos tú ti tus usted ustedes vosotros vuestro""".split()
)
#: Fixed table: characters that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
N_FEATURES = 15

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in PUNCTUATION]] = True


def stems(word: str) -> set[str]:
    """What may be learned of a word: itself, and its beginnings (marked by *)."""
    return {word} | {word[:k] + "*" for k in PREFIXES if len(word) >= k}


def core(token: str) -> str:
    return token.strip(PUNCTUATION)


def count(texts, into: dict[str, int]) -> None:
    """Add to each word and beginning of a word in how many of the texts it stands."""
    for t in texts:
        found: set[str] = set()
        for w in {core(x) for x in t.lower().split()}:
            if w:
                found |= stems(w)
        for s in found:
            into[s] = into.get(s, 0) + 1


def marking(stem: str, toxic: int, other: int, n1: int, n0: int) -> float:
    """Log-odds of a stem that marks toxic rows, 0 for another. It stands in so many of n1 toxic and n0 other rows."""
    odds = (toxic + 0.5) / (n1 + 1) / ((other + 0.5) / (n0 + 1))
    return float(np.log(odds)) if toxic >= LEARN_ROWS and odds >= LEARN_ODDS else 0.0


def learn(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Words and beginnings of words that mark toxic rows, with their log-odds."""
    toxic, other = {}, {}
    for label, into in ((1, toxic), (0, other)):
        count((t for t, v in zip(texts, y.tolist()) if v == label), into)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    found = {s: marking(s, c, other.get(s, 0), n1, n0) for s, c in sorted(toxic.items())}
    return {s: v for s, v in found.items() if v}


class Reader:
    """Turns texts into features."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.seen: dict[str, int] = {}
        self.kinds: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)]
        self.kind_of: dict[tuple, int] = {self.kinds[0]: 0}

    def _kind(self, token: str) -> int:
        """A number for (insult, learned weight, second person, obfuscated)."""
        word = core(token)
        plain = token.translate(DISGUISE)
        hidden = "".join(c for c in plain if c.isalpha())
        inside = any(not c.isalpha() for c in word) and any(c.isalpha() for c in word)
        disguised = inside and hidden not in (word, "") and hidden in INSULTS
        starred = "*" in word.strip("*") and len(word) >= 4
        learned = max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0) if word else 0.0
        if disguised:
            learned = max(learned, self.lexicon.get(hidden, 0.0))
        kind = (float(word in INSULTS or disguised), learned, float(word in SECOND), float(disguised or starred))
        if kind not in self.kind_of:
            self.kind_of[kind] = len(self.kinds)
            self.kinds.append(kind)
        k = self.kind_of[kind]
        if len(self.seen) >= CACHE_WORDS:
            self.seen.clear()
        self.seen[token] = k
        return k

    def features(self, column) -> np.ndarray:
        data, bounds = hashing.buffer(column)
        n = len(bounds) - 1
        out = np.zeros((n, N_FEATURES))
        texts = column.to_pylist()
        wide = _CAPITAL[data]
        wide[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        runs = np.zeros(len(data), bool)
        runs[3:] = (data[3:] == data[2:-1]) & (data[2:-1] == data[1:-2]) & (data[1:-2] == data[:-3])
        per = {"caps": wide, "letters": _LETTER[data], "punct": _PUNCT[data], "bang": data == 33, "runs": runs}
        sums = {k: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds]) for k, v in per.items()}
        size = np.maximum(np.diff(bounds), 1)
        for i, t in enumerate(texts):
            tokens = t.lower().split()
            if not tokens:
                continue
            get = self.seen.get
            codes = [get(w, -1) for w in tokens]
            if -1 in codes:
                codes = [self._kind(w) if c < 0 else c for w, c in zip(tokens, codes)]
            codes = np.array(codes)
            at = np.flatnonzero(codes)
            kinds = np.array([self.kinds[c] for c in codes[at]]).reshape(-1, 4)
            hit, second = at[(kinds[:, 0] > 0) | (kinds[:, 1] > 0)], at[kinds[:, 2] > 0]
            if len(hit) and len(second):
                k = np.searchsorted(second, hit)
                gap = np.minimum(np.abs(second[np.minimum(k, len(second) - 1)] - hit), np.abs(second[np.maximum(k - 1, 0)] - hit))
                near = int((gap <= NEAR).sum())
            else:
                near = 0
            m = len(tokens)
            insults, learned = kinds[:, 0].sum(), (kinds[:, 1] > 0).sum()
            out[i, :10] = [
                np.log1p(m), 100 * insults / m, np.log1p(insults), 100 * learned / m, np.log1p(learned), kinds[:, 1].max(initial=0), kinds[:, 1].sum() / m,
                100 * len(second) / m, np.log1p(near), np.log1p(kinds[:, 3].sum()),
            ]
        out[:, 10] = sums["caps"] / np.maximum(sums["letters"], 1)
        out[:, 11] = sums["punct"] / size
        out[:, 12] = sums["bang"] / size
        out[:, 13] = sums["runs"] / size
        out[:, 14] = np.log1p(size)
        return out


@dataclass
class Trees:
    """Each level's feature and cut for each node of each tree, leaf values, and the first log-odds."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (1 << DEPTH) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Histogram gradient boosting of the logistic loss."""
    n, m = x.shape
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    # Rare features are zero on most rows; cuts among their other values are needed as well.
    cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, BINS)[:-1]) * (1 - 1e-9) if len(v := x[x[:, j] > 0, j]) else []])) for j, c in enumerate(cuts)]
    width = max(map(len, cuts)) + 1
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    odds = np.full(n, base)
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-odds))
        g, h = q - y, np.maximum(q * (1 - q), 1e-9)
        node = np.zeros(n, np.int64)
        f, c = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, np.inf)
        for level in range(DEPTH):
            first, k = (1 << level) - 1, 1 << level
            best = np.full(k, 1e-9)
            pick_f, pick_b = np.zeros(k, np.int64), np.full(k, -1)
            for j in range(m):
                key = (node - first) * width + binned[:, j]
                gs, hs = np.bincount(key, g, k * width).reshape(k, width), np.bincount(key, h, k * width).reshape(k, width)
                ns = np.bincount(key, minlength=k * width).reshape(k, width).cumsum(1)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], ns[:, -1:]
                gain = gl**2 / (hl + REGULAR) + (gt - gl) ** 2 / (ht - hl + REGULAR) - gt**2 / (ht + REGULAR)
                gain[(ns < MIN_LEAF) | (nt - ns < MIN_LEAF)] = -1
                at = gain.argmax(1)
                better = gain[np.arange(k), at] > best
                best[better] = gain[np.arange(k), at][better]
                pick_f[better], pick_b[better] = j, at[better]
            for i in range(k):
                if pick_b[i] >= 0 and pick_b[i] < len(cuts[pick_f[i]]):
                    f[first + i], c[first + i] = pick_f[i], cuts[pick_f[i]][pick_b[i]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > c[node])
        at = node - (1 << DEPTH) + 1
        values = -RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + REGULAR)
        odds += values[at]
        feature.append(f)
        cut.append(c)
        leaf.append(values)
    return Trees(base, np.array(feature), np.array(cut), np.array(leaf))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a non-decreasing curve, to be interpolated between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, least x, greatest x
    for v, t in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([t, 1, v, v])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s, k, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += k
            blocks[-1][3] = hi
    xs, ys = [], []
    for s, k, lo, hi in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [s / k] * (2 if hi > lo else 1)
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    curve: tuple[np.ndarray, np.ndarray]
    rate: float

    def score(self, reader: Reader, column) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.rate)
        return np.interp(self.trees.odds(reader.features(column)), *self.curve)


def folds_of(y: np.ndarray) -> np.ndarray:
    """A fold for each row; each fold has its share of either label."""
    fold = np.empty(len(y), np.int64)
    for v in (0, 1):
        fold[y == v] = np.arange((y == v).sum()) % FOLDS
    return fold


def lexicons(rows: DataFrame, fold_of: dict[int, int], y: np.ndarray, fold: np.ndarray) -> dict[frozenset, dict[str, float]]:
    """The lexicon learned without each set of at most two folds (rows: doc_id, y, text).

    Counts by fold are worked out once by the executors and added for each lexicon; of a word only counts come to the driver, and only
    if LEARN_ROWS toxic rows have it.
    """

    def run(batches):
        import pyarrow as pa

        counts: dict[tuple[int, int], dict[str, int]] = {}

        def out():
            for (k, v), found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([k * 2 + v] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["stem", "slot", "n"])
            counts.clear()

        for batch in common.sized(batches, "text", 2 << 20):
            for i, v, t in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                count([t], counts.setdefault((fold_of[i], v), {}))
            if sum(map(len, counts.values())) > COUNTED_STEMS:
                yield from out()
        yield from out()

    counted = rows.mapInArrow(run, "stem string, slot int, n long").groupBy("stem").agg(*[F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(2 * FOLDS)])
    of = counted.where(sum(F.col(f"s{2 * k + 1}") for k in range(FOLDS)) >= LEARN_ROWS).toPandas().sort_values("stem")
    names, table = of.stem.tolist(), of[[f"s{s}" for s in range(2 * FOLDS)]].to_numpy(np.int64)
    left_out = [frozenset()] + [frozenset({j, k}) for j in range(FOLDS) for k in range(j, FOLDS)]
    found = {}
    for gone in left_out:
        others = [k for k in range(FOLDS) if k not in gone]
        toxic, other = table[:, [2 * k + 1 for k in others]].sum(1), table[:, [2 * k for k in others]].sum(1)
        mine = np.isin(fold, others)
        n1, n0 = int((mine & (y == 1)).sum()), int((mine & (y == 0)).sum())
        at = np.flatnonzero(toxic >= LEARN_ROWS)
        weights = [(names[i], marking(names[i], int(toxic[i]), int(other[i]), n1, n0)) for i in at]
        found[gone] = {s: v for s, v in weights if v}
    return found


def seen_by(rows: DataFrame, fold_of: dict[int, int], known: dict[frozenset, dict[str, float]], place: dict[int, int]) -> np.ndarray:
    """Features by lexicons, of shape (FOLDS, rows, N_FEATURES): under k, each row as seen without its own fold and without fold k."""

    def run(batches):
        import pyarrow as pa

        readers = {gone: Reader(lexicon) for gone, lexicon in known.items()}
        for batch in common.sized(batches, "text", 2 << 20):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            own = np.array([fold_of[i] for i in ids])
            for k in range(FOLDS):
                for j in set(own.tolist()):
                    at = np.flatnonzero(own == j)
                    x = readers[frozenset({j, k})].features(texts.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in at]), pa.array([k] * len(at), pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "k", "x"]
                    )

    got = rows.mapInArrow(run, "doc_id long, k int, x array<double>").toPandas()
    out = np.zeros((FOLDS, len(place), N_FEATURES))
    out[got.k.to_numpy(), [place[i] for i in got.doc_id]] = np.stack(got.x.to_numpy())
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Without a row of both labels for each fold every text gets the label's rate (0 without any).

    To the driver come the sample's ids and labels, FOLDS * N_FEATURES numbers for each of its rows, and counts of words; no text.
    """
    common.small_batches(docs.sparkSession)
    rows = common.stored(labelled.chosen(docs, labels, "toxic", ~held_out("doc_id", FOLD_MODULUS, FOLD_HELD_OUT), max_rows), "toxicity-sample")
    ids = sorted(((labelled.hash_id(r.doc_id), r.doc_id, r.y) for r in rows.select("doc_id", "y").collect()))  # max_rows at most
    y = np.array([v for _, _, v in ids], np.int64)
    rate = float(y.mean()) if len(y) else 0.0
    if min((y == v).sum() for v in (0, 1)) < FOLDS:
        return Model({}, None, (np.zeros(1), np.zeros(1)), rate)
    fold = folds_of(y)
    place = {i: n for n, (_, i, _) in enumerate(ids)}
    fold_of = {i: int(fold[n]) for i, n in place.items()}
    known = lexicons(rows, fold_of, y, fold)
    x = seen_by(rows, fold_of, {gone: v for gone, v in known.items() if gone}, place)
    target, own = y.astype(float), x[fold, np.arange(len(y))]  # each row as seen without its own fold
    out = np.empty(len(y))
    for k in range(FOLDS):
        out[fold == k] = boost(x[k, fold != k], target[fold != k]).odds(own[fold == k])
    return Model(known[frozenset()], boost(own, target), isotonic(out, target), rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    A null text counts as empty; an empty text has zero for each feature and is
    scored as that. Repeated rows get equal scores. A very long text is
    read whole, alone in its batch. There are no ties to break. Other columns, whatever
    their names, are not read. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        reader = Reader(model.lexicon)
        for batch in common.sized(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(reader, batch.column("text")))], ["doc_id", "score"])

    scored = common.texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", FOLD_MODULUS, FOLD_HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

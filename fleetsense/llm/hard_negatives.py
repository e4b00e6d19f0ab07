"""Hard negatives by a vector-approximation file.

1. Of rows with one label and one vector only the first few ids can be in a list, so
   the others go (ranked within the shuffle, before it and after).
2. Each dimension is cut into cells that hold about as many rows each; the cuts are
   fitted on a bounded sample, and any cuts give right results. The file is a table
   of blocks: ids, labels, a byte for each component's cell, the vectors, and the
   least and greatest value of each dimension, which bound the outer cells.
3. Anchors, in blocks, meet groups of blocks. A table lookup gives the least and the
   greatest value of each component; their sums with the anchor bound the score from
   both sides. An anchor's list asks for the exact score only of rows that may be in
   its window and may beat what is surely in it.
4. What a group finds, at most a list's length for each anchor and window, is ranked
   over all groups.

The first pass looks for positives, of the anchor's label, without a window; the
second for negatives of other labels, in a window for each positive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Components beyond this, once scaled, could overflow a sum: their rows take no part, like those that are not finite.
GREATEST = 1 << 24
#: Cells of a dimension; rows that their cuts are fitted on.
CELLS, SAMPLE = 64, 4096
#: Rows of a block, rows of a group of blocks, anchors of a block, and anchors whose bounds are held at once.
BLOCK, GROUP, ANCHORS, STRIP = 4096, 1 << 18, 2048, 256
#: Joined blocks in one Arrow batch.
BATCH = 16
#: Candidates that are scored and listed at once.
CANDIDATES = 1 << 18
#: Less than any score.
NONE = np.int64(-(1 << 62))

_BLOCK = "dim int, n int, ids binary, labels binary, cells binary, vectors binary, least binary, greatest binary"
_ANCHOR = "dim int, anchors int, numbers binary, own binary, of binary, queries binary, low binary, high binary"


def scaled(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, x: each row once, with x as whole numbers."""
    of = F.col("embedding")
    fine = F.forall(of, lambda v: v.isNotNull() & (F.abs(v.cast("double") * SCALE) <= GREATEST))
    label = F.col("label") if label is None else label
    out = rows.select("vec_id", label.cast("long").alias("label"), F.when(fine, F.transform(of, lambda v: F.floor(v.cast("double") * SCALE).cast("int"))).alias("x"))
    return out.dropna().where(F.size("x") > 0).dropDuplicates()


def first_of_class(rows: DataFrame, keep: int) -> DataFrame:
    """The first `keep` ids of those with one label and one vector."""
    nth = F.row_number().over(Window.partitionBy("label", "x").orderBy("vec_id"))
    return rows.select("*", nth.alias("nth")).where(F.col("nth") <= keep).drop("nth")


def fit_cuts(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each number of dimensions in the sample, dimensions x (cells - 1) cuts: a value belongs to the cell after the cuts not above it."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # `sample` rows at most
    by: dict[int, list] = {}
    for x in found.x:
        by.setdefault(len(x), []).append(x)
    at = np.arange(1, cells) / cells
    return {d: np.ceil(np.quantile(np.array(v, np.float64), at, axis=0)).T for d, v in by.items()}


def _matrix(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of dimensions, the places of a list column and their values as a matrix."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(bounds)
    out = {}
    for d in np.unique(sizes):
        places = np.flatnonzero(sizes == d)
        out[int(d)] = places, flat[bounds[places][:, None] + np.arange(d)].astype(np.int32)
    return out


def _gathered(batches, rows: int):
    """Arrow tables of `rows` rows, the last one less."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _bytes(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _row(schema: str, values: list):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], [f for f, _ in fields])


def approximation_file(rows: DataFrame, cuts: dict[int, np.ndarray]) -> DataFrame:
    """The blocks of rows (vec_id, label, x), numbered by `block`."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for table in _gathered(batches, BLOCK):
            ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
            for d, (places, x) in _matrix(table.column("x")).items():
                order = np.lexsort((ids[places], labels[places]))  # one label's rows stand together
                places, x = places[order], x[order]
                cells = np.zeros(x.shape, np.uint8)
                if d in cuts:
                    for j in range(d):
                        cells[:, j] = np.searchsorted(cuts[d][j], x[:, j], "right")
                row = [block, d, len(x), _bytes(ids[places], "<i8"), _bytes(labels[places], "<i8"), cells.tobytes(), _bytes(x, "<i4"), _bytes(x.min(0), "<i4"), _bytes(x.max(0), "<i4")]
                yield _row(f"block long, {_BLOCK}", row)
                block += 1

    return rows.mapInArrow(run, f"block long, {_BLOCK}")


def anchor_blocks(anchors: DataFrame, groups: int) -> DataFrame:
    """Blocks of anchors (number, vec_id, label, x, windows), each once for each group of the file."""

    def run(batches):
        for table in _gathered(batches, ANCHORS):
            numbers, ids, labels = (table.column(c).to_numpy() for c in ("number", "vec_id", "label"))
            windows = table.column("windows").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            half = windows.shape[1] // 2
            for d, (places, x) in _matrix(table.column("x")).items():
                order = np.argsort(labels[places], kind="stable")
                places, x = places[order], x[order]
                row = [d, len(x), _bytes(numbers[places], "<i8"), _bytes(ids[places], "<i8"), _bytes(labels[places], "<i8"), _bytes(x, "<i4"), _bytes(windows[places, :half], "<i8"), _bytes(windows[places, half:], "<i8")]
                yield _row(_ANCHOR, row)

    return anchors.mapInArrow(run, _ANCHOR).select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))


def bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the least and twice the greatest score of each anchor with each row whose components lie between low and high."""
    middle, width = x @ (low + high).T, np.abs(x) @ (high - low).T
    return middle - width, middle + width


class Lists:
    """The best `length` rows seen so far of each anchor and window, by falling score and then id."""

    def __init__(self, anchors: int, windows: int, length: int):
        self.shape, self.length = (anchors, windows), length
        self.at = np.empty(0, np.int64)
        self.score, self.id = self.at.copy(), self.at.copy()
        #: The score of a full list's last row, else NONE.
        self.last = np.full(self.shape, NONE)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        at, score, ids = np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        full = nth == self.length - 1
        self.last.reshape(-1)[at[full]] = score[full]
        kept = nth < self.length
        self.at, self.score, self.id = at[kept], score[kept], ids[kept]


def search(lists: Lists, block: dict, cuts: dict[int, np.ndarray], anchor: dict, same: bool) -> None:
    """Add to the lists what a block has for a block of anchors: of the anchor's label if same, else of all others."""
    d, n = block["dim"], block["n"]
    ids, labels = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["labels"], "<i8")
    vectors = np.frombuffer(block["vectors"], "<i4").reshape(n, d).astype(np.int64)
    cells = np.frombuffer(block["cells"], np.uint8).reshape(n, d)
    least, greatest = np.frombuffer(block["least"], "<i4"), np.frombuffer(block["greatest"], "<i4")
    own, of = np.frombuffer(anchor["own"], "<i8"), np.frombuffer(anchor["of"], "<i8")
    queries = np.frombuffer(anchor["queries"], "<i4").reshape(-1, d).astype(np.int64)
    windows = lists.shape[1]
    lows, highs = (np.frombuffer(anchor[k], "<i8").reshape(-1, windows) for k in ("low", "high"))
    # Sums below 2 to the power of 53 are exact as doubles, others are taken as whole numbers.
    kind = np.float64 if 4 * d * int(np.abs(queries).max()) * int(max(abs(least.min()), abs(greatest.max()), 1)) < 1 << 53 else np.int64
    edges = cuts.get(d, np.empty((d, 0)))
    table_low = np.clip(np.column_stack([least, edges]), least[:, None], None).astype(kind)
    table_high = np.clip(np.column_stack([edges - 1, greatest]), None, greatest[:, None]).astype(kind)
    axis = np.arange(d)
    low, high = table_low[axis, cells], table_high[axis, cells]
    held: list[tuple[np.ndarray, np.ndarray, int]] = []

    def score_held() -> None:
        if held:
            a, r = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            j = np.repeat([h[2] for h in held], [len(h[0]) for h in held])
            held.clear()
            score = np.empty(len(a), np.int64)
            for k in range(0, len(a), 1 << 14):
                score[k : k + (1 << 14)] = np.einsum("ij,ij->i", queries[a[k : k + (1 << 14)]], vectors[r[k : k + (1 << 14)]])
            inside = (score >= lows[a, j]) & (score <= highs[a, j])
            lists.add((a * windows + j)[inside], score[inside], ids[r[inside]])

    for label in np.unique(of):
        mine = np.flatnonzero(of == label)
        begin, end = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
        rows = np.arange(begin, end) if same else np.concatenate([np.arange(begin), np.arange(end, n)])
        if not len(rows):
            continue
        for strip in (mine[k : k + STRIP] for k in range(0, len(mine), STRIP)):
            least2, most2 = bounds(queries[strip].astype(kind), low[rows], high[rows])
            other = own[strip][:, None] != ids[rows][None, :]
            for j in range(windows):
                lo, hi, last = lows[strip, j][:, None], highs[strip, j][:, None], lists.last[strip, j][:, None]
                need = np.maximum(last, lo) * 2
                if (last == NONE).any() and len(rows) >= lists.length:
                    sure = np.where((least2 >= 2 * lo) & (most2 <= 2 * hi) & other, least2, 2 * NONE)
                    need = np.maximum(need, np.partition(sure, len(rows) - lists.length, axis=1)[:, [len(rows) - lists.length]])
                a, r = np.nonzero((most2 >= need) & (least2 <= 2 * hi) & other)
                held.append((strip[a], rows[r], j))
                if sum(len(h[0]) for h in held) > CANDIDATES:
                    score_held()
    score_held()


def scanned(file: DataFrame, anchors: DataFrame, cuts: dict[int, np.ndarray], length: int, same: bool) -> DataFrame:
    """number, window, score, id: the first `length` rows of each anchor (number, vec_id, label, x, windows) and window."""
    spark = file.sparkSession
    n, blocks = file.agg(F.sum("n"), F.count("*")).first()
    groups = max(1, min(blocks, max(common.shuffle_parts(spark), -(-(n or 0) // GROUP))))
    asked = anchor_blocks(anchors.repartition(max(1, -(-anchors.count() // ANCHORS)), "number"), groups)
    met = asked.join(file.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).hint("merge"), ["group", "dim"])
    names = [c.split()[0] for c in f"{_ANCHOR}, {_BLOCK}".split(", ")]

    def run(batches):
        import pyarrow as pa

        lists, numbers, now = None, None, None

        def found():
            at = lists.at
            return pa.RecordBatch.from_arrays([pa.array(numbers[at // lists.shape[1]]), pa.array((at % lists.shape[1]).astype(np.int32)), pa.array(lists.score), pa.array(lists.id)], ["number", "window", "score", "id"])

        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                if row["numbers"] != now:
                    if now is not None:
                        yield found()
                    now, numbers = row["numbers"], np.frombuffer(row["numbers"], "<i8")
                    lists = Lists(len(numbers), len(row["low"]) // 8 // len(numbers), length)
                search(lists, row, cuts, row, same)
        if now is not None:
            yield found()
        common.trim()

    common.small_batches(spark, BATCH)
    parts = common.stored(met.select(*dict.fromkeys(names)).mapInArrow(run, "number long, window int, score long, id long"), "negatives-lists")
    common.small_batches(spark)
    nth = F.row_number().over(Window.partitionBy("number", "window").orderBy(F.desc("score"), "id"))
    return parts.select("*", nth.alias("rank")).where(F.col("rank") <= length)


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, embedding, label).

    is_anchor and label are expressions on vec_id and label. Rows with a null in
    vec_id, label or vector, an empty vector, or a component that is not finite or beyond
    GREATEST take no part. Rows that repeat vec_id, label and vector are one; those that repeat
    vec_id alone each take part, but never with an anchor of that id. Ties go to the lesser
    id. Vectors of different lengths have no score. Other columns are not read. An empty
    table gives no rows.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    rows = common.stored(scaled(rows, label), "negatives-rows")
    cuts = fit_cuts(rows)
    file = common.stored(approximation_file(first_of_class(rows, max(positives + 1, negatives)), cuts), "negatives-file")
    anchors = common.stored(rows.where(is_anchor).withColumn("number", F.monotonically_increasing_id()), "negatives-anchors")

    open_ = F.array(F.lit(-(1 << 60)), F.lit(1 << 60))
    best = common.stored(scanned(file, anchors.withColumn("windows", open_), cuts, positives, same=True), "negatives-positives")
    of = best.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("best"))  # `positives` at most
    # Hundredths of a score are compared as whole numbers: the window is rounded inwards.
    edge = lambda share, up: lambda i: F.coalesce(F.when(F.lit(up), -F.floor(-F.get("best", i)["score"] * share / 100)).otherwise(F.floor(F.get("best", i)["score"] * share / 100)), F.lit(1 if up else -1) * F.lit(1 << 60)).cast("long")
    each = F.sequence(F.lit(0), F.lit(positives - 1))
    asked = anchors.join(of, "number").withColumn("windows", F.concat(F.transform(each, edge(LOW, True)), F.transform(each, edge(HIGH, False)))).drop("best")
    worst = scanned(file, asked, cuts, negatives, same=False)
    named = best.join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number")
    named = named.select("number", (F.col("rank") - 1).alias("window"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return worst.join(named, ["number", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

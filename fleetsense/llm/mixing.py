"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a hashed order, are one stream of words, cut into
blocks of equal length. Slot i of the schedule has the golden-ratio point
frac(i * phi); the cumulative targets say whose slot it is. Slots are ranked
within their source: the slot of rank k takes block k, and from the stream's end
on the stream begins again. A source's slots past its target are passed over; what
the points leave open is appended. So every source's words come out at its target,
and at any place of the schedule near its share.

Ranks and stream offsets are sums over chunks and buckets, within them and over
LEVEL of them at once, so that no source, however large, is ordered in one task.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Words in a block.
BLOCK_WORDS = 512
#: Rows of one source in a bucket, about; slots in a chunk; buckets or chunks that are summed before the sums are.
BUCKET_ROWS, CHUNK_SLOTS, LEVEL = 1000, 1 << 14, 1000
#: The points repeat after so many slots; the multiplier is phi's fraction at this precision, made odd.
PERIOD, GOLDEN = 1 << 31, 1327217885
SEED = 11
#: The driver plans the sources, a row for each; a table of more rows than this is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000
WORD = r"[^ \t-\r]+"


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words that each source gives; sizes are in the order of the sources, over which the weights repeat."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sized(docs: DataFrame, *keep) -> DataFrame:
    """source, size (words; null text: 0) and the columns to keep."""
    return docs.select(*keep, F.col("source"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


class Plan:
    """What each source gives: quota words in slots of `block` words; lists are in the order of the sources."""

    def __init__(self, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS):
        rows = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()  # a row for each source
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # by code point, null last
        self.sources = [r["source"] for r in rows]
        self.words = [int(r["words"]) for r in rows]
        self.rows = [int(r["rows"]) for r in rows]
        self.targets = targets(self.words, weights, share, cap)
        self.quota = [min(math.floor(t + 0.5), math.floor(cap * n)) for t, n in zip(self.targets, self.words)]
        self.block = block
        self.blocks = [-(-n // self.block) for n in self.words]
        self.slots = [self._slots(q, n, b) for q, n, b in zip(self.quota, self.words, self.blocks)]

    def _slots(self, quota: int, words: int, blocks: int) -> int:
        if not quota:
            return 0
        passes, rest = divmod(quota, words)
        return passes * blocks + -(-rest // self.block)

    def table(self, spark) -> DataFrame:
        rows = [(i, s, self.words[i], self.targets[i], max(1, -(-self.rows[i] // BUCKET_ROWS))) for i, s in enumerate(self.sources)]
        out = spark.createDataFrame(rows, "src int, source string, source_size long, target double, buckets int")
        return F.broadcast(out) if len(rows) <= BROADCAST_SOURCES else out


def before(sums: DataFrame, index: str, value: str) -> DataFrame:
    """src, index, before: the values of the source's lesser indexes. Sums of LEVEL neighbours are summed first."""
    upper = F.expr(f"{index} div {LEVEL}").alias("upper")
    rows = sums.select("src", index, value, upper)
    within = Window.partitionBy("src", "upper").orderBy(index)
    tops = rows.groupBy("src", "upper").agg(F.sum(value).alias("all"))
    tops = tops.select("src", "upper", (F.sum("all").over(Window.partitionBy("src").orderBy("upper")) - F.col("all")).alias("above"))
    rows = rows.select("src", index, "upper", (F.sum(value).over(within) - F.col(value)).alias("beside"))
    return rows.join(tops, ["src", "upper"]).select("src", index, (F.col("above") + F.col("beside")).alias("before"))


def schedule(spark, plan: Plan) -> DataFrame:
    """slot, src, rank, block, lo, hi: the slot takes words lo to hi of its source's stream. Appended slots are numbered on from the points'."""
    total = sum(plan.slots)
    chunks = -(-total // CHUNK_SLOTS)
    edges = np.cumsum(np.array(plan.slots, np.float64)) / max(total, 1)
    slots, words, quota = (np.array(x, np.int64) for x in (plan.slots, plan.words, plan.quota))
    blocks, size, n = np.array(plan.blocks, np.int64), plan.block, len(plan.slots)

    def owners(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(chunk * CHUNK_SLOTS, min(total, (chunk + 1) * CHUNK_SLOTS), dtype=np.int64)
        x = (i % PERIOD) * GOLDEN % PERIOD / PERIOD
        return i, np.minimum(np.searchsorted(edges, x, "right"), n - 1)

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                src, count = np.unique(owners(chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(src), chunk)), "src": pa.array(src.astype(np.int32)), "n": pa.array(count)})

    counts = common.stored(spark.range(0, chunks, 1, max(1, min(chunks, common.shuffle_parts(spark)))).mapInArrow(counted, "chunk long, src int, n long"), "mix-counts")
    per_chunk = before(counts, "chunk", "n").groupBy("chunk").agg(F.collect_list(F.struct("src", "before")).alias("starts"))  # a row for each source at most
    given = dict(counts.groupBy("src").agg(F.sum("n").alias("n")).collect())

    def taken(slot: np.ndarray, src: np.ndarray, rank: np.ndarray):
        import pyarrow as pa

        due = rank < slots[src]
        slot, src, rank = slot[due], src[due], rank[due]
        turn, block = np.divmod(rank, np.maximum(blocks[src], 1))
        lo = block * size
        hi = np.minimum(np.minimum(lo + size, words[src]), quota[src] - turn * words[src])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (slot, src.astype(np.int32), rank, block, lo, hi)], ["slot", "src", "rank", "block", "lo", "hi"])

    def dealt(batches):
        for batch in batches:
            for chunk, starts in zip(batch.column("chunk").to_pylist(), batch.column("starts").to_pylist()):
                slot, src = owners(chunk)
                first = np.zeros(n, np.int64)
                for s in starts:
                    first[s["src"]] = s["before"]
                order = np.argsort(src, kind="stable")
                ranked = src[order]
                within = np.arange(len(src)) - np.searchsorted(ranked, ranked, "left")
                rank = np.empty(len(src), np.int64)
                rank[order] = within + first[ranked]
                yield taken(slot, src, rank)

    kind = "slot long, src int, rank long, block long, lo long, hi long"
    out = per_chunk.mapInArrow(dealt, kind)
    short = [(i, int(given.get(i, 0)), k) for i, k in enumerate(plan.slots) if given.get(i, 0) < k]
    if short:
        at = np.cumsum([0] + [k - a for _, a, k in short])
        gaps = spark.createDataFrame([(i, a, k, total + int(at[j])) for j, (i, a, k) in enumerate(short)], "src int, a long, k long, at long")
        ranks = gaps.select("src", "a", "at", F.explode(F.expr("sequence(a, k - 1)")).alias("rank")).select((F.col("at") + F.col("rank") - F.col("a")).alias("slot"), "src", "rank")

        def appended(batches):
            for batch in batches:
                yield taken(*(np.asarray(batch.column(c)).astype(np.int64) for c in ("slot", "src", "rank")))

        out = out.unionByName(ranks.mapInArrow(appended, kind))
    return out


def placed(sizes: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """Each row's place: src, bucket, nth (its number in the bucket) and start, its first word's offset in its source's stream.

    sizes has doc_id, source, size and perhaps a key; rows are ordered by hashes, ties by doc_id, size and key.
    """
    spark = sizes.sparkSession
    extra = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    hashed = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = sizes.alias("d").join(plan.table(spark).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    rows = rows.select("doc_id", "size", *extra, "src", "source_size", "target", F.pmod(F.shiftrightunsigned(hashed, 20), F.col("buckets").cast("long")).alias("bucket"), hashed.alias("h"))
    rows = rows.repartition(common.shuffle_parts(spark), "src", "bucket")
    order = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size", *extra)
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    inside = rows.select("*", F.row_number().over(order).alias("nth"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("inside"))
    return inside.join(before(sums, "bucket", "words"), ["src", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("h", "before", "inside")


def mix_sizes(sizes: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, size, source_size, target, taken, first, last and the extra columns of sizes, for each of its rows.

    first and last are the least and the greatest slot that takes words of the row; null if none does.
    """
    spark = sizes.sparkSession
    extra = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    if not plan.sources:
        none = {"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "taken": F.lit(0).cast("long"), "first": F.lit(0).cast("long"), "last": F.lit(0).cast("long")}
        return sizes.select("doc_id", "size", *[v.alias(k) for k, v in none.items()], *extra)
    at = common.stored(placed(sizes, plan), "mix-places")
    b = plan.block
    blocks = schedule(spark, plan).groupBy("src", "block", "lo", "hi").agg(F.count("*").alias("times"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    spans = at.where("size > 0").select("src", "bucket", "nth", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
    words = F.greatest(F.lit(0), F.least(F.col("hi"), F.col("start") + F.col("size")) - F.greatest(F.col("lo"), F.col("start")))
    both = spans.join(blocks, ["src", "block"]).withColumn("words", words).where("words > 0")
    taken = both.groupBy("src", "bucket", "nth").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("first").alias("first"), F.max("last").alias("last"))
    out = at.join(taken, ["src", "bucket", "nth"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first", "last", *extra)


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, first, last for each row of docs (doc_id, text, source).

    A null text has no words; nothing is taken of a row without words. A null
    source is a source, the last. Repeated rows have places of their own. A very long
    text is many blocks. Ties of the shuffle go to the lesser doc_id, then the lesser
    size; rows that tie in all of it are alike. Other columns, whatever their names,
    are not read. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    sizes = common.stored(sized(docs, F.col("doc_id")), "mix-sizes")
    return mix_sizes(sizes, Plan(sizes, **how))


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text), 1):
        if k > n:
            break
        end = m.end()
    return text[:end]


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in the schedule's order: each row of docs as often as it is taken, its last copy cut where the source's target ends.

    Columns are those of docs, whatever their names; n_chars, if there, follows the
    text. Partitions are stretches of the schedule, in order within themselves. Rows
    that repeat doc_id, source and text are one row, of which the words of all are
    taken. Rows without words (null or empty texts) are not in the mix. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    names, cut = docs.columns, "n_chars" in docs.columns
    parts = (F.col("doc_id").isNull(), F.col("doc_id"), F.col("source").isNull(), F.col("source"), F.col("text").isNull(), F.col("text"))
    one, two = F.xxhash64(*parts), F.xxhash64(F.lit(SEED), *parts)  # 128 bits name a row
    sizes = common.stored(sized(docs, F.col("doc_id"), one.alias("one"), two.alias("two")), "mix-sizes")
    plan = Plan(sizes, **how)
    give = mix_sizes(sizes, plan).where("taken > 0").groupBy("one", "two").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.min("first").alias("first"), F.max("last").alias("last"))
    mine = [common.free(k, docs) for k in ("one", "two", "row", "taken", "size", "first", "last", "slot")]
    one_, two_, row_, taken_, size_, first_, last_, slot_ = mine
    give = give.select(F.col("one").alias(one_), F.col("two").alias(two_), F.struct("taken", "size", "first", "last").alias(taken_))
    named = docs.select(one.alias(one_), two.alias(two_), F.struct(*[F.col(f"`{c}`") for c in names]).alias(row_))
    chosen = named.join(give, [one_, two_]).groupBy(one_, two_).agg(F.first(row_).alias(row_), F.first(taken_).alias(taken_))
    chosen = chosen.select(f"{row_}.*", F.col(taken_)["taken"].alias(taken_), F.col(taken_)["size"].alias(size_), F.col(taken_)["first"].alias(first_), F.col(taken_)["last"].alias(last_))

    def run(batches):
        import pyarrow as pa

        for batch in common.sized(batches, "text"):
            take, size, first, last = (np.asarray(batch.column(c)) for c in (taken_, size_, first_, last_))
            whole, rest = np.divmod(take, size)
            at = np.repeat(np.arange(batch.num_rows), whole)
            again = np.arange(len(at)) > np.searchsorted(at, at, "left")  # the first copy stands at the first slot, others at the last
            copies = batch.select(names).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*copies.columns, pa.array(np.where(again, last[at], first[at]))], [*names, slot_])
            some = np.flatnonzero(rest)
            if len(some):
                part = batch.select(names).take(pa.array(some))
                texts = [first_words(t, int(n)) for t, n in zip(part.column("text").to_pylist(), rest[some])]
                columns = {c: part.column(c) for c in names} | {"text": pa.array(texts, part.schema.field("text").type)}
                if cut:
                    columns["n_chars"] = pa.array([len(t) for t in texts]).cast(part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(last[some])], [*names, slot_])

    kind = StructType([*docs.schema.fields, StructField(slot_, LongType())])
    n = common.shuffle_parts(spark)
    out = chosen.mapInArrow(run, kind).repartitionById(n, F.expr(f"CAST(`{slot_}` * {n} div {max(1, sum(plan.slots))} AS INT)"))
    return out.sortWithinPartitions(slot_, "doc_id").select(*[F.col(f"`{c}`") for c in names])

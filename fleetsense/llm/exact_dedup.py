"""Exact deduplication by content sort.

1. Within each task, equal texts that stand in one Arrow batch become one
   representative that carries their ids, so a group that holds a third of all
   rows sends a few texts instead of all of them.
2. Sampled splitters range-partition the representatives by their normalised
   bytes. What is sampled goes to the driver, so it is of bounded size: the first
   PREFIX characters, and a digest that parts long runs of texts with one beginning.
   External sorting by these and then by the whole text puts equal texts next to one
   another.
3. Each text is compared with its neighbour in full; equal ones get one group.
4. Sums and the row that stays are aggregated by group, before the shuffle and after,
   and joined back to the representatives, whose ids become rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of a text that the splitters are sampled from.
PREFIX = 48


def local_groups(docs: DataFrame) -> DataFrame:
    """prefix, sha, text and the ascending ids of equal texts of one batch (null ids first)."""

    def run(batches):
        import pyarrow as pa

        for batch in common.sized(batches, "text", 8 << 20):
            groups: dict[str, list] = {}
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                groups.setdefault(t, []).append(i)
            names = list(groups)
            ids = [sorted(x, key=lambda i: (i is not None, i or 0)) for x in groups.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t[:PREFIX] for t in names], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in names], pa.string()),
                    pa.array(names, pa.string()),
                    pa.array(ids, pa.list_(pa.int64())),
                ],
                ["prefix", "sha", "text", "ids"],
            )

    return docs.mapInArrow(run, "prefix string, sha string, text string, ids array<long>")


def neighbours(ordered: DataFrame) -> DataFrame:
    """rep, group, sha, ids: equal texts that follow one another have one group number; rep numbers the rows."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        group, last = (TaskContext.get().partitionId() << 40) - 1, None
        rep = group + 1
        for batch in batches:
            numbers = np.empty(batch.num_rows, np.int64)
            for k, t in enumerate(batch.column("text").to_pylist()):
                if t != last:
                    group, last = group + 1, t
                numbers[k] = group
            reps = pa.array(np.arange(rep, rep + batch.num_rows))
            rep += batch.num_rows
            yield pa.RecordBatch.from_arrays([reps, pa.array(numbers), batch.column("sha"), batch.column("ids")], ["rep", "group", "sha", "ids"])

    return ordered.mapInArrow(run, "rep long, group long, sha string, ids array<long>")


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    Texts are equal when identical; null counts as empty. The largest doc_id of a
    group stays; a null doc_id is less than any other. Of rows that repeat that
    doc_id just one is kept. A very long text is compared whole. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    n = common.shuffle_parts(spark)
    ordered = local_groups(common.texts(docs)).repartitionByRange(n, "prefix", "sha").sortWithinPartitions("prefix", "sha", "text")
    groups = common.stored(neighbours(ordered), "dedup-groups")
    last = F.element_at("ids", -1)
    sums = groups.groupBy("group").agg(F.sum(F.size("ids").cast("long")).alias("group_size"), F.max(F.struct(last.alias("keep_id"), "rep")).alias("stays"))
    both = groups.join(sums, "group").select("ids", "sha", "group_size", F.col("stays.keep_id"), (F.col("stays.rep") == F.col("rep")).alias("mine"), F.size("ids").alias("n"))
    # A representative holds the ids of one batch at most; dealt out, a large group's rows are made by all tasks.
    rows = both.repartition(n).select("keep_id", "group_size", "sha", "mine", "n", F.posexplode("ids").alias("at", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("mine") & (F.col("at") == F.col("n") - 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is the first of its kind by the rule of duplicates(), with all their columns, whatever their names.

    Null and empty texts are one kind, of which one row stays. Rows that repeat both
    doc_id and text are one row here. An empty table gives no rows.
    """
    stays, sha, own = (common.free(c, docs) for c in ("stays", "sha", "own"))
    stay = duplicates(docs).where("kept").select(F.col("doc_id").alias(stays), F.col("text_sha256").alias(sha))
    named = docs.withColumn(own, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    kept = named.join(stay, F.col("doc_id").eqNullSafe(F.col(stays)) & (F.col(own) == F.col(sha)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)

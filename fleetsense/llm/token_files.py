"""Token ids in Parquet: a list column with dictionary or delta encoding, small pages and page indexes.

Documents are range-partitioned by doc_id, sorted, encoded, and written as one
file for each range: a file's rows ascend, and so do the files. Each row group is
small and has a column and an offset index, so a reader that wants some doc_ids,
or the metadata without the ids, reads only those pages. A small manifest, one row
for each file, holds how many ids stand before the file.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import BYTE_BPE, encoder, tokenizer_path

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
#: A manifest of more rows than this is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 500_000

FILE_SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) and write `path`/ids and `path`/manifest.

    A null text counts as empty: the end id alone. Rows with equal doc_id stand
    in the order of their texts; null doc_ids come first. An empty table gives
    files without rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    source = tokenizer or tokenizer_path(BYTE_BPE)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        enc = encoder(source, False)
        for batch in common.sized(batches, "text"):
            raw, counts = enc.encode(batch.column("text"))
            ids = np.insert(raw, np.cumsum(counts), np.uint32(end_id)).astype(np.int32)
            counts = counts + 1
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part, np.int32)), batch.column("doc_id"), pa.array(before + ends - counts), pa.array(counts), lists],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids"],
            )
            before += int(ends[-1])

    ordered = common.texts(docs).repartitionByRange(common.shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(run, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(f"{path}/ids")
    )
    files = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/ids").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first"), F.sum("n_tokens").alias("tokens"))
    order = Window.orderBy("first", "part")  # one row for each file
    files.select("part", "tokens", (F.sum("tokens").over(order) - F.col("tokens")).alias("before")).coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, condition=None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; the condition on doc_id is pushed down to the pages."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/ids")
    if condition is not None:
        rows = rows.where(condition)
    manifest = spark.read.schema("part int, tokens long, before long").parquet(f"{path}/manifest").select("part", "before")
    if manifest.count() <= BROADCAST_ROWS:
        manifest = F.broadcast(manifest)
    return rows.join(manifest, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers)."""
    common.small_batches(tokens.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("ids")
            offsets = np.asarray(lists.offsets).astype(np.int64)
            view = memoryview(np.ascontiguousarray(np.asarray(lists.values)).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, shared_dir, stored  # noqa: F401  used as common.stored and so on

#: Rows in one Arrow batch: texts may be long, so few rows keep a worker's memory small.
BATCH_ROWS = 1000
#: And about so many bytes, where rows are long: both the executor and the worker hold a batch whole.
ROWS_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ROWS_BYTES))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until none of the frames has such a column (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null as empty) and the columns to keep; others, whatever their names, are left behind."""
    return docs.select(*[F.col(f"`{c}`") for c in ("doc_id", *keep)], F.coalesce(F.col("text"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sized(batches, column: str, limit: int = 4 << 20, rows: int = 20_000):
    """Arrow batches dealt anew: each holds about `limit` bytes of a text column, or one longer text.

    Both cuts depend on the rows alone, so a task that runs again deals alike.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute

    held, size, n = [], 0, 0
    for batch in batches:
        lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(np.cumsum(lengths[at:]), limit - size, "right"))
            end = min(batch.num_rows, at + min(fit, rows - n))
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(lengths[at:end].sum())
                n += end - at
                at = end
            if at < batch.num_rows:
                if not held:
                    held, at = [batch.slice(at, 1)], at + 1
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, n = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held = []
    trim()


def trim() -> None:
    """Give memory that a worker has freed back to the system: workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)

"""A bounded sample of labelled rows, chosen by a hash of doc_id, for fitting on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most: the one bound of the sample. Their whole texts come to the driver.
MAX_ROWS = 4000


def chosen(docs: DataFrame, labels: DataFrame, label: str, learn=None, max_rows: int = MAX_ROWS) -> DataFrame:
    """The sample as a table: doc_id, y (0 or 1), text.

    learn: a condition on doc_id. Rows with a null id, label or text are left
    out; of repeated ids the least label and text count. Ties of the hash go to the
    lesser id. Only doc_id, text and the label are read, so other columns may have any
    name. Empty tables give an empty sample.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if learn is not None:
        ids = ids.where(learn)
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")  # ids has max_rows rows at most
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn=None, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels (0 or 1) and doc_ids of the chosen rows, in ascending order of a hash of doc_id."""
    rows = chosen(docs, labels, label, learn, max_rows).toPandas()
    rows = rows.assign(h=[hash_id(i) for i in rows.doc_id]).sort_values(["h", "doc_id"])
    return rows.text.tolist(), rows.y.to_numpy(np.int64), rows.doc_id.to_numpy(np.int64)


def hash_id(doc_id: int) -> int:
    """A fixed order of ids that has nothing to do with their size."""
    x = (int(doc_id) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF

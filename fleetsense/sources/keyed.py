"""A table by key that changes in place: rows in hash buckets, a manifest for each version, copy-on-write.

    <path>/data/<version>-<name>/bucket=<b>/...   what a change wrote anew, in a folder of its own
    <path>/manifest/v=<version>/...               one file: (version, bucket, written), the folder of each bucket of that version

A change rewrites the buckets of its keys and no others. Its manifest is written last, as one file
that is renamed into place, so a version is there as a whole or not at all; what a failed change has
written lies unused. Of two writers that begin from one version the second one fails, as the
manifest is there, and the first one's rows are as it wrote them. Earlier versions stay readable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_MANIFEST = "version long, bucket int, written string"


class KeyedTable:
    """key: the column that names a row. Null is a key like others."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifests(self) -> DataFrame:
        """(version, bucket, written) of all versions."""
        try:
            return self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], _MANIFEST)
            raise

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def _where(self, version: int) -> dict[int, str]:
        """The folder of each bucket of a version: a row for each bucket."""
        return {r.bucket: r.written for r in self.manifests().where((F.col("version") == version) & (F.col("bucket") >= 0)).collect()}

    def _rows(self, where: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(where.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest by default)."""
        now = self.version()
        version = now if version is None else version
        if not 0 <= version <= now:
            raise ValueError(f"version {version} of {now}")
        return self._rows(self._where(version))

    def _commit(self, version: int, rows: DataFrame, kept: dict[int, str]) -> int:
        folder = f"{version}-{uuid.uuid4().hex}"
        data = f"{self.path}/data/{folder}"
        dealt = rows.select(*self.schema.names, self._bucket().alias("bucket"))
        dealt.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(data)
        written = [r.b for r in self._written(data).select(self._bucket().alias("b")).distinct().collect()]
        # Bucket -1 stands for the version itself, which may hold no rows.
        entries = [(version, -1, folder), *[(version, b, v) for b, v in kept.items()], *[(version, b, folder) for b in written]]
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/v={version}")
        return version

    def _written(self, data: str) -> DataFrame:
        try:
            return self.spark.read.option("recursiveFileLookup", "true").schema(self.schema).parquet(data)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):  # no row, no folder
                return self.spark.createDataFrame([], self.schema)
            raise

    def _changed(self, changes: DataFrame) -> tuple[int, dict[int, str], dict[int, str]]:
        version = self.version()
        where = self._where(version)
        touched = {r.b for r in changes.select(self._bucket().alias("b")).distinct().collect()}  # buckets at most
        return version + 1, {b: v for b, v in where.items() if b in touched}, {b: v for b, v in where.items() if b not in touched}

    def upsert(self, changes: DataFrame) -> int:
        """Rows of the table's columns replace those of their keys or are added; the new version. A key that stands twice is an error."""
        if not changes.groupBy(self.key).count().where("count > 1").isEmpty():
            raise ValueError("a key stands twice among the changes")
        version, old, kept = self._changed(changes)
        named = changes.select(F.col(self.key).alias("_key"))
        stay = self._rows(old)
        stay = stay.join(named, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        return self._commit(version, stay.unionByName(changes.select(*self.schema.names)), kept)

    def delete(self, keys: DataFrame) -> int:
        """Rows whose key is among keys (a column of the key's name) go; the new version."""
        version, old, kept = self._changed(keys)
        named = keys.select(F.col(self.key).alias("_key"))
        return self._commit(version, self._rows(old).join(named, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti"), kept)

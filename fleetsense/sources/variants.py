"""Documents whose fields change: JSON texts kept as VARIANT in Parquet, shredded into columns where they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(bodies: DataFrame, body: str = "body", doc: str = "doc") -> DataFrame:
    """bodies with a VARIANT column in place of the text, and `bad`: a text that is no JSON, or that names a key twice in one object; else null.

    A null text is a null document and not bad.
    """
    found = F.try_parse_json(F.col(body))
    rest = [c for c in bodies.columns if c != body]
    return bodies.select(*rest, found.alias(doc), F.when(found.isNull(), F.col(body)).alias("bad"))


def stored_documents(bodies: DataFrame, path: str, body: str = "body") -> DataFrame:
    """Append the documents to the table at path and give back all of it. Files written with other fields stay as they are: each is shredded by its own fields."""
    parsed(bodies, body).write.mode("append").parquet(path)
    return bodies.sparkSession.read.parquet(path)


def fields(docs: DataFrame, wanted: dict[str, tuple[str, str]], *keep: str, doc: str = "doc") -> DataFrame:
    """keep, and a column for each name of wanted (path, type). A path that a document lacks, or whose value has no such type, gives null.

    Only the shredded columns of these paths are read, where the files have them.
    """
    return docs.select(*keep, *[F.try_variant_get(doc, path, kind).alias(name) for name, (path, kind) in wanted.items()])


def drift(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """field, type, documents: of how many documents a top field has which type (object, array, number, string, boolean, null).

    Documents that are no objects have no fields.
    """
    rows = docs.select(F.col(doc).alias("doc")).where(F.schema_of_variant("doc").startswith("OBJECT"))
    each = docs.sparkSession.sql("SELECT f.key AS field, schema_of_variant(f.value) AS kind FROM {rows}, LATERAL variant_explode(doc) AS f", rows=rows)
    kind = F.col("kind")
    simple = (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    )
    return each.groupBy("field", simple.alias("type")).agg(F.count("*").alias("documents"))

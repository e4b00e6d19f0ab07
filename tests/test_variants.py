import json

from pyspark.sql import functions as F

from fleetsense.sources import variants as V

BODIES = [
    (1, '{"a": 1, "b": {"c": 1.5, "d": [1, "x", null]}, "new": true}'), (2, '{"a": "one", "b": {"c": "2.5"}}'), (3, '{"a": 3.25}'), (4, "{broken"), (5, None), (6, "[1, 2]"), (7, '"text"'),
    (8, '{"a": 1, "a": 2}'), (9, '{}'), (10, '{"ü": "' + "é" * 5000 + '", "a": null}'), (11, ""), (12, "null"),
]


def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = spark.createDataFrame(BODIES, "id long, body string")
    V.stored_documents(rows.where("id <= 2"), path)
    return V.stored_documents(rows.where("id > 2"), path)


def test_unknown_fields_survive(spark, tmp_path):
    got = {r.id: (r.text, r.bad) for r in docs(spark, tmp_path).select("id", F.to_json("doc").alias("text"), "bad").collect()}
    assert len(got) == len(BODIES)
    for i, body in BODIES:
        if i in (4, 8, 11):
            assert got[i] == (None, body)
        else:
            assert got[i][1] is None and (json.loads(got[i][0]) if got[i][0] is not None else None) == (json.loads(body) if body else None)


def test_fields_by_path_and_type(spark, tmp_path):
    wanted = {"a": ("$.a", "double"), "text": ("$.a", "string"), "c": ("$.b.c", "double"), "x": ("$.b.d[1]", "string"), "none": ("$.z", "int")}
    got = {r.id: tuple(r)[1:] for r in V.fields(docs(spark, tmp_path), wanted, "id").collect()}
    assert got[1] == (1.0, "1", 1.5, "x", None) and got[2] == (None, "one", 2.5, None, None) and got[3] == (3.25, "3.25", None, None, None)
    assert all(got[i] == (None,) * 5 for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))


def test_drift_counts_types(spark, tmp_path):
    got = {(r.field, r.type): r.documents for r in V.drift(docs(spark, tmp_path)).collect()}
    assert got == {("a", "number"): 2, ("a", "string"): 1, ("a", "null"): 1, ("b", "object"): 2, ("new", "boolean"): 1, ("ü", "string"): 1}
    assert V.drift(V.parsed(spark.createDataFrame([], "id long, body string"))).count() == 0


def test_only_the_wanted_fields_are_read(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = spark.range(3000).select("id", F.format_string('{"a":%d,"long":"%s"}', "id", F.repeat(F.md5(F.col("id").cast("string")), 20)).alias("body"))
    out = V.fields(V.stored_documents(rows, path), {"a": ("$.a", "bigint")}, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "doc:struct<0:bigint>" in plan
    assert out.agg(F.sum("a")).first()[0] == sum(range(3000))

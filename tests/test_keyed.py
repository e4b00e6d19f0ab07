import pytest
from pyspark.sql import functions as F

from fleetsense.functions import sql
from fleetsense.operators import routing
from fleetsense.plans import catalogue
from fleetsense.plans.catalogue import _requests
from fleetsense.sources.keyed import KeyedTable
from fleetsense.sources.views import Tables

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, name string"


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    return KeyedTable(spark, str(tmp_path / "t"), "id", df.schema, 8)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions(spark, table):
    assert table.version() == 0 and rows(table.read()) == []
    assert table.upsert(spark.range(200).select("id", F.lit("a").alias("name"))) == 1
    changes = spark.createDataFrame([(3, "b"), (None, "none"), (500, "new")], SCHEMA)
    assert table.upsert(changes) == 2
    want = {**{k: "a" for k in range(200)}, 3: "b", None: "none", 500: "new"}
    assert rows(table.read()) == sorted(want.items(), key=repr)
    assert table.delete(spark.createDataFrame([(None,), (4,), (999,)], "id long")) == 3
    del want[None], want[4]
    assert rows(table.read()) == sorted(want.items(), key=repr)
    assert rows(table.read(1)) == sorted(((k, "a") for k in range(200)), key=repr) and table.read(2).count() == 202
    with pytest.raises(ValueError):
        table.read(4)


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(spark.range(1000).select("id", F.lit("a").alias("name")))
    table.upsert(spark.createDataFrame([(7, "b")], SCHEMA))
    written = {r.bucket: r.written for r in table.manifests().where("version = 2 AND bucket >= 0").collect()}
    assert len(written) == 8 and sorted(w.split("-")[0] for w in written.values()) == ["1"] * 7 + ["2"]
    assert spark.read.parquet(f"{table.path}/data/{max(written.values())}").count() < 250


def test_a_failed_change_leaves_the_version(spark, table):
    table.upsert(spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA))
    broken = spark.createDataFrame([(1, "b")], SCHEMA).select("id", F.expr("raise_error('lost')").cast("string").alias("name"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, "b"), (1, "c")], SCHEMA))
    assert table.version() == 1 and rows(table.read()) == [(1, "a"), (2, "a")]
    assert table.upsert(spark.createDataFrame([(1, "d")], SCHEMA)) == 2 and rows(table.read()) == [(1, "d"), (2, "a")]


def test_the_second_of_two_writers_fails(spark, table):
    table.upsert(spark.createDataFrame([(1, "a")], SCHEMA))
    other = KeyedTable(spark, table.path, "id", table.schema, 8)
    other.version = lambda: 1  # it began before
    table.upsert(spark.createDataFrame([(1, "b")], SCHEMA))
    with pytest.raises(Exception, match="EXISTS"):
        other.upsert(spark.createDataFrame([(1, "c")], SCHEMA))
    assert table.version() == 2 and rows(table.read()) == [(1, "b")]


def test_all_deleted(spark, table):
    table.upsert(spark.createDataFrame([(1, "a")], SCHEMA))
    table.delete(spark.createDataFrame([(1,)], "id long"))
    assert table.version() == 2 and rows(table.read()) == []


def test_route_by_sql_is_the_grouped_map(spark):
    got = catalogue.queries()["routes_by_sql"](spark, SF)
    want = routing.optimal_route(_requests(Tables(spark, SF)))
    assert rows(got.select(*want.columns)) == rows(want)


def test_sql_functions_are_expressions(spark):
    sql.register(spark)
    plan = spark.sql("SELECT haversine_m(a, b, 1D, 2D) FROM (SELECT id + 0.5D AS a, id + 1D AS b FROM range(3))")._jdf.queryExecution().optimizedPlan().toString()
    assert "asin" in plan.lower() and "haversine_m" not in plan.replace("AS haversine_m", "").replace("haversine_m(", "")

"""DDL, sweep configurations, estimates, timed runs."""

import pytest
from pyspark.sql import types as T

from plumbline.bench import config, estimate, runs
from plumbline.sources.ddl import parse_ddl
from plumbline.validation import differences


def test_inline_keys():
    s = parse_ddl("CREATE TABLE t (id INT PRIMARY KEY, U VARCHAR(10) UNIQUE, x INT NOT NULL)")["t"]
    assert [(f.name, f.dataType, bool(f.metadata.get("unique"))) for f in s] == [("id", T.IntegerType(), True), ("u", T.StringType(), True), ("x", T.IntegerType(), False)]
    assert not s["x"].nullable


def test_table_keys_and_composites():
    s = parse_ddl("CREATE TABLE s.t (id INT, name VARCHAR, d DECIMAL(15,2), PRIMARY KEY (id), CONSTRAINT uq UNIQUE (name))")["t"]
    assert [bool(f.metadata.get("unique")) for f in s] == [True, True, False] and s["d"].dataType == T.DoubleType()
    s = parse_ddl("create table t (a INT, b INT, primary key (a, b))")["t"]
    assert not any(f.metadata for f in s)


def test_several_statements_and_faults():
    found = parse_ddl("-- note\nCREATE TABLE t1 (id INT PRIMARY KEY, v VARCHAR);\nCREATE TABLE t2 (k BIGINT, x DECIMAL, d DATE);")
    assert [f.dataType for f in found["t2"]] == [T.LongType(), T.DoubleType(), T.DateType()] and list(found) == ["t1", "t2"]
    with pytest.raises(KeyError):
        parse_ddl("CREATE TABLE t (a BLOB)")
    with pytest.raises(ValueError):
        parse_ddl("DROP TABLE t")


def test_config_defaults_and_faults():
    c = config.parse_config({"dataset": "d", "queries": ["q"]})
    assert (c.repeat, c.query_timeout, c.validate) == (6, 1800, True)
    for raw in ({"dataset": "d"}, {"dataset": "d", "queries": [], "colour": 1}, {"dataset": "d", "queries": [], "query_overrides": [{"codec": ["x"]}]}, {"dataset": "d", "queries": [], "query_overrides": [{"queries": ["q"], "repeat": [1]}]}):
        with pytest.raises(ValueError):
            config.parse_config(raw)


def test_overrides_replace_and_merge():
    c = config.parse_config({"dataset": "d", "queries": ["a", "b"], "shuffle_partitions": [1], "query_overrides": [{"queries": ["a"], "shuffle_partitions": [8, 4]}, {"queries": ["a", "c"], "shuffle_partitions": [4, 2]}]})
    assert config.parameters_of(c, "a")["shuffle_partitions"] == [8, 4, 2] and config.parameters_of(c, "b")["shuffle_partitions"] == [1]
    assert len(config.combinations(c, "a")) == 3


def test_equal_combinations_run_once():
    c = config.parse_config({"dataset": "d", "queries": ["a"], "storage": ["parquet_file", "system_memory"], "codec": ["zstd", "snappy"]})
    assert len(config.combinations(c, "a")) == 3


@pytest.mark.parametrize("path, sf", [("/x/sf0.01/t", 0.01), ("SF-1k", 1000), ("/d/sf_100", 100), ("/a/sf10/sf2", 2)])
def test_scale_factor(path, sf):
    assert estimate.scale_factor(path) == sf


def test_estimates():
    assert estimate.key_type("sf357") == T.LongType() and estimate.key_type("sf356") == T.IntegerType() and estimate.key_type("sf1/id64") == T.LongType()
    with pytest.raises(ValueError):
        estimate.scale_factor("/none")
    schema = parse_ddl("CREATE TABLE t (a INT, b BIGINT, c VARCHAR)")["t"]
    assert estimate.width(schema) == 37 and estimate.table_bytes("nation", schema, 100) == 925 and estimate.table_bytes("orders", schema, 2) == 111_000_000


def test_sweep_records_good_and_failed_runs(spark, sf):
    def broken(spark, sf):
        raise RuntimeError("no")

    queries = {"good": lambda s, d: s.range(10), "broken": broken}
    c = config.parse_config({"dataset": sf, "queries": ["good", "broken"], "repeat": 3, "shuffle_partitions": [2, 3]})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = runs.sweep(spark, c, queries).cache()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert found.where("query = 'good'").count() == 6 and found.where("error IS NOT NULL").count() == 2
    assert [r.n for r in runs.statistics(found).collect()] == [2, 2]
    assert runs.best(found).count() == 1 and runs.failed(found).count() == 2 and runs.flaky(found, 3).count() == 0 and runs.flaky(found, 9).count() == 2


def test_slow_runs_are_stopped_and_the_rest_goes_on(spark, sf, tmp_path):
    def slow(spark, sf):
        return spark.range(0, 10**13, 1, 2).selectExpr("sum(id % 7)")

    queries = {"slow": slow, "good": lambda s, d: s.read.parquet(f"{d}/nation.parquet")}
    c = config.parse_config({"dataset": sf, "queries": ["slow", "good"], "repeat": 2, "query_timeout": 2})
    found = {(r.query, r.number): r.error for r in runs.sweep(spark, c, queries, records=str(tmp_path / "records")).collect()}
    assert found == {("slow", 0): "timeout of 2 s", ("good", 0): None, ("good", 1): None}
    again = runs.sweep(spark, c, {}, records=str(tmp_path / "records"))  # all are there, so no query is run
    assert again.count() == 3
    best = runs.run_best(spark, c, queries, again).collect()
    assert [(r.query, r.error) for r in best] == [("good", None)] * 2


def test_storage_is_applied(spark, sf):
    plans = {}

    def query(spark, sf):
        df = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey > 3")
        plans.setdefault("InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString(), 0)
        return df

    c = config.parse_config({"dataset": sf, "queries": ["q"], "repeat": 1, "storage": ["parquet_file", "system_memory"]})
    assert runs.sweep(spark, c, {"q": query}).where("error IS NULL").count() == 2 and set(plans) == {False, True}
    plans.clear()
    query(spark, sf)
    assert set(plans) == {False}  # nothing stays in the cache


def test_differences():
    assert differences([{"a": 1}, {"a": 2}], [{"a": 2}, {"a": 1}]) == "" and "against" in differences([{"a": 1}, {"a": 2}], [{"a": 2}, {"a": 1}], in_order=True)
    assert differences([{"a": 1, "b": 2.0}], [{"b": 2.0000000001, "a": 1}]) == ""
    assert "rows" in differences([], [{"a": 1}]) and "columns" in differences([{"a": 1}], [{"b": 1}]) and differences([{"a": 1}], [{"a": 2}])

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.expressions import cast, date_literal, date_part, expr, if_then_else, like, like_column, literal, ref, substr, substr_column
from plumbline.operators.relation import Relation, read
from plumbline.sources.catalog import Catalog


@pytest.fixture(scope="module")
def pair(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "k int, v string")
    return Relation(left), Relation(right)


def rows(relation, names=None):
    return sorted((tuple(r) for r in relation.to_df(names or [f"c{i}" for i in range(len(relation.names))]).collect()), key=str)


@pytest.mark.parametrize("method", ["broadcast_join", "shuffle_join"])
def test_joins(pair, method):
    left, right = pair
    join = lambda kind: rows(getattr(left, method)(right, ref(0) == ref(2), kind=kind))
    assert join("inner") == [(2, "b", 2, "x")] * 2
    assert join("left_semi") == [(2, "b")] * 2
    assert join("left_anti") == sorted([(1, "a"), (None, "c")], key=str)
    assert len(join("left")) == 4 and len(join("full")) == 6


def test_join_filters_and_projection(pair):
    left, right = pair
    got = left.shuffle_join(right, (ref(0) == ref(2)) & (ref(1) != ref(3)), [3, 1], left_filter=ref(1) != "a", right_filter=ref(3) == "x")
    assert rows(got) == [("x", "b")] * 2


def test_unknown_kinds(pair):
    left, right = pair
    with pytest.raises(ValueError):
        left.shuffle_join(right, ref(0) == ref(2), kind="cross")
    with pytest.raises(ValueError):
        left.aggregate([0], [("median", 1)])
    with pytest.raises(TypeError):
        left.aggregate([0], [("sum", "k")])
    with pytest.raises(ValueError):
        left.sort([(0, "up", "before")])
    with pytest.raises(ValueError):
        left.fetch(-1, 2)


def test_aggregates(pair):
    left, _ = pair
    assert rows(left.aggregate([], [("count_all", 0), ("count_valid", 0), ("sum", 0), ("min", 1), ("avg", 0)])) == [(4, 3, 5, "a", 5 / 3)]
    assert rows(left.aggregate([0], [])) == sorted([(1,), (2,), (None,)], key=str)
    assert rows(left.aggregate([0], [("count_all", 0)], condition=ref(1) == "b")) == [(2, 2)]


def test_sort_and_fetch(pair):
    left, _ = pair
    order = lambda nulls: [r[0] for r in left.sort([(0, "descending", nulls)]).to_df().collect()]
    assert order("before") == [None, 2, 2, 1] and order("after") == [2, 2, 1, None]
    assert [r[0] for r in left.sort([(0, "ascending", "after")]).fetch(2, 5).to_df().collect()] == [2, None]


def test_union_all_keeps_duplicates(pair):
    left, right = pair
    assert len(rows(left.union_all(right))) == 7


def test_empty_table(spark):
    empty = Relation(spark.createDataFrame([], "k int, v string"))
    assert rows(empty.aggregate([], [("count_all", 0), ("sum", 0)])) == [(0, None)]
    assert rows(empty.sort([(0, "ascending", "before")]).fetch(0, 3)) == []


def value(spark, build, data=(("abcdef",),), schema="s string"):
    df = spark.createDataFrame(list(data), schema)
    return df.select((build if not callable(build) else build(F.col(df.columns[0]))).alias("x")).first()["x"]


def test_substr_counts_from_zero(spark):
    assert [value(spark, lambda c, s=s: substr_column(c, s, 2)) for s in (0, 1, 5)] == ["ab", "bc", "f"]
    with pytest.raises(ValueError):
        substr_column(F.lit("a"), -1, 1)


def test_like_escapes(spark):
    assert value(spark, lambda c: like_column(c, "a!%b", "!"), [("a%b",)]) is True
    assert value(spark, lambda c: like_column(c, "a!%b", "!"), [("axb",)]) is False
    assert value(spark, lambda c: like_column(c, "a\\_"), [("a\\x",)]) is True  # no escape: the backslash is itself


def test_literals(spark):
    types = [Relation(spark.range(1)).project([literal(v)]).df.dtypes[0][1] for v in (1, np.int64(1), 1.0, np.float32(1), "s", True)]
    assert types == ["int", "bigint", "double", "float", "string", "boolean"]
    with pytest.raises(NotImplementedError):
        literal(None)
    assert rows(Relation(spark.range(1)).project([expr(3) / 2, if_then_else(ref(0) > 0, "y", "n")])) == [(1.5, "n")]


def test_date_parts(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-07 01:02:03.456789' AS t, CAST(NULL AS TIMESTAMP_NTZ) AS n")
    parts = ["year", "month", "day", "weekday", "hour", "minute", "second", "millisecond", "nanosecond"]
    assert rows(Relation(df).project([date_part(ref(0), p) for p in parts])) == [(2024, 1, 7, 7, 1, 2, 3, 456, 0)]
    assert rows(Relation(df).project([date_part(ref(1), p) for p in parts])) == [(None,) * 9]
    with pytest.raises(ValueError):
        date_part(ref(0), "century")


def test_cast_and_like_and_dates(spark):
    df = Relation(spark.sql("SELECT '12' AS s, DATE '2020-02-29' AS d"))
    got = df.project([cast(ref(0), "int64"), cast(ref(0), "float64"), like(ref(0), "1_"), ref(1) == date_literal("2020-02-29"), substr(ref(0), 1, 5)])
    assert rows(got) == [(12, 12.0, True, True, "2")]
    with pytest.raises(ValueError):
        cast(ref(0), "int8")


def test_catalog(spark, sf, tmp_path):
    catalog = Catalog(spark)
    catalog.register_dataset(sf, ddl="CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR)")
    assert catalog.table_names() == ["nation"] and catalog.column_names("nation") == ["n_nationkey", "n_name"] and catalog.unique_columns("nation") == ["n_nationkey"]
    with pytest.raises(ValueError, match="unable to find column name"):
        read(catalog, "nation", ["n_nationkey", "n_colour"])
    with pytest.raises(ValueError):
        catalog.register("x", f"{sf}/nation.parquet", storage="tape")
    with pytest.raises(KeyError):
        catalog.table("none")
    script = tmp_path / "q.sql"
    script.write_text("-- a comment\nSELECT 1;\nSELECT count(*) AS n FROM nation;")
    assert catalog.run_file(str(script)).first().n == 25
    cached = catalog.register("r", f"{sf}/region.parquet", storage="device_memory")
    assert cached.count() == 5 and cached.is_cached
    cached.unpersist()


def test_sink_and_plan(spark, tmp_path):
    from plumbline.sources.catalog import log_plan, write_result

    df = spark.range(100).repartition(4)
    write_result(df, str(tmp_path / "out"), single_file=True)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 1 and spark.read.parquet(str(tmp_path / "out")).count() == 100
    assert "Exchange" in log_plan(df, str(tmp_path / "plans" / "p.txt")) and (tmp_path / "plans" / "p.txt").exists()


def test_transform_takes_a_users_operator(spark):
    from plumbline.operators.relation import Relation

    r = Relation(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"))
    got = r.transform(lambda df: df.groupBy("k").count(), ["key", "n"]).sort([(0, "ascending", "before")]).to_df()
    assert got.columns == ["key", "n"] and [tuple(x) for x in got.collect()] == [(1, 2), (2, 1)]

"""Each registered query against its SQL twin in DuckDB."""

import pytest

from plumbline.plans import operator_queries, tpch, tpch_oracle
from plumbline.sources.catalog import log_plan
from plumbline.validation import differences, oracle

QUERIES = tpch.QUERIES | operator_queries.QUERIES
SQL = tpch_oracle.ORACLE_SQL | operator_queries.ORACLE_SQL


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, sf, name):
    ours = [r.asDict() for r in QUERIES[name](spark, sf).collect()]
    assert differences(ours, oracle(sf, SQL[name])) == ""


@pytest.mark.parametrize("one, two", [("q02", "q02_ff"), ("q03", "q03_ff"), ("q10", "q10_opt"), ("q12", "q12_shuffle"), ("q13", "q13_opt"), ("q13", "q13_fused"), ("q16", "q16_opt"), ("q18", "q18_opt"), ("q21", "q21_opt"), ("q22", "q22_opt")])
def test_variants_are_equal(spark, sf, one, two):
    rows = [[r.asDict() for r in QUERIES[f"tpch_{n}"](spark, sf).collect()] for n in (one, two)]
    assert differences(*rows) == ""


def plan(df):
    return df._jdf.queryExecution().toString()


def test_late_filters_reach_the_scans(spark, sf):
    text = plan(tpch.q03_ff(spark, sf))
    assert "EqualTo(c_mktsegment,BUILDING)" in text


def test_pushed_filter_and_pruned_columns(spark, sf, tmp_path):
    text = log_plan(operator_queries.scan_filter_pushdown(spark, sf), str(tmp_path / "plan.txt"))
    assert "GreaterThan(l_quantity,45.0)" in text and "l_extendedprice" not in text.rpartition("ReadSchema")[2]


def test_hints_choose_the_join(spark, sf):
    assert "ShuffledHashJoin" in plan(operator_queries.join_shuffle_hash(spark, sf))
    assert "SortMergeJoin" in plan(operator_queries.join_sort_merge(spark, sf))
    assert "BroadcastHashJoin" in plan(operator_queries.join_broadcast(spark, sf))


def test_repartition_is_the_only_exchange(spark, sf):
    text = operator_queries.repartition_hash(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_topk_sorts_within_tasks(spark, sf):
    assert "TakeOrderedAndProject" in plan(operator_queries.topk(spark, sf))


def test_nulls_come_before_all_values(spark):
    """At sf0.1 there are more nulls than a top-300 holds; values must follow them, largest first."""
    rows = operator_queries.QUERIES["sort_nulls_whole"](spark, "/root/testdata/sf0.1").collect()
    nulls, values = [r.c_custkey for r in rows if r.bal is None], [r.bal for r in rows if r.bal is not None]
    assert len(rows) == 15_000 and len(nulls) == 2143 and values == sorted(values, reverse=True)
    assert [r.c_custkey for r in rows[:2143]] == sorted(nulls)

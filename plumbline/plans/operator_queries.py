"""A registered query for each operator of the inventory, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import cast, date_literal, date_part, date_part_column, if_then_else, like, like_column, literal, ref, substr, substr_column
from ..operators import analysis
from ..operators.relation import Relation, read
from ..session import table
from ..sources.catalog import Catalog
from ..sources.shared import through_parquet
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

col, lit = F.col, F.lit


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = X.with_fixtures(sql)
        return f

    return register


def catalog(spark: SparkSession, sf: str, *names: str) -> Catalog:
    c = Catalog(spark)
    for name in names:
        c.register(name, f"{sf}/{name}.parquet", view=False)
    return c


# Scans, sinks and storage


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def scan_project(spark, sf):
    return read(catalog(spark, sf, "orders"), "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"]).to_df()


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_quantity > 45")
def scan_filter_pushdown(spark, sf):
    """The scan's hint is by place in the whole table; the filter reaches the Parquet reader."""
    lines = read(catalog(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_quantity"], partial_filter=(ref(10) >= date_literal("2001-01-01")) & (ref(4) > 45))
    return lines.to_df()


@query("SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def scan_cached_table(spark, sf):
    """An in-memory table, held by Spark's columnar cache."""
    orders = Catalog(spark).register("orders", f"{sf}/orders.parquet", storage="system_memory", view=False)
    return orders.groupBy("o_orderpriority").agg(F.count(lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_name, r_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def sql_text(spark, sf):
    """SQL text over registered views: parse, analyse, optimize and plan are Spark's."""
    Catalog(spark).register_dataset(sf, ["customer", "nation", "region"])
    return spark.sql("SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")


@query("SELECT p_partkey, p_name, CAST(p_size AS INT) AS p_size, p_retailprice FROM part")
def ddl_registered_table(spark, sf):
    """A table whose schema is given by DDL."""
    ddl = "CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_name VARCHAR(55), p_size INT, p_retailprice DECIMAL(15,2))"
    return Catalog(spark).register_dataset(sf, ddl=ddl).table("part").select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("SELECT l_suppkey, l_returnflag, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2")
def sink_round_trip(spark, sf):
    """A result written as Parquet in the shared folder and read back."""
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return through_parquet(sums, "sink")


_STATISTICS = """SELECT '{0}' AS column_name, COUNT(*) AS n_rows, CAST(COUNT(*) - COUNT({0}) AS BIGINT) AS n_nulls, CAST(SUM(COALESCE(strlen(CAST({0} AS VARCHAR)), 0)) AS BIGINT) AS text_bytes,
    CAST(MIN({0}) AS VARCHAR) AS least, CAST(MAX({0}) AS VARCHAR) AS most FROM customer"""


@query(" UNION ALL ".join(_STATISTICS.format(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def table_statistics(spark, sf):
    """Statistics of columns in one pass over the table; the sketch of distinct values is no exact figure, so it is left out here."""
    found = catalog(spark, sf, "customer").statistics("customer")
    return found.select("column_name", "n_rows", "n_nulls", "text_bytes", "least", "most")


# Filters, projections and expressions


@query("SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def filter_project(spark, sf):
    """A filter that projects in the same step."""
    customers = read(catalog(spark, sf, "customer"), "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    return customers.filter((ref(3) == "BUILDING") & (ref(2) > 5000.0), [1, 2]).to_df()


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / l_quantity AS unit_net, l_extendedprice - l_quantity AS less, l_quantity + 1 AS more FROM lineitem")
def project_arith(spark, sf):
    lines = read(catalog(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"])
    return lines.project([0, 1, ref(2) * (literal(1) - ref(3)) / ref(4), ref(2) - ref(4), ref(4) + 1]).to_df(["l_orderkey", "l_linenumber", "unit_net", "less", "more"])


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'")
def pred_in(spark, sf):
    return table(spark, sf, "orders").where(col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (col("o_orderstatus") == "F")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05::DOUBLE AND 0.07::DOUBLE")
def pred_between(spark, sf):
    return table(spark, sf, "lineitem").where(col("l_discount").between(0.05, 0.07)).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT o_orderkey FROM ox WHERE o_comment NOT LIKE '%special%requests%'")
def pred_not_like(spark, sf):
    return X.orders(spark, sf).where(~like_column(col("o_comment"), "%special%requests%")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lx WHERE l_commitdate < l_receiptdate AND l_shipdate < l_commitdate")
def pred_col_vs_col(spark, sf):
    return X.lineitem(spark, sf).where((col("l_commitdate") < col("l_receiptdate")) & (col("l_shipdate") < col("l_commitdate"))).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_acctbal <> 0 AND (c_nationkey <= 3 OR c_nationkey >= 20) AND NOT c_mktsegment = 'MACHINERY' AND c_acctbal < 9000")
def pred_comparisons(spark, sf):
    c = read(catalog(spark, sf, "customer"), "customer", ["c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"])
    return c.filter((ref(1) != 0.0) & ((ref(2) <= 3) | (ref(2) >= 20)) & ~(ref(3) == "MACHINERY") & (ref(1) < 9000.0), [0]).to_df()


@query("SELECT c_custkey, SUBSTRING(c_phone, 1, 2) AS code, SUBSTRING(c_phone, 4, 3) AS local FROM cx")
def expr_substr(spark, sf):
    """Starts count from 0."""
    return X.customer(spark, sf).select("c_custkey", substr_column(col("c_phone"), 0, 2).alias("code"), substr_column(col("c_phone"), 3, 3).alias("local"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'blue%'")
def expr_like_prefix(spark, sf):
    return read(catalog(spark, sf, "part"), "part", ["p_partkey", "p_name"]).filter(like(ref(1), "blue%"), [0]).to_df()


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ing%'")
def expr_like_contains(spark, sf):
    return table(spark, sf, "part").where(like_column(col("p_name"), "%ing%")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_comment FROM ox WHERE o_comment LIKE '%special%requests%'")
def expr_like_multi(spark, sf):
    return X.orders(spark, sf).where(like_column(col("o_comment"), "%special%requests%")).select("o_orderkey", "o_comment")


@query("SELECT event_id, REPLACE(event_type, 'c', '%') AS t FROM events WHERE REPLACE(event_type, 'c', '%') LIKE '!%li%' ESCAPE '!'")
def expr_like_escape(spark, sf):
    marked = table(spark, sf, "events").select("event_id", F.regexp_replace("event_type", "c", "%").alias("t"))
    return marked.where(like_column(col("t"), "!%li%", "!"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part")
def expr_case(spark, sf):
    p = read(catalog(spark, sf, "part"), "part", ["p_partkey", "p_size"])
    return p.project([0, if_then_else(ref(1) < 10, "small", if_then_else(ref(1) < 30, "medium", "large"))]).to_df(["p_partkey", "size_class"])


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS as_int64, CAST(p_size AS DOUBLE) / 3 AS as_float64 FROM part")
def expr_cast(spark, sf):
    p = read(catalog(spark, sf, "part"), "part", ["p_partkey", "p_size"])
    return p.project([0, cast(ref(1), "int64"), cast(ref(1), "float64") / 3]).to_df(["p_partkey", "as_int64", "as_float64"])


@query("""SELECT event_id, CAST(YEAR(ts) AS INT) AS y, CAST(MONTH(ts) AS INT) AS mo, CAST(DAY(ts) AS INT) AS d, CAST(ISODOW(ts) AS INT) AS wd, CAST(HOUR(ts) AS INT) AS h,
    CAST(MINUTE(ts) AS INT) AS mi, CAST(SECOND(ts) AS INT) AS s, CAST(MILLISECOND(ts) % 1000 AS INT) AS ms, 0 AS ns FROM events""")
def expr_date_parts(spark, sf):
    """Weekdays from Monday, which is 1."""
    parts = {"y": "year", "mo": "month", "d": "day", "wd": "weekday", "h": "hour", "mi": "minute", "s": "second", "ms": "millisecond", "ns": "nanosecond"}
    return table(spark, sf, "events").select("event_id", *[date_part_column(col("ts"), p).alias(a) for a, p in parts.items()])


@query("SELECT CAST(YEAR(o_orderdate) AS INT) AS y, COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' GROUP BY 1")
def expr_date_literal(spark, sf):
    o = read(catalog(spark, sf, "orders"), "orders", ["o_orderkey", "o_orderdate"], partial_filter=ref(4) >= date_literal("1997-06-01"))
    return o.aggregate([date_part(ref(1), "year")], [("count_all", 0)]).to_df(["y", "n"])


@query("SELECT c_custkey, SUBSTRING(c_phone, 1, 2) AS code, c_acctbal FROM cx WHERE SUBSTRING(c_phone, 1, 2) IN ('13', '31', '23', '29', '30', '18', '17') AND c_acctbal > 0")
def fused_project_filter(spark, sf):
    """A filter on a computed column, which is also an output."""
    code = substr_column(col("c_phone"), 0, 2)
    return X.customer(spark, sf).where(code.isin("13", "31", "23", "29", "30", "18", "17") & (col("c_acctbal") > 0)).select("c_custkey", code.alias("code"), "c_acctbal")


# Joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    c = catalog(spark, sf, "orders", "customer")
    o, cu = read(c, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]), read(c, "customer", ["c_custkey", "c_name"])
    return o.shuffle_join(cu, ref(1) == ref(3), [0, 4, 2], strategy="merge").to_df()


@query("SELECT l_orderkey, l_linenumber, ps_availqty FROM lx JOIN psx ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey")
def join_multi_key(spark, sf):
    lines = X.lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(X.partsupp(spark, sf), (col("l_partkey") == col("ps_partkey")) & (col("l_suppkey") == col("ps_suppkey"))).select("l_orderkey", "l_linenumber", "ps_availqty")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal > s_acctbal")
def join_residual(spark, sf):
    """Every pair is a row, so the rows grow with the product of the tables; suppliers stand in blocks by balance."""
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return analysis.pairs_above(c, s, ("c_custkey", "c_nationkey", "c_acctbal"), ("s_suppkey", "s_nationkey", "s_acctbal"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9::DOUBLE FROM orders)")
def join_theta_scalar(spark, sf):
    """Against a table of one row, whose size is one row by construction."""
    o = table(spark, sf, "orders")
    mean = o.agg((F.avg("o_totalprice") * 1.9).alias("m"))
    return o.join(F.broadcast(mean), col("o_totalprice") > col("m")).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000 GROUP BY 1")
def join_left(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 450000")
    return table(spark, sf, "customer").join(o, col("c_custkey") == col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON s_suppkey = c_custkey")
def join_full(spark, sf):
    c = catalog(spark, sf, "supplier", "customer")
    s, cu = read(c, "supplier", ["s_suppkey", "s_acctbal"]), read(c, "customer", ["c_custkey", "c_acctbal"])
    return s.shuffle_join(cu, ref(0) == ref(2), [0, 2], kind="full", left_filter=ref(1) > 5000.0, right_filter=ref(3) > 5000.0, strategy="merge").to_df()


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
def join_semi(spark, sf):
    c = catalog(spark, sf, "orders", "lineitem")
    lines = read(c, "lineitem", ["l_orderkey", "l_quantity"])
    return read(c, "orders", ["o_orderkey"]).shuffle_join(lines, ref(0) == ref(1), kind="left_semi", right_filter=ref(2) == 50.0).to_df()


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_partkey")
    return table(spark, sf, "part").select("p_partkey").join(big, col("p_partkey") == col("l_partkey"), "left_anti")


def _same_order():
    return (col("l_orderkey") == col("k")) & (col("l_suppkey") != col("s"))


def _lines_twice(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return lines.where("l_returnflag = 'R'"), lines.select(col("l_orderkey").alias("k"), col("l_suppkey").alias("s"), col("l_returnflag").alias("f"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem a WHERE l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)")
def join_semi_residual(spark, sf):
    a, b = _lines_twice(spark, sf)
    return a.join(b, _same_order(), "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem a WHERE l_returnflag = 'R'
    AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_returnflag = 'R')""")
def join_anti_residual(spark, sf):
    a, b = _lines_twice(spark, sf)
    return a.join(b.where("f = 'R'"), _same_order(), "left_anti").select("l_orderkey", "l_linenumber", "l_suppkey")


_BY_PRIORITY = "SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"


def _by_priority(spark, sf, hint: str):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return lines.join(o.hint(hint), col("l_orderkey") == col("o_orderkey")).groupBy("o_orderpriority").agg(F.count(lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query(_BY_PRIORITY)
def join_shuffle_hash(spark, sf):
    return _by_priority(spark, sf, "shuffle_hash")


@query(_BY_PRIORITY)
def join_sort_merge(spark, sf):
    return _by_priority(spark, sf, "merge")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_broadcast(spark, sf):
    """The right side is copied only where the optimizer's estimate of it is under a bound."""
    c = catalog(spark, sf, "lineitem", "supplier")
    lines, s = read(c, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey"]), read(c, "supplier", ["s_suppkey", "s_name"])
    return lines.broadcast_join(s, ref(2) == ref(3), [0, 1, 4]).to_df()


@query("SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey")
def join_broadcast_left(spark, sf):
    c = catalog(spark, sf, "nation", "customer")
    return read(c, "nation", ["n_nationkey", "n_name"]).broadcast_join(read(c, "customer", ["c_custkey", "c_nationkey"]), ref(0) == ref(3), [1, 2], broadcast_left=True).to_df()


@query("SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1")
def repartition_hash(spark, sf):
    """One explicit exchange; the aggregate by the same key adds none."""
    lines = read(catalog(spark, sf, "lineitem"), "lineitem", ["l_suppkey"])
    return lines.shuffle([0]).aggregate([0], [("count_all", 0)]).to_df(["l_suppkey", "n"])


@query("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1")
def groupjoin(spark, sf):
    """Join and group by one key: orders are counted before the join."""
    counts = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(lit(1)).alias("m"))
    joined = table(spark, sf, "customer").select("c_custkey").join(counts, col("c_custkey") == col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("m", lit(0)).alias("n"))


_MARK = "SELECT s_suppkey, s_name FROM supplier WHERE {} EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_discount = 0.1::DOUBLE)"


def _marked(spark, sf):
    """The large side is reduced to its distinct keys first, so the small side is what a join builds on."""
    return table(spark, sf, "lineitem").where("l_quantity = 50 AND l_discount = 0.1D").select("l_suppkey").distinct()


@query(_MARK.format(""))
def mark_join_semi(spark, sf):
    return table(spark, sf, "supplier").join(_marked(spark, sf), col("s_suppkey") == col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query(_MARK.format("NOT"))
def mark_join_anti(spark, sf):
    return table(spark, sf, "supplier").join(_marked(spark, sf), col("s_suppkey") == col("l_suppkey"), "left_anti").select("s_suppkey", "s_name")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_totalprice > 400000")
def join_unique_key(spark, sf):
    """A filtered probe side against a side with unique keys; Spark may add a runtime filter."""
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").join(o, col("l_orderkey") == col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def join_fused_probes(spark, sf):
    """Two lookups of one row in a chain; the smaller tables are joined first."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), col("c_nationkey") == col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    return table(spark, sf, "orders").where("o_totalprice > 300000").join(c, col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, s_suppkey, a.n_name AS cn, b.n_name AS sn FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON s_suppkey = c_custkey JOIN nation b ON s_nationkey = b.n_nationkey")
def join_reused_build(spark, sf):
    """One small table on two sides of a plan: Spark reads and sends it once."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").join(n.toDF("k1", "cn"), col("c_nationkey") == col("k1"))
    s = table(spark, sf, "supplier").join(n.toDF("k2", "sn"), col("s_nationkey") == col("k2"))
    return c.join(s, col("c_custkey") == col("s_suppkey")).select("c_custkey", "s_suppkey", "cn", "sn")


# Aggregates


@query("SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, MIN(l_extendedprice) AS least, MAX(l_extendedprice) AS most, ROUND(AVG(l_tax), 8) AS tax FROM lineitem")
def agg_global(spark, sf):
    lines = read(catalog(spark, sf, "lineitem"), "lineitem", ["l_quantity", "l_extendedprice", "l_tax"])
    df = lines.aggregate([], [("count_all", 0), ("sum", 0), ("min", 1), ("max", 1), ("avg", 2)]).to_df(["n", "q", "least", "most", "tax"])
    return df.withColumns({"q": F.round("q", 2), "tax": F.round("tax", 8)})


@query("SELECT l_suppkey, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_quantity), 8) AS mean, MIN(l_discount) AS least, MAX(l_discount) AS most FROM lineitem GROUP BY 1")
def agg_by_key(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_quantity"), 8).alias("mean"), F.min("l_discount").alias("least"), F.max("l_discount").alias("most"))


@query("SELECT CAST(YEAR(o_orderdate) AS INT) AS y, SUBSTRING(o_orderpriority, 1, 1) AS p, ROUND(SUM(o_totalprice * 2), 2) AS t FROM orders GROUP BY 1, 2")
def agg_by_expr(spark, sf):
    o = read(catalog(spark, sf, "orders"), "orders", ["o_orderdate", "o_orderpriority", "o_totalprice"])
    return o.aggregate([date_part(ref(0), "year"), substr(ref(1), 0, 1)], [("sum", ref(2) * 2)]).to_df(["y", "p", "t"]).withColumn("t", F.round("t", 2))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def agg_keys_only(spark, sf):
    return read(catalog(spark, sf, "customer"), "customer", ["c_nationkey", "c_mktsegment"]).aggregate([0, 1], []).to_df()


@query("SELECT c_nationkey, COUNT(*) AS n_rows, COUNT(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000 GROUP BY 1")
def agg_count_all_vs_valid(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 480000")
    joined = table(spark, sf, "customer").join(o, col("c_custkey") == col("o_custkey"), "left").select("c_nationkey", "o_orderkey")
    return Relation(joined).aggregate([0], [("count_all", 1), ("count_valid", 1)]).to_df(["c_nationkey", "n_rows", "n_orders"])


@query("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT l_orderkey, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY 1 HAVING SUM(l_quantity) > 300")
def agg_having(spark, sf):
    lines = read(catalog(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_quantity"])
    return lines.aggregate([0], [("sum", 1)]).filter(ref(1) > 300.0).to_df(["l_orderkey", "q"]).withColumn("q", F.round("q", 2))


@query("""SELECT l_returnflag, CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large, CAST(SUM(CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END) AS BIGINT) AS small
    FROM lineitem GROUP BY 1""")
def agg_conditional_sum(spark, sf):
    lines = read(catalog(spark, sf, "lineitem"), "lineitem", ["l_returnflag", "l_quantity"])
    return lines.aggregate([0], [("sum", if_then_else(ref(1) > 25.0, 1, 0)), ("sum", if_then_else(ref(1) > 25.0, 0, 1))]).to_df(["l_returnflag", "large", "small"])


@query("SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS q, COUNT(*) AS n, ROUND(AVG(l_quantity), 8) AS mean FROM lineitem GROUP BY 1")
def agg_mean_of_parts(spark, sf):
    """A mean from the sum and the count that are outputs anyway."""
    lines = read(catalog(spark, sf, "lineitem"), "lineitem", ["l_returnflag", "l_quantity"]).aggregate([0], [("sum", 1), ("count_all", 1)])
    df = lines.project([0, 1, 2, ref(1) / ref(2)]).to_df(["l_returnflag", "q", "n", "mean"])
    return df.withColumns({"q": F.round("q", 2), "mean": F.round("mean", 8)})


@query("SELECT l_linestatus, COUNT(*) AS n FROM lineitem WHERE l_tax > 0.05::DOUBLE GROUP BY 1")
def agg_filtered(spark, sf):
    """The condition is part of the aggregate."""
    return read(catalog(spark, sf, "lineitem"), "lineitem", ["l_linestatus", "l_tax"]).aggregate([0], [("count_all", 0)], condition=ref(1) > 0.05).to_df(["l_linestatus", "n"])


# Order, limits and unions


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def sort_multi(spark, sf):
    c = read(catalog(spark, sf, "customer"), "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    return c.sort([(1, "ascending", "before"), (2, "descending", "after"), (0, "ascending", "before")]).to_df()


@query("""SELECT c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
    ORDER BY bal DESC NULLS FIRST, c_custkey LIMIT 300""")
def sort_nulls(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(col("c_custkey") % 7 != 0, col("c_acctbal")).alias("bal"))
    return Relation(c).sort([(1, "descending", "before"), (0, "ascending", "before")]).fetch(0, 300).to_df()


@query("""SELECT c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
    ORDER BY bal DESC NULLS FIRST, c_custkey""")
def sort_nulls_whole(spark, sf):
    """The whole table in the order of ``sort_nulls``."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(col("c_custkey") % 7 != 0, col("c_acctbal")).alias("bal"))
    return Relation(c).sort([(1, "descending", "before"), (0, "ascending", "before")]).to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 15")
def fetch_offset(spark, sf):
    o = read(catalog(spark, sf, "orders"), "orders", ["o_orderkey", "o_totalprice"])
    return o.sort([(1, "descending", "after"), (0, "ascending", "before")]).fetch(15, 20).to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def topk(spark, sf):
    """Each task keeps its own top rows; only those meet."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(20)


@query("SELECT s_nationkey AS k, s_acctbal AS b FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer")
def union_all(spark, sf):
    c = catalog(spark, sf, "supplier", "customer")
    return read(c, "supplier", ["s_nationkey", "s_acctbal"]).union_all(read(c, "customer", ["c_nationkey", "c_acctbal"])).to_df(["k", "b"])


# Analysis of events

_EVENTS = "e AS (SELECT event_id, user_id, event_type, value, CAST(EPOCH_US(ts) // 1000000 AS BIGINT) AS t0, CAST(EPOCH_US(ts) // 1000000 + CAST(FLOOR(value * 60) AS BIGINT) AS BIGINT) AS t1 FROM events)"


def events(spark, sf) -> DataFrame:
    """Events as intervals of whole seconds: a minute for each unit of value."""
    t0 = F.floor(F.unix_micros(col("ts").cast("timestamp")) / 1_000_000)
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", t0.alias("t0"), (t0 + F.floor(col("value") * 60)).alias("t1"))


_ISLANDS = f"""WITH {_EVENTS}, o AS (SELECT *, MAX(t1) OVER (PARTITION BY user_id, event_type ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e),
    i AS (SELECT *, SUM(CASE WHEN m IS NULL OR t0 > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY t0, t1) AS g FROM o),
    u AS (SELECT user_id, event_type, g, MIN(t0) AS t0, MAX(t1) AS t1, COUNT(*) AS n_merged FROM i GROUP BY 1, 2, 3)"""


@query(_ISLANDS + " SELECT user_id, event_type, t0, t1, n_merged FROM u")
def an_interval_merge(spark, sf):
    return analysis.merge_intervals(events(spark, sf), ["user_id", "event_type"], "t0", "t1").select("user_id", "event_type", "t0", "t1", "n_merged")


@query(_ISLANDS + """, c AS (SELECT user_id, event_type, SUM(t1 - t0) AS covered FROM u GROUP BY 1, 2), m AS (SELECT event_type, MAX(covered) AS covered FROM c GROUP BY 1)
    SELECT CAST(SUM(covered) AS BIGINT) AS effective FROM m""")
def an_effective_time(spark, sf):
    """Covered time by process and stage; the longest process of each stage; the sum of stages."""
    covered = analysis.covered_length(events(spark, sf), ["user_id", "event_type"], "t0", "t1")
    return covered.groupBy("event_type").agg(F.max("covered").alias("covered")).agg(F.sum("covered").alias("effective"))


@query(f"""WITH {_EVENTS} SELECT c.event_id AS child, p.event_id AS parent FROM e c JOIN e p ON c.user_id = p.user_id AND c.t0 >= p.t0 AND c.t1 <= p.t1
    WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def an_interval_containment(spark, sf):
    e = events(spark, sf)
    children = e.where("event_type = 'click'").select("user_id", col("event_id").alias("child"), col("t0").alias("c0"), col("t1").alias("c1"))
    parents = e.where("event_type = 'purchase'").select("user_id", col("event_id").alias("parent"), col("t0").alias("p0"), col("t1").alias("p1"))
    return analysis.contained_in(children, parents, ["user_id"], ("c0", "c1"), ("p0", "p1"), 3600).select("child", "parent")


@query("""SELECT event_type, user_id, event_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type, user_id ORDER BY value, event_id) AS r FROM events) WHERE r = 1""")
def an_argmin_group(spark, sf):
    e = table(spark, sf, "events").select("event_type", "user_id", "event_id", "value")
    return analysis.best_per_group(e, ["event_type", "user_id"], "value", ["event_id"]).select("event_type", "user_id", "event_id", "value")


@query("""SELECT user_id, ROUND(AVG(value), 6) AS mean, MIN(value) AS least, MAX(value) AS most, COUNT(*) AS n
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS number FROM events) WHERE number > 0 GROUP BY 1""")
def an_warmup_excluded_stats(spark, sf):
    e = table(spark, sf, "events")
    runs = e.withColumn("number", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return analysis.warm_statistics(runs, ["user_id"], "number", "value").withColumn("mean", F.round("mean", 6))


@query("""SELECT user_id, MAX(CASE WHEN event_type = 'click' THEN value END) AS click, MAX(CASE WHEN event_type = 'view' THEN value END) AS view,
    MAX(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events GROUP BY 1""")
def an_pivot(spark, sf):
    return analysis.pivot_max(table(spark, sf, "events"), ["user_id"], "event_type", ["click", "view", "purchase"], "value")


@query("SELECT user_id, STRING_AGG(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 150) GROUP BY 1")
def an_string_agg(spark, sf):
    return analysis.joined_strings(table(spark, sf, "events").where("value > 150"), ["user_id"], "event_type", "kinds")


@query("SELECT event_id, event_type FROM events WHERE event_type GLOB '*i?*' AND NOT event_type GLOB 'v*'")
def an_glob(spark, sf):
    t = col("event_type")
    return table(spark, sf, "events").where(analysis.matches_glob(t, "*i?*") & ~analysis.matches_glob(t, "v*")).select("event_id", "event_type")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 120)")
def an_failed_antijoin(spark, sf):
    e = table(spark, sf, "events")
    failed = e.where("event_type = 'error' AND value > 120").select("user_id")
    return e.select("user_id").distinct().join(failed, "user_id", "left_anti")


@query("""WITH g AS (SELECT user_id, event_type, AVG(value) AS mean, COUNT(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, COUNT(*) AS flaky FROM g WHERE n < 10 GROUP BY 1""")
def an_flaky_groups(spark, sf):
    """Groups with fewer samples than were asked for."""
    groups = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(lit(1)).alias("n"))
    return groups.where("n < 10").groupBy("event_type").agg(F.count(lit(1)).alias("flaky"))


@query("""SELECT l_returnflag, l_linestatus, CAST(SUM(LENGTH(CAST(l_extendedprice AS BIGINT)::VARCHAR)) AS BIGINT) AS primary_size, COUNT(*) * 8 AS plain_size,
    ROUND(COUNT(*) * 8.0::DOUBLE / SUM(LENGTH(CAST(l_extendedprice AS BIGINT)::VARCHAR)), 6) AS ratio FROM (SELECT * REPLACE (FLOOR(l_extendedprice) AS l_extendedprice) FROM lineitem) GROUP BY 1, 2""")
def an_compression_ratio(spark, sf):
    """Sizes of groups and the ratio of their sums."""
    size = F.length(F.floor("l_extendedprice").cast("string"))
    sums = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(size).alias("primary_size"), (F.count(lit(1)) * 8).alias("plain_size"))
    return sums.withColumn("ratio", F.round(col("plain_size").cast("double") / col("primary_size"), 6))


@query("""SELECT r_name, n_name, p_brand, l_shipmode, l_returnflag, CAST(SUM(plain) AS BIGINT) AS plain_size, CAST(SUM(packed) AS BIGINT) AS primary_size, COUNT(*) AS n,
    ROUND(SUM(plain)::DOUBLE / SUM(packed), 6) AS ratio, CAST(GROUPING(r_name) + GROUPING(n_name) + GROUPING(p_brand) + GROUPING(l_shipmode) + GROUPING(l_returnflag) AS BIGINT) AS level
    FROM (SELECT r_name, n_name, p_brand, l_shipmode, l_returnflag, 8 AS plain, LENGTH(CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS VARCHAR)) AS packed
        FROM lx, part, supplier, nation, region WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey) q
    GROUP BY ROLLUP (r_name, n_name, p_brand, l_shipmode, l_returnflag)""")
def an_compression_rollup(spark, sf):
    """Sizes of a fact table's groups over five joined tables, with sums at each level of its dimensions."""
    packed = F.length(F.floor("l_extendedprice").cast("string"))
    lines = X.lineitem(spark, sf).select("l_partkey", "l_suppkey", "l_shipmode", "l_returnflag", packed.alias("packed"))
    places = table(spark, sf, "supplier").join(table(spark, sf, "nation"), col("s_nationkey") == col("n_nationkey")).join(table(spark, sf, "region"), col("n_regionkey") == col("r_regionkey"))
    joined = lines.join(table(spark, sf, "part").select("p_partkey", "p_brand"), col("l_partkey") == col("p_partkey"))
    joined = joined.join(places.select("s_suppkey", "n_name", "r_name"), col("l_suppkey") == col("s_suppkey"))
    return analysis.size_rollup(joined.withColumn("plain", lit(8)), ["r_name", "n_name", "p_brand", "l_shipmode", "l_returnflag"], "plain", "packed")


@query("""SELECT k.user_id, k.event_type, r.n AS runs, f.n AS failures FROM (SELECT user_id, event_type FROM events WHERE event_type <> 'error' UNION
    SELECT user_id, event_type FROM events WHERE event_type = 'error') k LEFT JOIN (SELECT user_id, event_type, COUNT(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2) r
    ON k.user_id = r.user_id AND k.event_type = r.event_type LEFT JOIN (SELECT user_id, event_type, COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2) f
    ON k.user_id = f.user_id AND k.event_type = f.event_type""")
def an_all_runs(spark, sf):
    """Keys of two fact tables, with what each of them knows."""
    e = table(spark, sf, "events").select("user_id", "event_type")
    good, bad = e.where("event_type <> 'error'"), e.where("event_type = 'error'")
    count = lambda df, name: df.groupBy("user_id", "event_type").agg(F.count(lit(1)).alias(name))
    keys = good.unionAll(bad).distinct()
    return keys.join(count(good, "runs"), ["user_id", "event_type"], "left").join(count(bad, "failures"), ["user_id", "event_type"], "left")

"""Columns and tables of the query suite that the test data lack, derived by rule from those it has.

Each rule is integer arithmetic and CASE, so Spark and an SQL oracle compute the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# Expressions that both engines read alike.
SHIPMODE = (
    "CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN 'AIR' WHEN 1 THEN 'AIR REG' WHEN 2 THEN 'MAIL' WHEN 3 THEN 'SHIP' "
    "WHEN 4 THEN 'RAIL' WHEN 5 THEN 'TRUCK' ELSE 'FOB' END"
)
SHIPINSTRUCT = "CASE (l_orderkey + l_suppkey) % 4 WHEN 0 THEN 'DELIVER IN PERSON' WHEN 1 THEN 'COLLECT COD' WHEN 2 THEN 'NONE' ELSE 'TAKE BACK RETURN' END"
COMMIT_DAYS = "CAST((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 61 - 30 AS INT)"
RECEIPT_DAYS = "CAST((l_orderkey * 3 + l_suppkey) % 30 + 1 AS INT)"
ORDER_COMMENT = "CASE o_orderkey % 50 WHEN 0 THEN 'special packages requests' WHEN 1 THEN 'requests special' ELSE 'regular deposits' END"
CONTAINER = (
    "CASE p_partkey % 8 WHEN 0 THEN 'SM CASE' WHEN 1 THEN 'SM BOX' WHEN 2 THEN 'MED BAG' WHEN 3 THEN 'MED BOX' WHEN 4 THEN 'LG CASE' "
    "WHEN 5 THEN 'LG BOX' WHEN 6 THEN 'SM PACK' ELSE 'MED PKG' END"
)
SUPPLIER_COMMENT = "CASE WHEN s_suppkey % 20 = 0 THEN 'a Customer b Complaints' ELSE 'ok' END"
AVAILABLE = "CAST((ps_partkey * 7919 + ps_suppkey * 104729) % 9999 + 1 AS INT)"
COST = "CAST((ps_partkey * 31 + ps_suppkey * 17) % 100000 AS DOUBLE) / 100"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "* EXCEPT (l_shipdate)", "CAST(l_shipdate AS DATE) AS l_shipdate", f"date_add(CAST(l_shipdate AS DATE), {COMMIT_DAYS}) AS l_commitdate",
        f"date_add(CAST(l_shipdate AS DATE), {RECEIPT_DAYS}) AS l_receiptdate", f"{SHIPMODE} AS l_shipmode", f"{SHIPINSTRUCT} AS l_shipinstruct",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("* EXCEPT (o_orderdate)", "CAST(o_orderdate AS DATE) AS o_orderdate", f"{ORDER_COMMENT} AS o_comment", "0 AS o_shippriority")


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone = F.concat((F.col("c_nationkey") + 10).cast("string"), F.lit("-"), (F.col("c_custkey") % 900 + 100).cast("string"))
    return table(spark, sf_dir, "customer").withColumns({"c_phone": phone, "c_address": F.concat(F.lit("addr-"), "c_custkey"), "c_comment": F.concat(F.lit("note-"), "c_custkey")})


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("*", f"{CONTAINER} AS p_container", "concat('Manufacturer#', CAST(p_partkey % 5 + 1 AS STRING)) AS p_mfgr")


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {"s_address": F.concat(F.lit("addr-"), "s_suppkey"), "s_phone": F.concat(F.lit("phone-"), "s_suppkey"), "s_comment": F.expr(SUPPLIER_COMMENT)}
    return table(spark, sf_dir, "supplier").withColumns(extra)


def partsupp(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """Offers; with ``parts`` (``p_partkey``) only theirs, chosen before the lines are made distinct."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
    if parts is not None:
        pairs = pairs.join(parts, F.col("ps_partkey") == F.col("p_partkey"), "left_semi")
    return pairs.distinct().selectExpr("*", f"{AVAILABLE} AS ps_availqty", f"{COST} AS ps_supplycost")


def nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region")


#: The same, as common table expressions of the oracle: names end in ``x``.
SQL = {
    "lx": f"""lx AS (SELECT l.* EXCLUDE (l_shipdate), CAST(l_shipdate AS DATE) AS l_shipdate, CAST(l_shipdate AS DATE) + {COMMIT_DAYS} AS l_commitdate,
        CAST(l_shipdate AS DATE) + {RECEIPT_DAYS} AS l_receiptdate, {SHIPMODE} AS l_shipmode, {SHIPINSTRUCT} AS l_shipinstruct FROM lineitem l)""",
    "ox": f"ox AS (SELECT o.* EXCLUDE (o_orderdate), CAST(o_orderdate AS DATE) AS o_orderdate, {ORDER_COMMENT} AS o_comment, 0 AS o_shippriority FROM orders o)",
    "cx": """cx AS (SELECT c.*, CAST(10 + c_nationkey AS VARCHAR) || '-' || CAST(100 + c_custkey % 900 AS VARCHAR) AS c_phone,
        'addr-' || c_custkey AS c_address, 'note-' || c_custkey AS c_comment FROM customer c)""",
    "px": f"px AS (SELECT p.*, {CONTAINER} AS p_container, 'Manufacturer#' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS p_mfgr FROM part p)",
    "sx": f"sx AS (SELECT s.*, 'addr-' || s_suppkey AS s_address, 'phone-' || s_suppkey AS s_phone, {SUPPLIER_COMMENT} AS s_comment FROM supplier s)",
    "psx": f"""psx AS (SELECT *, {AVAILABLE} AS ps_availqty, {COST} AS ps_supplycost
        FROM (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem) q)""",
}


def with_fixtures(sql: str) -> str:
    """``sql`` with the common table expressions it names in front."""
    import re

    used = [text for name, text in SQL.items() if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    own = re.match(r"\s*WITH\s+", sql, re.IGNORECASE)
    return f"WITH {', '.join(used)}" + (", " + sql[own.end() :] if own else "\n" + sql)

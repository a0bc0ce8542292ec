"""The decision-support query suite: 22 queries, some in several equivalent formulations.

Each is a lazy DataFrame; the runtime plan chooses join strategies and partition counts.
Filters and columns reach the Parquet scans. Predicates are fitted to the test data's values.
Every ORDER BY with a LIMIT ends in a key, so results don't depend on ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import customer, lineitem, nation, orders, part, partsupp, region, supplier

col, lit = F.col, F.lit


def revenue(alias: str = "revenue", digits: int = 4):
    return F.round(F.sum(col("l_extendedprice") * (1 - col("l_discount"))), digits).alias(alias)


def between(name: str, low: str, high: str):
    """Dates from low on, before high."""
    return (col(name) >= F.to_date(lit(low))) & (col(name) < F.to_date(lit(high)))


def q01(spark: SparkSession, sf: str) -> DataFrame:
    net = col("l_extendedprice") * (1 - col("l_discount"))
    return (
        lineitem(spark, sf).where(col("l_shipdate") <= F.to_date(lit("1998-09-02"))).groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(net), 2).alias("sum_disc_price"),
            F.round(F.sum(net * (1 + col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def _q02_base(spark, sf) -> DataFrame:
    europe = nation(spark, sf).join(region(spark, sf).where("r_name = 'EUROPE'"), col("n_regionkey") == col("r_regionkey")).select("n_nationkey", "n_name")
    parts = part(spark, sf).where("p_size BETWEEN 10 AND 20 AND p_type LIKE '%ARD'").select("p_partkey", "p_mfgr")
    offers = partsupp(spark, sf, parts.select("p_partkey")).join(supplier(spark, sf), col("ps_suppkey") == col("s_suppkey")).join(europe, col("s_nationkey") == col("n_nationkey"))
    return offers.join(parts, col("ps_partkey") == col("p_partkey"))


_Q02 = ["s_acctbal", "s_name", "n_name", "p_partkey", "p_mfgr", "s_address", "s_phone", "s_comment"]


def q02(spark: SparkSession, sf: str) -> DataFrame:
    """The least cost of each part by a window over the offers."""
    least = F.min("ps_supplycost").over(Window.partitionBy("p_partkey"))
    best = _q02_base(spark, sf).withColumn("least", least).where("ps_supplycost = least")
    return best.select(*_Q02).orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100)


def q02_ff(spark: SparkSession, sf: str) -> DataFrame:
    """The same by an aggregate joined back on (part, cost)."""
    base = _q02_base(spark, sf)
    least = base.groupBy(col("p_partkey").alias("k")).agg(F.min("ps_supplycost").alias("least"))
    best = base.join(least, (col("p_partkey") == col("k")) & (col("ps_supplycost") == col("least")))
    return best.select(*_Q02).orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100)


def q03(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date(lit("1997-03-15"))
    c = customer(spark, sf).where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = orders(spark, sf).where(col("o_orderdate") < day).join(c, col("o_custkey") == col("c_custkey")).select("o_orderkey", "o_orderdate", "o_shippriority")
    joined = lineitem(spark, sf).where(col("l_shipdate") > day).join(o, col("l_orderkey") == col("o_orderkey"))
    found = joined.groupBy("l_orderkey", "o_orderdate", "o_shippriority").agg(revenue())
    return found.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate", "o_shippriority")


def q03_ff(spark: SparkSession, sf: str) -> DataFrame:
    """Filters written after all joins; they must reach the scans all the same."""
    joined = lineitem(spark, sf).join(orders(spark, sf), col("l_orderkey") == col("o_orderkey")).join(customer(spark, sf), col("o_custkey") == col("c_custkey"))
    day = F.to_date(lit("1997-03-15"))
    found = joined.where((col("c_mktsegment") == "BUILDING") & (col("o_orderdate") < day) & (col("l_shipdate") > day)).groupBy("l_orderkey", "o_orderdate", "o_shippriority").agg(revenue())
    return found.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate", "o_shippriority")


def q04(spark: SparkSession, sf: str) -> DataFrame:
    late = lineitem(spark, sf).where("l_commitdate < l_receiptdate").select("l_orderkey")
    o = orders(spark, sf).where(between("o_orderdate", "1996-07-01", "1996-10-01"))
    return o.join(late, col("o_orderkey") == col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(lit(1)).alias("order_count")).orderBy("o_orderpriority")


def q05(spark: SparkSession, sf: str) -> DataFrame:
    asia = nation(spark, sf).join(region(spark, sf).where("r_name = 'ASIA'"), col("n_regionkey") == col("r_regionkey")).select("n_nationkey", "n_name")
    s = supplier(spark, sf).join(asia, col("s_nationkey") == col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = orders(spark, sf).join(customer(spark, sf).select("c_custkey", "c_nationkey"), col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = lineitem(spark, sf).join(s, col("l_suppkey") == col("s_suppkey")).join(o, (col("l_orderkey") == col("o_orderkey")) & (col("s_nationkey") == col("c_nationkey")))
    return joined.groupBy("n_name").agg(revenue()).orderBy(F.desc("revenue"), "n_name")


def q06(spark: SparkSession, sf: str) -> DataFrame:
    kept = lineitem(spark, sf).where(between("l_shipdate", "1996-01-01", "1997-01-01") & col("l_discount").between(0.05, 0.07) & (col("l_quantity") < 24))
    return kept.agg(F.round(F.sum(col("l_extendedprice") * col("l_discount")), 4).alias("revenue"))


def q07(spark: SparkSession, sf: str, filter_late: bool = False) -> DataFrame:
    n1 = nation(spark, sf).select(col("n_nationkey").alias("k1"), col("n_name").alias("supp_nation"))
    n2 = nation(spark, sf).select(col("n_nationkey").alias("k2"), col("n_name").alias("cust_nation"))
    two = ["NATION_6", "NATION_7"]
    if not filter_late:
        n1, n2 = n1.where(col("supp_nation").isin(two)), n2.where(col("cust_nation").isin(two))
    s = supplier(spark, sf).join(n1, col("s_nationkey") == col("k1")).select("s_suppkey", "supp_nation")
    c = customer(spark, sf).join(n2, col("c_nationkey") == col("k2")).select("c_custkey", "cust_nation")
    o = orders(spark, sf).join(c, col("o_custkey") == col("c_custkey")).select("o_orderkey", "cust_nation")
    joined = lineitem(spark, sf).join(s, col("l_suppkey") == col("s_suppkey")).join(o, (col("l_orderkey") == col("o_orderkey")) & (col("supp_nation") != col("cust_nation")))
    if filter_late:
        joined = joined.where(col("supp_nation").isin(two) & col("cust_nation").isin(two))
    return joined.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year")).agg(revenue()).orderBy("supp_nation", "cust_nation", "l_year")


def q07_ff(spark: SparkSession, sf: str) -> DataFrame:
    return q07(spark, sf, filter_late=True)


def q08(spark: SparkSession, sf: str) -> DataFrame:
    america = nation(spark, sf).join(region(spark, sf).where("r_name = 'AMERICA'"), col("n_regionkey") == col("r_regionkey")).select(col("n_nationkey").alias("kc"))
    c = customer(spark, sf).join(america, col("c_nationkey") == col("kc")).select("c_custkey")
    o = orders(spark, sf).where(between("o_orderdate", "1996-01-01", "1998-01-01")).join(c, col("o_custkey") == col("c_custkey")).select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    p = part(spark, sf).where("p_type = 'ECONOMY'").select("p_partkey")
    s = supplier(spark, sf).join(nation(spark, sf), col("s_nationkey") == col("n_nationkey")).select("s_suppkey", "n_name")
    joined = lineitem(spark, sf).join(p, col("l_partkey") == col("p_partkey")).join(o, col("l_orderkey") == col("o_orderkey")).join(s, col("l_suppkey") == col("s_suppkey"))
    volume = col("l_extendedprice") * (1 - col("l_discount"))
    share = F.sum(F.when(col("n_name") == "NATION_7", volume).otherwise(0.0)) / F.sum(volume)
    return joined.groupBy("o_year").agg(F.round(share, 8).alias("mkt_share")).orderBy("o_year")


def q09(spark: SparkSession, sf: str) -> DataFrame:
    p = part(spark, sf).where("p_name LIKE '%blue%'").select("p_partkey")
    s = supplier(spark, sf).join(nation(spark, sf), col("s_nationkey") == col("n_nationkey")).select("s_suppkey", col("n_name").alias("nation"))
    joined = (
        lineitem(spark, sf).join(p, col("l_partkey") == col("p_partkey")).join(s, col("l_suppkey") == col("s_suppkey"))
        .join(partsupp(spark, sf), (col("l_partkey") == col("ps_partkey")) & (col("l_suppkey") == col("ps_suppkey")))
        .join(orders(spark, sf).select("o_orderkey", "o_orderdate"), col("l_orderkey") == col("o_orderkey"))
    )
    profit = col("l_extendedprice") * (1 - col("l_discount")) - col("ps_supplycost") * col("l_quantity")
    return joined.groupBy("nation", F.year("o_orderdate").alias("o_year")).agg(F.round(F.sum(profit), 4).alias("sum_profit")).orderBy("nation", F.desc("o_year"))


_Q10 = ["c_custkey", "c_name", "c_acctbal", "c_phone", "n_name", "c_address", "c_comment"]


def q10(spark: SparkSession, sf: str, filter_late: bool = False) -> DataFrame:
    o, returned = between("o_orderdate", "1996-10-01", "1997-01-01"), col("l_returnflag") == "R"
    left, right = (lineitem(spark, sf), orders(spark, sf)) if filter_late else (lineitem(spark, sf).where(returned), orders(spark, sf).where(o))
    joined = left.join(right, col("l_orderkey") == col("o_orderkey")).join(customer(spark, sf), col("o_custkey") == col("c_custkey")).join(nation(spark, sf), col("c_nationkey") == col("n_nationkey"))
    if filter_late:
        joined = joined.where(o & returned)
    return joined.groupBy(*_Q10).agg(revenue()).orderBy(F.desc("revenue"), "c_custkey").limit(20)


def q10_ff(spark: SparkSession, sf: str) -> DataFrame:
    return q10(spark, sf, filter_late=True)


def q10_opt(spark: SparkSession, sf: str) -> DataFrame:
    """Sums by key first; the customer's strings are joined to the top rows only."""
    o = orders(spark, sf).where(between("o_orderdate", "1996-10-01", "1997-01-01")).select("o_orderkey", "o_custkey")
    sums = lineitem(spark, sf).where("l_returnflag = 'R'").join(o, col("l_orderkey") == col("o_orderkey")).groupBy("o_custkey").agg(revenue())
    top = sums.orderBy(F.desc("revenue"), "o_custkey").limit(20)
    full = customer(spark, sf).join(F.broadcast(top), col("c_custkey") == col("o_custkey")).join(nation(spark, sf), col("c_nationkey") == col("n_nationkey"))
    return full.select(*_Q10, "revenue").orderBy(F.desc("revenue"), "c_custkey")


def q11(spark: SparkSession, sf: str) -> DataFrame:
    value = (F.sum((col("ps_supplycost") * 100).cast("decimal(18,0)") * col("ps_availqty")) / 100).cast("double")
    sums = partsupp(spark, sf).groupBy("ps_partkey").agg(value.alias("value"))
    total = sums.agg((F.sum("value") * 0.001).alias("least"))
    return sums.crossJoin(F.broadcast(total)).where("value > least").select("ps_partkey", F.round("value", 2).alias("value")).orderBy(F.desc("value"), "ps_partkey")


def _q12(spark, sf, hint: str | None) -> DataFrame:
    chosen = col("l_shipmode").isin("MAIL", "SHIP") & (col("l_commitdate") < col("l_receiptdate")) & (col("l_shipdate") < col("l_commitdate"))
    lines = lineitem(spark, sf).where(chosen & between("l_receiptdate", "1996-01-01", "1997-01-01")).select("l_orderkey", "l_shipmode")
    o = orders(spark, sf).select("o_orderkey", "o_orderpriority")
    high = col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    joined = o.join(lines.hint(hint) if hint else lines, col("o_orderkey") == col("l_orderkey"))
    counts = [F.sum(F.when(high, 1).otherwise(0)).alias("high_line_count"), F.sum(F.when(high, 0).otherwise(1)).alias("low_line_count")]
    return joined.groupBy("l_shipmode").agg(*counts).orderBy("l_shipmode")


def q12(spark: SparkSession, sf: str) -> DataFrame:
    return _q12(spark, sf, None)


def q12_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides hashed by the key."""
    return _q12(spark, sf, "shuffle_hash")


def _q13_orders(spark, sf) -> DataFrame:
    return orders(spark, sf).where(~col("o_comment").like("%special%requests%")).select("o_orderkey", "o_custkey")


def _q13_result(counts: DataFrame) -> DataFrame:
    return counts.groupBy("c_count").agg(F.count(lit(1)).alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


def q13(spark: SparkSession, sf: str) -> DataFrame:
    joined = customer(spark, sf).select("c_custkey").join(_q13_orders(spark, sf), col("c_custkey") == col("o_custkey"), "left")
    return _q13_result(joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count")))


def q13_opt(spark: SparkSession, sf: str) -> DataFrame:
    """Group-join: orders are counted before the join, which then has one row a key on both sides."""
    counts = _q13_orders(spark, sf).groupBy("o_custkey").agg(F.count(lit(1)).alias("n"))
    joined = customer(spark, sf).select("c_custkey").join(counts, col("c_custkey") == col("o_custkey"), "left")
    return _q13_result(joined.select(F.coalesce("n", lit(0)).alias("c_count")))


def q13_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Group-join without a join: customers with 0, orders with 1, one aggregate by key."""
    zeros = customer(spark, sf).select(col("c_custkey").alias("k"), lit(0).cast("long").alias("n"), lit(1).alias("known"))
    ones = _q13_orders(spark, sf).select(col("o_custkey").alias("k"), lit(1).cast("long").alias("n"), lit(0).alias("known"))
    counts = zeros.unionAll(ones).groupBy("k").agg(F.sum("n").alias("c_count"), F.max("known").alias("known")).where("known = 1")
    return _q13_result(counts)


def q14(spark: SparkSession, sf: str) -> DataFrame:
    lines = lineitem(spark, sf).where(between("l_shipdate", "1996-09-01", "1996-10-01"))
    joined = lines.join(part(spark, sf).select("p_partkey", "p_type"), col("l_partkey") == col("p_partkey"))
    net = col("l_extendedprice") * (1 - col("l_discount"))
    return joined.agg(F.round(100.0 * F.sum(F.when(col("p_type").like("PROMO%"), net).otherwise(0.0)) / F.sum(net), 8).alias("promo_revenue"))


def q15(spark: SparkSession, sf: str) -> DataFrame:
    """The largest sum is taken from the rounded sums themselves, so equality is safe."""
    sums = lineitem(spark, sf).where(between("l_shipdate", "1996-01-01", "1996-04-01")).groupBy("l_suppkey").agg(revenue("total_revenue"))
    top = sums.join(F.broadcast(sums.agg(F.max("total_revenue").alias("most"))), col("total_revenue") == col("most"))
    joined = supplier(spark, sf).join(top, col("s_suppkey") == col("l_suppkey"))
    return joined.select("s_suppkey", "s_name", "s_address", "s_phone", "total_revenue").orderBy("s_suppkey")


def _q16_pairs(spark, sf) -> DataFrame:
    sizes = [3, 9, 14, 19, 23, 36, 45, 49]
    p = part(spark, sf).where((col("p_brand") != "Brand#11") & ~col("p_type").like("MEDIUM%") & col("p_size").isin(sizes)).select("p_partkey", "p_brand", "p_type", "p_size")
    return partsupp(spark, sf, p.select("p_partkey")).select("ps_partkey", "ps_suppkey").join(p, col("ps_partkey") == col("p_partkey"))


def q16(spark: SparkSession, sf: str) -> DataFrame:
    bad = supplier(spark, sf).where("s_comment LIKE '%Customer%Complaints%'").select("s_suppkey")
    kept = _q16_pairs(spark, sf).join(bad, col("ps_suppkey") == col("s_suppkey"), "left_anti")
    counts = kept.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("ps_suppkey").alias("supplier_cnt"))
    return counts.orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


def q16_opt(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pairs first, then a count."""
    bad = supplier(spark, sf).where("s_comment LIKE '%Customer%Complaints%'").select("s_suppkey")
    pairs = _q16_pairs(spark, sf).select("p_brand", "p_type", "p_size", "ps_suppkey").distinct().join(bad, col("ps_suppkey") == col("s_suppkey"), "left_anti")
    return pairs.groupBy("p_brand", "p_type", "p_size").agg(F.count(lit(1)).alias("supplier_cnt")).orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


def q17(spark: SparkSession, sf: str) -> DataFrame:
    p = part(spark, sf).where("p_brand = 'Brand#12'").select("p_partkey")
    lines = lineitem(spark, sf).select("l_partkey", "l_quantity", "l_extendedprice").join(p, col("l_partkey") == col("p_partkey"))
    mean = F.avg("l_quantity").over(Window.partitionBy("l_partkey"))
    kept = lines.withColumn("mean", mean).where(col("l_quantity") < 0.2 * col("mean"))
    return kept.agg(F.round(F.sum("l_extendedprice") / 7.0, 6).alias("avg_yearly"))


_Q18 = ["c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"]


def q18(spark: SparkSession, sf: str) -> DataFrame:
    large = lineitem(spark, sf).groupBy(col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("q")).where("q > 300").select("k")
    o = orders(spark, sf).join(large, col("o_orderkey") == col("k"), "left_semi").join(customer(spark, sf).select("c_custkey", "c_name"), col("o_custkey") == col("c_custkey"))
    joined = o.join(lineitem(spark, sf).select("l_orderkey", "l_quantity"), col("o_orderkey") == col("l_orderkey"))
    return joined.groupBy(*_Q18).agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty")).orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


def q18_opt(spark: SparkSession, sf: str) -> DataFrame:
    """The order's sum is used as it is, so lines are read and shuffled once."""
    large = lineitem(spark, sf).groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty")).where("sum_qty > 300")
    o = orders(spark, sf).join(large, col("o_orderkey") == col("l_orderkey")).join(customer(spark, sf).select("c_custkey", "c_name"), col("o_custkey") == col("c_custkey"))
    return o.select(*_Q18, "sum_qty").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


def q19(spark: SparkSession, sf: str) -> DataFrame:
    lines = lineitem(spark, sf).where(col("l_shipmode").isin("AIR", "AIR REG") & (col("l_shipinstruct") == "DELIVER IN PERSON"))
    joined = lines.join(part(spark, sf).select("p_partkey", "p_container", "p_size"), col("l_partkey") == col("p_partkey"))
    one = col("p_container").isin("SM CASE", "SM BOX", "SM PACK") & col("l_quantity").between(1, 11) & col("p_size").between(1, 15)
    two = col("p_container").isin("MED BAG", "MED BOX", "MED PKG") & col("l_quantity").between(10, 20) & col("p_size").between(1, 30)
    three = col("p_container").isin("LG CASE", "LG BOX") & col("l_quantity").between(20, 30) & col("p_size").between(1, 45)
    return joined.where(one | two | three).agg(revenue())


def q20(spark: SparkSession, sf: str, filter_late: bool = False) -> DataFrame:
    year, blue = between("l_shipdate", "1996-01-01", "1997-01-01"), col("p_name").like("blue%")
    p = part(spark, sf).where(blue).select("p_partkey")
    lines = lineitem(spark, sf).select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    lines = lines.join(p, col("l_partkey") == col("p_partkey"), "left_semi")
    lines = lines.where(year) if filter_late else lineitem(spark, sf).where(year).join(p, col("l_partkey") == col("p_partkey"), "left_semi")
    sums = lines.groupBy("l_partkey", "l_suppkey").agg((0.5 * F.sum("l_quantity")).alias("half"))
    chosen = partsupp(spark, sf, p).join(sums, (col("ps_partkey") == col("l_partkey")) & (col("ps_suppkey") == col("l_suppkey")) & (col("ps_availqty").cast("double") > col("half")), "left_semi")
    s = supplier(spark, sf).join(nation(spark, sf).where("n_name = 'NATION_7'"), col("s_nationkey") == col("n_nationkey"))
    return s.join(chosen.select("ps_suppkey"), col("s_suppkey") == col("ps_suppkey"), "left_semi").select("s_name", "s_address").orderBy("s_name")


def q20_ff(spark: SparkSession, sf: str) -> DataFrame:
    return q20(spark, sf, filter_late=True)


def _q21_lines(spark, sf) -> DataFrame:
    return lineitem(spark, sf).select("l_orderkey", "l_suppkey", (col("l_receiptdate") > col("l_commitdate")).alias("late"))


def _q21_result(found: DataFrame, spark, sf) -> DataFrame:
    joined = found.join(supplier(spark, sf).select("s_suppkey", "s_name"), col("l_suppkey") == col("s_suppkey"))
    return joined.groupBy("s_name").agg(F.count(lit(1)).alias("numwait")).orderBy(F.desc("numwait"), "s_name").limit(100)


def q21(spark: SparkSession, sf: str) -> DataFrame:
    """EXISTS and NOT EXISTS with a residual condition."""
    failed = orders(spark, sf).where("o_orderstatus = 'F'").select("o_orderkey")
    lines = _q21_lines(spark, sf)
    others = lines.select(col("l_orderkey").alias("k"), col("l_suppkey").alias("s"))
    late = lines.where("late").select(col("l_orderkey").alias("k"), col("l_suppkey").alias("s"))
    same = (col("l_orderkey") == col("k")) & (col("l_suppkey") != col("s"))
    found = lines.where("late").join(failed, col("l_orderkey") == col("o_orderkey"), "left_semi").join(others, same, "left_semi").join(late, same, "left_anti")
    return _q21_result(found, spark, sf)


def q21_ff(spark: SparkSession, sf: str) -> DataFrame:
    """The order's filter after the other joins."""
    lines = _q21_lines(spark, sf)
    others = lines.select(col("l_orderkey").alias("k"), col("l_suppkey").alias("s"))
    late = lines.where("late").select(col("l_orderkey").alias("k"), col("l_suppkey").alias("s"))
    same = (col("l_orderkey") == col("k")) & (col("l_suppkey") != col("s"))
    found = lines.where("late").join(late, same, "left_anti").join(others, same, "left_semi").join(orders(spark, sf), col("l_orderkey") == col("o_orderkey")).where("o_orderstatus = 'F'")
    return _q21_result(found.select("l_orderkey", "l_suppkey"), spark, sf)


def q21_opt(spark: SparkSession, sf: str) -> DataFrame:
    """Least and largest supplier of each order, and of its late lines, instead of two self-joins: one shuffle of the lines."""
    failed = orders(spark, sf).where("o_orderstatus = 'F'").select("o_orderkey")
    lines = _q21_lines(spark, sf).join(failed, col("l_orderkey") == col("o_orderkey"), "left_semi")
    on, own = Window.partitionBy("l_orderkey"), F.when(col("late"), col("l_suppkey"))
    marked = lines.withColumns({"lo": F.min("l_suppkey").over(on), "hi": F.max("l_suppkey").over(on), "late_lo": F.min(own).over(on), "late_hi": F.max(own).over(on)})
    found = marked.where("late AND lo <> hi AND late_lo = late_hi").select("l_orderkey", "l_suppkey")
    return _q21_result(found, spark, sf)


_CODES = ["13", "31", "23", "29", "30", "18", "17"]


def _q22_recent(spark, sf) -> DataFrame:
    return orders(spark, sf).where((col("o_orderdate") >= F.to_date(lit("2000-01-01"))) & (col("o_totalprice") > 200000)).select("o_custkey")


def _q22_result(kept: DataFrame) -> DataFrame:
    return kept.groupBy("cntrycode").agg(F.count(lit(1)).alias("numcust"), F.round(F.sum("c_acctbal"), 2).alias("totacctbal")).orderBy("cntrycode")


def q22(spark: SparkSession, sf: str) -> DataFrame:
    coded = customer(spark, sf).withColumn("cntrycode", F.substring("c_phone", 1, 2)).where(col("cntrycode").isin(_CODES)).select("c_custkey", "cntrycode", "c_acctbal")
    mean = coded.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = coded.join(F.broadcast(mean), col("c_acctbal") > col("mean"), "left_semi")
    return _q22_result(rich.join(_q22_recent(spark, sf), col("c_custkey") == col("o_custkey"), "left_anti"))


def q22_opt(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts that aren't positive go first, as the mean is positive; customers with orders by a flag of one aggregate."""
    coded = customer(spark, sf).withColumn("cntrycode", F.substring("c_phone", 1, 2)).where(col("cntrycode").isin(_CODES) & (col("c_acctbal") > 0)).select("c_custkey", "cntrycode", "c_acctbal")
    rich = coded.crossJoin(F.broadcast(coded.agg(F.avg("c_acctbal").alias("mean")))).where("c_acctbal > mean")
    has = _q22_recent(spark, sf).select(col("o_custkey").alias("k")).distinct().withColumn("has", lit(True))
    return _q22_result(rich.join(has, col("c_custkey") == col("k"), "left").where(col("has").isNull()))


QUERIES = {f"tpch_{name}": f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()}

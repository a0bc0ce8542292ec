"""The query suite in standard SQL, for an independent engine to check results against."""

from __future__ import annotations

from .fixtures import with_fixtures
from .tpch import QUERIES

_REVENUE = "ROUND(SUM(l_extendedprice * (1 - l_discount)), 4)"

_SQL = {
    "q01": """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
        ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
        ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 6) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
        FROM lx WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL ORDER BY 1, 2""",
    "q02": """SELECT s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_address, s_phone, s_comment
        FROM px, sx, psx, nation, region
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size BETWEEN 10 AND 20 AND p_type LIKE '%ARD' AND s_nationkey = n_nationkey
          AND n_regionkey = r_regionkey AND r_name = 'EUROPE' AND ps_supplycost = (
            SELECT MIN(ps_supplycost) FROM psx ps2, sx s2, nation n2, region r2 WHERE px.p_partkey = ps2.ps_partkey AND s2.s_suppkey = ps2.ps_suppkey
              AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q03": f"""SELECT l_orderkey, {_REVENUE} AS revenue, o_orderdate, o_shippriority FROM cx, ox, lx
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'
        GROUP BY l_orderkey, o_orderdate, o_shippriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04": """SELECT o_orderpriority, COUNT(*) AS order_count FROM ox WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
        AND EXISTS (SELECT 1 FROM lx WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate) GROUP BY 1 ORDER BY 1""",
    "q05": f"""SELECT n_name, {_REVENUE} AS revenue FROM cx, ox, lx, sx, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
        AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY 1 ORDER BY 2 DESC, 1""",
    "q06": """SELECT ROUND(SUM(l_extendedprice * l_discount), 4) AS revenue FROM lx WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
        AND l_discount BETWEEN 0.05::DOUBLE AND 0.07::DOUBLE AND l_quantity < 24""",
    "q07": f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(YEAR(l_shipdate) AS INT) AS l_year, {_REVENUE} AS revenue
        FROM sx, lx, ox, cx, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey
        AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
        GROUP BY 1, 2, 3 ORDER BY 1, 2, 3""",
    "q08": """SELECT o_year, ROUND(SUM(CASE WHEN nation = 'NATION_7' THEN volume ELSE 0 END) / SUM(volume), 8) AS mkt_share FROM (
        SELECT CAST(YEAR(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation FROM px, sx, lx, ox, cx, nation n1, nation n2, region
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
        AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' AND p_type = 'ECONOMY') GROUP BY 1 ORDER BY 1""",
    "q09": """SELECT n_name AS nation, CAST(YEAR(o_orderdate) AS INT) AS o_year, ROUND(SUM(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 4) AS sum_profit
        FROM px, sx, lx, psx, ox, nation WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
        AND s_nationkey = n_nationkey AND p_name LIKE '%blue%' GROUP BY 1, 2 ORDER BY 1, 2 DESC""",
    "q10": f"""SELECT c_custkey, c_name, c_acctbal, c_phone, n_name, c_address, c_comment, {_REVENUE} AS revenue FROM cx, ox, lx, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R'
        AND c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4, 5, 6, 7 ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11": """WITH sums AS (SELECT ps_partkey, CAST(SUM(CAST(ps_supplycost * 100 AS BIGINT) * ps_availqty) AS DOUBLE) / 100 AS v FROM psx GROUP BY 1)
        SELECT ps_partkey, ROUND(v, 2) AS value FROM sums WHERE v > (SELECT SUM(v) * 0.001::DOUBLE FROM sums) ORDER BY 2 DESC, 1""",
    "q12": """SELECT l_shipmode, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
        CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count FROM ox, lx
        WHERE o_orderkey = l_orderkey AND l_shipmode IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate
        AND l_receiptdate >= DATE '1996-01-01' AND l_receiptdate < DATE '1997-01-01' GROUP BY 1 ORDER BY 1""",
    "q13": """SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM cx LEFT JOIN ox
        ON c_custkey = o_custkey AND o_comment NOT LIKE '%special%requests%' GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 DESC""",
    "q14": """SELECT ROUND(100.0::DOUBLE * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / SUM(l_extendedprice * (1 - l_discount)), 8)
        AS promo_revenue FROM lx, px WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""",
    "q15": f"""WITH sums AS (SELECT l_suppkey, {_REVENUE} AS total_revenue FROM lx WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY 1)
        SELECT s_suppkey, s_name, s_address, s_phone, total_revenue FROM sx, sums WHERE s_suppkey = l_suppkey AND total_revenue = (SELECT MAX(total_revenue) FROM sums) ORDER BY 1""",
    "q16": """SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM psx, px WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#11'
        AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM sx WHERE s_comment LIKE '%Customer%Complaints%')
        GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3""",
    "q17": """SELECT ROUND(SUM(l_extendedprice) / 7.0::DOUBLE, 6) AS avg_yearly FROM lx, px WHERE p_partkey = l_partkey AND p_brand = 'Brand#12'
        AND l_quantity < (SELECT 0.2::DOUBLE * AVG(l2.l_quantity) FROM lx l2 WHERE l2.l_partkey = px.p_partkey)""",
    "q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, ROUND(SUM(l_quantity), 2) AS sum_qty FROM cx, ox, lx
        WHERE o_orderkey IN (SELECT l_orderkey FROM lx GROUP BY 1 HAVING SUM(l_quantity) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY 1, 2, 3, 4, 5 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19": f"""SELECT {_REVENUE} AS revenue FROM lx, px WHERE p_partkey = l_partkey AND l_shipmode IN ('AIR', 'AIR REG') AND l_shipinstruct = 'DELIVER IN PERSON' AND (
        (p_container IN ('SM CASE', 'SM BOX', 'SM PACK') AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
        OR (p_container IN ('MED BAG', 'MED BOX', 'MED PKG') AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
        OR (p_container IN ('LG CASE', 'LG BOX') AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45))""",
    "q20": """SELECT s_name, s_address FROM sx, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM psx WHERE ps_partkey IN (SELECT p_partkey FROM px WHERE p_name LIKE 'blue%')
        AND ps_availqty > (SELECT 0.5::DOUBLE * SUM(l_quantity) FROM lx WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01'
        AND l_shipdate < DATE '1997-01-01')) AND s_nationkey = n_nationkey AND n_name = 'NATION_7' ORDER BY 1""",
    "q21": """SELECT s_name, COUNT(*) AS numwait FROM sx, lx l1, ox WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
        AND l1.l_receiptdate > l1.l_commitdate AND EXISTS (SELECT 1 FROM lx l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lx l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_receiptdate > l3.l_commitdate)
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
    "q22": """WITH coded AS (SELECT c_custkey, SUBSTRING(c_phone, 1, 2) AS cntrycode, c_acctbal FROM cx WHERE SUBSTRING(c_phone, 1, 2) IN ('13', '31', '23', '29', '30', '18', '17'))
        SELECT cntrycode, COUNT(*) AS numcust, ROUND(SUM(c_acctbal), 2) AS totacctbal FROM coded WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM coded WHERE c_acctbal > 0)
        AND NOT EXISTS (SELECT 1 FROM ox WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-01-01' AND o_totalprice > 200000) GROUP BY 1 ORDER BY 1""",
}

#: Variants return the rows of their query.
ORACLE_SQL = {name: with_fixtures(_SQL[name.split("_")[1]]) for name in QUERIES}

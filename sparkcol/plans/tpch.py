"""The 22 decision-support queries, with parameters that suit the data at hand.

The texts are standard SQL and run on other engines as they are. Sums are over decimals, so they don't depend on the
order of rows; every LIMIT has a total order. ``{partsupp}`` stands for the derived table of that name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import PARTSUPP, TPCH, load_tables

REVENUE = "l_extendedprice * (1 - l_discount)"


Sum = Callable[[str, int], str]


def _decimal_sum(x: str, scale: int = 4) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def _long_sum(x: str, scale: int = 4) -> str:
    """The same sum for Spark, whose cast of a double to a decimal goes through text: units of the last place as longs, summed in
    millions and the rest apart, so that no sum overflows, and put together as one decimal."""
    units = f"FLOOR(({x}) * 1e{scale} + 0.5D)"
    whole = f"(CAST(SUM({units} DIV 1000000) AS DECIMAL(31,0)) * 1000000 + CAST(SUM({units} % 1000000) AS DECIMAL(31,0)))"
    return f"CAST({whole} / {10**scale} AS DOUBLE)"


#: Parameters by query. Replace any of them through ``text(q, name=value)``.
PARAMETERS: dict[int, dict[str, object]] = {
    1: {"until": "1998-09-02"},
    2: {"size": 15, "type": "%ARD", "region": "EUROPE"},
    3: {"segment": "BUILDING", "date": "1998-03-15"},
    4: {"from": "1996-07-01", "to": "1996-10-01"},
    5: {"region": "ASIA", "from": "1996-01-01", "to": "1997-01-01"},
    6: {"from": "1996-01-01", "to": "1997-01-01", "low": 0.05, "high": 0.07, "quantity": 24},
    7: {"a": "NATION_6", "b": "NATION_7", "from": "1995-01-01", "to": "1996-12-31"},
    8: {"region": "AMERICA", "nation": "NATION_2", "type": "ECONOMY", "from": "1995-01-01", "to": "1996-12-31"},
    9: {"name": "%red%"},
    10: {"from": "1996-10-01", "to": "1997-01-01"},
    11: {"nation": "NATION_7", "fraction": 0.001},
    12: {"flags": "'A', 'N'", "from": "1996-01-01", "to": "1997-01-01"},
    13: {"pattern": "%-%H%"},
    14: {"from": "1996-09-01", "to": "1996-10-01", "type": "PROMO%"},
    15: {"from": "1996-01-01", "to": "1996-04-01"},
    16: {"brand": "Brand#5", "type": "MEDIUM%", "sizes": "3, 9, 14, 19, 23, 36, 45, 49"},
    17: {"brand": "Brand#23"},
    18: {"quantity": 250},
    19: {"b1": "Brand#12", "b2": "Brand#23", "b3": "Brand#4"},
    20: {"name": "red%", "nation": "NATION_15", "from": "1996-01-01", "to": "1997-01-01"},
    21: {"nation": "NATION_15", "late": "R"},
    22: {"prefixes": "'BU', 'MA', 'HO'", "before": "1996-01-01"},
}


def _texts(_sum: Sum) -> dict[int, str]:
    return {
    1: f"""
SELECT l_returnflag, l_linestatus, {_sum("l_quantity")} AS sum_qty, {_sum("l_extendedprice")} AS sum_base_price,
  {_sum(REVENUE)} AS sum_disc_price, {_sum(REVENUE + " * (1 + l_tax)", 6)} AS sum_charge,
  ROUND({_sum("l_quantity")} / COUNT(*), 6) AS avg_qty, ROUND({_sum("l_extendedprice")} / COUNT(*), 6) AS avg_price,
  ROUND({_sum("l_discount")} / COUNT(*), 6) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '{{until}}' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    2: """
WITH partsupp AS ({partsupp}), offers AS (
  SELECT p_partkey, p_name, s_suppkey, s_name, s_acctbal, n_name, ps_supplycost
  FROM partsupp JOIN part ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = '{region}' AND p_size = {size} AND p_type LIKE '{type}'),
least AS (SELECT p_partkey AS k, MIN(ps_supplycost) AS cost FROM offers GROUP BY p_partkey)
SELECT s_acctbal, s_name, n_name, p_partkey, p_name, ps_supplycost FROM offers JOIN least ON p_partkey = k AND ps_supplycost = cost
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    3: f"""
SELECT l_orderkey, {_sum(REVENUE)} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = '{{segment}}' AND o_orderdate < DATE '{{date}}' AND l_shipdate > DATE '{{date}}'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    4: """
SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '{from}' AND o_orderdate < DATE '{to}' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    5: f"""
SELECT n_name, {_sum(REVENUE)} AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = '{{region}}' AND o_orderdate >= DATE '{{from}}' AND o_orderdate < DATE '{{to}}'
GROUP BY n_name ORDER BY revenue DESC, n_name""",
    6: f"""
SELECT {_sum("l_extendedprice * l_discount")} AS revenue FROM lineitem
WHERE l_shipdate >= DATE '{{from}}' AND l_shipdate < DATE '{{to}}' AND l_discount BETWEEN {{low}} AND {{high}} AND l_quantity < {{quantity}}""",
    7: f"""
SELECT supp_nation, cust_nation, l_year, {_sum("volume")} AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS l_year, {REVENUE} AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
  WHERE ((n1.n_name = '{{a}}' AND n2.n_name = '{{b}}') OR (n1.n_name = '{{b}}' AND n2.n_name = '{{a}}')) AND l_shipdate BETWEEN DATE '{{from}}' AND DATE '{{to}}') s
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    8: f"""
SELECT o_year, ROUND({_sum("CASE WHEN nation = '{nation}' THEN volume ELSE 0 END")} / NULLIF({_sum("volume")}, 0), 6) AS mkt_share FROM (
  SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = '{{region}}' AND o_orderdate BETWEEN DATE '{{from}}' AND DATE '{{to}}' AND p_type = '{{type}}') s
GROUP BY o_year ORDER BY o_year""",
    9: f"""
WITH partsupp AS ({{partsupp}})
SELECT nation, o_year, {_sum("amount", 6)} AS sum_profit FROM (
  SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, {REVENUE} - ps_supplycost * l_quantity AS amount
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey
    JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
  WHERE p_name LIKE '{{name}}') s
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    10: f"""
SELECT c_custkey, c_name, {_sum(REVENUE)} AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '{{from}}' AND o_orderdate < DATE '{{to}}' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    11: f"""
WITH partsupp AS ({{partsupp}}), held AS (
  SELECT ps_partkey, {_sum("ps_supplycost * ps_availqty")} AS value
  FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = '{{nation}}' GROUP BY ps_partkey)
SELECT ps_partkey, value FROM held WHERE value > (SELECT {_sum("value")} * {{fraction}} FROM held) ORDER BY value DESC, ps_partkey""",
    12: """
SELECT l_linestatus, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(SUM(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag IN ({flags}) AND l_shipdate > o_orderdate AND l_shipdate >= DATE '{from}' AND l_shipdate < DATE '{to}'
GROUP BY l_linestatus ORDER BY l_linestatus""",
    13: """
WITH counted AS (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '{pattern}' GROUP BY o_custkey)
SELECT COALESCE(n, 0) AS c_count, COUNT(*) AS custdist FROM customer LEFT JOIN counted ON c_custkey = o_custkey
GROUP BY COALESCE(n, 0) ORDER BY custdist DESC, c_count DESC""",
    14: f"""
SELECT ROUND(100.0 * {_sum("CASE WHEN p_type LIKE '{type}' THEN " + REVENUE + " ELSE 0 END")} / NULLIF({_sum(REVENUE)}, 0), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '{{from}}' AND l_shipdate < DATE '{{to}}'""",
    15: f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, {_sum(REVENUE)} AS total_revenue FROM lineitem
  WHERE l_shipdate >= DATE '{{from}}' AND l_shipdate < DATE '{{to}}' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT MAX(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    16: """
WITH partsupp AS ({partsupp})
SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> '{brand}' AND p_type NOT LIKE '{type}' AND p_size IN ({sizes}) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    17: f"""
WITH usual AS (SELECT l_partkey AS k, 0.2 * AVG(l_quantity) AS least FROM lineitem GROUP BY l_partkey)
SELECT ROUND({_sum("l_extendedprice")} / 7.0, 6) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey JOIN usual ON k = l_partkey
WHERE p_brand = '{{brand}}' AND l_quantity < least""",
    18: f"""
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, {_sum("l_quantity")} AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > {{quantity}})
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    19: f"""
SELECT {_sum(REVENUE)} AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = '{{b1}}' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_brand = '{{b2}}' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = '{{b3}}' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""",
    20: """
WITH partsupp AS ({partsupp}), sold AS (SELECT l_partkey AS k1, l_suppkey AS k2, 0.5 * SUM(l_quantity) AS half FROM lineitem
  WHERE l_shipdate >= DATE '{from}' AND l_shipdate < DATE '{to}' GROUP BY l_partkey, l_suppkey)
SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_name = '{nation}' AND s_suppkey IN (SELECT ps_suppkey FROM partsupp JOIN sold ON k1 = ps_partkey AND k2 = ps_suppkey
  WHERE ps_availqty > half AND ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '{name}')) ORDER BY s_suppkey""",
    21: """
SELECT s_name, COUNT(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l1.l_returnflag = '{late}' AND n_name = '{nation}'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = '{late}')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    22: f"""
WITH asked AS (SELECT SUBSTRING(c_mktsegment, 1, 2) AS code, c_acctbal, c_custkey FROM customer WHERE SUBSTRING(c_mktsegment, 1, 2) IN ({{prefixes}}))
SELECT code, COUNT(*) AS numcust, {_sum("c_acctbal")} AS totacctbal FROM asked
WHERE c_acctbal > (SELECT AVG(CAST(c_acctbal AS DECIMAL(18,4))) FROM asked WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < DATE '{{before}}')
GROUP BY code ORDER BY code""",
    }


TEXTS, SPARK_TEXTS = _texts(_decimal_sum), _texts(_long_sum)


def _offers(condition: str) -> str:
    """The derived table of offers for some keys only: they are what it groups by, so the rest is never aggregated."""
    quick = PARTSUPP.replace("CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS BIGINT)", "SUM(FLOOR(l_quantity * 100 + 0.5D)) DIV 100")
    return quick.replace(" FROM lineitem ", f" FROM lineitem WHERE {condition} ")


#: Texts that say the same with less work, for Spark: sums of longs; keys are restricted before lines are aggregated, and EXISTS and NOT EXISTS over the
#: other suppliers of an order are one aggregation (two suppliers or more, a single late one).
PLANS: dict[int, str] = SPARK_TEXTS | {
    2: SPARK_TEXTS[2].replace("{partsupp}", _offers("l_partkey IN (SELECT p_partkey FROM part WHERE p_size = {size} AND p_type LIKE '{type}')")),
    9: SPARK_TEXTS[9].replace("{partsupp}", _offers("l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '{name}')")),
    11: SPARK_TEXTS[11].replace("{partsupp}", _offers("l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = '{nation}')")),
    16: SPARK_TEXTS[16].replace("{partsupp}", _offers("l_partkey IN (SELECT p_partkey FROM part WHERE p_brand <> '{brand}' AND p_type NOT LIKE '{type}' AND p_size IN ({sizes}))")),
    17: SPARK_TEXTS[17].replace("FROM lineitem GROUP BY", "FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = '{brand}') GROUP BY"),
    20: SPARK_TEXTS[20]
    .replace("{partsupp}", _offers("l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '{name}')"))
    .replace("WHERE l_shipdate", "WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '{name}') AND l_shipdate"),
    21: """
WITH suppliers AS (SELECT l_orderkey AS k, MIN(l_suppkey) AS a, MAX(l_suppkey) AS b, MIN(CASE WHEN l_returnflag = '{late}' THEN l_suppkey END) AS la,
  MAX(CASE WHEN l_returnflag = '{late}' THEN l_suppkey END) AS lb FROM lineitem GROUP BY l_orderkey)
SELECT s_name, COUNT(*) AS numwait FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
  JOIN suppliers ON k = l_orderkey
WHERE o_orderstatus = 'F' AND l_returnflag = '{late}' AND n_name = '{nation}' AND a < b AND la = lb
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
}


def text(q: int, plan: bool = False, **parameters: object) -> str:
    """The text of a query; with ``plan`` the one that Spark runs."""
    out = (PLANS if plan else TEXTS)[q].replace("{partsupp}", PARTSUPP)
    for name, value in (PARAMETERS[q] | parameters).items():
        out = out.replace("{" + name + "}", str(value))
    return out.strip()


def run(spark: SparkSession, sf_dir: str, q: int, **parameters: object) -> DataFrame:
    asked = text(q, True, **parameters)
    load_tables(spark, sf_dir, tuple(t for t in TPCH if re.search(rf"\b{t}\b", asked)))
    return spark.sql(asked)

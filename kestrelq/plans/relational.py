"""Whole queries and relational operators over the star schema.

Money is summed as decimal and returned as double, so results are exact in any order; counts are long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.operators import groups, joins, pairs
from kestrelq.plans.case import Cases
from kestrelq.session import table

cases = Cases()
QUERIES, ORACLE = cases.queries, cases.oracle
ts = lambda s: F.lit(s).cast("timestamp_ntz")
total = lambda c, name: F.sum(groups.money(c)).cast("double").alias(name)


@cases.frame("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc_price,
  count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q1_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    discounted = groups.money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= ts("1998-09-02 00:00:00"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(total("l_quantity", "sum_qty"), total("l_extendedprice", "sum_base_price"), F.sum(discounted).cast("double").alias("sum_disc_price"), F.count("*").alias("count_order"))
    )


REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue"
cases.sql("q3_shipping_priority", "customer orders lineitem", f"""
SELECT l_orderkey, o_orderdate, {REVENUE} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP_NTZ '1998-03-15' AND l_shipdate > TIMESTAMP_NTZ '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
ORACLE["q3_shipping_priority"] = ORACLE["q3_shipping_priority"].replace("TIMESTAMP_NTZ", "TIMESTAMP")
cases.sql("q5_local_supplier_volume", "customer orders lineitem supplier nation region", f"""
SELECT n_name, {REVENUE} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY n_name""")
cases.sql("q6_forecast_revenue", "lineitem", """
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue
FROM lineitem WHERE l_discount BETWEEN 0.049 AND 0.071 AND l_quantity < 24""")
cases.sql("q4_order_priority_exists", "orders lineitem", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority""")
cases.sql("q10_returned_items", "customer orders lineitem nation", f"""
SELECT c_custkey, n_name, {REVENUE} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
cases.sql("q12_case_counts", "orders lineitem", """
SELECT l_linestatus, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS low
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus""".replace("sum(CASE", "count(CASE").replace(" ELSE 0", ""))
cases.sql("q18_large_orders", "customer orders lineitem", """
SELECT c_custkey, o_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(CAST(l_quantity AS DECIMAL(18,2))) > 200)
GROUP BY c_custkey, o_orderkey""")

# scans, filters, projections
cases.sql("scan_project", "lineitem", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
cases.sql("filter_range", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey > 100")
cases.sql("filter_in_like", "part", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#3', 'Brand#11', 'Brand#12') AND p_name LIKE '%a%'")
cases.sql("project_case_coalesce", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders")

# joins
cases.sql("join_inner", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
cases.sql("join_left_predicate", "customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
cases.sql("join_right", "customer orders", "SELECT o_orderkey, c_custkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0")


@cases.frame("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal")
def join_full(spark, sf_dir):
    """Few nations, so blocks of each, and rows without partners apart from the pairs."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return pairs.full(s, c, ("s_nationkey", "c_nationkey"), ("s_acctbal", "c_acctbal")).select("s_suppkey", "c_custkey")


cases.sql("join_cross_small", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")


@cases.frame("SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_suppkey > b.s_suppkey")
def join_theta(spark, sf_dir):
    """No key: pairs of blocks, each in a task of its own."""
    s = table(spark, sf_dir, "supplier")
    a, b = (s.select(F.col("s_suppkey").alias(f"{x}_key"), F.col("s_acctbal").alias(f"{x}_acctbal")) for x in "ab")
    return pairs.matched(a, b, None, F.expr("a_acctbal < b_acctbal AND a_key > b_key")).select("a_key", "b_key")


@cases.frame("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@cases.frame("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


ASOF_SQL = """
WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT event_id, c.user_id, c.ts, p.value AS asof_value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts"""


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value")


@cases.frame(ASOF_SQL)
def join_asof(spark, sf_dir):
    return joins.asof(*_sides(spark, sf_dir), "user_id", "ts", "ts", ["value"])


@cases.frame(ASOF_SQL)
def join_asof_chunked(spark, sf_dir):
    return joins.asof_chunked(*_sides(spark, sf_dir), "user_id", "ts", "ts", ["value"])


@cases.frame("""
SELECT c.event_id AS event_id, p.event_id AS r_event_id FROM events c JOIN events p
ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 DAY""")
def join_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = joins.interval(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", "ts", 86_400)
    return out.select("event_id", "r_event_id")


@cases.frame("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber")  # noqa: E741
    return joins.salted(l, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k").drop("k")


# aggregation
cases.sql("agg_basic", "orders", "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderpriority")
cases.sql("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
cases.sql("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
cases.sql("agg_filter", "lineitem", "SELECT count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS full_price FROM lineitem")
cases.sql("agg_rollup", "customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
cases.sql("agg_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
cases.sql("agg_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
cases.sql("agg_percentile", "lineitem", "SELECT l_returnflag, median(l_quantity) AS med, percentile(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
cases.sql("agg_statistics", "lineitem", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag")
cases.sql("agg_skew_kurtosis", "lineitem", "SELECT round(skewness(l_quantity) * sqrt(count(*) * (count(*) - 1)) / (count(*) - 2), 6) AS sk, round(kurtosis(l_quantity), 6) AS ku FROM lineitem", "SELECT round(skewness(l_quantity), 6) AS sk, round(kurtosis_pop(l_quantity), 6) AS ku FROM lineitem")
cases.sql("agg_mode", "lineitem", "SELECT l_returnflag, mode(l_linenumber, true) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, l_linenumber AS m FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS k FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1")
cases.sql("agg_arg_max", "events", "SELECT user_id, max_by(event_id, ts) AS last_event FROM events GROUP BY user_id", "SELECT user_id, arg_max(event_id, ts) AS last_event FROM events GROUP BY user_id")
cases.sql("agg_ordered_list", "nation", "SELECT n_regionkey, concat_ws(',', array_sort(collect_list(n_name))) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
cases.sql("agg_histogram", "customer", "SELECT CAST(width_bucket(c_acctbal, -1000, 10000, 10) AS INT) AS b, count(*) AS n FROM customer GROUP BY 1", "SELECT CAST(CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 11 ELSE floor((c_acctbal + 1000) / 1100.0) + 1 END AS INT) AS b, count(*) AS n FROM customer GROUP BY 1")


@cases.frame("SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def agg_latest_row(spark, sf_dir):
    return groups.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_type"), ["user_id"], ["ts"])


@cases.frame("SELECT DISTINCT o_custkey FROM orders")
def agg_dedup(spark, sf_dir):
    return table(spark, sf_dir, "orders").dropDuplicates(["o_custkey"]).select("o_custkey")


@cases.frame("SELECT true AS close, count(DISTINCT l_orderkey) AS exact FROM lineitem")
def agg_approx_distinct(spark, sf_dir):
    """Whether the HyperLogLog count is within 5 % of the exact one (engines' sketches differ), and the exact one."""
    out = table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("approx"), F.countDistinct("l_orderkey").alias("exact"))
    return out.select((F.abs(F.col("approx") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"), "exact")


cases.sql("agg_avg", "lineitem", "SELECT l_returnflag, round(avg(l_quantity), 6) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS lo, max(l_discount) AS hi, count(*) AS n FROM lineitem GROUP BY l_returnflag")
cases.sql("agg_grouping_id", "orders", "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
cases.sql("agg_covariance", "lineitem", "SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 2) AS p, round(covar_samp(l_quantity, l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag")
cases.sql("agg_kurtosis_sample", "lineitem", """WITH k AS (SELECT count(*) AS n, kurtosis(l_extendedprice) AS k FROM lineitem)
SELECT round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6), 6) AS k FROM k""", "SELECT round(kurtosis(l_extendedprice), 6) AS k FROM lineitem")
cases.sql("agg_listagg", "nation", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
cases.sql("subquery_not_in_null", "customer orders", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END FROM orders)")
cases.sql("q5_region_year", "customer orders lineitem supplier nation region", f"""
SELECT n_name, {REVENUE} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_regionkey IN (1, 2) AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1999-01-01' GROUP BY n_name""")
ORACLE["q5_region_year"] = ORACLE["q5_region_year"].replace("TIMESTAMP_NTZ", "TIMESTAMP")
cases.sql("q6_year", "lineitem", """
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1997-01-01' AND l_discount BETWEEN 0.049 AND 0.071 AND l_quantity < 24""")
ORACLE["q6_year"] = ORACLE["q6_year"].replace("TIMESTAMP_NTZ", "TIMESTAMP")


@cases.frame("SELECT l_returnflag, median(l_quantity) AS med FROM lineitem GROUP BY l_returnflag")
def agg_median_by_counts(spark, sf_dir):
    """The exact median from counts by value and their running sums: no group's values meet in one buffer."""
    counts = table(spark, sf_dir, "lineitem").where("l_quantity IS NOT NULL").groupBy("l_returnflag", F.col("l_quantity").alias("x")).agg(F.count("*").alias("c"))
    return groups.median(counts, "l_returnflag", "x", "c", "med")


@cases.frame("""SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag""")
def reshape_pivot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


@cases.frame("SELECT c_custkey, 'c_acctbal' AS k, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer")
def reshape_unpivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return c.unpivot("c_custkey", ["c_acctbal", "c_nationkey"], "k", "v")


# windows
cases.sql("window_ranking", "orders", """SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER v AS INT) AS rk, CAST(dense_rank() OVER v AS INT) AS dr,
percent_rank() OVER v AS pr, cume_dist() OVER v AS cd, CAST(ntile(4) OVER w AS INT) AS nt FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
cases.sql("window_offsets", "events", """SELECT event_id, lag(value) OVER w AS prev, lead(value) OVER w AS next, first_value(value) OVER w AS first, nth_value(value, 2) OVER w AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
cases.sql("window_rows_frame", "events", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM events")
cases.sql("window_range_frame", "events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
cases.sql("window_ignore_nulls", "events", "SELECT event_id, last_value(nullif(event_type, 'view')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM events", "SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM events")


@cases.frame("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rn FROM orders QUALIFY rn <= 2")
def topk_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return groups.top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).drop("o_totalprice")


# sorts, sets, subqueries
cases.sql("sort_limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
cases.sql("sort_nulls", "orders", "SELECT DISTINCT nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s ASC NULLS LAST LIMIT 3")
cases.sql("set_distinct", "lineitem", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
cases.sql("set_union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
cases.sql("set_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
cases.sql("set_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
cases.sql("set_intersect_all", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
cases.sql("set_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20")
cases.sql("set_except_all", "customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
cases.sql("subquery_scalar", "orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
cases.sql("subquery_not_in", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 200000)")
cases.sql("subquery_recursive", "region", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")
cases.sql("subquery_lateral", "region nation", "SELECT r_name, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) t")
cases.sql("sample_by_hash", "orders", "SELECT o_orderkey FROM orders WHERE substr(md5(CAST(o_orderkey AS STRING)), 1, 1) = '0'", "SELECT o_orderkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) = '0'")

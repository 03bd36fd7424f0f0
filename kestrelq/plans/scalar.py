"""Scalar functions: string, date, math, array, map, JSON; and Python functions of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.functions import python_functions as pf
from kestrelq.operators import joins
from kestrelq.plans.case import Cases
from kestrelq.session import register, table

cases = Cases()
QUERIES, ORACLE = cases.queries, cases.oracle

cases.sql("string_basic", "part", "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 4) AS sub, CAST(length(p_name) AS INT) AS n, p_name || '-' || p_brand AS c, replace(p_brand, '#', '_') AS r, lpad(p_brand, 12, '*') AS l, trim('  x  ') AS t, reverse(p_name) AS v FROM part")
cases.sql("string_regexp", "part", "SELECT p_partkey, split_part(p_brand, '#', 2) AS s, CAST(instr(p_brand, '#') AS INT) AS i, regexp_extract(p_brand, '([0-9]+)', 1) AS e, regexp_replace(p_brand, '[a-z]', '.') AS x FROM part WHERE regexp_like(p_brand, '^B')", "SELECT p_partkey, split_part(p_brand, '#', 2) AS s, CAST(instr(p_brand, '#') AS INT) AS i, regexp_extract(p_brand, '([0-9]+)', 1) AS e, regexp_replace(p_brand, '[a-z]', '.', 'g') AS x FROM part WHERE regexp_matches(p_brand, '^B')")
cases.sql("string_hash", "part", "SELECT p_partkey, CAST(levenshtein(p_name, p_brand) AS INT) AS d, md5(p_name) AS m, sha2(p_name, 256) AS s FROM part", "SELECT p_partkey, CAST(levenshtein(p_name, p_brand) AS INT) AS d, md5(p_name) AS m, sha256(p_name) AS s FROM part")
cases.sql("string_unicode", "documents", "SELECT doc_id, CAST(length(text) AS INT) AS n, CAST(octet_length(text) AS INT) AS b, lower(text) AS l, CAST(size(filter(split(text, ' '), x -> x <> '')) AS INT) AS w FROM documents", "SELECT doc_id, CAST(length(text) AS INT) AS n, CAST(strlen(text) AS INT) AS b, lower(text) AS l, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS INT) AS w FROM documents")
cases.sql("date_parts", "orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(quarter(o_orderdate) AS INT) AS q, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(dayofweek(o_orderdate) - 1 AS INT) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS t FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(quarter(o_orderdate) AS INT) AS q, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(dayofweek(o_orderdate) AS INT) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t FROM orders")
cases.sql("date_epoch", "events", "SELECT event_id, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events", "SELECT event_id, epoch_us(ts) AS us FROM events")
cases.sql("math_functions", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity - 25) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(sqrt(l_quantity), 6) AS s, round(ln(l_quantity), 6) AS l, round(log10(l_quantity), 6) AS g, round(exp(l_discount), 6) AS e, CAST(sign(l_quantity - 25) AS INT) AS n, round(degrees(atan2(l_quantity, 10)), 6) AS d FROM lineitem")
cases.sql("math_integer", "orders", "SELECT o_orderkey, (o_custkey - 700) DIV 7 AS q, (o_custkey - 700) % 7 AS m FROM orders", "SELECT o_orderkey, (o_custkey - 700) // 7 AS q, (o_custkey - 700) % 7 AS m FROM orders")
cases.sql("math_round_money", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DOUBLE) AS r FROM lineitem")
cases.sql("math_division_by_zero", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / nullif(l_discount, 0) AS x FROM lineitem")
cases.sql("array_access", "embeddings", "SELECT vec_id, CAST(size(embedding) AS INT) AS n, CAST(element_at(embedding, 1) AS DOUBLE) AS a, CAST(embedding[1] AS DOUBLE) AS b, CAST(array_max(embedding) AS DOUBLE) AS m FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings")
cases.sql("array_explode", "embeddings", "SELECT vec_id, CAST(p AS INT) AS p, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, v", "SELECT vec_id, CAST(p - 1 AS INT) AS p, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings)")
cases.sql("array_dot_product", "embeddings", "SELECT vec_id, round(aggregate(zip_with(embedding, embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x), 6) AS dot FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS dot FROM embeddings")
cases.sql("string_upper_unicode", "documents", "SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS u FROM documents")
cases.sql("math_power", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, power(l_quantity, 2) AS p, round(power(l_discount + 1, 0.5), 9) AS r FROM lineitem")
cases.sql("array_slice", "embeddings", "SELECT vec_id, CAST(p AS INT) AS p, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(slice(embedding, 3, 4)) t AS p, v", "SELECT vec_id, CAST(p - 1 AS INT) AS p, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding[3:6]) AS v, generate_subscripts(embedding[3:6], 1) AS p FROM embeddings)")
cases.sql("array_transform", "embeddings", "SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * 2 + 1), 0D, (s, x) -> s + x), 6) AS t FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2 + 1)), 6) AS t FROM embeddings")
cases.sql("map_from_entries", "nation", "SELECT n_regionkey, element_at(map_from_entries(collect_list(struct(n_nationkey, n_name))), min(n_nationkey)) AS first FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first FROM nation GROUP BY n_regionkey")
cases.sql("json_path", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS STRING) AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events")
cases.sql("json_schema", "events", "SELECT event_id, from_json(props, 'k STRING').k AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events")
cases.sql("json_variant", "events", "SELECT event_id, try_variant_get(parse_json(props), '$.k', 'string') AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events")


@cases.frame("SELECT DISTINCT o_orderkey, CAST(datediff('day', o_orderdate, l_shipdate) AS INT) AS days, strftime(o_orderdate, '%Y-%m') AS ym FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's rows meet in one task for the join and for the distinct rows, so tasks are cut by the number of rows."""
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")  # noqa: E741
    parts = joins.parts(l)
    rows = l.repartition(parts, "l_orderkey").join(o.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", F.datediff("l_shipdate", "o_orderdate").cast("int").alias("days"), F.date_format("o_orderdate", "yyyy-MM").alias("ym")).distinct()


@cases.frame("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 + 1 AS y FROM lineitem")
def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pf.double_plus_one("l_quantity").alias("y"))


@cases.frame("SELECT p_partkey, upper(p_name) AS y FROM part")
def udf_arrow(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", pf.shout("p_name").alias("y"))


@cases.frame("SELECT l_returnflag, round(avg(l_quantity), 6) AS m FROM lineitem GROUP BY l_returnflag")
def udaf_pandas(spark, sf_dir):
    return pf.mean_by_blocks(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "m").withColumn("m", F.round("m", 6))


@cases.frame("SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w FROM nation")
def udtf_words(spark, sf_dir):
    register(spark, sf_dir, "nation")
    spark.udtf.register("kestrelq_words", pf.Words)
    return spark.sql("SELECT n_nationkey, t.word AS w FROM kestrelq_view_nation, LATERAL kestrelq_words(n_name, '_') t")


@cases.frame("SELECT c_nationkey, c_custkey, c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey) > 0 AS above FROM customer")
def udf_grouped_map(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(pf.above_mean, "c_nationkey int, c_custkey long, above boolean")


@cases.frame("SELECT n_nationkey, count(c_custkey) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def udf_cogroup(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return n.groupBy("k").cogroup(c.groupBy("k")).applyInPandas(pf.count_right, "n_nationkey int, customers long")


@cases.frame("SELECT o_orderkey, o_totalprice > 100000 AS big FROM orders")
def udf_map_arrow(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(pf.flag_big, "o_orderkey long, big boolean")


@cases.frame("SELECT o_orderkey, o_totalprice * 0.9 AS y FROM orders")
def udf_sql_defined(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kestrelq_discounted(x DOUBLE) RETURNS DOUBLE RETURN x * 0.9D")
    register(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, kestrelq_discounted(o_totalprice) AS y FROM kestrelq_view_orders")

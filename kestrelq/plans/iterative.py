"""Queries that need rounds or blocks: exact quantiles, inequality joins, graphs, nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.operators import graphs, inequality, neighbours, quantiles
from kestrelq.plans.case import Cases
from kestrelq.session import table

cases = Cases()
QUERIES, ORACLE = cases.queries, cases.oracle


@cases.frame("SELECT l_returnflag, median(l_extendedprice) AS med, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.01) AS p01 FROM lineitem GROUP BY l_returnflag")
def agg_quantiles_by_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly all prices differ; no group's distinct values meet in one task."""
    return quantiles.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"med": 0.5, "p90": 0.9, "p01": 0.01})


@cases.frame("SELECT median(value) AS med, quantile_cont(value, 0.999) AS p999 FROM events")
def agg_quantiles_global(spark, sf_dir):
    return quantiles.quantiles(table(spark, sf_dir, "events"), [], "value", {"med": 0.5, "p999": 0.999})


@cases.frame("SELECT user_id, event_type, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY user_id, event_type")
def agg_quantiles_many_groups(spark, sf_dir):
    """Many small groups: what is kept is a row for each group and wanted rank."""
    return quantiles.quantiles(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75})


@cases.frame("SELECT a.s_suppkey, count(b.s_suppkey) AS n FROM supplier a LEFT JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_suppkey > b.s_suppkey GROUP BY a.s_suppkey")
def join_inequality_counts(spark, sf_dir):
    """The theta join's pairs by supplier, without the pairs."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return inequality.count_matches(s, s, ("s_acctbal", "<", "s_acctbal"), ("s_suppkey", ">", "s_suppkey")).select("s_suppkey", "n")


@cases.frame("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_totalprice <= c_acctbal * 20 AND o_custkey >= c_custkey) AS n FROM customer""")
def join_inequality_orders(spark, sf_dir):
    """Of two tables, with equal values that match: orders of customers at or after one, worth 20 balances at most."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 20).alias("limit"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    return inequality.count_matches(c, o, ("limit", ">=", "o_totalprice"), ("c_custkey", "<=", "o_custkey")).select("c_custkey", "n")


@cases.frame("SELECT event_id, CAST(rank() OVER (ORDER BY value) - 1 AS BIGINT) AS below FROM events")
def join_inequality_rank(spark, sf_dir):
    """One inequality: how many events have a smaller value. A rank over all rows without a window in one task."""
    e = table(spark, sf_dir, "events")
    return inequality.count_matches(e.select("event_id", "value"), e.select("value"), ("value", ">", "value"), name="below").select("event_id", "below")


def named(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def numbered(letter: str, key: str) -> Column:
    """A number for a node, which moves in a third of its name's bytes; ``name_of`` gives the name."""
    return F.col(key).cast("long") * 3 + "cps".index(letter)


def name_of(node: str) -> Column:
    letter = F.pmod(F.col(node), F.lit(3))
    return F.concat(F.substring(F.lit("cps"), letter.cast("int") + 1, F.lit(1)), F.expr(f"({node} - pmod({node}, 3)) div 3").cast("string"))


def bought(spark: SparkSession, sf_dir: str, name: Callable[[str, str], Column] = named) -> DataFrame:
    """Customers, parts and suppliers by line item, as node names, and the item's flag."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")  # noqa: E741
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(name("c", "o_custkey").alias("c"), name("p", "l_partkey").alias("p"), name("s", "l_suppkey").alias("s"), "l_returnflag")


BOUGHT = "b AS MATERIALIZED (SELECT 'c' || o_custkey AS c, 'p' || l_partkey AS p, 's' || l_suppkey AS s, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
STEPS = 5
PAGERANK = f"""WITH {BOUGHT}, e AS MATERIALIZED (SELECT c AS src, p AS dst FROM b UNION ALL SELECT p, c FROM b WHERE l_returnflag = 'R'),
n AS MATERIALIZED (SELECT node, count(src) AS d FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN e ON node = src GROUP BY node),
r0 AS (SELECT node, d, 1.0 / (SELECT count(*) FROM n) AS r FROM n)""" + "".join(f""",
r{k} AS MATERIALIZED (SELECT node, d, (0.15 + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE d = 0)) / (SELECT count(*) FROM n) + 0.85 * coalesce(g, 0) AS r
FROM n LEFT JOIN (SELECT dst, sum(r / d) AS g FROM e JOIN r{k - 1} ON src = node GROUP BY dst) ON node = dst)""" for k in range(1, STEPS + 1)) + f"""
SELECT node, round(CAST(r AS DOUBLE) * 1000, 9) AS rank FROM r{STEPS}"""


@cases.frame(PAGERANK.replace("1.0 / (SELECT", "1e0 / (SELECT").replace("(0.15 + 0.85 *", "(0.15e0 + 0.85e0 *").replace("+ 0.85 * coalesce", "+ 0.85e0 * coalesce"))
def graph_pagerank(spark, sf_dir):
    """A walk from customers to the parts they bought, and back from parts that were returned; all other parts dangle."""
    b = bought(spark, sf_dir, numbered)
    there, back = (F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("cp", "pc"))
    # one reading of the line items for both kinds of edges
    edges = b.select(F.inline(F.when(F.col("l_returnflag") == "R", F.array(there, back)).otherwise(F.array(there))))
    return graphs.pagerank(edges, rounds=STEPS).select(name_of("node").alias("node"), F.round(F.col("rank") * 1000, 9).alias("rank"))


LABELS = f"""WITH {BOUGHT}, u AS MATERIALIZED (SELECT DISTINCT c AS u, s AS v FROM b WHERE l_returnflag = 'R'), e AS MATERIALIZED (SELECT u, v FROM u UNION ALL SELECT v, u FROM u),
l0 AS (SELECT DISTINCT u AS node, u AS label FROM e)""" + "".join(f""",
l{k} AS MATERIALIZED (SELECT node, label FROM (SELECT e.u AS node, l.label, row_number() OVER (PARTITION BY e.u ORDER BY count(*) DESC, l.label) AS k FROM e JOIN l{k - 1} l ON e.v = l.node GROUP BY e.u, l.label) WHERE k = 1)""" for k in range(1, STEPS + 1)) + f"""
SELECT node, label FROM l{STEPS}"""


@cases.frame(LABELS)
def graph_label_propagation(spark, sf_dir):
    """Groups of customers and suppliers by returned items."""
    return graphs.propagate_labels(bought(spark, sf_dir).where("l_returnflag = 'R'"), "c", "s", rounds=STEPS)


TRIANGLES = f"""WITH {BOUGHT}, e AS MATERIALIZED (SELECT c AS u, p AS v FROM b UNION SELECT p, s FROM b UNION SELECT c, s FROM b),
t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON x.u = z.u AND y.v = z.v)
SELECT node, count(a) AS triangles FROM (SELECT u AS node FROM e UNION SELECT v FROM e) LEFT JOIN (SELECT a, a AS k FROM t UNION ALL SELECT a, b FROM t UNION ALL SELECT a, c FROM t) ON node = k GROUP BY node"""


@cases.frame(TRIANGLES)
def graph_triangles(spark, sf_dir):
    """Customers, parts and suppliers that meet in line items; suppliers are hubs."""
    b = bought(spark, sf_dir, numbered)
    pair = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    # one reading of the line items for the three kinds of edges
    edges = b.select(F.inline(F.array(pair("c", "p"), pair("p", "s"), pair("c", "s"))))
    return graphs.triangles(edges).select(name_of("node").alias("node"), "triangles")


NEIGHBOURS = """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q, b)
SELECT query, neighbour, round(d, 9) AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS INT) AS place FROM d QUALIFY place <= 10"""


@cases.frame(NEIGHBOURS)
def vector_neighbours(spark, sf_dir):
    """The ten nearest vectors of each whose number is divisible by 50, exact by bounds on cells."""
    e = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(e.where("vec_id % 50 = 0"), e, 10).withColumn("distance", F.round("distance", 9))


@cases.frame("SELECT true AS enough, count(*) * 10 AS n FROM embeddings WHERE vec_id % 50 = 0")
def vector_neighbours_by_probes(spark, sf_dir):
    """The share of the ten nearest in as many cells as a sample needs for 0.95 of them; it is 0.9 or more."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0")
    some, exact = (neighbours.nearest(q, e, 10, probes=p, exact=x).select("query", "neighbour") for p, x in ((None, False), (8, True)))
    hits = some.join(exact, ["query", "neighbour"], "left_semi").agg(F.count("*").alias("hits"))
    out = hits.join(exact.agg(F.count("*").alias("n")), F.lit(True))
    return out.select((F.col("hits") >= 0.9 * F.col("n")).alias("enough"), "n")

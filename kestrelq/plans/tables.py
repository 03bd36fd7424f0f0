"""Table functions over whole tables, collations, tables whose files differ, records that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.functions import table_functions
from kestrelq.operators.scratch import shared_path
from kestrelq.plans.case import Cases
from kestrelq.session import table
from kestrelq.sources import evolution

cases = Cases()
QUERIES, ORACLE = cases.queries, cases.oracle


@cases.frame("""WITH a AS (SELECT user_id, ts, event_type, row_number() OVER u - row_number() OVER v AS g FROM events
WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_type), v AS (PARTITION BY user_id, event_type ORDER BY ts))
SELECT user_id, event_type, min(ts) AS first, max(ts) AS last, count(*) AS n FROM a GROUP BY user_id, event_type, g""")
def udtf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types of each user, by a table function that says how its table is partitioned and ordered."""
    runs = F.udtf(table_functions.Runs)
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "event_id")
    return runs(e.asTable(), F.lit("user_id"), F.lit("ts"), F.lit("event_type"))


@cases.frame("""WITH w AS (SELECT lower(regexp_extract(text, '^[A-Za-z]+')) AS word, doc_id FROM documents)
SELECT word, count(*) AS n, min(doc_id) AS first FROM w WHERE word <> '' GROUP BY word""")
def collation_group(spark, sf_dir):
    """First words of documents, whatever their case: the grouping key has a collation, no copy in lower case."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", "^[A-Za-z]+", 0).alias("word")).where("word <> ''")
    g = d.groupBy(F.collate("word", "UNICODE_CI").alias("k")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return g.select(F.lower(F.collate("k", "UTF8_BINARY")).alias("word"), "n", "first")


@cases.frame("""SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON lower(CASE WHEN o_orderkey % 2 = 0 THEN 'CUSTOMER-' ELSE 'customer-' END || o_custkey) = lower('Customer-' || c_custkey)""")
def collation_join(spark, sf_dir):
    """A join on names that differ in case only, by a collation of the key."""
    name = lambda prefix, c: F.collate(F.concat(prefix, F.col(c).cast("string")), "UNICODE_CI")
    o = table(spark, sf_dir, "orders").select("o_orderkey", name(F.when(F.col("o_orderkey") % 2 == 0, "CUSTOMER-").otherwise("customer-"), "o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").select("c_custkey", name(F.lit("Customer-"), "c_custkey").alias("k2"))
    return o.join(c, F.col("k") == F.col("k2")).select("o_orderkey", "c_custkey")


@cases.frame("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END AS o_totalprice FROM orders""")
def source_merged_schema(spark, sf_dir):
    """Three generations of a table's files, each with a column more than the one before."""
    o, path = table(spark, sf_dir, "orders"), shared_path(spark, "generations")
    for k, columns in enumerate((["o_orderkey"], ["o_orderkey", "o_orderstatus"], ["o_orderstatus", "o_orderkey", "o_totalprice"])):
        o.where(F.col("o_orderkey") % 3 == k).select(*columns).write.mode("append").parquet(path)
    return evolution.merged(spark, path).select("o_orderkey", "o_orderstatus", "o_totalprice")


RECORD = "CASE WHEN event_id % 10 = 3 THEN '{\"event_id\": ' || event_id WHEN event_id % 10 = 7 THEN '{\"event_id\": \"x' || event_id || '\", \"event_type\": \"a\"}' ELSE '{\"event_id\": ' || event_id || ', \"event_type\": \"' || event_type || '\"}' END"


@cases.frame(f"""SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS record FROM events WHERE event_id % 10 NOT IN (3, 7)
UNION ALL SELECT NULL, NULL, {RECORD} FROM events WHERE event_id % 10 IN (3, 7)""")
def source_bad_records(spark, sf_dir):
    """JSON lines of which some are cut off and some have a word for a number: these come back as they stand."""
    path = shared_path(spark, "records")
    table(spark, sf_dir, "events").select(F.expr(RECORD).alias("value")).write.text(path)
    schema = spark.createDataFrame([], "event_id long, event_type string").schema
    good, bad = evolution.split_records(spark, path, schema)
    return good.select("event_id", "event_type", F.lit(None).cast("string").alias("record")).unionByName(bad.select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), "record"))

"""Time windows in batch, the same over streams, and sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.operators import groups
from kestrelq.plans.case import Cases
from kestrelq.session import table
from kestrelq.sources import formats
from kestrelq.streaming import streams

cases = Cases()
QUERIES, ORACLE = cases.queries, cases.oracle

TUMBLING = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL"
SLIDING = "SELECT s AS started, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY s"
SESSION = """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM b GROUP BY user_id, s"""
ntz = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)


def tumbling(e: DataFrame) -> DataFrame:
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(ntz("w.start", "started"), "event_type", "n")


def sliding(e: DataFrame) -> DataFrame:
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(ntz("w.start", "started"), "n")


def sessions(e: DataFrame) -> DataFrame:
    return groups.sessions(e, "user_id", "ts", "30 minutes").select("user_id", ntz("started", "started"), ntz("ended", "ended"), "n")


@cases.frame(TUMBLING)
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events"))


@cases.frame("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS started, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling_week(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "7 days").alias("w")).agg(F.count("*").alias("n")).select(ntz("w.start", "started"), "n")


@cases.frame(SLIDING)
def window_sliding(spark, sf_dir):
    return sliding(table(spark, sf_dir, "events"))


@cases.frame(SESSION)
def window_session(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"))


@cases.frame(TUMBLING)
def stream_tumbling(spark, sf_dir):
    return streams.run(tumbling(streams.events_stream(spark, sf_dir)), "complete", "tumbling")


@cases.frame(SLIDING)
def stream_sliding(spark, sf_dir):
    return streams.run(sliding(streams.events_stream(spark, sf_dir)), "complete", "sliding")


@cases.frame(SESSION)
def stream_session(spark, sf_dir):
    return streams.run(sessions(streams.events_stream(spark, sf_dir)), "complete", "session")


@cases.frame("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'")
def stream_filter_append(spark, sf_dir):
    return streams.run(streams.events_stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "event_type"), "append", "filter")


@cases.frame("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark, sf_dir):
    return streams.run(streams.events_stream(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"), "append", "static")


@cases.frame("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    e = streams.events_stream(spark, sf_dir).withWatermark("ts", "60 days")
    return streams.run(e.dropDuplicatesWithinWatermark(["user_id"]).select("user_id"), "append", "dedup")


@cases.frame("""SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id
AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR""")
def stream_stream_join(spark, sf_dir):
    e = streams.events_stream(spark, sf_dir)
    c = e.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("cu"), F.col("ts").alias("ct")).withWatermark("ct", "60 days")
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("pu"), F.col("ts").alias("pt")).withWatermark("pt", "60 days")
    return streams.run(c.join(p, F.expr("cu = pu AND pt >= ct AND pt <= ct + INTERVAL 1 HOUR")).select("click", "purchase"), "append", "interval")


@cases.frame("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_arbitrary_state(spark, sf_dir):
    e = streams.events_stream(spark, sf_dir).select("user_id", "value")
    s = e.groupBy("user_id").applyInPandasWithState(streams.running_totals, "user_id long, n long, total double", "n long, total double", "append", "NoTimeout")
    out = streams.run(s, "append", "state")  # a key's last row has its most events
    return out.groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("m")).select("user_id", "m.n", F.round("m.total", 4).alias("total"))


def halves(spark, sf_dir):
    """The events before and after the middle of the month, and a closing row; ts as an instant."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = F.lit("2024-01-16").cast("timestamp")
    return e.where(F.col("ts") < middle), e.where(F.col("ts") >= middle), streams.closing(e)


def appended(spark, sf_dir, f, name):
    """The windows that a watermark of an hour closes, over events in order of time."""
    early, later, end = halves(spark, sf_dir)
    return streams.fed([early, later, end], lambda e: f(e.withWatermark("ts", "1 hour")), "append", name)


@cases.frame(TUMBLING)
def stream_tumbling_append(spark, sf_dir):
    return appended(spark, sf_dir, tumbling, "tumbling")


@cases.frame(SLIDING)
def stream_sliding_append(spark, sf_dir):
    return appended(spark, sf_dir, sliding, "sliding")


@cases.frame(SESSION)
def stream_session_append(spark, sf_dir):
    return appended(spark, sf_dir, sessions, "session")  # the closing row's own session stays open


@cases.frame(TUMBLING.replace("FROM events", "FROM events WHERE ts >= TIMESTAMP '2024-01-16'"))
def stream_late_drop(spark, sf_dir):
    """The earlier half arrives after the later one: its windows are closed, so its rows are dropped."""
    early, later, end = halves(spark, sf_dir)
    return streams.fed([later, early, end], lambda e: tumbling(e.withWatermark("ts", "1 hour")), "append", "late")


@cases.frame(f"SELECT * FROM ({TUMBLING}) WHERE started + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 DAY FROM events)")
def stream_append_before_the_end(spark, sf_dir):
    """Without a closing row, a watermark of 10 days emits the windows that end that long before the last event."""
    early, later, _ = halves(spark, sf_dir)
    return streams.fed([early, later], lambda e: tumbling(e.withWatermark("ts", "10 days")), "append", "open")


@cases.frame(TUMBLING)
def stream_tumbling_update(spark, sf_dir):
    return streams.run(tumbling(streams.events_stream(spark, sf_dir)), "update", "update", ("started", "event_type"))


@cases.frame("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_transform_with_state(spark, sf_dir):
    """Arbitrary state, second form; it needs the RocksDB store, which is set for this query alone."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        e = streams.events_stream(spark, sf_dir).select("user_id", "value")
        s = e.groupBy("user_id").transformWithStateInPandas(streams.Totals(), "user_id long, n long, total double", "Update", "None")
        out = streams.run(s, "update", "state2", ("user_id",))
    finally:
        spark.conf.set(key, before)
    return out.select("user_id", "n", F.round("total", 4).alias("total"))


for _fmt in ("parquet", "orc", "csv", "json", "xml"):

    def _round_trip(spark, sf_dir, fmt=_fmt):
        return formats.round_trip(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), fmt)

    QUERIES[f"source_{_fmt}"] = _round_trip
    ORACLE[f"source_{_fmt}"] = "SELECT event_id, ts, user_id, event_type, value FROM events"


@cases.frame("SELECT n_name AS value FROM nation")
def source_text(spark, sf_dir):
    return formats.round_trip(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), "text")


@cases.frame("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def source_partitioned(spark, sf_dir):
    """Partition pruning: the filter on the folder column reads one folder."""
    return formats.round_trip(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "parquet", ("o_orderstatus",)).where("o_orderstatus = 'F'")


@cases.frame("SELECT range AS x, range * range AS y FROM range(1000)")
def source_custom(spark, sf_dir):
    spark.dataSource.register(formats.Squares)
    return spark.read.format("kestrelq_squares").option("n", 1000).load()


@cases.frame("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def source_bucketed_join(spark, sf_dir):
    """Both sides bucketed by the key: the join has no shuffle. Its result is written, and the two tables go."""
    o = formats.bucketed(table(spark, sf_dir, "orders").select("o_orderkey"), "kestrelq_orders", "o_orderkey")
    l = formats.bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "kestrelq_lineitem", "l_orderkey")  # noqa: E741
    out = formats.round_trip(o.join(l, o.o_orderkey == l.l_orderkey).select("o_orderkey", "l_linenumber", "l_partkey"), "parquet")
    formats.dropped(o, l)
    return out

"""Streams with timers, map state and outer joins, the ledger connector, and sketches that are stored and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.operators.scratch import shared_path
from kestrelq.plans.case import Cases
from kestrelq.plans.temporal import SESSION, halves
from kestrelq.session import table
from kestrelq.sources import ledger
from kestrelq.streaming import streams, timers

cases = Cases()
QUERIES, ORACLE = cases.queries, cases.oracle


@cases.frame(SESSION)
def stream_timer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in arbitrary state, closed by event-time timers; the last ones by a row after the end."""
    early, later, end = halves(spark, sf_dir)
    buckets = max(16, table(spark, sf_dir, "events").count() // 50_000)

    def build(e: DataFrame) -> DataFrame:
        keyed = e.select("user_id", "ts", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket")).withWatermark("ts", "1 hour").groupBy("bucket")
        return keyed.transformWithStateInPandas(timers.TimedSessions(1800), timers.TimedSessions.SCHEMA, "Append", "EventTime")

    with timers.rocksdb(spark):
        # the closing row belongs to a user of its own, whose session no timer closes
        out = streams.fed([early, later, end.withColumn("user_id", F.lit(-1).cast("long"))], build, "append", "timers")
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@cases.frame("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_map_state(spark, sf_dir):
    """Counts by type in a map state whose entries would expire after a day of the clock."""
    e = streams.events_stream(spark, sf_dir).select("user_id", "event_type")
    with timers.rocksdb(spark):
        s = e.groupBy("user_id").transformWithStateInPandas(timers.Tallies(86_400), timers.Tallies.SCHEMA, "Update", "ProcessingTime")
        return streams.run(s, "update", "tallies", ("user_id", "event_type"), once=True)


@cases.frame("""SELECT c.event_id AS click, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') c
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR""")
def stream_outer_join(spark, sf_dir):
    """Clicks with the purchases of the hour after them, or none: an unmatched click comes out when the watermark has
    passed its hour. Closing rows on either side move the watermark over all."""
    early, later, end = halves(spark, sf_dir)
    # with a user: rows without a key are filtered out before they can move the watermark
    ends = end.withColumn("user_id", F.lit(-1).cast("long")).withColumn("event_type", F.explode(F.array(F.lit("click"), F.lit("purchase"))))

    def build(e: DataFrame) -> DataFrame:
        side = lambda kind, x: e.where(F.col("event_type") == kind).select(F.col("event_id").alias(kind), F.col("user_id").alias(f"{x}u"), F.col("ts").alias(f"{x}t")).withWatermark(f"{x}t", "1 hour")
        return side("click", "c").join(side("purchase", "p"), F.expr("cu = pu AND pt >= ct AND pt <= ct + INTERVAL 1 HOUR"), "left").select("click", "purchase")

    out = streams.fed([early, later, ends], build, "append", "outer")
    return out.where("click IS NOT NULL")  # closing rows have no number


@cases.frame("SELECT event_id, user_id, event_type FROM events")
def stream_ledger(spark, sf_dir):
    """Two commits to a ledger table, read by a stream into another one, with a restart in between."""
    spark.dataSource.register(ledger.LedgerSource)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    one, two, check = (shared_path(spark, f"ledger-{x}") for x in ("in", "out", "state"))
    stream = spark.readStream.format("kestrelq_ledger").option("path", one).schema(e.schema).load()
    for part in (e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0")):
        part.write.format("kestrelq_ledger").option("path", one).mode("append").save()
        q = stream.writeStream.format("kestrelq_ledger").option("path", two).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.format("kestrelq_ledger").option("path", two).schema(e.schema).load()


@cases.frame("""SELECT event_type, true AS close, count(DISTINCT user_id) AS exact FROM events GROUP BY event_type""")
def sketch_distinct_users(spark, sf_dir):
    """Users a month from stored states of the days: the events are not read again. Within 5 % of the exact number."""
    e = table(spark, sf_dir, "events")
    daily = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(14)).alias("users"))
    path = shared_path(spark, "sketches")
    daily.write.parquet(path)
    merged = spark.read.parquet(path).groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("about"))
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return merged.join(exact, "event_type").select("event_type", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"), "exact")


@cases.frame("""SELECT event_type, true AS close_median, true AS close_p90, count(value) AS n FROM events GROUP BY event_type""")
def sketch_quantiles(spark, sf_dir):
    """Median and 90th percentile from stored states of the days, merged: the shares of values below them are within
    0.03 of what they stand for."""
    e = table(spark, sf_dir, "events")
    path = shared_path(spark, "sketches")
    e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.kll_sketch_agg_double("value", F.lit(400)).alias("s")).write.parquet(path)
    states = spark.read.parquet(path).groupBy("event_type").agg(F.collect_list("s").alias("s"))  # one state a day
    merged = states.select("event_type", F.expr("aggregate(slice(s, 2, size(s)), s[0], (a, b) -> kll_sketch_merge_double(a, b))").alias("s"))
    about = merged.select("event_type", *(F.expr(f"kll_sketch_get_quantile_double(s, {p}D)").alias(c) for c, p in (("m", 0.5), ("q", 0.9))))
    share = lambda c: F.avg((F.col("value") <= F.col(c)).cast("double"))
    out = e.join(about, "event_type").groupBy("event_type").agg(share("m").alias("m"), share("q").alias("q"), F.count("value").alias("n"))
    return out.select("event_type", (F.abs(F.col("m") - 0.5) <= 0.03).alias("close_median"), (F.abs(F.col("q") - 0.9) <= 0.03).alias("close_p90"), "n")

"""Streaming operators run over the events table as a file stream, beside the batch answer in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.operators import meetings
from ledgerwing.plans.catalog import ORACLES, query
from ledgerwing.plans.event_queries import COLLISION
from ledgerwing.session import shared_folder
from ledgerwing.streaming import monitors


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    batch = spark.read.parquet(f"{d}/events.parquet")
    # a table is one file or a folder of them; a file stream watches a folder
    raw = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/events.parquet*")
    return raw.select(
        "event_id",
        F.col("user_id").alias("agent_id"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("target"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("cost_usd"),
        F.col("value").alias("latency_ms"),
    )


def run(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a stream built over the events gives for everything that is there now."""
    return finished(spark, build(_stream(spark, d)), mode)


def finished(spark: SparkSession, built: DataFrame, mode: str = "append") -> DataFrame:
    """A stream's output, written to a folder that the result is read from."""
    out = _folder(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("append").parquet(out + "/rows")

    running = built.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", out + "/log").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(built.schema).parquet(out + "/rows")


@query("""
WITH s AS (SELECT *, count(*) OVER w AS n, avg(cost_usd) OVER w AS m FROM event WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))
SELECT agent_id, event_id, k.alert AS alert FROM s, (SELECT unnest([{'alert': 'cost_spike', 'f': 5}, {'alert': 'latency_spike', 'f': 3}]) AS k) WHERE n >= 4 AND m > 0 AND cost_usd > m * k.f
""")
def anomaly_stream(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, monitors.anomaly_stream).select("agent_id", "event_id", "alert")


@query("""
WITH s AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY agent_id ORDER BY ts, event_id))) / 1000000.0::DOUBLE AS gap FROM event)
SELECT agent_id, event_id, 'stall' AS alert FROM s WHERE gap > 43200
""")
def stall_stream(spark: SparkSession, d: str) -> DataFrame:
    found = run(spark, d, lambda s: monitors.monitor_stream(s, stall_seconds=43200))
    return found.filter("alert = 'stall'").select("agent_id", "event_id", "alert")


def _collisions(spark: SparkSession, d: str, causal: DataFrame | None = None) -> DataFrame:
    """The stream leaves blocks, which grow with the events; pairs are made as they are read."""
    return meetings.paired(run(spark, d, lambda s: monitors.collision_blocks(s.withColumnRenamed("action", "dimension"), causal=causal)), 300)


@query(COLLISION)
def collision_stream(spark: SparkSession, d: str) -> DataFrame:
    return _collisions(spark, d)


@query("SELECT event_id, ts FROM events")
def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table sent twice over: each event comes out once."""
    return run(spark, d, lambda s: monitors.ingest_stream(s.select("event_id", F.col("ts")).union(s.select("event_id", "ts")), ["event_id"])).select("event_id", F.col("ts"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, action, count(*) AS n FROM event GROUP BY ALL")
def live_counts(spark: SparkSession, d: str) -> DataFrame:
    """Complete counts of all windows, as the stream's last update leaves them."""
    updates = run(spark, d, lambda s: monitors.live_counts(s, "6 hours"), mode="update")
    return updates.groupBy("window_start", "action").agg(F.max("n").alias("n"))


@query("""
WITH g AS (SELECT agent_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY agent_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM event),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY agent_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT agent_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS ended, count(*) AS n FROM s GROUP BY agent_id, k
""")
def agent_sessions(spark: SparkSession, d: str) -> DataFrame:
    from ledgerwing.plans.views import events

    return monitors.sessions(events(spark, d), "12 hours")


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS seq FROM event),
a AS (SELECT agent_id, max(ts) AS newest, coalesce(max(seq) FILTER (action = 'purchase'), 0) AS answered FROM e GROUP BY agent_id)
SELECT agent_id, event_id, 'unanswered' AS alert, 'error' AS detail FROM e JOIN a USING (agent_id) WHERE action = 'error' AND seq > answered AND newest + INTERVAL 1 HOUR < (SELECT max(ts) FROM event) - INTERVAL 10 MINUTE
""")
def property_stream(spark: SparkSession, d: str) -> DataFrame:
    """Errors that no purchase followed, of agents whose hour ran out before the watermark at the stream's end."""
    return run(spark, d, lambda s: monitors.property_stream(s, "error", "purchase"))


LAST = "row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS seq"


@query(f"""
WITH e AS (SELECT *, {LAST} FROM event), f AS (SELECT agent_id, min(seq) AS first FROM e WHERE action = 'signup' GROUP BY agent_id)
SELECT agent_id, event_id, 'out_of_order' AS alert FROM e LEFT JOIN f USING (agent_id) WHERE action = 'purchase' AND (first IS NULL OR seq < first)
""")
def precedence_stream(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, lambda s: monitors.order_stream(s, "precedence", "signup", "purchase")).select("agent_id", "event_id", "alert")


@query(f"""
WITH e AS (SELECT *, {LAST} FROM event), s AS (SELECT *, last_value(CASE action WHEN 'error' THEN 1 WHEN 'view' THEN 0 END IGNORE NULLS) OVER (PARTITION BY agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS open FROM e)
SELECT agent_id, event_id, 'forbidden' AS alert FROM s WHERE action = 'purchase' AND open = 1
""")
def absence_stream(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, lambda s: monitors.order_stream(s, "absence", "error", "view", "purchase")).select("agent_id", "event_id", "alert")


@query(f"SELECT event_id, signature AS detail FROM ({ORACLES['loops']})")
def loop_stream(spark: SparkSession, d: str) -> DataFrame:
    """As loops: targets are told apart by their first digit."""
    return run(spark, d, lambda s: monitors.monitor_stream(s.withColumn("target", F.substring("target", 1, 2)))).filter("alert = 'loop'").select("event_id", "detail")


@query(f"SELECT event_id FROM ({ORACLES['thrash']})")
def thrash_stream(spark: SparkSession, d: str) -> DataFrame:
    found = run(spark, d, lambda s: monitors.monitor_stream(s.withColumn("target", F.lit("x")), threshold=12))
    return found.filter("alert = 'thrash'").select("event_id")


@query(f"SELECT * FROM ({ORACLES['collision_stream']}) c WHERE NOT (a_event % 2 = 0 AND b_event % 2 = 1)")
def causal_collision_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a known link from the earlier event to the later one go; here from every even id to every odd one met."""
    links = _collisions(spark, d).filter("a_event % 2 = 0 and b_event % 2 = 1").select(F.col("a_event").alias("source"), F.col("b_event").alias("target"))
    return _collisions(spark, d, causal=links)


#: Files of each part of a staged stream; a micro-batch takes one part.
STAGED_FILES = 4


def _staged(spark: SparkSession, d: str, late: Column) -> DataFrame:
    """The events as a stream of four parts by id, one a micro-batch; rows of the first part that are late come with the last."""
    events = spark.read.parquet(f"{d}/events.parquet")
    most = events.agg(F.max("event_id")).first()[0] or 0
    quarter = F.floor(F.col("event_id") * 4 / F.lit(most + 1))
    part = F.when((quarter == 0) & late, 3).otherwise(quarter)
    folder = _folder(spark)
    for k in range(4):  # files are taken in the order of their writing
        events.filter(part == k).repartition(STAGED_FILES).write.parquet(f"{folder}/part{k}")
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", STAGED_FILES).parquet(f"{folder}/part*")
    return raw.select("event_id", F.col("user_id").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"))


@query("""
WITH p AS (SELECT event_id, ts, CASE WHEN event_id * 4 // (max(event_id) OVER () + 1) = 0 AND event_id % 37 = 0 THEN 3 ELSE event_id * 4 // (max(event_id) OVER () + 1) END AS part FROM events),
w AS (SELECT k.part, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM p WHERE p.part < k.part - 1) AS mark FROM (SELECT DISTINCT part FROM p) k)
SELECT count(*) AS read, count(*) FILTER (ts <= mark) AS dropped, count(*) - count(*) FILTER (ts <= mark) AS kept FROM p JOIN w USING (part)
""")
def lateness_losses(spark: SparkSession, d: str) -> DataFrame:
    """Rows read, dropped as late and kept by a stream whose first part has stragglers; a batch is held against the mark that the one before it began with."""
    stream = monitors.with_lateness(_staged(spark, d, F.col("event_id") % 37 == 0)).dropDuplicatesWithinWatermark(["event_id"])
    out = _folder(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("append").parquet(out + "/rows")

    with monitors.Losses(spark) as losses:
        running = stream.writeStream.foreachBatch(write).option("checkpointLocation", out + "/log").trigger(availableNow=True).start()
        running.awaitTermination()
        read, dropped = losses.of(str(running.runId))
    kept = spark.read.schema(stream.schema).parquet(out + "/rows").agg(F.count("*").alias("kept"))
    return kept.select(F.lit(read).cast("long").alias("read"), F.lit(dropped).cast("long").alias("dropped"), "kept")


@query(f"SELECT * FROM ({ORACLES['agent_sessions']}) WHERE ended <= (SELECT max(ts) FROM event) - INTERVAL 10 MINUTE")
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed by the end of four micro-batches; open ones are held back."""
    return finished(spark, monitors.sessions(_staged(spark, d, F.lit(False)), "12 hours"))


@query("""
SELECT w AS window_start, action, count(*) AS n FROM (SELECT action, unnest([time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 4 HOUR]) AS w FROM event) GROUP BY ALL
""")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windows of six hours, one every two, so that each event counts in three."""
    updates = run(spark, d, lambda s: monitors.live_counts(s, "6 hours", slide="2 hours"), mode="update")
    return updates.groupBy("window_start", "action").agg(F.max("n").alias("n"))

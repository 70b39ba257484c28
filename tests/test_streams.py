"""Streams over several micro-batches: late rows, repeats, and state that outlives a batch."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerwing.streaming import monitors

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, agent_id long, action string, target string, ts timestamp"


def batches(spark, folder, parts):
    """A stream that takes one file, hence one part, a batch."""
    for n, part in enumerate(parts):
        rows = [(i, a, action, "t", T0 + datetime.timedelta(minutes=m)) for i, a, action, m in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/part{n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in/*")


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    # a batch is held against the watermark that the batch before it began with
    parts = [[(1, 1, "a", 0), (2, 1, "a", 60)], [(4, 1, "a", 55)], [(3, 1, "a", 1), (5, 1, "a", 61)]]
    stream = monitors.with_lateness(batches(spark, tmp_path, parts)).dropDuplicatesWithinWatermark(["event_id"]).select("event_id")
    found = monitors.run_available(stream, "late", str(tmp_path / "log"))
    assert sorted(r["event_id"] for r in found.collect()) == [1, 2, 4, 5]  # 3 came 59 minutes late


def test_order_is_kept_over_batches(spark, tmp_path):
    parts = [[(1, 1, "done", 0), (2, 2, "start", 1)], [(3, 1, "start", 2), (4, 2, "done", 3)], [(5, 1, "done", 4)]]
    stream = monitors.order_stream(batches(spark, tmp_path, parts), "precedence", "start", "done")
    found = monitors.run_available(stream, "order", str(tmp_path / "log"))
    assert [(r["agent_id"], r["event_id"], r["alert"]) for r in found.collect()] == [(1, 1, "out_of_order")]


def test_a_scope_stays_open_over_batches(spark, tmp_path):
    parts = [[(1, 1, "open", 0), (2, 2, "write", 0)], [(3, 1, "write", 1), (4, 1, "close", 2)], [(5, 1, "write", 3)]]
    stream = monitors.order_stream(batches(spark, tmp_path, parts), "absence", "open", "close", "write")
    found = monitors.run_available(stream, "scope", str(tmp_path / "log"))
    assert [r["event_id"] for r in found.filter(F.col("alert") == "forbidden").collect()] == [3]


def test_a_causal_link_takes_a_collision_out(spark, tmp_path):
    parts = [[(1, 1, "d", 0), (2, 2, "d", 1)], [(3, 3, "d", 2)]]
    stream = batches(spark, tmp_path, parts).withColumnRenamed("action", "dimension")
    known = spark.createDataFrame([(1, 2)], "source long, target long")
    found = monitors.run_available(monitors.collision_stream(stream, causal=known), "collide", str(tmp_path / "log"))
    assert sorted((r["a_event"], r["b_event"]) for r in found.collect()) == [(1, 3), (2, 3)]


SPANS = SCHEMA + ", cost_usd double, latency_ms double"


def staged(spark, folder, parts):
    for n, part in enumerate(parts):
        rows = [(i, a, action, "t", T0 + datetime.timedelta(minutes=m), c, 1.0) for i, a, action, m, c in part]
        spark.createDataFrame(rows, SPANS).coalesce(1).write.parquet(f"{folder}/in/part{n}")

    def stream():
        return spark.readStream.schema(SPANS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")

    return stream


def test_an_idle_agent_leaves_no_state(spark, tmp_path):
    parts = [[(1, 1, "a", 0, 1.0), (2, 1, "a", 1, 1.0), (3, 2, "b", 0, 1.0)], [(4, 2, "c", 200, 1.0)], [(5, 2, "d", 300, 1.0)], [(6, 1, "a", 400, 1.0), (7, 2, "e", 301, 1.0)]]
    stream = staged(spark, tmp_path, parts)
    found = {}
    for idle in ("30 days", "1 hour"):
        alerts = monitors.monitor_stream(stream(), stall_seconds=1e9, idle=idle)
        name = "idle" + idle[0]
        query = alerts.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        found[idle] = [(r["agent_id"], r["event_id"], r["alert"]) for r in spark.table(name).collect()]
    assert found == {"30 days": [(1, 6, "loop")], "1 hour": []}  # agent 1 began anew after six hours


def test_spikes_against_values_of_earlier_batches(spark, tmp_path):
    stream = staged(spark, tmp_path, [[(i, 1, "a", i, 1.0) for i in range(4)], [(5, 1, "a", 10, 5.5), (6, 1, "a", 11, None)], [(7, 1, "a", 12, 9.5)]])
    found = monitors.run_available(monitors.anomaly_stream(stream()), "spikes", str(tmp_path / "log"))
    assert sorted((r["event_id"], r["alert"], r["detail"]) for r in found.collect()) == [(5, "cost_spike", "5.5"), (7, "cost_spike", "9.5")]


def test_losses_are_told_by_progress(spark, tmp_path):
    parts = [[(1, 1, "a", 0), (2, 1, "a", 60)], [(4, 1, "a", 55)], [(3, 1, "a", 1), (6, 1, "a", 2), (5, 1, "a", 61)]]
    stream = monitors.with_lateness(batches(spark, tmp_path, parts)).dropDuplicatesWithinWatermark(["event_id"]).select("event_id")
    with monitors.Losses(spark) as losses:
        query = stream.writeStream.format("memory").queryName("lost").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert losses.of(str(query.runId)) == (6, 2)
    assert spark.table("lost").count() == 4
    assert losses.of("another run", wait_seconds=0) == (0, 0)


def test_a_session_stays_open_until_the_watermark_has_passed_it(spark, tmp_path):
    parts = [[(1, 1, "a", 0), (2, 1, "a", 30)], [(3, 1, "a", 80), (4, 2, "a", 85)], [(5, 1, "a", 200)]]
    found = monitors.run_available(monitors.sessions(batches(spark, tmp_path, parts)), "session", str(tmp_path / "log"))
    assert sorted((r["agent_id"], (r["started"] - T0).seconds // 60, (r["ended"] - T0).seconds // 60, r["n"]) for r in found.collect()) == [(1, 0, 140, 3), (2, 85, 145, 1)]


def test_a_mean_is_rounded_as_avg_rounds_it(spark, tmp_path):
    staged(spark, tmp_path, [[(i, 1, "a", i, 3.03 if i < 19 else 15.15) for i in range(20)]])
    stream = spark.readStream.schema(SPANS).parquet(f"{tmp_path}/in/*")
    found = monitors.run_available(monitors.anomaly_stream(stream), "means", str(tmp_path / "log"))
    assert found.collect() == []  # added one by one, 19 times 3.03 come to a little over 57.57


def test_pairs_over_batches_come_once(spark, tmp_path):
    far, big = 600, 2**53  # minutes; an id that a float would round
    parts = [[(big + 1, 1, "d", 0), (None, 2, "d", 2), (3, None, "d", 2)], [(4, 2, "d", 1), (5, 3, "d", 5), (6, 1, "d", 7), (6, 2, "d", 7)], [(8, 2, "d", 57), (9, 1, "e", 58), (10, 1, "d", 62)], [(11, 1, "d", far), (12, 2, "d", far + 1)], [(13, 3, "d", far + 1)]]
    rows = [x for part in parts for x in part]
    links = {(big + 1, 4), (4, 5), (12, 11), (8, 10), (11, 13)}
    near = [(a, b) for a, k, d, s in rows for b, m, e, t in rows if k and m and k != m and d == e and 0 <= t - s <= 5 and (s < t or (a and b and a < b))]
    for n, known in enumerate((set(), links)):
        stream = batches(spark, tmp_path / str(n), parts).withColumnRenamed("action", "dimension")
        causal = spark.createDataFrame([*known, (None, 5), (big + 1, None)], "source long, target long") if known else None
        built = monitors.collision_stream(stream, causal=causal)
        assert "LeftAnti" not in built._jdf.queryExecution().analyzed().toString()  # links go to events, not to pairs
        query = built.writeStream.format("memory").queryName(f"once{n}").option("checkpointLocation", str(tmp_path / f"log{n}")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(((r["a_event"], r["b_event"]) for r in spark.table(f"once{n}").collect()), key=repr) == sorted((x for x in near if x not in known), key=repr)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # the slices of the first hours are gone

"""Structured Streaming forms of the sequence operators: state per agent, watermarks, sessions and windows."""

from __future__ import annotations

import functools
import operator
import threading
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ledgerwing.operators import meetings
from ledgerwing.session import written

ALERTS = "agent_id long, event_id long, alert string, detail string"
RECENT = "actions array<string>, times array<double>, costs array<double>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_lateness(stream: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Rows later than delay behind the newest are dropped; Losses tells how many."""
    return stream.withWatermark(ts, delay)


class Losses(StreamingQueryListener):
    """Rows that came in and rows that watermarks dropped, by query, as their progress reports them.

    Used as a context: queries that run inside are counted. Every stateful operator counts the rows that it drops, so a
    query with two of them may count one row twice; an aggregation counts groups of its partial sums, not rows.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.read: dict[str, int] = {}
        self.dropped: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}

    def __enter__(self) -> Losses:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event: Any) -> None:
        self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event: Any) -> None:
        run = str(event.progress.runId)
        self.read[run] = self.read.get(run, 0) + event.progress.numInputRows
        self.dropped[run] = self.dropped.get(run, 0) + sum(x.numRowsDroppedByWatermark for x in event.progress.stateOperators)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self._ended.setdefault(str(event.runId), threading.Event()).set()

    def of(self, run_id: str, wait_seconds: float = 60) -> tuple[int, int]:
        """Rows read and dropped by a run that has ended; its last report arrives a little after its end."""
        self._ended.setdefault(run_id, threading.Event()).wait(wait_seconds)
        return self.read.get(run_id, 0), self.dropped.get(run_id, 0)


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts", "event_id"])


class _Recent(StatefulProcessor):
    """Judges an agent's events one by one beside its last ones, which are state until the agent has been idle for idle_ms.

    judge takes a row and the last (signature, time, cost, latency) tuples, its own included, and yields (alert, detail).
    A timer of event time moves on with each batch of an agent; when it runs out the list is cleared, so
    agents that fall silent leave no state behind.
    """

    def __init__(self, judge: Callable[[Any, list[tuple]], Iterator[tuple[str, str]]], keep: int, idle_ms: int):
        self.judge, self.keep, self.idle_ms = judge, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "signature string, at double, cost double, latency double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = list(self.recent.get()) if self.recent.exists() else []
        out, newest = [], 0.0
        for row in _ordered(rows).itertuples():
            numbers = [0.0 if pd.isna(x) else float(x) for x in (row.cost_usd, row.latency_ms)]
            last = [*last, (f"{row.action}:{row.target}", row.ts.timestamp(), *numbers)][-self.keep :]
            newest = max(newest, last[-1][1])
            out += [(key[0], row.event_id, alert, detail) for alert, detail in self.judge(row, last)]
        self.recent.put(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(newest * 1000) + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["agent_id", "event_id", "alert", "detail"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield pd.DataFrame([], columns=["agent_id", "event_id", "alert", "detail"])

    def close(self) -> None:
        pass


def _judged(events: DataFrame, judge: Callable[[Any, list[tuple]], Iterator[tuple[str, str]]], keep: int, idle: str, delay: str) -> DataFrame:
    """alerts of a judge over each agent's last events; such state needs the session's RocksDB store, set here for the queries to come."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    recent = _Recent(judge, keep, int(pd.Timedelta(idle).total_seconds() * 1000))
    keyed = events.withWatermark("ts", delay).groupBy("agent_id")
    return keyed.transformWithStateInPandas(statefulProcessor=recent, outputStructType=ALERTS, outputMode="Append", timeMode="EventTime")


def monitor_stream(
    events: DataFrame, loop_window: int = 10, repeats: int = 3, thrash_window: int = 20, threshold: int = 4, stall_seconds: float = 300, idle: str = "30 days", delay: str = "10 minutes"
) -> DataFrame:
    """agent_id, event_id, alert (loop, thrash, stall), detail as events arrive; state: an agent's last events.

    Within a micro-batch events are taken by time, then id; one that arrives after later ones were seen joins at the end,
    one later than delay behind the newest is dropped. An agent without an event for idle begins anew.
    """

    def judge(row: Any, last: list[tuple]) -> Iterator[tuple[str, str]]:
        signatures, times = [x[0] for x in last], [x[1] for x in last]
        window = signatures[-loop_window:]
        best = max(dict.fromkeys(window), key=window.count)
        if window.count(best) >= repeats:
            yield "loop", best
        if len(signatures) >= 4:
            recent = signatures[-thrash_window:]
            steps = list(zip(recent, recent[1:], strict=False))
            if any(steps.count(p) >= threshold // 2 and steps.count(p[::-1]) >= threshold // 2 for p in set(steps)):
                yield "thrash", ""
        if len(times) >= 2 and times[-1] - times[-2] > stall_seconds:
            yield "stall", f"{times[-1] - times[-2]:.3f}"

    return _judged(events, judge, max(loop_window, thrash_window), idle, delay)


def anomaly_stream(spans: DataFrame, window: int = 20, cost_factor: float = 5, latency_factor: float = 3, idle: str = "30 days", delay: str = "10 minutes") -> DataFrame:
    """agent_id, event_id, alert (cost_spike, latency_spike), detail: value; state: an agent's last window values."""

    def judge(row: Any, last: list[tuple]) -> Iterator[tuple[str, str]]:
        for name, place, factor in (("cost_spike", 2, cost_factor), ("latency_spike", 3, latency_factor)):
            value, before = last[-1][place], [x[place] for x in last[:-1]]
            total = functools.reduce(operator.add, before, 0.0)  # rounded at each step, as avg does; sum would carry what is lost
            if len(before) >= 4 and total > 0 and value > total / len(before) * factor:
                yield name, repr(value)

    return _judged(spans, judge, window, idle, delay)


class _Meeting(StatefulProcessor):
    """Packs a slice's new events with those before that they may meet.

    State is what later events may still meet, packed; it goes when the watermark has passed the slice.
    """

    def __init__(self, size: int, schema: pa.Schema):
        self.size, self.schema = size, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.before = handle.getValueState("before", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables([self._new(x) for x in rows])
        both = new.append_column("fresh", pa.array(np.ones(len(new), bool)))
        mark = timerValues.getCurrentWatermarkInMs()
        if self.before.exists():
            old = meetings.unpacked(self.before.get()[0])
            old = old.filter(pc.greater_equal(old["us"], mark * 1000 - self.size))
            both = pa.concat_tables([both, old.append_column("fresh", pa.array(np.zeros(len(old), bool)))])
        else:
            end = (key[1] + 1) * meetings.SLICE_WINDOWS * self.size // 1000
            self.handle.registerTimer(max(end, mark + 1))
        both = both.take(pc.sort_indices(both, sort_keys=[("us", "ascending"), ("event_id", "ascending")], null_placement="at_start"))
        self.before.update((meetings.packed(both.drop_columns("fresh")),))
        first, last = pc.min_max(new["us"]).values()
        near = pc.and_(pc.greater_equal(both["us"], first.as_py() - self.size), pc.less_equal(both["us"], last.as_py() + self.size))
        yield pd.DataFrame({"dimension": [key[0]], "rows": [meetings.packed(both.filter(near))]})

    def _new(self, rows: pd.DataFrame) -> pa.Table:
        new = pa.Table.from_pandas(rows if "linked" in rows else rows.assign(linked=None), schema=self.schema, preserve_index=False)
        for n, name in enumerate(("event_id", "agent_id")):
            new = new.set_column(n, name, pc.if_else(pa.array(rows[f"no_{name}"]), pa.scalar(None, new[name].type), new[name]))
        return new

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.before.clear()
        yield pd.DataFrame({"dimension": [], "rows": []}, dtype=object)

    def close(self) -> None:
        pass


def collision_blocks(events: DataFrame, window_seconds: int = 300, delay: str = "10 minutes", causal: DataFrame | None = None) -> DataFrame:
    """dimension, rows: what collision_stream finds, as blocks that meetings.paired makes pairs of.

    Pairs grow with the square of the events in a window, blocks with the events: a block is the new events of a slice of some
    windows and those before that they may meet. causal (source, target), if given, is a table of known links; it is written
    once by source, and links come to their source's slice as rows without an agent. Needs the session's RocksDB store, as _judged.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(events.dtypes)
    event, agent = [to_arrow_type(events.schema[c].dataType) for c in ("event_id", "agent_id")]
    rows = events.select("event_id", "agent_id", "dimension", "ts").withWatermark("ts", delay)
    if causal is not None:
        links = written(meetings.targets(causal, kinds["event_id"]).withColumnRenamed("source", "event_id"), "links")
        linked = rows.drop("agent_id").join(links, "event_id").withColumn("agent_id", F.lit(None).cast(kinds["agent_id"]))
        rows = rows.filter("agent_id is not null").withColumn("linked", F.lit(None).cast(f"array<{kinds['event_id']}>")).unionByName(linked)
    else:
        rows = rows.filter("agent_id is not null")
    rows = meetings.slices(rows, window_seconds)
    for c in ("event_id", "agent_id"):  # a null among whole numbers would make pandas round them
        rows = rows.withColumn(f"no_{c}", F.col(c).isNull()).withColumn(c, F.coalesce(c, F.lit(0).cast(kinds[c])))
    schema = pa.schema([("event_id", event), ("agent_id", agent), ("us", pa.int64()), ("late", pa.bool_()), ("linked", pa.list_(event))])
    meeting = _Meeting(window_seconds * 1_000_000, schema)
    return rows.groupBy("dimension", "bucket").transformWithStateInPandas(statefulProcessor=meeting, outputStructType=f"dimension {kinds['dimension']}, rows binary", outputMode="Append", timeMode="EventTime")


def collision_stream(events: DataFrame, window_seconds: int = 300, delay: str = "10 minutes", causal: DataFrame | None = None) -> DataFrame:
    """a_event, b_event, dimension, gap_seconds: events of one dimension by two agents at most window apart.

    Events are dealt to slices of some windows, so an event meets those near it alone, and a slice's state goes when the
    watermark has passed it. causal (source, target), if given, is a table of known links; pairs linked from the earlier event
    to the later one go.
    """
    return meetings.paired(collision_blocks(events, window_seconds, delay, causal), window_seconds, dict(events.dtypes)["event_id"])


def property_stream(events: DataFrame, trigger: str, response: str, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """agent_id, event_id, alert unanswered, detail: triggers that no response follows within timeout of event time."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            out = [(key[0], int(w), "unanswered", trigger) for w in waiting]
            state.remove()
        else:
            rows = _ordered(batches)
            for row in rows.itertuples():
                if row.action == trigger:
                    waiting.append(str(row.event_id))
                elif row.action == response:
                    waiting.clear()
            if waiting:
                state.update((waiting, [], []))
                limit = int(pd.Timedelta(timeout).total_seconds() * 1000)
                state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000) + limit, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["agent_id", "event_id", "alert", "detail"])

    return events.withWatermark("ts", delay).groupBy("agent_id").applyInPandasWithState(step, ALERTS, RECENT, "append", GroupStateTimeout.EventTimeTimeout)


def order_stream(events: DataFrame, kind: str, first: str, second: str, third: str = "") -> DataFrame:
    """agent_id, event_id, alert, detail: events that break an ordering property, as they arrive; state: one flag.

    precedence: a second action before any first one is out_of_order. absence: a third action between a first, which
    opens a scope, and a second, which closes it, is forbidden. Within a micro-batch events are taken by time, then id.
    """
    if kind not in ("precedence", "absence"):
        raise ValueError(f"no such property: {kind}")

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flag = bool(state.get[0]) if state.exists else False
        out = []
        for row in _ordered(batches).itertuples():
            if kind == "precedence":
                if row.action == second and not flag:
                    out.append((key[0], row.event_id, "out_of_order", second))
                flag = flag or row.action == first
            else:
                flag = row.action == first or (flag and row.action != second)
                if row.action == third and flag:
                    out.append((key[0], row.event_id, "forbidden", third))
        state.update((flag,))
        yield pd.DataFrame(out, columns=["agent_id", "event_id", "alert", "detail"])

    return events.groupBy("agent_id").applyInPandasWithState(step, ALERTS, "flag boolean", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(lines: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each key once, however often it is sent within the delay."""
    return lines.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def live_counts(events: DataFrame, width: str = "10 minutes", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, action, n by windows of event time: tumbling ones, or with slide one that begins every so often."""
    windows = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", delay).groupBy(windows, "action").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "action", "n")


def sessions(events: DataFrame, ttl: str = "60 minutes", delay: str = "10 minutes") -> DataFrame:
    """agent_id, started, ended, n: sessions that end after ttl without an event. Also works on a batch table."""
    base = events.withWatermark("ts", delay) if events.isStreaming else events
    grouped = base.groupBy("agent_id", F.session_window("ts", ttl)).agg(F.count("*").alias("n"))
    return grouped.select("agent_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give the result as a table (for tests and backfills)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

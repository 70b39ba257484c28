"""The driver's star-schema tables seen as decisions, bridges, events and the other governance tables.

Every view is written twice: as a DataFrame, and as SQL for the comparison engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwing.schemas import DECISION_TYPES, DIMENSIONS
from ledgerwing.session import table

AS_OF = "2002-01-01 00:00:00"
STATUSES = ("unresolved", "resolved", "ignored", "deferred")
VERDICT_BY_MOD = ("contradiction", "tension", "compatible")
PRIORITY_SOURCE = {"1-URGENT": "manual", "2-HIGH": "git_pr", "3-MEDIUM": "agent", "4-NOT SPECIFIED": "git_commit"}


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """values[index], counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    source = F.lit("scan")
    for priority, name in PRIORITY_SOURCE.items():
        source = F.when(F.col("o_orderpriority") == priority, name).otherwise(source)
    valid = F.col("o_orderstatus") != "P"
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("project"),
        F.concat(F.lit("agent-"), F.col("o_custkey") % 7).alias("made_by"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("confidence"),
        source.alias("source_type"),
        valid.alias("valid"),
        F.when(valid, "active").otherwise("superseded").alias("status"),
        pick(DECISION_TYPES, F.col("o_orderkey") % 4).alias("decision_type"),
        F.lag("o_orderkey").over(by_customer).alias("supersedes"),
        F.concat(F.lit("Decision "), F.col("o_orderkey")).alias("title"),
    )


def bridge(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 12).alias("n"))
    owners = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(owners, lines["l_orderkey"] == owners["o_orderkey"]).select("l_orderkey", "o_custkey", "n").distinct()  # one shuffle serves both
    return joined.select(F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("project"), pick(DIMENSIONS, F.col("n")).alias("dimension"))


def contradictions(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """more: columns of decisions that follow for both sides, as a_* and b_*."""
    from ledgerwing.operators.pairs import candidate_pairs

    both = candidate_pairs(bridge(spark, d), decisions(spark, d).select("id", *dict.fromkeys(("created_at", *more))))
    total = F.col("a_id") + F.col("b_id")
    return both.select(
        F.concat_ws("::", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("id"),
        "project",
        "a_id",
        "b_id",
        "shared_dimensions",
        pick(VERDICT_BY_MOD, total % 3).alias("verdict"),
        pick(STATUSES, total % 4).alias("status"),
        ((F.col("a_id") * 7 + F.col("b_id")) % 100 / F.lit(100.0)).alias("confidence"),
        (total % 10 == 0).alias("is_baseline"),
        F.greatest("a_created_at", "b_created_at").alias("detected_at"),
        *[f"{s}_{c}" for c in more for s in ("a", "b")],
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.col("user_id").alias("agent_id"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("target"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("cost_usd"),
        F.col("value").alias("latency_ms"),
    )


def calibration(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "R", "contradiction").when(F.col("l_returnflag") == "A", "tension").otherwise("compatible")
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        (F.col("l_suppkey") % 5).alias("judge"),
        verdict.alias("judge_verdict"),
        F.when(F.col("l_linestatus") == "F", "contradiction").otherwise("compatible").alias("human_verdict"),
        (F.col("l_discount") * 10).alias("judge_confidence"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
    )


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """log, idx, data: each user's events in order, as the leaves of a log."""
    ordered = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("log"),
        (F.row_number().over(ordered) - 1).cast("long").alias("idx"),
        F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props").alias("data"),
    )


def organisations(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), F.col("c_nationkey").alias("org_id"))
    return decisions(spark, d).join(owners, "project")


def _case(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} AS INTEGER) + 1]"


SQL_VIEWS: dict[str, str] = {
    "decision": f"""
      SELECT o_orderkey AS id, o_custkey AS project, 'agent-' || (o_custkey % 7) AS made_by, o_orderdate AS created_at,
             CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence,
             CASE o_orderpriority {' '.join(f"WHEN '{p}' THEN '{s}'" for p, s in PRIORITY_SOURCE.items())} ELSE 'scan' END AS source_type,
             o_orderstatus <> 'P' AS valid, CASE WHEN o_orderstatus <> 'P' THEN 'active' ELSE 'superseded' END AS status,
             {_case(DECISION_TYPES, 'o_orderkey % 4')} AS decision_type,
             lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes,
             'Decision ' || o_orderkey AS title
      FROM orders""",
    "bridge": f"""
      SELECT DISTINCT l_orderkey AS id, o_custkey AS project, {_case(DIMENSIONS, 'l_partkey % 12')} AS dimension
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pair": """
      SELECT a.project, a.id AS a_id, b.id AS b_id, list_sort(list(a.dimension)) AS shared_dimensions, count(*) AS shared_count
      FROM bridge a JOIN bridge b ON a.project = b.project AND a.dimension = b.dimension AND a.id < b.id GROUP BY ALL""",
    "contra": f"""
      SELECT a_id || '::' || b_id AS id, p.project, a_id, b_id, shared_dimensions, {_case(VERDICT_BY_MOD, '(a_id + b_id) % 3')} AS verdict,
             {_case(STATUSES, '(a_id + b_id) % 4')} AS status, CAST((a_id * 7 + b_id) % 100 AS DOUBLE) / 100 AS confidence,
             (a_id + b_id) % 10 = 0 AS is_baseline, greatest(x.created_at, y.created_at) AS detected_at
      FROM pair p JOIN decision x ON x.id = a_id JOIN decision y ON y.id = b_id""",
    "event": """
      SELECT event_id, user_id AS agent_id, event_type AS action, 'k' || json_extract_string(props, '$.k') AS target, ts,
             value AS cost_usd, value AS latency_ms
      FROM events""",
    "calib": """
      SELECT l_orderkey || '-' || l_linenumber AS id, l_suppkey % 5 AS judge,
             CASE l_returnflag WHEN 'R' THEN 'contradiction' WHEN 'A' THEN 'tension' ELSE 'compatible' END AS judge_verdict,
             CASE l_linestatus WHEN 'F' THEN 'contradiction' ELSE 'compatible' END AS human_verdict,
             l_discount * 10 AS judge_confidence, l_shipdate AS ts, l_orderkey AS orderkey, l_linenumber AS linenumber
      FROM lineitem""",
    "audit": """
      SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx,
             concat_ws('|', event_id, event_type, props) AS data
      FROM events""",
    "org": "SELECT d.*, c_nationkey AS org_id FROM decision d JOIN customer ON c_custkey = project",
}


def with_views(sql: str) -> str:
    """sql with the views it names, and those they name, as common table expressions in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


Query = Callable[[SparkSession, str], DataFrame]

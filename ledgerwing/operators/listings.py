"""Filtered pages of decisions, contradictions and assumptions with their totals, and policies from decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwing.functions.labels import first_match
from ledgerwing.operators.sequences import page

# The severity of a policy by the type of its decision; other types are medium.
POLICY_SEVERITY = {"constraint": "critical", "architectural": "high", "technical": "medium", "product": "low"}
# Statuses of an assumption that awaits an answer.
AWAITING = ("detected", "proposed")


def list_decisions(decisions: DataFrame, bridge: DataFrame, dimension: str | None = None, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """id, project, title, status, created_at, total: a page of the decisions of a dimension and status, newest first.

    total counts all that the filters admit. Ties in time go by id.
    """
    rows = decisions.select("id", "project", "title", "status", "created_at")
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if dimension is not None:
        rows = rows.join(bridge.filter(F.col("dimension") == dimension).select("id").distinct(), "id", "left_semi")
    return page(rows, limit, offset, "created_at", "id")


def list_contradictions(contradictions: DataFrame, status: str = "unresolved", limit: int = 100, offset: int = 0) -> DataFrame:
    """id, project, verdict, status, detected_at, total: a page of the contradictions of a status."""
    rows = contradictions.filter(F.col("status") == status).select("id", "project", "verdict", "status", "detected_at")
    return page(rows, limit, offset, "detected_at", "id")


def list_assumptions(assumptions: DataFrame, status: str | None = None, category: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """id, category, status, detected_at, total: a page of the assumptions of a status and category."""
    rows = assumptions.select("id", "category", "status", "detected_at")
    for name, value in (("status", status), ("category", category)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return page(rows, limit, offset, "detected_at", "id")


def assumption_facets(assumptions: DataFrame) -> DataFrame:
    """facet, value, n: how many assumptions have each status and category, and how many await an answer; one pass."""
    awaiting = F.col("status").isin(*AWAITING)
    facets = F.array(
        F.struct(F.lit("status").alias("facet"), F.col("status").alias("value"), F.lit(1).alias("one")),
        F.struct(F.lit("category").alias("facet"), F.col("category").alias("value"), F.lit(1).alias("one")),
        F.struct(F.lit("actionable").alias("facet"), F.lit("actionable").alias("value"), awaiting.cast("int").alias("one")),
    )
    return assumptions.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.sum("f.one").alias("n"))


def to_policies(decisions: DataFrame, bridge: DataFrame) -> DataFrame:
    """policy_id, name, description, dimensions, severity, source_type, confidence, decision_type of valid decisions."""
    dims = bridge.groupBy("id").agg(F.sort_array(F.collect_set("dimension")).alias("dimensions"))
    severity = first_match([(F.col("decision_type") == k, s) for k, s in POLICY_SEVERITY.items()], "medium")
    return decisions.filter("valid").join(dims, "id", "left").select(
        F.col("id").alias("policy_id"),
        F.col("title").alias("name"),
        F.substring("content", 1, 200).alias("description"),
        F.coalesce("dimensions", F.array().cast("array<string>")).alias("dimensions"),
        severity.alias("severity"),
        "source_type",
        "confidence",
        "decision_type",
    )

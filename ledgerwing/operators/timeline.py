"""Unified timelines and audit trails from several sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwing.functions.labels import git_severity


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def activity(df: DataFrame, kind: str, entry_id: Column, ts: Column, agent: Column, summary: Column, severity: Column) -> DataFrame:
    """One source's rows as timeline entries."""
    return df.select(
        F.concat(F.lit(kind + ":"), entry_id.cast("string")).alias("entry_id"),
        ts.cast("timestamp").alias("ts"),
        agent.cast("string").alias("agent_id"),
        F.lit(kind).alias("kind"),
        F.substring(summary, 1, 200).alias("summary"),
        severity.alias("severity"),
    )


def activity_timeline(parts: list[DataFrame]) -> DataFrame:
    """All entries; callers order by ts and entry_id where they page."""
    return union_all(parts)


def observation_entries(spans: DataFrame, tool_calls: DataFrame, shell: DataFrame, vcs: DataFrame, reads: DataFrame, danger: Callable[[Column, Column], Column] | None = None) -> list[DataFrame]:
    """Timeline entries of observed model calls, tool calls, commands, version-control operations and file reads.

    Failed tool calls and commands are warnings; danger(command, exit_code), if given, says a command's severity.
    """

    def at(c: str) -> Column:
        return F.timestamp_micros((F.col(c) * 1_000_000).cast("long"))

    model = F.format_string("LLM call: %s (%s), %s+%s tokens", "model", "provider", "tokens_in", "tokens_out")
    failed = F.when(F.col("exit_code") != 0, "warning").otherwise("info")
    return [
        activity(spans, "llm_call", F.col("span_id"), at("timestamp"), F.col("agent_id"), model, F.lit("info")),
        activity(tool_calls, "tool_call", F.col("call_id"), at("timestamp"), F.col("agent_id"), F.concat(F.lit("Tool: "), "tool_name"), F.when(F.col("success"), "info").otherwise("warning")),
        activity(shell, "shell", F.col("execution_id"), at("timestamp"), F.col("agent_id"), F.concat(F.lit("Shell: "), "command"), danger(F.col("command"), F.col("exit_code")) if danger else failed),
        activity(vcs, "vcs", F.col("operation_id"), at("timestamp"), F.col("agent_id"), F.concat_ws(" ", F.lit("Git:"), "operation", "branch"), git_severity(F.col("operation"))),
        activity(reads, "file_read", F.col("read_id"), at("timestamp"), F.col("agent_id"), F.format_string("Read %s (%s lines)", "path", "lines"), F.lit("info")),
    ]


# Label and result of an audit event; other events are their own label, with result info.
AUDIT_LABELS = {
    "decision_added": ("Decision Created", "info"),
    "decision_superseded": ("Decision Superseded", "info"),
    "contradiction_detected": ("Contradiction Detected", "warning"),
    "contradiction_resolved": ("Contradiction Resolved", "pass"),
    "assumption_detected": ("Assumption Found", "info"),
    "assumption_validated": ("Assumption Validated", "pass"),
    "assumption_rejected": ("Assumption Rejected", "fail"),
    "assumption_scan": ("Assumptions Scanned", "info"),
}
#: Statuses of a decision that is out of force.
OUT_OF_FORCE = ("superseded", "deprecated", "archived")


def _labelled(kind: Column, at: int) -> Column:
    table = F.create_map(*[x for k, both in AUDIT_LABELS.items() for x in (F.lit(k), F.lit(both[at]))])
    return F.coalesce(F.element_at(table, kind), F.lit("info") if at else kind)


def _entries(df: DataFrame, source: str, options: list[Column]) -> DataFrame:
    """The entries that each row gives rise to; options are null where they do not apply."""
    each = df.select(F.explode(F.array_compact(F.array(*options))).alias("e")).select("e.*")
    kind = F.col("event_type")
    return each.select("entry_id", "ts", "event_type", F.coalesce("label", _labelled(kind, 0)).alias("label"), F.coalesce("description", F.lit("")).alias("description"), "actor", F.coalesce("result", _labelled(kind, 1)).alias("result"), F.lit(source).alias("source"))


def _entry(prefix: str, key: Column, ts: Column, kind: Column, actor: Column, description: Column, result: Column | None = None, label: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.concat(F.lit(prefix), key.cast("string")).alias("entry_id"),
        ts.cast("timestamp").alias("ts"),
        kind.alias("event_type"),
        actor.cast("string").alias("actor"),
        description.alias("description"),
        (none if result is None else result).alias("result"),
        (none if label is None else label).alias("label"),
    )


def audit_trail(decisions: DataFrame, contradictions: DataFrame, assumptions: DataFrame | None = None, traces: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """entry_id, ts, event_type, label, description, actor, result, source: five kinds of records as one trail.

    decisions: added, and superseded if out of force, at their creation. contradictions (id, verdict, a_id, b_id,
    status, detected_at, resolved_by): detected, and resolved at the same time. assumptions (id, project, summary,
    severity, status, detected_at, resolved_at, resolved_by): detected, validated or rejected, and one scan a project
    at its first detection. traces (id, type, action, result, agent, file, reason, model, prompt_preview, ts): hooks and
    model calls. log (id, ts, event_type, actor, description): entries of the sealed log.
    """
    by = F.col("source_type")
    out_of_force = ~F.col("valid") | F.col("status").isin(*OUT_OF_FORCE)
    made = _entry("c:", F.col("id"), F.col("created_at"), F.lit("decision_added"), F.coalesce(by, F.lit("cli")), F.col("title"))
    gone = _entry("s:", F.col("id"), F.col("created_at"), F.lit("decision_superseded"), F.lit("system"), F.format_string("%s [%s]", "title", "status"))
    parts = [_entries(decisions, "decisions", [made, F.when(out_of_force, gone)])]
    against = F.concat_ws(" ", F.col("a_id").cast("string"), F.lit("vs"), F.col("b_id").cast("string"))
    found = _entry("d:", F.col("id"), F.col("detected_at"), F.lit("contradiction_detected"), F.lit("system"), F.format_string("%s: %s", "verdict", against))
    done = _entry("r:", F.col("id"), F.col("detected_at"), F.lit("contradiction_resolved"), F.coalesce("resolved_by", F.lit("dashboard")), against)
    parts.append(_entries(contradictions, "contradictions", [found, F.when(F.col("status") == "resolved", done)]))
    if assumptions is not None:
        severity = F.coalesce("severity", F.lit("medium"))
        result = F.when(severity.isin("high", "critical"), "warning").otherwise("info")
        seen = _entry("a:", F.col("id"), F.col("detected_at"), F.lit("assumption_detected"), F.lit("scanner"), F.format_string("[%s] %s", F.upper(severity), "summary"), result)
        kind = F.concat(F.lit("assumption_"), "status")
        settled = _entry("o:", F.col("id"), F.col("resolved_at"), kind, F.coalesce("resolved_by", F.lit("dashboard")), F.col("summary"))
        parts.append(_entries(assumptions, "assumptions", [seen, F.when(F.col("status").isin("validated", "rejected") & F.col("resolved_at").isNotNull(), settled)]))
        scans = assumptions.groupBy("project").agg(F.min("detected_at").alias("first"), F.count("*").alias("n")).filter("first is not null")
        scan = _entry("n:", F.col("project"), F.col("first"), F.lit("assumption_scan"), F.lit("scanner"), F.format_string("%s assumption(s) detected", "n"))
        parts.append(_entries(scans, "assumptions", [scan]))
    if traces is not None:
        hook, call = F.col("type") == "hook", F.col("type") == "llm_call"
        action = F.coalesce("action", F.lit(""))
        kind = F.when(hook, F.when(action == "", "hook").otherwise(F.concat(F.lit("hook_"), F.lower(action)))).otherwise(F.coalesce("type", F.lit("unknown")))
        label = F.when(hook, F.concat(F.lit("Hook: "), action)).when(call, "LLM Call").otherwise(F.coalesce("type", F.lit("unknown")))
        file = F.element_at(F.split(F.coalesce("file", F.lit("")), "/"), -1)
        description = F.when(hook, F.concat_ws(": ", file, F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")))).when(call, F.concat_ws(": ", "model", F.substring("prompt_preview", 1, 80))).otherwise("")
        result = F.when(hook, F.when(F.col("result") == "pass", "pass").when(F.col("result").isin("block", "blocked"), "fail").otherwise("info")).otherwise("info")
        parts.append(_entries(traces, "traces", [_entry("t:", F.col("id"), F.col("ts"), kind, F.coalesce("agent", F.lit("cli")), description, result, label)]))
    if log is not None:
        parts.append(_entries(log, "audit_log", [_entry("l:", F.col("id"), F.col("ts"), F.col("event_type"), F.col("actor"), F.col("description"))]))
    return union_all(parts)


def agent_timeline(trail: DataFrame) -> DataFrame:
    return trail.filter("actor <> 'system'")


def source_counts(trail: DataFrame) -> DataFrame:
    return trail.groupBy("source", "event_type").agg(F.count("*").alias("n"))


def audit_labels(trail: DataFrame) -> DataFrame:
    return trail.select("entry_id", "label", "result")

"""Texts and findings for reviewers: rules, questions, constraint texts, context for a change, assumption outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.functions import labels
from ledgerwing.functions.labels import first_match
from ledgerwing.functions.questions import question_text
from ledgerwing.functions.text import extract_imports
from ledgerwing.operators.governance import assumption_priority, cluster, rule_stats
from ledgerwing.operators.keywords import containing
from ledgerwing.operators.pairs import dedupe_known

#: Confidence that a finding of each tier must reach.
TIER_THRESHOLDS = {"architectural": 0.4, "implementation": 0.7}
ARCHITECTURAL = ("data_scope", "configuration", "framework")
#: Days after which a deferred assumption comes back.
DEFER_DAYS = 7


def active_decisions(decisions: DataFrame, project: Column) -> DataFrame:
    """id, title, created_at of a project's valid decisions; callers that page order by created_at and id."""
    return decisions.filter(F.col("valid") & (F.col("project") == project)).select("id", "project", "title", "created_at")


def constraint_text(evidence: DataFrame, most: int = 3) -> DataFrame:
    """project, dimension, text: an imperative sentence that names a dimension's first packages (project, dimension, found)."""
    names = F.array_join(F.slice(F.sort_array("found"), 1, most), ", ")
    return evidence.select("project", "dimension", F.format_string("Use %s for %s; do not introduce alternatives without a recorded decision.", names, F.col("dimension")).alias("text"))


def rule_text(assumptions: DataFrame) -> DataFrame:
    """id, text: the rule that a validated or rejected assumption leaves, empty for others.

    assumptions: id, status, summary, options, selected_option, resolved_by, resolved_at.
    """
    chosen = F.get("options", F.col("selected_option"))
    when = F.date_format("resolved_at", "MMM dd")
    text = first_match(
        [
            (chosen.isNull(), F.lit("")),
            (F.col("status") == "validated", F.format_string("DOMAIN RULE: %s — %s [Validated by %s on %s]", F.col("summary"), chosen, F.col("resolved_by"), when)),
            (F.col("status") == "rejected", F.format_string("DOMAIN RULE: DO NOT assume %s. %s [Corrected by %s on %s]", F.lower("summary"), chosen, F.col("resolved_by"), when)),
        ],
        F.lit(""),
    )
    return assumptions.select("id", text.alias("text"))


def resolve_assumptions(assumptions: DataFrame, answers: DataFrame, as_of: Column) -> DataFrame:
    """id, status, selected_option, resolved_by, rationale, resolved_at, deferred_until of all assumptions after answers.

    assumptions: id, status, options. answers: id, option, resolved_by, rationale; at most one for an id. Only detected and proposed ones
    with an option of that number change: the first validates, one that asks for more context defers for DEFER_DAYS, others reject.
    """
    said = answers.select("id", F.col("option").alias("selected_option"), "resolved_by", "rationale")
    j = assumptions.select("id", "status", "options").join(said, "id", "left")
    chosen = F.lower(F.when(F.col("selected_option") >= 0, F.get("options", F.col("selected_option").cast("int"))))
    taken = F.col("status").isin("detected", "proposed") & chosen.isNotNull()
    status = first_match([(~taken, F.col("status")), (F.col("selected_option") == 0, F.lit("validated")), (chosen.contains("more context"), F.lit("deferred"))], F.lit("rejected"))
    j = j.withColumn("taken", F.coalesce(taken, F.lit(False))).withColumn("after", F.when(F.col("taken"), status).otherwise(F.col("status")))
    own = [F.when(F.col("taken"), F.col(c)).alias(c) for c in ("selected_option", "resolved_by", "rationale")]
    until = F.when(F.col("taken") & (F.col("after") == "deferred"), F.timestamp_micros(F.unix_micros(as_of) + DEFER_DAYS * 86_400_000_000))
    return j.select("id", F.col("after").alias("status"), *own, F.when(F.col("taken"), as_of).alias("resolved_at"), until.alias("deferred_until"))


# The dimension of a decision that a validated assumption of each category leaves.
DIMENSION_OF = {"data_scope": "database", "temporal": "state-management", "access": "auth", "completeness": "testing", "configuration": "deployment", "framework": "api-style"}
TITLE_CHARS = 80


def decisions_from(assumptions: DataFrame) -> DataFrame:
    """assumption_id, title, content, rationale, dimension, decision_type, made_by, source_type: the decision of each validated one.

    assumptions: id, status, category, summary, resolved_by. The content states the summary as a constraint.
    """
    rationale = F.concat(F.lit("Validated assumption: "), F.col("summary"))
    kind = F.replace(F.col("category"), F.lit("_"), F.lit(" "))
    content = F.concat(
        F.col("summary"), F.lit("\n\nThis is a validated "), kind, F.lit(" constraint. Do not change this behavior without explicit approval.\n\nRationale: "), rationale
    )
    dimension = first_match([(F.col("category") == c, F.lit(x)) for c, x in DIMENSION_OF.items()], F.lit("api-style"))
    return assumptions.filter("status = 'validated'").select(
        F.col("id").alias("assumption_id"),
        F.concat(F.lit("Validated: "), F.substring("summary", 1, TITLE_CHARS)).alias("title"),
        content.alias("content"),
        rationale.alias("rationale"),
        dimension.alias("dimension"),
        F.lit("architectural").alias("decision_type"),
        F.coalesce("resolved_by", F.lit("dashboard-user")).alias("made_by"),
        F.lit("agent").alias("source_type"),
    )


OUTCOMES = ("shadowed", "below_threshold", "pre_validated", "deduped", "new")


@dataclass
class AssumptionRun:
    """What one run over findings gives. proposals: cluster, id (the representative), project, summary, n, is_baseline,
    priority, question, options, status, the most urgent first by priority and id. counters: project, detected, a count of
    each outcome, clusters and compression (findings a cluster)."""

    proposals: DataFrame
    counters: DataFrame


def finding_outcomes(findings: DataFrame, known: DataFrame, rule_events: DataFrame) -> DataFrame:
    """findings with outcome and is_baseline: shadow rules first, then the tier's threshold, then what is known of the project."""
    threshold = F.when(F.col("category").isin(*ARCHITECTURAL), TIER_THRESHOLDS["architectural"]).otherwise(TIER_THRESHOLDS["implementation"])
    shadow = rule_stats(rule_events).filter("mode = 'shadow'").select(F.col("rule").alias("pattern_id"), F.lit(True).alias("is_shadow"))
    told = dedupe_known(findings.join(shadow, "pattern_id", "left"), known)
    outcome = first_match(
        [
            (F.col("is_shadow"), F.lit("shadowed")),
            (F.col("confidence") < threshold, F.lit("below_threshold")),
            (F.col("known_status") == "validated", F.lit("pre_validated")),
            (F.col("known_status") == "known", F.lit("deduped")),
        ],
        F.lit("new"),
    )
    return told.withColumn("outcome", outcome).drop("is_shadow", "known_status")


def assumption_run(findings: DataFrame, known: DataFrame, rule_events: DataFrame, evidence: DataFrame, modules: DataFrame, churned: DataFrame, per_file: int = 10) -> AssumptionRun:
    """Findings to proposals: shadow rules, tiers, known ones, clusters, priorities and questions in one plan.

    findings: id, project, category, pattern_id, file, summary, snippet, dedup_key, severity_rank, confidence, ts. known:
    project, dedup_key, status. rule_events: rule, event. evidence: id, module. modules, churned: as assumption_priority
    takes them. Counters come from the same pass over the findings as the proposals. A project without known
    assumptions freezes what it has as its baseline.
    """
    told = finding_outcomes(findings, known, rule_events)
    new = told.filter("outcome = 'new'")
    clusters = cluster(new, per_file)
    chosen = clusters.join(new.select("id", "project", "pattern_id", "category", "summary", "snippet", "file", "severity_rank", "is_baseline"), clusters["representative"] == new["id"])
    chosen = chosen.withColumn("summary", F.when(F.col("n") > 1, F.format_string("[%sx] %s", "n", "summary")).otherwise(F.col("summary")))
    urgent = assumption_priority(chosen.select("id", "severity_rank", "file").join(evidence, "id", "left"), modules, churned).select("id", "priority")
    asked = question_text(chosen.select("id", "pattern_id", "category", "summary", "snippet"))
    proposals = chosen.join(urgent, "id").join(asked, "id").select("cluster", "id", "project", "summary", "n", "is_baseline", "priority", "question", "options", F.lit("proposed").alias("status"))
    counts = told.groupBy("project").agg(F.count("*").alias("detected"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    groups = chosen.groupBy("project").agg(F.count("*").alias("clusters"))
    counters = counts.join(groups, "project", "left").withColumn("clusters", F.coalesce("clusters", F.lit(0)))
    return AssumptionRun(proposals, counters.withColumn("compression", F.round(F.coalesce(F.try_divide(F.col("new"), F.col("clusters")), F.lit(0.0)), 6)))


def assumption_pipeline(findings: DataFrame, known: DataFrame, rule_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of new findings that pass their tier and are not from a shadow rule, and a row of counters from one pass."""
    told = finding_outcomes(findings, known, rule_events)
    sure = F.count_if(~F.col("outcome").isin("below_threshold", "shadowed"))
    counters = told.agg(F.count("*").alias("scanned"), sure.alias("sure"), sure.alias("shown"), F.count_if(F.col("outcome") == "new").alias("new"))
    return cluster(told.filter("outcome = 'new'")), counters


def drop_multi_writer(findings: DataFrame, writes: DataFrame) -> DataFrame:
    """Single-writer findings (id, table_name) without those on tables that two or more files write (path, table_name)."""
    shared = writes.groupBy("table_name").agg(F.countDistinct("path").alias("n")).filter("n > 1")
    return findings.join(shared, "table_name", "left_anti")


def import_violations(files: DataFrame, taxonomy: DataFrame, constraints: DataFrame) -> DataFrame:
    """path, decision_id, module: the first import of each file that a constraint on its dimension does not allow.

    taxonomy (module, dimension) and constraints (decision_id, dimension, allowed) are reference tables.
    """
    used = extract_imports(files).withColumn("module", F.regexp_extract("module", r"^([A-Za-z_0-9]+)", 1)).distinct()
    hit = used.join(taxonomy, "module").join(constraints, "dimension").filter(~F.array_contains("allowed", F.col("module")))
    first = Window.partitionBy("path", "decision_id").orderBy("module")
    return hit.withColumn("n", F.row_number().over(first)).filter("n = 1").select("path", "decision_id", "module")


def pattern_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, name, kind: functions (file, name) that are gone: removed tests and removed public functions."""
    gone = before.select("file", "name").distinct().join(after.select("file", "name"), ["file", "name"], "left_anti")
    kinds = F.array_compact(F.array(F.when(F.col("name").startswith("test_"), "test_removed"), F.when(~F.col("name").startswith("_"), "public_api_removed")))
    return gone.select("file", "name", F.explode(kinds).alias("kind"))


# Words of a title that are no keywords, and folders whose files are not looked through.
STOP_WORDS = ("use", "the", "and", "or", "for", "with", "via", "api", "in", "a", "an", "at", "of", "to", "is", "are", "be")
PASSED_OVER = r"(^|/)(\.venv|__pycache__|\.git|node_modules)/"


def title_keywords(title: Column) -> Column:
    """Words of a title that begin with a letter and have three characters or more, in lower case, without common ones."""
    words = F.transform(F.regexp_extract_all(title, F.lit(r"(?U)\b([A-Za-z][A-Za-z0-9_-]+)\b"), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def affected_files(losers: DataFrame, files: DataFrame, most: int = 20) -> DataFrame:
    """id, path: files (path, content) that hold a keyword of a superseded decision's title (id, title), inside words too.

    Of a decision's files the first most by path, which are among the first most of its keywords, so no keyword brings
    more to the decisions that share it. All keywords are looked for in one pass over each file; files of folders that
    are passed over, and titles without keywords, give nothing.
    """
    keys = losers.select("id", F.explode(title_keywords(F.col("title"))).alias("keyword"))
    kept = files.filter(~F.col("path").cast("string").rlike(PASSED_OVER)).select("path", F.lower("content").alias("content"))
    found = containing(kept, keys, "content", "keyword", keep_text=False)
    first = found.withColumn("n", F.dense_rank().over(Window.partitionBy("keyword").orderBy("path"))).filter(F.col("n") <= most).select("keyword", "path").distinct()
    hit = first.join(keys, "keyword").select("id", "path").distinct()
    return hit.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("path"))).filter(F.col("n") <= most).select("id", "path")


def context_for(requests: DataFrame, decisions: DataFrame, bridge: DataFrame, contradictions: DataFrame, agents: DataFrame, most: int = 5) -> DataFrame:
    """request_id, allowed, decisions, unresolved, deferred: what an agent should know before it changes a file.

    requests: request_id, agent_id, project, path. A blocked path gives no decisions. Relevant are the project's valid
    decisions of a dimension that the path suggests, the newest first; unresolved counts the project's open ones, deferred
    those that deferred_warnings tells of.
    """
    access = labels.path_access(F.col("path"), F.col("blocked"), F.col("allowed_paths"))
    r = requests.join(agents, "agent_id", "left").withColumn("allowed", F.coalesce(access, F.lit(False)))
    asked = r.filter("allowed").select("request_id", "project", F.explode(labels.path_dimensions(F.col("path"))).alias("dimension"))
    live = bridge.join(decisions.filter("valid").select("id", "created_at"), "id").select("project", "dimension", "id", "created_at")
    hit = asked.join(live, ["project", "dimension"]).select("request_id", "id", "created_at").distinct()
    top = hit.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("created_at"), "id"))).filter(F.col("n") <= most)
    lists = top.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("x"))
    open_ = contradictions.groupBy("project").agg(F.count_if(F.expr("status = 'unresolved' and not is_baseline")).alias("unresolved"), F.count_if(F.col("status") == "deferred").alias("deferred"))
    j = r.join(lists, "request_id", "left").join(open_, "project", "left")
    ids = F.coalesce(F.transform("x", lambda e: e["id"]), F.array().cast("array<bigint>"))
    return j.select("request_id", "allowed", ids.alias("decisions"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unresolved", "deferred")])


def deferred_warnings(contradictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """project, id, warning: a line for each contradiction that people have put off, naming both decisions."""
    title = decisions.select("id", "title")
    put_off = contradictions.filter("status = 'deferred'").join(title.toDF("a_id", "a_title"), "a_id").join(title.toDF("b_id", "b_title"), "b_id")
    text = F.format_string("DEFERRED CONTRADICTION: %s vs %s. Human has not yet decided. Proceed with caution.", "a_title", "b_title")
    return put_off.select("project", "id", text.alias("warning"))

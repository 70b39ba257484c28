"""Counts, rates and scores over decision, calibration, dismissal and organisation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.schemas import DIMENSIONS, VERDICTS


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _r(col: Column) -> Column:
    return F.round(col, 6)


def attribution(decisions: DataFrame, by: str = "project") -> DataFrame:
    """by, agent, human, total, agent_share: who took the decisions; sources agent and scan are agents, all others people."""
    agent = F.coalesce(F.col("source_type").isin("agent", "scan"), F.lit(False))
    out = decisions.groupBy(by).agg(_n(agent).alias("agent"), _n(~agent).alias("human"), F.count("*").alias("total"))
    return out.withColumn("agent_share", _r(F.col("agent") / F.col("total")))


def is_actionable() -> Column:
    return (F.col("verdict") == "contradiction") & (F.col("status") == "unresolved") & ~F.col("is_baseline")


def health(decisions: DataFrame, contradictions: DataFrame) -> DataFrame:
    """project, active, actionable, coherence = max(0, 1 - actionable / active)."""
    active = decisions.groupBy("project").agg(_n(F.col("valid")).alias("active"))
    open_ = contradictions.filter(is_actionable()).groupBy("project").agg(F.count("*").alias("actionable"))
    joined = active.join(open_, "project", "left").withColumn("actionable", F.coalesce("actionable", F.lit(0)))
    return joined.withColumn("coherence", _r(F.when(F.col("active") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("actionable") / F.greatest("active", F.lit(1))))))


def band(coherence: Column) -> Column:
    return F.when(coherence >= 0.8, "healthy").when(coherence >= 0.5, "degraded").otherwise("critical")


def triage(decisions: DataFrame, contradictions: DataFrame) -> DataFrame:
    """project, total, actionable, coherence on all decisions, status: 0.8 and more healthy, 0.5 and more degraded, else critical."""
    total = decisions.groupBy("project").agg(F.count("*").alias("total"))
    open_ = contradictions.filter(is_actionable()).groupBy("project").agg(F.count("*").alias("actionable"))
    out = total.join(open_, "project", "left").withColumn("actionable", F.coalesce("actionable", F.lit(0)))
    coherence = F.greatest(F.lit(0.0), 1 - F.col("actionable") / F.col("total"))
    return out.withColumn("coherence", _r(coherence)).withColumn("status", band(coherence))


def top_contradictions(contradictions: DataFrame, k: int = 5) -> DataFrame:
    """project, rank, id, verdict, confidence: a project's k gravest unresolved ones: contradictions first, then the surest, then by id."""
    first = Window.partitionBy("project").orderBy(F.col("verdict") != "contradiction", F.desc("confidence"), "id")
    open_ = contradictions.filter("status = 'unresolved'").withColumn("rank", F.row_number().over(first))
    return open_.filter(F.col("rank") <= k).select("project", "rank", "id", "verdict", "confidence")


def home(decisions: DataFrame, contradictions: DataFrame, alerts: DataFrame, timeline: DataFrame, assumptions: DataFrame) -> DataFrame:
    """triage() of every project with active, unresolved, drifting_agent, drift, anomalous_calls, pending.

    alerts: project, agent_id, score; the highest score above 0 counts, ties by agent. timeline: project, action, severity;
    LLM calls of severity warning or critical are anomalous. assumptions: project, status; proposed ones are pending.
    """
    active = decisions.groupBy("project").agg(_n(F.col("status") == "active").alias("active"))
    unresolved = contradictions.groupBy("project").agg(_n(F.col("status") == "unresolved").alias("unresolved"))
    worst = alerts.filter("score > 0").groupBy("project").agg(F.max("score").alias("drift"), F.max_by("agent_id", F.struct("score", -F.col("agent_id"))).alias("drifting_agent"))
    calls = timeline.groupBy("project").agg(_n((F.col("action") == "llm_call") & F.col("severity").isin("warning", "critical")).alias("anomalous_calls"))
    pending = assumptions.groupBy("project").agg(_n(F.col("status") == "proposed").alias("pending"))
    out = triage(decisions, contradictions)
    for part in (active, unresolved, worst, calls, pending):
        out = out.join(part, "project", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("active", "unresolved", "anomalous_calls", "pending")]
    return out.select("project", "total", "actionable", "coherence", "status", *zero, "drifting_agent", F.coalesce("drift", F.lit(0.0)).alias("drift"))


def timeline_summary(timeline: DataFrame, by: str = "agent_id") -> DataFrame:
    """by, action counts, cost and distinct targets of a unified timeline, in one pass."""
    return timeline.groupBy(by, "action").agg(F.count("*").alias("n"), _r(F.sum("cost_usd")).alias("cost"), F.countDistinct("target").alias("targets"))


def timeline_facets(timeline: DataFrame) -> DataFrame:
    """project, facet (action, severity, agent), value, n: what a project's timeline is made of, from one pass of grouping sets.

    timeline: project, agent_id, action, severity. A null action is `unknown`, a null severity `info`; empty agents do not count.
    """
    facets = {"action": F.coalesce("action", F.lit("unknown")), "severity": F.coalesce("severity", F.lit("info")), "agent": F.nullif(F.col("agent_id").cast("string"), F.lit(""))}
    rows = timeline.select("project", *[c.alias(n) for n, c in facets.items()])
    counted = rows.groupingSets([["project", n] for n in facets], "project", *facets).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for place, n in enumerate(facets):
        mine = F.col("g") == (7 & ~(4 >> place))
        facet, value = F.when(mine, n).otherwise(facet), F.when(mine, F.col(n)).otherwise(value)
    return counted.select("project", facet.alias("facet"), value.alias("value"), "n").filter("value is not null")


def llm_totals(spans: DataFrame, calls: DataFrame, cost: Column) -> DataFrame:
    """project, cost_usd, tokens_in, tokens_out, providers, models of a project's spans and of its traced calls.

    spans: project, provider, model, cost_usd, tokens_in, tokens_out. calls: project, model, cost_usd, input_tokens,
    output_tokens; a call without a cost, or with none, takes cost, a column over it. Only spans name providers and models.
    """
    none = F.lit(None).cast("string")
    number = lambda c: F.coalesce(c, F.lit(0))
    own = spans.select("project", number("cost_usd").cast("double").alias("cost_usd"), number("tokens_in").alias("tokens_in"), number("tokens_out").alias("tokens_out"), "provider", "model")
    known = F.nullif("cost_usd", F.lit(0.0))
    traced = calls.select("project", F.coalesce(known, cost).cast("double").alias("cost_usd"), number("input_tokens").alias("tokens_in"), number("output_tokens").alias("tokens_out"), none.alias("provider"), none.alias("model"))
    return own.unionByName(traced).groupBy("project").agg(
        _r(F.sum("cost_usd")).alias("cost_usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sort_array(F.collect_set("provider")).alias("providers"), F.sort_array(F.collect_set("model")).alias("models")
    )


def usage_counts(events: DataFrame) -> DataFrame:
    """agent_id, calls, unique_targets, action_kinds."""
    return events.groupBy("agent_id").agg(F.count("*").alias("calls"), F.countDistinct("target").alias("unique_targets"), F.countDistinct("action").alias("action_kinds"))


def usage_by(events: DataFrame) -> DataFrame:
    """by (category, agent), value, calls of tool calls (agent_id, category), in one pass; an empty agent or category is `unknown`."""
    rows = events.select(*[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias(n) for n, c in (("category", "category"), ("agent", "agent_id"))])
    counted = rows.groupingSets([["category"], ["agent"]], "category", "agent").agg(F.count("*").alias("calls"), F.grouping_id().alias("g"))
    return counted.select(F.when(F.col("g") == 1, "category").otherwise("agent").alias("by"), F.coalesce("category", "agent").alias("value"), "calls")


def trajectory_actions(events: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """keys, actions (action -> count), length of each trajectory (keys, action)."""
    per = events.groupBy(*keys, "action").agg(F.count("*").alias("n"))
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias("actions")
    return per.groupBy(*keys).agg(counts, F.sum("n").alias("length"))


def change_signals(changes: DataFrame, many: int = 50, configs: int = 3) -> DataFrame:
    """grp, signal, n: large change batches, many config changes, dependency changes (grp, category rows)."""
    counts = changes.groupBy("grp").agg(F.count("*").alias("total"), _n(F.col("category") == "config").alias("config"), _n(F.col("category") == "dependency").alias("dependency"))
    found = F.array(
        F.when(F.col("total") > many, F.struct(F.lit("file_changes").alias("signal"), F.col("total").alias("n"))),
        F.when(F.col("config") > configs, F.struct(F.lit("config_change").alias("signal"), F.col("config").alias("n"))),
        F.when(F.col("dependency") > 0, F.struct(F.lit("dependency_change").alias("signal"), F.col("dependency").alias("n"))),
    )
    return counts.select("grp", F.explode(F.array_compact(found)).alias("s")).select("grp", "s.signal", "s.n")


def _correct() -> Column:
    return (F.col("judge_verdict") == F.col("human_verdict")).cast("double")


def calibration_metrics(records: DataFrame, by: str = "judge", bins: int = 10, window: int = 50, drift_limit: float = 0.15) -> DataFrame:
    """by, n, accuracy, brier, ece, wasserstein, drift, needs_review: all judge metrics in two passes over the records.

    ece: over confidence bins, their share times the gap of accuracy and mean confidence. wasserstein: distance of the
    two distributions of ordered verdicts, unknown ones counting as the first. drift: gap of overall accuracy and that
    of the newest `window` records (rank-limited before the shuffle), 0 for fewer than two records.
    """
    rows = records.withColumn("correct", _correct())
    order = F.create_map(*[x for k, v in enumerate(VERDICTS) for x in (F.lit(v), F.lit(k))])
    j, h = [F.coalesce(F.element_at(order, F.col(c)), F.lit(0)) for c in ("judge_verdict", "human_verdict")]
    bin_ = F.least(F.floor(F.col("judge_confidence") * bins), F.lit(bins - 1))
    binned = rows.groupBy(by, bin_.alias("bin")).agg(
        F.count("*").alias("m"),
        F.sum("correct").alias("hits"),
        F.sum("judge_confidence").alias("conf"),
        F.sum(F.pow(F.col("judge_confidence") - F.col("correct"), 2)).alias("sq"),
        *[_n(j <= k).alias(f"j{k}") for k in range(2)],
        *[_n(h <= k).alias(f"h{k}") for k in range(2)],
    )
    total = F.sum("m").alias("n")
    metrics = binned.groupBy(by).agg(
        total,
        (F.sum("hits") / F.sum("m")).alias("accuracy"),
        (F.sum("sq") / F.sum("m")).alias("brier"),
        (F.sum(F.abs(F.col("hits") - F.col("conf"))) / F.sum("m")).alias("ece"),
        ((F.abs(F.sum("j0") - F.sum("h0")) + F.abs(F.sum("j1") - F.sum("h1"))) / F.sum("m")).alias("wasserstein"),
    )
    newest = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id"))
    recent = rows.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= window).groupBy(by).agg(F.avg("correct").alias("recent"))
    drift = F.when(F.col("n") < 2, 0.0).otherwise(F.abs(F.col("accuracy") - F.col("recent")))
    return metrics.join(recent, by).select(by, "n", *[_r(F.col(c)).alias(c) for c in ("accuracy", "brier", "ece", "wasserstein")], _r(drift).alias("drift"), (drift > drift_limit).alias("needs_review"))


def dismissal_stats(dismissals: DataFrame, totals: DataFrame, min_samples: int = 5, rate_limit: float = 0.5) -> DataFrame:
    """dimension, total, dismissed, rate, mean confidence and (positive) similarity, needs_tuning."""
    d = dismissals.groupBy("dimension").agg(F.count("*").alias("dismissed"), F.avg("confidence").alias("avg_confidence"), F.avg(F.when(F.col("nli_score") > 0, F.col("nli_score"))).alias("avg_nli"))
    j = d.join(totals, "dimension", "full_outer")
    dismissed, total = F.coalesce("dismissed", F.lit(0)), F.coalesce("total", "dismissed")
    rate = F.when(total == 0, 0.0).otherwise(dismissed / total)
    return j.select(
        "dimension",
        total.alias("total"),
        dismissed.alias("dismissed"),
        _r(rate).alias("rate"),
        _r(F.coalesce("avg_confidence", F.lit(0.0))).alias("avg_confidence"),
        _r(F.coalesce("avg_nli", F.lit(0.0))).alias("avg_nli"),
        ((dismissed >= min_samples) & (rate > rate_limit)).alias("needs_tuning"),
    )


def tuning_report(stats: DataFrame, current: float = 0.3, step: float = 0.1, most: float = 0.8) -> DataFrame:
    """dimension, recommended, rate: raised thresholds for dimensions that need tuning."""
    up = F.when(F.col("avg_nli") > 0, F.greatest(F.lit(current), F.col("avg_nli") + step)).otherwise(F.lit(current + step))
    return stats.filter("needs_tuning").select("dimension", _r(F.least(F.lit(most), up)).alias("recommended"), "rate", "dismissed")


def aggregate_orgs(rows: DataFrame, k: int = 5) -> DataFrame:
    """dimension, total_decisions, orgs_using, avg_per_org, avg_confidence; nothing unless k organisations contribute."""
    gate = rows.agg(F.countDistinct("org_id").alias("orgs"))
    out = rows.groupBy("dimension").agg(F.count("*").alias("total_decisions"), F.countDistinct("org_id").alias("orgs_using"), F.avg("confidence").alias("c"))
    gated = out.crossJoin(F.broadcast(gate)).filter(F.col("orgs") >= k)
    return gated.select("dimension", "total_decisions", "orgs_using", _r(F.col("total_decisions") / F.col("orgs_using")).alias("avg_per_org"), _r(F.col("c")).alias("avg_confidence"))


def top_patterns(rows: DataFrame, n: int = 20) -> DataFrame:
    """pattern, dimension, occurrences, orgs, adoption, avg_confidence: the n most common type and first dimension."""
    gate = rows.agg(F.countDistinct("org_id").alias("all_orgs"))
    out = rows.groupBy(F.col("decision_type").alias("pattern"), F.col("first_dimension").alias("dimension")).agg(F.count("*").alias("occurrences"), F.countDistinct("org_id").alias("orgs"), F.avg("confidence").alias("c"))
    top = out.orderBy(F.desc("occurrences"), "pattern", "dimension").limit(n)
    return top.crossJoin(F.broadcast(gate)).select("pattern", "dimension", "occurrences", "orgs", _r(F.col("orgs") / F.col("all_orgs")).alias("adoption"), _r(F.col("c")).alias("avg_confidence"))


def insights(per_org: DataFrame, adoption: float = 0.7) -> DataFrame:
    """org_id, dimension, kind: dimensions that most organisations use and this one lacks (per_org: org_id, dimension)."""
    used = per_org.select("org_id", "dimension").distinct()
    orgs = used.select("org_id").distinct()
    n = orgs.agg(F.count("*").alias("orgs"))
    common = used.groupBy("dimension").agg(F.count("*").alias("users")).crossJoin(F.broadcast(n)).filter(F.col("users") >= adoption * F.col("orgs")).select("dimension", _r(F.col("users") / F.col("orgs")).alias("adoption"))
    wanted = orgs.crossJoin(F.broadcast(common))  # dimensions are a dozen fixed names
    return wanted.join(used, ["org_id", "dimension"], "left_anti").select("org_id", "dimension", "adoption", F.lit("adoption_gap").alias("kind"))


def insight_kinds(patterns: DataFrame, rates: DataFrame, orgs: DataFrame, dimensions: list[str], adoption: float = 0.7, hot: float = 0.3, sure: float = 0.8) -> DataFrame:
    """kind, severity, dimension, pattern, metric: what an organisation of the given dimensions can learn from others.

    patterns: the output of top_patterns. rates: dimension, orgs_using, contradiction_rate. orgs: one row with orgs.
    Patterns of wide adoption in a dimension that the organisation lacks are adoption gaps, dimensions of many
    contradictions hotspots, the first five patterns trending where adoption and confidence are high, and dimensions
    that half of all organisations use and this one does not recommendations. Without dimensions of its own an
    organisation has neither gaps nor recommendations.
    """
    mine = F.col("dimension").isin(*dimensions) if dimensions else F.lit(True)
    none = F.lit(None)
    columns = ["kind", "severity", "dimension", "pattern", "metric"]

    def rows(df: DataFrame, kind: str, severity: str, pattern: Column, metric: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "dimension", pattern.cast("string").alias("pattern"), metric.cast("double").alias("metric")).select(*columns)

    common = F.col("adoption") >= adoption
    first = patterns.orderBy(F.desc("occurrences"), "pattern", "dimension").limit(5)
    gaps = rows(patterns.filter(common & ~mine), "adoption_gap", "warning", F.col("pattern"), F.col("adoption"))
    hotspots = rows(rates.filter(F.col("contradiction_rate") >= hot), "contradiction_hotspot", "critical", none, F.col("contradiction_rate"))
    trending = rows(first.filter(common & (F.col("avg_confidence") >= sure)), "trending", "info", F.col("pattern"), F.col("adoption"))
    wanted = rates.crossJoin(orgs.select("orgs")).filter(~mine & (F.col("orgs_using") >= 0.5 * F.col("orgs")))
    return gaps.unionByName(hotspots).unionByName(trending).unionByName(rows(wanted, "recommendation", "info", none, none))


def fingerprint_hash(fingerprints: DataFrame) -> DataFrame:
    """project, hash: the first 16 hex digits of the SHA-256 of a vector's slots with six places, joined by commas."""
    slots = F.array_join(F.transform("vector", lambda x: F.format_string("%.6f", x)), ",")
    return fingerprints.select("project", F.substring(F.sha2(slots.cast("binary"), 256), 1, 16).alias("hash"))


def fingerprint(decisions: DataFrame, bridge: DataFrame, contradictions: DataFrame) -> DataFrame:
    """project, vector: a profile of 20 slots: 12 dimension scores, then eight features of the project.

    Slots are rounded to six places; the 1e-9 keeps exact halves from falling either way with the order of a sum.
    """
    per_dim = bridge.join(decisions.select("id", "confidence"), "id").groupBy("project").pivot("dimension", list(DIMENSIONS)).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"))
    base = decisions.groupBy("project").agg(F.count("*").alias("n"), F.avg("confidence").alias("conf"), F.countDistinct("source_type").alias("kinds"))
    contra = contradictions.groupBy("project").agg(F.count("*").alias("contra"), _n(F.col("status") == "resolved").alias("resolved"))
    j = base.join(per_dim, "project", "left").join(contra, "project", "left")
    counts = {d: F.coalesce(F.col(f"`{d}_n`"), F.lit(0)) for d in DIMENSIONS}
    scores = [F.least(F.lit(1.0), counts[d] / F.col("n")) * F.coalesce(F.col(f"`{d}_c`"), F.lit(0.0)) for d in DIMENSIONS]
    used = sum((F.when(c > 0, 1).otherwise(0) for c in counts.values()), F.lit(0))
    rate = F.coalesce(F.col("contra"), F.lit(0)) / F.col("n")
    resolution = F.coalesce(F.col("resolved") / F.col("contra"), F.lit(0.0))
    coverage = used / F.lit(float(len(DIMENSIONS)))
    features = [
        F.least(F.lit(1.0), F.log1p("n") / F.log1p(F.lit(1000.0))),
        F.least(F.lit(1.0), rate),
        F.col("conf"),
        coverage,
        coverage * F.col("conf") * (0.5 + 0.5 * resolution),
        F.least(F.lit(1.0), F.col("kinds") / F.lit(5.0)),
        F.least(F.lit(1.0), F.col("n") / F.greatest(used * 5, F.lit(1))),
        resolution,
    ]
    return j.select("project", F.array(*[F.round(x + 1e-9, 6) for x in [*scores, *features]]).alias("vector"))


def recurring_exceptions(exceptions: DataFrame, least: int = 3) -> DataFrame:
    return exceptions.groupBy("contradiction_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def majority_vote(votes: DataFrame) -> DataFrame:
    """pair_id, verdict, votes, agreement, confidence: the most frequent verdict; ties go to the one seen first.

    votes: pair_id, round (their order, unique in a pair), verdict, confidence. confidence is the best of the winning votes times the agreement.
    """
    per = votes.groupBy("pair_id", "verdict").agg(F.count("*").alias("n"), F.max("confidence").alias("c"), F.min("round").alias("first"))
    best = per.groupBy("pair_id").agg(F.sum("n").alias("total"), F.max_by(F.struct("verdict", "n", "c"), F.struct("n", -F.col("first"))).alias("w"))
    agreement = F.col("w.n") / F.col("total")
    return best.select("pair_id", "w.verdict", F.col("w.n").alias("votes"), F.round(agreement, 3).alias("agreement"), F.round(F.col("w.c") * agreement, 3).alias("confidence"))


def quality_gate(decisions: DataFrame, bridge: DataFrame, contradictions: DataFrame) -> DataFrame:
    """project, rule, severity, field, violations of a project's open contradictions and of its active decisions.

    An open contradiction is an error, an active decision without dimensions too; one without a rationale is a warning.
    """
    against = contradictions.filter(is_actionable()).groupBy("project").agg(F.count("*").alias("violations"))
    tagged = bridge.select("id").distinct().withColumn("tagged", F.lit(True))
    active = decisions.filter("status = 'active'").join(tagged, "id", "left")
    told = F.array_compact(
        F.array(
            F.when(F.col("tagged").isNull(), F.struct(F.lit("error").alias("severity"), F.lit("dimensions").alias("field"))),
            F.when(F.trim(F.coalesce("rationale", F.lit(""))) == "", F.struct(F.lit("warning").alias("severity"), F.lit("rationale").alias("field"))),
        )
    )
    bare = active.select("project", F.explode(told).alias("t")).groupBy("project", "t.severity", "t.field").agg(F.count("*").alias("violations"))
    first = against.select("project", F.lit("no-new-contradictions").alias("rule"), F.lit("error").alias("severity"), F.lit("").alias("field"), "violations")
    return first.unionByName(bare.select("project", F.lit("decision-metadata").alias("rule"), "severity", "field", "violations"))


# A dimension on the left needs one on the right.
IMPLICATIONS = (
    ("auth_requires_security", "auth", "security"),
    ("deployment_requires_logging", "deployment", "logging"),
    ("caching_requires_state_mgmt", "caching", "state-management"),
    ("testing_with_error_handling", "testing", "error-handling"),
    ("concurrency_requires_state_mgmt", "concurrency", "state-management"),
    ("security_requires_auth", "security", "auth"),
    ("messaging_requires_error_handling", "messaging", "error-handling"),
)
# The words that name an interface style.
API_STYLES = ("rest", "graphql", "grpc", "soap", "websocket")


def api_style_consistency(decisions: DataFrame, bridge: DataFrame) -> DataFrame:
    """project, styles, satisfied: a project's valid api-style decisions name one style at most, in title or content."""
    words = F.lower(F.concat_ws(" ", "title", F.coalesce("content", F.lit(""))))
    named = F.array_compact(F.array(*[F.when(words.contains(x), x) for x in API_STYLES]))
    api = bridge.filter(F.col("dimension") == "api-style").select("id").distinct()
    live = decisions.filter("valid").join(api, "id", "left_semi").select("project", F.explode_outer(named).alias("style"))
    found = live.groupBy("project").agg(F.sort_array(F.collect_set("style")).alias("styles"))
    return found.select("project", "styles", (F.size("styles") <= 1).alias("satisfied"))


def verify_rules(decisions: DataFrame, bridge: DataFrame, rules: tuple[tuple[str, str, str], ...] = IMPLICATIONS) -> DataFrame:
    """project, rule, satisfied: what a project's valid decisions imply."""
    live = bridge.join(decisions.filter("valid").select("id"), "id")
    names = sorted({x for _, a, b in rules for x in (a, b)})
    has = live.groupBy("project").agg(*[F.bool_or(F.col("dimension") == x).alias(x) for x in names])
    checks = F.array(*[F.struct(F.lit(n).alias("rule"), (~F.col(f"`{a}`") | F.col(f"`{b}`")).alias("satisfied")) for n, a, b in rules])
    return has.select("project", F.explode(checks).alias("c")).select("project", "c.rule", "c.satisfied")


def signal_board(signals: DataFrame) -> DataFrame:
    """grp, critical, warning, info, light: red on a critical signal, yellow on a warning."""
    counts = signals.groupBy("grp").agg(*[_n(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    return counts.withColumn("light", F.when(F.col("critical") > 0, "red").when(F.col("warning") > 0, "yellow").otherwise("green"))


def dataset_stats(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("dimension").alias("dimensions"))


def missing_share(flags: DataFrame, keys: list[str]) -> DataFrame:
    """framework status by the number of evidence flags that hold: 2 and more met, 1 partial, none missing."""
    n = sum((F.when(F.col(k), 1).otherwise(0) for k in keys), F.lit(0))
    return flags.withColumn("evidence", n).withColumn("status", F.when(n >= 2, "met").when(n == 1, "partial").otherwise("missing"))

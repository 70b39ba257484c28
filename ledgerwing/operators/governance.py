"""Access, approval, waiver, resolution and compliance rules over request and record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwing.functions.labels import first_match
from ledgerwing.operators.aggregates import missing_share

# Hours until a waiver of each tier runs out (none: never), the approvals it needs, and whether it is reviewed afterwards.
TIERS = {
    "auto_waiver": (None, 0, False),
    "standard": (720, 1, False),
    "elevated": (2160, 2, False),
    "break_glass": (72, 1, True),
}
# Dimensions whose conflicts people decide.
CRITICAL_DIMENSIONS = ("auth", "security", "deployment")
# The capabilities that each trust level has.
TRUST = {
    "untrusted": ("read_decisions",),
    "basic": ("read_decisions", "write_decisions"),
    "verified": ("read_decisions", "write_decisions", "detect_contradictions"),
    "trusted": ("read_decisions", "write_decisions", "detect_contradictions", "resolve_contradictions", "execute_code"),
    "privileged": (
        "read_decisions",
        "write_decisions",
        "detect_contradictions",
        "resolve_contradictions",
        "modify_governance",
        "execute_code",
        "access_external",
        "manage_agents",
    ),
}
# The ways to settle a pair of each verdict, with their impact.
RESOLUTIONS = {
    "contradiction": (("pick_a", "high"), ("pick_b", "high"), ("accept_exception", "low")),
    "tension": (("accept_exception", "low"), ("update_decision", "medium"), ("defer", "low")),
    "compatible": (("dismiss", "low"),),
}
# The status of a contradiction after each action.
STATUS_AFTER = {
    "pick_a": "resolved",
    "pick_b": "resolved",
    "accept_exception": "ignored",
    "defer": "deferred",
    "dismiss": "resolved",
    "update_decision": "deferred",
}
# Requirements of two frameworks, with the dimensions that cover each and the controls that stand for it.
HIPAA = (
    ("HIPAA-ACCESS-1", ("access-controls", "auth"), ("unique_user_id", "emergency_access", "automatic_logoff", "encryption")),
    ("HIPAA-AUDIT-1", ("audit-trail", "logging"), ("audit_logging", "access_monitoring", "log_review")),
    ("HIPAA-INTEGRITY-1", ("phi-handling",), ("data_validation", "error_checking", "authentication_mechanism")),
    ("HIPAA-TRANSMISSION-1", ("encryption-in-transit",), ("tls_required", "integrity_controls")),
    ("HIPAA-MINIMUM-1", ("minimum-necessary",), ("role_based_access", "data_segmentation", "field_level_encryption")),
    ("HIPAA-BREACH-1", ("breach-notification",), ("incident_response_plan", "notification_procedures", "risk_assessment")),
)
PCI = (
    ("PCI-1", ("network-segmentation",), ("firewall_rules", "network_diagram", "dmz")),
    ("PCI-2", ("security-policy",), ("hardening_standards", "no_default_passwords", "unnecessary_services_disabled")),
    ("PCI-3", ("cardholder-data", "encryption"), ("encryption_at_rest", "key_management", "data_retention_policy")),
    ("PCI-4", ("encryption",), ("tls_required", "certificate_management")),
    ("PCI-5", ("vulnerability-management",), ("antivirus", "malware_detection")),
    ("PCI-6", ("vulnerability-management", "security-testing"), ("patch_management", "secure_sdlc", "code_review")),
    ("PCI-7", ("access-control",), ("role_based_access", "least_privilege")),
    ("PCI-8", ("access-control",), ("unique_user_ids", "mfa", "password_policy")),
    ("PCI-9", ("cardholder-data",), ("physical_access_controls", "visitor_logs")),
    ("PCI-10", ("monitoring-logging",), ("audit_logging", "log_review", "time_synchronization")),
    ("PCI-11", ("security-testing",), ("vulnerability_scanning", "penetration_testing", "ids_ips")),
    ("PCI-12", ("security-policy",), ("security_policy", "risk_assessment", "security_awareness")),
)
# Decisions that each context level lets an agent see; other levels show all.
CONTEXT_ROWS = {"minimal": 5, "relevant": 10}


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in values]) if values else F.array().cast("array<string>")


def exception_status(exceptions: DataFrame, as_of: Column) -> DataFrame:
    """id, expires_at, expired, fully_approved, active, pending_review, errors for waivers.

    exceptions: id, contradiction_id, tier, reason, approvers, created_at, reviewed. A waiver is active while it has
    its approvals and has not run out, expiry itself being out. Only tiers with a mandatory review can await one.
    """
    tier = F.col("tier")
    hours = first_match([(tier == t, F.lit(h)) for t, (h, _, _) in TIERS.items() if h], F.lit(None).cast("int"))
    needed = first_match([(tier == t, F.lit(n)) for t, (_, n, _) in TIERS.items()], F.lit(0))
    reviewed_tier = tier.isin(*[t for t, (_, _, review) in TIERS.items() if review])
    expires = F.timestamp_micros(F.unix_micros("created_at") + hours.cast("long") * 3_600_000_000)
    expired = F.coalesce(expires <= as_of, F.lit(False))
    got = F.coalesce(F.size("approvers"), F.lit(0))
    errors = F.array_compact(
        F.array(
            F.when(F.coalesce("contradiction_id", F.lit("")) == "", "no contradiction_id"),
            F.when(F.coalesce("reason", F.lit("")) == "", "no reason"),
            F.when(got < needed, F.format_string("%s approvals of %s", got, needed)),
        )
    )
    approved = got >= needed
    return exceptions.select("id", expires.alias("expires_at"), expired.alias("expired"), approved.alias("fully_approved"), (approved & ~expired).alias("active"), (reviewed_tier & ~F.coalesce("reviewed", F.lit(False))).alias("pending_review"), errors.alias("errors"))


def context_cut(decisions: DataFrame, agents: DataFrame) -> DataFrame:
    """agent_id, id, rank: the decisions that each agent is shown.

    decisions: project, id, dimensions, created_at. agents: agent_id, project, context_level, allowed_dimensions,
    restricted_dimensions. With allowed dimensions, only decisions of those or the restricted ones count, or decisions
    without any. The newest come first, ties by id; the context level says how many are shown.
    """
    none = F.array().cast("array<string>")
    allowed = F.coalesce("allowed_dimensions", none)
    open_to = F.concat(allowed, F.coalesce("restricted_dimensions", none))
    has = F.coalesce("dimensions", none)
    fits = (F.size(allowed) == 0) | (F.size(has) == 0) | F.arrays_overlap(has, open_to)
    seen = decisions.select("project", "id", "dimensions", "created_at").join(agents, "project").filter(fits)
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("created_at"), "id")))
    most = first_match([(F.col("context_level") == level, F.lit(n)) for level, n in CONTEXT_ROWS.items()], F.lit(None).cast("int"))
    return ranked.filter(most.isNull() | (F.col("rank") <= most)).select("agent_id", "id", "rank")


def auto_resolve(pairs: DataFrame, as_of: Column, excluded: tuple[str, ...] = ("security", "auth"), least_confidence: float = 0.85, most_blast: int = 3, override_hours: int = 48) -> DataFrame:
    """id, eligible, rejection, winner, loser, deadline: the first rule that rejects a pair, else the more confident, then newer, decision.

    Until the deadline, override_hours after as_of, people may decide otherwise.

    pairs: id, verdict, shared_dimensions, confidence, blast, a_id, b_id, a_confidence, b_confidence, a_at, b_at,
    a_dependents, b_dependents.
    """
    a_wins = (F.col("a_confidence") > F.col("b_confidence")) | ((F.col("a_confidence") == F.col("b_confidence")) & (F.col("a_at") >= F.col("b_at")))
    loser_dependents = F.when(a_wins, F.col("b_dependents")).otherwise(F.col("a_dependents"))
    rejection = first_match(
        [
            (F.col("verdict") != "tension", "verdict"),
            (F.arrays_overlap("shared_dimensions", F.array(*[F.lit(x) for x in excluded])), "excluded_dimension"),
            (F.col("confidence") < least_confidence, "confidence"),
            (F.col("blast") > most_blast, "blast_radius"),
            (loser_dependents > 0, "dependents"),
        ],
        F.lit(None).cast("string"),
    )
    out = pairs.select("id", rejection.alias("rejection"), F.when(a_wins, F.col("a_id")).otherwise(F.col("b_id")).alias("w"), F.when(a_wins, F.col("b_id")).otherwise(F.col("a_id")).alias("l"))
    free = F.col("rejection").isNull()
    deadline = F.timestamp_micros(F.unix_micros(as_of) + override_hours * 3_600_000_000)
    return out.select("id", free.alias("eligible"), "rejection", F.when(free, F.col("w")).alias("winner"), F.when(free, F.col("l")).alias("loser"), F.when(free, deadline).alias("deadline"))


def negotiate(contradictions: DataFrame, critical: tuple[str, ...] = CRITICAL_DIMENSIONS) -> DataFrame:
    """id, outcome, winner: contradictions and critical dimensions escalate, other tensions resolve, the rest is deferred.

    A resolved tension goes to the more confident decision, of equal ones to the newer, of those to a.
    """
    hit = F.arrays_overlap("shared_dimensions", _texts(critical))
    outcome = first_match([((F.col("verdict") == "contradiction") | hit, "escalated"), (F.col("verdict") == "tension", "auto_resolved")], "deferred")
    a_wins = (F.col("a_confidence") > F.col("b_confidence")) | ((F.col("a_confidence") == F.col("b_confidence")) & (F.col("a_at") >= F.col("b_at")))
    return contradictions.select("id", outcome.alias("outcome"), F.when(outcome == "auto_resolved", F.when(a_wins, F.col("a_id")).otherwise(F.col("b_id"))).alias("winner"))


def check_capability(requests: DataFrame, identities: DataFrame) -> DataFrame:
    """request_id, allowed, reason: the capabilities of an identity's trust level and its own extra ones."""
    by_level = first_match([(F.col("trust") == level, _texts(names)) for level, names in TRUST.items()], F.array().cast("array<string>"))
    capabilities = F.array_union(by_level, F.coalesce("extra", F.array().cast("array<string>")))
    j = requests.join(identities.select("agent_id", "trust", "extra"), "agent_id", "left")
    known, ok = F.col("trust").isNotNull(), F.array_contains(capabilities, F.col("capability"))
    return j.select("request_id", (known & ok).alias("allowed"), first_match([(~known, "unknown identity"), (ok, "granted")], "not granted").alias("reason"))


def check_permission(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """request_id, allowed, reason: missing, inactive or not granted."""
    j = requests.join(agents.select("agent_id", "active", "permissions"), "agent_id", "left")
    reason = first_match([(F.col("active").isNull(), "missing"), (~F.col("active"), "inactive"), (~F.array_contains("permissions", F.col("permission")), "not granted")], "granted")
    return j.select("request_id", (reason == "granted").alias("allowed"), reason.alias("reason"))


def check_tokens(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """request_id, valid, reason for uses of capability tokens at a time (request_id, token, permission, at)."""
    j = requests.join(tokens.select("token", "permissions", "expires_at", "revoked"), "token", "left")
    reason = first_match(
        [(F.col("revoked").isNull(), "unknown"), (F.col("revoked"), "revoked"), (F.col("expires_at") <= F.col("at"), "expired"), (~F.array_contains("permissions", F.col("permission")), "not granted")],
        "valid",
    )
    return j.select("request_id", (reason == "valid").alias("valid"), reason.alias("reason"))


def find_agents(agents: DataFrame, agent_type: str | None = None, organization: str | None = None, capability: str | None = None) -> DataFrame:
    """agents (agent_id, agent_type, organization, trust, extra) of a type, an organisation and with a capability, as far as given.

    An agent has the capabilities of its trust level and those granted beside.
    """
    found = agents
    if agent_type is not None:
        found = found.filter(F.col("agent_type") == agent_type)
    if organization is not None:
        found = found.filter(F.col("organization") == organization)
    if capability is not None:
        levels = [level for level, has in TRUST.items() if capability in has]
        found = found.filter(F.col("trust").isin(*levels) | F.coalesce(F.array_contains("extra", capability), F.lit(False)))
    return found


def check_federation(requests: DataFrame, tokens: DataFrame, members: DataFrame) -> DataFrame:
    """request_id, valid, reason for uses of federation tokens at a time (request_id, token, at): unknown, expired, or of an
    organisation that is no member or no active one. tokens: token, org_id, expires_at. members: org_id, active."""
    j = requests.join(tokens.select("token", "org_id", "expires_at"), "token", "left").join(members.select("org_id", "active"), "org_id", "left")
    reason = first_match([(F.col("expires_at").isNull(), "unknown"), (F.col("expires_at") <= F.col("at"), "expired"), (~F.coalesce("active", F.lit(False)), "inactive organisation")], "valid")
    return j.select("request_id", (reason == "valid").alias("valid"), reason.alias("reason"))


def approval_status(requests: DataFrame, approvals: DataFrame) -> DataFrame:
    """request_id, pending_roles, dissent, approved: every required role has answered; dissent is told apart.

    approvals: request_id, role, dissenting. Any answer counts as its role's, a dissenting one too.
    """
    got = approvals.groupBy("request_id").agg(F.collect_set("role").alias("roles"), F.bool_or("dissenting").alias("dissent"))
    j = requests.join(got, "request_id", "left")
    pending = F.array_except("required_roles", F.coalesce("roles", F.array().cast("array<string>")))
    return j.select("request_id", pending.alias("pending_roles"), F.coalesce("dissent", F.lit(False)).alias("dissent"), (F.size(pending) == 0).alias("approved"))


def resolution_paths(contradictions: DataFrame) -> DataFrame:
    """id, action, impact, rank: what can be done about each contradiction, in the order of offer."""
    table = F.create_map(*[x for k, ways in RESOLUTIONS.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("action"), F.lit(i).alias("impact")) for a, i in ways]))])
    offered = contradictions.select("id", F.posexplode(F.element_at(table, F.col("verdict"))).alias("n", "way"))
    return offered.select("id", "way.action", "way.impact", (F.col("n") + 1).alias("rank"))


# What the note of each action says before the rationale; {side} is the decision that stays.
NOTES = {
    "pick_a": "Winner: {side}. ",
    "pick_b": "Winner: {side}. ",
    "accept_exception": "Accepted as exception. ",
    "defer": "Deferred. ",
    "dismiss": "Dismissed as false positive. ",
    "update_decision": "Pending reconciliation. ",
}


def apply_resolutions(contradictions: DataFrame, decisions: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contradictions and decisions after actions (id, action, actor, rationale, at).

    Contradictions get resolved_by, resolution_note and resolved_at, the time only where they are settled. Picking a
    side supersedes the other decision, which loses its validity. Actions of other names change nothing.
    """
    said = actions.select("id", "action", "actor", "rationale", "at")
    c = contradictions.join(said, "id", "left")
    known = F.col("action").isin(*STATUS_AFTER)
    status = first_match([(F.col("action") == a, F.lit(after)) for a, after in STATUS_AFTER.items()], F.col("status"))
    lost = c.filter(F.col("action").isin("pick_a", "pick_b")).select(F.when(F.col("action") == "pick_a", F.col("b_id")).otherwise(F.col("a_id")).alias("id")).distinct()
    marked = decisions.join(lost.withColumn("_lost", F.lit(True)), "id", "left")
    kept = marked.withColumn("valid", F.col("valid") & F.col("_lost").isNull()).withColumn("status", F.when(F.col("_lost"), "superseded").otherwise(F.col("status"))).drop("_lost")
    side = F.when(F.col("action") == "pick_a", F.col("a_id")).otherwise(F.col("b_id")).cast("string")
    note = first_match([(F.col("action") == a, F.replace(F.lit(text), F.lit("{side}"), side)) for a, text in NOTES.items()], F.lit(None).cast("string"))
    settled = status.isin("resolved", "ignored")
    after = c.select(
        *[F.col(x) if x != "status" else status.alias("status") for x in contradictions.columns if x not in ("resolved_by", "resolution_note", "resolved_at")],
        F.when(known, F.col("actor")).alias("resolved_by"),
        F.concat(note, F.coalesce("rationale", F.lit(""))).alias("resolution_note"),
        F.when(known & settled, F.col("at")).alias("resolved_at"),
    )
    return after, kept


def rule_stats(events: DataFrame, by: str = "rule", stored: DataFrame | None = None) -> DataFrame:
    """rule, triggered, validated, rejected, roi, mode: a rule whose resolved hits are rejected over 90 % is a shadow.

    It takes 20 triggers to be one. A rule that is a shadow in stored (rule, mode), if given, stays one, whatever its
    counts; one of stored without events has counts of 0. roi = validated / (0.1 triggered).
    """

    def n(kind: str) -> Column:
        return F.count(F.when(F.col("event") == kind, 1)).alias(kind)

    s = events.groupBy(by).agg(n("triggered"), n("validated"), n("rejected")).withColumn("stored", F.lit("active"))
    if stored is not None:
        kept = stored.select(by, F.col("mode").alias("stored"))
        s = s.drop("stored").join(kept, by, "full_outer").select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("triggered", "validated", "rejected")], "stored")
    ratio = F.try_divide(F.col("rejected"), F.col("rejected") + F.col("validated"))
    shadow = ((F.col("triggered") >= 20) & F.coalesce(ratio > 0.9, F.lit(False))) | F.coalesce(F.col("stored") == "shadow", F.lit(False))
    return s.select(by, "triggered", "validated", "rejected", F.round(F.coalesce(F.try_divide(F.col("validated"), F.col("triggered") * 0.1), F.lit(0.0)), 6).alias("roi"), F.when(shadow, "shadow").otherwise("active").alias("mode"))


def assumption_stats(assumptions: DataFrame) -> DataFrame:
    """category, pattern_id (null: all of a category), outcome counts and value ratio, in one pass of grouping sets."""

    def n(kind: str) -> Column:
        return F.count(F.when(F.col("status") == kind, 1)).alias(kind)

    counted = assumptions.groupingSets([["category"], ["category", "pattern_id"]], "category", "pattern_id").agg(F.count("*").alias("total"), n("validated"), n("rejected"), n("deferred"))
    return counted.withColumn("value_ratio", F.round(F.coalesce(F.try_divide(F.col("validated"), F.col("validated") + F.col("rejected")), F.lit(0.0)), 6))


def assumption_metrics(assumptions: DataFrame, by: str = "project") -> DataFrame:
    """by, total, resolved, first_value_seconds: from the first detection to the first validation; and what each tier gives.

    architectural, implementation, validated_architectural, validated_implementation count assumptions by tier (of another tier or none:
    implementation). value_ratio: validated architectural ones for each validated implementation one; infinite
    without the latter, 0 without either.
    """
    first = F.min(F.when(F.col("status") == "validated", F.col("resolved_at")))
    high, done = F.coalesce(F.col("tier") == "architectural", F.lit(False)), F.col("status") == "validated"
    tiers = {"architectural": high, "implementation": ~high, "validated_architectural": high & done, "validated_implementation": ~high & done}
    out = assumptions.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col("status").isin("validated", "rejected"), 1)).alias("resolved"),
        F.min("detected_at").alias("start"),
        first.alias("hit"),
        *[F.count_if(c).alias(n) for n, c in tiers.items()],
    )
    a, b = F.col("validated_architectural"), F.col("validated_implementation")
    ratio = F.when(b > 0, F.round(a / b, 6)).when(a > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.select(by, "total", "resolved", F.round((F.unix_micros("hit") - F.unix_micros("start")) / F.lit(1e6), 6).alias("first_value_seconds"), *tiers, ratio.alias("value_ratio"))


def cluster(findings: DataFrame, per_file: int = 10) -> DataFrame:
    """cluster, n, representative, severity, avg_confidence: a file with more than per_file findings, else its directory.

    findings: id, project, pattern_id, file, severity_rank, confidence, ts. The representative is the gravest, then
    surest, then earliest finding.
    """
    in_file = F.count("*").over(Window.partitionBy("project", "pattern_id", "file"))
    directory = F.regexp_replace("file", r"/?[^/]*$", "")
    keyed = findings.withColumn("cluster", F.concat_ws("::", F.col("project").cast("string"), "pattern_id", F.when(in_file > per_file, F.col("file")).otherwise(directory)))
    best = F.max_by("id", F.struct("severity_rank", "confidence", -F.unix_micros("ts"), -F.col("id")))
    return keyed.groupBy("cluster").agg(F.count("*").alias("n"), best.alias("representative"), F.max("severity_rank").alias("severity"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def module_in_degree(imports: DataFrame) -> DataFrame:
    """module, in_degree: how many files import it (path, module)."""
    return imports.groupBy("module").agg(F.countDistinct("path").alias("in_degree"))


def churn(commits: DataFrame) -> DataFrame:
    """path, commits, factor = 1 + n / the busiest file's n."""
    per = commits.groupBy("path").agg(F.count("*").alias("commits"))
    most = per.agg(F.max("commits").alias("most"))
    return per.crossJoin(most).select("path", "commits", F.round(1 + F.col("commits") / F.col("most"), 6).alias("factor"))


def with_ancestors(modules: DataFrame) -> DataFrame:
    """module, in_degree: the greatest in-degree of each module or of any below it (a.b has that of a.b.c)."""
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return modules.select(F.explode(prefixes).alias("module"), "in_degree").groupBy("module").agg(F.max("in_degree").alias("in_degree"))


def assumption_priority(findings: DataFrame, modules: DataFrame, churned: DataFrame) -> DataFrame:
    """id, centrality, priority = severity x centrality x churn.

    findings: id, severity_rank, module, file, a row for each piece of evidence. Centrality is 1 + the best in-degree
    of an evidence's module over the greatest of all; a package has that of the modules below it. Churn is the best
    factor of an evidence's file, 1 at least.
    """
    credit = with_ancestors(modules).select(F.col("module").alias("m"), "in_degree")
    most = modules.agg(F.max("in_degree").alias("most"))
    j = findings.join(credit, F.col("module") == F.col("m"), "left").join(churned.select(F.col("path").alias("p"), "factor"), F.col("file") == F.col("p"), "left")
    best = j.groupBy("id").agg(F.max("severity_rank").alias("severity"), F.coalesce(F.max("in_degree"), F.lit(0)).alias("degree"), F.greatest(F.coalesce(F.max("factor"), F.lit(1.0)), F.lit(1.0)).alias("churn"))
    centrality = 1 + F.coalesce(F.try_divide(F.col("degree"), F.col("most")), F.lit(0.0))
    return best.crossJoin(most).select("id", F.round(centrality, 6).alias("centrality"), F.round(F.col("severity") * centrality * F.col("churn"), 6).alias("priority"))


def missing_patterns(sets: DataFrame, itemsets: DataFrame, least: float = 0.5) -> DataFrame:
    """key, itemset, present, missing, confidence: frequent itemsets of which a set holds the share least or more, but not all.

    sets: key, items. itemsets (itemset: array) is a mined table of bounded size, which goes to all tasks. Sets meet itemsets
    through the items they share, so nothing is compared that has no item in common, and whole sets are shuffled, not what they share. Of
    the itemsets found for a key only those stay that lie in no larger one: what a smaller one shows, the larger one shows too.
    """
    exploded = itemsets.select("itemset", F.size("itemset").alias("k"), F.explode("itemset").alias("item"))
    have = sets.select("key", "items").repartition("key").select("key", F.explode(F.array_distinct("items")).alias("item"))
    met = have.join(F.broadcast(exploded), "item").groupBy("key", "itemset", "k")
    near = met.agg(F.sort_array(F.collect_set("item")).alias("present")).withColumn("n", F.size("present"))
    near = near.filter((F.col("n") < F.col("k")) & (F.col("n") / F.col("k") >= least))
    found = near.groupBy("key").agg(F.collect_list(F.struct("itemset", "k", "n", "present")).alias("all"))  # as many as there are itemsets at most

    def largest(x: Column) -> Column:
        return ~F.exists("all", lambda y: (y["k"] > x["k"]) & (F.size(F.array_except(x["itemset"], y["itemset"])) == 0))

    each = found.select("key", F.explode(F.filter("all", largest)).alias("x"))
    lists = [F.array_join(c, ",").alias(n) for n, c in (("itemset", F.col("x.itemset")), ("present", F.col("x.present")), ("missing", F.array_except("x.itemset", "x.present")))]
    return each.select("key", *lists, F.round(F.col("x.n") / F.col("x.k"), 2).alias("confidence"))


def provenance_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def secret_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pattern_name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def consistency_score(counts: DataFrame) -> DataFrame:
    """grp, score = max(0, 1 - violations / endpoints); 1 without endpoints."""
    return counts.select("grp", F.round(F.when(F.col("endpoints") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("violations") / F.greatest("endpoints", F.lit(1)))), 6).alias("score"))


def requirement_table(spark: SparkSession, rows: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]) -> DataFrame:
    """One framework as the table that requirements_met takes."""
    return spark.createDataFrame([(name, list(dims), list(controls)) for name, dims, controls in rows], "requirement string, wanted_dimensions array<string>, controls array<string>")


def requirements_met(configs: DataFrame, requirements: DataFrame) -> DataFrame:
    """org, requirement, met: a requirement is met by one of its dimensions or by a mention of one of its controls.

    configs: org, dimensions, controls_text. requirements is a reference table of a dozen rows.
    """
    j = configs.crossJoin(requirements)
    by_dimension = F.arrays_overlap(j["dimensions"], j["wanted_dimensions"])
    by_control = F.exists("controls", lambda c: F.col("controls_text").contains(c))
    return j.select("org", "requirement", (F.coalesce(by_dimension, F.lit(False)) | F.coalesce(by_control, F.lit(False))).alias("met"))


def compliance_scores(requirements: DataFrame, detections: DataFrame, weight: float, most_penalty: float = 0.5) -> DataFrame:
    """org, met, total, coverage, risk, ready of each organisation (org, requirement, status: met, partial or unmet).

    coverage counts partial ones as half; ready from 80 %. risk is the unmet share plus weight for each detection of
    protected data (org, n), most_penalty at most, 1 in all. Fixed values: weight is 0.1 for health and 0.15 for card
    data.
    """
    hits = detections.groupBy("org").agg(F.sum("n").alias("n"))
    counted = requirements.groupBy("org").agg(*[F.count_if(F.col("status") == k).alias(k) for k in ("met", "partial", "unmet")], F.count("*").alias("total"))
    out = counted.join(hits, "org", "left")
    coverage = (F.col("met") + 0.5 * F.col("partial")) / F.col("total")
    risk = F.col("unmet") / F.col("total") + F.least(F.coalesce("n", F.lit(0)) * F.lit(weight), F.lit(most_penalty))
    return out.select("org", "met", "total", F.round(coverage, 6).alias("coverage"), F.round(F.least(F.lit(1.0), risk), 6).alias("risk"), (coverage >= 0.8).alias("ready"))


def framework_status(flags: DataFrame, keys: list[str]) -> DataFrame:
    return missing_share(flags, keys)


def review_status(changes: DataFrame, most_new: int = 3) -> DataFrame:
    """pr, verdict: violations if a change contradicts or adds more than most_new dependencies."""
    agg = changes.groupBy("pr").agg(F.sum("contradictions").alias("contradictions"), F.sum("new_dependencies").alias("new_dependencies"))
    bad = (F.col("contradictions") > 0) | (F.col("new_dependencies") > most_new)
    return agg.withColumn("verdict", F.when(bad, "violations").otherwise("ok"))


def evidence_matrix(features: DataFrame, mapping: DataFrame, criteria: DataFrame) -> DataFrame:
    """org, criterion, evidence: how many of an org's features serve each criterion; criteria without any count 0."""
    hit = features.join(mapping, "feature").groupBy("org", "criterion").agg(F.countDistinct("feature").alias("evidence"))
    whole = features.select("org").distinct().crossJoin(criteria)
    return whole.join(hit, ["org", "criterion"], "left").select("org", "criterion", F.coalesce("evidence", F.lit(0)).alias("evidence"))


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of incoming whose key existing does not have."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti")

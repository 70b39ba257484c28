"""Queries of the audit trail, the timeline of observations, listings, policies, contracts and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.functions import text
from ledgerwing.operators import aggregates as agg
from ledgerwing.operators import listings, timeline
from ledgerwing.operators import sequences as seq
from ledgerwing.plans import decision_queries  # noqa: F401  registers the fingerprint that the hash is of
from ledgerwing.plans import views as v
from ledgerwing.plans.catalog import ORACLES, query
from ledgerwing.plans.governance_queries import ASSUMED, _assumptions
from ledgerwing.session import table

SEVERITIES = ("low", "medium", "high", "critical")
HOOKS = ("Edit", "Write", "")
RESULTS = ("pass", "block", "odd")

TRAIL = f"""{ASSUMED},
tr AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS agent, event_id % 3 AS k, event_type, {v._case(HOOKS, 'user_id % 3')} AS action, {v._case(RESULTS, 'event_id // 3 % 3')} AS result FROM events),
trail AS (
  SELECT 'c:' || id AS entry_id, created_at AS ts, 'decision_added' AS event_type, 'Decision Created' AS label, title AS description, source_type AS actor, 'info' AS result, 'decisions' AS source FROM decision
  UNION ALL SELECT 's:' || id, created_at, 'decision_superseded', 'Decision Superseded', title || ' [' || status || ']', 'system', 'info', 'decisions' FROM decision WHERE NOT valid OR status = 'superseded'
  UNION ALL SELECT 'd:' || id, detected_at, 'contradiction_detected', 'Contradiction Detected', verdict || ': ' || a_id || ' vs ' || b_id, 'system', 'warning', 'contradictions' FROM contra
  UNION ALL SELECT 'r:' || id, detected_at, 'contradiction_resolved', 'Contradiction Resolved', a_id || ' vs ' || b_id, 'dashboard', 'pass', 'contradictions' FROM contra WHERE status = 'resolved'
  UNION ALL SELECT 'a:' || id, ts, 'assumption_detected', 'Assumption Found', '[' || upper({v._case(SEVERITIES, 'severity_rank')}) || '] ' || file, 'scanner', CASE WHEN severity_rank >= 2 THEN 'warning' ELSE 'info' END, 'assumptions' FROM assumed
  UNION ALL SELECT 'o:' || id, ts + INTERVAL 1 HOUR, 'assumption_' || status, CASE status WHEN 'validated' THEN 'Assumption Validated' ELSE 'Assumption Rejected' END, file, 'lead', CASE status WHEN 'validated' THEN 'pass' ELSE 'fail' END, 'assumptions' FROM assumed WHERE status IN ('validated', 'rejected')
  UNION ALL SELECT 'n:' || project, min(ts), 'assumption_scan', 'Assumptions Scanned', count(*) || ' assumption(s) detected', 'scanner', 'info', 'assumptions' FROM assumed GROUP BY project
  UNION ALL SELECT 't:' || id, ts, CASE k WHEN 0 THEN CASE action WHEN '' THEN 'hook' ELSE 'hook_' || lower(action) END WHEN 1 THEN 'llm_call' ELSE event_type END, CASE k WHEN 0 THEN 'Hook: ' || action WHEN 1 THEN 'LLM Call' ELSE event_type END,
    CASE k WHEN 0 THEN 'f.py: why' WHEN 1 THEN 'm1: ' || event_type ELSE '' END, agent, CASE WHEN k = 0 AND result = 'pass' THEN 'pass' WHEN k = 0 AND result = 'block' THEN 'fail' ELSE 'info' END, 'traces' FROM tr
  UNION ALL SELECT 'l:' || conv_id || '-' || turn, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * turn, CASE turn WHEN 0 THEN 'session_started' ELSE 'turn' END, CASE turn WHEN 0 THEN 'session_started' ELSE 'turn' END, 'Turn ' || turn, role, 'info', 'audit_log' FROM conversations
)"""


def _trail(spark: SparkSession, d: str) -> DataFrame:
    """The five kinds of records: decisions, contradictions, assumptions, events as traces, turns as the sealed log."""
    found = _assumptions(spark, d)
    assumptions = found.select("id", "project", "status", "detected_at", "resolved_at", F.col("file").alias("summary"), v.pick(SEVERITIES, F.col("severity_rank")).alias("severity"), F.lit("lead").alias("resolved_by"))
    k = F.col("event_id") % 3
    traces = table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(k == 0, "hook").when(k == 1, "llm_call").otherwise(F.col("event_type")).alias("type"),
        v.pick(HOOKS, F.col("user_id") % 3).alias("action"),
        v.pick(RESULTS, F.floor(F.col("event_id") / 3) % 3).alias("result"),
        F.col("user_id").cast("string").alias("agent"),
        F.lit("src/f.py").alias("file"),
        F.lit("why").alias("reason"),
        F.lit("m1").alias("model"),
        F.col("event_type").alias("prompt_preview"),
    )
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("turn") * 1_000_000)
    kind = F.when(F.col("turn") == 0, "session_started").otherwise("turn")
    log = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), at.alias("ts"), kind.alias("event_type"), F.col("role").alias("actor"), F.concat(F.lit("Turn "), "turn").alias("description"))
    contradictions = v.contradictions(spark, d).withColumn("resolved_by", F.lit(None).cast("string"))
    return timeline.audit_trail(v.decisions(spark, d), contradictions, assumptions, traces, log)


@query(f"WITH {TRAIL} SELECT * FROM trail")
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    return _trail(spark, d)


@query(f"WITH {TRAIL} SELECT source, event_type, count(*) AS n FROM trail GROUP BY ALL")
def audit_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return timeline.source_counts(_trail(spark, d))


@query(f"WITH {TRAIL} SELECT * FROM trail WHERE actor <> 'system'")
def agent_timeline(spark: SparkSession, d: str) -> DataFrame:
    return timeline.agent_timeline(_trail(spark, d))


@query(f"WITH {TRAIL} SELECT entry_id, label, result FROM trail")
def audit_labels(spark: SparkSession, d: str) -> DataFrame:
    return timeline.audit_labels(_trail(spark, d))


@query(f"WITH {TRAIL} SELECT *, (SELECT count(*) FROM trail) AS total FROM trail ORDER BY ts DESC, entry_id DESC LIMIT 100 OFFSET 50")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    return seq.page(_trail(spark, d), 100, 50, "ts", "entry_id")


COMMANDS = ("ls -l", "git push --force")
OPERATIONS = ("commit", "force_push", "rebase")


@query(f"""
WITH e AS (SELECT event_id AS id, user_id, event_id % 5 AS k, ts, value FROM events)
SELECT CASE k WHEN 0 THEN 'llm_call:' WHEN 1 THEN 'tool_call:' WHEN 2 THEN 'shell:' WHEN 3 THEN 'vcs:' ELSE 'file_read:' END || id AS entry_id, ts, CAST(user_id AS VARCHAR) AS agent_id,
  CASE k WHEN 0 THEN 'llm_call' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'shell' WHEN 3 THEN 'vcs' ELSE 'file_read' END AS kind,
  CASE k WHEN 0 THEN 'LLM call: m (p), ' || user_id || '+7 tokens' WHEN 1 THEN 'Tool: t' || user_id % 9 WHEN 2 THEN 'Shell: ' || {v._case(COMMANDS, 'id // 5 % 2')} WHEN 3 THEN 'Git: ' || {v._case(OPERATIONS, 'id // 5 % 3')} || ' main' ELSE 'Read a.py (' || user_id || ' lines)' END AS summary,
  CASE k WHEN 1 THEN CASE WHEN user_id % 4 = 0 THEN 'warning' ELSE 'info' END WHEN 2 THEN CASE WHEN id // 5 % 2 = 1 THEN 'critical' WHEN user_id % 3 > 0 THEN 'warning' ELSE 'info' END
    WHEN 3 THEN CASE id // 5 % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'critical' ELSE 'warning' END ELSE 'info' END AS severity FROM e
""")
def observation_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Events as the five kinds of observations, in the observers' own schemas."""
    k, user = F.floor(F.col("event_id") / 5), F.col("user_id")
    e = table(spark, d, "events").withColumn("timestamp", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double")).withColumn("agent_id", user.cast("string"))

    def part(n: int, key: str, **columns) -> DataFrame:
        return e.filter(F.col("event_id") % 5 == n).select(F.col("event_id").alias(key), "timestamp", "agent_id", *[c.alias(name) for name, c in columns.items()])

    entries = timeline.observation_entries(
        part(0, "span_id", model=F.lit("m"), provider=F.lit("p"), tokens_in=user, tokens_out=F.lit(7)),
        part(1, "call_id", tool_name=F.concat(F.lit("t"), user % 9), success=user % 4 != 0),
        part(2, "execution_id", command=v.pick(COMMANDS, k % 2), exit_code=user % 3),
        part(3, "operation_id", operation=v.pick(OPERATIONS, k % 3), branch=F.lit("main")),
        part(4, "read_id", path=F.lit("a.py"), lines=user),
        lambda command, code: text.dangerous_commands(command, code)["severity"],
    )
    return timeline.activity_timeline(entries)


@query("""
WITH f AS (SELECT d.id, d.project, d.title, d.status, d.created_at FROM decision d WHERE status = 'active' AND d.id IN (SELECT id FROM bridge WHERE dimension = 'auth'))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 20
""")
def list_decisions(spark: SparkSession, d: str) -> DataFrame:
    return listings.list_decisions(v.decisions(spark, d), v.bridge(spark, d), dimension="auth", status="active", limit=100, offset=20)


@query("SELECT id, project, verdict, status, detected_at, count(*) OVER () AS total FROM contra WHERE status = 'unresolved' ORDER BY detected_at DESC, id DESC LIMIT 100")
def list_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return listings.list_contradictions(v.contradictions(spark, d))


@query(f"WITH {ASSUMED}, f AS (SELECT id, category, status, ts AS detected_at FROM assumed WHERE status = 'validated' AND category = 'click') SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY detected_at DESC, id DESC LIMIT 50 OFFSET 10")
def list_assumptions(spark: SparkSession, d: str) -> DataFrame:
    return listings.list_assumptions(_assumptions(spark, d), status="validated", category="click", limit=50, offset=10)


@query(f"""WITH {ASSUMED} SELECT 'status' AS facet, status AS value, count(*) AS n FROM assumed GROUP BY status UNION ALL SELECT 'category', category, count(*) FROM assumed GROUP BY category
UNION ALL SELECT 'actionable', 'actionable', count(*) FILTER (status IN ('detected', 'proposed')) FROM assumed""")
def assumption_facets(spark: SparkSession, d: str) -> DataFrame:
    return listings.assumption_facets(_assumptions(spark, d).withColumn("is_baseline", F.lit(False)))


@query("""
WITH g AS (SELECT id, list_sort(list(DISTINCT dimension)) AS dimensions FROM bridge GROUP BY id)
SELECT d.id AS policy_id, title AS name, repeat(title, 20)[1:200] AS description, coalesce(dimensions, []) AS dimensions, CASE decision_type WHEN 'constraint' THEN 'critical' WHEN 'architectural' THEN 'high' WHEN 'technical' THEN 'medium' WHEN 'product' THEN 'low' END AS severity,
  source_type, confidence, decision_type FROM decision d LEFT JOIN g USING (id) WHERE valid
""")
def to_policies(spark: SparkSession, d: str) -> DataFrame:
    return listings.to_policies(v.decisions(spark, d).withColumn("content", F.repeat("title", 20)), v.bridge(spark, d))


@query("""
WITH e AS (SELECT *, CASE WHEN agent_id % 2 = 0 THEN 'coding' ELSE 'review' END AS kind, target IN ('k1', 'k2', 'k3') AS known FROM event),
s AS (SELECT agent_id, kind, bool_or(action = 'signup') AS context, bool_or(action = 'click') AS edits, bool_or(action = 'purchase') AS decided, bool_or(action = 'signup' AND known) AS scoped,
  bool_or(action = 'click' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.agent_id = e.agent_id AND x.action = 'signup' AND x.known AND x.target = e.target)) AS outside, 1.0 - exp(-3.0 * avg((action IN ('view', 'error'))::INT)) AS drift FROM e GROUP BY agent_id, kind),
c AS (SELECT agent_id, drift, unnest(list_filter([
  CASE WHEN NOT context THEN {'c': 'loaded_context', 't': 'precondition', 's': 'error'} END,
  CASE WHEN context AND kind = 'coding' AND edits AND NOT decided THEN {'c': 'decisions_recorded', 't': 'postcondition', 's': 'warning'} END,
  CASE WHEN kind = 'coding' AND scoped AND outside THEN {'c': 'scope_respected', 't': 'invariant', 's': 'error'} END,
  CASE WHEN drift >= 0.7 THEN {'c': 'drift_limit', 't': 'drift', 's': 'hard_stop'} WHEN drift >= 0.3 THEN {'c': 'drift_warning', 't': 'drift', 's': 'warning'} END], lambda x: x IS NOT NULL)) AS f FROM s)
SELECT agent_id, f.c AS clause, f.t AS clause_type, f.s AS severity, round(drift, 6) AS drift FROM c
""")
def contract_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Events under the default contracts of two agent types: signups load a scope, clicks edit, purchases decide."""
    names = {"signup": "load_context", "click": "file_edit", "purchase": "decision"}
    action = F.coalesce(*[F.when(F.col("action") == a, b) for a, b in names.items()], F.col("action"))
    scope = F.when((F.col("action") == "signup") & F.col("target").isin("k1", "k2", "k3"), F.array("target"))
    kind = F.when(F.col("agent_id") % 2 == 0, "coding").otherwise("review")
    e = v.events(spark, d).select("agent_id", kind.alias("agent_type"), action.alias("action"), "target", scope.alias("scope"))
    expected = {k: ("load_context", "file_edit", "decision") for k in ("coding", "review")}
    return seq.contract_breaches(e, expected=expected)


@query("""
WITH o AS (SELECT org_id, decision_type, confidence, coalesce((SELECT min(dimension) FROM bridge b WHERE b.id = org.id), 'general') AS first FROM org),
n AS (SELECT count(DISTINCT org_id) AS orgs FROM o),
p AS (SELECT decision_type AS pattern, first AS dimension, count(*) AS occurrences, count(DISTINCT org_id) / (SELECT orgs FROM n)::DOUBLE AS adoption, avg(confidence) AS conf FROM o GROUP BY ALL ORDER BY occurrences DESC, pattern, dimension LIMIT 20),
rp AS (SELECT *, row_number() OVER (ORDER BY occurrences DESC, pattern, dimension) AS k FROM p),
u AS (SELECT DISTINCT org.org_id, dimension FROM org JOIN bridge b ON b.id = org.id),
cd AS (SELECT x.dimension, count(*) FILTER (verdict = 'contradiction') AS c FROM (SELECT verdict, unnest(shared_dimensions) AS dimension FROM contra) x GROUP BY ALL),
dd AS (SELECT dimension, count(*) AS n FROM bridge GROUP BY dimension),
mine AS (SELECT unnest(['auth', 'caching', 'general']) AS dimension)
SELECT 'adoption_gap' AS kind, 'warning' AS severity, dimension, pattern, round(adoption, 6) AS metric FROM rp WHERE round(adoption, 6) >= 0.7 AND dimension NOT IN (SELECT dimension FROM mine)
UNION ALL SELECT 'contradiction_hotspot', 'critical', dd.dimension, NULL, round(coalesce(c, 0) / n::DOUBLE, 6) FROM dd LEFT JOIN cd USING (dimension) WHERE round(coalesce(c, 0) / n::DOUBLE, 6) >= 0.3
UNION ALL SELECT 'trending', 'info', dimension, pattern, round(adoption, 6) FROM rp WHERE k <= 5 AND round(adoption, 6) >= 0.7 AND round(conf, 6) >= 0.4
UNION ALL SELECT 'recommendation', 'info', dimension, NULL, NULL FROM u WHERE dimension NOT IN (SELECT dimension FROM mine) GROUP BY dimension HAVING count(*) >= 0.5 * (SELECT orgs FROM n)
""")
def insight_kinds(spark: SparkSession, d: str) -> DataFrame:
    """All four kinds for an organisation of three dimensions; the driver's confidences are even, so 0.4 is a high one."""
    first = v.bridge(spark, d).groupBy("id").agg(F.min("dimension").alias("f"))
    orgs = v.organisations(spark, d)
    patterns = agg.top_patterns(orgs.join(first, "id", "left").withColumn("first_dimension", F.coalesce("f", F.lit("general"))))
    used = orgs.join(v.bridge(spark, d).select("id", "dimension"), "id").groupBy("dimension").agg(F.countDistinct("org_id").alias("orgs_using"))
    per = v.contradictions(spark, d).select("verdict", F.explode("shared_dimensions").alias("dimension")).groupBy("dimension").agg(F.count_if(F.col("verdict") == "contradiction").alias("c"))
    n = v.bridge(spark, d).groupBy("dimension").agg(F.count("*").alias("n"))
    rates = used.join(n, "dimension").join(per, "dimension", "left").select("dimension", "orgs_using", F.round(F.coalesce("c", F.lit(0)) / F.col("n"), 6).alias("contradiction_rate"))
    return agg.insight_kinds(patterns, rates, orgs.agg(F.countDistinct("org_id").alias("orgs")), ["auth", "caching", "general"], sure=0.4)


FINGERPRINTS = ORACLES["fingerprint"]


@query(f"SELECT project, sha256(array_to_string(list_transform(vector, lambda x: printf('%.6f', x)), ','))[1:16] AS hash FROM ({FINGERPRINTS})")
def fingerprint_hash(spark: SparkSession, d: str) -> DataFrame:
    return agg.fingerprint_hash(agg.fingerprint(v.decisions(spark, d), v.bridge(spark, d), v.contradictions(spark, d)))


TITLES = ("Use REST", "GraphQL gateway", "plain files", "SOAP bridge")


@query(f"""
WITH t AS (SELECT d.project, lower({v._case(TITLES, 'd.id % 4')}) AS w FROM decision d WHERE valid AND d.id IN (SELECT id FROM bridge WHERE dimension = 'api-style')),
s AS (SELECT project, CASE WHEN contains(w, 'rest') THEN 'rest' WHEN contains(w, 'graphql') THEN 'graphql' WHEN contains(w, 'soap') THEN 'soap' END AS style FROM t)
SELECT project, coalesce(list_sort(list(DISTINCT style) FILTER (style IS NOT NULL)), []) AS styles, count(DISTINCT style) <= 1 AS satisfied FROM s GROUP BY project
""")
def api_style_consistency(spark: SparkSession, d: str) -> DataFrame:
    decisions = v.decisions(spark, d).withColumn("title", v.pick(TITLES, F.col("id") % 4)).withColumn("content", F.lit(None).cast("string"))
    return agg.api_style_consistency(decisions, v.bridge(spark, d))

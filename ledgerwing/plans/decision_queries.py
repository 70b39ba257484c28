"""Queries over decisions, contradictions, calibration records and organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.operators import aggregates as agg
from ledgerwing.operators import graph, pairs, timeline
from ledgerwing.operators import sequences as seq
from ledgerwing.plans import views as v
from ledgerwing.plans.catalog import ORACLES, query
from ledgerwing.schemas import DIMENSIONS
from ledgerwing.session import table

RECENCY = f"1.0 / (1.0 + epoch_us(TIMESTAMP '{v.AS_OF}' - d.created_at) / 1000000.0 / 2592000.0)"
AGE_DAYS = "epoch_us(TIMESTAMP '{0}' - {1}) / 86400000000.0"


@query("SELECT * FROM pair")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.candidate_pairs(v.bridge(spark, d))


@query(f"""
WITH shared AS (
  SELECT a.id, b.id AS related_id, count(DISTINCT a.dimension) AS shared_count FROM bridge a JOIN bridge b
  ON a.project = b.project AND a.dimension = b.dimension AND a.id <> b.id GROUP BY ALL
), scored AS (SELECT s.*, shared_count * ({RECENCY}) AS raw FROM shared s JOIN decision d ON d.id = related_id WHERE d.valid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY raw DESC, related_id) AS rank FROM scored),
top AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ranked WHERE rank <= 5)
SELECT id, related_id, CAST(rank AS INTEGER) AS rank,
       CAST(CASE WHEN n <= 2 THEN rank WHEN rank = 1 THEN 1 WHEN rank = 2 THEN n ELSE rank - 1 END AS INTEGER) AS position,
       shared_count, round(least(1.0, raw), 6) AS score FROM top
""")
def find_related(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_related(v.decisions(spark, d), v.bridge(spark, d), v.as_of())


@query("""
SELECT id AS source, supersedes AS target, 'supersedes' AS kind, 1.0::DOUBLE AS weight FROM decision WHERE supersedes IS NOT NULL AND valid
UNION ALL SELECT a_id, b_id, verdict, confidence FROM contra WHERE status = 'unresolved'
UNION ALL SELECT a_id, b_id, 'shared', CAST(shared_count AS DOUBLE) FROM pair JOIN decision x ON x.id = a_id JOIN decision y ON y.id = b_id WHERE x.valid AND y.valid
""")
def decision_graph(spark: SparkSession, d: str) -> DataFrame:
    return pairs.decision_graph(v.decisions(spark, d), v.bridge(spark, d), v.contradictions(spark, d))


@query("""
WITH s AS (SELECT id, list_sort(list(dimension)) AS dims FROM bridge WHERE id % 9 > 0 GROUP BY id)
SELECT d.id, repeat(title || ' ', 4)[1:50] AS label, decision_type, coalesce(dims, []) AS dimensions, confidence, status FROM decision d LEFT JOIN s ON s.id = d.id WHERE valid
""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Titles longer than a label; every ninth decision has lost its dimensions."""
    title = F.repeat(F.concat("title", F.lit(" ")), 4)
    return pairs.graph_nodes(v.decisions(spark, d).withColumn("title", title), v.bridge(spark, d).filter("id % 9 > 0"))


@query("""
WITH touched AS (
  SELECT a_id AS id, b_id AS other, 'related' AS why FROM pair JOIN decision o ON o.id = b_id WHERE o.valid
  UNION ALL SELECT b_id, a_id, 'related' FROM pair JOIN decision o ON o.id = a_id WHERE o.valid
  UNION ALL SELECT a_id, b_id, 'contradicting' FROM contra WHERE status = 'unresolved'
  UNION ALL SELECT b_id, a_id, 'contradicting' FROM contra WHERE status = 'unresolved'
  UNION ALL SELECT supersedes, id, 'superseded_by' FROM decision WHERE supersedes IS NOT NULL
), n AS (
  SELECT id, count(*) FILTER (why = 'related') AS related, count(*) FILTER (why = 'contradicting') AS contradicting,
         count(*) FILTER (why = 'superseded_by') AS superseded_by, count(DISTINCT other) AS touched FROM touched GROUP BY id
), active AS (SELECT project, count(*) AS active FROM decision WHERE valid GROUP BY project)
SELECT id, related, contradicting, superseded_by, round(least(1.0, touched / CAST(greatest(coalesce(active, 1), 1) AS DOUBLE)), 6) AS impact
FROM n JOIN decision USING (id) LEFT JOIN active USING (project)
""")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return pairs.blast_radius(v.decisions(spark, d), v.bridge(spark, d), v.contradictions(spark, d))


AFFECTED = """
affected AS (
  SELECT c.id, count(DISTINCT b.id) AS affected FROM (SELECT *, unnest(shared_dimensions) AS dimension FROM contra) c
  LEFT JOIN (SELECT b.* FROM bridge b JOIN decision d ON d.id = b.id WHERE d.valid) b
  ON b.project = c.project AND b.dimension = c.dimension AND b.id <> a_id AND b.id <> b_id GROUP BY c.id
)"""


@query(f"WITH {AFFECTED} SELECT * FROM affected")
def affected_count(spark: SparkSession, d: str) -> DataFrame:
    return pairs.affected_count(v.contradictions(spark, d, "valid"), v.decisions(spark, d), v.bridge(spark, d))


@query(f"""
WITH {AFFECTED}, scored AS (
  SELECT id, project, round(0.3 * confidence + 0.25 * least(1.0, affected / 5.0::DOUBLE) + 0.25 * least(1.0, {AGE_DAYS.format(v.AS_OF, 'detected_at')} / 90.0)
         + 0.2 * CASE verdict WHEN 'contradiction' THEN 1.0 ELSE 0.5 END, 6) AS priority
  FROM contra JOIN affected USING (id) WHERE status = 'unresolved' AND NOT is_baseline AND verdict <> 'compatible'
)
SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY priority DESC, id) AS INTEGER) AS rank FROM scored
""")
def backlog(spark: SparkSession, d: str) -> DataFrame:
    open_ = v.contradictions(spark, d, "valid").filter(seq.OPEN)
    return seq.backlog(pairs.with_affected(open_, v.decisions(spark, d), v.bridge(spark, d)), None, v.as_of())


ROLES = {
    "auth": ("tech_lead", "ciso"),
    "api-style": ("tech_lead", "qa"),
    "deployment": ("tech_lead", "devops"),
    "testing": ("tech_lead", "qa"),
    "messaging": ("tech_lead", "qa"),
    "security": ("tech_lead", "ciso"),
}
RULES = [(dim, role) for dim in DIMENSIONS for role in ROLES.get(dim, ("tech_lead",))]


@query(f"""
WITH rule(dimension, role) AS (VALUES {', '.join(str(r) for r in RULES)}),
r AS (SELECT id, list_sort(list(DISTINCT role)) AS roles FROM (SELECT id, unnest(shared_dimensions) AS dimension FROM contra) JOIN rule USING (dimension) GROUP BY id)
SELECT id, roles, len(roles) >= 2 AS dual_auth FROM r
""")
def route(spark: SparkSession, d: str) -> DataFrame:
    return pairs.route(v.contradictions(spark, d), spark.createDataFrame(RULES, "dimension string, role string"))


@query("""
WITH i AS (SELECT a.id, a.project, a.created_at AS valid_from, (SELECT min(b.created_at) FROM decision b WHERE b.supersedes = a.id) AS valid_until FROM decision a)
SELECT * FROM i
""")
def to_intervals(spark: SparkSession, d: str) -> DataFrame:
    return seq.to_intervals(v.decisions(spark, d))


@query("""
WITH i AS (SELECT a.id, a.project, a.created_at AS valid_from, lead(a.created_at) OVER (PARTITION BY project ORDER BY created_at, id) AS valid_until FROM decision a),
t AS (SELECT o_custkey AS key, o_orderdate + INTERVAL 30 DAY AS t FROM orders)
SELECT t, key, id FROM t JOIN i ON project = key AND valid_from <= t AND (valid_until IS NULL OR t < valid_until)
""")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    times = o.select(F.col("o_custkey").alias("key"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")).alias("t"))
    return pairs.as_of(seq.to_intervals(v.decisions(spark, d)).withColumnRenamed("project", "key"), times)


@query("""
SELECT b.project, b.dimension, b.id, CAST(row_number() OVER (PARTITION BY b.project, b.dimension ORDER BY created_at, b.id) AS INTEGER) AS version
FROM bridge b JOIN decision d ON d.id = b.id
""")
def dimension_history(spark: SparkSession, d: str) -> DataFrame:
    return seq.dimension_history(seq.to_intervals(v.decisions(spark, d)), v.bridge(spark, d))


SCORE = f"""round(CASE decision_type WHEN 'constraint' THEN 1.0 WHEN 'architectural' THEN 0.9 WHEN 'technical' THEN 0.7 ELSE 0.5 END
 * (1.0::DOUBLE / (1.0 + ln(greatest(1.0, {AGE_DAYS.format(v.AS_OF, 'created_at')})))) * confidence, 6)"""


@query(f"SELECT id, project, {SCORE} AS score FROM decision WHERE status = 'active'")
def priority_score(spark: SparkSession, d: str) -> DataFrame:
    return seq.priority_score(v.decisions(spark, d), v.as_of())


@query(f"""
WITH s AS (SELECT id, project, {SCORE} AS score FROM decision WHERE status = 'active'),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS rank FROM s)
SELECT id, project, score, CAST(rank AS INTEGER) AS rank,
       CASE WHEN rank <= 5 THEN 'always' WHEN rank <= 10 AND id IN (SELECT id FROM bridge) THEN 'auto' ELSE 'on-demand' END AS tier FROM r
""")
def assign_tiers(spark: SparkSession, d: str) -> DataFrame:
    return seq.assign_tiers(seq.priority_score(v.decisions(spark, d), v.as_of()), v.bridge(spark, d), always=5, auto=5)


@query("""
SELECT project, count(*) FILTER (source_type IN ('agent', 'scan')) AS agent, count(*) FILTER (source_type NOT IN ('agent', 'scan')) AS human,
       count(*) AS total, round(count(*) FILTER (source_type IN ('agent', 'scan')) / count(*)::DOUBLE, 6) AS agent_share FROM decision GROUP BY project
""")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    return agg.attribution(v.decisions(spark, d))


OPEN = "SELECT project, count(*) AS actionable FROM contra WHERE verdict = 'contradiction' AND status = 'unresolved' AND NOT is_baseline GROUP BY project"


@query(f"""
WITH a AS (SELECT project, count(*) FILTER (valid) AS active FROM decision GROUP BY project), o AS ({OPEN})
SELECT project, active, coalesce(actionable, 0) AS actionable,
       round(CASE WHEN active = 0 THEN 1.0 ELSE greatest(0.0, 1 - coalesce(actionable, 0) / greatest(active, 1)::DOUBLE) END, 6) AS coherence FROM a LEFT JOIN o USING (project)
""")
def health(spark: SparkSession, d: str) -> DataFrame:
    return agg.health(v.decisions(spark, d), v.contradictions(spark, d))


@query(f"""
WITH a AS (SELECT project, count(*) AS total FROM decision GROUP BY project), o AS ({OPEN}),
c AS (SELECT project, total, coalesce(actionable, 0) AS actionable, greatest(0.0, 1 - coalesce(actionable, 0) / total::DOUBLE) AS x FROM a LEFT JOIN o USING (project))
SELECT project, total, actionable, round(x, 6) AS coherence, CASE WHEN x >= 0.8 THEN 'healthy' WHEN x >= 0.5 THEN 'degraded' ELSE 'critical' END AS status FROM c
""")
def triage(spark: SparkSession, d: str) -> DataFrame:
    return agg.triage(v.decisions(spark, d), v.contradictions(spark, d))


@query("""
WITH r AS (SELECT project, id, verdict, confidence, row_number() OVER (PARTITION BY project ORDER BY CASE verdict WHEN 'contradiction' THEN 0 ELSE 1 END, confidence DESC, id) AS rank FROM contra WHERE status = 'unresolved')
SELECT * FROM r WHERE rank <= 5
""")
def top_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return agg.top_contradictions(v.contradictions(spark, d))


@query(f"""
WITH a AS (SELECT project, count(*) AS total, count(*) FILTER (status = 'active') AS active FROM decision GROUP BY project), o AS ({OPEN}),
u AS (SELECT project, count(*) AS unresolved FROM contra WHERE status = 'unresolved' GROUP BY project),
w AS (SELECT user_id AS project, event_id % 7 AS agent, value - 100 AS score FROM events), h AS (SELECT project, max(score) AS drift FROM w WHERE score > 0 GROUP BY project),
b AS (SELECT project, drift, min(agent) AS drifting_agent FROM w JOIN h USING (project) WHERE score = drift GROUP BY ALL),
e AS (SELECT user_id AS project, count(*) FILTER (event_type = 'click' AND event_id % 3 < 2) AS anomalous_calls, count(*) FILTER (event_id % 4 = 3) AS pending FROM events GROUP BY user_id),
c AS (SELECT a.*, coalesce(actionable, 0) AS actionable, greatest(0.0, 1 - coalesce(actionable, 0) / total::DOUBLE) AS x FROM a LEFT JOIN o USING (project))
SELECT project, total, actionable, round(x, 6) AS coherence, CASE WHEN x >= 0.8 THEN 'healthy' WHEN x >= 0.5 THEN 'degraded' ELSE 'critical' END AS status, active, coalesce(unresolved, 0) AS unresolved,
  coalesce(anomalous_calls, 0) AS anomalous_calls, coalesce(pending, 0) AS pending, drifting_agent, coalesce(drift, 0.0) AS drift FROM c LEFT JOIN u USING (project) LEFT JOIN b USING (project) LEFT JOIN e USING (project)
""")
def home(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("project", F.col("user_id"))
    alerts = e.select("project", (F.col("event_id") % 7).alias("agent_id"), (F.col("value") - 100).alias("score"))
    action = F.when(F.col("event_type") == "click", "llm_call").otherwise("shell_exec")
    timeline = e.select("project", action.alias("action"), v.pick(("warning", "critical", "info"), F.col("event_id") % 3).alias("severity"))
    assumed = e.select("project", v.pick(("validated", "rejected", "detected", "proposed"), F.col("event_id") % 4).alias("status"))
    return agg.home(v.decisions(spark, d), v.contradictions(spark, d), alerts, timeline, assumed)


@query("""
WITH r AS (SELECT *, (judge_verdict = human_verdict)::INT::DOUBLE AS correct,
  CASE judge_verdict WHEN 'contradiction' THEN 2 WHEN 'tension' THEN 1 ELSE 0 END AS j, CASE human_verdict WHEN 'contradiction' THEN 2 WHEN 'tension' THEN 1 ELSE 0 END AS h,
  least(floor(judge_confidence * 10), 9) AS bin, row_number() OVER (PARTITION BY judge ORDER BY ts DESC, id DESC) AS rn FROM calib),
e AS (SELECT judge, sum(g) / sum(m) AS ece FROM (SELECT judge, bin, count(*) AS m, abs(sum(correct) - sum(judge_confidence)) AS g FROM r GROUP BY ALL) GROUP BY judge),
m AS (SELECT judge, count(*) AS n, avg(correct) AS accuracy, avg(pow(judge_confidence - correct, 2)) AS brier,
  abs(avg((j <= 0)::INT) - avg((h <= 0)::INT)) + abs(avg((j <= 1)::INT) - avg((h <= 1)::INT)) AS wasserstein, avg(correct) FILTER (rn <= 50) AS recent FROM r GROUP BY judge)
SELECT judge, n, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, round(ece, 6) AS ece, round(wasserstein, 6) AS wasserstein,
       round(abs(accuracy - recent), 6) AS drift, abs(accuracy - recent) > 0.15 AS needs_review FROM m JOIN e USING (judge)
""")
def calibration_metrics(spark: SparkSession, d: str) -> DataFrame:
    return agg.calibration_metrics(v.calibration(spark, d))


DISMISSED = "SELECT unnest(shared_dimensions) AS dimension, confidence, confidence - 0.2 AS nli_score FROM contra WHERE status = 'resolved' AND verdict <> 'compatible'"
TOTALS = "SELECT dimension, count(*) AS total FROM (SELECT unnest(shared_dimensions) AS dimension FROM contra WHERE verdict = 'contradiction') GROUP BY dimension"
STATS = f"""
dis AS ({DISMISSED}), tot AS ({TOTALS}), g AS (SELECT dimension, count(*) AS dismissed, avg(confidence) AS c, avg(nli_score) FILTER (nli_score > 0) AS s FROM dis GROUP BY dimension),
stat AS (SELECT dimension, coalesce(total, dismissed) AS total, coalesce(dismissed, 0) AS dismissed, round(coalesce(dismissed, 0) / coalesce(total, dismissed)::DOUBLE, 6) AS rate,
  round(coalesce(c, 0.0), 6) AS avg_confidence, round(coalesce(s, 0.0), 6) AS avg_nli,
  coalesce(dismissed, 0) >= 5 AND coalesce(dismissed, 0) / coalesce(total, dismissed)::DOUBLE > 0.5 AS needs_tuning FROM g FULL JOIN tot USING (dimension))"""


def _dismissals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = v.contradictions(spark, d)
    gone = c.filter("status = 'resolved' and verdict <> 'compatible'").select(F.explode("shared_dimensions").alias("dimension"), "confidence", (F.col("confidence") - 0.2).alias("nli_score"))
    totals = c.filter("verdict = 'contradiction'").select(F.explode("shared_dimensions").alias("dimension")).groupBy("dimension").agg(F.count("*").alias("total"))
    return gone, totals


@query(f"WITH {STATS} SELECT * FROM stat")
def dismissal_stats(spark: SparkSession, d: str) -> DataFrame:
    return agg.dismissal_stats(*_dismissals(spark, d), rate_limit=0.5)


@query(f"""WITH {STATS} SELECT dimension, round(least(0.8, CASE WHEN avg_nli > 0 THEN greatest(0.3, avg_nli + 0.1) ELSE 0.4 END), 6) AS recommended, rate, dismissed FROM stat WHERE needs_tuning""")
def tuning_report(spark: SparkSession, d: str) -> DataFrame:
    return agg.tuning_report(agg.dismissal_stats(*_dismissals(spark, d), rate_limit=0.5))


def _org_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return v.organisations(spark, d).join(v.bridge(spark, d).select("id", "dimension"), "id")


@query("""
SELECT dimension, count(*) AS total_decisions, count(DISTINCT org_id) AS orgs_using, round(count(*) / count(DISTINCT org_id)::DOUBLE, 6) AS avg_per_org, round(avg(confidence), 6) AS avg_confidence
FROM org o JOIN bridge b ON b.id = o.id GROUP BY dimension HAVING (SELECT count(DISTINCT org_id) FROM org) >= 5
""")
def aggregate_orgs(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate_orgs(_org_dimensions(spark, d))


@query("""
WITH f AS (SELECT o.id, org_id, decision_type, confidence, coalesce((SELECT min(dimension) FROM bridge b WHERE b.id = o.id), 'general') AS dim FROM org o)
SELECT decision_type AS pattern, dim AS dimension, count(*) AS occurrences, count(DISTINCT org_id) AS orgs, round(count(DISTINCT org_id) / (SELECT count(DISTINCT org_id) FROM f)::DOUBLE, 6) AS adoption, round(avg(confidence), 6) AS avg_confidence
FROM f GROUP BY ALL ORDER BY occurrences DESC, pattern, dimension LIMIT 20
""")
def top_patterns(spark: SparkSession, d: str) -> DataFrame:
    first = v.bridge(spark, d).groupBy("id").agg(F.min("dimension").alias("f"))
    rows = v.organisations(spark, d).join(first, "id", "left").withColumn("first_dimension", F.coalesce("f", F.lit("general")))
    return agg.top_patterns(rows)


@query("""
WITH used AS (SELECT DISTINCT d.project AS org_id, dimension FROM decision d JOIN bridge b ON b.id = d.id),
n AS (SELECT count(DISTINCT org_id) AS orgs FROM used),
common AS (SELECT dimension, round(count(*) / any_value(orgs)::DOUBLE, 6) AS adoption FROM used, n GROUP BY dimension HAVING count(*) >= 0.7 * any_value(orgs))
SELECT org_id, dimension, adoption, 'adoption_gap' AS kind FROM (SELECT DISTINCT o.org_id, c.dimension, c.adoption FROM used o, common c) w WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.org_id = w.org_id AND u.dimension = w.dimension)
""")
def insights(spark: SparkSession, d: str) -> DataFrame:
    return agg.insights(v.bridge(spark, d).select(F.col("project").alias("org_id"), "dimension"))


@query(f"""
WITH base AS (SELECT project, count(*) AS n, avg(confidence) AS conf, count(DISTINCT source_type) AS kinds FROM decision GROUP BY project),
dims AS (SELECT b.project, dimension, count(*) AS k, avg(confidence) AS c FROM bridge b JOIN decision d ON d.id = b.id GROUP BY ALL),
con AS (SELECT project, count(*) AS contra, count(*) FILTER (status = 'resolved') AS resolved FROM contra GROUP BY project),
s AS (SELECT base.*, [{', '.join(f"coalesce((SELECT round(least(1.0, k / base.n::DOUBLE) * c + 1e-9, 6) FROM dims WHERE dims.project = base.project AND dimension = '{x}'), round(1e-9, 6))" for x in DIMENSIONS)}] AS scores,
  (SELECT count(*) FROM dims WHERE dims.project = base.project) AS used, coalesce(contra, 0) AS contra, coalesce(resolved / contra::DOUBLE, 0.0) AS res FROM base LEFT JOIN con USING (project))
SELECT project, list_concat(scores, [round(least(1.0, ln(1 + n) / ln(1001.0)) + 1e-9, 6), round(least(1.0, contra / n::DOUBLE) + 1e-9, 6), round(conf + 1e-9, 6), round(used / 12.0::DOUBLE + 1e-9, 6),
  round(used / 12.0::DOUBLE * conf * (0.5 + 0.5 * res) + 1e-9, 6), round(least(1.0, kinds / 5.0::DOUBLE) + 1e-9, 6), round(least(1.0, n / greatest(used * 5, 1)::DOUBLE) + 1e-9, 6), round(res + 1e-9, 6)]) AS vector FROM s
""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return agg.fingerprint(v.decisions(spark, d), v.bridge(spark, d), v.contradictions(spark, d))


@query("""
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity, round(list_cosine_similarity(a.e, b.e), 6) >= 0.7 AS compatible
FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
""")
def compare_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The vectors whose id 20 divides against all vectors of their label."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return pairs.compare_fingerprints(e, asked=e.filter("key % 20 = 0"))


@query(f"""
WITH g AS ({OPEN.replace('actionable', 'violations')})
SELECT project, 'no-new-contradictions' AS rule, 'error' AS severity, '' AS field, violations FROM g
UNION ALL SELECT project, 'decision-metadata', 'error', 'dimensions', count(*) FROM decision WHERE status = 'active' AND (id % 11 = 0 OR id NOT IN (SELECT id FROM bridge)) GROUP BY project
UNION ALL SELECT project, 'decision-metadata', 'warning', 'rationale', count(*) FROM decision WHERE status = 'active' AND id % 9 < 2 GROUP BY project
""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every eleventh decision has lost its dimensions; of nine one has a blank rationale and one none."""
    rationale = F.when(F.col("id") % 9 == 0, "  ").when(F.col("id") % 9 > 1, "because")
    return agg.quality_gate(v.decisions(spark, d).withColumn("rationale", rationale), v.bridge(spark, d).filter("id % 11 <> 0"), v.contradictions(spark, d))


@query(f"""
WITH has AS (SELECT b.project, list(DISTINCT dimension) AS dims FROM bridge b JOIN decision d ON d.id = b.id WHERE d.valid GROUP BY b.project)
{' UNION ALL '.join(f"SELECT project, '{n}' AS rule, NOT list_contains(dims, '{a}') OR list_contains(dims, '{b}') AS satisfied FROM has" for n, a, b in agg.IMPLICATIONS)}
""")
def verify_rules(spark: SparkSession, d: str) -> DataFrame:
    return agg.verify_rules(v.decisions(spark, d), v.bridge(spark, d))


@query("""
WITH s AS (SELECT c.id, unnest([a_id, b_id]) AS decision_id FROM contra c), t AS (SELECT made_by, count(DISTINCT s.id) AS n FROM s JOIN decision d ON d.id = decision_id GROUP BY made_by)
SELECT made_by, count(*) AS decisions_made, coalesce(any_value(n), 0) AS contradictions_triggered FROM decision LEFT JOIN t USING (made_by) GROUP BY made_by
""")
def agent_activity(spark: SparkSession, d: str) -> DataFrame:
    return pairs.agent_activity(v.decisions(spark, d), v.contradictions(spark, d))


@query("""
SELECT a_id AS decision_id, c.id AS contradiction_id, verdict, c.status, o.title AS other_title FROM contra c JOIN decision o ON o.id = b_id
UNION ALL SELECT b_id, c.id, verdict, c.status, o.title FROM contra c JOIN decision o ON o.id = a_id
""")
def contradiction_sides(spark: SparkSession, d: str) -> DataFrame:
    return pairs.contradiction_sides(v.contradictions(spark, d), v.decisions(spark, d))


@query("SELECT c.id, d.project, verdict, c.confidence, detected_at FROM contra c JOIN decision d ON d.id = a_id WHERE c.status = 'unresolved' AND NOT is_baseline")
def unresolved(spark: SparkSession, d: str) -> DataFrame:
    return pairs.unresolved(v.contradictions(spark, d), v.decisions(spark, d))


@query("""
WITH r AS (SELECT o_orderkey AS request_id, o_custkey AS project, list(DISTINCT dimension) AS dims FROM orders JOIN bridge b ON b.id = o_orderkey GROUP BY ALL),
a AS (SELECT request_id, project, unnest(dims) AS dimension FROM r),
bl AS (SELECT request_id, min(c.id) AS blocked_by FROM a JOIN (SELECT *, unnest(shared_dimensions) AS dimension FROM contra WHERE status = 'unresolved' AND verdict = 'contradiction') c USING (project, dimension) GROUP BY request_id),
li AS (SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY id) AS n FROM (SELECT DISTINCT request_id, b.id FROM a JOIN bridge b USING (project, dimension) JOIN decision k ON k.id = b.id WHERE k.valid))
SELECT r.request_id, blocked_by IS NULL AS allowed, blocked_by, CASE WHEN blocked_by IS NULL THEN coalesce((SELECT list_sort(list(id)) FROM li WHERE li.request_id = r.request_id AND n <= 5), []) ELSE [] END AS constraints
FROM r LEFT JOIN bl USING (request_id)
""")
def evaluate_actions(spark: SparkSession, d: str) -> DataFrame:
    b = v.bridge(spark, d)
    asked = b.groupBy(F.col("id").alias("request_id"), "project").agg(F.collect_set("dimension").alias("dimensions"))
    return pairs.evaluate_actions(asked, v.contradictions(spark, d), b, v.decisions(spark, d))


@query("""
WITH RECURSIVE chain(id, node, depth) AS (
  SELECT id, id, 0::BIGINT FROM decision UNION ALL SELECT c.id, d.supersedes, depth + 1 FROM chain c JOIN decision d ON d.id = c.node WHERE d.supersedes IS NOT NULL
)
SELECT id, max_by(node, depth) AS root, max(depth) AS depth, false AS cyclic FROM chain GROUP BY id
""", name="supersession_chains")
def chains(spark: SparkSession, d: str) -> DataFrame:
    return graph.supersession_chains(v.decisions(spark, d))


@query("SELECT DISTINCT project, project % 5 = 2 AS has_cycle FROM decision")
def has_cycle(spark: SparkSession, d: str) -> DataFrame:
    """In every fifth project the oldest decision supersedes the newest, so that its chain has no end."""
    decisions = v.decisions(spark, d).select("id", "project", "created_at", "supersedes")
    newest = decisions.groupBy("project").agg(F.max_by("id", F.struct("created_at", "id")).alias("newest"))
    closed = F.when(F.col("supersedes").isNull() & (F.col("project") % 5 == 2), F.col("newest")).otherwise(F.col("supersedes"))
    return graph.has_cycle(decisions.join(newest, "project").withColumn("supersedes", closed).select("id", "project", "supersedes"))


@query("""
WITH p AS (SELECT a_id || '-' || b_id AS pair_id, unnest([{'r': 0, 'v': verdict, 'c': confidence}, {'r': 1, 'v': CASE WHEN a_id % 2 = 0 THEN 'tension' ELSE verdict END, 'c': confidence / 2}, {'r': 2, 'v': 'compatible', 'c': 0.5::DOUBLE}]) AS x FROM contra),
g AS (SELECT pair_id, x.v AS verdict, count(*) AS n, max(x.c) AS c, min(x.r) AS f FROM p GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY pair_id) AS t, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, f) AS k FROM g)
SELECT pair_id, verdict, n AS votes, round(n / t, 3) AS agreement, round(c * (n / t), 3) AS confidence FROM r WHERE k = 1
""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Three votes a pair, of which all may differ: then the first one wins."""
    c = v.contradictions(spark, d)
    pair_id = F.concat_ws("-", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("pair_id")
    votes = F.array(
        F.struct(F.lit(0).alias("r"), F.col("verdict").alias("v"), F.col("confidence").alias("c")),
        F.struct(F.lit(1).alias("r"), F.when(F.col("a_id") % 2 == 0, "tension").otherwise(F.col("verdict")).alias("v"), (F.col("confidence") / 2).alias("c")),
        F.struct(F.lit(2).alias("r"), F.lit("compatible").alias("v"), F.lit(0.5).alias("c")),
    )
    return agg.majority_vote(c.select(pair_id, F.explode(votes).alias("x")).select("pair_id", F.col("x.r").alias("round"), F.col("x.v").alias("verdict"), F.col("x.c").alias("confidence")))


@query(f"""
WITH f AS ({ORACLES['fingerprint']}), p AS (SELECT a.project AS a, b.project AS b, a.vector AS x, b.vector AS y FROM f a JOIN f b ON b.project = a.project + 1),
s AS (SELECT a, b, list_transform(range(1, 13), lambda i: CASE WHEN x[i] = 0 AND y[i] = 0 THEN 1.0 ELSE 1 - abs(x[i] - y[i]) / greatest(x[i], y[i], 0.001) END) AS l FROM p)
SELECT a, b, round(list_sum(list_transform(l, lambda z: round(z, 6))) + 1e-8, 4) AS total, list_filter(list_transform(range(1, 13), lambda i: CASE WHEN l[i] < 0.3 THEN 'Major divergence in ''' || {v._case(DIMENSIONS, "i - 1")} || ''' — review required' WHEN l[i] < 0.6 THEN 'Moderate difference in ''' || {v._case(DIMENSIONS, "i - 1")} || '''' END), lambda n: n IS NOT NULL) AS notes FROM s
""")
def fingerprint_notes(spark: SparkSession, d: str) -> DataFrame:
    """Each project beside the next one by number; total sums the likeness in all dimensions."""
    f = agg.fingerprint(v.decisions(spark, d), v.bridge(spark, d), v.contradictions(spark, d))
    a, b = f.select(F.col("project").alias("a"), F.col("vector").alias("a_vector")), f.select(F.col("project").alias("b"), F.col("vector").alias("b_vector"))
    found = pairs.fingerprint_notes(a.join(b, F.col("b") == F.col("a") + 1))
    total = F.aggregate(F.map_values("similarities"), F.lit(0.0), lambda t, x: t + x)
    return found.select("a", "b", F.round(total + 1e-8, 4).alias("total"), "notes")

"""Queries of review texts, symbol diffs, context, listings and of readers over what they have written."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.functions import questions, text
from ledgerwing.operators import aggregates as agg
from ledgerwing.operators import governance as gov
from ledgerwing.operators import matching, pairs, review, risk
from ledgerwing.operators import sequences as seq
from ledgerwing.plans import views as v
from ledgerwing.plans.catalog import query
from ledgerwing.plans.governance_queries import ASSUMED, _assumptions
from ledgerwing.session import shared_folder, table
from ledgerwing.sources import readers


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT id, project, title, created_at FROM decision WHERE valid AND project = 7")
def active_decisions(spark: SparkSession, d: str) -> DataFrame:
    return review.active_decisions(v.decisions(spark, d), F.lit(7))


@query("""
WITH h AS (SELECT user_id AS project, event_type AS dimension, list_sort(list(DISTINCT json_extract_string(props, '$.k')))[1:3] AS f FROM events GROUP BY ALL)
SELECT project, dimension, 'Use ' || array_to_string(f, ', ') || ' for ' || dimension || '; do not introduce alternatives without a recorded decision.' AS text FROM h
""")
def constraint_text(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("project"), F.col("event_type").alias("dimension")).agg(F.collect_set(F.get_json_object("props", "$.k")).alias("found"))
    return review.constraint_text(e)


@query(f"""WITH {ASSUMED}
SELECT id, CASE status WHEN 'validated' THEN 'DOMAIN RULE: ' || category || ' — yes [Validated by lead on ' || strftime(ts + INTERVAL 1 HOUR, '%b %d') || ']'
  WHEN 'rejected' THEN 'DOMAIN RULE: DO NOT assume ' || category || '. yes [Corrected by lead on ' || strftime(ts + INTERVAL 1 HOUR, '%b %d') || ']' ELSE '' END AS text FROM assumed""")
def rule_text(spark: SparkSession, d: str) -> DataFrame:
    a = _assumptions(spark, d).withColumn("summary", F.col("category")).withColumn("options", F.array(F.lit("yes"), F.lit("no"))).withColumn("selected_option", F.lit(0)).withColumn("resolved_by", F.lit("lead"))
    return review.rule_text(a)


#: Findings (rule, category, snippet), and the beginning of the question and the first two options that they lead to.
ASKED = (
    ("single_source_write", "data_scope", "def save(x): db.run(INSERT INTO `users` VALUES)", "The code restricts writes to 'users' from save().", "A) Correct — only save() should write to users", "B) Incomplete — external webhooks/APIs should also write to users", 5),
    ("narrow_where_clause", "data_scope", "select a from t WHERE b = 3 ;", "This query filters t with WHERE b = 3. Does", "A) Correct — only this subset is ever needed", "B) Incomplete — other filter values will be needed later", 4),
    ("single_role_access", "access", "if allowed(\"Viewer\", \"x y\")", "This endpoint requires role 'Viewer'. Should", "A) Correct — only Viewer should access this", "B) Incomplete — other roles (e.g., superadmin, service accounts) need access", 4),
    ("incomplete_enum", "completeness", "status in (OPEN, CLOSED )", "This code handles statuses: OPEN, CLOSED. Are", "A) Yes — these are the only valid states", "B) No — additional states will be needed (e.g., closed, archived)", 4),
    ("env_no_fallback", "configuration", "os.environ.get(\"HOME\")", "This code reads os.environ['HOME'] without", "A) Yes — deployment always sets HOME", "B) No — needs a sensible default for local development", 4),
    ("single_endpoint", "access", "@app.get(\"/api/v2/orders/{id}\")", "Resource 'orders' is only", "A) Yes — one access path is intentional", "B) No — other endpoints should also expose this data", 4),
    ("own_rule", "data_scope", "x", "This code makes a data scope assumption: told", "A) The current scope is correct and complete", "B) The scope is too narrow — additional data sources are needed", 5),
    ("own_rule", "other", "x", "This code assumes: told", "A) Yes — this assumption is correct", "B) Partially — the assumption is too narrow", 4),
)


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(f"""WITH t(k, start, a, b, n) AS (VALUES {', '.join(f"({k}, {_quote(start)}, {_quote(a)}, {_quote(b)}, {n})" for k, (_, _, _, start, a, b, n) in enumerate(ASKED))})
SELECT event_id AS id, start AS question, a, b, n FROM events JOIN t ON k = event_id % {len(ASKED)}""")
def question_text(spark: SparkSession, d: str) -> DataFrame:
    """The question as far as the list has it, its first two options, and how many there are."""
    k = F.col("event_id") % len(ASKED)
    rule, category, snippet, start = (v.pick(tuple(x[c] for x in ASKED), k) for c in range(4))
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), rule.alias("pattern_id"), category.alias("category"), snippet.alias("snippet"), F.concat(F.lit("told "), "event_id").alias("summary"))
    found = questions.question_text(e).join(table(spark, d, "events").select(F.col("event_id").alias("id"), F.length(start).alias("w")), "id")
    return found.select("id", F.expr("substring(question, 1, w)").alias("question"), F.col("options")[0].alias("a"), F.col("options")[1].alias("b"), F.size("options").alias("n"))


@query(f"""WITH {ASSUMED}, s AS (SELECT id, CASE WHEN id % 8 = 3 THEN 'proposed' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN ['yes', 'no', 'I need MORE context', 'other'] ELSE ['yes', 'no'] END AS options, id % 7 - 1 AS option FROM assumed),
t AS (SELECT *, status IN ('detected', 'proposed') AND id % 3 < 2 AND option BETWEEN 0 AND len(options) - 1 AS taken FROM s),
u AS (SELECT *, CASE WHEN NOT taken THEN status WHEN option = 0 THEN 'validated' WHEN option = 2 THEN 'deferred' ELSE 'rejected' END AS after FROM t)
SELECT id, after AS status, CASE WHEN taken THEN option END AS selected_option, CASE WHEN taken THEN 'lead' END AS resolved_by, CASE WHEN taken THEN 'r' || id END AS rationale,
  CASE WHEN taken THEN TIMESTAMP '{v.AS_OF}' END AS resolved_at, CASE WHEN taken AND after = 'deferred' THEN TIMESTAMP '{v.AS_OF}' + INTERVAL 7 DAY END AS deferred_until FROM u""")
def resolve_assumptions(spark: SparkSession, d: str) -> DataFrame:
    """Two of three assumptions are answered, some with a number that is no option, some that were settled before."""
    few, many = F.array(F.lit("yes"), F.lit("no")), F.array(F.lit("yes"), F.lit("no"), F.lit("I need MORE context"), F.lit("other"))
    a = _assumptions(spark, d).withColumn("status", F.when(F.col("id") % 8 == 3, "proposed").otherwise(F.col("status"))).withColumn("options", F.when(F.col("id") % 5 == 0, many).otherwise(few))
    answers = a.filter("id % 3 < 2").select("id", (F.col("id") % 7 - 1).alias("option"), F.lit("lead").alias("resolved_by"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("rationale"))
    return review.resolve_assumptions(a, answers, v.as_of())


KINDS = ("data_scope", "temporal", "access", "completeness", "configuration", "framework")


@query(f"""WITH {ASSUMED}, s AS (SELECT id, {v._case(KINDS, 'id % 6')} AS category, repeat('word ' || id || ' ', 20) AS summary, CASE WHEN id % 5 > 0 THEN 'lead' END AS resolved_by FROM assumed WHERE status = 'validated')
SELECT id AS assumption_id, 'Validated: ' || summary[1:80] AS title, summary || chr(10) || chr(10) || 'This is a validated ' || replace(category, '_', ' ') || ' constraint. Do not change this behavior without explicit approval.' || chr(10) || chr(10) || 'Rationale: Validated assumption: ' || summary AS content,
  'Validated assumption: ' || summary AS rationale, ['database', 'state-management', 'auth', 'testing', 'deployment', 'api-style'][CAST(id % 6 AS INT) + 1] AS dimension, 'architectural' AS decision_type, coalesce(resolved_by, 'dashboard-user') AS made_by, 'agent' AS source_type FROM s""")
def decisions_from_assumptions(spark: SparkSession, d: str) -> DataFrame:
    summary = F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 20)
    a = _assumptions(spark, d).withColumn("category", v.pick(KINDS, F.col("id") % 6)).withColumn("summary", summary).withColumn("resolved_by", F.when(F.col("id") % 5 > 0, "lead"))
    return review.decisions_from(a)


PIPE = f"""{ASSUMED}, keyed AS (SELECT *, category || '::' || file AS dedup_key FROM assumed), sure AS (SELECT * FROM keyed WHERE confidence >= 0.7),
known AS (SELECT DISTINCT project, dedup_key FROM keyed WHERE id % 50 = 0), fresh AS (SELECT * FROM sure WHERE (project, dedup_key) NOT IN (SELECT (project, dedup_key) FROM known))"""


def _pipeline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = _assumptions(spark, d).withColumn("dedup_key", F.concat_ws("::", "category", "file"))
    known = a.filter("id % 50 = 0").select("project", "dedup_key", F.lit("rejected").alias("status"))
    return review.assumption_pipeline(a, known, a.select(F.col("pattern_id").alias("rule"), F.lit("validated").alias("event")))


@query(f"""WITH {PIPE}, k AS (SELECT *, count(*) OVER (PARTITION BY project, pattern_id, file) AS c FROM fresh),
g AS (SELECT *, project || '::' || pattern_id || '::' || CASE WHEN c > 10 THEN file ELSE regexp_replace(file, '/?[^/]*$', '') END AS cluster FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY severity_rank DESC, confidence DESC, ts, id) AS rn FROM g)
SELECT cluster, count(*) AS n, max(id) FILTER (rn = 1) AS representative, max(severity_rank) AS severity, round(avg(confidence), 6) AS avg_confidence FROM r GROUP BY cluster""")
def assumption_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _pipeline(spark, d)[0]


@query(f"WITH {PIPE} SELECT (SELECT count(*) FROM keyed) AS scanned, (SELECT count(*) FROM sure) AS sure, (SELECT count(*) FROM sure) AS shown, (SELECT count(*) FROM fresh) AS new")
def assumption_counters(spark: SparkSession, d: str) -> DataFrame:
    return _pipeline(spark, d)[1]


RUN = f"""{ASSUMED}, base AS (SELECT * EXCLUDE (category), ['data_scope', 'temporal', 'access'][CAST(id % 3 AS INT) + 1] AS category, 'told ' || id AS summary, 'm' || id AS snippet, 'k' || id % 400 AS dedup_key FROM assumed),
known AS (SELECT DISTINCT project, dedup_key, CASE WHEN id % 2 = 0 THEN 'validated' ELSE 'rejected' END AS st FROM base WHERE project < 15 AND id % 9 = 0),
shadow AS (SELECT pattern_id FROM base GROUP BY pattern_id HAVING pattern_id = 'p1' AND count(*) >= 20),
told AS (SELECT b.*, CASE WHEN pattern_id IN (SELECT pattern_id FROM shadow) THEN 'shadowed' WHEN confidence < CASE category WHEN 'data_scope' THEN 0.4 ELSE 0.7 END THEN 'below_threshold'
  WHEN EXISTS (SELECT 1 FROM known k WHERE k.project = b.project AND k.dedup_key = b.dedup_key AND st = 'validated') THEN 'pre_validated'
  WHEN EXISTS (SELECT 1 FROM known k WHERE k.project = b.project AND k.dedup_key = b.dedup_key) THEN 'deduped' ELSE 'new' END AS outcome FROM base b),
kf AS (SELECT *, count(*) OVER (PARTITION BY project, pattern_id, file) AS nf FROM told WHERE outcome = 'new'),
kg AS (SELECT *, project || '::' || pattern_id || '::' || CASE WHEN nf > 10 THEN file ELSE regexp_replace(file, '/?[^/]*$', '') END AS cluster FROM kf),
kr AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n, row_number() OVER (PARTITION BY cluster ORDER BY severity_rank DESC, confidence DESC, ts, id) AS rn FROM kg),
degree AS (SELECT event_type AS module, count(DISTINCT user_id) AS k FROM events GROUP BY event_type), churned AS (SELECT file, 1 + count(*) / max(count(*)) OVER ()::DOUBLE AS factor FROM base GROUP BY file)"""


def _run(spark: SparkSession, d: str) -> review.AssumptionRun:
    e = table(spark, d, "events")
    key = F.col("id").cast("string")
    a = _assumptions(spark, d).withColumn("category", v.pick(("data_scope", "temporal", "access"), F.col("id") % 3))
    a = a.withColumn("summary", F.concat(F.lit("told "), key)).withColumn("snippet", F.concat(F.lit("m"), key)).withColumn("dedup_key", F.concat(F.lit("k"), (F.col("id") % 400).cast("string")))
    known = a.filter("project < 15 and id % 9 = 0").select("project", "dedup_key", F.when(F.col("id") % 2 == 0, "validated").otherwise("rejected").alias("status"))
    told = F.array(F.lit("triggered"), F.when(F.col("pattern_id") == "p1", "rejected").otherwise("validated"))
    events = a.select(F.col("pattern_id").alias("rule"), F.explode(told).alias("event"))
    evidence = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("module"))
    modules = gov.module_in_degree(e.select(F.col("event_type").alias("module"), F.col("user_id").alias("path")))
    churned = gov.churn(a.select(F.col("file").alias("path")))
    return review.assumption_run(a, known, events, evidence, modules, churned)


@query(f"""WITH {RUN}
SELECT cluster, id, project, CASE WHEN n > 1 THEN '[' || n || 'x] ' || summary ELSE summary END AS summary, n, project >= 15 AS is_baseline, round(severity_rank * (1 + k / (SELECT max(k) FROM degree)::DOUBLE) * round(factor, 6), 4) AS priority, 'proposed' AS status
FROM kr JOIN events ON event_id = id JOIN degree ON module = event_type JOIN churned USING (file) WHERE rn = 1""")
def assumption_proposals(spark: SparkSession, d: str) -> DataFrame:
    """The whole run; questions have a query of their own."""
    return _run(spark, d).proposals.drop("question", "options").withColumn("priority", F.round("priority", 4))


@query(f"""WITH {RUN}
SELECT project, count(*) AS detected, count(*) FILTER (outcome = 'shadowed') AS shadowed, count(*) FILTER (outcome = 'below_threshold') AS below_threshold, count(*) FILTER (outcome = 'pre_validated') AS pre_validated,
  count(*) FILTER (outcome = 'deduped') AS deduped, count(*) FILTER (outcome = 'new') AS new, (SELECT count(DISTINCT cluster) FROM kg WHERE kg.project = told.project) AS clusters,
  round(coalesce(count(*) FILTER (outcome = 'new') / nullif((SELECT count(DISTINCT cluster) FROM kg WHERE kg.project = told.project), 0)::DOUBLE, 0.0), 6) AS compression FROM told GROUP BY project""")
def assumption_run_counters(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).counters


@query("""
WITH t AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 't' || user_id ELSE 'own' || event_id END AS table_name, event_type AS path FROM events)
SELECT id, table_name FROM t WHERE table_name NOT IN (SELECT table_name FROM t GROUP BY table_name HAVING count(DISTINCT path) > 1)
""")
def drop_multi_writer(spark: SparkSession, d: str) -> DataFrame:
    """Every finding against every write; half of the tables have one writer alone."""
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("t"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("own"), F.col("event_id").cast("string")))
    t = table(spark, d, "events").select(F.col("event_id").alias("id"), name.alias("table_name"), F.col("event_type").alias("path"))
    return review.drop_multi_writer(t.select("id", "table_name"), t.select("path", "table_name"))


@query("""
WITH i AS (SELECT DISTINCT 'f' || user_id || '.py' AS path, event_type AS module FROM events),
h AS (SELECT path, CASE WHEN module IN ('view', 'click') THEN 1 ELSE 2 END AS decision_id, module FROM i WHERE module IN ('view', 'error') OR module = 'signup')
SELECT path, decision_id, min(module) AS module FROM h WHERE NOT (decision_id = 1 AND module = 'click') GROUP BY ALL
""")
def import_violations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("m"))
    files = e.select(F.format_string("f%s.py", "user_id").alias("path"), F.array_join(F.transform("m", lambda x: F.concat(F.lit("import "), x)), "\n").alias("source"))
    taxonomy = spark.createDataFrame([("view", "a"), ("click", "a"), ("error", "b"), ("signup", "b"), ("purchase", "b")], "module string, dimension string")
    constraints = spark.createDataFrame([(1, "a", ["click"]), (2, "b", ["purchase"])], "decision_id long, dimension string, allowed array<string>")
    return review.import_violations(files, taxonomy, constraints)


def _symbols(spark: SparkSession, d: str, late: bool) -> DataFrame:
    e = table(spark, d, "events").filter("event_id % 3 <> 0" if late else "event_id % 5 <> 0")
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "test_").otherwise("_"), "event_type", F.get_json_object("props", "$.k"))
    return e.select(F.concat(F.lit("f"), F.col("user_id") % 9).alias("file"), name.alias("name"), F.col("event_id")).groupBy("file", "name").agg(F.max("event_id").alias("body_hash"))


SYMBOLS = """sym AS (SELECT 'f' || user_id % 9 AS file, CASE WHEN event_id % 2 = 0 THEN 'test_' ELSE '_' END || event_type || json_extract_string(props, '$.k') AS name, event_id FROM events),
o AS (SELECT file, name, max(event_id) AS h FROM sym WHERE event_id % 5 <> 0 GROUP BY ALL), n AS (SELECT file, name, max(event_id) AS h FROM sym WHERE event_id % 3 <> 0 GROUP BY ALL),
ch AS (SELECT file, name, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN n USING (file, name) WHERE o.h IS DISTINCT FROM n.h)"""


@query(f"WITH {SYMBOLS} SELECT * FROM ch")
def diff_symbols(spark: SparkSession, d: str) -> DataFrame:
    return pairs.diff_symbols(_symbols(spark, d, False), _symbols(spark, d, True))


@query(f"WITH {SYMBOLS}, g AS (SELECT name, max(file) AS from_file FROM ch WHERE change = 'delete' GROUP BY name) SELECT name, from_file, file AS to_file FROM ch JOIN g USING (name) WHERE change = 'insert' AND file <> from_file")
def symbol_moves(spark: SparkSession, d: str) -> DataFrame:
    return pairs.symbol_moves(diff_symbols(spark, d))


@query(f"WITH {SYMBOLS} SELECT file, name, CASE WHEN starts_with(name, 'test_') THEN unnest(['test_removed', 'public_api_removed']) END AS kind FROM ch WHERE change = 'delete' AND starts_with(name, 'test_')")
def pattern_violations(spark: SparkSession, d: str) -> DataFrame:
    return review.pattern_violations(_symbols(spark, d, False), _symbols(spark, d, True))


@query("""
WITH f AS (SELECT p_partkey AS path, upper(p_name) || p_partkey AS content FROM part),
l AS (SELECT c_custkey AS id, unnest(CASE c_custkey % 4 WHEN 0 THEN ['ring'] WHEN 1 THEN ['old', 'ear1'] WHEN 2 THEN ['lue'] ELSE [] END) AS word FROM customer WHERE c_custkey % 20 < 4),
h AS (SELECT DISTINCT id, path FROM l JOIN f ON contains(lower(content), word)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path) AS n FROM h)
SELECT id, path FROM r WHERE n <= 20
""")
def affected_files(spark: SparkSession, d: str) -> DataFrame:
    """Superseded titles with keywords that occur inside longer words, and one of common words alone; of the customers whose id modulo 20 is below four."""
    files = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.concat(F.upper("p_name"), F.col("p_partkey").cast("string")).alias("content"))
    title = v.pick(("Use the RING", "old API for ear1", "lue of in 12", "use the api"), F.col("c_custkey") % 4)
    return review.affected_files(table(spark, d, "customer").filter("c_custkey % 20 < 4").select(F.col("c_custkey").alias("id"), title.alias("title")), files)


@query("""
WITH r AS (SELECT o_orderkey AS request_id, o_orderkey % 4 AS agent_id, o_custkey AS project, CASE o_orderkey % 3 WHEN 0 THEN 'src/login.py' WHEN 1 THEN 'src/redis.py' ELSE 'etc/x' END AS path FROM orders),
a AS (SELECT *, agent_id <> 3 AND starts_with(path, 'src/') AS allowed FROM r),
q AS (SELECT request_id, project, CASE path WHEN 'src/login.py' THEN unnest(['auth', 'logging']) WHEN 'src/redis.py' THEN unnest(['caching', NULL]) END AS dimension FROM a WHERE allowed),
h AS (SELECT DISTINCT request_id, d.id, d.created_at FROM q JOIN bridge b ON b.project = q.project AND b.dimension = q.dimension JOIN decision d ON d.id = b.id WHERE d.valid),
t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id) AS n FROM h), l AS (SELECT request_id, list(id ORDER BY n) AS ids FROM t WHERE n <= 5 GROUP BY request_id),
u AS (SELECT project, count(*) FILTER (status = 'unresolved' AND NOT is_baseline) AS n, count(*) FILTER (status = 'deferred') AS put_off FROM contra GROUP BY project)
SELECT a.request_id, allowed, coalesce(ids, []) AS decisions, coalesce(u.n, 0) AS unresolved, coalesce(put_off, 0) AS deferred FROM a LEFT JOIN l ON l.request_id = a.request_id LEFT JOIN u ON u.project = a.project
""")
def context_for(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    path = v.pick(("src/login.py", "src/redis.py", "etc/x"), F.col("o_orderkey") % 3)
    requests = o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 4).alias("agent_id"), F.col("o_custkey").alias("project"), path.alias("path"))
    agents = spark.createDataFrame([(i, [], ["src/*"]) for i in range(3)], "agent_id long, blocked array<string>, allowed_paths array<string>")
    return review.context_for(requests, v.decisions(spark, d), v.bridge(spark, d), v.contradictions(spark, d), agents)


@query("SELECT project, id, 'DEFERRED CONTRADICTION: Decision ' || a_id || ' vs Decision ' || b_id || '. Human has not yet decided. Proceed with caution.' AS warning FROM contra WHERE status = 'deferred'")
def deferred_warnings(spark: SparkSession, d: str) -> DataFrame:
    return review.deferred_warnings(v.contradictions(spark, d), v.decisions(spark, d))


@query("""
WITH s AS (SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY confidence DESC, id) AS k FROM decision), t AS (SELECT *, CASE WHEN k <= 2 THEN 'always' WHEN k <= 6 THEN 'auto' ELSE 'on-demand' END AS tier FROM s),
f AS (SELECT c_custkey AS project, 'src/' || lower(c_mktsegment) || '/' || c_custkey || '.py' AS path FROM customer)
SELECT path, id, tier FROM f JOIN t USING (project) WHERE tier = 'always' OR (tier = 'auto' AND path LIKE 'src/' || CASE WHEN id % 2 = 0 THEN 'b' ELSE 'm' END || '%')
""")
def decisions_for_file(spark: SparkSession, d: str) -> DataFrame:
    """For a file of every customer."""
    scored = v.decisions(spark, d).select("id", "project", F.col("confidence").alias("score"))
    tiers = seq.assign_tiers(scored, scored, always=2, auto=4)
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"))
    globs = scored.select("id", F.when(F.col("id") % 2 == 0, "src/b**").otherwise("src/m**").alias("pattern"))
    return matching.decisions_for_file(files, tiers, globs)


@query("SELECT l_suppkey AS contradiction_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey HAVING count(*) >= 3")
def recurring_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return agg.recurring_exceptions(table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("contradiction_id")))


@query("SELECT l_suppkey, round(100 * sum(CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS percent FROM lineitem GROUP BY l_suppkey")
def coverage_percent(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "N", "implemented").when(F.col("l_returnflag") == "A", "partial").otherwise("missing")
    return matching.coverage_percent(table(spark, d, "lineitem").select("l_suppkey", status.alias("status")), ["l_suppkey"])


@query("SELECT user_id AS grp, round(greatest(0.0, 1 - count(*) FILTER (event_type = 'error') / count(*)::DOUBLE), 6) AS score FROM events GROUP BY user_id")
def consistency_score(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("grp")).agg(F.count("*").alias("endpoints"), F.count(F.when(F.col("event_type") == "error", 1)).alias("violations"))
    return gov.consistency_score(counts)


@query("SELECT l_returnflag AS label, count(*) AS n, count(DISTINCT l_linestatus) AS dimensions FROM lineitem GROUP BY l_returnflag")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return agg.dataset_stats(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("dimension")))


@query("""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b4\\d{3}[\\s\\-]?\\d{4}[\\s\\-]?\\d{4}[\\s\\-]?\\d{4}\\b')) AS t FROM documents)
SELECT 'visa_like' AS pattern_name, count(*) AS n, count(DISTINCT doc_id) AS documents FROM m HAVING count(*) > 0
""")
def secret_summary(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("(" + text.CARDS[0][1] + ")"), F.lit(1))
    hits = table(spark, d, "documents").select("doc_id", F.explode(found).alias("t"), F.lit("visa_like").alias("pattern_name"))
    return gov.secret_summary(hits)


def _by_length(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a judge: equal lengths are compatible."""
    same = batch["text_a"].str.len() == batch["text_b"].str.len()
    return pd.DataFrame({"verdict": same.map({True: "compatible", False: "tension"}), "confidence": same.map({True: 0.9, False: 0.5})})


@query("SELECT a_id || '-' || b_id AS pair_id, CASE WHEN length(a_id::VARCHAR) = length(b_id::VARCHAR) THEN 'compatible' ELSE 'tension' END AS verdict, CASE WHEN length(a_id::VARCHAR) = length(b_id::VARCHAR) THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, length(a_id::VARCHAR) <> length(b_id::VARCHAR) AS needs_vote FROM pair WHERE shared_count / 3.0 >= 0.3 AND shared_count > 1")
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.candidate_pairs(v.bridge(spark, d)).select(
        F.concat_ws("-", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("pair_id"),
        F.when(F.col("shared_count") > 1, 0.5).otherwise(0.1).alias("similarity"),
        F.concat(F.lit("Decision "), "a_id").alias("text_a"),
        F.concat(F.lit("Decision "), "b_id").alias("text_b"),
    )
    return risk.score_pairs(p, _by_length)


@query("""
WITH p AS (SELECT a_id || '-' || b_id AS pair_id, a_id, length(a_id::VARCHAR) = length(b_id::VARCHAR) AS same FROM pair WHERE shared_count > 1)
SELECT pair_id, CASE WHEN same THEN 'compatible' WHEN a_id % 4 = 2 THEN 'contradiction' ELSE 'tension' END AS verdict,
  CASE WHEN same THEN 0.9 WHEN a_id % 4 = 2 THEN round(0.9 * 2 / 4.0, 3) WHEN a_id % 4 = 0 THEN round(0.8 * 2 / 4.0, 3) ELSE 0.5 END::DOUBLE AS confidence, NOT same AND a_id % 2 = 0 AS voted FROM p
""")
def settle_votes(spark: SparkSession, d: str) -> DataFrame:
    """Of every other pair three judges vote beside the first verdict, tension: two are against it, or one is with it and two tie with both."""
    p = pairs.candidate_pairs(v.bridge(spark, d)).filter("shared_count > 1")
    pair_id = F.concat_ws("-", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("pair_id")
    scored = risk.score_pairs(p.select(pair_id, F.lit(0.5).alias("similarity"), F.concat(F.lit("Decision "), "a_id").alias("text_a"), F.concat(F.lit("Decision "), "b_id").alias("text_b")), _by_length)

    def said(*votes: tuple[str, float]) -> Column:
        return F.array(*[F.struct(F.lit(n + 1).alias("round"), F.lit(verdict).alias("verdict"), F.lit(c).alias("confidence")) for n, (verdict, c) in enumerate(votes)])

    against, tied = said(("contradiction", 0.9), ("contradiction", 0.7), ("compatible", 0.9)), said(("compatible", 0.9), ("compatible", 0.7), ("tension", 0.8))
    votes = p.filter("a_id % 2 = 0").select(pair_id, F.explode(F.when(F.col("a_id") % 4 == 2, against).otherwise(tied)).alias("s")).select("pair_id", "s.*")
    return risk.settle_votes(scored, votes)


@query("""
SELECT 't' || conv_id || '-' || turn AS timestamp, 'llm_call' AS type, 'm' || conv_id % 3 AS model, turn + 10 + 5 AS input_tokens, length(text) AS output_tokens, text[1:200] AS prompt_preview FROM conversations WHERE role = 'assistant'
""")
def parse_session_logs(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as log lines: a text block inside a JSON array, with other rows and broken lines between."""
    c = table(spark, d, "conversations")
    usage = F.struct(F.col("turn").alias("input_tokens"), F.lit(10).alias("cache_creation_input_tokens"), F.lit(5).alias("cache_read_input_tokens"), F.length("text").alias("output_tokens"))
    content = F.array(F.struct(F.lit("tool").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    message = F.struct(F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), usage.alias("usage"), content.alias("content"))
    stamp = F.concat(F.lit("t"), "conv_id", F.lit("-"), "turn")
    line = F.to_json(F.struct(F.col("role").alias("type"), stamp.alias("timestamp"), message.alias("message")))
    lines = c.select(line.alias("value")).union(c.select(F.lit("{broken").alias("value")))
    return readers.parse_session_logs(lines)


@query("SELECT event_id::VARCHAR AS timestamp, event_type AS type, user_id::VARCHAR AS agent, value AS cost_usd FROM events")
def read_trace_events(spark: SparkSession, d: str) -> DataFrame:
    """Events written as trace lines, a broken line among them, and read back."""
    folder = _folder(spark)
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("timestamp"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("agent"), F.col("value").alias("cost_usd"))
    e.select(F.to_json(F.struct("*")).alias("value")).union(spark.range(1).select(F.lit("{broken").alias("value"))).write.text(folder)
    return readers.read_trace_events(spark, folder).select("timestamp", "type", "agent", "cost_usd")


@query("SELECT id, made_by, confidence, valid, project FROM decision")
def write_tables(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    o = v.decisions(spark, d).select("id", "made_by", "confidence", "valid", "project")
    # few partitions here: the driver's projects are customers, each with a handful of rows
    readers.write_tables(o.withColumn("part", F.col("project") % 16), folder, "part")
    return spark.read.parquet(folder).drop("part")


@query("SELECT l_orderkey || '-' || l_linenumber AS pair_id, CASE WHEN l_returnflag = 'R' THEN ['unknown label'] ELSE [] END AS reasons FROM lineitem")
def invalid_pair_reasons(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    label = F.when(F.col("l_returnflag") == "R", "odd").when(F.col("l_returnflag") == "A", "tension").otherwise("compatible")
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("pair_id"),
        F.lit("a").alias("decision_a"), F.lit("b").alias("decision_b"), label.alias("label"), F.lit("auth").alias("dimension"), F.lit("r").alias("reasoning"),
    )
    readers.write_pairs(rows, folder)
    return readers.invalid_pair_reasons(readers.read_pairs(spark, folder))



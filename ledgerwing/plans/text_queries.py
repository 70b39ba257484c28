"""Queries over documents, pages and conversations, and of the column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.functions import labels, text
from ledgerwing.operators import matching
from ledgerwing.plans import views as v
from ledgerwing.plans.catalog import query
from ledgerwing.session import table

RE2_API_KEY = text.REDACTIONS[4][1]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _redacted(col: str) -> str:
    for mark, pattern in text.REDACTIONS:
        col = f"regexp_replace({col}, '{_quoted(pattern)}', '{mark}', 'g')"
    return col


@query(f"SELECT doc_id, md5({_redacted('text')}) AS digest, length({_redacted('text')}) AS n_chars FROM documents")
def redact(spark: SparkSession, d: str) -> DataFrame:
    out = text.redact(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(out.cast("binary")).alias("digest"), F.length(out).cast("long").alias("n_chars"))


@query("SELECT id, left(sha256('s:' || made_by), 16) AS made_by, 'org-' || left(sha256('s:' || project), 16) AS project, confidence, decision_type, source_type, title FROM decision")
def anonymize(spark: SparkSession, d: str) -> DataFrame:
    return text.anonymize(v.decisions(spark, d), "s")


@query("SELECT project, sum(10 + (supersedes IS NOT NULL)::INT)::BIGINT AS original_fields, sum(4 + (supersedes IS NOT NULL)::INT)::BIGINT AS redacted_fields, 2 * count(*) AS hashed_identifiers FROM decision GROUP BY project")
def anonymized_fields(spark: SparkSession, d: str) -> DataFrame:
    """Of eleven columns one may be null; id, time, validity, status and what is superseded go."""
    return text.anonymized_fields(v.decisions(spark, d))


def _scan_sql(patterns: tuple[tuple[str, str], ...]) -> str:
    parts = [f"SELECT doc_id, line_number, '{n}' AS pattern_name, unnest(regexp_extract_all(line, '(?i){_quoted(p)}')) AS matched_text FROM line" for n, p in patterns]
    return f"""line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents),
hit AS ({' UNION ALL '.join(parts)})"""


@query(f"""WITH documents AS (SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'ssn 123-45-' || (1000 + doc_id % 9000) || ' mrn: 12345678' WHEN doc_id % 7 = 1 THEN chr(10) || 'DOB 1/2/1990, 555-123-4567, me@clinic.org, e11.9, NPI 1234567890' ELSE '' END AS text FROM documents),
{_scan_sql(text.PHI)} SELECT *, CASE WHEN pattern_name IN ('ssn', 'mrn') THEN 'high' ELSE 'medium' END AS severity FROM hit""")
def scan_phi(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents; two of seven end with a line of planted health data."""
    number = F.concat(F.lit("\nssn 123-45-"), (F.col("doc_id") % 9000 + 1000).cast("string"), F.lit(" mrn: 12345678"))
    planted = F.when(F.col("doc_id") % 7 == 0, number).when(F.col("doc_id") % 7 == 1, "\nDOB 1/2/1990, 555-123-4567, me@clinic.org, e11.9, NPI 1234567890").otherwise("")
    return text.scan_phi(_docs(spark, d).select("doc_id", F.concat("text", planted).alias("text")))


LUHN = """(SELECT sum(CASE WHEN i % 2 = 1 THEN x WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END) % 10 = 0 FROM (
  SELECT CAST(unnest(string_split(reverse(regexp_replace(matched_text, '\\D', '', 'g')), '')) AS INT) AS x, generate_subscripts(string_split(reverse(regexp_replace(matched_text, '\\D', '', 'g')), ''), 1) AS i))"""


@query(f"""WITH {_scan_sql(text.CARDS)} SELECT *, CASE WHEN pattern_name IN ('visa', 'mastercard', 'amex', 'track_data') THEN 'critical' ELSE 'high' END AS severity FROM hit
WHERE pattern_name NOT IN ('visa', 'mastercard', 'amex') OR {LUHN}""")
def scan_cards(spark: SparkSession, d: str) -> DataFrame:
    return text.scan_cards(_docs(spark, d))


@query("""
WITH p AS (SELECT string_split(replace(text, chr(10), ' '), '. ') AS s, doc_id FROM documents), e AS (SELECT doc_id, array_to_string(s[1:3], '. ') AS x FROM p)
SELECT doc_id, CASE WHEN x LIKE '%.' THEN x ELSE x || '.' END AS excerpt FROM e
""")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


def _contains_sql(col: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"


def _path(col: str = "url") -> Column:
    return F.regexp_extract(col, r"^[a-z]+://[^/]+(/[^?#]*)", 1)


PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"


@query(f"""SELECT page_id, CASE {' '.join(f"WHEN {_contains_sql('lower(url)', parts)} THEN '{k}'" for k, parts in labels.PATH_PARTS)}
WHEN regexp_matches(lower(url), '[^/.][^/]*\\.({'|'.join(labels.SOURCE_SUFFIXES)})$') THEN 'source' ELSE 'other' END AS category FROM pages""")
def change_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", labels.change_category(F.col("url")).alias("category"))


@query(f"""SELECT page_id, list_filter([{', '.join(f"CASE WHEN {_contains_sql('lower(url)', parts)} THEN '{k}' END" for k, parts in labels.PATH_DIMENSIONS.items())}], lambda x: x IS NOT NULL) AS dimensions FROM pages""")
def path_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", labels.path_dimensions(F.col("url")).alias("dimensions"))


@query(f"""SELECT doc_id, CASE WHEN {_contains_sql('upper(text)', labels.CRITICAL_KEYS)} THEN 'critical' WHEN {_contains_sql('upper(text)', labels.WARNING_KEYS)} THEN 'warning' ELSE 'info' END AS severity FROM documents""")
def config_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", labels.config_sensitivity(F.col("text")).alias("severity"))


_TYPE_SAMPLES = ("Architecture", " database ", "feature", "ux", "limitation", "unheard", "testing", "Compliance")
_SAMPLES_SQL = "['" + "', '".join(_TYPE_SAMPLES) + "'][CAST(o_orderkey % 8 AS INTEGER) + 1]"


@query(f"""SELECT o_orderkey AS id, CASE {' '.join(f"WHEN lower(trim({_SAMPLES_SQL})) IN ({', '.join(repr(n) for n in names)}) THEN '{k}'" for k, names in labels.TYPE_NAMES.items())} ELSE 'technical' END AS kind FROM orders""")
def normalize_type(spark: SparkSession, d: str) -> DataFrame:
    raw = v.pick(_TYPE_SAMPLES, F.col("o_orderkey") % 8)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), labels.normalize_type(raw).alias("kind"))


@query("""
SELECT id, round(CASE WHEN confidence = 0.75 THEN least(1.0, CASE source_type WHEN 'manual' THEN 0.95 WHEN 'git_pr' THEN 0.9 WHEN 'agent' THEN 0.75 WHEN 'git_commit' THEN 0.6 ELSE 0.5 END + CASE WHEN id % 2 = 0 THEN 0.05 ELSE 0 END) ELSE confidence END, 6) AS confidence FROM decision
""")
def computed_confidence(spark: SparkSession, d: str) -> DataFrame:
    o = v.decisions(spark, d)
    out = labels.computed_confidence(F.col("confidence"), F.col("source_type"), F.col("id") % 2 == 0, F.col("title"), F.col("title"))
    return o.select("id", F.round(out, 6).alias("confidence"))


@query("SELECT a_id, b_id, least(a_id::VARCHAR, b_id::VARCHAR) || '::' || greatest(a_id::VARCHAR, b_id::VARCHAR) AS pair_key FROM contra WHERE verdict = 'contradiction' AND status = 'unresolved' AND NOT is_baseline")
def actionable_pairs(spark: SparkSession, d: str) -> DataFrame:
    from ledgerwing.operators.aggregates import is_actionable

    return v.contradictions(spark, d).filter(is_actionable()).select("a_id", "b_id", labels.pair_key(F.col("b_id"), F.col("a_id")).alias("pair_key"))


_TOOLS = ("read_file", "Bash", "git_push", "my_exec_tool", "http_fetch", "path_lookup", "gitlab", "list_directory")


@query(f"""WITH t AS (SELECT event_id, ['{"', '".join(x.lower() for x in _TOOLS)}'][CAST(event_id % 8 AS INTEGER) + 1] AS n FROM events)
SELECT event_id, CASE {' '.join(f"WHEN n IN ({', '.join(repr(x) for x in names)}) THEN '{k}'" for k, names in labels.TOOLS.items())} {' '.join(f"WHEN {_contains_sql('n', parts)} THEN '{k}'" for k, parts in labels.TOOL_PARTS)} ELSE 'external' END AS category FROM t""")
def tool_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", labels.tool_category(v.pick(_TOOLS, F.col("event_id") % 8)).alias("category"))


_OPERATIONS = ("commit", "force_push", "branch_delete", "rebase", "reset_hard", "stash", "unknown")


@query(f"""WITH t AS (SELECT event_id, ['{"', '".join(_OPERATIONS)}'][CAST(event_id % 7 AS INTEGER) + 1] AS n FROM events)
SELECT event_id, CASE {' '.join(f"WHEN n IN ({', '.join(repr(x) for x in ops)}) THEN '{k}'" for k, ops in labels.OPERATION_SEVERITY.items())} ELSE 'info' END AS severity FROM t""")
def git_severity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", labels.git_severity(v.pick(_OPERATIONS, F.col("event_id") % 7)).alias("severity"))


_MODELS = ("claude-opus-4", "claude-haiku-x", "gpt-4o-mini", "gpt-4-turbo", "unknown")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, ['{"', '".join(_MODELS)}'][CAST(l_partkey % 5 AS INTEGER) + 1] AS m, l_partkey AS i, l_suppkey AS o FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE {' '.join(f"WHEN contains(m, '{p}') THEN (i * {a}::DOUBLE + o * {b}::DOUBLE) / 1000000.0 + 1e-9" for p, a, b in labels.PRICES)} ELSE 0 END, 6) AS cost FROM t""")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    cost = labels.token_cost(v.pick(_MODELS, F.col("l_partkey") % 5), F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.when(cost > 0, cost + 1e-9).otherwise(cost), 6).alias("cost"))


_SIGNALS = ("file_changes", "dependency_added", "cost_spike", "scope_creep", "other")


@query(f"""WITH t AS (SELECT event_id, ['{"', '".join(_SIGNALS)}'][CAST(event_id % 5 AS INTEGER) + 1] AS n FROM events)
SELECT event_id, CASE {' '.join(f"WHEN n IN ({', '.join(repr(x) for x in names)}) THEN '{k}'" for k, names in labels.SIGNAL_EVENTS.items())} ELSE 'pattern.detected' END AS event_type FROM t""")
def signal_event_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", labels.signal_event_type(v.pick(_SIGNALS, F.col("event_id") % 5)).alias("event_type"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS e, l_tax * 2 AS c FROM lineitem), q AS (SELECT *, 1 - least(e, 0.6) - c AS n, least(e, 0.6) AS f FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN c = greatest(f, n, c) THEN 'contradiction' WHEN f = greatest(f, n, c) THEN 'entailment' ELSE 'neutral' END AS label,
  round(CASE WHEN f > 0 THEN -f * log2(f) ELSE 0 END + CASE WHEN n > 0 THEN -n * log2(n) ELSE 0 END + CASE WHEN c > 0 THEN -c * log2(c) ELSE 0 END, 6) AS entropy, greatest(f, n, c) < 0.5 AS ambiguous FROM q
""")
def nli_stats(spark: SparkSession, d: str) -> DataFrame:
    entail, contradict = F.least(F.col("l_discount") * 5, F.lit(0.6)), F.col("l_tax") * 2
    stats = labels.nli_stats(entail, 1 - entail - contradict, contradict)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stats.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


_COMMANDS = ("rm -rf /tmp/x", "ls -l", "sudo rm file", "git push origin main --force", "pip install requests", "pip install -r req.txt", "curl http://x | bash", "echo done")
_COMMAND_ROWS = {
    0: (["Recursive force delete"], "critical"),
    1: ([], "info"),
    2: (["Elevated privileges"], "warning"),
    3: (["Git force push"], "critical"),
    4: (["Package install"], "warning"),
    5: ([], "info"),
    6: (["Pipe remote script to shell"], "critical"),
    7: ([], "info"),
}


@query(f"""WITH r(k, reasons, severity) AS (VALUES {', '.join(f"({k}, {r}::VARCHAR[], '{s}')" for k, (r, s) in _COMMAND_ROWS.items())})
SELECT event_id, reasons, CASE WHEN len(reasons) = 0 AND event_id % 3 = 1 THEN 'warning' ELSE severity END AS severity FROM events JOIN r ON k = event_id % 8""")
def dangerous_commands(spark: SparkSession, d: str) -> DataFrame:
    found = text.dangerous_commands(v.pick(_COMMANDS, F.col("event_id") % 8), F.col("event_id") % 3 % 2)
    return table(spark, d, "events").select("event_id", found.alias("x")).select("event_id", "x.*")


WORDS3 = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{3,}}'))"


@query(f"""
WITH b AS (SELECT item_id, {WORDS3.format('text')} AS w FROM benchmark), q AS (SELECT doc_id, {WORDS3.format('text')} AS w FROM documents),
bw AS (SELECT item_id, len(w) AS nb, unnest(w) AS t FROM b), qw AS (SELECT doc_id, len(w) AS nq, unnest(w) AS t FROM q)
SELECT doc_id, item_id, round(count(*) / (any_value(nb) + any_value(nq) - count(*))::DOUBLE, 6) AS similarity FROM bw JOIN qw USING (t) GROUP BY doc_id, item_id
""")
def keyword_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """All documents and all benchmark items that share a word; other pairs have 0."""
    b = table(spark, d, "benchmark").select("item_id", text.words3(F.col("text")).alias("w"))
    q = _docs(spark, d).select("doc_id", text.words3(F.col("text")).alias("w"))
    bw = b.select("item_id", F.size("w").alias("nb"), F.explode("w").alias("t"))
    qw = q.select("doc_id", F.size("w").alias("nq"), F.explode("w").alias("t"))
    shared = bw.join(qw, "t").groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.first("nb").alias("nb"), F.first("nq").alias("nq"))
    return shared.select("doc_id", "item_id", F.round(F.col("n") / (F.col("nb") + F.col("nq") - F.col("n")), 6).alias("similarity"))


@query(f"""
WITH b AS (SELECT item_id, {WORDS3.format('text')} AS w FROM benchmark), q AS (SELECT doc_id, {WORDS3.format('text')} AS w FROM documents),
bw AS (SELECT item_id, unnest(w) AS t FROM b), qw AS (SELECT doc_id, unnest(w) AS t FROM q),
c AS (SELECT item_id, doc_id, count(*) AS n FROM bw JOIN qw USING (t) GROUP BY ALL),
s AS (SELECT item_id, doc_id, n / (len(b.w) + len(q.w) - n)::DOUBLE AS j FROM c JOIN b USING (item_id) JOIN q USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) AS k FROM s)
SELECT b.item_id, doc_id AS best_id, round(coalesce(j, 0.0), 6) AS score, CASE WHEN j >= 0.6 THEN 'implemented' WHEN j >= 0.3 THEN 'partial' ELSE 'not_started' END AS status FROM b LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (item_id)
""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    reqs = table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("r"))
    return matching.coverage(reqs, _docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "item_id", "r", "id", "text")


@query("""
WITH docs AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '## Part ' || doc_id || chr(10) || '1. first thing' || chr(10) || '- x' || chr(10) || 'It runs. You must stop! We require more? No.' ELSE '' END AS text FROM documents),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM docs),
l AS (SELECT doc_id, line_number, trim(line) AS line, regexp_matches(trim(line), '^#{1,6}\\s+.+$') AS header FROM line),
s AS (SELECT *, coalesce(last_value(CASE WHEN header THEN trim(regexp_replace(line, '^#{1,6}\\s+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number ROWS UNBOUNDED PRECEDING), '') AS section FROM l),
f AS (SELECT doc_id, line_number, section, CASE WHEN header THEN [] WHEN regexp_matches(line, '^(\\d+[.)]|[-*])\\s+.+$') THEN [trim(regexp_replace(line, '^(\\d+[.)]|[-*])\\s+', ''))]
  ELSE list_transform(list_filter(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '(?i)\\b(must|shall|should|will|need to|require)\\b')), lambda x: trim(x)) END AS found FROM s),
e AS (SELECT doc_id, line_number, section, unnest(found) AS requirement, generate_subscripts(found, 1) AS part FROM f)
SELECT doc_id, line_number, CAST(part AS INT) AS part, section, requirement FROM e WHERE length(requirement) >= 5
""")
def extract_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents; every fifth ends with a planted section of items and sentences."""
    planted = F.concat(F.lit("\n## Part "), F.col("doc_id").cast("string"), F.lit("\n1. first thing\n- x\nIt runs. You must stop! We require more? No."))
    return text.extract_requirements(_docs(spark, d).select("doc_id", F.concat("text", F.when(F.col("doc_id") % 5 == 0, planted).otherwise("")).alias("text")))


_ROUTES = ("/a/{id}/", "/a/:name/b", "/x/<int:k>", "/plain")


@query("SELECT event_id, ['/a/{param}', '/a/{param}/b', '/x/{param}', '/plain'][CAST(event_id % 4 AS INTEGER) + 1] AS route FROM events")
def normalize_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.normalize_route(v.pick(_ROUTES, F.col("event_id") % 4)).alias("route"))


@query("""
WITH r(dimension, kind, pattern, weight) AS (VALUES ('database', 'keyword', 'THE', 0.5), ('database', 'regex', '[0-9]{3}', 0.25), ('auth', 'keyword', 'der', 1.0), ('auth', 'regex', '\\bTH[ae]', 0.125), ('logging', 'glob', 'Th*. To', 2.0), ('logging', 'glob', 'a+*', 4.0), ('logging', 'other', 'the', 9.0))
SELECT doc_id, dimension, round(sum(weight), 6)::DOUBLE AS score FROM documents, r
WHERE CASE kind WHEN 'keyword' THEN contains(lower(text), lower(pattern)) WHEN 'regex' THEN regexp_matches(text, '(?i)' || pattern) WHEN 'glob' THEN regexp_matches(text, CASE WHEN weight = 2.0 THEN '(?i)Th.*\\. To' ELSE '(?i)a\\+.*' END) ELSE false END GROUP BY ALL
""")
def auto_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = [("database", "keyword", "THE", 0.5), ("database", "regex", "[0-9]{3}", 0.25), ("auth", "keyword", "der", 1.0), ("auth", "regex", r"\bTH[ae]", 0.125), ("logging", "glob", "Th*. To", 2.0), ("logging", "glob", "a+*", 4.0), ("logging", "other", "the", 9.0)]
    return text.auto_detect(_docs(spark, d), spark.createDataFrame(rows, "dimension string, kind string, pattern string, weight double"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'tension' END AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS confidence, o_orderkey % 3 = 0 AS valid FROM orders WHERE o_orderkey % 3 <> 1
UNION ALL SELECT o_orderkey, 'odd', 0.5, false FROM orders WHERE o_orderkey % 3 = 1
""")
def parse_verdict(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    good = F.format_string('```json\n{"reasoning": "r", "verdict": "tension", "confidence": %s, "evidence_a": "a", "evidence_b": "b"}\n```', ((F.col("o_orderkey") % 10) / 10.0).cast("string"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, good).when(F.col("o_orderkey") % 3 == 1, F.lit('{"verdict": "odd", "confidence": 0.5}')).otherwise(F.lit("no answer"))
    return o.select(F.col("o_orderkey").alias("id"), text.parse_verdict(raw).alias("x")).select("id", "x.*")


@query("""
WITH a AS (SELECT user_id, list_distinct(string_split(lower('fix error then view'), ' ')) AS t, list_distinct(list(event_type)) AS f FROM events GROUP BY user_id)
SELECT user_id, round(len(list_intersect(t, f)) / len(t)::DOUBLE, 6) AS overlap, len(list_intersect(t, f)) / len(t)::DOUBLE < 0.3 AS creep FROM a
""")
def scope_creep(spark: SparkSession, d: str) -> DataFrame:
    from ledgerwing.operators.sequences import word_overlap

    done = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), " ").alias("done"))
    overlap = word_overlap(F.lit("fix error then view"), F.col("done"))
    return done.select("user_id", F.round(overlap, 6).alias("overlap"), (overlap < 0.3).alias("creep"))


@query("""
SELECT page_id, NOT contains(url, '/de/') AND (contains(url, '.com/') OR contains(url, '.org/')) AS allowed FROM pages
""")
def path_access(spark: SparkSession, d: str) -> DataFrame:
    blocked, allowed = F.array(F.lit("*/de/*")), F.array(F.lit("*.com/*"), F.lit("*.org/*"))
    return table(spark, d, "pages").select("page_id", labels.path_access(F.col("url"), blocked, allowed).alias("allowed"))


@query("""
WITH g AS (SELECT id, list(dimension) AS dims FROM bridge GROUP BY id)
SELECT id, NOT list_contains(dims, 'security') AND len(list_filter(dims, lambda x: x IN ('auth', 'caching', 'logging', 'testing', 'database', 'messaging'))) = len(dims) AS allowed FROM g
""")
def dimension_access(spark: SparkSession, d: str) -> DataFrame:
    dims = v.bridge(spark, d).groupBy("id").agg(F.collect_set("dimension").alias("dims"))
    allowed = F.array(*[F.lit(x) for x in ("auth", "caching", "logging", "testing", "database", "messaging")])
    return dims.select("id", labels.dimension_access(F.col("dims"), F.array(F.lit("security")), allowed).alias("allowed"))


@query("""
WITH a AS (SELECT user_id, list_distinct(string_split('fix the purchase error in user' || user_id % 3 || ' then stop', ' ')) AS t, list_distinct(list(event_type) || list('user' || event_id % 40)) AS f FROM events WHERE event_id % 9 = 0 GROUP BY user_id)
SELECT user_id, round(len(list_intersect(t, f)) / len(t)::DOUBLE, 6) AS overlap, len(list_intersect(t, f)) / len(t)::DOUBLE < 0.2 AS drifted FROM a
""")
def intent_drift(spark: SparkSession, d: str) -> DataFrame:
    from ledgerwing.operators.sequences import intent_drift as operator

    tasks = table(spark, d, "events").select(F.col("user_id").alias("agent_id")).distinct().withColumn("task", F.format_string("Fix the purchase error in user%s THEN stop", F.col("agent_id") % 3))
    actions = table(spark, d, "events").filter("event_id % 9 = 0").select(F.col("user_id").alias("agent_id"), F.concat(F.upper("event_type"), F.lit("  user"), (F.col("event_id") % 40).cast("string")).alias("action"))
    return operator(tasks, actions).select(F.col("agent_id").alias("user_id"), "overlap", "drifted")

"""Queries of readers over what Spark has written from the given tables, and of rules over source files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ledgerwing.functions import code, labels, text
from ledgerwing.plans import stream_queries
from ledgerwing.plans import views as v
from ledgerwing.plans.catalog import query
from ledgerwing.session import shared_folder, table
from ledgerwing.sources import readers
from ledgerwing.sources.snapshots import SnapshotStore
from ledgerwing.streaming import monitors


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


#: Files that a task writes, and moves to their place when it is done.
FILES_A_TASK = 250


def _one_a_file(rows: DataFrame) -> DataFrameWriter:
    """A writer of a file for each row: tasks share the rows and move their own files, not the driver all of them."""
    tasks = max(1, -(-rows.count() // FILES_A_TASK))
    return rows.repartition(tasks).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def _documents(rows: DataFrame, folder: str) -> str:
    """One JSON document a file."""
    _one_a_file(rows).json(folder)
    return folder


@query("SELECT 's' || s_suppkey AS id, s_name AS title, [CASE WHEN s_suppkey % 2 = 0 THEN 'auth' ELSE 'caching' END] AS dimensions, s_suppkey % 3 > 0 AS valid FROM supplier")
def read_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    rows = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.array(F.when(F.col("s_suppkey") % 2 == 0, "auth").otherwise("caching")).alias("dimensions"), (F.col("s_suppkey") % 3 > 0).alias("valid"))
    nameless = s.filter("s_suppkey % 7 = 0").select(F.col("s_name").alias("title"))
    found = readers.read_decisions(spark, _documents(rows.unionByName(nameless, allowMissingColumns=True), _folder(spark)))
    return found.select("id", "title", "dimensions", "valid")


@query("SELECT 'c' || s_suppkey AS id, 's' || s_suppkey AS decision_a_id, 's' || s_nationkey AS decision_b_id, 'tension' AS verdict, round(s_acctbal, 2) AS confidence FROM supplier")
def read_contradictions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("c"), key).alias("id"), F.concat(F.lit("s"), key).alias("decision_a_id"), F.concat(F.lit("s"), "s_nationkey").alias("decision_b_id"), F.lit("tension").alias("verdict"), F.round("s_acctbal", 2).alias("confidence"))
    return readers.read_contradictions(spark, _documents(rows, _folder(spark))).select("id", "decision_a_id", "decision_b_id", "verdict", "confidence")


@query("SELECT 'a' || s_suppkey AS id, 'temporal' AS category, 'src/' || s_name || '.py' AS file, CAST(s_nationkey AS INT) AS line FROM supplier")
def read_assumptions(spark: SparkSession, d: str) -> DataFrame:
    evidence = F.array(F.struct(F.concat(F.lit("src/"), "s_name", F.lit(".py")).alias("file"), F.col("s_nationkey").alias("line")))
    rows = table(spark, d, "supplier").select(F.concat(F.lit("a"), "s_suppkey").alias("id"), F.lit("temporal").alias("category"), evidence.alias("code_evidence"))
    found = readers.read_assumptions(spark, _documents(rows, _folder(spark)))
    return found.select("id", "category", F.explode("code_evidence").alias("e")).select("id", "category", "e.file", "e.line")


@query("SELECT 't' || s_suppkey AS token, 'n' || s_nationkey AS project, ['s' || s_suppkey] AS decision_ids, CAST(s_suppkey % 5 AS INT) AS context_loads FROM supplier")
def read_sessions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("t"), key).alias("token"), F.concat(F.lit("n"), "s_nationkey").alias("project"), F.array(F.concat(F.lit("s"), key)).alias("decision_ids"), (key % 5).alias("context_loads"))
    return readers.read_sessions(spark, _documents(rows, _folder(spark))).select("token", "project", "decision_ids", "context_loads")


def _trace_lines(spark: SparkSession, d: str) -> str:
    folder = _folder(spark)
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("timestamp"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("agent"), F.col("value").alias("cost_usd"))
    e.write.json(folder)
    return folder


@query("SELECT event_id::VARCHAR AS timestamp, event_type AS type, user_id::VARCHAR AS agent, value AS cost_usd FROM events")
def stream_trace_events(spark: SparkSession, d: str) -> DataFrame:
    """The trace lines as a file stream, every line once."""
    lines = readers.stream_trace_events(spark, _trace_lines(spark, d))
    return stream_queries.finished(spark, lines).select("timestamp", "type", "agent", "cost_usd")


@query("""
SELECT CASE event_id % 6 WHEN 0 THEN 'spans' WHEN 1 THEN 'edges' WHEN 2 THEN 'tool_calls' WHEN 3 THEN 'shell' WHEN 4 THEN 'vcs' ELSE 'reads' END AS kind, count(*) AS n, count(DISTINCT user_id) AS agents FROM events GROUP BY ALL
""")
def read_observation(spark: SparkSession, d: str) -> DataFrame:
    """Events written as six kinds of observation lines and read back by kind; edges name agents by their source."""
    folder, e = _folder(spark), table(spark, d, "events")
    ids = {"spans": "span_id", "edges": "target_span_id", "tool_calls": "call_id", "shell": "execution_id", "vcs": "operation_id", "reads": "read_id"}
    agents = {kind: "source_span_id" if kind == "edges" else "agent_id" for kind in ids}
    for n, (kind, key) in enumerate(ids.items()):
        e.filter(F.col("event_id") % 6 == n).select(F.col("event_id").cast("string").alias(key), F.col("user_id").cast("string").alias(agents[kind])).write.json(f"{folder}/{kind}")
    out = None
    for kind, rows in readers.read_observation(spark, folder).items():
        part = rows.filter(F.col(ids[kind]).isNotNull()).select(F.lit(kind).alias("kind"), F.col(agents[kind]).alias("agent"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("agent").alias("agents"))


def _tree(spark: SparkSession, d: str) -> str:
    """A file for each supplier, and for each nation one in a folder that readers pass over."""
    folder = _folder(spark)
    body = F.concat(F.lit("import "), F.regexp_replace(F.lower("s_name"), "#", "_"))
    _one_a_file(table(spark, d, "supplier").select(body.alias("value"))).text(f"{folder}/src")
    table(spark, d, "nation").select("n_name").write.option("maxRecordsPerFile", 1).text(f"{folder}/node_modules")
    return folder


@query("SELECT 'import ' || replace(lower(s_name), '#', '_') || chr(10) AS source, 'src' AS top FROM supplier")
def read_source_tree(spark: SparkSession, d: str) -> DataFrame:
    tree = readers.read_source_tree(spark, _tree(spark, d), ("txt",))
    return tree.select("source", F.regexp_extract("path", r"^([^/]+)/", 1).alias("top"))


@query("""
SELECT sha256('import ' || replace(lower(s_name), '#', '_') || chr(10)) AS content_hash, CAST(strlen(s_name) + 8 AS BIGINT) AS size FROM supplier UNION ALL SELECT sha256(n_name || chr(10)), CAST(strlen(n_name) + 1 AS BIGINT) FROM nation
""")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    found = readers.snapshot(spark, _tree(spark, d))
    return found.filter(F.col("path").endswith(".txt")).select("content_hash", "size")


@query("""
SELECT 'decisions' AS name, count(*) AS n, count(*) AS sound FROM decision UNION ALL SELECT 'contradictions', count(*), count(*) FROM contra UNION ALL SELECT 'audit', count(*), count(*) FROM audit
""")
def evidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The bundle's tables read back, each row's digest computed again."""
    folder = _folder(spark)
    readers.evidence_bundle(v.decisions(spark, d), v.contradictions(spark, d), v.audit_log(spark, d), folder)
    out = None
    for name in ("decisions", "contradictions", "audit"):
        part = spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("n"), F.count_if(F.col("digest") == F.sha2(F.col("entry").cast("binary"), 256)).alias("sound")).select(F.lit(name).alias("name"), "n", "sound")
        out = part if out is None else out.unionByName(part)
    return out


#: Configuration files: name, text, and (rule, line number, resource) of each finding.
INFRA = (
    ("main.tf", 'password = "hunter22"\n  token = "x"\nactions = ["*"]\ninstance_type = "m5.24xlarge"\ninstance_type = "t3.small"\npublicly_accessible = TRUE', (("hardcoded_credential", 1, ""), ("wildcard_action", 3, ""), ("large_instance", 4, "m5.24xlarge"), ("public_access", 6, ""))),
    ("Dockerfile", "from Ubuntu:22.04\nFROM debian:slim\nUSER root\nADD https://z/k /k\nADD k /k", (("large_base", 1, "ubuntu:22.04"), ("root_user", 3, ""), ("remote_add", 4, ""))),
    ("k8s/pod.yaml", "image: web:latest\n  privileged: true\nhostNetwork: true\nresources:\n" + "a: 1\n" * 9 + "limits: 1\nresources:\n" + "a: 1\n" * 10 + "limits: 2", (("latest_image", 1, ""), ("privileged", 2, ""), ("host_network", 3, ""), ("no_limits", 15, ""))),
    (".github/workflows/ci.yml", "- uses: a/b@main\n- uses: a/c\n  run: Echo ${{ secrets.KEY }}\n  key: ${{ secrets.KEY }}", (("unpinned_action", 2, "a/c"), ("echoed_secret", 3, ""))),
    ("app.py", 'password = "hunter22"', ()),
    ("api/Dockerfile.dev", "FROM alpine:3\nUSERS x", (("no_user", 0, ""),)),
    ("x.yml", "apiVersion: v1\nkind: Pod\nhostNetwork: true", (("host_network", 3, ""),)),
)


def _by_event(spark: SparkSession, d: str, names: tuple[str, ...], sources: tuple[str, ...]) -> DataFrame:
    """A file for each event, of as many kinds as there are names."""
    k = F.col("event_id") % len(names)
    path: Column = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("/"), v.pick(names, k))
    return table(spark, d, "events").select(path.alias("path"), v.pick(sources, k).alias("source"))


_INFRA = ", ".join(f"({k}, '{name}', '{rule}', {line}, '{resource}')" for k, (name, _, found) in enumerate(INFRA) for rule, line, resource in found)


@query(f"""WITH r(k, name, rule, line_number, resource) AS (VALUES {_INFRA})
SELECT 'e' || event_id || '/' || name AS path, rule, line_number, resource FROM events JOIN r ON k = event_id % {len(INFRA)}""")
def scan_infra(spark: SparkSession, d: str) -> DataFrame:
    files = _by_event(spark, d, tuple(x[0] for x in INFRA), tuple(x[1] for x in INFRA))
    return code.scan_infra(files).select("path", "rule", "line_number", "resource")


ASYNC = ("async def f():\n    await x\ndef g():\n    await y\n    return 1", "def f():\n    return 1", "async def f():\n    await x\n    await y")


@query("SELECT 'e' || event_id || '/a.py' AS path, 4 AS line_number FROM events WHERE event_id % 3 = 0")
def await_in_sync(spark: SparkSession, d: str) -> DataFrame:
    return code.await_in_sync(_by_event(spark, d, ("a.py",) * 3, ASYNC)).select("path", "line_number")


ROUTES = (
    '@app.get("/a/{id}/")\ndef f(id: int,\n      x) -> HTMLResponse:\n    raise HTTPException(404)\n    return X(status_code=201)\n@router.post("/b/<int:k>")\nasync def g(k) -> str: pass\nraise HTTPException(500)\ndef other():\n    raise HTTPException(409)',
    "x = 1",
    '@app.route("/c/<name>", methods=["GET", "PUT"])\ndef h(): pass\n@bp.route("/d")\ndef i(): pass\n@api.get("/e")\n@router.head("/f")\n\n\n\n\ndef k() -> str: pass',
)


@query("""
WITH r(k, line_number, method, route, response_type, status_codes, parameters) AS (VALUES (0, 1, 'GET', '/a/{id}/', 'html', '200,201,404', 'id'), (0, 6, 'POST', '/b/<int:k>', 'text', '200,500', 'k'),
  (2, 1, 'GET', '/c/<name>', 'json', '', 'name'), (2, 1, 'PUT', '/c/<name>', 'json', '', 'name'), (2, 3, 'GET', '/d', 'json', '', ''), (2, 6, 'HEAD', '/f', 'json', '200', ''))
SELECT 'e' || event_id || '/a.py' AS path, r.* EXCLUDE (k) FROM events JOIN r ON k = event_id % 3
""")
def extract_endpoints(spark: SparkSession, d: str) -> DataFrame:
    found = text.extract_endpoints(_by_event(spark, d, ("a.py",) * 3, ROUTES))
    lists = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("status_codes", "parameters")]
    return found.select("path", "line_number", "method", "route", "response_type", *lists)


SPECS = ("Requests[socks]>=2.0; python_version > '3'", "  numpy", "my.pkg_x==1", "-r other.txt", "Django ~= 4")


@query("SELECT event_id, ['requests', 'numpy', 'my.pkg_x', '', 'django'][CAST(event_id % 5 AS INT) + 1] AS package FROM events")
def package_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.package_name(v.pick(SPECS, F.col("event_id") % 5)).alias("package"))


DIFF = ("+requests>=2", "-flask==1", '+  "numpy",', "+++ b/setup.py", " django", "+Pandas")


@query("SELECT DISTINCT user_id AS doc_id, CASE event_id % 6 WHEN 0 THEN 'requests' ELSE 'pandas' END AS package FROM events WHERE event_id % 6 IN (0, 5)")
def new_deps(spark: SparkSession, d: str) -> DataFrame:
    return text.new_deps(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), v.pick(DIFF, F.col("event_id") % 6).alias("line")))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS day, count(*) AS n FROM event GROUP BY ALL")
def with_lateness(spark: SparkSession, d: str) -> DataFrame:
    """Days counted behind a watermark, as the stream's last update leaves them; no event of one batch is late."""

    def days(s: DataFrame) -> DataFrame:
        return monitors.with_lateness(s).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")

    return stream_queries.run(spark, d, days, "update").groupBy("day").agg(F.max("n").alias("n"))


@query("SELECT event_id, concat_ws('::', event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'f' || user_id || '.py' END, repeat(json_extract_string(props, '$.k') || '-', 60)[1:80]) AS dedup_key FROM events")
def dedup_key(spark: SparkSession, d: str) -> DataFrame:
    """The first file alone counts, and the first 80 characters of a summary."""
    files = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("f"), "user_id", F.lit(".py")), F.lit("other.py")))
    summary = F.repeat(F.concat(F.get_json_object("props", "$.k"), F.lit("-")), 60)
    return table(spark, d, "events").select("event_id", labels.dedup_key(F.col("event_type"), files, summary).alias("dedup_key"))


@query("""
SELECT 1 AS version, s_nationkey || '.txt' AS path, true AS hashed, sha256(string_agg(s_name, ',' ORDER BY s_suppkey)) AS content_hash FROM supplier GROUP BY s_nationkey
UNION ALL SELECT 2, s_nationkey || '.txt', s_nationkey % 3 = 0, sha256(string_agg(s_name, ',' ORDER BY s_suppkey) || CASE WHEN s_nationkey % 3 = 0 THEN '!' ELSE '' END) FROM supplier GROUP BY s_nationkey
""")
def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a tree with a file for each nation's suppliers; between them every third file is written anew."""
    folder = _folder(spark)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]), ",")
    files = table(spark, d, "supplier").groupBy("s_nationkey").agg(names.alias("value"))
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store = SnapshotStore(spark, f"{folder}/store")

    def write(rows: DataFrame) -> None:
        for r in rows.collect():  # a file a nation
            out = system.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/tree/{r['s_nationkey']}.txt"), True)
            out.write(bytearray(r["value"].encode()))
            out.close()

    write(files)
    versions = [store.take(f"{folder}/tree")]
    write(files.filter("s_nationkey % 3 = 0").withColumn("value", F.concat("value", F.lit("!"))))
    versions.append(store.take(f"{folder}/tree"))
    first, second = [store.load(n).select(F.lit(n).alias("version"), "path", "hashed", "content_hash") for n in versions]
    return first.unionByName(second)

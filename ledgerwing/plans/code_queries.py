"""Queries of the line rules over the text tables, which stand in for source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.functions import assumptions, code, text
from ledgerwing.plans import views as v
from ledgerwing.plans.catalog import query
from ledgerwing.session import table

PAGE_RULES = (
    code.LineRule("script", r"<script>", "warning", "security"),
    code.LineRule("track", r"track\(\d+\)", "low", "privacy"),
)


@query("""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS line_number FROM pages),
r(rule, category, severity, pattern) AS (VALUES ('script', 'security', 'warning', '<script>'), ('track', 'privacy', 'low', 'track\\(\\d+\\)'))
SELECT page_id, line_number, rule, category, severity, trim(line) AS line FROM l, r WHERE regexp_matches(line, pattern)
""")
def scan_lines(spark: SparkSession, d: str) -> DataFrame:
    return code.scan_lines(table(spark, d, "pages"), PAGE_RULES, "page_id", "html")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Events as small source files: one per user, a line an event."""
    line = F.format_string('%s(%s)  # %s', "event_type", F.col("value").cast("string"), "props")
    header = F.format_string("import m%s\nfrom app.%s import x\n\ndef handle_%s():\n", F.col("user_id") % 7, "event_type", F.col("event_id"))
    body = F.when(F.col("event_id") % 4 == 0, F.concat(header, F.lit("    limit = 100\n    "), line)).otherwise(F.concat(F.lit("    "), line))
    first = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", body.alias("b")))).alias("x"))
    path = F.format_string("svc%s/f%s.py", F.col("user_id") % 5, F.col("user_id"))
    return first.select("user_id", path.alias("path"), F.array_join(F.transform("x", lambda e: e["b"]), "\n").alias("source"))


@query("""
SELECT DISTINCT 'svc' || user_id % 5 || '/f' || user_id || '.py' AS path, unnest(['m' || user_id % 7, 'app.' || event_type]) AS module FROM events WHERE event_id % 4 = 0
""")
def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return text.extract_imports(_files(spark, d)).distinct()


@query("SELECT 'svc' || user_id % 5 || '/f' || user_id || '.py' AS path, 'function' AS kind, 'handle_' || event_id AS name FROM events WHERE event_id % 4 = 0")
def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    return text.extract_symbols(_files(spark, d)).select("path", "kind", "name")


#: Small source files, and the (line, rule, what the summary tells of the match) of each finding in them.
SNIPPETS = (
    ('cur.run("""x""")\nq = "INSERT INTO users VALUES (1)"\nd = datetime(2024, 1, 5)', ((2, "single_source_write", "Write to users found"), (3, "hardcoded_date", "'datetime(2024, 1, 5'"))),
    ("q = \"SELECT id FROM\n  orders WHERE kind = 'a-b'\"\n# role == 'x'\nif role == 'admin':\n    pass", ((1, "single_table_query", "table orders without"), (1, "no_multitenancy", "DB query"), (2, "narrow_where_clause", "WHERE clause"), (4, "single_role_access", "'admin'"))),
    ("q = 'SELECT id FROM a JOIN b' + tenant_id\nrows = q.all()\nx = d['key']\ny = d.get('key') or e['k']", ((2, "no_pagination", "'.all()'"), (3, "no_null_handling", "'key'"))),
    ("try:\n    f()\nexcept ValueError as e:\n    pass\nexcept:\n    raise", ((3, "no_error_path", "Bare except"),)),
    ("class A(str, Enum):\n    ONE = 1\n\n    TWO = 2\nclass B(Enum):\n    A = 1\n    B = 2\n    C = 3\n    D = 4", ((1, "incomplete_enum", "'class A(str, Enum)'"),)),
    ("if a == 'x':\n    f()\n# other\nelif b:\n    g()\nz = 1\nif a == 'y':\n    f()\nelif b:\n    g()\nelse:\n    h()\nif a == 'z':\n    f()", ((1, "incomplete_enum", "check 'if a =="),)),
    ("a = os.getenv('HOME')\nb = os.getenv('A', 'b')\nc = os.environ['C']\np = '/tmp/x'\nport = 5432\nport = 1234", ((1, "env_no_fallback", "'HOME'"), (3, "env_no_fallback", "'C'"), (3, "no_null_handling", "'C'"), (4, "hardcoded_path", "'/tmp/x'"), (5, "hardcoded_port", "port 5432"))),
    ("class T(Base):\n    __tablename__ = 'tees'\n    u = relationship('U')\n    v = relationship('V', lazy='joined')\n    w = ForeignKey('w.id')\n    k = models.ForeignKey(W, on_delete=CASCADE)", ((2, "hardcoded_table_name", "'tees'"), (3, "orm_no_loading_strategy", "relationship()"), (5, "no_cascade_behavior", "ForeignKey without"))),
    ("from flask.globals import g\n@app.get('/items')\nasync def f(): pass\ndb.session.commit()", ((1, "framework_version_dep", "'from flask.globals'"), (2, "single_endpoint", "'/items'"), (4, "no_migration_check", "DB write"))),
    ("import alembic\ndb.session.commit()\n'''\n@login_required\n'''\n@login_required", ((6, "single_role_access", "'@login_required'"),)),
    ("x = 1", ()),
)


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    """Rules cost far more than reading, so rows are dealt evenly before they become files, four tasks a core."""
    k = F.col("event_id") % len(SNIPPETS)
    path = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 13 == 0, "/tests/a.py").otherwise("/a.py"))
    dealt = table(spark, d, "events").select("event_id").repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.select(path.alias("path"), v.pick(tuple(s for s, _ in SNIPPETS), k).alias("source"))


_FOUND = ", ".join(f"({k}, {line}, '{rule}')" for k, (_, found) in enumerate(SNIPPETS) for line, rule, _ in found)


@query(f"""WITH f(k, line_number, rule) AS (VALUES {_FOUND})
SELECT 'e' || event_id || '/a.py' AS path, line_number, rule, true AS told FROM events JOIN f ON k = event_id % {len(SNIPPETS)} WHERE event_id % 13 <> 0""")
def scan_assumptions(spark: SparkSession, d: str) -> DataFrame:
    """A file an event; those in a test folder give nothing. told: the summary holds what the snippet says of its match."""
    told = F.lit(False)
    for _, found in SNIPPETS:
        for line, rule, words in found:
            told = told | ((F.col("line_number") == line) & (F.col("rule") == rule) & F.col("summary").contains(words))
    return assumptions.scan(_snippets(spark, d)).select("path", "line_number", "rule", told.alias("told"))


@query("""WITH w AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 't' || user_id % 9 ELSE 'last' || event_id || CASE WHEN event_id % 2 = 0 THEN '_t' || user_id ELSE '' END END AS t FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0), s AS (SELECT t FROM w GROUP BY t HAVING count(*) > 1)
SELECT 'e' || event_id || '.py' AS path FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains('write to ' || w.t || ' found in one location — assumes no external write sources', s.t))""")
def lone_writers(spark: SparkSession, d: str) -> DataFrame:
    """Files whose writes to a table stay findings: the name of a table that others write too may lie inside another name."""
    n, user = F.col("event_id"), F.col("user_id")
    own = F.concat(F.lit("last"), n.cast("string"), F.when(n % 2 == 0, F.concat(F.lit("_t"), user.cast("string"))).otherwise(""))
    name = F.when(n % 6 == 0, F.concat(F.lit("t"), (user % 9).cast("string"))).otherwise(own)
    files = table(spark, d, "events").filter((n % 2 == 0) | (n % 3 == 0)).select(F.format_string("e%s.py", "event_id").alias("path"), F.concat(F.lit("UPDATE "), F.upper(name), F.lit(" SET a = 1")).alias("source"))
    writes = tuple(r for r in assumptions.RULES if r.rule == "single_source_write")
    return assumptions.drop_shared_writes(assumptions.scan(files, writes), files).select("path")


#: Source files, and what is to be found in them: line, last line, kind, name, parent, decorators.
SOURCES = (
    ("@wraps(f)\n@cached\ndef outer(a,\n          b=(1, 2)):\n    def inner():\n        return 1\n\n    return inner\nx = 1", ((3, 8, "function", "outer", "", "wraps,cached"), (5, 6, "function", "inner", "outer", ""))),
    ("class A(B, metaclass=M):\n    '''text\nclass No:\n    '''\n    @property\n    async def go(self): return [\n1]\n\n\ndef late(): pass", ((1, 7, "class", "A", "", ""), (6, 7, "function", "go", "A", "property"), (10, 10, "function", "late", "", ""))),
    ("def unfinished(a):\n  if a:\n      return 1\n  # end\nz =", ((1, 3, "function", "unfinished", "", ""),)),
    ("", ()),
)
_SYMBOLS = ", ".join(f"({k}, {a}, {b}, '{kind}', '{name}', '{parent}', '{decorators}')" for k, (_, found) in enumerate(SOURCES) for a, b, kind, name, parent, decorators in found)


@query(f"""WITH f(k, line_number, end_line, kind, name, parent, decorators) AS (VALUES {_SYMBOLS})
SELECT 'e' || event_id || '.py' AS path, f.* EXCLUDE (k) FROM events JOIN f ON k = event_id % {len(SOURCES)}""")
def symbol_bodies(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "events").select(F.format_string("e%s.py", "event_id").alias("path"), v.pick(tuple(x for x, _ in SOURCES), F.col("event_id") % len(SOURCES)).alias("source"))
    found = code.symbol_bodies(files)
    return found.select("path", "line_number", "end_line", "kind", "name", "parent", F.array_join("decorators", ",").alias("decorators"))


@query("""
SELECT DISTINCT 'svc' || user_id % 5 || '/f' || user_id || '.py' AS path, 'app.' || event_type AS module, 'svc1/ -> app.e' AS rule FROM events WHERE event_id % 4 = 0 AND user_id % 5 = 1 AND event_type LIKE 'e%'
""")
def boundary_violations(spark: SparkSession, d: str) -> DataFrame:
    layers = spark.createDataFrame([("svc1/", "app.e")], "prefix string, forbidden string")
    return code.boundary_violations(_files(spark, d), layers).distinct()


#: Bodies of small functions, and the features that each has.
BODIES = (
    ("x = 1", ()),
    ("try:\n        x = int(y)\n    except ValueError:\n        raise TypeError('x')", ("try_except", "type_conversion", "validation")),
    ("if x is None:\n        return session.get(url)\n    db.commit()", ("db_call", "http_call", "null_check", "return_early")),
    ("if not x:\n        logger.info(os.environ['A'])", ("env_access", "logging", "null_check")),
    ("return open(os.path.join(a, b)).read().decode()", ("file_io", "type_conversion")),
    ("self.log.warning(requests.x(os.getenv('B')))", ("env_access", "http_call", "logging")),
    ("assert isinstance(x, int)\n    cache.get(x)", ("validation",)),
    ("import httpx\n    raise errors.ValueError", ()),
)


@query(f"""WITH b(k, features) AS (VALUES {', '.join(f"({n}, '{','.join(tags)}')" for n, (_, tags) in enumerate(BODIES))})
SELECT 'f' || user_id || '.py' AS path, 'handle_' || event_id AS name, features FROM events JOIN b ON k = event_id % {len(BODIES)} WHERE features <> '' AND user_id % 50 <> 7""")
def function_features(spark: SparkSession, d: str) -> DataFrame:
    """A file per user, a function an event; files of every fiftieth user do not parse."""
    body = F.concat(F.lit("def handle_"), "event_id", F.lit("():\n    "), v.pick(tuple(b for b, _ in BODIES), F.col("event_id") % len(BODIES)))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", body.alias("b")))), lambda e: e["b"]), "\n\n")
    files = table(spark, d, "events").groupBy("user_id").agg(F.concat(whole, F.when(F.col("user_id") % 50 == 7, "\ndef (").otherwise("")).alias("source"))
    found = code.function_features(files.select(F.concat(F.lit("f"), "user_id", F.lit(".py")).alias("path"), "source"))
    return found.select("path", "name", F.array_join("features", ",").alias("features"))

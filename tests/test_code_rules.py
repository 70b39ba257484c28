"""Rules over source files: hits and misses of each rule, symbols against Python's own parser, keywords inside words."""

from __future__ import annotations

import ast
from pathlib import Path

from ledgerwing.functions import assumptions, code
from ledgerwing.operators.keywords import containing

FILES = "path string, source string"


def found_in(spark, source: str, rule: str, path: str = "a.py") -> list[int]:
    rules = tuple(r for r in assumptions.RULES if r.rule == rule)
    return sorted(r["line_number"] for r in assumptions.scan(spark.createDataFrame([(path, source)], FILES), rules).collect())


#: rule: a source whose lines hold hits and misses, and the lines of the hits.
CASES = {
    "single_source_write": ("insert into `t` x\nupdate T\nupdate t set\nrow.save()\nadd(\ns.add (x)", [1, 3, 4, 6]),
    "narrow_where_clause": ("where a = 'x'\nwhere a = 5\nWHERE a IN (1, 2)\nwhere a = 'x y'", [1, 3]),
    "single_table_query": ("select a from b\nselect a from b where x\nselect a\nfrom\nc\n# select a from d\n", [1, 2, 3]),
    "hardcoded_table_name": ("Table('a')\ndb.Model\n__tablename__ = name", [1, 2]),
    "hardcoded_date": ("'2024-01-31'\n'2024-13-01'\n'31/12/1999'\ndate(1,2,3)\ndate(2020, 1, 2)", [1, 3, 5]),
    "no_migration_check": ("x.execute('insert')\nx.execute(sql)\nsession.commit()", [1, 3]),
    "single_role_access": ("@require_role('a')\nrole == 'b'\ncurrent_user.is_admin\nrole = 'b'\nu.has_perm('a.b')", [1, 2, 3, 5]),
    "single_endpoint": ("@router.get('/a')\n@x.get('/a')\npath('b/')\n@api_view([])", [1, 3, 4]),
    "no_multitenancy": ("db.query(\nx.objects.all()\nselect a\n from b\nfilter(", [1, 2, 3]),
    "no_null_handling": ("a['b']\na[0]\na.get('b') + a['c']\nx.first()\ndef f() -> d['k']", [1, 4]),
    "no_pagination": ("q.all()\nselect * from a\nselect * from a limit 3\nc.fetchall()", [1, 2, 4]),
    "no_error_path": ("try:\n    x\nexcept:\n    pass\ntry:\n    x\nexcept A as b:\n\n  pass\nexcept Exception: pass", [3, 7]),
    "env_no_fallback": ("os.getenv('A')\nos.getenv('A', 'b')\nos.environ['B']\nos.environ.get('C')", [1, 3]),
    "hardcoded_path": ("'/tmp/a'\n'/tmpx'\n\"/etc/x y\"\n'C:/a'", [1, 4]),
    "hardcoded_port": ("port=8080\nport: 1\nlocalhost:5432\nhttp://h:9999/x\nbind(('', 443", [1, 3, 5]),
    "orm_no_loading_strategy": ("relationship('A')\nrelationship('A', lazy='x')", [1]),
    "no_cascade_behavior": ("ForeignKey('a')\nForeignKey('a', on_delete=X)\nForeignKey('a', Cascade = X)\nForeignKey(", [1]),
    "framework_version_dep": ("from flask._compat import x\nfrom flask import x\nimport werkzeug.internal", [1, 3]),
    "incomplete_enum": ("status in ('a', 'b')\nif x == 'a':\n    y\nelif z:\n    y\nx\nclass A(Enum):\n    A = 1", [1, 2, 7]),
}


def test_each_assumption_rule(spark):
    assert set(CASES) == {r.rule for r in assumptions.RULES}
    for rule, (source, lines) in CASES.items():
        assert (rule, found_in(spark, source, rule)) == (rule, lines)


def test_docstrings_comments_and_tests_give_no_assumption(spark):
    source = "'''q.all()\nq.all()\n'''\n  # q.all()\nq.all()\n\"\"\"one\"\"\"\nq.all() # note"
    assert found_in(spark, source, "no_pagination") == [1, 5, 7]
    assert found_in(spark, source, "no_pagination", "x/tests/a.py") == [] == found_in(spark, source, "no_pagination", "test_a.py")
    assert assumptions.scan(spark.createDataFrame([("a.py", None), ("b.py", ""), (None, "q.all()")], FILES)).count() == 0


def test_a_block_of_members_ends_with_its_indent(spark):
    four = "class A(Enum):\n" + "".join(f"    M{i} = {i}\n" for i in range(4))
    assert found_in(spark, four, "incomplete_enum") == []
    assert found_in(spark, "class A(Enum):\n    A = 1\n# note\n    B = 2\nC = 3\nD = 4", "incomplete_enum") == [1]
    assert found_in(spark, "class A(Enum):\n" + "\n" * 29 + four[15:], "incomplete_enum") == [1]  # members too far below


def test_summaries_name_the_match(spark):
    rows = assumptions.scan(spark.createDataFrame([("a.py", "x = '/tmp/" + "y" * 100 + "'\nos.getenv('HOME')")], FILES)).collect()
    told = {r["rule"]: r["summary"] for r in rows}
    assert told["hardcoded_path"] == "Hardcoded path '/tmp/" + "y" * 72 + "...' — assumes fixed filesystem layout"
    assert told["env_no_fallback"].startswith("Environment variable 'HOME' accessed")


def test_a_table_that_two_files_write_is_no_finding(spark):
    files = spark.createDataFrame([("a.py", "INSERT INTO users x"), ("b.py", "update Users set x"), ("c.py", "INSERT INTO logs"), ("d.py", "INSERT INTO old_users_2"), ("e.py", "x.all()")], FILES)
    left = assumptions.drop_shared_writes(assumptions.scan(files), files).collect()
    assert sorted((r["path"], r["rule"]) for r in left) == [("c.py", "single_source_write"), ("e.py", "no_pagination")]


def test_symbols_of_this_repository(spark):
    """Against Python's own parser, file by file: lines, names, decorators and bases."""
    root = Path(__file__).resolve().parent.parent
    sources = [(str(p), p.read_text()) for folder in ("ledgerwing", "tests") for p in sorted((root / folder).rglob("*.py"))]
    found: dict[str, set] = {}
    for r in code.symbol_bodies(spark.createDataFrame(sources, FILES)).collect():
        found.setdefault(r["path"], set()).add((r["line_number"], r["end_line"], r["kind"], r["name"], r["is_async"], tuple(r["decorators"]), tuple(r["bases"])))
    for path, source in sources:
        want = set()
        for x in ast.walk(ast.parse(source)):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                decorators = tuple(ast.unparse(y).split("(")[0] for y in x.decorator_list)
                bases = tuple(ast.unparse(b) for b in x.bases) if isinstance(x, ast.ClassDef) else ()
                want.add((x.lineno, x.end_lineno, "class" if isinstance(x, ast.ClassDef) else "function", x.name, isinstance(x, ast.AsyncFunctionDef), decorators, bases))
        assert (path, found.get(path, set())) == (path, want)


def test_a_moved_symbol_keeps_its_hash(spark):
    rows = [("a.py", "def f():\n    return 1"), ("b.py", "class A:\n    def f():\n        return 1\n"), ("c.py", "def f():\n    return 2"), ("d.py", None)]
    hashes = {r["path"]: r["body_hash"] for r in code.symbol_bodies(spark.createDataFrame(rows, FILES)).filter("name = 'f'").collect()}
    assert hashes["a.py"] == hashes["b.py"] != hashes["c.py"]


def test_keywords_inside_words(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the postgresql store"), (2, "sql sql"), (3, None), (4, "SQL")], "id int, body string")
    words = spark.createDataFrame([("sql",), ("post",), ("",), (None,), ("sql",)], "w string")
    for size in (1 << 22, 4):
        monkeypatch.setattr("ledgerwing.operators.keywords.PASS_BYTES", size)
        assert sorted((r["id"], r["keyword"]) for r in containing(texts, words, "body", "w").collect()) == [(1, "post"), (1, "sql"), (2, "sql")]
    assert containing(texts, words.limit(0), "body", "w").count() == 0

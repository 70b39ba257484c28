"""Hidden assumptions in source files: line rules, and rules over whole files and indented blocks, without a shuffle.

A file is one row. Its text is marked before it is split into lines, so that every line knows whether it lies in a
docstring and which matches begin in it; findings leave the row as an array. Look-ahead rules read a bounded slice of lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwing.operators.keywords import without
from ledgerwing.session import written

#: Marks put into a text: a line that begins in a docstring, a docstring's delimiter, and around a match's text.
IN_DOC, DELIMITER, FROM, TO = "\x01", "\x02", "\x03", "\x04"


@dataclass(frozen=True)
class Rule:
    """over_lines: the pattern may span lines and is matched over the whole file. unless_file, unless_line: what the file or line must not have."""

    rule: str
    category: str
    severity: str
    confidence: float
    tier: str
    pattern: str
    summary: str
    over_lines: bool = False
    unless_file: str = ""
    unless_line: str = ""

    @property
    def groups(self) -> int:
        return re.compile(self.pattern).groups


# What each rule looks for, and how it is told. Patterns are those of Unicode text, case where stated. Those of
# several alternatives start with a look at the letters that a match begins with, so that most places are passed at once.
RULES = (
    Rule(
        "single_source_write", "data_scope", "high", 0.7, "architectural",
        r"(?i)(?=[iu.])(?:INSERT\s+INTO\s+[`\"']?(\w+)[`\"']?|UPDATE\s+[`\"']?(\w+)[`\"']?\s+SET|\.create\s*\(|\.save\s*\(|\.add\s*\(|\.bulk_create\s*\(|\.update_or_create\s*\()",
        "Write to {match} found in one location — assumes no external write sources",
    ),
    Rule(
        "narrow_where_clause", "data_scope", "medium", 0.6, "architectural",
        r"(?i)WHERE\s+\w+\s*(?:=\s*['\"][\w\-]+['\"]|IN\s*\([^)]{1,120}\))",
        "WHERE clause filters on literal values — assumes data subset is complete",
    ),
    Rule(
        "single_table_query", "data_scope", "low", 0.5, "architectural",
        r"(?is)SELECT\s+.{1,200}?\s+FROM\s+[`\"']?(\w+)[`\"']?(?!\s+(?:JOIN|INNER\s+JOIN|LEFT\s+JOIN|RIGHT\s+JOIN|CROSS\s+JOIN|FULL\s+JOIN))",
        "Query reads from single table {match} without JOINs — assumes no cross-table relationships needed", over_lines=True,
    ),
    Rule(
        "hardcoded_table_name", "data_scope", "low", 0.5, "architectural",
        r"(?=[_Td])(?:__tablename__\s*=\s*['\"](\w+)['\"]|Table\s*\(\s*['\"](\w+)['\"]|db\.Model)",
        "Hardcoded table name '{match}' — track for schema evolution",
    ),
    Rule(
        "hardcoded_date", "temporal", "high", 0.7, "implementation",
        r"(?=[d'\"])(?:datetime\s*\(\s*\d{4}\s*,\s*\d{1,2}\s*,\s*\d{1,2}|date\s*\(\s*\d{4}\s*,\s*\d{1,2}\s*,\s*\d{1,2}"
        r"|['\"](?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])['\"]|['\"](?:0[1-9]|[12]\d|3[01])[-/](?:0[1-9]|1[0-2])[-/](?:19|20)\d{2}['\"])",
        "Hardcoded date '{match}' — assumes fixed temporal boundary",
    ),
    Rule(
        "no_migration_check", "temporal", "low", 0.4, "implementation",
        r"(?i)(?=[.sd])(?:\.execute\s*\(\s*['\"](?:INSERT|UPDATE|ALTER|CREATE)|session\.commit\s*\(|db\.session\.commit\s*\(|\.migrate\s*\()",
        "DB write without migration/backfill logic — assumes schema is stable",
        unless_file=r"(?i)(?:migration|migrate|alembic|backfill|schema_version|RunSQL|RunPython)",
    ),
    Rule(
        "single_role_access", "access", "high", 0.7, "implementation",
        r"(?=[@r.c])(?:@require_role\s*\(\s*['\"](\w+)['\"]\s*\)|@login_required|@permission_required\s*\(\s*['\"](\w+)['\"]\s*\)|role\s*==\s*['\"](\w+)['\"]"
        r"|\.has_role\s*\(\s*['\"](\w+)['\"]\s*\)|\.has_perm\s*\(\s*['\"][\w.]+['\"]\s*\)|current_user\.is_(\w+))",
        "Single role check '{match}' — assumes no additional access control needed",
    ),
    Rule(
        "single_endpoint", "access", "medium", 0.5, "implementation",
        r"(?=[@p])(?:@(?:app|router|api|blueprint)\.(?:route|get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)['\"]|@api_view\s*\(|path\s*\(\s*['\"]([^'\"]+)['\"])",
        "Single endpoint '{match}' for resource — assumes no alternative access paths",
    ),
    Rule(
        "no_multitenancy", "access", "low", 0.4, "implementation",
        r"(?is)(?=[.s])(?:\.query\s*\(|\.filter\s*\(|\.filter_by\s*\(|\.objects\.(?:filter|get|all|exclude)\s*\(|SELECT\s+.{1,200}?\s+FROM)",
        "DB query without tenant/org filter — assumes single-tenant access", over_lines=True,
        unless_file=r"(?i)tenant_id|org_id|organization_id|team_id|account_id|workspace_id",
    ),
    Rule(
        "incomplete_enum", "completeness", "medium", 0.6, "implementation",
        r"(?i)(?=[sci])(?:status\s+IN\s*\(\s*(?:'[^']*'\s*,\s*){0,3}'[^']*'\s*\)|class\s+\w+\s*\(\s*(?:str\s*,\s*)?Enum\s*\)|if\s+\w+\s*==\s*['\"][^'\"]+['\"])",
        "Incomplete status/enum check '{match}' — may not cover all possible states",
    ),
    Rule(
        "no_null_handling", "completeness", "medium", 0.5, "implementation",
        r"(?:(?<!\w)\w++\[['\"](\w+)['\"]\]|\.first\s*\(\s*\)|\.one\s*\(\s*\)|\.scalar\s*\(\s*\))",
        "Direct access without null check — assumes '{match}' always exists", unless_line=r"get\(|Optional|->",
    ),
    Rule(
        "no_pagination", "completeness", "medium", 0.5, "implementation",
        r"(?i)(?=[.s])(?:\.all\s*\(\s*\)|\.objects\.all\s*\(\s*\)|SELECT\s+\*\s+FROM(?!.*(?:LIMIT|OFFSET|TOP))|\.fetchall\s*\(\s*\))",
        "Unbounded query '{match}' — assumes result set fits in memory",
    ),
    Rule(
        "no_error_path", "completeness", "medium", 0.4, "implementation",
        r"(?m)(?=e)(?:except\s*:\s*\n\s*pass|except\s+\w+(?:\s+as\s+\w+)?:\s*\n\s*pass|except\s+Exception\s*:\s*\n\s*pass)",
        "Bare except/pass — swallows errors, assumes happy path always succeeds", over_lines=True,
    ),
    Rule(
        "env_no_fallback", "configuration", "high", 0.7, "architectural",
        r"(?=o)(?:os\.getenv\s*\(\s*['\"](\w+)['\"]\s*\)|os\.environ\s*\[\s*['\"](\w+)['\"]\s*\])",
        "Environment variable '{match}' accessed without fallback — assumes always set", unless_line=r"os\.getenv\s*\(\s*['\"](\w+)['\"]\s*,\s*[^)]+\)",
    ),
    Rule(
        "hardcoded_path", "configuration", "medium", 0.6, "architectural",
        r"['\"](/tmp/[^\s'\"]*|/var/[^\s'\"]*|/etc/[^\s'\"]*|/home/[^\s'\"]*|/opt/[^\s'\"]*|/usr/local/[^\s'\"]*|C:\\\\[^\s'\"]*|C:/[^\s'\"]*)['\"]",
        "Hardcoded path '{match}' — assumes fixed filesystem layout",
    ),
    Rule(
        "hardcoded_port", "configuration", "medium", 0.5, "architectural",
        r"(?=[pPl10bc:])(?:(?:port|PORT)\s*[=:]\s*(\d{2,5})|localhost:(\d{2,5})|127\.0\.0\.1:(\d{2,5})|0\.0\.0\.0:(\d{2,5})"
        r"|bind\s*\(\s*\(?['\"][^'\"]*['\"],\s*(\d{2,5})|connect\s*\(\s*\(?['\"][^'\"]*['\"],\s*(\d{2,5})|:(\d{2,5})/\w)",
        "Hardcoded port {match} — assumes fixed network configuration",
    ),
    Rule(
        "orm_no_loading_strategy", "framework", "medium", 0.6, "architectural",
        r"relationship\s*\([^)]*\)",
        "relationship() without explicit loading strategy — assumes SQLAlchemy default (lazy='select')", unless_line=r"relationship\s*\([^)]*lazy\s*=",
    ),
    Rule(
        "no_cascade_behavior", "framework", "medium", 0.6, "architectural",
        r"(?=[Fm])(?:ForeignKey\s*\([^)]*\)|models\.ForeignKey\s*\([^)]*\))",
        "ForeignKey without explicit cascade behavior — assumes framework default on delete",
        unless_line=r"(?i)ForeignKey\s*\([^)]*(?:on_delete|cascade)\s*=",
    ),
    Rule(
        "framework_version_dep", "framework", "medium", 0.5, "architectural",
        r"(?=[fi])(?:from|import)\s+(?:django\.db\.backends|django\.utils\.encoding|django\.utils\.six|flask\._\w+|flask\.globals|sqlalchemy\.engine\.strategies"
        r"|sqlalchemy\.orm\.strategies|celery\.app\.amqp|celery\._state|fastapi\.routing|starlette\._\w+|werkzeug\._\w+|werkzeug\.internal)",
        "Import from framework internals '{match}' — may break on version upgrade",
    ),
)
# Ports of well-known services; other ports are no finding.
KNOWN_PORTS = (80, 443, 3000, 3306, 5000, 5432, 5433, 5672, 6379, 6380, 8000, 8080, 8443, 8888, 9000, 9090, 9200, 9300, 11211, 15672, 27017, 27018, 28015)
# Paths that hold tests.
TEST_PATH = r"(?:^|/)(?:test_|tests/|testing/|conftest\.py|_test\.py$)"
# Statements that write a table.
WRITES = r"(?i)(?:INSERT\s+INTO\s+[`\"']?(\w+)[`\"']?|UPDATE\s+[`\"']?(\w+)[`\"']?\s+SET)"
#: Lines below a class that may hold its members, and below an if that may hold the rest of its chain.
ENUM_LINES, CHAIN_LINES, FEW_MEMBERS, SUMMARY_CHARS = 29, 39, 4, 80

FINDING = ("rule", "category", "severity", "confidence", "tier", "line_number", "summary", "snippet")


def unicode(pattern: str) -> str:
    """A pattern whose word characters, digits and blanks are Unicode's."""
    return "(?U)" + pattern


def marked_lines(source: Column) -> Column:
    """Lines of a file; one that begins inside a docstring, after an odd number of triple quotes, starts with IN_DOC."""
    plain = F.split(source, "\n")
    parts = F.split(F.regexp_replace(source, "(\"\"\"|''')", f"{DELIMITER}$1"), DELIMITER)
    marked = F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.replace(part, F.lit("\n"), F.lit("\n" + IN_DOC))).otherwise(part))
    quoted = source.contains('"""') | source.contains("'''")
    return F.when(quoted, F.split(F.array_join(marked, ""), "\n")).otherwise(plain)


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, unicode(r"^\s+"), ""))


def few_members(lines: Column, line: Column, at: Column) -> Column:
    """True if the class at a line has fewer than FEW_MEMBERS assignments in capitals before its block ends."""
    below = F.filter(F.slice(lines, at + 2, ENUM_LINES), lambda x: F.trim(x) != "")
    ends = F.transform(below, lambda x: (indent(x) <= indent(line)) & ~F.trim(x).startswith("#"))
    end = F.array_position(ends, F.lit(True))
    block = F.when(end > 0, F.slice(below, 1, (end - 1).cast("int"))).otherwise(below)
    return F.size(F.filter(block, lambda x: F.trim(x).rlike(r"^[A-Z_][A-Z0-9_]*\s*="))) < FEW_MEMBERS


def open_chain(lines: Column, line: Column, at: Column) -> Column:
    """True if the if at a line has an elif and no else: the lines below are told apart by one letter each."""
    own = indent(line)

    def kind(x: Column) -> Column:
        text, depth = F.trim(x), indent(x)
        return (
            F.when(text == "", "-")
            .when(depth > own, "-")
            .when(depth < own, "x")
            .when(text.startswith("elif "), "i")
            .when(text.startswith("else:") | text.startswith("else "), "e")
            .when(text.startswith("#"), "-")
            .otherwise("x")
        )

    return F.array_join(F.transform(F.slice(lines, at + 2, CHAIN_LINES), kind), "").rlike("^-*i[-i]*(x|$)")


def matched(line: Column, rule: Rule) -> Column:
    """The first group that took part, or the whole match. Each is looked for once, as lambdas do not share what they have found."""
    pattern = unicode(rule.pattern)
    whole = F.regexp_extract(line, pattern, 0)
    if not rule.groups:
        return whole
    groups = F.array(*[F.regexp_extract(line, pattern, g) for g in range(1, rule.groups + 1)])
    return F.coalesce(F.get(F.filter(groups, lambda x: x != ""), F.lit(0)), whole)


def passes(rule: Rule, lines: Column, line: Column, at: Column) -> Column:
    """What a rule asks of a line beside its pattern."""
    if rule.rule == "incomplete_enum":
        enum = line.contains("class ") & line.contains("Enum")
        return F.when(enum, few_members(lines, line, at)).when(F.trim(line).startswith("if "), open_chain(lines, line, at)).otherwise(F.lit(True))
    if rule.rule == "hardcoded_port":
        return F.coalesce(matched(line, rule).try_cast("int").isin(*KNOWN_PORTS), F.lit(False))
    return ~line.rlike(unicode(rule.unless_line)) if rule.unless_line else F.lit(True)


def finding(rule: Rule, line_number: Column, text: Column, snippet: Column) -> Column:
    """A finding's columns; text, its match without blanks around it, is read several times and should be no long expression."""
    short = F.when(F.length(text) > SUMMARY_CHARS, F.concat(F.substring(text, 1, SUMMARY_CHARS - 3), F.lit("..."))).otherwise(text)
    values = (F.lit(rule.rule), F.lit(rule.category), F.lit(rule.severity), F.lit(rule.confidence), F.lit(rule.tier), line_number, F.replace(F.lit(rule.summary), F.lit("{match}"), short), F.rtrim(snippet))
    return F.struct(*[v.alias(n) for v, n in zip(values, FINDING, strict=True)])


def line_findings(rule: Rule, lines: Column) -> Column:
    """Findings of a rule in single lines, outside comments and docstrings, one a line."""

    def hit(x: Column) -> Column:
        line, at = x["line"], x["at"]
        return ~line.startswith(IN_DOC) & line.rlike(unicode(rule.pattern)) & ~line.rlike(unicode(r"^\s*#")) & passes(rule, lines, line, at)

    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("at")))
    told = F.transform(F.filter(numbered, hit), lambda x: F.struct(x["line"].alias("line"), x["at"].alias("at"), F.trim(matched(x["line"], rule)).alias("match")))
    return F.transform(told, lambda x: finding(rule, x["at"] + 1, x["match"], x["line"]))


def spanning_findings(rule: Rule, source: Column) -> Column:
    """Findings of a rule over the whole file, each on the line where its match begins, told by a mark put in front of it."""
    group = "$1" if rule.groups else ""
    text = marked_lines(F.regexp_replace(source, unicode(rule.pattern), f"{FROM}{group}{TO}$0"))
    mark = f"{FROM}([^{TO}]*){TO}"
    numbered = F.transform(text, lambda x, i: F.struct(F.regexp_replace(x, mark, "").alias("line"), (i + 1).alias("n"), F.transform(F.regexp_extract_all(x, F.lit(mark), F.lit(1)), lambda m: F.trim(m)).alias("found")))
    kept = F.filter(numbered, lambda x: (F.size(x["found"]) > 0) & ~x["line"].startswith(IN_DOC) & ~x["line"].rlike(unicode(r"^\s*#")))
    return F.flatten(F.transform(kept, lambda x: F.transform(x["found"], lambda m: finding(rule, x["n"], m, x["line"]))))


def scan(files: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "path", text: str = "source") -> DataFrame:
    """key, line_number, rule, category, severity, confidence, tier, summary, snippet of each finding in files that are no tests.

    A rule that spans lines gives a finding for each match, one of single lines a finding a line at most. A match whose
    line is a comment or begins inside a docstring is none. Null and blank sources give nothing. Each rule is tried on
    the whole text first, so a file's lines are only taken apart for rules that it matches. One narrow stage, no shuffle.
    """
    source = F.col(text)
    lines = F.col("_lines")
    found = []
    for rule in rules:
        applies = source.rlike(unicode(rule.pattern if rule.over_lines else "(?m)" + rule.pattern))
        if rule.unless_file:
            applies = applies & ~source.rlike(rule.unless_file)
        findings = spanning_findings(rule, source) if rule.over_lines else line_findings(rule, lines)
        found.append(F.when(applies, findings))
    rows = files.filter(~F.col(key).rlike(TEST_PATH)).withColumn("_lines", marked_lines(source))
    each = rows.select(key, F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("f"))
    return each.select(key, *[f"f.{n}" for n in FINDING])


def written_tables(files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """key, table_name: tables, in lower case, that a file's statements write."""
    names = F.concat(*[F.regexp_extract_all(text, F.lit(unicode(WRITES)), F.lit(g)) for g in (1, 2)])
    return files.select(key, F.explode(F.array_distinct(F.transform(F.filter(names, lambda x: x != ""), F.lower))).alias("table_name"))


def shared_tables(files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """table_name of the tables that two or more files write. Files are told apart by 128 bits of hashes, so only tables are grouped."""
    of = F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.when(F.col(key).isNotNull(), F.xxhash64(key, F.lit(1)))
    ends = [f(h).alias(f"{n}{k}") for k, h in enumerate(of) for n, f in (("low", F.min), ("high", F.max))]
    return written_tables(files, key, text).groupBy("table_name").agg(*ends).filter("low0 <> high0 or low1 <> high1").select("table_name")


def drop_shared_writes(findings: DataFrame, files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """Findings without single_source_write ones whose summary holds the name of a table that two or more files write.

    The names of shared tables are written once; findings are read once and stay where they lie.
    """
    shared = written(shared_tables(files, key, text), "shared-tables")
    told = findings.withColumn("_summary", F.when(F.col("rule") == "single_source_write", F.lower("summary")))
    return without(told, shared, "_summary", "table_name").drop("_summary")

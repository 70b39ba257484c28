"""Rules over source and configuration files: lines, infrastructure, boundaries, symbols with their bodies, and features."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.functions.text import extract_imports, lines


@dataclass(frozen=True)
class LineRule:
    """A finding for each line that pattern matches. except_near: no finding if a line up to look_ahead below matches it."""

    rule: str
    pattern: str
    severity: str
    category: str = ""
    except_near: str = ""
    look_ahead: int = 0


@dataclass(frozen=True)
class InfraRule:
    """A finding for each line, without the blanks around it, that pattern matches.

    resource: the group that names what the finding is about; wanted and unwanted: what that must hold one of and none of,
    in lower case. without: what none of the next look_ahead lines may hold.
    """

    rule: str
    dimension: str
    pattern: str
    message: str
    suggestion: str
    resource: int = 0
    lower: bool = False
    wanted: tuple[str, ...] = ()
    unwanted: tuple[str, ...] = ()
    without: str = ""
    look_ahead: int = 10


# What each kind of infrastructure file is looked through for, and how it is told.
INFRA_RULES = {
    "terraform": (
        InfraRule("hardcoded_credential", "security-posture", r'(?i)(password|secret|api_key|token)\s*=\s*"[^"]{3,}"', "Hardcoded credential detected in Terraform config", "Use variables or a secrets manager"),
        InfraRule("wildcard_action", "security-posture", r'actions.*"\*"|"\*".*actions', "Wildcard IAM action '*' is overly permissive", "Use least-privilege principle — specify exact actions"),
        InfraRule("large_instance", "cost-impact", r'instance_type\s*=\s*"([^"]+)"', "Large instance type '{resource}' may have high cost impact", "Review instance sizing requirements", resource=1, wanted=("xlarge", "metal", "16x", "24x")),
        InfraRule("public_access", "security-posture", r"(?i)(publicly_accessible|public)\s*=\s*true", "Resource configured with public access", "Consider restricting access to VPC/private subnets"),
    ),
    "kubernetes": (
        InfraRule("privileged", "security-posture", r"privileged: true", "Privileged container detected", "Remove privileged: true unless absolutely required"),
        InfraRule("no_limits", "blast-radius", r"resources:", "Container resources without limits", "Set CPU and memory limits to prevent resource exhaustion", without="limits:"),
        InfraRule("host_network", "security-posture", r"hostNetwork: true", "Pod using host network", "Use pod networking instead of host network"),
        InfraRule("latest_image", "rollback-complexity", r"image:\s*\S+:latest", "Image using ':latest' tag — not reproducible", "Pin image to specific version or SHA digest"),
    ),
    "dockerfile": (
        InfraRule("root_user", "security-posture", r"^USER root$", "Container runs as root", "Use a non-root USER directive"),
        InfraRule("remote_add", "security-posture", r"^ADD .*https?://", "ADD with URL download — use COPY + curl for better layer caching", "Replace ADD URL with RUN curl + COPY"),
        InfraRule("large_base", "blast-radius", r"(?i)^FROM\s+(\S+)", "Large base image '{resource}' increases attack surface", "Use slim/alpine/distroless variant", resource=1, lower=True, wanted=("ubuntu", "debian", "centos", "fedora"), unwanted=("slim", "alpine", "distroless", "minimal")),
    ),
    "github_actions": (
        InfraRule("unpinned_action", "security-posture", r"uses:\s*(\S+)", "Unpinned action '{resource}' — supply chain risk", "Pin to specific version or commit SHA", resource=1, unwanted=("@",)),
        InfraRule("echoed_secret", "security-posture", r"(?=.*\$\{\{)(?=.*secrets\.)(?i:.*echo)", "Secret potentially exposed via echo/print", "Avoid echoing secrets — use them directly in commands"),
    ),
}
# What is told of a container file in which no line sets a user.
NO_USER = InfraRule("no_user", "security-posture", "", "No USER directive — container will run as root", "Add USER directive with a non-root user")
INFRA_FINDING = ("line_number", "rule", "dimension", "severity", "resource", "message", "suggestion")


def infra_type(path: Column, source: Column) -> Column:
    """terraform, dockerfile, github_actions or kubernetes by name, else by what a YAML file starts with; null for others."""
    low = F.lower(path)
    yaml = low.rlike(r"\.ya?ml$")
    head = F.lower(F.substring(source, 1, 500))
    return (
        F.when(low.rlike(r"\.tf(vars)?$"), "terraform")
        .when(low.rlike(r"(^|/)dockerfile(\.[^/]*)?$"), "dockerfile")
        .when(yaml & low.contains(".github/workflows"), "github_actions")
        .when(yaml & (low.rlike("k8s|kubernetes|deploy|manifests") | (head.contains("apiversion:") & head.contains("kind:"))), "kubernetes")
    )


def scan_lines(files: DataFrame, rules: tuple[LineRule, ...], key: str = "path", text: str = "source") -> DataFrame:
    """key, line_number, rule, category, severity, line: findings of line rules; a file that matches none is passed over."""
    wanted = F.lit(False)
    for r in rules:
        wanted = wanted | F.col(text).rlike("(?m)" + r.pattern)
    rows = lines(files.filter(wanted), key, text)
    ahead = Window.partitionBy(key).orderBy("line_number")
    checks, columns = [], {}
    for n, r in enumerate(rules):
        hit = F.col("line").rlike(r.pattern)
        if r.except_near:
            near = F.max(F.col("line").rlike(r.except_near).cast("int")).over(ahead.rowsBetween(0, r.look_ahead))
            columns[f"_near{n}"] = F.coalesce(near, F.lit(0)) == 0
            hit = hit & F.col(f"_near{n}")
        checks.append(F.when(hit, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"))))
    found = rows.withColumns(columns) if columns else rows
    return found.select(key, "line_number", "line", F.explode(F.array_compact(F.array(*checks))).alias("f")).select(key, "line_number", "f.*", F.trim("line").alias("line"))


def _infra_findings(rule: InfraRule, numbered: Column, source: Column) -> Column:
    def resource(line: Column) -> Column:
        found = F.regexp_extract(line, rule.pattern, rule.resource) if rule.resource else F.lit("")
        return F.lower(found) if rule.lower else found

    def holds(text: Column, names: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for name in names:
            hit = hit | text.contains(name)
        return hit

    def hit(x: Column) -> Column:
        ok = x["line"].rlike(rule.pattern)
        if rule.wanted:
            ok = ok & holds(resource(x["line"]), rule.wanted)
        if rule.unwanted:
            ok = ok & ~holds(resource(x["line"]), rule.unwanted)
        if rule.without:
            below = F.slice(F.split(source, "\n"), x["n"] + 1, rule.look_ahead)
            ok = ok & ~F.exists(below, lambda y: y.contains(rule.without))
        return ok

    return F.transform(F.filter(numbered, hit), lambda x: _infra_finding(rule, x["n"], resource(x["line"])))


def _infra_finding(rule: InfraRule, line_number: Column, resource: Column) -> Column:
    values = (line_number.cast("int"), F.lit(rule.rule), F.lit(rule.dimension), F.lit("critical"), resource, F.replace(F.lit(rule.message), F.lit("{resource}"), resource), F.lit(rule.suggestion))
    return F.struct(*[v.alias(n) for v, n in zip(values, INFRA_FINDING, strict=True)])


def scan_infra(files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """key, kind, line_number, rule, dimension, severity, resource, message, suggestion of each finding in infrastructure files.

    A rule that looks at the lines below reads a bounded slice of them; a container file without a user is told on line 0.
    Findings leave a file's row as an array, so nothing is shuffled. Null sources and other files give nothing.
    """
    source, kind = F.col(text), F.col("kind")
    numbered = F.transform(F.split(source, "\n"), lambda line, i: F.struct(F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")).alias("line"), (i + 1).alias("n")))
    found = None
    for name, rules in INFRA_RULES.items():
        own = F.concat(*[_infra_findings(r, F.col("_lines"), source) for r in rules])
        if name == "dockerfile":
            rooted = F.array(_infra_finding(NO_USER, F.lit(0), F.lit("")))
            own = F.concat(own, F.when(F.exists("_lines", lambda x: x["line"].startswith("USER ")), F.slice(rooted, 1, 0)).otherwise(rooted))
        found = F.when(kind == name, own) if found is None else found.when(kind == name, own)
    typed = files.withColumn("kind", infra_type(F.col(key), source)).filter("kind is not null").withColumn("_lines", numbered)
    return typed.select(key, "kind", F.explode(found).alias("f")).select(key, "kind", *[f"f.{n}" for n in INFRA_FINDING])


def boundary_violations(files: DataFrame, layers: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """key, module, rule: imports that a layer (prefix, forbidden) must not make; layers is a small reference table."""
    imports = extract_imports(files, key, text)
    hit = F.col(key).startswith(F.col("prefix")) & F.col("module").startswith(F.col("forbidden"))
    return imports.crossJoin(layers).filter(hit).select(key, "module", F.concat_ws(" -> ", "prefix", "forbidden").alias("rule"))


def await_in_sync(files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """key, line_number: awaits whose last function header above is not async."""
    rows = lines(files.filter(F.col(text).contains("await ")), key, text)
    header = F.when(F.col("line").rlike(r"^\s*async\s+def\b"), "async").when(F.col("line").rlike(r"^\s*def\b"), "sync")
    kind = F.last(header, ignorenulls=True).over(Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("kind", kind).filter((F.col("kind") == "sync") & F.col("line").rlike(r"\bawait\s")).select(key, "line_number")


FEATURES = "path string, name string, line_number int, features array<string>"
# Names that a function's features are read from.
DB_METHODS = ("execute", "commit", "query", "filter", "filter_by", "fetchone", "fetchall", "fetchmany", "scalar", "add", "add_all", "merge", "flush", "rollback", "bulk_create", "update_or_create", "get_or_create")
HTTP_MODULES = ("requests", "httpx", "urllib", "aiohttp", "fetch")
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "request")
HTTP_RECEIVERS = ("client", "session", "http", "conn", "connection", "resp", "response", "req", "request", "api")
CONVERSIONS = ("int", "float", "str", "bool", "bytes", "list", "tuple", "dict", "set")
FILE_METHODS = ("read_text", "read_bytes", "write_text", "write_bytes", "read", "write", "readlines", "writelines")
PATH_FUNCTIONS = ("exists", "isfile", "isdir", "join", "abspath", "dirname", "basename", "splitext", "getsize")
LOG_METHODS = ("debug", "info", "warning", "error", "critical", "exception", "log", "warn")
VALIDATION_ERRORS = ("ValueError", "TypeError", "ValidationError", "AssertionError", "AttributeError")


def _path(node: ast.AST) -> tuple[str, ...]:
    """a.b.c as its names; what is not a name, such as a call, is an empty one."""
    if isinstance(node, ast.Attribute):
        return (*_path(node.value), node.attr)
    return (node.id,) if isinstance(node, ast.Name) else ("",)


def _call_features(path: tuple[str, ...]) -> Iterator[str]:
    """What a call of this dotted name tells about the function around it."""
    *before, name = path
    if not before:
        if name in ("open", "isinstance", "fetch") or name in CONVERSIONS:
            yield {"open": "file_io", "isinstance": "validation", "fetch": "http_call"}.get(name, "type_conversion")
        return
    first, last, single = before[0], before[-1], len(before) == 1
    yield from (
        feature
        for feature, told in (
            ("db_call", name in DB_METHODS),
            ("logging", name in LOG_METHODS and (last in ("logger", "log") or (single and last == "logging"))),
            ("http_call", len(before) <= 2 and first in HTTP_MODULES),
            ("http_call", single and name in HTTP_VERBS and any(x in first.lower() for x in HTTP_RECEIVERS)),
            ("file_io", name in FILE_METHODS or (before == ["os", "path"] and name in PATH_FUNCTIONS)),
            ("env_access", path == ("os", "getenv") or path == ("os", "environ", "get")),
            ("type_conversion", name in ("encode", "decode")),
        )
        if told
    )


def _node_features(node: ast.AST) -> Iterator[str]:
    match node:
        case ast.Try(handlers=[_, *_]) | ast.TryStar(handlers=[_, *_]):
            yield "try_except"
        case ast.Call():
            yield from _call_features(_path(node.func))
        case ast.Compare():
            if any(isinstance(op, (ast.Is, ast.IsNot)) and isinstance(c, ast.Constant) and c.value is None for op, c in zip(node.ops, node.comparators, strict=True)):
                yield "null_check"
        case ast.If():
            if isinstance(node.test, ast.UnaryOp) and isinstance(node.test.op, ast.Not):
                yield "null_check"
            if any(isinstance(x, ast.Return) for x in ast.walk(node)):
                yield "return_early"
        case ast.Assert():
            yield "validation"
        case ast.Raise(exc=ast.Call(func=error)) if _path(error)[-1] in VALIDATION_ERRORS:
            yield "validation"
        case ast.Raise(exc=ast.Name(id=error)) if error in VALIDATION_ERRORS:
            yield "validation"
        case ast.Subscript() if _path(node.value) == ("os", "environ"):
            yield "env_access"


def function_features(files: DataFrame) -> DataFrame:
    """path, name, line_number, features of every Python function that has any of ten features, from its syntax tree.

    try_except, null_check, return_early, validation, db_call, http_call, file_io, env_access, logging and
    type_conversion. Files that do not parse give none.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, source in zip(batch["path"], batch["source"], strict=True):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for x in ast.walk(tree):
                    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        found = sorted({f for node in ast.walk(x) for f in _node_features(node)})
                        if found:
                            out.append((path, x.name, x.lineno, found))
            yield pd.DataFrame(out, columns=["path", "name", "line_number", "features"])

    return files.select("path", "source").mapInPandas(parse, FEATURES)


SYMBOLS = "path string, line_number int, end_line int, kind string, name string, parent string, is_async boolean, decorators array<string>, bases array<string>, body_hash string"
#: Texts and comments, whose brackets and indents do not count; line breaks inside them stay.
QUOTED = re.compile(r"""(?s:[rbfuRBFU]{0,2}(\"{3}|'{3})(?:\\.|(?!\1).)*(?:\1|\Z))|[rbfuRBFU]{0,2}"(?:\\.|[^"\\\n])*"?|[rbfuRBFU]{0,2}'(?:\\.|[^'\\\n])*'?|#[^\n]*""")
HEADER = re.compile(r"\s*(async\s+)?(def|class)\s+(\w+)\s*(.*)", re.S)


def _statements(source: str) -> Iterator[tuple[int, int, int, str]]:
    """First line, last line, indent and blanked text of each statement: lines inside brackets or texts go with the first."""
    blank = QUOTED.sub(lambda m: "" if m[0].startswith("#") else "\n".join("_" * len(x) for x in m[0].split("\n")), source).split("\n")
    first, depth, held = 0, 0, []
    inside = {n for m in QUOTED.finditer(source) if "\n" in m[0] for n in range(source.count("\n", 0, m.start()) + 1, source.count("\n", 0, m.end()) + 1)}
    for n, line in enumerate(blank):
        if not held and not line.strip():
            continue
        if not held:
            first = n
        held.append(line)
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        if depth or line.endswith("\\") or n + 1 in inside:
            continue
        indent = len(held[0].expandtabs()) - len(held[0].expandtabs().lstrip())
        yield first, n, indent, "\n".join(held)
        held = []


def symbols_of(source: str) -> list[tuple]:
    """Functions and classes of one Python file, from indents alone, so that a file need not parse.

    A symbol's body goes to the last statement of deeper indent below its header; the open symbols form a stack.
    """
    lines, open_, out, decorators = source.split("\n"), [], [], []
    last = 0

    def close(indent: int) -> None:
        while open_ and open_[-1]["indent"] >= indent:
            s = open_.pop()
            body = "\n".join(x.strip() for x in lines[s["first"] : last + 1])
            out.append((s["first"] + 1, last + 1, s["kind"], s["name"], s["parent"], s["is_async"], s["decorators"], s["bases"], hashlib.sha256(body.encode()).hexdigest()))

    for first, end, indent, text in _statements(source):
        close(indent)
        last = end
        if text.lstrip().startswith("@"):
            decorators.append(re.match(r"[\w.]*", text.lstrip()[1:].lstrip())[0])
            continue
        header = HEADER.match(text)
        if header:
            kind = "class" if header[2] == "class" else "function"
            listed = re.match(r"\((.*?)\)\s*:", header[4], re.S) if kind == "class" else None
            bases = [b.strip() for b in listed[1].split(",") if b.strip() and "=" not in b] if listed else []
            parent = ".".join(s["name"] for s in open_)
            open_.append({"first": first, "indent": indent, "kind": kind, "name": header[3], "parent": parent, "is_async": bool(header[1]), "decorators": decorators, "bases": bases})
        decorators = []
    close(0)
    return sorted(out)


def symbol_bodies(files: DataFrame) -> DataFrame:
    """path, line_number, end_line, kind, name, parent, is_async, decorators, bases, body_hash of every function and class.

    parent joins the names around a symbol. body_hash is that of its lines without the blanks around them, header
    and nested symbols included, so a symbol that moves or is indented anew keeps it. Null and empty sources give nothing.
    """

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *s) for path, source in zip(batch["path"], batch["source"], strict=True) for s in symbols_of(source or "")]
            yield pd.DataFrame(rows, columns=["path", "line_number", "end_line", "kind", "name", "parent", "is_async", "decorators", "bases", "body_hash"])

    return files.select("path", "source").mapInPandas(segment, SYMBOLS)

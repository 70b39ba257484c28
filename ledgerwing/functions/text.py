"""Column and table functions over text: redaction, scans for sensitive data, requirements, imports, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.functions.labels import first_match

# What is redacted, in this order.
REDACTIONS = (
    ("[EMAIL]", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("[IP]", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("[URL]", r"https?://[^\s\"']+"),
    ("[PATH]", r"(?:/[a-zA-Z0-9._-]+){3,}"),
    ("[API_KEY]", r"(?i)\b(?:api[_-]?key|token|secret)[:\s]*['\"][a-zA-Z0-9_-]{20,}['\"]"),
)
# Health data, high severity first.
PHI = (
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("mrn", r"\bMRN[:\s#]*\d{6,10}\b"),
    ("dob", r"\b(?:DOB|date.?of.?birth)[:\s]*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b"),
    ("phone", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("email_health", r"\b[a-zA-Z0-9._%+-]+@(?:hospital|clinic|health|medical)\.[a-zA-Z]{2,}\b"),
    ("diagnosis_code", r"\b[A-Z]\d{2}(?:\.\d{1,4})?\b"),
    ("npi", r"\bNPI[:\s#]*\d{10}\b"),
)
# Payment cards; the three brands must pass the check digit.
CARDS = (
    ("visa", r"\b4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    ("mastercard", r"\b5[1-5]\d{2}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    ("amex", r"\b3[47]\d{2}[\s\-]?\d{6}[\s\-]?\d{5}\b"),
    ("cvv", r"\b(?:CVV|CVC|CVV2)[:\s]*\d{3,4}\b"),
    ("expiry", r"\b(?:exp(?:iry|iration)?)[:\s]*\d{2}[/\-]\d{2,4}\b"),
    ("track_data", r"\b%B\d{13,19}\^\w+\b"),
)
BRANDS = ("visa", "mastercard", "amex")
# Dangerous shell commands.
DANGEROUS = (
    (r"rm\s+(-[a-zA-Z]*f[a-zA-Z]*\s+)?-[a-zA-Z]*r|rm\s+(-[a-zA-Z]*r[a-zA-Z]*\s+)?-[a-zA-Z]*f|rm\s+-rf", "Recursive force delete", "critical"),
    (r"chmod\s+777", "World-writable permissions", "critical"),
    (r"curl\s+.*\|\s*(?:bash|sh|zsh)", "Pipe remote script to shell", "critical"),
    (r"wget\s+.*\|\s*(?:bash|sh|zsh)", "Pipe remote script to shell", "critical"),
    (r"docker\s+run\s+.*--privileged", "Privileged Docker container", "critical"),
    (r"git\s+push\s+.*--force(?:\s|$)", "Git force push", "critical"),
    (r"git\s+push\s+.*-f(?:\s|$)", "Git force push", "critical"),
    (r"git\s+reset\s+--hard", "Git hard reset", "warning"),
    (r"dd\s+.*if=/dev/zero", "Disk write from /dev/zero", "critical"),
    (r"mkfs\b", "Filesystem format", "critical"),
    (r"pip\s+install\s+(?!-r\s)(?!-e\s)(?!\.)", "Package install", "warning"),
    (r"npm\s+install\s+(?!--save-dev)", "NPM package install", "info"),
    (r"sudo\s+", "Elevated privileges", "warning"),
    (r"eval\s+", "Shell eval", "warning"),
    (r">\s*/dev/sd[a-z]", "Direct device write", "critical"),
    (r":\(\)\s*\{\s*:\|\s*:\s*&\s*\}\s*;", "Fork bomb", "critical"),
)


def excerpt(content: Column, sentences: int = 3) -> Column:
    """The first sentences, ending in a full stop."""
    parts = F.array_join(F.slice(F.split(F.replace(content, F.lit("\n"), F.lit(" ")), r"\. "), 1, sentences), ". ")
    return F.when(parts.endswith("."), parts).otherwise(F.concat(parts, F.lit(".")))


def redact(text: Column, rules: tuple[tuple[str, str], ...] = REDACTIONS) -> Column:
    for mark, pattern in rules:
        text = F.regexp_replace(text, pattern, mark.replace("[", r"\[").replace("]", r"\]"))
    return text


def hash_id(identifier: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), identifier.cast("string")).cast("binary"), 256), 1, 16)


def luhn(number: Column) -> Column:
    """True for 13 to 19 digits whose check digit is right; other characters are passed over."""
    digits = F.reverse(F.regexp_replace(number, r"\D", ""))
    values = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))

    def add(total: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return total + F.when(x["i"] % 2 == 0, x["d"]).when(twice > 9, twice - 9).otherwise(twice)

    return F.length(digits).between(13, 19) & (F.aggregate(values, F.lit(0), add) % 10 == 0)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_number (from 1), line."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_number"), "line")


def _scan(docs: DataFrame, key: str, text: str, patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """key, line_number, pattern_name, matched_text: every match of every pattern.

    A document in which nothing matches never has its lines taken apart.
    """

    def matches(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(f"(?i)({pattern})"), F.lit(1)), lambda m: F.struct(F.lit(name).alias("pattern_name"), m.alias("matched_text")))

    found = [matches(name, p) for name, p in patterns]
    any_match = F.lit(False)
    for _, p in patterns:
        any_match = any_match | F.col(text).rlike("(?i)" + p)
    hit = lines(docs.filter(any_match), key, text)
    return hit.select(key, "line_number", F.explode(F.concat(*found)).alias("m")).select(key, "line_number", "m.pattern_name", "m.matched_text")


def scan_phi(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    severity = F.when(F.col("pattern_name").isin("ssn", "mrn"), "high").otherwise("medium")
    return _scan(docs, key, text, PHI).withColumn("severity", severity)


def scan_cards(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = _scan(docs, key, text, CARDS).filter(~F.col("pattern_name").isin(list(BRANDS)) | luhn(F.col("matched_text")))
    return found.withColumn("severity", F.when(F.col("pattern_name").isin([*BRANDS, "track_data"]), "critical").otherwise("high"))


def dangerous_commands(command: Column, exit_code: Column) -> Column:
    """struct<reasons, severity>: every dangerous pattern, the gravest severity, a failed command a warning."""
    matches = F.array_compact(F.array(*[F.when(command.rlike(p), F.struct(F.lit(r).alias("reason"), F.lit(s).alias("severity"))) for p, r, s in DANGEROUS]))

    def has(level: str) -> Column:
        return F.exists(matches, lambda m: m["severity"] == level)

    severity = first_match([(has("critical"), "critical"), (has("warning"), "warning"), (F.size(matches) > 0, "info"), (exit_code != 0, "warning")], "info")
    return F.struct(F.transform(matches, lambda m: m["reason"]).alias("reasons"), severity.alias("severity"))


def words3(text: Column) -> Column:
    """Distinct lower-case words of three word characters and more: letters of any script, digits, underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{3,})"), F.lit(1)))


def keyword_jaccard(a: Column, b: Column) -> Column:
    x, y = words3(a), words3(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def normalize_route(path: Column) -> Column:
    """Path parameters of any spelling become {param}; a final slash goes."""
    return F.rtrim(F.regexp_replace(path, r"\{[^}]+\}|:[A-Za-z_]\w*|<[^>]+>", "{param}"), F.lit("/"))


def parse_verdict(raw: Column) -> Column:
    """struct<verdict, confidence, valid>: a judge's JSON answer, with or without fences around it."""
    body = F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "reasoning string, verdict string, confidence double, evidence_a string, evidence_b string")
    ok = parsed["verdict"].isin("compatible", "tension", "contradiction") & parsed["confidence"].between(0, 1)
    complete = ok & parsed["reasoning"].isNotNull() & parsed["evidence_a"].isNotNull() & parsed["evidence_b"].isNotNull()
    return F.struct(parsed["verdict"].alias("verdict"), parsed["confidence"].alias("confidence"), F.coalesce(complete, F.lit(False)).alias("valid"))


def package_name(spec: Column) -> Column:
    """The lower-case name of a dependency line, without extras, version and marker."""
    return F.lower(F.regexp_extract(F.trim(spec), r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))


def new_deps(diff: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, package: packages on added lines of a diff (key, line)."""
    added = diff.filter(F.col("line").rlike(r"^\+\s*[\"']?[A-Za-z0-9][A-Za-z0-9._-]*[\"']?\s*([=<>~!:]|$)"))
    return added.select(key, package_name(F.regexp_replace("line", r"^\+\s*[\"']?", "")).alias("package")).distinct()


# Words that make a sentence a requirement.
MODAL = r"(?i)\b(must|shall|should|will|need to|require)\b"


def extract_requirements(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5) -> DataFrame:
    """key, line_number, part, section, requirement: list items, and sentences of other lines that have a modal word.

    A line of one to six # and a title opens a section, which holds for the lines below it. part counts the sentences
    of a line that are requirements, from 1; an item is one.
    """
    rows = lines(docs, key, text).withColumn("line", F.trim("line"))
    header = F.when(F.col("line").rlike(r"^#{1,6}\s+.+$"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    order = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("section", F.coalesce(F.last(header, ignorenulls=True).over(order), F.lit("")))
    item = r"^(?:\d+[.)]\s+|[-*]\s+)(.+)$"
    sentences = F.transform(F.filter(F.split("line", r"(?<=[.!?])\s+"), lambda x: x.rlike(MODAL)), F.trim)
    found = F.when(header.isNull(), F.when(F.col("line").rlike(item), F.array(F.trim(F.regexp_extract("line", item, 1)))).when(F.col("line").rlike(MODAL), sentences))
    each = seen.select(key, "line_number", "section", F.posexplode(found).alias("n", "requirement"))
    return each.filter(F.length("requirement") >= least).select(key, "line_number", (F.col("n") + 1).alias("part"), "section", "requirement")


def extract_imports(files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """key, module: modules that Python and script files import."""
    patterns = (r"(?m)^\s*import\s+([A-Za-z_][\w.]*)", r"(?m)^\s*from\s+([A-Za-z_.][\w.]*)\s+import", r"(?:from|require\()\s*['\"]([^'\"]+)['\"]")
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    return files.select(key, F.explode(found).alias("module"))


def extract_symbols(files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """key, line_number, kind, name of functions and classes."""
    pattern = r"^\s*(?:export\s+)?(?:async\s+)?(def|class|function)\s+([A-Za-z_]\w*)"
    rows = lines(files, key, text).filter(F.col("line").rlike(pattern))
    kind = F.when(F.regexp_extract("line", pattern, 1) == "class", "class").otherwise("function")
    return rows.select(key, "line_number", kind.alias("kind"), F.regexp_extract("line", pattern, 2).alias("name"))


# How routes, answers' types, status codes and path parameters are written.
ROUTE = r"(?i)@(?:app|router)\.(get|post|put|patch|delete|head|options)\s*\(\s*[\"']([^\"']+)[\"']"
METHODS_ROUTE = r"(?i)@(?:app|blueprint|bp)\s*\.route\s*\(\s*[\"']([^\"']+)[\"']\s*(?:,\s*methods\s*=\s*\[([^\]]*)\])?"
RETURNS = r"\)\s*->\s*([\w\[\], |]+)\s*:"
STATUS_CODES = (r"status_code\s*=\s*(\d{3})", r"HTTPException\s*\(\s*(\d{3})")
PATH_PARAMETERS = (r"\{(\w+)\}", r"<(?:\w+:)?(\w+)>")
#: Lines below a route that may hold the handler's answer type, and those that may hold its status codes.
TYPE_LINES, CODE_LINES, HEADER_LINES = 4, 29, 2


def response_type(below: Column) -> Column:
    """html, binary, text or json, by the first answer type that the lines below a route name; json without one."""
    named = F.get(F.filter(F.slice(below, 1, TYPE_LINES), lambda x: x.rlike(RETURNS)), F.lit(0))
    kind = F.trim(F.regexp_extract(named, RETURNS, 1))
    binary = kind.contains("FileResponse") | kind.contains("StreamingResponse")
    return first_match([(kind.contains("HTML"), F.lit("html")), (binary, F.lit("binary")), (kind == "str", F.lit("text"))], F.lit("json"))


def status_codes(below: Column) -> Column:
    """200 and the codes that a handler names, in order; it ends with the first header or decorator after HEADER_LINES lines."""
    ends = F.transform(below, lambda x, i: (i >= HEADER_LINES) & F.ltrim(x).rlike(r"^(?:def |class |@)"))
    end = F.array_position(ends, F.lit(True))
    own = F.when(end > 0, F.slice(below, 1, end.cast("int"))).otherwise(below)

    def codes(pattern: str) -> Column:
        return F.flatten(F.transform(own, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))))

    named = F.concat(*map(codes, STATUS_CODES))
    return F.sort_array(F.array_distinct(F.concat(F.array(F.lit(200)), F.transform(named, lambda x: x.cast("int")))))


def extract_endpoints(files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """key, line_number, method, route, response_type, status_codes, parameters of each handler, two ways of writing them.

    A route of one method is followed to its handler: the answer type within TYPE_LINES lines, codes within CODE_LINES. One
    that lists methods gives a row each (GET without a list), json and no codes. Routes stay as written; normalize_route
    makes them comparable. Lines leave the row only as findings.
    """
    ls = F.col("_lines")

    def parameters(route: Column) -> Column:
        return F.concat(*[F.regexp_extract_all(route, F.lit(p), F.lit(1)) for p in PATH_PARAMETERS])

    def endpoint(x: Column, method: Column, route: Column, kind: Column, codes: Column) -> Column:
        return F.struct((x["at"] + 1).alias("line_number"), F.upper(method).alias("method"), route.alias("route"), kind.alias("response_type"), codes.alias("status_codes"), parameters(route).alias("parameters"))

    def single(x: Column) -> Column:
        below = F.slice(ls, x["at"] + 2, CODE_LINES)
        return F.array(endpoint(x, F.regexp_extract(x["line"], ROUTE, 1), F.regexp_extract(x["line"], ROUTE, 2), response_type(below), status_codes(below)))

    def listed(x: Column) -> Column:
        named = F.regexp_extract_all(F.regexp_extract(x["line"], METHODS_ROUTE, 2), F.lit(r"\"(\w+)\""), F.lit(1))
        methods = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("GET")))
        route = F.regexp_extract(x["line"], METHODS_ROUTE, 1)
        return F.transform(methods, lambda m: endpoint(x, m, route, F.lit("json"), F.array().cast("array<int>")))

    numbered = F.transform(ls, lambda line, i: F.struct(line.alias("line"), i.alias("at")))
    hits = F.filter(numbered, lambda x: x["line"].rlike(ROUTE) | x["line"].rlike(METHODS_ROUTE))
    found = F.flatten(F.transform(hits, lambda x: F.when(x["line"].rlike(ROUTE), single(x)).otherwise(listed(x))))
    return files.withColumn("_lines", F.split(F.col(text), "\n")).select(key, F.explode(found).alias("e")).select(key, "e.*")


def auto_detect(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, dimension, score: summed weights of the rules (dimension, kind, pattern, weight) that a text matches.

    A keyword is looked for as it is, a glob with * for any run within a line, a regex as written; none minds the case. A kind of
    another name matches nothing. rules is a reference table of a few rows, whose measured size decides on a broadcast.
    """
    low = F.lower(F.col(text))
    escaped = F.regexp_replace(F.col("pattern"), r"([^\w*])", r"\\$1")
    glob = F.concat(F.lit("(?i)"), F.replace(escaped, F.lit("*"), F.lit(".*")))
    regex = F.concat(F.lit("(?i)"), F.col("pattern"))
    hit = first_match([(F.col("kind") == "keyword", low.contains(F.lower("pattern"))), (F.col("kind") == "glob", F.rlike(F.col(text), glob)), (F.col("kind") == "regex", F.rlike(F.col(text), regex))], False)
    joined = docs.select(key, text).crossJoin(rules).filter(hit)
    return joined.groupBy(key, "dimension").agg(F.round(F.sum("weight"), 6).alias("score"))


# What an anonymous decision keeps as it is, what it keeps as a hash, and what it keeps redacted.
KEPT = ("dimensions", "confidence", "decision_type", "source_type")
HASHED = ("made_by", "project")
REDACTED = ("title", "content", "rationale")


def anonymize(decisions: DataFrame, salt: str) -> DataFrame:
    """Decisions with people and projects as salted hashes and texts redacted; other columns than those of a fixed list go."""
    have = set(decisions.columns)
    hashed = {"made_by": hash_id(F.col("made_by"), salt), "project": F.concat(F.lit("org-"), hash_id(F.col("project"), salt))}
    columns = [*[F.col(c) for c in ("id", *KEPT) if c in have], *[hashed[c].alias(c) for c in HASHED if c in have], *[redact(F.col(c)).alias(c) for c in REDACTED if c in have]]
    return decisions.select(*columns)


def anonymized_fields(decisions: DataFrame, by: str = "project") -> DataFrame:
    """by, original_fields, redacted_fields, hashed_identifiers: fields with a value, those of them that anonymize leaves out, and those that it hashes."""
    def present(names: list[str]) -> Column:
        return F.sum(sum((F.col(c).isNotNull().cast("long") for c in names), F.lit(0)))

    gone = [c for c in decisions.columns if c not in (*KEPT, *HASHED, *REDACTED)]
    return decisions.groupBy(by).agg(
        present(decisions.columns).alias("original_fields"), present(gone).alias("redacted_fields"), present([c for c in HASHED if c in decisions.columns]).alias("hashed_identifiers")
    )

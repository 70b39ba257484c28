"""Column functions that name, classify and key values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwing.schemas import SOURCE_CONFIDENCE

# Free-form type names of each canonical type.
TYPE_NAMES = {
    "architectural": ("architecture", "architectural", "infrastructure", "deployment", "system-design"),
    "technical": ("technical", "database", "framework", "security", "testing", "async-processing", "api-design", "performance", "tooling"),
    "product": ("product", "feature", "business", "ux"),
    "constraint": ("constraint", "limitation", "requirement", "compliance"),
}
# Tools of known category; other names go by substring, in this order.
TOOLS = {
    "filesystem": ("read_file", "write_file", "list_directory", "search_files", "create_directory", "move_file", "delete_file", "get_file_info"),
    "shell": ("run_command", "execute_command", "bash", "terminal"),
    "git": tuple(f"git_{x}" for x in ("commit", "push", "pull", "branch", "checkout", "diff", "log", "status", "add", "reset", "tag", "merge", "rebase", "stash")),
}
TOOL_PARTS = (("filesystem", ("file", "read", "write", "directory", "path")), ("shell", ("shell", "exec", "command", "bash", "terminal")), ("git", ("git",)))
# Categories of a changed path, first match wins. Names with capitals never match a lower-case path.
PATH_PARTS = (
    ("test", ("test", "spec", "e2e")),
    ("ci", (".github/workflows", ".gitlab-ci", ".circleci", ".github/actions")),
    ("dependency", ("requirements.txt", "requirements-", "pyproject.toml", "setup.py", "setup.cfg", "poetry.lock", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.mod", "go.sum")),
    (
        "config",
        (".env", "dockerfile", "docker-compose", ".dockerignore", ".eslintrc", ".prettierrc", "tsconfig", "ruff.toml", ".gitignore", ".editorconfig", "makefile", "alembic.ini", "pytest.ini", "tox.ini", "governance.yaml", ".smm/"),
    ),
    ("generated", ("agents.md", "claude.md", ".cursor/rules", "dist/", "build/")),
    ("docs", ("readme", "changelog", "contributing", "license", "docs/", "doc/", ".md")),
)
SOURCE_SUFFIXES = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "kt", "rb", "php", "cs", "swift", "c", "cpp")
OPERATION_SEVERITY = {
    "critical": ("force_push", "reset_hard"),
    "warning": ("branch_delete", "tag_delete", "rebase"),
    "info": ("commit", "push", "branch_create", "checkout", "tag_create", "merge", "stash", "cherry_pick"),
}
CRITICAL_KEYS = ("DATABASE_URL", "DB_PASSWORD", "SECRET_KEY", "PRIVATE_KEY", "AWS_SECRET_ACCESS_KEY", "ANTHROPIC_API_KEY", "OPENAI_API_KEY")
WARNING_KEYS = ("CORS", "ALLOWED_HOSTS", "DEBUG", "LOG_LEVEL", "MAX_CONNECTIONS", "TIMEOUT", "RATE_LIMIT")
PATH_DIMENSIONS = {
    "database": ("db", "model", "migration", "sql", "schema"),
    "auth": ("auth", "login", "session", "token", "jwt"),
    "caching": ("cache", "redis", "memcache"),
    "api-style": ("api", "route", "endpoint", "handler", "view"),
    "deployment": ("deploy", "docker", "k8s", "terraform", "infra"),
    "concurrency": ("async", "worker", "queue", "celery", "task"),
    "logging": ("log", "monitor", "metric", "trace"),
    "testing": ("test", "spec", "fixture"),
    "error-handling": ("error", "exception", "handler"),
    "state-management": ("state", "store", "redux", "context"),
    "messaging": ("message", "event", "pubsub", "kafka", "rabbitmq"),
    "security": ("security", "encrypt", "secret", "cert"),
}
SIGNAL_EVENTS = {
    "file.changed": ("file_changes", "config_change", "config_sensitivity"),
    "dependency.updated": ("dependency_added", "dependency_modified", "dependency_removed"),
    "llm.call_observed": ("cost_spike", "latency_spike"),
}
# Price per million tokens in and out by part of the model's name, first match wins.
PRICES = (
    ("claude-opus", 15.0, 75.0),
    ("claude-sonnet", 3.0, 15.0),
    ("claude-haiku", 0.25, 1.25),
    ("gpt-4o", 2.5, 10.0),
    ("gpt-4o-mini", 0.15, 0.6),
    ("gpt-4", 30.0, 60.0),
    ("gpt-3.5", 0.5, 1.5),
)


def contains_any(col: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | col.contains(part)
    return out


def first_match(rules: Iterable[tuple[Column, object]], default: object) -> Column:
    """The value of the first rule that holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for condition, value in reversed(list(rules)):
        out = F.when(condition, value).otherwise(out)
    return out


def normalize_type(raw: Column) -> Column:
    name = F.lower(F.trim(raw))
    return first_match([(name.isin(*names), kind) for kind, names in TYPE_NAMES.items()], "technical")


def computed_confidence(confidence: Column, source: Column, has_alternatives: Column, rationale: Column, content: Column) -> Column:
    """A stored 0.75 is the default and gives way to the source's base plus up to three boosts of 0.05."""
    base = first_match([(source == k, v) for k, v in SOURCE_CONFIDENCE.items()], 0.5)
    length = F.length(F.coalesce(content, F.lit("")))

    def boost(condition: Column) -> Column:
        return F.when(condition, 0.05).otherwise(0.0)

    total = base + boost(has_alternatives) + boost((F.coalesce(rationale, F.lit("")) != "") & (length > 200)) + boost(length > 500)
    return F.when(confidence == 0.75, F.least(F.lit(1.0), total)).otherwise(confidence)


def pair_key(a: Column, b: Column) -> Column:
    x, y = a.cast("string"), b.cast("string")
    return F.concat_ws("::", F.least(x, y), F.greatest(x, y))


def dedup_key(pattern: Column, files: Column, summary: Column) -> Column:
    return F.concat_ws("::", pattern, F.coalesce(F.get(files, F.lit(0)), F.lit("")), F.substring(summary, 1, 80))


def tool_category(name: Column) -> Column:
    low = F.lower(F.trim(name))
    exact = [(low.isin(*names), kind) for kind, names in TOOLS.items()]
    return first_match([*exact, *[(contains_any(low, parts), kind) for kind, parts in TOOL_PARTS]], "external")


def change_category(path: Column) -> Column:
    low = F.lower(path)
    rules = [(contains_any(low, parts), kind) for kind, parts in PATH_PARTS]
    suffix = low.rlike(r"[^/.][^/]*\.(" + "|".join(SOURCE_SUFFIXES) + ")$")
    return first_match([*rules, (suffix, "source")], "other")


def git_severity(operation: Column) -> Column:
    return first_match([(operation.isin(*ops), level) for level, ops in OPERATION_SEVERITY.items()], "info")


def config_sensitivity(content: Column) -> Column:
    up = F.upper(F.coalesce(content, F.lit("")))
    return first_match([(contains_any(up, CRITICAL_KEYS), "critical"), (contains_any(up, WARNING_KEYS), "warning")], "info")


def path_dimensions(path: Column) -> Column:
    low = F.lower(path)
    return F.array_compact(F.array(*[F.when(contains_any(low, parts), name) for name, parts in PATH_DIMENSIONS.items()]))


def signal_event_type(name: Column) -> Column:
    return first_match([(name.isin(*names), kind) for kind, names in SIGNAL_EVENTS.items()], "pattern.detected")


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: Iterable[tuple[str, float, float]] = PRICES, default: tuple[float, float] = (0.0, 0.0)) -> Column:
    low = F.lower(model)
    rules = [(low.contains(part), (tokens_in * i + tokens_out * o) / F.lit(1e6)) for part, i, o in prices]
    return first_match(rules, (tokens_in * default[0] + tokens_out * default[1]) / F.lit(1e6))


def nli_stats(entail: Column, neutral: Column, contradict: Column) -> Column:
    """struct<label, entropy, ambiguous>: the likeliest class, entropy in bits, and whether no class reaches 0.5."""
    top = F.greatest(entail, neutral, contradict)
    label = F.when(contradict == top, "contradiction").when(entail == top, "entailment").otherwise("neutral")

    def part(p: Column) -> Column:
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return F.struct(label.alias("label"), F.round(part(entail) + part(neutral) + part(contradict), 6).alias("entropy"), (top < 0.5).alias("ambiguous"))


def glob_to_regex(glob: Column) -> Column:
    """A shell pattern as an anchored regular expression: * any run, ? one character."""
    escaped = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def path_access(path: Column, blocked: Column, allowed: Column) -> Column:
    """False where a blocked pattern matches, or where there are allowed patterns and none matches."""
    hit = [F.exists(globs, lambda g: F.rlike(path, glob_to_regex(g))) for globs in (blocked, allowed)]
    return ~hit[0] & ((F.size(allowed) == 0) | hit[1])


def dimension_access(dimensions: Column, restricted: Column, allowed: Column) -> Column:
    """No restricted dimension, and nothing outside the allowed ones if there are any."""
    clear = F.size(F.array_intersect(dimensions, restricted)) == 0
    return clear & ((F.size(allowed) == 0) | (F.size(F.array_except(dimensions, allowed)) == 0))

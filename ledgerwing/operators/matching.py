"""Best matches and pattern matches between texts, paths and reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.functions.labels import glob_to_regex
from ledgerwing.functions.text import words3


def coverage(requirements: DataFrame, decisions: DataFrame, req_id: str, req_text: str, dec_id: str, dec_text: str, full: float = 0.6, partial: float = 0.3) -> DataFrame:
    """req_id, best_id, score, status: the decision of highest keyword similarity for each requirement.

    Candidates share a word, so sizes and common words come from one equi-join on words. Of decisions only words that
    a requirement has are kept, by a join with the requirements' words; ties go to the smaller id. A requirement that
    shares no word with any decision is not_started, with score 0 and no best_id.
    """
    r = requirements.select(F.col(req_id).alias("r"), words3(F.col(req_text)).alias("w"))
    q = decisions.select(F.col(dec_id).alias("d"), words3(F.col(dec_text)).alias("w"))
    rw = r.select("r", F.size("w").alias("nr"), F.explode("w").alias("t"))
    qw = q.select("d", F.size("w").alias("nd"), F.explode("w").alias("t"))
    common = rw.join(qw, "t").groupBy("r", "d").agg(F.count("*").alias("n"), F.first("nr").alias("nr"), F.first("nd").alias("nd"))
    score = F.col("n") / (F.col("nr") + F.col("nd") - F.col("n"))
    best = common.withColumn("j", score).withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("j"), "d"))).filter("k = 1")
    status = F.when(F.col("j") >= full, "implemented").when(F.col("j") >= partial, "partial").otherwise("not_started")
    whole = r.select("r").join(best, "r", "left")
    return whole.select(F.col("r").alias(req_id), F.col("d").alias("best_id"), F.round(F.coalesce("j", F.lit(0.0)), 6).alias("score"), status.alias("status"))


def coverage_percent(rows: DataFrame, by: list[str], partial_weight: float = 0.5) -> DataFrame:
    """Share of implemented ones plus partial_weight of partial ones, in percent; 0 gives the share of implemented ones alone."""
    part = F.when(F.col("status") == "implemented", 1.0).when(F.col("status") == "partial", partial_weight).otherwise(0.0)
    return rows.groupBy(*by).agg(F.round(100 * F.sum(part) / F.count("*"), 6).alias("percent"))


def owners_for(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """path, owners: of the rules (pattern, owners, line_number) that match a path, the last one counts.

    rules is one file's worth of lines, whose measured size decides on a broadcast.
    """
    regex = F.rlike(F.col(path), rule_regex(F.col("pattern")))
    hit = paths.select(path).distinct().crossJoin(rules).filter(regex)
    return hit.groupBy(path).agg(F.max_by("owners", "line_number").alias("owners"))


def rule_regex(pattern: Column) -> Column:
    """An owner rule as a regular expression: rooted by a leading slash, a directory by a final one."""
    core = F.regexp_replace(F.regexp_replace(pattern, r"^/", ""), r"/$", "/*")
    body = F.regexp_replace(F.regexp_replace(glob_to_regex(core), r"^\^", ""), r"\$$", "")
    return F.concat(F.when(pattern.startswith("/"), F.lit("^/?")).otherwise(F.lit("(^|/)")), body, F.lit("(/.*)?$"))


def files_for_dimensions(files: DataFrame, globs: DataFrame, path: str = "path") -> DataFrame:
    """path, dimension: files that a dimension's patterns match (dimension, pattern: a few dozen rows)."""
    hit = files.select(path).crossJoin(globs).filter(F.rlike(F.col(path), glob_to_regex(F.col("pattern"))))
    return hit.select(path, "dimension").distinct()


def decisions_for_file(files: DataFrame, tiers: DataFrame, globs: DataFrame, path: str = "path") -> DataFrame:
    """path, id, tier: for each file of a project the decisions that always apply, and those whose patterns match.

    files: project, path. tiers: id, project, tier. globs: id, dimension pattern.
    """
    always = files.join(tiers.filter("tier = 'always'"), "project").select(path, "id", "tier")
    auto = tiers.filter("tier = 'auto'").join(globs, "id").select("project", "id", "tier", "pattern")
    matched = files.join(auto, "project").filter(F.rlike(F.col(path), glob_to_regex(F.col("pattern")))).select(path, "id", "tier").distinct()
    return always.unionByName(matched)


def detect_dimensions(evidence: DataFrame, taxonomy: DataFrame, key: str = "project") -> DataFrame:
    """key, dimension, found, confidence = min(1, 0.4 + 0.15 n): evidence (key, item) met in the taxonomy (dimension, item)."""
    hits = evidence.join(taxonomy, "item").groupBy(key, "dimension").agg(F.sort_array(F.collect_set("item")).alias("found"))
    return hits.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.4 + 0.15 * F.size("found")), 6))


def contract_violations(endpoints: DataFrame) -> DataFrame:
    """service, method, route, kind: a route declared twice in a service, or with another response type elsewhere."""
    twice = endpoints.groupBy("service", "method", "route").agg(F.count("*").alias("n")).filter("n > 1").select("service", "method", "route", F.lit("duplicate_route").alias("kind"))
    types = endpoints.groupBy("method", "route").agg(F.countDistinct("response_type").alias("k"), F.countDistinct("service").alias("s")).filter("k > 1 and s > 1")
    differ = endpoints.join(types, ["method", "route"], "left_semi").select("service", "method", "route").distinct().withColumn("kind", F.lit("response_mismatch"))
    return twice.unionByName(differ)


# Names of technologies in a text, and the one name that several stand for.
TECHNOLOGY = (
    r"\b(postgres(?:ql)?|psycopg2?|asyncpg|sqlite\d?|aiosqlite|mysql|mariadb|pymysql|mongodb|pymongo|redis|cassandra|dynamodb|rest|graphql|grpc|websocket"
    r"|docker|kubernetes|k8s|serverless|lambda|celery|rabbitmq|kafka|nats|sqs|jwt|oauth|saml|react|vue|angular|svelte|fastapi|flask|django|express|next\.?js"
    r"|pytest|jest|vitest|mocha|asyncio|threading|multiprocessing|sqlalchemy|prisma|typeorm|sequelize)\b"
)
CANONICAL = {
    "psycopg2": "postgresql",
    "psycopg": "postgresql",
    "asyncpg": "postgresql",
    "postgres": "postgresql",
    "sqlite3": "sqlite",
    "aiosqlite": "sqlite",
    "pymysql": "mysql",
    "mariadb": "mysql",
    "pymongo": "mongodb",
}
CONFLICT_CONFIDENCE = 0.6


def technologies(title: Column, content: Column) -> Column:
    """The technologies that a decision stands for, sorted: those of its title, and of its content before it says `do not`."""
    body = F.lower(F.coalesce(content, F.lit("")))
    stop = F.instr(body, "do not")
    said = F.when(stop > 1, F.substring(body, F.lit(1), stop - 1)).otherwise(body)
    found = F.regexp_extract_all(F.concat_ws(" ", F.lower(title), said), F.lit(f"(?U){TECHNOLOGY}"), F.lit(1))
    names = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.coalesce(F.element_at(names, x), x))))


def tech_conflicts(pairs: DataFrame) -> DataFrame:
    """pairs (a_title, a_content, b_title, b_content) whose decisions stand for technologies of which they share none.

    technologies_a, technologies_b, verdict and confidence come in; a decision that names none conflicts with nothing.
    """
    both = pairs.withColumn("technologies_a", technologies(F.col("a_title"), F.col("a_content"))).withColumn("technologies_b", technologies(F.col("b_title"), F.col("b_content")))
    hit = (F.size("technologies_a") > 0) & (F.size("technologies_b") > 0) & ~F.arrays_overlap("technologies_a", "technologies_b")
    return both.filter(hit).withColumn("verdict", F.lit("contradiction")).withColumn("confidence", F.lit(CONFLICT_CONFIDENCE))

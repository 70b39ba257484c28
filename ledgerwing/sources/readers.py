"""Readers and writers of governance records, traces, session logs, source trees and labelled pairs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing import schemas
from ledgerwing.functions.assumptions import TEST_PATH
from ledgerwing.functions.labels import change_category

# Folders that hold no sources; hidden ones are passed over too.
SKIPPED = (".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", ".venv", "venv", ".tox", ".eggs", "dist", "build", ".nox")
#: Folders below a root that are gone into.
MAX_DEPTH = 8


def _json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; files that do not parse are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return _json_documents(spark, path, schemas.DECISION).filter("id is not null")


def read_contradictions(spark: SparkSession, path: str) -> DataFrame:
    return _json_documents(spark, path, schemas.CONTRADICTION).filter("id is not null")


def read_assumptions(spark: SparkSession, path: str) -> DataFrame:
    """Assumption files; stats.json beside them is not one."""
    return _json_documents(spark, path, schemas.ASSUMPTION).filter(~F.col("_metadata.file_name").endswith("stats.json")).filter("id is not null")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return _json_documents(spark, path, schemas.SESSION).filter("token is not null")


def read_trace_events(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines; broken ones are left out. Callers that page order by timestamp."""
    return spark.read.schema(schemas.TRACE_EVENT).option("mode", "DROPMALFORMED").json(path).filter("timestamp is not null or type is not null")


def stream_trace_events(spark: SparkSession, path: str) -> DataFrame:
    """The same lines as they arrive in new files of a folder."""
    return spark.readStream.schema(schemas.TRACE_EVENT).option("mode", "DROPMALFORMED").json(path)


def read_observation(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """spans, edges, tool_calls, shell, vcs and reads from JSON lines under folder/<name>."""
    kinds = {"spans": schemas.SPAN, "edges": schemas.CAUSAL_EDGE, "tool_calls": schemas.TOOL_CALL, "shell": schemas.SHELL_RUN, "vcs": schemas.VCS_OPERATION, "reads": schemas.FILE_READ}
    return {name: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{folder}/{name}") for name, schema in kinds.items()}


LOG_LINE = (
    "type string, timestamp string, message struct<model:string, usage:struct<input_tokens:bigint, cache_creation_input_tokens:bigint, "
    "cache_read_input_tokens:bigint, output_tokens:bigint>, content:string>"
)


def parse_session_logs(lines: DataFrame, cost: Column | None = None, column: str = "value") -> DataFrame:
    """llm_call events from raw log lines: assistant rows that name a model and its usage.

    Input tokens count what was read fresh, written to and read from a cache. The preview is the first 200 characters
    of the first text block, or of plain text content.
    """
    row = F.from_json(F.col(column), LOG_LINE)
    parsed = lines.select(row.alias("r")).filter("r.type = 'assistant' and r.message.model is not null and r.message.model <> '' and r.message.usage is not null and r.timestamp <> ''")
    usage = F.col("r.message.usage")
    tokens_in = sum((F.coalesce(usage[c], F.lit(0)) for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")), F.lit(0))
    blocks = F.from_json(F.col("r.message.content"), "array<struct<type:string, text:string>>")
    first = F.get(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(0))["text"]
    listed = F.substring(F.col("r.message.content"), 1, 1) == "["
    out = parsed.select(
        F.col("r.timestamp").alias("timestamp"),
        F.lit("llm_call").alias("type"),
        F.col("r.message.model").alias("model"),
        tokens_in.cast("long").alias("input_tokens"),
        F.coalesce(usage["output_tokens"], F.lit(0)).alias("output_tokens"),
        F.coalesce(F.substring(F.when(listed, first).otherwise(F.col("r.message.content")), 1, 200), F.lit("")).alias("prompt_preview"),
    )
    return out if cost is None else out.withColumn("cost_usd", F.round(cost, 6))


def write_tables(df: DataFrame, path: str, by: str = "project") -> None:
    """Partitioned by project, clustered first so that a project has few files."""
    df.repartition(by).write.mode("append").partitionBy(by).parquet(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELLED_PAIR).option("mode", "DROPMALFORMED").json(path)


def invalid_pair_reasons(pairs: DataFrame) -> DataFrame:
    """pair_id and what is wrong with each labelled pair; an empty array for a sound one."""
    empty = [F.when(F.trim(F.coalesce(c, F.lit(""))) == "", f"{c} is empty") for c in ("decision_a", "decision_b", "reasoning")]
    label = F.when(~F.coalesce(F.col("label").isin("compatible", "tension", "contradiction"), F.lit(False)), "unknown label")
    same = F.when(F.col("decision_a") == F.col("decision_b"), "both sides are equal")
    return pairs.select("pair_id", F.array_compact(F.array(*empty, label, same)).alias("reasons"))


def kept_folders(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED, max_depth: int | None = MAX_DEPTH) -> list[str]:
    """root and the folders below it, without hidden and skipped ones: those are never listed, however much they hold.

    Names of folders pass through the driver, level by level, as those of Spark's own file index do; files are not read.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    level, found, depth = [top], [], 0
    while level:
        found += [p.toString() for p in level]
        if max_depth is not None and depth >= max_depth:
            break
        below = [s.getPath() for p in level for s in files.listStatus(p) if s.isDirectory()]
        level = [p for p in below if not p.getName().startswith(".") and p.getName() not in skipped]
        depth += 1
    return found


def below(root: str, path: Column) -> Column:
    """A file's path below root, whatever scheme and slashes it is given with."""
    name = root.split("://", 1)[-1].removeprefix("file:").strip("/")
    return F.regexp_replace(path, "^.*?" + re.escape("/" + name + "/").replace("/", "/+"), "")


def read_source_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("py",), max_depth: int = MAX_DEPTH) -> DataFrame:
    """path (below root), source of every file with one of the suffixes, without tests and skipped folders."""
    pattern = "*.{" + ",".join(suffixes) + "}"
    files = spark.read.option("pathGlobFilter", pattern).text(kept_folders(spark, root, max_depth=max_depth), wholetext=True)
    path = below(root, F.col("_metadata.file_path"))
    return files.select(path.alias("path"), F.col("value").alias("source")).filter(~F.col("path").rlike(TEST_PATH))


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """path, content_hash, size, category of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"), change_category(F.col("path")).alias("category"))


def evidence_bundle(decisions: DataFrame, contradictions: DataFrame, trail: DataFrame, path: str) -> None:
    """One folder a table, each row as JSON text with its digest."""
    for name, df in (("decisions", decisions), ("contradictions", contradictions), ("audit", trail)):
        body = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
        df.select(body.alias("entry"), F.sha2(body.cast("binary"), 256).alias("digest")).write.mode("overwrite").parquet(f"{path}/{name}")

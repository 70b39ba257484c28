"""Intermediate tables in the shared checkpoint folder, and helpers that every operator of this package uses."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.session import shared_folder

#: What holds while a table is written. Spark drops an execution's shuffle files once it ends, which is safe for a
#: table that has been written; and rows of long texts go to Python in small batches.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: the result survives lost executors, and what follows never recomputes it. batch_rows: rows that
    go to Python at once, where they are larger than documents.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with held(spark, WHILE_WRITING | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)} if batch_rows else {})):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop_materialized(table: DataFrame) -> None:
    """Delete the files behind a table that materialize() returned, once nothing reads it any more."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def id_text(col: Column) -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def id_bucket(col: Column, n: int) -> Column:
    """crc32(id as text) mod n, the split key that held-out folds use."""
    return F.crc32(id_text(col).cast("binary")) % F.lit(n)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: list[str], name: str) -> str:
    """name, with a number behind it if columns has it; case does not count."""
    taken = {c.lower() for c in columns}
    return next(x for x in (name, *[f"{name}{n}" for n in range(len(columns))]) if x.lower() not in taken)

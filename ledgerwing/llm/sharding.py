"""Contiguous shards of near equal bytes, from global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.llm.storage import id_text, materialize

#: Partitions of the order: ranges of the leading hex digits of a text's MD5.
RANGE_DIGITS = 3
RANGES = 16**RANGE_DIGITS


def assign_shards(docs: DataFrame, shards: int = 8, text_col: str = "text", id_col: str = "doc_id", whole_group_share: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    Documents are ordered by the MD5 of their text, then doc_id (nulls first), so equal texts stand together. The
    order falls into partitions by MD5 range; sizes are summed in each partition, the totals summed up over the
    partitions, and the order cut where the byte count passes k/shards of the whole: a row goes to the shard that
    holds its middle byte. Equal texts go by the middle byte of their group and so stay in one shard, unless they
    fill more than 1/whole_group_share of a shard; a larger group is cut like any other rows.

    A text that more rows share than an average partition holds gets partitions of its own, cut by the CRC-32 of
    doc_id, so that no task gets all of it; they come before the other texts of its range, and their totals give the
    middle byte of its group. At most RANGES texts can be so frequent, which bounds all tables that are joined by
    broadcast. size: UTF-8 bytes plus 1, a null text counts as empty. slot: from 0 without gaps in
    each shard. Repeated rows take a slot each. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("key"),
    )
    rows = materialize(rows, "shard-sizes")
    n_rows = rows.count()
    per_range = n_rows / RANGES
    frequent = rows.groupBy("key").agg(F.count("*").alias("copies")).filter(F.col("copies") > max(per_range, 64))
    frequent = frequent.select("key", F.ceil(F.col("copies") / max(per_range, 64)).alias("parts"))
    placed = rows.join(F.broadcast(frequent), "key", "left").select(
        "doc_id",
        "size",
        "text_crc32",
        "key",
        F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("int").alias("range"),
        F.when(F.col("parts").isNotNull(), F.col("key")).alias("hot"),
        F.coalesce(F.pmod(F.crc32(id_text(F.col("doc_id")).cast("binary")), F.col("parts")), F.lit(0)).cast("int").alias("part"),
    )
    partition = ["range", "hot", "part"]
    # hot texts come before the others of their range; nulls last in both orders below
    partition_order = [F.asc("range"), F.asc_nulls_last("hot"), F.asc("part")]
    before = Window.orderBy(*partition_order).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*partition).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # the partitions of a hot text stand together and hold nothing else, so their totals are the text's
    whole_text = Window.partitionBy("hot")
    starts = totals.select(
        *partition,
        "bytes",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_start"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_start"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    starts = materialize(
        starts.withColumn("hot_bytes", F.when(F.col("hot").isNotNull(), F.sum("bytes").over(whole_text)))
        .withColumn("hot_at", F.when(F.col("hot").isNotNull(), F.min("byte_start").over(whole_text)))
        .drop("bytes"),
        "shard-partitions",
    )
    inside = Window.partitionBy(*partition).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    same_text = Window.partitionBy(*partition, "key")
    same_partition = [placed[c].eqNullSafe(starts[c]) for c in partition]
    counted = (
        placed.join(F.broadcast(starts), same_partition)
        .select(*[placed[c] for c in placed.columns], "byte_start", "row_start", "all_bytes", "hot_bytes", "hot_at")
        .withColumn("at", F.col("byte_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("index", F.col("row_start") + F.coalesce(F.count("*").over(inside), F.lit(0)))
        .withColumn("group_bytes", F.coalesce("hot_bytes", F.sum("size").over(same_text)))
        .withColumn("group_at", F.coalesce("hot_at", F.min("at").over(same_text)))
    )
    whole = F.col("group_bytes") * (whole_group_share * shards) <= F.col("all_bytes")
    twice_middle = F.when(whole, 2 * F.col("group_at") + F.col("group_bytes")).otherwise(2 * F.col("at") + F.col("size"))
    counted = counted.withColumn("twice_middle", twice_middle)
    shard = F.expr(f"cast(least(twice_middle * {shards} div (2 * all_bytes), {shards - 1}) as int)")
    cut = materialize(counted.select("doc_id", "size", "text_crc32", "index", shard.alias("shard")), "shards")
    firsts = cut.groupBy("shard").agg(F.min("index").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **parameters) -> None:
    """Write whole documents under path/shard=k, each shard sorted by slot. doc_id must be unique and not null."""
    placed = assign_shards(docs, shards, **parameters).select("doc_id", "shard", "slot")
    joined = docs.drop("shard", "slot").join(placed, "doc_id")
    ranged = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(path)


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """assign_shards with the columns law (always `bytes`) and grown_shard (always null: only a key law has one)."""
    return assign_shards(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

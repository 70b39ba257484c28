"""Tamper evidence for many logs at once: leaf and node hashes, roots, inclusion proofs and hash chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF, NODE = b"\x00", b"\x01"


def leaf_hash(data: Column) -> Column:
    """SHA-256 of a zero byte and the data."""
    return F.unhex(F.sha2(F.concat(F.lit(LEAF), data.cast("binary")), 256))


def node_hash(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(NODE), left, right), 256))


#: Levels of a tree that one group folds at once, from an array of so many leaves.
FOLD = 12
_HASHES = "array<binary>"


def _paired(level: Column) -> Column:
    """The level above an array of hashes: neighbours are hashed together, an odd last one moves up as it is."""

    def up(i: Column) -> Column:
        left, right = F.get(level, 2 * i), F.get(level, 2 * i + 1)
        return F.when(right.isNull(), left).otherwise(node_hash(left, right))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), up)


def _leaf_nodes(leaves: DataFrame) -> DataFrame:
    """log, idx, hash, n of the lowest nodes, each of one leaf."""
    return leaves.select("log", "idx", leaf_hash(F.col("data")).alias("hash"), F.lit(1).cast("long").alias("n"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """log, block, hashes, n: runs of 2^FOLD neighbouring nodes (log, idx, hash, n) in order, and the leaves below them."""
    block = F.shiftright("idx", FOLD)
    runs = nodes.groupBy("log", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("run"), F.sum("n").alias("n"))
    return runs.select("log", "block", F.transform("run", lambda x: x["hash"]).alias("hashes"), "n")


def tree_levels(leaves: DataFrame) -> DataFrame:
    """log, level, idx, hash of every node of every log's tree, from its leaves (log, idx, data).

    A group folds 2^FOLD neighbouring nodes up by FOLD levels and puts all of them out, so a log of n leaves takes
    log(n) / FOLD shuffles; what is above them starts from their tops alone.
    """
    nodes, low, out = _leaf_nodes(leaves), 0, None
    size = (leaves.agg(F.max("idx")).first()[0] or 0) + 1
    while True:
        empty = F.array().cast(f"array<{_HASHES}>")
        start = F.struct(F.col("hashes").alias("now"), empty.alias("all"))
        folded = F.aggregate(F.sequence(F.lit(1), F.lit(FOLD)), start, lambda s, _: F.struct(_paired(s["now"]).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all")))
        blocks = _blocks(nodes).select("log", "block", folded.alias("f"), "n").select("log", "block", "f.now", "f.all", "n")
        each = blocks.select("log", "block", F.posexplode("all").alias("up", "level_hashes")).select("log", "block", "up", F.posexplode("level_hashes").alias("at", "hash"))
        # above a block's top there is nothing left to fold in it
        height = min(FOLD, max(0, (size - 1).bit_length()))
        kept = each.filter(F.col("up") < max(height, 1)).select("log", (F.col("up") + low).alias("level"), (F.expr(f"shiftleft(block, {FOLD} - up)") + F.col("at")).cast("long").alias("idx"), "hash")
        tops = blocks.select("log", F.col("block").alias("idx"), F.get("now", F.lit(0)).alias("hash"), "n")
        out = kept if out is None else out.unionByName(kept)
        if size <= 1 << FOLD:
            if height:
                out = out.unionByName(tops.filter("idx = 0").select("log", F.lit(low + height).alias("level"), "idx", "hash"))
            return out
        nodes, low, size = tops, low + FOLD, -(-size // (1 << FOLD))


def merkle_root(leaves: DataFrame, longest: int | None = None) -> DataFrame:
    """log, size, root (hex) of every log; FOLD levels a shuffle. longest: leaves of the longest log, counted if not given.

    Sizes are summed on the way up, so that leaves are read once and no log is joined.
    """
    size = (leaves.agg(F.max("idx")).first()[0] or 0) + 1 if longest is None else longest
    nodes = _leaf_nodes(leaves)
    while True:
        top = F.aggregate(F.sequence(F.lit(1), F.lit(FOLD)), F.col("hashes"), lambda level, _: _paired(level))
        nodes = _blocks(nodes).select("log", F.col("block").alias("idx"), F.get(top, F.lit(0)).alias("hash"), "n")
        size = -(-size // (1 << FOLD))
        if size <= 1:
            return nodes.select("log", F.col("n").alias("size"), F.lower(F.hex("hash")).alias("root"))


def inclusion_proofs(leaves: DataFrame) -> DataFrame:
    """log, idx, size, proof (array of sibling hashes from the leaf up) for every leaf."""
    nodes = tree_levels(leaves)
    height = nodes.agg(F.max("level")).first()[0] or 0
    sizes = leaves.groupBy("log").agg(F.count("*").alias("size"))
    steps = leaves.select("log", "idx", F.explode(F.sequence(F.lit(0), F.lit(max(height - 1, 0)))).alias("level"))
    sibling = F.expr("shiftright(idx, level) ^ 1").cast("long")
    asked = steps.withColumn("at", sibling)
    found = asked.join(nodes.withColumnRenamed("idx", "at"), ["log", "level", "at"])
    proof = found.groupBy("log", "idx").agg(F.sort_array(F.collect_list(F.struct("level", "hash"))).alias("p"))
    joined = leaves.select("log", "idx").join(sizes, "log").join(proof, ["log", "idx"], "left")
    return joined.select("log", "idx", "size", F.coalesce(F.transform("p", lambda x: x["hash"]), F.array().cast("array<binary>")).alias("proof"))


def verify_inclusion(proofs: DataFrame, leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """log, idx, verified: whether each proof leads from its leaf to the log's root."""
    rows = proofs.join(leaves.select("log", "idx", leaf_hash(F.col("data")).alias("leaf")), ["log", "idx"]).join(roots.select("log", "root"), "log")
    start = F.struct(F.col("leaf").alias("hash"), F.col("idx").cast("long").alias("i"), F.col("size").cast("long").alias("left"), F.lit(0).alias("used"))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest("size", F.lit(1)))).cast("int")))

    def step(s: Column, _: Column) -> Column:
        other = F.get("proof", s["used"])
        odd, paired, more = s["i"] % 2 == 1, s["i"] + 1 < s["left"], s["left"] > 1
        hashed = F.when(more & odd, node_hash(other, s["hash"])).when(more & paired, node_hash(s["hash"], other)).otherwise(s["hash"])
        used = F.when(more & (odd | paired), s["used"] + 1).otherwise(s["used"])
        return F.struct(hashed.alias("hash"), F.floor(s["i"] / 2).cast("long").alias("i"), F.floor((s["left"] + 1) / 2).cast("long").alias("left"), used.alias("used"))

    end = F.aggregate(rounds, start, step)
    return rows.select("log", "idx", F.coalesce(F.lower(F.hex(end["hash"])) == F.col("root"), F.lit(False)).alias("verified"))


def verify_consistency(leaves: DataFrame, old: DataFrame) -> DataFrame:
    """log, consistent: whether the first leaves of a log still give the root that was noted (log, size, root).

    old is read several times, so it should be a written table.
    """
    longest = old.agg(F.max("size")).first()[0] or 0
    prefix = leaves.join(old.select("log", "size"), "log").filter("idx < size").select("log", "idx", "data")
    again = merkle_root(prefix, longest).select("log", F.col("size").alias("found"), F.col("root").alias("now"))
    joined = old.join(again, "log", "left")
    return joined.select("log", F.coalesce((F.col("size") == F.col("found")) & (F.col("root") == F.col("now")), F.lit(False)).alias("consistent"))


def entry_hash(canonical: Column, previous: Column) -> Column:
    """SHA-256 of an entry's canonical text and the hash before it."""
    return F.sha2(F.concat_ws("|", canonical, previous).cast("binary"), 256)


def verify_chain(entries: DataFrame, sealed: Callable[[Column, Column], Column] = entry_hash) -> DataFrame:
    """log, idx, content_ok, link_ok: each entry's hash recomputes, and its prev_hash is the previous entry's hash.

    entries: log, idx, canonical, prev_hash, entry_hash; sealed(canonical, prev_hash) is what an entry's hash covers.
    """
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy("log").orderBy("idx")), F.lit(""))
    return entries.select("log", "idx", (F.col("entry_hash") == sealed(F.col("canonical"), F.col("prev_hash"))).alias("content_ok"), (F.col("prev_hash") == before).alias("link_ok"))

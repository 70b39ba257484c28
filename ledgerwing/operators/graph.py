"""Chains, cycles and closures over edge tables, by pointer doubling and frontier joins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.session import shared_folder


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop's table in the shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def supersession_chains(decisions: DataFrame, most_rounds: int = 40) -> DataFrame:
    """id, root, depth, cyclic: the oldest decision that each one leads back to and how many steps away it is.

    Pointer doubling: after round r every id knows its ancestor 2^r steps back, so a chain of n takes log2(n)
    joins. Only pointers that are still open move; ids that have reached their root are written once. Ids whose pointer
    never ends are on a cycle or lead into one; they have neither root nor depth.
    """
    known = decisions.select(F.col("id").alias("k"))
    linked = decisions.select("id", F.col("supersedes").alias("next"))
    found = linked.filter("next is not null").join(known, F.col("next") == F.col("k"), "left").select("id", F.col("k").alias("next"))
    first = found.unionByName(linked.filter("next is null"))
    open_ = _cut(first.select("id", "next", F.coalesce("next", "id").alias("root"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    closed, left = None, None
    for _ in range(most_rounds):
        ended = open_.filter("next is null")
        closed = ended if closed is None else closed.unionByName(ended)
        open_ = open_.filter("next is not null")
        # a chain of 2^r steps or more has an id at each smaller depth, so if none was closed in a round all others go round
        before, left = left, open_.count()
        if left in (0, before):
            break
        ahead = closed.unionByName(open_).select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        moved = open_.join(ahead, "next")
        open_ = _cut(moved.select("id", F.col("n2").alias("next"), F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth")))
    none = F.lit(None).cast("long")
    cyclic = open_.filter("next is not null").select("id", none.cast(open_.schema["root"].dataType).alias("root"), none.alias("depth"), F.lit(True).alias("cyclic"))
    return closed.select("id", "root", "depth", F.lit(False).alias("cyclic")).unionByName(cyclic)


def has_cycle(decisions: DataFrame) -> DataFrame:
    """project, has_cycle."""
    own = _cut(decisions.select("id", "project", "supersedes"))
    cyclic = supersession_chains(own).filter("cyclic").select("id", "cyclic")
    return own.select("id", "project").join(cyclic, "id", "left").groupBy("project").agg(F.bool_or(F.coalesce("cyclic", F.lit(False))).alias("has_cycle"))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, node, hops: every node that a seed reaches along edges (source, target), the seed itself at 0.

    Runs until no new node is met, which is after as many rounds as the longest of the shortest ways. Edges are computed
    once, and each round writes only the nodes that it has met.
    """
    edges = _cut(edges.select("source", "target"))
    frontier = _cut(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct())
    seen = frontier
    for hop in itertools.count(1):
        step = frontier.join(edges, frontier["node"] == edges["source"]).select("seed", F.col("target").alias("node")).distinct()
        frontier = _cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % 16 == 0:  # many short rounds would make a plan of many parts
            seen = _cut(seen)
    return seen


def causal_chain(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, node, hops: the decisions that led to each seed, against the direction of the edges."""
    return reachable(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), seeds)


def affected_outputs(dependencies: DataFrame, changed: DataFrame, durable: DataFrame) -> DataFrame:
    """seed, node, hops: what must be recomputed when a seed changes; durable nodes (node) stop the walk."""
    passing = dependencies.join(durable.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target")
    return reachable(passing, changed).filter("hops > 0")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")

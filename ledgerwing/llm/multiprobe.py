"""Approximate nearest neighbours by cosine: p-stable hash tables, probed in the order of estimated success."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwing.llm import vectors
from ledgerwing.llm.storage import drop_materialized, materialize

FOUND = "query_id long, vec_id long, score double"
INDEX = "table int, bucket long, vec_id long, v array<double>"


@dataclass(frozen=True)
class Index:
    """Hash functions floor((a . x + b) / width) on unit vectors, tables x functions of them, and probes a table.

    reach: the distance, in widths, at which a neighbour is still found with the wanted probability.
    """

    a: np.ndarray
    b: np.ndarray
    width: float
    probes: int
    reach: float

    def positions(self, unit: np.ndarray) -> np.ndarray:
        """rows x tables x functions, before rounding down."""
        tables, functions, _ = self.a.shape
        flat = unit @ self.a.reshape(tables * functions, -1).T
        return flat.reshape(len(unit), tables, functions) / self.width + self.b

    def sure_cosine(self) -> float:
        """A query whose k-th candidate is at least so near has met its neighbours with the wanted probability."""
        return 1 - (self.reach * self.width) ** 2 / 2


def bucket_key(cells: np.ndarray) -> np.ndarray:
    """One number for a row of hash values; a clash would only merge two buckets."""
    key = np.zeros(cells.shape[:-1], np.int64)
    for k in range(cells.shape[-1]):
        key = key * 1_000_003 + cells[..., k].astype(np.int64)
    return key


@lru_cache(maxsize=16)
def step_sets(functions: int, most: int) -> np.ndarray:
    """sets x (2 functions): the sets of steps that are likely the best, most of them at most; the empty set comes first.

    Step j of a query is its j-th nearest cell edge of a table, the edge across the same cell being step 2 functions -
    1 - j. A set's estimated cost is the sum of its expected squared edge distances, each uniform over the cell. Sets
    come from a heap by shifting or extending the last step, and those that cross a cell both ways are passed over.
    """
    m = functions
    near = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) for j in range(m)]
    cost = near + [1 - (m - j) / (m + 1) + (m - j) * (m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < most:
        total, chosen = heapq.heappop(heap)
        if len({min(j, 2 * m - 1 - j) for j in chosen}) == len(chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    sets = np.zeros((len(out), 2 * m))
    for k, chosen in enumerate(out):
        sets[k, list(chosen)] = 1
    return sets


def perturbations(low: np.ndarray, probes: int) -> np.ndarray:
    """rows x probes x functions: the cells to visit as steps from the home cell, in order of estimated success.

    low: rows x functions, distance of the query from the lower edge of its cell, in widths. A set of single steps is
    as likely as the sum of its squared edge distances is small; the sets compared are four times those visited.
    """
    rows, m = low.shape
    sets = step_sets(m, 4 * probes)
    edges = np.concatenate([low, 1 - low], axis=1)
    order = np.argsort(edges, axis=1)
    cost = np.take_along_axis(edges, order, axis=1) ** 2 @ sets.T
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    step = np.zeros((rows, 2 * m, m))
    at = np.arange(rows)[:, None]
    step[at, np.arange(2 * m)[None, :], order % m] = np.where(order < m, -1, 1)
    return (sets[best] @ step).astype(np.int64)


def probe_keys(index: Index, unit: np.ndarray) -> np.ndarray:
    """rows x tables x probes: keys of the buckets in the order in which they are visited."""
    exact = index.positions(unit)
    home = np.floor(exact)
    rows, tables, m = exact.shape
    steps = perturbations((exact - home).reshape(rows * tables, m), index.probes)
    return bucket_key(home.astype(np.int64).reshape(rows * tables, 1, m) + steps).reshape(rows, tables, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v**2).sum(axis=1))[:, None]


def reach(functions: int, tables: int, probes: int, goal: float, seed: int, trials: int = 2000) -> float:
    """The greatest distance in widths at which a neighbour shares a visited bucket with probability goal or more.

    The projections of two points at a distance d differ by d times a standard normal number, whatever the data,
    so the probability follows from trials with random numbers.
    """
    rng = np.random.default_rng(seed)
    low = rng.uniform(0, 1, (trials, functions))
    normal = rng.standard_normal((trials, functions))
    steps = perturbations(low, probes)
    shortest, longest = 0.0, 4.0
    for _ in range(12):
        d = (shortest + longest) / 2
        cell = np.floor(low + d * normal)
        found = (steps == cell[:, None, :]).all(axis=2).any(axis=1).mean()
        shortest, longest = (d, longest) if 1 - (1 - found) ** tables >= goal else (shortest, d)
    return shortest


def typical_distance(sample: np.ndarray, k: int, queries: int = 256) -> float:
    """The median distance to the k-th neighbour among distinct unit vectors of a sample; in all rows it is no greater."""
    unit = np.unique(_unit(sample), axis=0)
    if len(unit) < 2:
        return 1.0
    asked = np.unique(np.linspace(0, len(unit) - 1, queries).astype(int))
    cosine = unit[asked] @ unit.T
    cosine[np.arange(len(asked)), asked] = -np.inf
    kth = -np.partition(-cosine, min(k, len(unit) - 1) - 1, axis=1)[:, min(k, len(unit) - 1) - 1]
    return max(float(np.median(np.sqrt(np.maximum(2 - 2 * kth, 0)))), 1e-3)


def build(dimensions: int, n: int, distance: float, tables: int, probes: int, goal: float, seed: int) -> Index:
    """Functions a table grow with log n, to hold buckets near a few hundred rows; the width makes distance the reach."""
    rng = np.random.default_rng(seed)
    functions = int(np.clip(round(np.log2(max(n, 2) / 512) / 1.5), 2, 16))
    far = reach(functions, tables, probes, goal, seed)
    return Index(rng.standard_normal((tables, functions, dimensions)), rng.uniform(0, 1, (tables, functions)), distance / far, probes, far)


def search(entries: DataFrame, queries: DataFrame, index: Index, k: int, rows_per_block: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each bucket that a query visits. entries: the rows that answers can name."""

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = bucket_key(np.floor(index.positions(_unit(vectors.stacked(batch["v"])))).astype(np.int64))
                for t in range(keys.shape[1]):
                    yield pd.DataFrame({"table": np.int32(t), "bucket": keys[:, t], "vec_id": batch["vec_id"], "v": batch["v"]})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.iloc[at : at + 128]
                keys = probe_keys(index, _unit(vectors.stacked(part["v"])))
                rows, tables, probes = keys.shape
                table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), rows)
                yield pd.DataFrame({"table": table, "bucket": keys.ravel(), "vec_id": np.repeat(part["vec_id"].to_numpy(), tables * probes)})

    entered = materialize(entries.mapInPandas(enter, INDEX), "ann-index")
    visits = queries.mapInPandas(visit, "table int, bucket long, vec_id long").distinct()
    bucket = ["table", "bucket"]
    filled = entered.groupBy(*bucket).agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("blocks"))
    visits = materialize(visits.join(filled, bucket), "ann-visits")
    visited = visits.groupBy(*bucket).agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("parts"), F.first("blocks").alias("blocks"))
    placed = entered.join(visited, bucket).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*bucket, "part", "block", "vec_id", "v")
    asked = visits.drop("blocks").join(visited, bucket).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.join(queries.withColumnRenamed("v", "q"), "vec_id").select(*bucket, "part", "block", "vec_id", "q")
    key = [*bucket, "part", "block"]
    found = materialize(asked.groupBy(*key).cogroup(placed.groupBy(*key)).applyInPandas(scorer(k), FOUND), "ann-found")
    drop_materialized(visits)
    drop_materialized(entered)
    return found


def search_all(entries: DataFrame, queries: DataFrame, n: int, n_queries: int, k: int, rows_per_block: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block of all rows, for the queries that no probing settles."""
    blocks, parts = -(-n // rows_per_block), -(-n_queries // rows_per_block)
    placed = entries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.withColumnRenamed("v", "q").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["part", "block"]
    return materialize(asked.groupBy(*key).cogroup(placed.groupBy(*key)).applyInPandas(scorer(k), FOUND), "ann-rest")


def scorer(k: int):
    def score(query: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(query) or not len(rows):
            return vectors.best_of_block(np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.int64), k, 0.0, None)
        q, x, ids = vectors.stacked(query["q"]), vectors.stacked(rows["v"]), rows["vec_id"].to_numpy()
        q_length, x_length = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
        found = []
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            cosine = (q[part] @ x.T) / q_length[part][:, None] / x_length[None, :]

            def exactly(row: int, rows: np.ndarray, at: int = at) -> np.ndarray:
                # the same sum for each pair, whatever block it stands in, so that equal vectors tie
                return (q[at + row] * x[rows]).sum(axis=1) / (q_length[at + row] * x_length[rows])

            found.append(vectors.best_of_block(cosine, query["vec_id"].to_numpy()[part], ids, k, 1e-9, exactly))
        return pd.concat(found)

    return score


def nearest_by_cosine(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    tables: int = 3,
    goal: float = 0.98,
    probes: int = 40,
    levels: int = 3,
    seed: int = 7,
    sample_rows: int = 8192,
    sample_bytes: int = 64 << 20,
    rows_per_block: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest, by exact cosine, found with probability goal.

    rows has vec_id and v (array of floats or doubles). Every distinct vector stands in one bucket of each table
    (its k + 1 smallest ids, which is all that any answer can hold of it); each query visits its home bucket and the
    perturbed ones of least cost. A bucket is scored in double precision against the queries that visit it and
    returns its k best for each; the tables' candidates are then merged.

    The first width suits the median distance to the k-th neighbour in a sample of sample_rows rows, those of least
    hashed id, or as many as sample_bytes hold. A query is settled once its k-th candidate lies within the index's
    reach: all nearer rows were then met with probability goal. The others try an index of a greater width, levels of
    them at most, and those still open are compared with all rows in blocks; so each query gets k rows, or all
    candidates if there are fewer. Buckets and visits of more than rows_per_block rows are split.

    Rows with a null id or vector take no part, nor zero vectors or those of another length than the usual one.
    Equal rows count once; of an id with several vectors the best score counts; ties go to the smaller vec_id. An
    empty table gives no rows.
    """
    spark = rows.sparkSession
    usable = rows.select("vec_id", F.col("v").cast("array<double>").alias("v")).dropna().filter(F.exists("v", lambda x: x != 0))
    base = materialize(vectors.same_length(usable.dropDuplicates(), "v"), "ann-vectors")
    n, dimensions = base.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    limit = max(2, min(sample_rows, sample_bytes // (8 * dimensions)))
    distance = typical_distance(vectors.stacked(vectors.by_hash(base, limit, ["v"])["v"]), k)
    entries = materialize(vectors.smallest_of_copies(base, k + 1), "ann-entries")
    open_ = base.filter(is_query)
    found: DataFrame | None = None
    for level in range(levels):
        index = build(dimensions, n, distance, tables, probes, goal, seed + level)
        more = search(entries, open_, index, k, rows_per_block)
        found = more if found is None else found.unionByName(more)
        best = materialize(vectors.best_overall(found, k), "ann-best")
        kth = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
        sure = index.sure_cosine()
        open_ = materialize(open_.join(kth.filter(F.col("kth") >= sure).select("vec_id"), "vec_id", "left_anti"), "ann-open")
        left, short, far = open_.join(kth, "vec_id", "left").agg(F.count("*"), F.count_if(F.col("kth").isNull()), F.percentile_approx("kth", 0.1)).first()
        if not left:
            return best
        # as far as nine tenths of the open queries have to look, or twice as far for those without k candidates
        further = 0.0 if far is None else float(np.sqrt(max(2 - 2 * far, 0.0)))
        distance = max(distance * 2 if 2 * short > left else 0.0, further, distance * 1.25)
        if distance >= 1.5:
            break
    rest = search_all(entries, open_, n, left, k, rows_per_block)
    return vectors.best_overall(found.unionByName(rest), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, vec_id) that were found."""
    total = exact.count()
    return exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0


def nearest5(embeddings: DataFrame) -> DataFrame:
    """The five nearest by cosine, for the rows whose vec_id is divisible by 50."""
    usable = embeddings.filter(F.col("vec_id").isNotNull() & vectors.finite(F.col("embedding")))
    return nearest_by_cosine(usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")), F.col("vec_id") % 50 == 0)

"""Exact top-k by inner product: queries and data grouped by pivots, bounds from summaries, blocks solved locally."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwing.llm import vectors
from ledgerwing.llm.storage import materialize

FOUND = "query_id long, vec_id long, score long"
#: Below this, sums of products of whole numbers are exact in doubles.
EXACT_IN_DOUBLES = 2.0**53


def _cells(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it."""
    square = (rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(axis=1)[None, :]
    cell = square.argmin(axis=1)
    return cell, np.sqrt(np.maximum(square[np.arange(len(rows)), cell], 0.0))


def _groups(pivots: np.ndarray, counts: dict[int, int], per_group: int) -> dict[int, int]:
    """Cells of queries gathered along a chain of nearest pivots, until a group has per_group queries."""
    left, group, size, out = set(counts), 0, 0, {}
    at = min(left, default=None)
    while at is not None:
        out[at] = group
        size += counts[at]
        left.discard(at)
        if size >= per_group:
            group, size = group + 1, 0
        at = min(left, key=lambda c: (float(((pivots[c] - pivots[at]) ** 2).sum()), c), default=None)
    return out


def top_inner_products(
    rows: DataFrame, is_query: Column, k: int = 10, n_pivots: int | None = None, queries_per_group: int = 2048, rows_per_block: int = 8192
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows of highest inner product, exactly.

    rows has vec_id (long) and v (array<long>). Queries and data each fall to their nearest of n_pivots pivots, a
    sample of 64 to 2,048 rows that grows with the square root of all, unless given. Neighbouring cells of queries make a group with a centre, a radius and a threshold: the least,
    over its queries, of the k-th best score among the pivots, which no query's answer can fall below. A cell of
    data, by its pivot and radius, and then a row, by its own length, goes to a group only if

        centre . x + radius * |x| >= threshold

    can hold; all else is left behind. Each group meets the rows that are left to it in blocks of bounded size, so
    neither a full cell nor a frequent query gathers in one task, and a query is sent to those blocks alone. Of equal vectors only the k + 1 smallest ids take part, which changes
    no answer. Rows with a null id or vector take no part, nor vectors of another length than the usual one; equal
    rows count once; ties go to the smaller vec_id. An empty table gives no rows.
    """
    valid = rows.select("vec_id", "v").dropna().dropDuplicates()
    base = materialize(vectors.same_length(valid, "v"), "knn-vectors")
    n = base.count()
    sample = vectors.by_hash(base, n_pivots or int(np.clip(2 * n**0.5, 64, 2048)), ["v"])
    if not len(sample):
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = vectors.stacked(sample["v"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = vectors.stacked(batch["v"])
            if not len(x):
                continue
            cell, away = _cells(x, pivots)
            near = np.sort(x @ pivots.T, axis=1)
            # one of the pivots may be the query itself
            floor = near[:, -(k + 1)] if near.shape[1] > k else np.full(len(x), -np.inf)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "cell": cell.astype(np.int32), "away": away, "floor": floor})

    schema = "vec_id long, v array<long>, cell int, away double, floor double"
    queries = materialize(base.filter(is_query).mapInPandas(assign, schema), "knn-queries")
    data = materialize(vectors.smallest_of_copies(base, k + 1).mapInPandas(assign, schema), "knn-data")

    counts = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
    group_of = _groups(pivots, counts, queries_per_group)
    if not group_of:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_groups = max(group_of.values()) + 1
    members = [[c for c, g in group_of.items() if g == h] for h in range(n_groups)]
    centres = np.stack([np.average(pivots[m], axis=0, weights=[counts[c] for c in m]) for m in members])
    parts = [max(1, -(-sum(counts[c] for c in m) // (2 * queries_per_group))) for m in members]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                g = batch["cell"].map(group_of).to_numpy()
                away = np.sqrt(((vectors.stacked(batch["v"]) - centres[g]) ** 2).sum(axis=1))
                yield pd.DataFrame({"g": g.astype(np.int32), "away": away, "floor": batch["floor"]}).groupby("g", as_index=False).agg({"away": "max", "floor": "min"})

    spread = queries.mapInPandas(summarise, "g int, away double, floor double").groupBy("g").agg(F.max("away").alias("away"), F.min("floor").alias("floor"))
    radius, threshold = np.zeros(n_groups), np.full(n_groups, -np.inf)
    for r in spread.collect():
        radius[r["g"]], threshold[r["g"]] = r["away"], r["floor"]
    reach = np.zeros(len(pivots))
    for r in data.groupBy("cell").agg(F.max("away").alias("away")).collect():
        reach[r["cell"]] = r["away"]
    # slack for rounding, far below the whole numbers that scores are
    length, centre_length = np.sqrt((pivots**2).sum(axis=1)), np.sqrt((centres**2).sum(axis=1))
    bound = centres @ pivots.T + centre_length[:, None] * reach[None, :] + radius[:, None] * (length + reach)[None, :]
    open_cells = bound + 0.5 >= threshold[:, None]

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, cell = vectors.stacked(batch["v"]), batch["cell"].to_numpy()
            upper = x @ centres.T + np.sqrt((x**2).sum(axis=1))[:, None] * radius[None, :]
            for g in range(n_groups):
                near = np.flatnonzero(open_cells[g, cell] & (upper[:, g] + 0.5 >= threshold[g]))
                if len(near):
                    yield pd.DataFrame({"g": np.int32(g), "vec_id": batch["vec_id"].to_numpy()[near], "v": batch["v"].to_numpy()[near]})

    replicas = materialize(data.mapInPandas(replicate, "g int, vec_id long, v array<long>"), "knn-replicas")
    sizes = {r["g"]: r["count"] for r in replicas.groupBy("g").count().collect()}
    n_blocks = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(g, 0) // rows_per_block))) for g in range(n_groups)]), F.col("g") + 1)
    block = F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int")
    n_parts = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("g") + 1)
    replicas = replicas.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    groups = F.create_map(*[F.lit(x) for pair in group_of.items() for x in pair])
    asked = queries.select(F.element_at(groups, F.col("cell")).cast("int").alias("g"), "vec_id", "v")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))

    def solve(query: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(query) or not len(rows):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        q, x, ids = vectors.stacked(query["v"], np.int64), vectors.stacked(rows["v"], np.int64), rows["vec_id"].to_numpy()
        largest = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
        qs, xs = (q.astype(np.float64), x.astype(np.float64)) if largest < EXACT_IN_DOUBLES else (q, x)
        found = []
        for at in range(0, len(q), 256):
            scores = qs[at : at + 256] @ xs.T
            found.append(vectors.best_of_block(scores, query["vec_id"].to_numpy()[at : at + 256], ids, k, 0.0, lambda row, rows, s=scores: s[row, rows]))
        out = pd.concat(found)
        return out.astype({"score": np.int64})

    key = ("g", "part", "block")
    found = asked.groupBy(*key).cogroup(replicas.groupBy(*key)).applyInPandas(solve, FOUND)
    return vectors.best_overall(found, k)


def scaled_top10(embeddings: DataFrame) -> DataFrame:
    """The ten highest inner products of floor(1024 * x) vectors, for the rows whose vec_id is divisible by 100."""
    usable = embeddings.filter(F.col("vec_id").isNotNull() & vectors.finite(F.col("embedding")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))
    return top_inner_products(usable.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH vec AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM vec q JOIN vec x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

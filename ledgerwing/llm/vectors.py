"""What both searches over vectors share: valid rows, copies of a vector, and the best rows of a block of scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that is neither null nor empty and whose components are all finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def same_length(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose vectors have the most frequent length, the greater of two that are as frequent: vectors of
    another length cannot be compared with them."""
    counts = rows.groupBy(F.size(column).alias("length")).agg(F.count("*").alias("n"))
    usual = counts.orderBy(F.desc("n"), F.desc("length")).first()
    return rows.filter(F.size(column) == F.lit(usual["length"] if usual else 0))


def smallest_of_copies(rows: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors, the keep smallest ids: no other copy can be among the first keep - 1 of a query but its own.

    The rank is limited in each input partition before the shuffle, so a very frequent vector sends keep rows each.
    """
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    return ranked.filter(F.col("_n") <= keep).drop("_n")


def by_hash(rows: DataFrame, limit: int, columns: list[str]) -> pd.DataFrame:
    """A bounded sample on the driver: the limit rows of least hashed id."""
    return rows.orderBy(F.xxhash64("vec_id"), "vec_id").select(*columns).limit(limit).toPandas()


def stacked(column: pd.Series, dtype: type = np.float64) -> np.ndarray:
    return np.stack([np.asarray(x, dtype) for x in column]) if len(column) else np.zeros((0, 0), dtype)


def best_of_block(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, slack: float, rescore) -> pd.DataFrame:
    """The k highest scores of each query in one block, ties to smaller ids, never the query's own row.

    scores choose the rows within slack of the k-th highest; rescore(query row, rows) gives what counts.
    """
    out_q, out_id, out_s = [], [], []
    for row, query in enumerate(query_ids):
        own = ids != query
        s = np.where(own, scores[row], -np.inf)
        if len(s) > k:
            s_k = np.partition(s, len(s) - k)[len(s) - k]
            at = np.flatnonzero((s >= s_k - slack) & own)
        else:
            at = np.flatnonzero(own)
        exact = rescore(row, at)
        order = np.lexsort((ids[at], -exact))[:k]
        out_q.append(np.full(len(order), query))
        out_id.append(ids[at][order])
        out_s.append(exact[order])
    if not out_q:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_id), "score": np.concatenate(out_s)})


def best_overall(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from what the blocks found; the best score of an id that has several."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Contradiction risk: features of a decision, a boosted-tree classifier, and the base-rate fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.functions.labels import first_match
from ledgerwing.operators.aggregates import majority_vote

# The number of each agent type; other types count as custom.
AGENT_TYPES = {"coding": 0, "review": 1, "scan": 2, "orchestrator": 3, "custom": 4, "human": 5}
FEATURES = ("dimension_overlap_count", "decision_density", "historical_contradiction_rate", "agent_type_numeric", "time_since_last_same_dimension", "total_active_decisions", "dimension_count")


def risk_features(decisions: DataFrame, bridge: DataFrame, contradictions: DataFrame, as_of: Column) -> DataFrame:
    """id, the seven features, and label (1: part of a contradiction) of every decision up to as_of.

    decisions has agent_type. A dimension's density and contradiction rate are those of the project. time_since_last_same_dimension is the hours since the project's
    latest earlier decision with one of the dimensions, 0 if there is none; decisions of one time follow their ids.
    """
    decisions = decisions.filter(F.col("created_at") <= as_of)
    # rows and pairs of a project lie together, so that nothing but labels leaves its task before a decision's features are whole
    rows = bridge.join(decisions.select("id", "created_at", "valid"), "id").repartition("project")
    per = contradictions.select("project", F.explode("shared_dimensions").alias("dimension"), (F.col("verdict") == "contradiction").cast("double").alias("c"))
    rates = per.groupBy("project", "dimension").agg(F.avg("c").alias("rate")).filter("dimension is not null")
    rates = rates.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "rate"))).alias("rates"))
    in_project = Window.partitionBy("project", "dimension")
    in_order = in_project.orderBy("created_at", "id")
    named = F.col("project").isNotNull() & F.col("dimension").isNotNull()
    dims = rows.withColumn("gap", F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(in_order)))
    dims = dims.withColumn("n", F.when(named, F.count(F.when(F.col("valid"), 1)).over(in_project)).otherwise(0)).join(rates, "project", "left")
    agg = dims.groupBy("project", "id").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("dimension_overlap_count"),
        F.avg("n").alias("decision_density"),
        F.avg(F.coalesce(F.col("rates")[F.col("dimension")], F.lit(0.0))).alias("historical_contradiction_rate"),
        F.count("*").alias("dimension_count"),
        F.min("gap").alias("gap"),
    ).drop("project")
    active = decisions.filter("valid").groupBy("project").agg(F.count("*").alias("total_active_decisions"))
    against = contradictions.filter("verdict = 'contradiction'").select("project", F.explode(F.array("a_id", "b_id")).alias("id"))
    # within a project first, where pairs lie together, then over all
    sides = against.groupBy("project", "id").agg(F.lit(1).alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    base = decisions.join(agg, "id").join(sides, "id", "left").join(active, "project", "left")
    hours = F.coalesce(F.col("gap") / F.lit(3600e6), F.lit(0.0))
    kind = first_match([(F.col("agent_type") == name, F.lit(n)) for name, n in AGENT_TYPES.items()], F.lit(AGENT_TYPES["custom"]))
    return base.select(
        "id",
        "dimension_overlap_count",
        F.round("decision_density", 6).alias("decision_density"),
        F.round("historical_contradiction_rate", 6).alias("historical_contradiction_rate"),
        kind.alias("agent_type_numeric"),
        F.round(hours, 6).alias("time_since_last_same_dimension"),
        F.coalesce("total_active_decisions", F.lit(0)).alias("total_active_decisions"),
        "dimension_count",
        F.coalesce("label", F.lit(0)).alias("label"),
    )


@dataclass
class RiskModel:
    """A fitted pipeline, or the base rate where there were too few rows to fit one."""

    model: PipelineModel | None
    base_rate: float
    importances: dict[str, float]


def train_risk(features: DataFrame, least_rows: int = 50, trees: int = 50, depth: int = 3, seed: int = 42) -> RiskModel:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    n, positive = features.agg(F.count("*"), F.coalesce(F.avg("label"), F.lit(0.0))).first()
    if n < least_rows or positive in (0.0, 1.0):
        return RiskModel(None, float(positive), {})
    tree = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="x"), tree]).fit(features)
    weights = model.stages[-1].featureImportances.toArray()
    return RiskModel(model, float(positive), dict(zip(FEATURES, map(float, weights), strict=True)))


def fold_accuracy(features: DataFrame, folds: int = 5, **parameters) -> float:
    """The share of rows that models fitted on the other folds call right, at a risk of 0.5; folds go by the hash of id."""
    placed = features.withColumn("_fold", F.pmod(F.xxhash64("id"), F.lit(folds)))
    right = total = 0
    for fold in range(folds):
        fitted = train_risk(placed.filter(F.col("_fold") != fold), **parameters)
        held = placed.filter(F.col("_fold") == fold)
        told = predict_risk(held, fitted).join(held.select("id", "label"), "id")
        n, hits = told.agg(F.count("*"), F.count_if((F.col("risk") >= 0.5) == (F.col("label") == 1))).first()
        right, total = right + hits, total + n
    return right / total if total else 0.0


def heuristic_risk(features: DataFrame, base: float) -> DataFrame:
    """id, risk: the base rate, 0.1 for each overlapping dimension (at most 0.3), 0.05 of density (at most 0.2)."""
    risk = F.lit(base) + F.least(F.col("dimension_overlap_count") * 0.1, F.lit(0.3)) + F.least(F.col("decision_density") * 0.05, F.lit(0.2))
    return features.select("id", F.round(F.least(F.lit(1.0), risk), 6).alias("risk"))


def predict_risk(features: DataFrame, fitted: RiskModel) -> DataFrame:
    if fitted.model is None:
        return heuristic_risk(features, fitted.base_rate)
    from pyspark.ml.functions import vector_to_array

    return fitted.model.transform(features).select("id", F.round(vector_to_array("probability")[1], 6).alias("risk"))


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], least: float = 0.3, vote_below: float = 0.6) -> DataFrame:
    """pair_id, verdict, confidence, needs_vote: pairs of similarity least and more, judged by a caller's scorer.

    pairs: pair_id, similarity, text_a, text_b. scorer takes a batch of them and returns verdict and confidence.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = scorer(batch)
            yield pd.DataFrame({"pair_id": batch["pair_id"], "verdict": found["verdict"].to_numpy(), "confidence": found["confidence"].to_numpy()})

    kept = pairs.filter(F.col("similarity") >= least).select("pair_id", "similarity", "text_a", "text_b")
    return kept.mapInPandas(judge, "pair_id string, verdict string, confidence double").withColumn("needs_vote", F.col("confidence") < vote_below)


def settle_votes(scored: DataFrame, votes: DataFrame) -> DataFrame:
    """pair_id, verdict, confidence, voted: unsure pairs take the majority of their first verdict and their votes, if they have any.

    scored: the output of score_pairs. votes: pair_id, round (from 1), verdict, confidence, a row a vote.
    """
    unsure = scored.filter("needs_vote")
    asked = votes.join(unsure.select("pair_id"), "pair_id", "left_semi")
    first = unsure.join(votes.select("pair_id"), "pair_id", "left_semi").select("pair_id", F.lit(0).alias("round"), "verdict", "confidence")
    won = majority_vote(first.unionByName(asked.select("pair_id", "round", "verdict", "confidence"))).select("pair_id", F.col("verdict").alias("_verdict"), F.col("confidence").alias("_confidence"))
    joined = scored.join(won, "pair_id", "left")
    return joined.select("pair_id", F.coalesce("_verdict", "verdict").alias("verdict"), F.coalesce("_confidence", "confidence").alias("confidence"), F.col("_verdict").isNotNull().alias("voted"))


def frequent_itemsets(sets: DataFrame, support: float, largest: int = 12) -> DataFrame:
    """itemset, freq: item sets of 2 to largest items in at least max(1, int(support * n)) rows."""
    from pyspark.ml.fpm import FPGrowth

    n = sets.count()
    least = max(1, int(support * n))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(n, 1)), minConfidence=0.5).fit(sets)
    found = model.freqItemsets.filter(F.size("items").between(2, largest))
    return found.select(F.sort_array("items").alias("itemset"), "freq")

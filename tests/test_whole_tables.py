"""Queries run over whole tables: no subset of ids or lengths."""

from __future__ import annotations

import inspect

from ledgerwing.operators import graph
from ledgerwing.plans import governance_queries, load_all

QUERIES = load_all().QUERIES


def written(spark, folder, **tables) -> str:
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_long_document_or_one_of_unknown_length_can_be_the_best_match(spark, tmp_path):
    documents = [(1, "alpha beta other words", 22), (2, "alpha beta gamma delta", 5000), (3, "epsilon zeta eta", None)]
    d = written(spark, tmp_path, benchmark=([(1, "alpha beta gamma delta"), (2, "epsilon zeta eta")], "item_id long, text string"), documents=(documents, "doc_id long, text string, n_chars long"))
    found = {r["item_id"]: (r["best_id"], r["score"], r["status"]) for r in QUERIES["coverage"](spark, d).collect()}
    assert found == {1: (2, 1.0, "implemented"), 2: (3, 1.0, "implemented")}


def test_a_walk_has_no_limit_of_rounds():
    """A walk past a hundred rounds takes minutes in a local session, so only the parameter's absence is tested."""
    assert set(inspect.signature(graph.reachable).parameters) == {"edges", "seeds"}


def test_every_log_has_its_proofs_checked(spark, sf_dir):
    logs = {r["log"] for r in QUERIES["merkle_root"](spark, sf_dir).select("log").collect()}
    found = QUERIES["verify_inclusion"](spark, sf_dir).groupBy("log").agg({"verified": "max"}).collect()
    assert {r[0] for r in found} == logs and all(r[1] for r in found)


def test_every_document_meets_every_item(spark, tmp_path):
    documents = [(i, f"alpha beta word{'xyz'[i]}") for i in range(3)]
    d = written(spark, tmp_path, benchmark=([(7, "alpha beta"), (8, "beta")], "item_id long, text string"), documents=(documents, "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in QUERIES["keyword_jaccard"](spark, d).collect()}
    assert found == {(i, k): x for i in range(3) for k, x in ((7, 0.666667), (8, 0.333333))}


def test_predicted_risk_uses_the_operators_own_trees(spark, sf_dir, monkeypatch):
    asked = []
    fit = governance_queries.risk.train_risk
    monkeypatch.setattr(governance_queries.risk, "train_risk", lambda *a, **k: asked.append(k) or fit(*a, **k))
    assert QUERIES["predicted_risk"](spark, sf_dir).count() > 0
    assert asked == [{}]


def test_predicted_risk_makes_its_features_once(spark, sf_dir):
    told = QUERIES["predicted_risk"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in told and "Join" not in told

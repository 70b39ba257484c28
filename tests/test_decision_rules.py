"""Rules of votes, gates, conflicts and assumptions on rows written by hand."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerwing.functions import text
from ledgerwing.operators import aggregates as agg
from ledgerwing.operators import governance as gov
from ledgerwing.operators import matching, pairs, review, risk

T0 = datetime.datetime(2024, 1, 1)


def test_the_first_verdict_votes_and_wins_ties(spark):
    votes = [("a", 0, "tension", 0.9), ("a", 1, "tension", 0.5), ("a", 2, "contradiction", 0.8), ("b", 0, "tension", 0.2), ("b", 1, "compatible", 0.9), ("c", 0, "tension", 0.4)]
    found = {r["pair_id"]: (r["verdict"], r["votes"], r["confidence"]) for r in agg.majority_vote(spark.createDataFrame(votes, "pair_id string, round int, verdict string, confidence double")).collect()}
    assert found == {"a": ("tension", 2, 0.6), "b": ("tension", 1, 0.1), "c": ("tension", 1, 0.4)}
    scored = spark.createDataFrame([("a", "tension", 0.5, True), ("b", "tension", 0.5, True), ("c", "tension", 0.9, False)], "pair_id string, verdict string, confidence double, needs_vote boolean")
    asked = spark.createDataFrame([("a", 1, "compatible", 0.9), ("c", 1, "compatible", 0.9)], "pair_id string, round int, verdict string, confidence double")
    settled = {r["pair_id"]: (r["verdict"], r["confidence"], r["voted"]) for r in risk.settle_votes(scored, asked).collect()}
    assert settled == {"a": ("tension", 0.25, True), "b": ("tension", 0.5, False), "c": ("tension", 0.9, False)}


def test_technologies_and_their_conflicts(spark):
    rows = [
        (1, "React", "", "Vue", None),
        (2, "Celery", "", "Redis", ""),
        (3, "psycopg2 store", "", "Use postgres", "Do not use MySQL"),
        (4, "Nothing", "", "Redis", ""),
        (5, "Store", "SQLite3. Do NOT use redis", "Redis", ""),
        (6, "interest in restful", "", "Redis", ""),
    ]
    found = matching.tech_conflicts(spark.createDataFrame(rows, "id int, a_title string, a_content string, b_title string, b_content string"))
    assert {r["id"]: (r["technologies_a"], r["technologies_b"]) for r in found.collect()} == {1: (["react"], ["vue"]), 2: (["celery"], ["redis"]), 5: (["sqlite"], ["redis"])}


def test_words_of_any_script(spark):
    df = spark.createDataFrame([("sha256 JWT_v2 été ab naïve",)], "t string")
    assert sorted(df.select(text.words3(F.col("t")).alias("w")).first()["w"]) == ["jwt_v2", "naïve", "sha256", "été"]


def test_only_contradictions_block_and_only_valid_decisions_constrain(spark):
    asked = spark.createDataFrame([(1, "p", ["auth"]), (2, "p", ["caching"]), (3, "p", ["logging"])], "request_id int, project string, dimensions array<string>")
    against = [("c1", "p", "tension", "unresolved", ["auth"]), ("c2", "p", "contradiction", "unresolved", ["caching"]), ("c3", "p", "contradiction", "resolved", ["logging"])]
    contradictions = spark.createDataFrame(against, "id string, project string, verdict string, status string, shared_dimensions array<string>")
    bridge = spark.createDataFrame([(7, "p", "auth"), (8, "p", "auth"), (9, "p", "logging")], "id long, project string, dimension string")
    decisions = spark.createDataFrame([(7, True), (8, False), (9, False)], "id long, valid boolean")
    found = {r["request_id"]: (r["allowed"], r["blocked_by"], r["constraints"]) for r in pairs.evaluate_actions(asked, contradictions, bridge, decisions).collect()}
    assert found == {1: (True, None, [7]), 2: (False, "c2", []), 3: (True, None, [])}


def test_patterns_that_are_half_there(spark):
    sets = spark.createDataFrame([("f", ["a", "b"]), ("g", ["a"]), ("h", ["a", "b", "c", "d"]), ("i", ["c", "x"]), ("j", ["x"])], "key string, items array<string>")
    mined = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", "b"],), (["c", "d"],), (["a", "b", "c"],)], "itemset array<string>")
    found = sorted((r["key"], r["itemset"], r["missing"], r["confidence"]) for r in gov.missing_patterns(sets, mined).collect())
    assert found == [("f", "a,b,c,d", "c,d", 0.5), ("g", "a,b", "b", 0.5), ("i", "c,d", "d", 0.5)]


def test_files_that_hold_a_keyword_inside_a_word(spark):
    losers = spark.createDataFrame([(1, "Use SQL for the API"), (2, "use the api"), (3, "Redis-cache via k8s")], "id int, title string")
    files = spark.createDataFrame([("b.py", "import PostgreSQLdb"), ("a.py", "mysql"), (".venv/a.py", "sql"), ("c.py", "k8s"), ("d.py", None)], "path string, content string")
    assert sorted((r["id"], r["path"]) for r in review.affected_files(losers, files).collect()) == [(1, "a.py"), (1, "b.py"), (3, "c.py")]
    assert [r["path"] for r in review.affected_files(losers, files, most=1).filter("id = 1").collect()] == ["a.py"]


def test_answers_settle_open_assumptions_only(spark):
    options = ["A) Yes", "B) No", "C) Needs More Context first"]
    rows = [(i, s, options) for i, s in enumerate(["detected", "proposed", "proposed", "validated", "detected", "detected", "proposed"])] + [(7, "detected", None)]
    answers = spark.createDataFrame([(0, 0, "x", "r"), (1, 1, "x", "r"), (2, 2, "x", "r"), (3, 1, "x", "r"), (4, 3, "x", "r"), (5, -1, "x", "r"), (7, 0, "x", "r")], "id int, option int, resolved_by string, rationale string")
    found = {r["id"]: (r["status"], r["selected_option"], r["deferred_until"]) for r in review.resolve_assumptions(spark.createDataFrame(rows, "id int, status string, options array<string>"), answers, F.lit(T0)).collect()}
    week = T0 + datetime.timedelta(days=7)
    assert found == {0: ("validated", 0, None), 1: ("rejected", 1, None), 2: ("deferred", 2, week), 3: ("validated", None, None), 4: ("detected", None, None), 5: ("detected", None, None), 6: ("proposed", None, None), 7: ("detected", None, None)}


def test_the_gate_names_what_a_decision_lacks(spark):
    decisions = spark.createDataFrame([(1, "p", "active", "why"), (2, "p", "active", " "), (3, "p", "active", None), (4, "p", "superseded", "")], "id int, project string, status string, rationale string")
    bridge = spark.createDataFrame([(1, "auth"), (2, "auth")], "id int, dimension string")
    none = spark.createDataFrame([], "project string, verdict string, status string, is_baseline boolean")
    found = sorted((r["rule"], r["severity"], r["field"], r["violations"]) for r in agg.quality_gate(decisions, bridge, none).collect())
    assert found == [("decision-metadata", "error", "dimensions", 1), ("decision-metadata", "warning", "rationale", 2)]


def test_a_run_equals_its_parts(spark):
    findings = [
        (1, "p", "data_scope", "r1", "a/x.py", "s1", "m", "k1", 3, 0.5, T0),
        (2, "p", "data_scope", "r1", "a/y.py", "s2", "m", "k2", 2, 0.9, T0),
        (3, "p", "temporal", "r2", "a/x.py", "s3", "m", "k3", 1, 0.5, T0),
        (4, "p", "temporal", "r2", "a/x.py", "s4", "m", "k4", 1, 0.8, T0),
        (5, "q", "temporal", "r2", "b.py", "s5", "m", "k5", 1, 0.8, T0),
        (6, "p", "temporal", "shady", "b.py", "s6", "m", "k6", 1, 0.8, T0),
        (7, "p", "temporal", "r2", "b.py", "s7", "m", "k7", 1, 0.8, T0),
    ]
    table = spark.createDataFrame(findings, "id int, project string, category string, pattern_id string, file string, summary string, snippet string, dedup_key string, severity_rank int, confidence double, ts timestamp")
    known = spark.createDataFrame([("p", "k4", "validated"), ("p", "k7", "rejected")], "project string, dedup_key string, status string")
    events = spark.createDataFrame([("shady", "triggered")] * 30 + [("shady", "rejected")] * 20, "rule string, event string")
    evidence = spark.createDataFrame([(1, "app.core")], "id int, module string")
    modules, churned = spark.createDataFrame([("app.core", 4)], "module string, in_degree long"), spark.createDataFrame([("b.py", 2.0)], "path string, factor double")
    run = review.assumption_run(table, known, events, evidence, modules, churned)
    counted = {r["project"]: (r["detected"], r["shadowed"], r["below_threshold"], r["pre_validated"], r["deduped"], r["new"], r["clusters"], r["compression"]) for r in run.counters.collect()}
    assert counted == {"p": (6, 1, 1, 1, 1, 2, 1, 2.0), "q": (1, 0, 0, 0, 0, 1, 1, 1.0)}
    told = {r["id"]: (r["summary"], r["n"], r["is_baseline"], r["priority"], r["status"]) for r in run.proposals.collect()}
    assert told == {1: ("[2x] s1", 2, False, 6.0, "proposed"), 5: ("s5", 1, True, 2.0, "proposed")}
    assert all(r["question"] and r["options"] for r in run.proposals.collect())


def test_related_decisions_of_one_large_project(spark):
    """Against every pair of it; equal dimensions and equal times come up often, and invalid decisions ask but are no answers."""
    names = ("auth", "caching", "logging", "testing")
    rows = [(i, "p", T0 + datetime.timedelta(days=i % 7), i % 5 > 0, [names[k] for k in range(4) if (i * 7 + 1) % 15 >> k & 1]) for i in range(120)] + [(500, "q", T0, True, ["auth"]), (501, "p", T0, True, [])]
    decisions = spark.createDataFrame([r[:4] + (None,) for r in rows], "id long, project string, created_at timestamp, valid boolean, supersedes long")
    bridge = spark.createDataFrame([(r[0], r[1], x) for r in rows for x in r[4]], "id long, project string, dimension string")
    as_of = T0 + datetime.timedelta(days=30)
    found: dict[int, list] = {}
    for r in pairs.find_related(decisions, bridge, F.lit(as_of), k=3).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["related_id"], r["shared_count"]))

    def related(a):
        out = [(-len(set(a[4]) & set(b[4])) / (1 + (as_of - b[2]).days / 30), b[0], len(set(a[4]) & set(b[4]))) for b in rows if b[1] == a[1] and b[0] != a[0] and b[3] and set(a[4]) & set(b[4])]
        return [(b, n) for _, b, n in sorted(out)[:3]]

    assert found == {r[0]: related(r) for r in rows if related(r)}
    none = spark.createDataFrame([(1, 2, "unresolved", "contradiction"), (1, 5, "unresolved", "tension"), (3, 500, "resolved", "contradiction")], "a_id long, b_id long, status string, verdict string")
    radius = {r["id"]: (r["related"], r["contradicting"], r["impact"]) for r in pairs.blast_radius(decisions, bridge, none).collect()}
    active = {p: sum(r[3] for r in rows if r[1] == p) for p in "pq"}
    for r in rows:
        near = {b[0] for b in rows if b[1] == r[1] and b[0] != r[0] and b[3] and set(r[4]) & set(b[4])}
        against = {1: {2, 5}, 2: {1}, 5: {1}}.get(r[0], set())
        assert radius.get(r[0], (0, 0, 0.0)) == (len(near), len(against), round(min(1.0, len(near | against) / active[r[1]]), 6))


def test_a_dimension_without_a_bit_is_an_error(spark):
    import pytest

    bridge = spark.createDataFrame([(1, "p", "weather")], "id long, project string, dimension string")
    assert pairs.dimension_sets(bridge, ("weather",)).first()["dims"] == 1
    with pytest.raises(Exception, match="no such dimension: weather"):
        pairs.dimension_sets(bridge).collect()

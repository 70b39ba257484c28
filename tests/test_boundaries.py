"""Boundary rows: thresholds, ties, empty inputs and nulls."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerwing.functions import labels, text
from ledgerwing.operators import aggregates, graph, integrity, matching, pairs
from ledgerwing.operators import sequences as seq
from ledgerwing.sources import readers

T0 = datetime.datetime(2024, 1, 1)


def at(seconds: float) -> datetime.datetime:
    return T0 + datetime.timedelta(seconds=seconds)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_collision_gap_is_inclusive(spark):
    schema = "event_id long, agent_id string, dimension string, ts timestamp"
    rows = [(1, "a", "d", at(0)), (2, "b", "d", at(300)), (3, "c", "d", at(300.001)), (4, "a", "d", at(1)), (5, "b", "e", at(0))]
    found = {tuple(r)[:2] for r in pairs.collisions(spark.createDataFrame(rows, schema)).collect()}
    assert found == {(1, 2), (4, 2), (2, 3), (4, 3)}
    causal = spark.createDataFrame([(1, 2)], "source long, target long")
    assert (1, 2) not in {tuple(r)[:2] for r in pairs.collisions(spark.createDataFrame(rows, schema), causal).collect()}
    assert pairs.collisions(spark.createDataFrame([], schema)).count() == 0


def test_spikes_need_four_before_and_more_than_the_factor(spark):
    schema = "event_id long, agent_id string, ts timestamp, cost_usd double, latency_ms double"
    rows = [(i, "a", at(i), 1.0, None) for i in range(4)] + [(4, "a", at(4), 5.0, 0.0), (5, "a", at(5), 100.0, 0.0), (6, "b", at(0), 9.0, 9.0)]
    found = [tuple(r)[:2] for r in seq.llm_anomalies(spark.createDataFrame(rows, schema)).collect()]
    assert found == [(5, "cost_spike")]


def test_loop_and_thrash(spark):
    schema = "event_id long, agent_id string, ts timestamp, action string, target string"
    same = spark.createDataFrame([(i, "a", at(i), "edit", "f") for i in range(4)], schema)
    assert sorted(r["event_id"] for r in seq.loops(same).collect()) == [2, 3]
    assert [r["event_id"] for r in seq.thrash(same).collect()] == [3]  # a repeated action is its own reverse
    turn = spark.createDataFrame([(i, "a", at(i), "edit", "fg"[i % 2]) for i in range(5)], schema)
    assert [r["event_id"] for r in seq.thrash(turn).collect()] == [4]


def test_intervals_are_half_open(spark):
    d = spark.createDataFrame([(1, 1, at(0), at(10)), (1, 2, at(10), None)], "key long, id long, valid_from timestamp, valid_until timestamp")
    t = spark.createDataFrame([(1, at(0)), (1, at(10)), (1, at(-1))], "key long, t timestamp")
    assert sorted((r["t"], r["id"]) for r in pairs.as_of(d, t).collect()) == [(at(0), 1), (at(10), 2)]


def test_attention_position(spark):
    for n, expected in ((1, [1]), (2, [1, 2]), (3, [1, 3, 2]), (5, [1, 5, 2, 3, 4])):
        df = spark.range(1, n + 1).select(pairs.attention_position(F.col("id"), F.lit(n)).alias("p"))
        assert [r["p"] for r in df.collect()] == expected


def test_chains_with_cycles(spark):
    rows = [(1, None, 1), (2, 1, 1), (3, 2, 1), (4, 4, 2), (5, 6, 3), (6, 5, 3), (7, 5, 3), (8, 99, 4)]
    d = spark.createDataFrame(rows, "id long, supersedes long, project long")
    found = {r["id"]: (r["root"], r["depth"], r["cyclic"]) for r in graph.supersession_chains(d).collect()}
    assert found[3] == (1, 2, False) and found[1] == (1, 0, False) and found[8] == (8, 0, False)
    assert all(found[i] == (None, None, True) for i in (4, 5, 6, 7))
    assert {r["project"]: r["has_cycle"] for r in graph.has_cycle(d).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_merkle_against_a_loop(spark):
    import hashlib

    def root(leaves):
        level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves]
        while len(level) > 1:
            level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0].hex()

    rows = [(n, i, f"{n}-{i}") for n in (1, 2, 3, 5, 8) for i in range(n)]
    leaves = spark.createDataFrame(rows, "log long, idx long, data string")
    roots = integrity.merkle_root(leaves)
    assert {r["log"]: r["root"] for r in roots.collect()} == {n: root([f"{n}-{i}".encode() for i in range(n)]) for n in (1, 2, 3, 5, 8)}
    proofs = integrity.inclusion_proofs(leaves)
    assert all(r["verified"] for r in integrity.verify_inclusion(proofs, leaves, roots).collect())
    changed = leaves.withColumn("data", F.when((F.col("log") == 5) & (F.col("idx") == 4), "x").otherwise(F.col("data")))
    bad = [(r["log"], r["idx"]) for r in integrity.verify_inclusion(proofs, changed, roots).collect() if not r["verified"]]
    assert bad == [(5, 4)]


def test_calibration_boundaries(spark):
    schema = "id string, judge long, judge_verdict string, human_verdict string, judge_confidence double, ts timestamp"
    row = spark.createDataFrame([("a", 1, "odd", "compatible", 1.0, at(0))], schema)
    found = aggregates.calibration_metrics(row).first()
    assert (found["accuracy"], found["ece"], found["brier"], found["wasserstein"], found["drift"]) == (0.0, 1.0, 1.0, 0.0, 0.0)


def test_text_functions(spark):
    assert one(spark, text.luhn(F.lit("4111 1111 1111 1111"))) is True
    assert one(spark, text.luhn(F.lit("4111111111111112"))) is False
    assert one(spark, text.redact(F.lit('a@b.com 10.0.0.1 http://x/y token = "abcdefghijklmnopqrstuvwx"'))) == '[EMAIL] [IP] [URL] token = "abcdefghijklmnopqrstuvwx"'
    assert one(spark, text.excerpt(F.lit("A. B. C. D"))) == "A. B. C."
    assert one(spark, text.excerpt(F.lit(""))) == "."
    assert one(spark, text.normalize_route(F.lit("/a/{id}/:b/"))) == "/a/{param}/{param}"
    assert one(spark, text.keyword_jaccard(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, text.parse_verdict(F.lit("nothing")))["valid"] is False
    docs = spark.createDataFrame([(1, "x\nSSN 123-45-6789 and a12"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r["line_number"], r["pattern_name"]) for r in text.scan_phi(docs).collect()) == [(2, "diagnosis_code"), (2, "ssn")]
    assert text.scan_cards(docs).count() == 0


def test_labels(spark):
    assert one(spark, labels.normalize_type(F.lit(" UX "))) == "product"
    assert one(spark, labels.change_category(F.lit("src/latest.py"))) == "test"
    assert one(spark, labels.change_category(F.lit("Cargo.toml"))) == "other"
    assert one(spark, labels.change_category(F.lit("a/main.py"))) == "source"
    assert one(spark, labels.token_cost(F.lit("gpt-4o-mini"), F.lit(1000000), F.lit(0))) == 2.5
    assert one(spark, labels.path_access(F.lit("a/b.py"), F.array().cast("array<string>"), F.array(F.lit("a/*")))) is True


def test_clusters_at_the_limit(spark):
    from ledgerwing.operators import governance

    def rows(n):
        return [(i, 1, "p", "d/f.py", i % 2, 0.5, at(i)) for i in range(n)]

    schema = "id long, project long, pattern_id string, file string, severity_rank int, confidence double, ts timestamp"
    assert governance.cluster(spark.createDataFrame(rows(10), schema)).first()["cluster"] == "1::p::d"
    eleven = governance.cluster(spark.createDataFrame(rows(11), schema)).first()
    assert (eleven["cluster"], eleven["representative"]) == ("1::p::d/f.py", 1)


def test_k_anonymity(spark):
    rows = [(o, "auth", 0.5) for o in range(4)]
    schema = "org_id long, dimension string, confidence double"
    assert aggregates.aggregate_orgs(spark.createDataFrame(rows, schema)).count() == 0
    assert aggregates.aggregate_orgs(spark.createDataFrame([*rows, (9, "auth", 0.5)], schema)).count() == 1


def test_coverage_without_common_words(spark):
    r = spark.createDataFrame([(1, "alpha beta"), (2, "zzz")], "r long, t string")
    d = spark.createDataFrame([(5, "beta alpha"), (4, "alpha beta")], "d long, t2 string")
    assert sorted(tuple(x) for x in matching.coverage(r, d, "r", "t", "d", "t2").collect()) == [(1, 4, 1.0, "implemented"), (2, None, 0.0, "not_started")]


def test_session_logs(spark):
    lines = [
        '{"type": "assistant", "timestamp": "t1", "message": {"model": "m", "usage": {"input_tokens": 1, "cache_creation_input_tokens": 2, "cache_read_input_tokens": 3, "output_tokens": 4}, "content": [{"type": "tool"}, {"type": "text", "text": "hello"}]}}',
        '{"type": "user", "timestamp": "t2"}',
        "broken",
        '{"type": "assistant", "timestamp": "t3", "message": {"model": "", "usage": {}}}',
    ]
    found = readers.parse_session_logs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["timestamp"], r["input_tokens"], r["output_tokens"], r["prompt_preview"]) for r in found] == [("t1", 6, 4, "hello")]


def test_json_folders(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1",\n "title": "x", "dimensions": ["auth"], "valid": true}')
    (tmp_path / "b.json").write_text("{broken")
    assert [r["id"] for r in readers.read_decisions(spark, str(tmp_path)).collect()] == ["1"]


def test_labelled_pairs(spark, tmp_path):
    rows = [("1", "a", "b", "tension", "auth", "r"), ("2", "a", "a", "odd", "auth", " ")]
    pairs_df = spark.createDataFrame(rows, "pair_id string, decision_a string, decision_b string, label string, dimension string, reasoning string")
    readers.write_pairs(pairs_df, str(tmp_path / "p"))
    found = {r["pair_id"]: r["reasons"] for r in readers.invalid_pair_reasons(readers.read_pairs(spark, str(tmp_path / "p"))).collect()}
    assert found == {"1": [], "2": ["reasoning is empty", "unknown label", "both sides are equal"]}


def test_source_tree(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.py", "tests/c.py", "src/test_d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("import os\nfrom a.b import c\n")
    tree = readers.read_source_tree(spark, str(tmp_path))
    assert [r["path"] for r in tree.collect()] == ["src/a.py"]
    assert sorted(r["module"] for r in text.extract_imports(tree).collect()) == ["a.b", "os"]


def test_code_rules(spark):
    from ledgerwing.functions import code

    files = [
        ("a.py", 'def f():\n    """sleep(5)\n    """\n    # sleep(6)\n    sleep(7)\n    await x\nasync def g():\n    await y\n    try:\n        return 1\n    except Exception:\n        raise\n'),
        ("Dockerfile", "FROM x:latest\nRUN y"),
        ("k8s/a.yaml", "image: x\nfoo\nlimits: 1\n" + "\n" * 20 + "image: y\nprivileged: true"),
        ("b.py", "def broken("),
        ("c.py", None),
    ]
    df = spark.createDataFrame(files, "path string, source string")
    assert [(r["path"], r["line_number"]) for r in code.await_in_sync(df).collect()] == [("a.py", 6)]
    features = {r["name"]: r["features"] for r in code.function_features(df).collect()}
    assert features == {"g": ["try_except"]}


def test_function_features_of_nested_and_odd_calls(spark):
    from ledgerwing.functions import code

    source = (
        "def a():\n    def b():\n        return get().logger.info(1)\n    while c: pass\n"
        "def c():\n    urllib.request.urlopen(x)\n    deep.a.requests.get(x)\n"
        "def d():\n    try:\n        pass\n    finally:\n        os.environ.get('x')\n"
        "async def e():\n    if y:\n        def f():\n            return fetch(x)\n"
        "def g():\n    raise pkg.ValueError(1)\n"
        "def h():\n    raise pkg.ValueError\n"
    )
    found = code.function_features(spark.createDataFrame([("x.py", source)], "path string, source string")).collect()
    assert {r["name"]: r["features"] for r in found} == {"a": ["logging"], "b": ["logging"], "c": ["http_call"], "d": ["env_access"], "e": ["http_call", "return_early"], "f": ["http_call"], "g": ["validation"]}


def test_requirements_by_sentence(spark):
    docs = spark.createDataFrame([(1, "# Title\n- one item\n2) abc\nIt works. You will log in! We require it? No.\n####### not a header must\n## Next\nneed to go")], "doc_id long, text string")
    found = [tuple(r) for r in text.extract_requirements(docs).orderBy("line_number", "part").collect()]
    assert found == [(1, 2, 1, "Title", "one item"), (1, 4, 1, "Title", "You will log in!"), (1, 4, 2, "Title", "We require it?"), (1, 5, 1, "Title", "####### not a header must"), (1, 7, 1, "Next", "need to go")]


def test_governance_rules(spark):
    from ledgerwing.operators import governance as gov

    ids = spark.createDataFrame([("a", "trusted", None), ("b", "verified", ["execute_code"]), ("c", "privileged", None)], "agent_id string, trust string, extra array<string>")
    asked = spark.createDataFrame([(1, "a", "execute_code"), (2, "a", "manage_agents"), (3, "b", "execute_code"), (4, "c", "modify_governance"), (5, "z", "read_decisions")], "request_id int, agent_id string, capability string")
    assert {r["request_id"]: r["allowed"] for r in gov.check_capability(asked, ids).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    waivers = [("w1", "c", "break_glass", "r", ["x"], at(0), False), ("w2", "c", "auto_waiver", "r", [], at(0), False), ("w3", "c", "elevated", "", ["x"], at(0), False)]
    rows = spark.createDataFrame(waivers, "id string, contradiction_id string, tier string, reason string, approvers array<string>, created_at timestamp, reviewed boolean")
    found = {r["id"]: (r["expired"], r["active"], r["pending_review"], r["errors"]) for r in gov.exception_status(rows, F.lit(at(72 * 3600))).collect()}
    assert found == {"w1": (True, False, True, []), "w2": (False, True, False, []), "w3": (False, False, False, ["no reason", "1 approvals of 2"])}
    answers = spark.createDataFrame([(1, "qa", True), (1, "ciso", False), (2, "qa", False)], "request_id int, role string, dissenting boolean")
    wanted = spark.createDataFrame([(n, ["qa", "ciso"]) for n in (1, 2, 3)], "request_id int, required_roles array<string>")
    assert {r["request_id"]: (r["approved"], r["dissent"], r["pending_roles"]) for r in gov.approval_status(wanted, answers).collect()} == {1: (True, True, []), 2: (False, False, ["ciso"]), 3: (False, False, ["qa", "ciso"])}
    met = spark.createDataFrame([("h", str(i), s) for i, s in enumerate(["met", "met", "partial", "unmet"])], "org string, requirement string, status string")
    hits = spark.createDataFrame([("h", 9)], "org string, n long")
    assert tuple(gov.compliance_scores(met, hits, 0.1).first()) == ("h", 2, 4, 0.625, 0.75, False)
    modules = spark.createDataFrame([("foo.bar.baz", 4), ("x", 8)], "module string, in_degree long")
    evidence = spark.createDataFrame([(1, 2, "foo.bar", "f"), (2, 2, "x", "f"), (2, 2, "foo", "g"), (3, 2, "fo", "f")], "id int, severity_rank int, module string, file string")
    churned = spark.createDataFrame([("g", 1.5)], "path string, factor double")
    assert {r["id"]: r["priority"] for r in gov.assumption_priority(evidence, modules, churned).collect()} == {1: 3.0, 2: 6.0, 3: 2.0}


def test_fold_accuracy(spark):
    """A feature that tells the label apart is found on rows that the models did not see; noise is not."""
    from ledgerwing.operators import risk

    rows = [(i, i % 5, float(i % 3), 0.0, i % 4, 1.0, 10, 2, i % 5 >= 3) for i in range(150)]
    names = [*risk.FEATURES]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" if k in (1, 2, 4) else f"{n} long" for k, n in enumerate(names)) + ", label boolean").withColumn("label", F.col("label").cast("double"))
    assert risk.fold_accuracy(df, folds=3, trees=2) == 1.0
    assert risk.fold_accuracy(df.limit(0), folds=2) == 0.0

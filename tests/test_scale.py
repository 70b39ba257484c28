"""Steps whose work must grow with the input: rounds, rows that meet, and what is shuffled."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerwing.functions import assumptions
from ledgerwing.operators import governance, graph, integrity, meetings, pairs, review, risk
from ledgerwing.streaming import monitors
from ledgerwing.plans import load_all, stream_queries
from tests.test_streams import T0, batches


QUERIES = load_all().QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cycles_end_once_no_chain_ends(spark, monkeypatch):
    cuts = []
    cut = graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: cuts.append(1) or cut(df))
    rows = [(i, i - 1 if i % 4 else None, i // 4) for i in range(1000)] + [(1000, 1001, 500), (1001, 1000, 500), (1002, 1000, 500)]
    d = spark.createDataFrame(rows, "id long, supersedes long, project long")
    found = {r["id"]: (r["root"], r["depth"], r["cyclic"]) for r in graph.supersession_chains(d).collect()}
    assert found == {i: (i - i % 4, i % 4, False) if i < 1000 else (None, None, True) for i in range(1003)}
    assert len(cuts) <= 5  # not a round for each doubling up to the number of ids
    assert {r["project"] for r in graph.has_cycle(d).filter("has_cycle").collect()} == {500}


def test_a_shared_keyword_brings_its_first_files_alone(spark):
    losers = spark.createDataFrame([(i, "ring or bell" if i % 2 else "bell") for i in range(40)], "id long, title string")
    files = spark.createDataFrame([(f"f{i:03}", "SPRING" if i % 3 else "bell") for i in range(90)], "path string, content string")
    found = review.affected_files(losers, files, most=2)
    rings, bells = ["f001", "f002"], ["f000", "f003"]
    assert sorted((r["id"], r["path"]) for r in found.collect()) == [(i, p) for i in range(40) for p in (sorted(rings + bells)[:2] if i % 2 else bells)]
    assert "dense_rank(path" in plan(found)  # files are ranked before they meet the decisions


def test_streamed_events_meet_in_buckets_of_the_window(spark, tmp_path):
    parts = [[(1, 1, "d", 4), (2, 2, "d", 6), (3, 3, "d", 9)], [(4, 4, "d", 10), (5, 5, "e", 10), (6, 6, "d", 16)]]
    built = monitors.collision_stream(batches(spark, tmp_path, parts).withColumnRenamed("action", "dimension"))
    assert "(a_bucket#" in built._jdf.queryExecution().analyzed().toString()  # a part of the join's key
    found = monitors.run_available(built, "buckets", str(tmp_path / "log"))
    assert sorted((r["a_event"], r["b_event"]) for r in found.collect()) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]


def test_linked_collisions_go_without_a_shuffle_of_pairs(spark):
    at = [(1, 1, 0), (2, 2, 0), (3, 3, 299), (4, 4, 300), (5, 5, 601), (6, 1, 10)]
    events = spark.createDataFrame([(i, a, "d", T0 + datetime.timedelta(seconds=s)) for i, a, s in at], "event_id long, agent_id long, dimension string, ts timestamp")
    links = spark.createDataFrame([(1, 2), (1, 4), (1, 4), (2, 1), (3, 5), (9, 9), (None, 4)], "source long, target long")
    every = {(a, b) for a, ka, sa in at for b, kb, sb in at if ka != kb and (sa, a) < (sb, b) and sb - sa <= 300}
    found = pairs.collisions(events, links)
    assert sorted((r["a_event"], r["b_event"]) for r in found.collect()) == sorted(every - {(1, 2), (1, 4)})
    assert "LeftAnti" not in plan(found)
    assert {(r["a_event"], r["b_event"]) for r in pairs.collisions(events).collect()} == every


def test_a_walk_writes_each_round_once(spark, monkeypatch):
    cuts = []
    cut = graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: cuts.append(1) or cut(df))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "source long, target long")
    found = graph.reachable(edges, spark.createDataFrame([(1,), (4,), (9,)], "seed long"))
    assert sorted((r["seed"], r["node"], r["hops"]) for r in found.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (4, 4, 0), (9, 9, 0)]
    assert len(cuts) == 6  # edges, seeds, and four rounds, the last of which meets nothing


def test_vectors_of_a_group_meet_in_blocks(spark):
    rows = [(f"k{i:03}", i % 2 if i else None, None if i == 7 else [1.0, None] if i == 9 else [1.0] if i == 11 else [0.0, 0.0] if i == 13 else [float(i % 5), float(i % 7)]) for i in range(600)]
    table = spark.createDataFrame(rows, "key string, grp int, vector array<float>")

    def cosine(u, v):
        if u is None or v is None or None in u + v or len(u) != len(v):
            return None
        norm = sum(x * x for x in u) ** 0.5 * sum(x * x for x in v) ** 0.5
        return 0.0 if norm == 0 else sum(x * y for x, y in zip(u, v, strict=True)) / norm

    for asked, wanted in ((None, lambda a, b: a < b), (table.filter("key like '%3'"), lambda a, b: a != b and a.endswith("3"))):
        compared = pairs.compare_fingerprints(table, asked=asked)
        found = [tuple(r) for r in compared.collect()]
        every = {(a, b): cosine(u, v) for a, g, u in rows for b, h, v in rows if g == h and g is not None and wanted(a, b)}
        assert len(found) == len(every)
        assert all((s is None and c is None and every[a, b] is None) or (abs(s - every[a, b]) < 1e-6 and c == (s >= 0.7)) for a, b, s, c in found)
        assert "MapInArrow" in plan(compared)  # not a row of two vectors a pair


def test_pairs_are_neither_grouped_nor_shuffled(spark):
    rows = [(p, i, d) for p, i, ds in (("x", 1, "ab"), ("x", 2, "bac"), ("x", 3, "c"), ("y", 4, "a"), ("x", 5, "d"), ("y", 6, "aa"), (None, 7, "a"), (None, 8, "a")) for d in ds]
    bridge = spark.createDataFrame([*rows, ("x", 3, None), ("x", 5, None)], "project string, id long, dimension string")
    found = pairs.candidate_pairs(bridge)
    every = {("x", 1, 2, ("a", "b"), 2), ("x", 2, 3, ("c",), 1), ("y", 4, 6, ("a",), 1)}
    assert sorted((p, a, b, tuple(s), n) for p, a, b, s, n in found.collect()) == sorted(every)
    assert plan(found).index("Join") < plan(found).index("Aggregate")  # decisions are grouped before they meet, pairs are not
    facts = spark.createDataFrame([(1, 0.5), (2, 0.25), (4, 1.0)], "id long, confidence double")
    assert [tuple(r) for r in pairs.candidate_pairs(bridge, facts).select("a_id", "b_id", "a_confidence", "b_confidence").collect()] == [(1, 2, 0.5, 0.25)]


def test_affected_decisions_are_looked_up_where_pairs_lie(spark):
    bridge = spark.createDataFrame([("x", i, d) for i, ds in ((1, "ab"), (2, "ab"), (3, "bc"), (4, "c"), (5, "a")) for d in ds], "project string, id long, dimension string")
    decisions = spark.createDataFrame([(i, i != 2) for i in range(1, 6)], "id long, valid boolean")
    against = pairs.candidate_pairs(bridge, decisions).select(F.concat_ws("-", "a_id", "b_id").alias("id"), "project", "a_id", "b_id", "shared_dimensions", "a_valid", "b_valid")
    wanted = {("1-2", 2), ("1-3", 0), ("1-5", 0), ("2-3", 1), ("2-5", 1), ("3-4", 0)}
    found = pairs.with_affected(against, decisions, bridge)
    assert {(r["id"], r["affected"]) for r in found.collect()} == wanted
    assert {tuple(r) for r in pairs.affected_count(against.drop("a_valid", "b_valid"), decisions, bridge).collect()} == wanted


def test_features_of_a_project_are_made_in_one_place(spark):
    bridge = spark.createDataFrame([("x", 1, "a"), ("x", 2, "a"), ("x", 2, "b"), ("x", 3, None)], "project string, id long, dimension string")
    at = [datetime.timedelta(hours=h) for h in (0, 5, 9)]
    decisions = spark.createDataFrame([(i + 1, "x", T0 + h, i != 1, "scan") for i, h in enumerate(at)], "id long, project string, created_at timestamp, valid boolean, agent_type string")
    against = spark.createDataFrame([("x", 1, 2, ["a"], "contradiction"), ("x", 1, 3, ["a"], "tension")], "project string, a_id long, b_id long, shared_dimensions array<string>, verdict string")
    found = risk.risk_features(decisions, bridge, against, F.lit(T0 + datetime.timedelta(days=1)))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 1.0, 0.5, 2, 0.0, 2, 1, 1), (2, 1, 0.5, 0.25, 2, 5.0, 2, 2, 1), (3, 0, 0.0, 0.0, 2, 0.0, 2, 1, 0)]
    assert plan(found).count("Join") <= 5  # densities, rates and gaps do not come back by joins on dimensions


def test_whole_sets_are_shuffled_once_for_patterns(spark):
    sets = spark.createDataFrame([("f", ["a", "b", "b"]), ("g", ["a"]), ("h", ["c", None])], "key string, items array<string>")
    mined = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["c", "d"],)], "itemset array<string>")
    found = governance.missing_patterns(sets, mined)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in found.collect()) == [("f", "a,b,c", "a,b", "c", 0.67), ("g", "a,b", "a", "b", 0.5), ("h", "c,d", "c", "d", 0.5)]


def test_leaves_are_read_once_and_sizes_summed_on_the_way_up(spark, monkeypatch):
    monkeypatch.setattr(integrity, "FOLD", 2)
    leaves = spark.createDataFrame([(n, i, f"{n}-{i}") for n in (1, 2, 5, 16, 17, 40) for i in range(n)], "log long, idx long, data string")
    roots = integrity.merkle_root(leaves)
    assert "Join" not in plan(roots) and {r["log"]: r["size"] for r in roots.collect()} == {n: n for n in (1, 2, 5, 16, 17, 40)}
    heads = spark.createDataFrame([tuple(r) for r in integrity.merkle_root(leaves.filter("idx < 17"), 17).collect()], "log long, size long, root string")
    heads = heads.unionByName(spark.createDataFrame([(99, 1, "00")], heads.schema))
    changed = leaves.filter("log <> 5 or idx <> 4").withColumn("data", F.when((F.col("log") == 16) & (F.col("idx") == 15), "x").otherwise(F.col("data")))
    checked = integrity.verify_consistency(changed, heads)
    assert {r["log"]: r["consistent"] for r in checked.collect()} == {1: True, 2: True, 5: False, 16: False, 17: True, 40: True, 99: False}
    assert integrity.verify_consistency(leaves, heads.limit(0)).count() == 0


def test_shared_writes_go_where_findings_lie(spark, monkeypatch):
    rows = [("a.py", "INSERT INTO users x"), ("b.py", "update Users set x"), ("c.py", "INSERT INTO logs"), ("c.py", "INSERT INTO logs"), ("d.py", "INSERT INTO old_users_2"), ("e.py", "x.all()"), (None, "INSERT INTO logs"), ("f.py", "INSERT INTO pets; INSERT INTO t_9"), ("g.py", "UPDATE pets SET a")]
    files = spark.createDataFrame(rows, "path string, source string")
    for size in (1 << 22, 4):
        monkeypatch.setattr("ledgerwing.operators.keywords.PASS_BYTES", size)
        left = assumptions.drop_shared_writes(assumptions.scan(files), files)
        assert sorted((r["path"], r["rule"]) for r in left.collect()) == [("c.py", "single_source_write"), ("c.py", "single_source_write"), ("e.py", "no_pagination")]
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()  # neither joined nor made distinct


def test_a_match_is_looked_for_once_a_group(spark):
    files = spark.createDataFrame([("a.py", "port = 5432\nx = '\x02'\nbind(('', 8080"), ("b.py", "'''\nport = 80\n'''\nport = 81\nurl = ':443/x'\n# :80/x")], "path string, source string")
    ports = tuple(r for r in assumptions.RULES if r.rule == "hardcoded_port")
    found = assumptions.scan(files, ports)
    assert sorted((r["path"], r["line_number"], r["summary"].split()[2]) for r in found.collect()) == [("a.py", 1, "5432"), ("a.py", 3, "8080"), ("b.py", 5, "443")]
    assert plan(found).count("regexp_extract(") <= 16  # seven groups and the whole, for the rule's own check and for the finding


def test_small_files_are_dealt_evenly(spark, sf_dir):
    assert "Repartition" in plan(QUERIES["scan_assumptions"](spark, sf_dir))


def test_events_are_shuffled_once_and_swept_in_order(spark):
    seconds = [-3601, -3600, -1, 0, 0, 0, 0, 299, 300, 300.000001, 3300, 3599.5, 3600, 3600, 3899.5, 3900, 3900.1, 7199, 7200, 7200, None]
    events = [(i if i % 9 else None, f"agent{i % 4}" if i % 7 else None, "de"[i % 5 == 0] if i % 11 else None, s) for i, s in enumerate(seconds * 2)]
    table = spark.createDataFrame([(i, k, d, None if s is None else datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=s)) for i, k, d, s in events], "event_id long, agent_id string, dimension string, ts timestamp")
    ids = [i for i, *_ in events if i is not None]
    links = [(a, b) for a in ids for b in ids if (a + 2 * b) % 5 == 0]

    def pairs_of(linked):
        near = [(a, b, d, round(t - s, 6)) for a, k, d, s in events for b, m, e, t in events if None not in (s, t, k, m, d, e) and k != m and d == e and 0 <= t - s <= 300 and (s < t or (None not in (a, b) and a < b))]
        return sorted((x for x in near if x[:2] not in linked), key=repr)

    known = spark.createDataFrame([*links, (None, 1), (1, None)], "source int, target long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in (size, "3"):  # windows also reach over what comes at a time
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            assert sorted(map(tuple, pairs.collisions(table).collect()), key=repr) == pairs_of(set())
            assert sorted(map(tuple, pairs.collisions(table, known).collect()), key=repr) == pairs_of(set(links))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    found = pairs.collisions(table)
    assert "Join" not in plan(found) and found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    dealt = meetings.slices(spark.range(36000).selectExpr("id event_id", "id agent_id", "'d' dimension", "timestamp_seconds(id) ts"), 300)
    assert dealt.count() == 36000 + 3000  # one in SLICE_WINDOWS goes to two slices


def test_pairs_of_a_window_are_made_some_at_a_time(monkeypatch):
    monkeypatch.setattr(meetings, "PAIRS", 50)
    at = np.arange(300) // 3
    rows = pa.table({"event_id": pa.array(range(300)), "agent_id": pa.array([i % 2 for i in range(300)])})
    links = pa.table({"source": pa.array([i for i in range(0, 290, 7)]), "target": pa.array([i + 3 for i in range(0, 290, 7)])})
    made = list(meetings.met(rows, at, np.arange(1, 300, 2), links, 20))
    every = {(a, b) for b in range(1, 300, 2) for a in range(0, b, 2) if at[b] - at[a] <= 20 and not (a % 7 == 0 and a < 290 and b == a + 3)}
    assert {(a, b) for x, y in made for a, b in zip(x.tolist(), y.tolist(), strict=True)} == every
    assert sum(len(x) for x, _ in made) == len(every) and max(len(x) for x, _ in made) <= 60


def crowd(spark, tmp_path, monkeypatch):
    """1500 events of one window, which make a million pairs, and all pairs by two agents."""
    events = spark.range(1500).selectExpr("id event_id", "timestamp_micros(1704067200000000 + id * 190000) ts", "id % 7 user_id", "'view' event_type", "1.0D value", "'{\"k\": 1}' props")
    events.repartition(4).write.parquet(f"{tmp_path}/in/events.parquet")
    monkeypatch.setattr(stream_queries, "_folder", lambda spark: f"{tmp_path}/out/{len(list(tmp_path.glob('out/*')))}")
    return f"{tmp_path}/in", [(i, j) for j in range(1500) for i in range(j) if (j - i) % 7]


def test_streamed_pairs_are_not_written(spark, tmp_path, monkeypatch):
    folder, every = crowd(spark, tmp_path, monkeypatch)
    assert QUERIES["collision_stream"](spark, folder).count() == len(every) > 900_000
    assert sum(x.stat().st_size for x in tmp_path.glob("out/*/rows/*.parquet")) < 100_000  # grows with the events


def test_streamed_pairs_do_not_meet_their_links(spark, tmp_path, monkeypatch):
    folder, every = crowd(spark, tmp_path, monkeypatch)
    found = QUERIES["causal_collision_stream"](spark, folder)
    wanted = [i * 1500 + j for i, j in every if i % 2 or not j % 2]
    assert tuple(found.agg(F.count("*"), F.sum(F.col("a_event") * 1500 + F.col("b_event"))).first()) == (len(wanted), sum(wanted))
    assert sum(x.stat().st_size for x in tmp_path.glob("out/*/rows/*.parquet")) < 300_000  # of both streams

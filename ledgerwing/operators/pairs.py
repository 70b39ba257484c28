"""Pairs, rankings and matches between decisions, contradictions, files and agents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.operators import meetings
from ledgerwing.schemas import DIMENSIONS

MONTH_SECONDS = 2592000.0


def candidate_pairs(bridge: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """project, a_id, b_id, shared_dimensions, shared_count: decisions of a project that share a dimension, once.

    A decision travels as one row with its dimensions, and meets the others of its project: each pair comes up once, and pairs, which
    grow with the square of a project, are neither shuffled nor grouped. They stay together by project; adaptive execution splits a
    large project. facts (id and others): decisions without a row in it are left out, and its columns follow as a_* and b_*.
    """
    sets = bridge.groupBy("project", "id").agg(F.sort_array(F.collect_set("dimension")).alias("dims"))
    more = []
    if facts is not None:
        sets, more = sets.join(facts, "id"), [c for c in facts.columns if c != "id"]
    left, right = [sets.select("project", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "dims", *more)]) for s in ("a", "b")]
    met = left.join(right, "project").filter((F.col("a_id") < F.col("b_id")) & F.arrays_overlap("a_dims", "b_dims"))
    shared = met.withColumn("shared_dimensions", F.array_intersect("a_dims", "b_dims"))
    return shared.select("project", "a_id", "b_id", "shared_dimensions", F.size("shared_dimensions").cast("long").alias("shared_count"), *[f"{s}_{c}" for c in more for s in ("a", "b")])


def dimension_sets(bridge: DataFrame, names: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """project, id, dims: each decision's dimensions as bits in the order of names, at most 63 of them; another name is an error.

    A project has few different sets, however many decisions.
    """
    bit = F.raise_error(F.concat(F.lit("no such dimension: "), F.col("dimension"))).cast("long")
    for n, name in enumerate(names):
        bit = F.when(F.col("dimension") == name, F.lit(1 << n).cast("long")).otherwise(bit)
    return bridge.groupBy("project", "id").agg(F.bit_or(bit).alias("dims"))


def overlapping_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """project, dims, shared_count and the columns of right but its dims: sets of left (project, dims) that have dimensions in common with those of right."""
    a, b = left.select("project", "dims").distinct(), right.withColumnRenamed("dims", "other_dims")
    met = a.join(b, "project").filter(F.col("dims").bitwiseAND(F.col("other_dims")) != 0)
    return met.withColumn("shared_count", F.bit_count(F.col("dims").bitwiseAND(F.col("other_dims"))).cast("long")).drop("other_dims")


def recency(created_at: Column, as_of: Column) -> Column:
    """1 / (1 + age in months of 30 days)."""
    return 1.0 / (1.0 + (F.unix_micros(as_of) - F.unix_micros(created_at)) / F.lit(1e6) / MONTH_SECONDS)


def find_related(decisions: DataFrame, bridge: DataFrame, as_of: Column, k: int = 5, names: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """id, related_id, rank, position, shared_count, score: for every decision its k related ones of highest score.

    Related: valid, of the same project, sharing a dimension. Score: shared dimensions times recency, at most 1 as
    reported; ties go to the smaller id. position puts the second best last, where readers look again.

    Decisions with equal dimensions have equal answers but for themselves, and of those with equal dimensions only the
    k + 1 newest can be in an answer. So sets of dimensions meet sets with their newest decisions, the best k + 1 are
    kept for each set, and each decision leaves itself out: the work is linear in the decisions however large a project is.
    """
    own = dimension_sets(bridge, names)
    valid = own.join(decisions.filter("valid").select("id", "created_at"), "id")
    newest = Window.partitionBy("project", "dims").orderBy(F.desc("created_at"), "id")
    heads = valid.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= k + 1)
    heads = heads.groupBy("project", "dims").agg(F.collect_list(F.struct("id", "created_at")).alias("heads"))
    met = overlapping_sets(own, heads).select("project", "dims", "shared_count", F.explode("heads").alias("h"))
    raw = F.col("shared_count") * recency(F.col("h.created_at"), as_of)
    scored = met.select("project", "dims", F.struct((-raw).alias("order"), F.col("h.id").alias("related_id"), "shared_count", raw.alias("raw")).alias("b"))
    first = Window.partitionBy("project", "dims").orderBy("b")
    best = scored.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    best = best.groupBy("project", "dims").agg(F.sort_array(F.collect_list("b")).alias("best"))
    answer = F.slice(F.filter("best", lambda b: b["related_id"] != F.col("id")), 1, k)
    told = own.join(best, ["project", "dims"]).select("id", answer.alias("a")).select("id", F.size("a").alias("n"), F.posexplode("a").alias("at", "b"))
    rank = (F.col("at") + 1).cast("int")
    return told.select("id", "b.related_id", rank.alias("rank"), attention_position(rank, F.col("n")).alias("position"), "b.shared_count", F.round(F.least(F.lit(1.0), F.col("b.raw")), 6).alias("score"))


def attention_position(rank: Column, n: Column) -> Column:
    """Where a rank stands when rank 2 goes last; lists of one or two keep their order."""
    return F.when(n <= 2, rank).when(rank == 1, 1).when(rank == 2, n).otherwise(rank - 1).cast("int")


LABEL_CHARS = 50


def graph_nodes(decisions: DataFrame, bridge: DataFrame) -> DataFrame:
    """id, label, decision_type, dimensions, confidence, status of every valid decision; one without dimensions has an empty list."""
    dims = bridge.groupBy("id").agg(F.sort_array(F.collect_set("dimension")).alias("dimensions"))
    nodes = decisions.filter("valid").join(dims, "id", "left")
    return nodes.select("id", F.substring("title", 1, LABEL_CHARS).alias("label"), "decision_type", F.coalesce("dimensions", F.array().cast("array<string>")).alias("dimensions"), "confidence", "status")


def decision_graph(decisions: DataFrame, bridge: DataFrame, contradictions: DataFrame) -> DataFrame:
    """source, target, kind, weight: edges of valid decisions to what they supersede, unresolved pairs by verdict, and valid decisions that share dimensions."""
    valid = decisions.filter("valid")
    supersedes = valid.filter("supersedes is not null").select(F.col("id").alias("source"), F.col("supersedes").alias("target"), F.lit("supersedes").alias("kind"), F.lit(1.0).alias("weight"))
    against = contradictions.filter("status = 'unresolved'").select(F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.col("verdict").alias("kind"), F.col("confidence").alias("weight"))
    live = candidate_pairs(bridge.join(valid.select("id"), "id", "left_semi"))
    shared = live.select(F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.lit("shared").alias("kind"), F.col("shared_count").cast("double").alias("weight"))
    return supersedes.unionByName(against).unionByName(shared)


def blast_radius(decisions: DataFrame, bridge: DataFrame, contradictions: DataFrame, names: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """id, related, contradicting, superseded_by, impact: how many decisions a change of each would touch.

    impact = min(1, distinct decisions touched / active decisions of its project). Related ones are valid, of the same
    project, and share a dimension: they are counted by sets of dimensions. Only those that a contradiction or a
    succession names are looked at one by one, to leave out the ones that are related too.
    """
    own = dimension_sets(bridge, names)
    live = own.join(decisions.filter("valid").select("id"), "id")
    kinds = live.groupBy("project", "dims").agg(F.count("*").alias("n"))
    counts = overlapping_sets(own, kinds).groupBy("project", "dims").agg(F.sum("n").alias("met"))
    is_live = live.select("id", F.lit(1).alias("live"))
    related = own.join(counts, ["project", "dims"]).join(is_live, "id", "left").select("id", (F.col("met") - F.coalesce("live", F.lit(0))).alias("related")).filter("related > 0")

    against = contradictions.filter("status = 'unresolved'").select(F.explode(F.array(F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("other")), F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("other")))).alias("x"))
    later = decisions.filter("supersedes is not null").select(F.col("supersedes").alias("id"), F.col("id").alias("other"), F.lit(0).alias("c"), F.lit(1).alias("s"))
    named = against.select("x.id", "x.other", F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(later)
    named = named.groupBy("id", "other").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    mine = own.select("id", F.col("project").alias("p"), F.col("dims").alias("d"))
    theirs = live.select(F.col("id").alias("other"), F.col("project").alias("q"), F.col("dims").alias("e"))
    too = F.coalesce((F.col("p") == F.col("q")) & (F.col("d").bitwiseAND(F.col("e")) != 0) & (F.col("id") != F.col("other")), F.lit(False))
    named = named.join(mine, "id", "left").join(theirs, "other", "left")
    extra = named.groupBy("id").agg(F.sum("c").alias("contradicting"), F.sum("s").alias("superseded_by"), F.count(F.when(~too, 1)).alias("new"))

    touched = related.join(extra, "id", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("related", "contradicting", "superseded_by", "new")}
    active = decisions.filter("valid").groupBy("project").agg(F.count("*").alias("active"))
    share = (zero["related"] + zero["new"]) / F.greatest(F.coalesce("active", F.lit(1)), F.lit(1))
    return (
        touched.join(decisions.select("id", "project"), "id")
        .join(active, "project", "left")
        .select("id", *[zero[c].alias(c) for c in ("related", "contradicting", "superseded_by")], F.round(F.least(F.lit(1.0), share), 6).alias("impact"))
    )


def with_affected(contradictions: DataFrame, decisions: DataFrame, bridge: DataFrame) -> DataFrame:
    """contradictions with affected: valid decisions of the project, outside the pair, that have one of its dimensions.

    Decisions are counted once by project and set of dimensions, of which there are few; each distinct set of shared
    dimensions meets those counts, and the pair's own two decisions are taken off again. A project's counts travel as one
    map from set to number, so that pairs which already lie together by project are not shuffled again. a_valid and b_valid,
    if contradictions have them, tell of decisions that have all shared dimensions; else both are looked up.
    """
    live = bridge.join(decisions.filter("valid").select("id"), "id").groupBy("project", "id").agg(F.sort_array(F.collect_set("dimension")).alias("dims"))
    kinds = live.select("project", "dims").repartition("project").groupBy("project", "dims").agg(F.count("*").alias("n"))
    rows = contradictions.withColumn("_shared", F.sort_array("shared_dimensions"))
    wanted = rows.select("project", F.col("_shared").alias("shared")).distinct()
    counted = wanted.join(kinds, "project").filter(F.arrays_overlap("shared", "dims")).groupBy("project", "shared").agg(F.sum("n").alias("n"))
    maps = counted.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("shared", "n"))).alias("_counts"))
    if {"a_valid", "b_valid"} <= set(contradictions.columns):
        own = sum((F.coalesce(f"{s}_valid", F.lit(False)).cast("long") for s in ("a", "b")), F.lit(0))
    else:
        for s in ("a", "b"):
            rows = rows.join(live.select("project", F.col("id").alias(f"{s}_id"), F.col("dims").alias(f"_{s}_dims")), ["project", f"{s}_id"], "left")
        own = sum((F.coalesce(F.arrays_overlap("_shared", f"_{s}_dims"), F.lit(False)).cast("long") for s in ("a", "b")), F.lit(0))
    rows = rows.join(maps, "project", "left")
    return rows.select(*contradictions.columns, (F.coalesce(F.col("_counts")[F.col("_shared")], F.lit(0)) - own).alias("affected"))


def affected_count(contradictions: DataFrame, decisions: DataFrame, bridge: DataFrame) -> DataFrame:
    """id, affected, as with_affected counts them."""
    return with_affected(contradictions, decisions, bridge).select("id", "affected")


def collisions(events: DataFrame, causal: DataFrame | None = None, window_seconds: int = 300) -> DataFrame:
    """a_event, b_event, dimension, gap_seconds: events of one dimension by two agents at most window apart.

    events: event_id, agent_id, dimension, ts. causal (source, target), if given, takes out pairs with a link from the
    earlier event to the later one. An event is shuffled once, or twice near the end of a slice of some windows, and slices
    are swept in order; links lie beside their source. Pairs, which grow with the square of the events in a window, are only
    put out.
    """
    kind = dict(events.dtypes)["event_id"]
    base = events.select("event_id", "agent_id", "dimension", "ts")
    rows = base.filter("agent_id is not null").withColumn("linked", F.lit(None).cast(f"array<{kind}>"))
    if causal is not None:
        links = base.select("event_id", "dimension", "ts").join(meetings.targets(causal, kind).withColumnRenamed("source", "event_id"), "event_id")
        rows = rows.unionByName(links.withColumn("agent_id", F.lit(None).cast(dict(events.dtypes)["agent_id"])))
    return meetings.swept(meetings.slices(rows, window_seconds).drop("ts"), window_seconds)


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change, category: added, removed and modified files of two snapshots (path, content_hash, category)."""
    a = before.select("path", F.col("content_hash").alias("old"), F.col("category").alias("old_category"))
    b = after.select("path", F.col("content_hash").alias("new"), F.col("category").alias("new_category"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    joined = a.join(b, "path", "full_outer").withColumn("change", change).filter("change is not null")
    return joined.select("path", "change", F.coalesce("new_category", "old_category").alias("category"))


def diff_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, name, change: symbols (file, name, body_hash) inserted, deleted or updated between two versions."""
    a, b = old.select("file", "name", F.col("body_hash").alias("old")), new.select("file", "name", F.col("body_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return a.join(b, ["file", "name"], "full_outer").withColumn("change", change).filter("change is not null").select("file", "name", "change")


def symbol_moves(changes: DataFrame) -> DataFrame:
    """name, from_file, to_file: a symbol deleted in one file and inserted in another; the last deleting file counts."""
    gone = changes.filter("change = 'delete'").groupBy("name").agg(F.max("file").alias("from_file"))
    come = changes.filter("change = 'insert'").select("name", F.col("file").alias("to_file"))
    return come.join(gone, "name").filter("from_file <> to_file").select("name", "from_file", "to_file")


def route(contradictions: DataFrame, rules: DataFrame, fallback: str = "tech_lead") -> DataFrame:
    """id, roles, dual_auth: roles of all shared dimensions, sorted; two or more need dual authorisation.

    rules (dimension, role) is a reference table of a few dozen rows.
    """
    asked = contradictions.select("id", F.explode_outer("shared_dimensions").alias("dimension"))
    found = asked.join(rules, "dimension", "left").groupBy("id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    roles = F.when(F.size("roles") == 0, F.array(F.lit(fallback))).otherwise(F.col("roles"))
    return found.select("id", roles.alias("roles"), (F.size(roles) >= 2).alias("dual_auth"))


def as_of(decisions: DataFrame, times: DataFrame, bucket_days: int = 90) -> DataFrame:
    """t, id: the decisions valid at each time, from half-open intervals [valid_from, valid_until).

    decisions: key, id, valid_from, valid_until (null: open). times: key, t. Both are cut into buckets of bucket_days,
    up to the latest time asked for, so the equi-join on key and bucket compares a time with what its bucket holds.
    """
    last = times.agg(F.max("t")).first()[0]
    if last is None:
        return times.join(decisions.select("key", "id"), "key").select("t", "key", "id").limit(0)

    def bucket(at: Column) -> Column:
        return F.floor(F.unix_micros(at) / F.lit(bucket_days * 86_400_000_000)).cast("long")

    end = F.least(F.coalesce("valid_until", F.lit(last)), F.lit(last))
    decisions = decisions.filter(F.col("valid_from") <= end).withColumn("bucket", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(end))))
    times = times.withColumn("bucket", bucket(F.col("t")))
    inside = (F.col("valid_from") <= F.col("t")) & (F.col("valid_until").isNull() | (F.col("t") < F.col("valid_until")))
    return times.join(decisions, ["key", "bucket"]).filter(inside).select("t", "key", "id")


#: Vectors in a block, and parts into which the blocks of a group are dealt, so that one large group occupies many tasks.
BLOCK_ROWS, LANES = 256, 32


def _vector_blocks(rows: DataFrame, side: str) -> DataFrame:
    """grp, and the length, keys and vectors (one after another) of blocks of BLOCK_ROWS rows of a group, where they lie.

    Vectors of a block have one length; -1 if they are null or hold a null.
    """
    held = F.col("vector").cast("array<double>")
    length = F.when(held.isNotNull() & ~F.exists(held, lambda x: x.isNull()), F.size(held)).otherwise(-1)
    rows = rows.filter("grp is not null").select("grp", "key", F.coalesce(length, F.lit(-1)).alias("length"), held.alias("vector")).sortWithinPartitions("grp", "length")
    kinds = dict(rows.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, length = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at = 0
            while at < len(grp):
                end = at + 1
                while end < len(grp) and end - at < BLOCK_ROWS and (grp[end], length[end]) == (grp[at], length[at]):
                    end += 1
                keys = pa.ListArray.from_arrays([0, end - at], batch.column(1).slice(at, end - at))
                flat = batch.column(3).slice(at, end - at).flatten().to_numpy() if length[at] > 0 else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([length[at]], pa.int32()), keys, pa.array([flat.tobytes()], pa.binary())], names=["grp", f"{side}_length", f"{side}_keys", f"{side}_flat"])
                at = end

    return rows.mapInArrow(cut, f"grp {kinds['grp']}, {side}_length int, {side}_keys array<{kinds['key']}>, {side}_flat binary")


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the columns of x and y, component after component, so that a sum does not depend on the block."""
    out = np.zeros(np.broadcast_shapes(x.shape[1:], y.shape[1:]))
    for p, q in zip(x, y, strict=True):
        out += p * q
    return out


def _block_cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            row = {name: batch.column(k)[n] for k, name in enumerate(batch.schema.names)}
            a, b = row["a_keys"].values, row["b_keys"].values
            dims, cosine = row["a_length"].as_py(), None
            if dims == row["b_length"].as_py() and dims >= 0:
                x, y = [np.ascontiguousarray(np.frombuffer(row[f].as_buffer()).reshape(-1, dims).T) if dims else np.zeros((0, len(keys))) for f, keys in (("a_flat", a), ("b_flat", b))]
                with np.errstate(all="ignore"):
                    norm = np.sqrt(_dot(x, x))[:, None] * np.sqrt(_dot(y, y))[None, :]
                    cosine = np.where(norm == 0, 0.0, _dot(x[:, :, None], y[:, None, :]) / norm).ravel()
            values = pa.nulls(len(a) * len(b), pa.float64()) if cosine is None else pa.array(cosine)
            first = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
            yield pa.RecordBatch.from_arrays([a.take(pa.array(first[0])), b.take(pa.array(first[1])), values], names=["a", "b", "cosine"])


def compare_fingerprints(fingerprints: DataFrame, threshold: float = 0.7, asked: DataFrame | None = None) -> DataFrame:
    """a, b, similarity, compatible: cosine of the vectors of every two rows of a stated set in one group.

    fingerprints: grp, key, vector. Only rows of one group meet. asked, of the same columns: its rows meet all others of
    fingerprints instead, as a. Rows travel in blocks, and a pair of blocks is one product in a task, whose memory is
    bounded by BLOCK_ROWS; the number of pairs stays quadratic in a group. Vectors that are null, hold nulls or differ in
    length have no similarity.
    """
    spark = fingerprints.sparkSession
    x = _vector_blocks(fingerprints if asked is None else asked, "a").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    y = _vector_blocks(fingerprints, "b").withColumn("lane", F.pmod(F.xxhash64("b_keys"), F.lit(LANES)).cast("int"))
    # few bytes make many pairs, so the number of tasks must not follow the bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    x, y = [side.repartition(tasks, "grp", "lane") for side in (x, y)]
    key = dict(fingerprints.dtypes)["key"]
    met = x.hint("merge").join(y, ["grp", "lane"]).select(*[f"{s}_{c}" for s in ("a", "b") for c in ("length", "keys", "flat")])
    pairs = met.mapInArrow(_block_cosines, f"a {key}, b {key}, cosine double").filter("a < b" if asked is None else "a <> b")
    return pairs.select("a", "b", F.round("cosine", 6).alias("similarity")).withColumn("compatible", F.col("similarity") >= threshold)


def fingerprint_notes(pairs: DataFrame, names: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """pairs (a_vector, b_vector) with similarities (dimension -> 0 to 1) and notes on the dimensions in which two projects differ.

    The first slots of a fingerprint are scores by dimension. Both without a dimension agree in it; else the gap counts
    by the greater score. Under 0.3 is a major divergence, under 0.6 a moderate difference.
    """
    likeness = []
    for n in range(len(names)):
        a, b = F.col("a_vector")[n], F.col("b_vector")[n]
        likeness.append(F.when((a == 0) & (b == 0), 1.0).otherwise(1 - F.abs(a - b) / F.greatest(a, b, F.lit(0.001))))
    slots = F.array(*[F.struct(F.lit(name).alias("name"), x.alias("x")) for name, x in zip(names, likeness, strict=True)])
    kept = F.filter(slots, lambda s: s["x"] < 0.6)
    note = F.transform(kept, lambda s: F.when(s["x"] < 0.3, F.concat(F.lit("Major divergence in '"), s["name"], F.lit("' — review required"))).otherwise(F.concat(F.lit("Moderate difference in '"), s["name"], F.lit("'"))))
    similar = F.map_from_entries(F.transform(slots, lambda s: F.struct(s["name"], F.round(s["x"], 6))))
    return pairs.withColumn("similarities", similar).withColumn("notes", note)


def dedupe_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """new rows with known_status: `validated`, `known` or `new`, by the dedup key; baseline where a project has none."""
    had = known.select("project").distinct().withColumn("has_known", F.lit(True))
    seen = known.groupBy("project", "dedup_key").agg(F.max(F.when(F.col("status") == "validated", 1).otherwise(0)).alias("v"))
    joined = new.join(seen, ["project", "dedup_key"], "left").join(had, "project", "left")
    status = F.when(F.col("v") == 1, "validated").when(F.col("v") == 0, "known").otherwise("new")
    return joined.select(*new.columns, status.alias("known_status"), F.col("has_known").isNull().alias("is_baseline"))


def contradiction_sides(contradictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """decision id beside each contradiction it is part of, and the other side's title."""
    sides = contradictions.select("id", "verdict", "status", F.explode(F.array(F.struct(F.col("a_id").alias("mine"), F.col("b_id").alias("other")), F.struct(F.col("b_id").alias("mine"), F.col("a_id").alias("other")))).alias("s"))
    other = decisions.select(F.col("id").alias("other_id"), F.col("title").alias("other_title"))
    return sides.join(other, F.col("s.other") == F.col("other_id")).select(F.col("s.mine").alias("decision_id"), F.col("id").alias("contradiction_id"), "verdict", "status", "other_title")


def agent_activity(decisions: DataFrame, contradictions: DataFrame) -> DataFrame:
    """made_by, decisions_made, contradictions_triggered."""
    sides = contradictions.select("id", F.explode(F.array("a_id", "b_id")).alias("decision_id"))
    triggered = sides.join(decisions.select(F.col("id").alias("decision_id"), "made_by"), "decision_id").groupBy("made_by").agg(F.countDistinct("id").alias("contradictions_triggered"))
    made = decisions.groupBy("made_by").agg(F.count("*").alias("decisions_made"))
    return made.join(triggered, "made_by", "left").select("made_by", "decisions_made", F.coalesce("contradictions_triggered", F.lit(0)).alias("contradictions_triggered"))


def unresolved(contradictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open, non-baseline contradictions with the project of their first decision."""
    owner = decisions.select(F.col("id").alias("a_id"), F.col("project").alias("owner"))
    open_ = contradictions.filter("status = 'unresolved' and not is_baseline")
    return open_.join(owner, "a_id").select("id", F.col("owner").alias("project"), "verdict", "confidence", "detected_at")


def influence(edges: DataFrame) -> DataFrame:
    """agent, influences, influenced_by: distinct agents along causal edges (source_agent, target_agent)."""
    out = edges.groupBy(F.col("source_agent").alias("agent")).agg(F.countDistinct("target_agent").alias("influences"))
    back = edges.groupBy(F.col("target_agent").alias("agent")).agg(F.countDistinct("source_agent").alias("influenced_by"))
    return out.join(back, "agent", "full_outer").select("agent", F.coalesce("influences", F.lit(0)).alias("influences"), F.coalesce("influenced_by", F.lit(0)).alias("influenced_by"))


def shadow_servers(servers: DataFrame, known: DataFrame) -> DataFrame:
    """server, monitored: every server with whether it is among the known ones."""
    k = known.select("server").distinct().withColumn("monitored", F.lit(True))
    return servers.join(k, "server", "left").select("server", F.coalesce("monitored", F.lit(False)).alias("monitored"))


def server_coverage(servers: DataFrame, known: DataFrame, by: str = "project") -> DataFrame:
    """by, total, monitored, unmonitored, coverage: the share of a project's servers (by, server) that are known ones."""
    watched = servers.join(known.select("server").distinct().withColumn("m", F.lit(1)), "server", "left")
    out = watched.groupBy(by).agg(F.count("*").alias("total"), F.count("m").alias("monitored"))
    return out.select(by, "total", "monitored", (F.col("total") - F.col("monitored")).alias("unmonitored"), F.round(F.col("monitored") / F.col("total"), 6).alias("coverage"))


def evaluate_actions(requests: DataFrame, contradictions: DataFrame, bridge: DataFrame, decisions: DataFrame, most_constraints: int = 5) -> DataFrame:
    """request_id, allowed, blocked_by, constraints for actions (request_id, project, dimensions).

    An unresolved pair of the project with the verdict contradiction blocks where it shares a dimension, the first by id;
    else the valid decisions of those dimensions constrain the action, at most most_constraints of them by id.
    """
    asked = requests.select("request_id", "project", F.explode("dimensions").alias("dimension"))
    against = contradictions.filter("status = 'unresolved' and verdict = 'contradiction'").select("project", "id", F.explode("shared_dimensions").alias("dimension"))
    blocked = asked.join(against, ["project", "dimension"]).groupBy("request_id").agg(F.min("id").alias("blocked_by"))
    valid = bridge.join(decisions.filter("valid").select("id"), "id", "left_semi")
    limits = asked.join(valid, ["project", "dimension"]).select("request_id", "id").distinct()
    limits = limits.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("id"))).filter(F.col("n") <= most_constraints)
    limits = limits.groupBy("request_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    joined = requests.select("request_id").join(blocked, "request_id", "left").join(limits, "request_id", "left")
    free = F.col("blocked_by").isNull()
    return joined.select("request_id", free.alias("allowed"), "blocked_by", F.when(free, F.coalesce("ids", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>")).alias("constraints"))

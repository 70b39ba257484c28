"""Windows over event sequences: spikes, loops, ordering properties, priorities and validity intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.schemas import SEVERITY_BY_TYPE


def _ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("ts", "event_id")


def llm_anomalies(spans: DataFrame, key: str = "agent_id", window: int = 20, cost_factor: float = 5, latency_factor: float = 3) -> DataFrame:
    """event_id, signal, value, average: cost and latency spikes against the mean of up to window - 1 earlier spans.

    A spike needs four earlier spans, a positive mean and a value over factor times it. A null cost counts as 0.
    """
    before = _ordered(key).rowsBetween(-(window - 1), -1)

    def spike(name: str, column: str, factor: float) -> Column:
        value = F.coalesce(F.col(column), F.lit(0.0))
        mean = F.avg(value).over(before)
        return F.when((F.count("*").over(before) >= 4) & (mean > 0) & (value > mean * factor), F.struct(F.lit(name).alias("signal"), value.alias("value"), F.round(mean, 6).alias("average")))

    found = F.array_compact(F.array(F.col("cost"), F.col("latency")))
    marked = spans.select("event_id", spike("cost_spike", "cost_usd", cost_factor).alias("cost"), spike("latency_spike", "latency_ms", latency_factor).alias("latency"))
    return marked.select("event_id", F.explode(found).alias("s")).select("event_id", "s.signal", "s.value", "s.average")


def loops(events: DataFrame, key: str = "agent_id", window: int = 10, repeats: int = 3) -> DataFrame:
    """event_id, signature, n: the most frequent signature of the last window events, where it occurs repeats times.

    Of signatures tied for most frequent, the one first seen in the window counts.
    """
    signed = events.withColumn("signature", F.concat_ws(":", "action", "target"))
    last = F.collect_list("signature").over(_ordered(key).rowsBetween(-(window - 1), 0))
    seen = signed.select("event_id", last.alias("w"))
    counted = F.transform(F.array_distinct("w"), lambda s: F.struct(F.size(F.filter("w", lambda x: x == s)).alias("n"), (-F.array_position("w", s)).alias("at"), s.alias("signature")))
    best = seen.select("event_id", F.array_max(counted).alias("b"))
    return best.filter(F.col("b.n") >= repeats).select("event_id", "b.signature", F.col("b.n").cast("long").alias("n"))


def thrash(events: DataFrame, key: str = "agent_id", window: int = 20, threshold: int = 4) -> DataFrame:
    """event_id of every event, from the fourth on, in whose last window events two signatures alternate.

    That is, both A to B and B to A occur threshold // 2 times; a repeated signature is its own reverse.
    """
    signed = events.withColumn("signature", F.concat_ws(":", "action", "target"))
    order = _ordered(key)
    pairs = signed.select("event_id", key, "ts", F.row_number().over(order).alias("n"), F.struct(F.lag("signature").over(order).alias("a"), F.col("signature").alias("b")).alias("p"))
    step = F.when(F.col("p.a").isNotNull(), F.col("p"))
    # collect_list passes over the null of an agent's first event
    seen = pairs.select("event_id", "n", F.collect_list(step).over(order.rowsBetween(-(window - 2), 0)).alias("w"))
    half = threshold // 2

    def often(a: Column, b: Column) -> Column:
        return F.size(F.filter("w", lambda x: (x["a"] == a) & (x["b"] == b))) >= half

    return seen.filter((F.col("n") >= 4) & F.exists("w", lambda p: often(p["a"], p["b"]) & often(p["b"], p["a"]))).select("event_id")


def stalls(events: DataFrame, key: str = "agent_id", seconds: float = 300) -> DataFrame:
    """event_id, gap_seconds where the gap to the agent's previous event is longer than seconds."""
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(_ordered(key)))) / F.lit(1e6)
    return events.select("event_id", F.round(gap, 6).alias("gap_seconds")).filter(F.col("gap_seconds") > seconds)


def _with_seq(events: DataFrame, key: str) -> DataFrame:
    return events.withColumn("seq", F.row_number().over(_ordered(key)))


def check_response(events: DataFrame, trigger: str, response: str, key: str = "agent_id") -> DataFrame:
    """key, violated, pending: triggers after the last response wait in vain; open ones violate the property."""
    seq = _with_seq(events, key)
    answered = F.max(F.when(F.col("action") == response, F.col("seq"))).over(Window.partitionBy(key))
    pending = F.count(F.when((F.col("action") == trigger) & (F.col("seq") > F.coalesce(F.col("answered"), F.lit(0))), 1))
    return seq.withColumn("answered", answered).groupBy(key).agg(pending.alias("pending")).select(key, (F.col("pending") > 0).alias("violated"), "pending")


def check_precedence(events: DataFrame, required: str, guarded: str, key: str = "agent_id") -> DataFrame:
    """key, violated: a guarded action came before any required one."""
    first = _with_seq(events, key).groupBy(key).agg(F.min(F.when(F.col("action") == required, F.col("seq"))).alias("r"), F.min(F.when(F.col("action") == guarded, F.col("seq"))).alias("g"))
    return first.select(key, (F.col("g").isNotNull() & (F.col("r").isNull() | (F.col("g") < F.col("r")))).alias("violated"))


def check_absence(events: DataFrame, scope_start: str, scope_end: str, forbidden: str, key: str = "agent_id") -> DataFrame:
    """key, violated, first_event: a forbidden action between a scope's start and its end."""
    mark = F.when(F.col("action") == scope_start, 1).when(F.col("action") == scope_end, 0)
    state = F.last(mark, ignorenulls=True).over(_ordered(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bad = (F.col("action") == forbidden) & (F.col("state") == 1)
    return events.withColumn("state", state).groupBy(key).agg(F.min(F.when(bad, F.struct("ts", "event_id"))).alias("f")).select(key, F.col("f").isNotNull().alias("violated"), F.col("f.event_id").alias("first_event"))


@dataclass(frozen=True)
class Property:
    """kind: response (first, second), precedence (first, second) or absence (first, second, third)."""

    name: str
    kind: str
    first: str
    second: str
    third: str = ""


def evaluate_properties(events: DataFrame, properties: list[Property], key: str = "agent_id") -> DataFrame:
    """key, violated_properties, satisfied_properties, both sorted; all properties in one pass.

    Responses and precedences compare first and last places of actions, which need no sort; absences share one.
    """
    place, action = F.struct("ts", "event_id"), F.col("action")
    states, violated = {}, []
    for n, p in enumerate(properties):
        if p.kind == "response":
            asked, answered = (F.max(F.when(action == x, place)) for x in (p.first, p.second))
            broken = asked.isNotNull() & (answered.isNull() | (asked > answered))
        elif p.kind == "precedence":
            required, guarded = (F.min(F.when(action == x, place)) for x in (p.first, p.second))
            broken = guarded.isNotNull() & (required.isNull() | (guarded < required))
        else:
            mark = F.when(action == p.first, 1).when(action == p.second, 0)
            states[f"_state{n}"] = F.last(mark, ignorenulls=True).over(_ordered(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            broken = F.bool_or((action == p.third) & (F.coalesce(F.col(f"_state{n}"), F.lit(0)) == 1))
        violated.append(F.struct(F.lit(p.name).alias("name"), F.coalesce(broken, F.lit(False)).alias("violated")))
    whole = (events.withColumns(states) if states else events).groupBy(key).agg(F.array(*violated).alias("p"))

    def names(hit: bool) -> Column:
        return F.sort_array(F.transform(F.filter("p", lambda x: x["violated"] == hit), lambda x: x["name"]))

    return whole.select(key, names(True).alias("violated_properties"), names(False).alias("satisfied_properties"))


def evaluate_contracts(events: DataFrame, precondition: str, postcondition: str, scope: list[str], key: str = "agent_id") -> DataFrame:
    """key, precondition_met, postcondition_met, in_scope: postconditions count only where preconditions hold."""
    pre = F.bool_or(F.col("action") == precondition)
    agg = events.groupBy(key).agg(pre.alias("precondition_met"), F.bool_or(F.col("action") == postcondition).alias("post"), F.bool_and(F.col("action").isin(scope)).alias("in_scope"))
    return agg.select(key, "precondition_met", F.when(F.col("precondition_met"), F.col("post")).alias("postcondition_met"), "in_scope")


# What agents of each type are expected to do, and the actions that clauses look for.
EXPECTED_ACTIONS = {
    "coding": ("load_context", "get_project_context", "read_file", "file_edit", "write_file", "test_run", "record_decision", "decision", "task_start", "task_end"),
    "review": ("load_context", "get_project_context", "read_file", "comment", "approve", "request_changes", "task_start", "task_end"),
}
LOADS_CONTEXT, EDITS, DECIDES, SCOPES = ("load_context", "get_project_context"), ("file_edit", "write_file"), ("record_decision", "decision"), ("task_start", "load_context")


@dataclass(frozen=True)
class Clause:
    """A clause of a contract: a Boolean aggregate over one agent's events, true where it holds."""

    name: str
    kind: str  # precondition, postcondition or invariant
    holds: Column


def default_clauses() -> dict[str, tuple[Clause, ...]]:
    """The clauses of each agent type; `outside` marks edits of files beyond the agent's scope."""
    context = Clause("loaded_context", "precondition", F.bool_or(F.col("action").isin(*LOADS_CONTEXT)))
    edited = F.bool_or(F.col("action").isin(*EDITS) & F.col("target").isNotNull())
    decided = F.bool_or(F.col("action").isin(*DECIDES) & F.col("target").isNotNull())
    return {"coding": (context, Clause("decisions_recorded", "postcondition", ~edited | decided), Clause("scope_respected", "invariant", ~F.bool_or("outside"))), "review": (context,)}


def contract_breaches(events: DataFrame, contracts: dict[str, tuple[Clause, ...]] | None = None, expected: dict[str, tuple[str, ...]] | None = None, key: str = "agent_id", warning: float = 0.3, stop: float = 0.7) -> DataFrame:
    """key, clause, clause_type, severity, drift: the clauses that each agent's events break, and its drift.

    events: key, agent_type, action, target, scope (array, on events that set one). Postconditions count only where all
    preconditions hold. Preconditions and invariants are errors, postconditions warnings; a drift of warning and more
    is a warning, of stop and more a hard_stop. An agent without a scope is never outside it.
    """
    contracts, expected = contracts or default_clauses(), expected or EXPECTED_ACTIONS
    scopes = events.filter(F.col("action").isin(*SCOPES) & (F.size("scope") > 0)).select(key, F.explode("scope").alias("target")).distinct()
    scoped = scopes.select(key).distinct().withColumn("_scoped", F.lit(True))
    inside = scopes.withColumn("_inside", F.lit(True))
    known = events.join(scoped, key, "left").join(inside, [key, "target"], "left")
    edit = F.col("action").isin(*EDITS) & (F.coalesce("target", F.lit("")) != "")
    known = known.withColumn("outside", F.coalesce(edit & F.col("_scoped") & F.col("_inside").isNull(), F.lit(False)))
    severity = {"precondition": "error", "postcondition": "warning", "invariant": "error"}
    parts = []
    for kind, clauses in contracts.items():
        unexpected = (~F.col("action").isin(*expected.get(kind, ()))).cast("double")
        held = [F.coalesce(c.holds, F.lit(False)).alias(f"c{n}") for n, c in enumerate(clauses)]
        per = known.filter(F.col("agent_type") == kind).groupBy(key).agg(*held, (1.0 - F.exp(-3.0 * F.avg(unexpected))).alias("d"))
        met = F.lit(True)
        for n, c in enumerate(clauses):
            met = met & F.col(f"c{n}") if c.kind == "precondition" else met

        def breach(name: str, clause_type: str, grade: str) -> Column:
            return F.struct(F.lit(name).alias("clause"), F.lit(clause_type).alias("clause_type"), F.lit(grade).alias("severity"))

        broken = [F.when(~F.col(f"c{n}") & (met if c.kind == "postcondition" else F.lit(True)), breach(c.name, c.kind, severity[c.kind])) for n, c in enumerate(clauses)]
        drift = F.when(F.col("d") >= stop, breach("drift_limit", "drift", "hard_stop")).when(F.col("d") >= warning, breach("drift_warning", "drift", "warning"))
        parts.append(per.select(key, F.round("d", 6).alias("drift"), F.explode(F.array_compact(F.array(*broken, drift))).alias("b")).select(key, "b.*", "drift"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drift_score(events: DataFrame, expected: list[str], key: str = "agent_id") -> DataFrame:
    """key, ratio of unexpected actions, drift = 1 - exp(-3 ratio), band: 0.3 warning, 0.7 stop."""
    ratio = events.groupBy(key).agg(F.avg((~F.col("action").isin(expected)).cast("double")).alias("r"))
    drift = F.round(1.0 - F.exp(-3.0 * F.col("r")), 6)
    out = ratio.select(key, F.round("r", 6).alias("ratio"), drift.alias("drift"))
    return out.withColumn("band", F.when(F.col("drift") >= 0.7, "stop").when(F.col("drift") >= 0.3, "warning").otherwise("ok"))


def scope_drift(events: DataFrame, scope: DataFrame, limit: float = 0.5, key: str = "agent_id") -> DataFrame:
    """key, targets, outside, drifted: the share of distinct targets outside the expected ones (key, target)."""
    seen = events.select(key, "target").distinct().join(scope.withColumn("inside", F.lit(1)), [key, "target"], "left")
    agg = seen.groupBy(key).agg(F.count("*").alias("targets"), F.count(F.when(F.col("inside").isNull(), 1)).alias("outside"))
    return agg.withColumn("drifted", F.col("outside") / F.col("targets") > limit)


def word_overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct lower-case words that are among b's."""
    words = [F.array_remove(F.array_distinct(F.split(F.lower(x), r"\s+")), "") for x in (a, b)]
    return F.try_divide(F.size(F.array_intersect(*words)), F.size(words[0]))


def intent_drift(tasks: DataFrame, actions: DataFrame, threshold: float = 0.2) -> DataFrame:
    """agent_id, overlap, drifted: the share of a task's words (agent_id, task) that the agent's actions (agent_id, action) name.

    Words go by blanks, in lower case; an agent drifts below the threshold. Agents without a task's words or without
    actions are left out. Words are aggregated before they meet, so a busy agent sends each word once a partition.
    """
    def words(col: str) -> Column:
        return F.explode(F.array_distinct(F.filter(F.split(F.lower(col), r"\s+"), lambda w: w != "")))

    wanted = tasks.select("agent_id", words("task").alias("word")).distinct()
    done = actions.select("agent_id", words("action").alias("word")).distinct()
    met = wanted.join(done.withColumn("named", F.lit(1)), ["agent_id", "word"], "left").groupBy("agent_id").agg(F.count("*").alias("n"), F.count("named").alias("hit"))
    overlap = F.col("hit") / F.col("n")
    acting = actions.select("agent_id").distinct()
    return met.join(acting, "agent_id", "left_semi").select("agent_id", F.round(overlap, 6).alias("overlap"), (overlap < threshold).alias("drifted"))


def path_words(path: Column) -> Column:
    return F.translate(path, "/_-.", "    ")


def priority_score(decisions: DataFrame, as_of: Column, violations: Column | None = None) -> DataFrame:
    """id, project, score = severity x recency x (1 + ln(1 + violations)) x confidence, for active decisions.

    recency = 1 / (1 + ln(age in days, at least 1)).
    """
    severity = F.lit(0.5)
    for name, value in SEVERITY_BY_TYPE.items():
        severity = F.when(F.col("decision_type") == name, value).otherwise(severity)
    days = F.greatest(F.lit(1.0), (F.unix_micros(as_of) - F.unix_micros("created_at")) / F.lit(86400e6))
    boost = 1.0 + F.log(1.0 + (violations if violations is not None else F.lit(0)))
    score = severity * (1.0 / (1.0 + F.log(days))) * boost * F.col("confidence")
    return decisions.filter("status = 'active'").select("id", "project", F.round(score, 6).alias("score"))


def assign_tiers(scored: DataFrame, with_globs: DataFrame, always: int = 15, auto: int = 50) -> DataFrame:
    """id, project, score, rank, tier: per project the first always, the next auto if they have globs, else on-demand."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "id")))
    has = with_globs.select("id").distinct().withColumn("globs", F.lit(True))
    tier = F.when(F.col("rank") <= always, "always").when((F.col("rank") <= always + auto) & F.col("globs"), "auto").otherwise("on-demand")
    return ranked.join(has, "id", "left").select("id", "project", "score", "rank", tier.alias("tier"))


#: Contradictions that stand in a backlog.
OPEN = "status = 'unresolved' and not is_baseline and verdict <> 'compatible'"


def backlog(contradictions: DataFrame, affected: DataFrame | None, as_of: Column, max_age_days: float = 90) -> DataFrame:
    """id, project, priority, rank: open contradictions and tensions by 0.3 confidence + 0.25 impact + 0.25 age + 0.2 severity.

    affected: id, affected; None if contradictions have that column.
    """
    open_ = contradictions.filter(OPEN)
    open_ = open_ if affected is None else open_.join(affected, "id")
    days = (F.unix_micros(as_of) - F.unix_micros("detected_at")) / F.lit(86400e6)
    impact, age = F.least(F.lit(1.0), F.col("affected") / 5.0), F.least(F.lit(1.0), days / max_age_days)
    severity = F.when(F.col("verdict") == "contradiction", 1.0).otherwise(0.5)
    scored = open_.select("id", "project", F.round(0.3 * F.col("confidence") + 0.25 * impact + 0.25 * age + 0.2 * severity, 6).alias("priority"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("priority"), "id")))


def to_intervals(decisions: DataFrame) -> DataFrame:
    """id, project, valid_from, valid_until: a decision's interval closes when its first successor starts."""
    later = decisions.filter("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.min("created_at").alias("valid_until"))
    return decisions.join(later, "id", "left").select("id", "project", F.col("created_at").alias("valid_from"), "valid_until")


def dimension_history(intervals: DataFrame, bridge: DataFrame) -> DataFrame:
    """project, dimension, id, version: decisions of a dimension numbered from the oldest."""
    order = Window.partitionBy("project", "dimension").orderBy("valid_from", "id")
    return intervals.join(bridge.select("id", "dimension"), "id").select("project", "dimension", "id", F.row_number().over(order).alias("version"))


def page(df: DataFrame, limit: int, offset: int, newest: str, unique: str) -> DataFrame:
    """One page of rows, newest first with a unique last key, and the total beside each."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(F.desc(newest), F.desc(unique)).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total))

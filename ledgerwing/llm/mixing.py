"""Mixing sources to target weights: budgets flow down a domain-language-source tree, leaves give token prefixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.llm.storage import materialize, unused

LEVELS = ("domain", "lang", "source")
UNKNOWN = "unknown"
#: Ranges of an epoch's order in which tokens are summed before any row is ranked.
RANGE_DIGITS = 3


@dataclass(frozen=True)
class Mixture:
    """Whole-number weights of the tree's nodes, by name at each level; a name that is not listed weighs 1, 0 leaves out.

    budget = tokens available * budget_parts / budget_of, rounded down. A leaf gives its documents at most
    max_epochs times over.
    """

    domain_weights: tuple[tuple[str, int], ...]
    lang_weights: tuple[tuple[str, int], ...]
    source_weights: tuple[tuple[str, int], ...] = ()
    budget_parts: int = 1
    budget_of: int = 2
    max_epochs: int = 1
    seed: str = "mix"


def domain_of(source: Column) -> Column:
    """A stand-in for a domain table: the domain by the first hex digit of the source's MD5."""
    digit = F.substring(F.md5(source.cast("binary")), 1, 1)
    return F.when(digit < "6", "web").when(digit < "b", "books").otherwise("code")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def leaves_of(docs: DataFrame) -> list[Column]:
    """The leaf that each document belongs to; a null language or source counts as `unknown`."""
    source = F.coalesce(F.col("source"), F.lit(UNKNOWN))
    return [domain_of(source).alias("domain"), F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), source.alias("source")]


def _weight(name: Column, weights: tuple[tuple[str, int], ...]) -> Column:
    out = F.lit(1)
    for known, weight in reversed(weights):
        out = F.when(name == known, weight).otherwise(out)
    return out.cast("long")


def water_fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (parent columns, name, weight, room, given) with budget: given shared out by weight, none over its room.

    A node that cannot take its share takes its room, and what it leaves goes to its siblings by weight. Sorted by
    room per weight, the full nodes come first: a node is full if its room per weight is at most what remains per
    remaining weight. Shares are rounded down, so less than one token a node may stay unplaced. A node of weight 0
    has no room and gets nothing.
    """
    nodes = nodes.withColumn("room", F.when(F.col("weight") > 0, F.col("room")).otherwise(0))
    by_room = Window.partitionBy(*parent).orderBy(F.col("room") / F.greatest("weight", F.lit(1)), "name")
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    later = by_room.rowsBetween(0, Window.unboundedFollowing)
    ranked = nodes.select(
        "*",
        F.coalesce(F.sum("room").over(earlier), F.lit(0)).alias("_taken"),
        F.sum("weight").over(later).alias("_weights"),
        F.row_number().over(by_room).alias("_at"),
    ).withColumn("_full", F.expr("room * _weights <= (given - _taken) * weight"))
    # the full nodes are a prefix; what they leave is shared by the others
    first_open = Window.partitionBy(*parent)
    ranked = ranked.withColumn("_open", F.min(F.when(~F.col("_full"), F.col("_at"))).over(first_open))
    ranked = ranked.withColumn("_left", F.max(F.when(F.col("_at") == F.col("_open"), F.col("given") - F.col("_taken"))).over(first_open))
    ranked = ranked.withColumn("_of", F.max(F.when(F.col("_at") == F.col("_open"), F.col("_weights"))).over(first_open))
    budget = F.when(F.col("_open").isNull() | (F.col("_at") < F.col("_open")), F.col("room")).otherwise(F.expr("(_left * weight) div _of"))
    return ranked.withColumn("budget", budget).drop("_taken", "_weights", "_at", "_full", "_open", "_left", "_of")


def leaf_budgets(leaf_tokens: DataFrame, mixture: Mixture) -> DataFrame:
    """Budget of each leaf (domain, lang, source, tokens): filled level by level from the root.

    A node's room is what all leaves below it can give, so a shortage is made up by siblings first, and only what a
    whole subtree lacks reaches the siblings of its root.
    """
    weights = (mixture.domain_weights, mixture.lang_weights, mixture.source_weights)
    left_out = F.lit(False)
    for level, names in zip(LEVELS, weights, strict=True):
        left_out = left_out | (_weight(F.col(level), names) <= 0)
    room = leaf_tokens.withColumn("room", F.when(left_out, 0).otherwise(F.col("tokens") * mixture.max_epochs))
    total = (leaf_tokens.agg(F.sum("tokens")).first()[0] or 0) * mixture.budget_parts // mixture.budget_of
    given, parent = None, []
    for level, names in zip(LEVELS, weights, strict=True):
        keys = [*parent, level]
        nodes = room.groupBy(*keys).agg(F.sum("room").alias("room"))
        nodes = nodes.join(given, parent) if parent else nodes.withColumn("given", F.lit(total).cast("long"))
        nodes = nodes.select(*keys, F.col(level).alias("name"), _weight(F.col(level), names).alias("weight"), "room", "given")
        given = water_fill(nodes, parent or [F.lit(0)]).select(*keys, F.col("budget").alias("given"))
        parent = keys
    return given.withColumnRenamed("given", "budget").join(leaf_tokens, list(LEVELS))


def epoch_key(mixture: Mixture, epoch: Column) -> Column:
    """Where a document stands in an epoch of its leaf: an MD5 of seed, epoch and doc_id."""
    name = F.concat_ws("-", F.lit(mixture.seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.md5(name.cast("binary"))


def plan(docs: DataFrame, mixture: Mixture, tokens: Column | None = None) -> DataFrame:
    """What each leaf gives: domain, lang, source, tokens, budget, epochs (whole ones) and cut.

    cut is the key of the document in which the leaf's budget ends, in the epoch after the whole ones; null if the
    budget ends with a whole epoch. Rows are ranked only inside the one range of keys in which the budget ends, so
    no task sorts a whole leaf.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaves_of(docs), (tokens if tokens is not None else token_count(F.col("text"))).alias("n_tokens")), "mix-tokens")
    return _plan(rows, mixture)


def _plan(rows: DataFrame, mixture: Mixture) -> DataFrame:
    leaf = list(LEVELS)
    leaf_tokens = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    budgets = materialize(
        leaf_budgets(leaf_tokens, mixture).withColumn("epochs", F.expr("cast(budget div tokens as int)")).withColumn("need", F.expr("budget % tokens")),
        "mix-budgets",
    )
    keyed = rows.filter("n_tokens > 0").join(budgets.filter("need > 0"), leaf).select(*leaf, "need", "n_tokens", epoch_key(mixture, F.col("epochs")).alias("key"))
    keyed = keyed.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = keyed.groupBy(*leaf, "need", "range").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = sums.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0))).filter("before < need and need <= before + t").select(*leaf, "range", "before")
    inside = Window.partitionBy(*leaf).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = keyed.join(last, [*leaf, "range"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).filter("upto >= need")
    return budgets.join(cuts.groupBy(*leaf).agg(F.min("key").alias("cut")), leaf, "left").drop("need")


def mixed(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens: one row for each time that a document is taken.

    Epoch by epoch a leaf's documents follow in the order of epoch_key, up to and with the one in which the leaf's
    budget ends. Texts without a token are never taken. Repeated rows share a key and are taken together; a null
    doc_id counts as the empty text. An empty table gives no rows.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaves_of(docs), token_count(F.col("text")).alias("n_tokens")), "mix-tokens")
    planned = _plan(rows, mixture).select(*LEVELS, "epochs", "cut")
    taken = rows.filter("n_tokens > 0").join(planned, list(LEVELS))
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    in_last = F.col("cut").isNotNull() & (epoch_key(mixture, F.col("epochs")) <= F.col("cut"))
    return taken.filter((F.col("epoch") < F.col("epochs")) | in_last).select("doc_id", *LEVELS, "epoch", "n_tokens")


def select_documents(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The documents that a mixture of one epoch takes, with all their columns.

    The plan holds one row a leaf, so texts meet it by a join on the leaf and are never shuffled by id.
    """
    mine = {c: unused(docs.columns, f"_mix_{c}") for c in (*LEVELS, "epochs", "cut")}
    planned = plan(docs, mixture).select(*[F.col(c).alias(name) for c, name in mine.items()])
    leaf = leaves_of(docs)
    on = [leaf[k] == F.col(mine[c]) for k, c in enumerate(LEVELS)]
    key = epoch_key(mixture, F.col(mine["epochs"]))
    joined = docs.join(planned, on).filter((F.col(mine["epochs"]) > 0) | (key <= F.col(mine["cut"])))
    return joined.filter(F.coalesce(F.regexp_instr("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) > 0).select(*docs.columns)


#: The production mixture of the registered query: half of all tokens, scarce leaves up to twice over.
CORPUS_MIXTURE = Mixture(
    domain_weights=(("web", 5), ("books", 3), ("code", 2)),
    lang_weights=(("en", 6), ("fr", 2), ("de", 2)),
    budget_parts=6,
    budget_of=10,
    max_epochs=2,
)
#: The pipeline follows deduplication, so it repeats nothing.
PIPELINE_MIXTURE = Mixture(CORPUS_MIXTURE.domain_weights, CORPUS_MIXTURE.lang_weights, budget_parts=7, budget_of=10, max_epochs=1)


def _case(column: str, weights: tuple[tuple[str, int], ...]) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{n}' THEN {w}" for n, w in weights)} ELSE 1 END" if weights else "1"


def oracle_sql(mixture: Mixture, table: str = "documents") -> str:
    """DuckDB SQL for mixed(): the shares by searching each parent's fill level among its nodes, the prefix by one sum."""
    parts, parent, given = [], [], "SELECT CAST(sum(tokens) * {p} // {o} AS BIGINT) AS given FROM leaf".format(p=mixture.budget_parts, o=mixture.budget_of)
    parts.append(f"level0 AS ({given})")
    for k, (level, weights) in enumerate(zip(LEVELS, (mixture.domain_weights, mixture.lang_weights, mixture.source_weights), strict=True)):
        keys = [*parent, level]
        same = " AND ".join(["1 = 1", *[f"s.{c} = n.{c}" for c in parent]])
        by = f"USING ({', '.join(parent)})" if parent else "ON 1 = 1"
        parts.append(
            f"node{k} AS (SELECT r.*, p.given FROM (SELECT {', '.join(keys)}, {_case(level, weights)} AS weight, CAST(sum(give) * {mixture.max_epochs} AS BIGINT) AS room FROM leaf GROUP BY {', '.join(keys)}) r JOIN level{k} p {by})"
        )
        # a node is full if the rooms of all nodes no roomier per weight, and its share beside the others, fit
        parts.append(
            f"fill{k} AS (SELECT n.*, n.room * (SELECT sum(s.weight) FROM node{k} s WHERE {same} AND s.room * n.weight >= n.room * s.weight)"
            f" <= (n.given - (SELECT coalesce(sum(s.room), 0) FROM node{k} s WHERE {same} AND s.room * n.weight < n.room * s.weight)) * n.weight AS is_full FROM node{k} n)"
        )
        parts.append(
            f"level{k + 1} AS (SELECT {', '.join('n.' + c for c in keys)}, CAST(CASE WHEN n.is_full THEN n.room ELSE"
            f" (n.given - (SELECT coalesce(sum(s.room), 0) FROM fill{k} s WHERE {same} AND s.is_full)) * n.weight // (SELECT sum(s.weight) FROM fill{k} s WHERE {same} AND NOT s.is_full) END AS BIGINT) AS given FROM fill{k} n)"
        )
        parent = keys
    leaf = ", ".join(LEVELS)
    gives = " AND ".join(f"{_case(level, weights)} > 0" for level, weights in zip(LEVELS, (mixture.domain_weights, mixture.lang_weights, mixture.source_weights), strict=True))
    return f"""
WITH raw AS (
  SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens
  FROM {table}
), doc AS (
  SELECT doc_id, CASE WHEN md5(source)[1] < '6' THEN 'web' WHEN md5(source)[1] < 'b' THEN 'books' ELSE 'code' END AS domain,
         lang, source, CAST(n_tokens AS BIGINT) AS n_tokens
  FROM raw WHERE n_tokens > 0
), leaf AS (SELECT {leaf}, CAST(sum(n_tokens) AS BIGINT) AS tokens, CASE WHEN {gives} THEN CAST(sum(n_tokens) AS BIGINT) ELSE 0 END AS give FROM doc GROUP BY {leaf}),
{', '.join(parts)},
budget AS (SELECT {leaf}, given // tokens AS epochs, given % tokens AS need FROM level3 JOIN leaf USING ({leaf})),
keyed AS (
  SELECT d.*, epochs, need, md5(concat_ws('-', '{mixture.seed}', CAST(epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
  FROM doc d JOIN budget USING ({leaf})
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY key RANGE UNBOUNDED PRECEDING)
            - sum(n_tokens) OVER (PARTITION BY {leaf}, key) AS before FROM keyed
)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens
FROM (SELECT *, unnest(range(CAST(epochs + CASE WHEN before < need THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM placed)
"""

"""Repair of conversation structure: the cheapest edits, by a dynamic program with square-root checkpoints.

A conversation's roles must read as an optional system turn, then user and assistant in turns. The program runs over
four states (what the repaired conversation ended with so far). Backward cost vectors are kept only where blocks end;
block k of a part of a conversation has k times BLOCK rows, so a conversation of n rows has about the root of n
checkpoints and its longest block about as many rows. Every block is recomputed while the edits are walked forward.
A block's costs are a four by four table (smallest sums), so the blocks of one long conversation are worked by many tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwing.llm.storage import id_text, materialize, shuffle_width
from ledgerwing.llm.worker import lean

#: Rows that the first block of a part has; the second has twice as many, the third three times.
BLOCK = 64
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn, and its role: in each state only one role may follow so.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept turn, by state and place of its initial in INITIALS.
INITIALS = "sua"
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
OTHER = 3
#: A row's code is the place of its initial plus four times its fault.
SOUND, SHORT, BLANK, DUPLICATE = range(4)
FAR = 1 << 40
BREAKS = " \t\n\x0b\x0c\r"

Costs = tuple[int, ...]


def with_inserts(costs: list[int]) -> Costs:
    """Costs where turns may be inserted first; two at most are of use, a third leads back to an earlier state."""
    out = []
    for s in range(4):
        one = NEXT[s]
        out.append(min(costs[s], costs[one] + INSERT, costs[NEXT[one]] + 2 * INSERT))
    return tuple(FAR if c >= FAR // 2 else c for c in out)


#: Costs behind the last row: an empty conversation and one that ends with the assistant are done.
END = with_inserts([0, FAR, FAR, 0])
UNITS = tuple(tuple(0 if s == t else FAR for s in range(4)) for t in range(4))


@functools.lru_cache(1 << 16)
def before(code: int, after: Costs) -> Costs:
    """Costs before a row from those after it."""
    fault, initial = code >> 2, code & 3
    extra = TRUNCATED if fault == SHORT else 0
    costs = []
    for s in range(4):
        best = after[s] + DELETE
        if fault < BLANK:
            best = min(best, after[NEXT[s]] + REROLE + extra)
            kept = KEPT.get((s, initial))
            if kept is not None:
                best = min(best, after[kept] + extra)
        costs.append(best)
    return with_inserts(costs)


@functools.lru_cache(1 << 16)
def lowered(costs: Costs) -> tuple[Costs, int]:
    """Costs less their least one, of which there are few different ones, and that least one."""
    least = min(costs)
    return tuple(c if c >= FAR else c - least for c in costs), least


def backward(codes: bytes, after: Costs, keep: bool = False) -> tuple[Costs, list[Costs]]:
    """Costs before a block from those after it; with keep also the lowered costs after each of its rows."""
    costs, total = lowered(after)
    kept: list[Costs] = []
    for code in reversed(codes):
        if keep:
            kept.append(costs)
        costs, least = lowered(before(code, costs))
        total += least
    return tuple(c if c >= FAR else c + total for c in costs), kept[::-1]


@functools.lru_cache(1 << 16)
def moves(code: int, after: Costs, state: int) -> tuple[str, int]:
    """The ASCII-least tight edits up to and with a row's own, and the state after it."""
    here, fault = before(code, after), code >> 2
    extra = TRUNCATED if fault == SHORT else 0
    letters = ""
    while True:
        if after[state] + DELETE == here[state]:
            return letters + "D", state
        if here[NEXT[state]] + INSERT == here[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        kept = KEPT.get((state, code & 3)) if fault < BLANK else None
        if kept is not None and after[kept] + extra == here[state]:
            return letters + "K", kept
        return letters + "R", NEXT[state]


def forward(codes: bytes, after: Costs, state: int) -> tuple[list[str], int]:
    """The edits at each row of a block, and the state at its end; the block's costs are recomputed first."""
    _, kept = backward(codes, after, keep=True)
    out = []
    for code, costs in zip(codes, kept, strict=True):
        letters, state = moves(code, costs, state)
        out.append(letters)
    return out, state


def closing(state: int) -> str:
    """Turns to insert behind the last row."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows that damage leaves, by CRC-32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 takes full stops, exclamation and question marks out of it, 3 repeats it,
    4 makes it the user's. A null counts as one space, but turn stays null.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return conversations.filter(hit != 0).select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def with_columns_of(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on equal columns of these names, where a null equals a null."""
    right = b.select(*[F.col(n).alias(f"other_{n}") if n in names else F.col(n) for n in b.columns])
    on = functools.reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"other_{n}")) for n in names])
    return a.join(right, on, how).drop(*[f"other_{n}" for n in names])


def text_digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def row_codes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, times, code, more: equal rows of a turn once, without their texts.

    code is that of the first of the equal rows, more that of each further one. Faults: a blank text; a role and text
    that an earlier row has; a text that does not end in a full stop, exclamation or question mark. Pre-aggregation
    makes one row of however many equal ones, and the first turn of a role and text comes from an aggregate.
    """
    ended = F.rtrim("text", F.lit(BREAKS))
    keyed = rows.select(
        "conv_id", "turn", "role", text_digest().alias("digest"), "copies", (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("short")
    )
    counted = keyed.groupBy("conv_id", "turn", "role", "digest", "blank", "short").agg(F.sum("copies").alias("times"))
    firsts = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    both = with_columns_of(counted, firsts, ["conv_id", "role", "digest"])
    place = F.substring("role", 1, 1)
    initial = F.when(place == "s", 0).when(place == "u", 1).when(place == "a", 2).otherwise(OTHER)
    fault = F.when(F.col("blank"), BLANK).when(~F.col("first.turn").eqNullSafe(F.col("turn")), DUPLICATE).when(F.col("short"), SHORT).otherwise(SOUND)
    more = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    return both.select("conv_id", "turn", "role", "digest", "times", (initial + 4 * fault).alias("code"), (initial + 4 * more).alias("more"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks of codes; a block lies in one conversation and one partition."""
    part, seq, size = TaskContext.get().partitionId(), 0, BLOCK
    owner: object = _blocks  # no conversation yet
    codes, at, turns, roles, digests = bytearray(), [], [], [], []
    fields: dict[str, pa.DataType] = {}

    def block() -> pa.RecordBatch:
        costs = [c for unit in UNITS for c in backward(bytes(codes), unit)[0]]
        illegal = sum((a & 3, b & 3) not in LEGAL_PAIRS for a, b in zip(codes, codes[1:], strict=False))
        values = [owner, part, seq, bytes(codes), at, turns, roles, digests, costs, illegal]
        types = [fields["conv_id"], pa.int32(), pa.int64(), pa.binary(), *map(pa.list_, (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64())), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=BLOCK_COLUMNS)

    for batch in batches:
        fields = {f.name: f.type for f in batch.schema}
        for conv, turn, role, digest, times, code, more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if conv != owner or owner is _blocks:
                if codes:
                    yield block()
                    seq += 1
                owner, size = conv, BLOCK
                codes, at, turns, roles, digests = bytearray(), [], [], [], []
            first = True
            while times:
                if len(codes) == size:
                    yield block()
                    seq, size = seq + 1, size + BLOCK
                    codes, at, turns, roles, digests = bytearray(), [], [], [], []
                if first:
                    at.append(len(codes))
                    turns.append(turn)
                    roles.append(role)
                    digests.append(digest)
                    codes.append(code)
                    times, first = times - 1, False
                else:
                    taken = min(times, size - len(codes))
                    codes += bytes([more]) * taken
                    times -= taken
    if codes:
        yield block()


BLOCK_COLUMNS = ["conv_id", "part", "seq", "codes", "at", "turns", "roles", "digests", "costs", "illegal"]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its blocks in order (part, seq, costs, first, last, illegal): the costs after each, and totals."""
    for batch in batches:
        rows = []
        for conv, blocks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            after, illegal, following, own = END, 0, None, []
            for b in reversed(blocks):
                illegal += b["illegal"] + (following is not None and (b["last"], following) not in LEGAL_PAIRS)
                following = b["first"]
                own.append((b["part"], b["seq"], list(after)))
                table = [b["costs"][4 * t : 4 * t + 4] for t in range(4)]
                after = tuple(min(FAR, *[table[t][s] + after[t] for t in range(4)]) for s in range(4))
            rows += [(conv, part, seq, costs, after[START], illegal) for part, seq, costs in own]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [batch.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "part", "seq", "after", "cost", "illegal"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and each state that it may begin in: the edits at its rows, and the state at its end."""
    for batch in batches:
        pieces, exits = [], []
        for codes, after in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist(), strict=True):
            walks = [forward(codes, tuple(after), s) for s in range(4)]
            pieces.append([" ".join(letters) for letters, _ in walks])
            exits.append([state for _, state in walks])
        keep = [n for n in batch.schema.names if n not in ("codes", "after")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in keep], pa.array(pieces, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], names=[*keep, "pieces", "exits"]
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its blocks in order (part, seq, exits): the state that each begins in, and what closes it."""
    for batch in batches:
        rows = []
        for blocks in batch.column("blocks").to_pylist():
            state = START
            for k, b in enumerate(blocks):
                begun, state = state, b["exits"][state]
                rows.append((b["part"], b["seq"], begun, closing(state) if k == len(blocks) - 1 else ""))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["part", "seq", "begun", "closed"])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that a block leaves or inserts, in order: n counts its edits, digest names a kept text."""
    for batch in batches:
        out: list[tuple] = []
        names = ["conv_id", "part", "seq", "at", "turns", "roles", "digests", "letters", "begun", "closed"]
        for conv, part, seq, at, turns, roles, digests, letters, state, closed in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            rows = dict(zip(at, zip(turns, roles, digests, strict=True), strict=True))
            n = 0
            for place, edits in enumerate([*letters.split(" "), closed]):
                for edit in edits:
                    if edit == "I":
                        state = NEXT[state]
                        out.append((conv, part, seq, n, edit, ROLE_OF[state], None, None, None))
                    elif edit in "KR":
                        turn, role, digest = rows[place]
                        state = NEXT[state] if edit == "R" else KEPT[state, INITIALS.index(role[0])]
                        out.append((conv, part, seq, n, edit, ROLE_OF[state] if edit == "R" else role, turn, role, digest))
                    n += 1
        types = [batch.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "part", "seq", "n", "edit", "role", "turn", "old_role", "digest"])


@dataclass
class Repaired:
    """turns: conv_id, part, seq, n (their order), edit (Keep, Rerole, Insert), role, turn, text of each turn that stays or
    comes in. audits: conv_id, audit (the initials of all edits), cost, illegal of each conversation that has rows.
    codes: the rows with their faults."""

    turns: DataFrame
    audits: DataFrame
    codes: DataFrame


def repair(rows: DataFrame) -> Repaired:
    """The cheapest edits that make every conversation regular; of equally cheap ones the ASCII-least by initials.

    rows: conv_id (any type, null is a conversation too), turn, role, text, copies (how often a row comes); no null role or
    text. Rows go by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text. Keep costs 0, Rerole
    and Insert 2, Delete 3; a row that stays truncated costs 1 more; blank rows and duplicates must go. No rows, no
    conversations: both tables are empty. Long conversations are split over tasks by ranges of the order, and equal
    rows travel once, so neither a conversation nor a text that holds a third of all rows meets in one task.
    """
    spark = rows.sparkSession
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    codes = materialize(row_codes(rows), "repair-codes")
    order = ["conv_id", "turn", "role", "digest"]
    ordered = codes.select(*order, "times", "code", "more").repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    block_schema = f"conv_id {conv_type}, part int, seq long, codes binary, at array<int>, turns array<long>, roles array<string>, digests array<binary>, costs array<long>, illegal long"
    blocks = materialize(ordered.mapInArrow(lean(_blocks), block_schema), "repair-blocks", 10_000)

    initial = [(F.ascii(F.substring("codes", i, 1)) % 4).cast("int").alias(n) for i, n in ((1, "first"), (-1, "last"))]
    summary = blocks.select("conv_id", "part", "seq", "costs", "illegal", *initial)
    per = summary.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "costs", "illegal", "first", "last"))).alias("blocks"))
    chained = per.mapInArrow(_chained, f"conv_id {conv_type}, part int, seq long, after array<long>, cost long, illegal long")
    chained = materialize(chained, "repair-chained")

    work = blocks.drop("costs", "illegal").join(chained.select("part", "seq", "after"), ["part", "seq"])
    walk_schema = f"part int, seq long, conv_id {conv_type}, at array<int>, turns array<long>, roles array<string>, digests array<binary>, pieces array<string>, exits array<int>"
    walked = materialize(work.mapInArrow(lean(_walked), walk_schema), "repair-walked", 100)

    ends = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "exits"))).alias("blocks"))
    entries = ends.mapInArrow(_entries, "part int, seq long, begun int, closed string")
    letters = F.element_at("pieces", F.col("begun") + 1)
    chosen = walked.join(entries, ["part", "seq"]).select("conv_id", "part", "seq", "at", "turns", "roles", "digests", letters.alias("letters"), "begun", "closed")
    chosen = materialize(chosen, "repair-chosen")

    piece = F.concat(F.replace(F.col("letters"), F.lit(" "), F.lit("")), F.col("closed"))
    audit = chosen.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", piece.alias("p")))).alias("ps"))
    audit = audit.select("conv_id", F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("audit"))
    totals = chained.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    audits = with_columns_of(audit, totals, ["conv_id"])

    turn_schema = f"conv_id {conv_type}, part int, seq long, n long, edit string, role string, turn long, old_role string, digest binary"
    turns = chosen.mapInArrow(_turns, turn_schema)
    keys = ["conv_id", "turn", "old_role", "digest"]
    old = rows.select("conv_id", "turn", F.col("role").alias("old_role"), text_digest().alias("digest"), "text")
    kept = turns.filter("digest is not null")
    texts = with_columns_of(kept, old, keys).dropDuplicates(keys)
    columns = ["conv_id", "part", "seq", "n", "edit", "role", "turn", "text"]
    inserted = turns.filter("digest is null").withColumn("text", F.lit(""))
    return Repaired(texts.select(*columns).unionByName(inserted.select(*columns)), audits, codes)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's `role:text` lines; only the running hash is held, not the texts."""
    owner: object = _hashed
    running = hashlib.sha256()

    def row(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([owner], kind), pa.array([running.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "role", "text")], strict=True):
            if conv != owner or owner is _hashed:
                if owner is not _hashed:
                    yield row(kind)
                owner, running = conv, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
    if owner is not _hashed:
        yield row(kind)


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage.

    Every conv_id of the input has a row, null too; one without rows after damage has zeros, no edits and the hash of
    nothing. The SHA-256 of one conversation can only run in order, so its lines stream through one task, which holds none of them.
    """
    found = repair(damaged(conversations))
    fault = F.shiftright("code", 2)
    further = F.shiftright("more", 2)
    per = found.codes.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.sum((fault == f).cast("long") + (further == f).cast("long") * (F.col("times") - 1)).alias(n) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", SHORT))],
    )
    lines = found.turns.repartition(id_text(F.col("conv_id"))).sortWithinPartitions("conv_id", "part", "seq", "n").select("conv_id", "role", "text")
    hashes = lines.mapInArrow(lean(_hashed), f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    every = conversations.select("conv_id").distinct()
    out = functools.reduce(lambda a, b: with_columns_of(a, b, ["conv_id"], "left"), [per, found.audits, hashes], every)
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

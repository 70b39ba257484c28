"""Conversation repair against a plain recursion over all edits, and the ranked search and packing against plain forms."""

from __future__ import annotations

import collections
import functools
import hashlib
import random
import re
import zlib

import pytest

from ledgerwing.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, n int"


def conversations(seed: int = 3) -> list[tuple]:
    """Rows with nulls in every column, ties, repeated rows, empty texts, and one long conversation."""
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "assistant"]
    texts = ["Yes.", "No!", "well", "", "  \t", "a? ", "Fine.\n", None, "ça va.", "x" * 3000 + "."]
    out = []
    for conv in range(60):
        regular = rng.random() < 0.5
        for turn in range(rng.randrange(1, 9)):
            role = ("user", "assistant")[turn % 2] if regular else rng.choice(roles)
            out.append((conv, turn if rng.random() < 0.9 else None, role, f"t{turn}." if regular else rng.choice(texts), 7))
    out += [(None, 0, "user", "hm.", 7), (None, 1, "assistant", "so.", 7), (70, None, "user", "a.", 7), (71, 9, "user", "a.", 7)]
    out += [(72, t, "user" if rng.random() < 0.5 else "assistant", f"long {t % 211}" + rng.choice(".!? "), 7) for t in range(1500)]
    out += [(73, 1, "user", "same.", 7)] * 300 + [(74, 2**40, "user", "far.", 7), (74, -5, "assistant", "near.", 7)]
    return out


def brute(rows: list[tuple]) -> dict:
    """Every conversation's result by one recursion over positions and states that keeps whole strings of edits."""
    hits = [(r, zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20) for r in rows]
    kept = collections.defaultdict(list)
    for (conv, turn, role, text, _), hit in hits:
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        if hit:
            kept[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] for r in mine]
        after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

        @functools.cache
        def best(i: int, state: str, room: int = 2) -> tuple[int, str, tuple[str, ...]]:
            ways = []
            if i == len(mine) and state in ("", "a"):
                ways.append((0, "", ()))
            for role in ("user", "assistant"):
                if role[0] in after[state]:
                    if room:
                        cost, edits, lines = best(i, role[0], room - 1)
                        ways.append((cost + 2, "I" + edits, (f"{role}:", *lines)))
                    if i < len(mine) and faults[i] in ("", "truncated"):
                        cost, edits, lines = best(i + 1, role[0])
                        ways.append((cost + 2 + (faults[i] == "truncated"), "R" + edits, (f"{role}:{mine[i][2]}", *lines)))
            if i < len(mine):
                cost, edits, lines = best(i + 1, state)
                ways.append((cost + 3, "D" + edits, lines))
                if faults[i] in ("", "truncated") and initials[i] in after[state]:
                    cost, edits, lines = best(i + 1, initials[i])
                    ways.append((cost + (faults[i] == "truncated"), "K" + edits, (f"{mine[i][1]}:{mine[i][2]}", *lines)))
            return min(ways, default=(10**9, "", ()))

        for i in range(len(mine), -1, -1):
            for state in ("", "s", "u", "a"):
                best(i, state)
        cost, edits, lines = best(0, "")
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = collections.Counter(faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [1, 3, 64])
def test_repairs_are_the_cheapest_and_least(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)  # small blocks: many checkpoints
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n", "part")
    found = {r[0]: tuple(r)[1:] for r in repair.repaired_digests(table.repartition(3)).collect()}
    assert found == brute(rows)


def test_no_rows_and_rows_that_damage_drops(spark):
    assert repair.repaired_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    row = repair.repaired_digests(spark.createDataFrame([(dropped, 0, "user", "a.", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repaired_turns_are_regular(spark):
    rows = [(1, 0, "user", "a.", 1), (1, 1, "user", "b.", 1), (1, 2, "assistant", "c.", 1), (2, 0, "system", "s.", 1)]
    found = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int"))
    turns = [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in found.turns.orderBy("conv_id", "part", "seq", "n").collect()]
    assert turns == [(1, "K", "user", "a."), (1, "I", "assistant", ""), (1, "K", "user", "b."), (1, "K", "assistant", "c.")]
    assert {r["conv_id"]: (r["audit"], r["cost"]) for r in found.audits.collect()} == {1: ("KIKK", 2), 2: ("D", 3)}


def test_blocks_grow_with_the_root_of_a_conversation():
    codes = bytes([repair.INITIALS.index("u")] * 40)
    whole, _ = repair.backward(codes, repair.END)
    for cut in (0, 7, 40):
        after, _ = repair.backward(codes[cut:], repair.END)
        table = [repair.backward(codes[:cut], unit)[0] for unit in repair.UNITS]
        assert whole == tuple(min(table[t][s] + after[t] for t in range(4)) for s in range(4))

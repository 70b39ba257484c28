"""Ranked search against scores by the formula, document by document."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest

from ledgerwing.llm import fptree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tables() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Étude", "ÀB", "x9", "naïve"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60))) + rng.choice(["", ".", " W1-w2"]), 1) for i in range(400)]
    docs += [(500 + i, "w1 w2 w3 copy", 1) for i in range(40)] + [(600, None, 1), (601, "", 1), (602, "!?", 1), (None, "w5 w6 w59", 1), (603, "w7 " * 5000 + "w" * 9000, 1)]
    docs += [(604, "w8 w58", 1)] * 3
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 12))), 1) for i in range(30)]
    items += [(40, None, 1), (41, "", 1), (42, "nowhere", 1), (43, "w5 W6 w59", 1), (None, "copy w1", 1), (44, "w58", 1), (44, "w8", 1), (45, " ".join(words), 1)]
    return docs, items


def brute(docs: list[tuple], items: list[tuple], k: int) -> dict:
    terms = lambda text: TERM.findall((text or "").translate(LOWER))
    counts = [(doc, collections.Counter(terms(text))) for doc, text, _ in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counts for t in c)
    wanted = collections.defaultdict(set)
    for item, text, _ in items:
        wanted[item] |= set(terms(text))
    out = {}
    for item, own in wanted.items():
        rows = []
        for (doc, c), size in zip(counts, sizes, strict=True):
            m = 100 - 90 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc))
        if rows:
            out[item] = [(r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("small", [True, False])
def test_the_best_documents_of_each_item(spark, monkeypatch, small):
    if small:  # small trees, short pieces, runs that are split to the end, several passes
        for name, value in (("TREE_POSTINGS", 300), ("PIECE", 50), ("LEAF", 1), ("PASS_BYTES", 200)):
            monkeypatch.setattr(fptree, name, value)
    docs, items = tables()
    found = collections.defaultdict(list)
    frame = spark.createDataFrame(docs, "doc_id long, text string, n int").withColumnRenamed("n", "terms")
    for r in fptree.search(frame.repartition(3), spark.createDataFrame(items, "item_id long, text string, score int")).collect():
        found[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert {k: sorted(v) for k, v in found.items()} == brute(docs, items, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert fptree.search(none, item).count() == 0
    assert fptree.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), item.limit(0)).count() == 0


def test_a_search_leaves_runs_out(monkeypatch):
    """Documents without the rare term cannot reach the best scores, so they are never scored."""
    import numpy as np

    rng = np.random.default_rng(7)
    tf = (rng.random((5000, 3)) < np.array([0.01, 0.5, 0.9])).astype(np.int64)
    tree = fptree.Tree.of(tf, np.full(5000, 100, np.int64), np.arange(5000), np.array([9000, 500, 10], np.int64))
    scored = []
    score = fptree.Tree._score
    monkeypatch.setattr(fptree.Tree, "_score", lambda self, lo, hi, *a: scored.append(hi - lo) or score(self, lo, hi, *a))
    best: list = []
    tree.search(best, 10)
    all_scores = fptree.contributions(tf, np.full(5000, 100, np.int64)) @ np.array([9000, 500, 10])
    assert sorted((-s, d) for s, d in ((x, -y) for x, y in best)) == sorted((-int(s), i) for i, s in enumerate(all_scores))[:10]
    assert sum(scored) < 100

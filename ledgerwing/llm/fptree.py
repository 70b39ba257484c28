"""Ranked lexical search of items in documents: document trees with bounds, searched branch and bound.

Documents, restricted to an item's terms, are sorted by which of the terms they have, the rarest first. Equal beginnings
are a tree's shared paths, and a subtree is a run of the sorted documents. The largest tf of every term and the least m
in a run bound every score in it, so an item's depth-first search goes to the best child first and leaves out each
run whose bound falls short of the item's k-th score so far. That score is carried from tree to tree of a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwing.llm.storage import drop_materialized, materialize
from ledgerwing.llm.textwords import LOWER, prefix_sums, substring_hashes
from ledgerwing.llm.worker import lean

#: Bytes that terms are made of: digits, letters, and all of characters beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of text whose terms are hashed at once; a longer text goes in pieces that end between two terms.
PIECE = 1 << 18
#: Bytes of item texts whose terms are broadcast and searched at once; more items are searched in several passes.
PASS_BYTES = 1 << 22
#: Postings of the documents of one tree, so that its arrays stay small however long the documents are.
TREE_POSTINGS = 1 << 20
#: Runs of at most so many documents are scored, not split.
LEAF = 24
LAST_ID = np.iinfo(np.int64).max


def term_pieces(text: bytes) -> Iterator[np.ndarray]:
    """A text's bytes in lower case, in pieces that do not cut a term. A term longer than a piece makes one longer piece."""
    data = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            breaks = np.flatnonzero(~TERM_BYTES[data[end : end + PIECE]])
            if len(breaks):
                end += int(breaks[0])
                break
            end = min(end + PIECE, len(data))
        yield LOWER[data[at:end]]
        at = end


def term_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every term in lower-case bytes."""
    inside = TERM_BYTES[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    return substring_hashes(prefix_sums(data), starts, ends), starts


def text_batches(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document number and hash of the terms of many texts: short texts are hashed together, long ones in pieces."""
    run: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        data = LOWER[np.frombuffer(b" ".join(run), np.uint8)]
        hashes, starts = term_hashes(data)
        firsts = np.cumsum([0, *[len(t) + 1 for t in run[:-1]]])
        return np.array(owners, np.int64)[np.searchsorted(firsts, starts, side="right") - 1], hashes

    for k, text in enumerate(texts):
        if not text:
            continue
        if len(text) > PIECE:
            for piece in term_pieces(text):
                hashes, _ = term_hashes(piece)
                yield np.full(len(hashes), k, np.int64), hashes
            continue
        run.append(text)
        owners.append(k)
        size += len(text)
        if size >= PIECE:
            yield flush()
            run, owners, size = [], [], 0
    if run:
        yield flush()


def restricted_vectors(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to doc_id, n (terms with repeats), terms and tfs: places in the sorted vocabulary of hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            totals = np.zeros(count, np.int64)
            keys, sums = [], []
            for owners, hashes in text_batches(batch.column("text").to_pylist()):
                totals += np.bincount(owners, minlength=count)
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[place] == hashes
                key, n = np.unique(owners[known] * len(vocabulary) + place[known], return_counts=True)
                keys.append(key)
                sums.append(n)
            key = np.concatenate([*keys, np.zeros(0, np.int64)])
            kept, inverse = np.unique(key, return_inverse=True)
            tf = np.bincount(inverse, np.concatenate([*sums, np.zeros(0, np.int64)]), len(kept)).astype(np.int64)
            offsets = pa.array(np.searchsorted(kept // len(vocabulary), np.arange(count + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, pa.array((kept % len(vocabulary)).astype(np.int32)))
            tfs = pa.ListArray.from_arrays(offsets, pa.array(tf))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals), terms, tfs], names=["doc_id", "n", "terms", "tfs"])

    return run


@dataclass
class Item:
    """One item's terms that documents have, the rarest first, with their weights."""

    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Tree:
    """One item's documents sorted by their presence pattern: tf (rows x terms), m, doc_id; runs of them are subtrees."""

    tf: np.ndarray
    m: np.ndarray
    ids: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> Tree:
        packed = np.packbits(tf == 0, axis=1)  # documents that have the rarest term come first
        order = np.lexsort((ids, *packed.T[::-1]))
        return cls(tf[order], m[order], ids[order], weights)

    def bounds(self, starts: np.ndarray, end: int) -> np.ndarray:
        """What no document of each run from starts on scores above: the largest tf of each term with the least m."""
        most = np.maximum.reduceat(self.tf[:end], starts, axis=0)
        least = np.minimum.reduceat(self.m[:end], starts)
        return contributions(most, least) @ self.weights

    def children(self, lo: int, hi: int, depth: int) -> tuple[np.ndarray, int]:
        """Where the runs begin that part at the first term, from depth on, that not all documents of a run have or lack."""
        has = self.tf[lo:hi, depth:] > 0
        mixed = np.flatnonzero(has.any(axis=0) & ~has.all(axis=0))
        if not len(mixed):
            return np.array([lo]), self.tf.shape[1]
        column = depth + int(mixed[0])
        change = np.flatnonzero(np.diff((self.tf[lo:hi, column] > 0).view(np.int8))) + 1
        return np.concatenate([[lo], lo + change]), column + 1

    def search(self, best: list[tuple[int, int]], k: int) -> None:
        """Add this tree's documents to the heap of the best (score, -doc_id), of which k stay."""
        stack = [(0, len(self.ids), 0, int(self.bounds(np.array([0]), len(self.ids))[0]))]
        while stack:
            lo, hi, depth, bound = stack.pop()
            if bound <= 0 or (len(best) == k and bound < best[0][0]):
                continue
            if hi - lo <= LEAF or depth >= self.tf.shape[1]:
                self._score(lo, hi, best, k)
                continue
            starts, deeper = self.children(lo, hi, depth)
            if len(starts) == 1:
                self._score(lo, hi, best, k)  # one path: all these documents have the same terms
                continue
            found = self.bounds(starts, hi)
            ends = [*starts[1:].tolist(), hi]
            children = sorted(zip(found.tolist(), starts.tolist(), ends, strict=True))  # the best is taken first
            stack += [(a, b, deeper, bound) for bound, a, b in children]

    def _score(self, lo: int, hi: int, best: list[tuple[int, int]], k: int) -> None:
        scores = contributions(self.tf[lo:hi], self.m[lo:hi]) @ self.weights
        floor = best[0][0] if len(best) == k else 1
        take = np.flatnonzero(scores >= max(floor, 1))
        if len(take) > k:
            take = take[np.lexsort((self.ids[lo:hi][take], -scores[take]))[:k]]
        for i in take.tolist():
            entry = (int(scores[i]), -int(self.ids[lo + i]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def contributions(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's saturated frequency: it grows with tf and falls with m, so extremes of both bound it."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None])


class Postings:
    """Restricted vectors of some documents by term, from which an item's tree takes its rows."""

    def __init__(self, owners: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, ids: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.owners, self.terms, self.tfs, self.m, self.ids = owners[order], terms[order], tfs[order], m, ids

    def tree(self, item: Item) -> Tree | None:
        lows, highs = np.searchsorted(self.terms, item.terms), np.searchsorted(self.terms, item.terms, side="right")
        columns = [self.owners[a:b] for a, b in zip(lows, highs, strict=True)]
        docs = np.unique(np.concatenate(columns))
        if not len(docs):
            return None
        tf = np.zeros((len(docs), len(item.terms)), np.int64)
        for j, (a, b) in enumerate(zip(lows, highs, strict=True)):
            tf[np.searchsorted(docs, columns[j]), j] = self.tfs[a:b]
        return Tree.of(tf, self.m[docs], self.ids[docs], item.weights)


def searched(items: list[Item], documents: int, terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Restricted vectors to item (its place in items), doc_id, score: each item's k best of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        held: list[tuple[np.ndarray, ...]] = []

        def search() -> None:
            firsts = np.cumsum([0, *[len(x[3]) for x in held[:-1]]])
            owners = np.concatenate([x[0] + f for x, f in zip(held, firsts, strict=True)])
            postings = Postings(owners, *[np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4)])
            for item, heap in zip(items, best, strict=True):
                if len(item.terms) and (tree := postings.tree(item)):
                    tree.search(heap, k)

        for batch in batches:
            lengths = np.diff(batch.column("terms").offsets.to_numpy())
            flat, tfs = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            m = np.array([10 + 90 * n * documents // terms for n in batch.column("n").to_pylist()], np.int64)
            ids = batch.column("doc_id").fill_null(LAST_ID).to_numpy()
            held.append((np.repeat(np.arange(len(ids)), lengths), flat, tfs, m, ids))
            if sum(len(x[0]) for x in held) >= TREE_POSTINGS:
                search()
                held = []
        if held:
            search()
        out = [(i, None if -d == LAST_ID else -d, s) for i, heap in enumerate(best) for s, d in heap]
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return run


def _pass(spark: SparkSession, documents: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame | None:
    """Rows item_id, doc_id, score for the items of one pass; every task gives its k best of each item, the window picks."""
    own = [np.unique(np.concatenate([*[h for _, h in text_batches(texts)], np.zeros(0, np.uint64)])) for _, texts in items]
    vocabulary = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
    if not len(vocabulary):
        return None
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    vectors = materialize(rows.mapInArrow(lean(restricted_vectors(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<long>"), "search-vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)  # bounded by the terms of one pass
    for r in found.collect():
        df[r["t"]] = r["df"]
    weights = np.array([int(np.floor(1000 * np.log((2 * total[0] + 2) / (2 * d + 1)))) for d in df.tolist()], np.int64)
    chosen = []
    for hashes in own:
        terms = np.searchsorted(vocabulary, hashes)
        terms = terms[(df[terms] > 0) & (weights[terms] > 0)]
        terms = terms[np.argsort(df[terms], kind="stable")]
        chosen.append(Item(terms.astype(np.int32), weights[terms]))
    near = vectors.filter(F.size("terms") > 0).mapInArrow(lean(searched(chosen, total[0], total[1], k)), "item int, doc_id long, score long")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
    best = materialize(best, "search-best")
    drop_materialized(vectors)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as many as the pass has items


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for every item.

    Terms are runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased. Document counts, lengths
    and frequencies are those of all documents. Equal scores go by doc_id, a null one last. Rows of one item_id are one
    item with the terms of all its texts, a null id too; a null text has no terms. Repeated document rows rank one
    by one. Empty tables and items without terms give no rows. Items go in passes of about PASS_BYTES of text, so what is
    broadcast is bounded whatever the table; a long text is hashed in pieces. No document is shuffled: each task
    searches its own trees and passes on k rows an item.
    """
    spark = documents.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // PASS_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for n in range(passes):
        by_id: dict[int | None, list[bytes]] = {}
        for r in texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).collect():  # bounded by the pass
            by_id.setdefault(r["item_id"], []).append(bytes(r["text"] or b""))
        found = _pass(spark, documents, list(by_id.items()), k) if by_id else None
        if found is not None:
            out = found if passes == 1 else out.unionByName(found)
    return out


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents)),
counts AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counts, totals GROUP BY t, docs),
scored AS (
  SELECT item_id, c.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted q JOIN counts c ON c.t = q.t JOIN weights x ON x.t = q.t JOIN lengths l ON l.doc_id = c.doc_id, totals GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

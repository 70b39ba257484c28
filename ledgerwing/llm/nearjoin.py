"""Self-join of documents on n-gram Jaccard similarity: rare-first prefixes, three filters, one check per pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.llm import textwords, worker
from ledgerwing.llm.connected import components
from ledgerwing.llm.storage import materialize, unused

#: Counters of the frequency sketch that orders shingles; its size is the same whatever the data.
SKETCH_BITS = 20
SKETCH_BLOCKS = 16
#: Hash ranges in which the suffix filter compares two sets.
SUFFIX_RANGES = 64
#: Documents named by candidate pairs are fetched by broadcast up to this number, by a shuffle beyond it.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Similarity:
    """Link when 100 * intersection >= percent * union of the sets of distinct n-word shingles."""

    n: int = 5
    percent: int = 80


def _overlap(size_a: Column, size_b: Column, s: Similarity) -> Column:
    """The least intersection that a link of two sets needs: ceil(percent * (a + b) / (100 + percent))."""
    return F.ceil((size_a + size_b) * s.percent / F.lit(100.0 + s.percent))


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.to_pylist()


def _frequency_sketch(docs: DataFrame, s: Similarity) -> np.ndarray:
    """How many documents hold a shingle, at least: counters over all documents, added up block by block."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for _, run in textwords.blocks(_texts(batch.column(0))):
                total += np.bincount((textwords.shingle_sets(run, s.n)[0] & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32)
        parts = np.split(total, SKETCH_BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counts"])

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size // SKETCH_BLOCKS, np.uint32)
        for part in rows:
            for counts in part["counts"]:
                total += np.frombuffer(counts, np.uint32)
        yield pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    partial = docs.select(F.col("text").cast("binary")).mapInArrow(worker.lean(count), "block int, counts binary")
    rows = partial.groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    found = {r["block"]: np.frombuffer(bytes(r["counts"]), np.uint32) for r in rows}
    return np.concatenate([found.get(k, np.zeros(size // SKETCH_BLOCKS, np.uint32)) for k in range(SKETCH_BLOCKS)])


SETS = "doc_id long, n_shingles long, fp1 long, fp2 long, prefix array<long>, ranges array<short>"


def _sets(docs: DataFrame, s: Similarity, sketch: np.ndarray) -> DataFrame:
    """Of each document: the size of its set, a fingerprint of it, its rare-first prefix, and shingles per hash range."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            for at, run in textwords.blocks(_texts(batch.column(1))):
                value, offsets = textwords.shingle_sets(run, s.n)
                sizes = np.diff(offsets)
                owner = np.repeat(np.arange(len(run)), sizes)
                often = frequency[(value & np.uint64(len(frequency) - 1)).astype(np.int64)]
                order = np.lexsort((value, often, owner))
                ranked = value[order]
                lengths = np.where(sizes > 0, sizes - -(-sizes * s.percent // 100) + 1, 0)
                place = np.arange(len(value)) - offsets[:-1][owner]
                prefix = ranked[place < lengths[owner]]
                spread = np.bincount(owner * SUFFIX_RANGES + (value >> np.uint64(58)).astype(np.int64), minlength=len(run) * SUFFIX_RANGES)

                def total(x: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
                    return (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)

                with np.errstate(over="ignore"):
                    fp1, fp2 = total(textwords.mix(value)), total(textwords.mix(value ^ np.uint64(0xA0761D6478BD642F)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(run)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(fp1),
                        pa.array(fp2),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(prefix.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array((np.arange(len(run) + 1) * SUFFIX_RANGES).astype(np.int32)), pa.array(np.minimum(spread, 32767).astype(np.int16))),
                    ],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "prefix", "ranges"],
                )

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(worker.lean(describe), SETS)


def _passes(a: str, b: str, s: Similarity) -> Column:
    """Length and positional filter for two sets that share a token at pos in their prefixes.

    live counts the earlier tokens of a prefix that some other prefix holds too. The other set cannot share the rest:
    what stands before the common token in the order would stand in the other's prefix as well. So the sets share at
    most the fewer live tokens, the common one, and the fewer of those behind it.
    """
    na, nb, pa_, pb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    length = (100 * F.least(na, nb)) >= (s.percent * F.greatest(na, nb))
    most = F.least(F.col(f"{a}.live"), F.col(f"{b}.live")) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return length & (most >= _overlap(na, nb, s))


def _suffix_filter(pairs: DataFrame, reps: DataFrame, s: Similarity) -> DataFrame:
    """Drop pairs whose sets, range by range of the hash, cannot share enough shingles."""
    narrow = reps.select("rep", "n", "ranges")
    joined = pairs.join(narrow.toDF("a", "n_a", "ranges_a"), "a").join(narrow.toDF("b", "n_b", "ranges_b"), "b")
    most = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    full = F.exists("ranges_a", lambda x: x == 32767)  # a range that is too full to count bounds nothing
    return joined.filter(full | (most >= _overlap(F.col("n_a"), F.col("n_b"), s))).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, s: Similarity) -> DataFrame:
    """The pairs (a, b) whose sets are similar, each compared once."""
    pairs = materialize(pairs, "pairs")
    named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    small = pairs.count() * 2 <= BROADCAST_IDS
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    texts = materialize(texts.join(F.broadcast(named) if small else named, "doc_id", "left_semi"), "pair-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = (batch.column(0).to_pylist(), batch.column(1).to_pylist()), []
            left, right = batch.column(2), batch.column(3)
            step = 64
            for at in range(0, batch.num_rows, step):
                x = [t or b"" for t in left.slice(at, step).to_pylist()]
                y = [t or b"" for t in right.slice(at, step).to_pylist()]
                value_a, off_a = textwords.shingle_sets(x, s.n)
                value_b, off_b = textwords.shingle_sets(y, s.n)
                for k in range(len(x)):
                    sa, sb = value_a[off_a[k] : off_a[k + 1]], value_b[off_b[k] : off_b[k + 1]]
                    common = len(np.intersect1d(sa, sb, assume_unique=True))
                    if len(sa) and len(sb) and 100 * common >= s.percent * (len(sa) + len(sb) - common):
                        found.append(at + k)
            yield pa.RecordBatch.from_arrays([pa.array([column[i] for i in found], pa.int64()) for column in ids], names=["a", "b"])

    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(worker.lean(compare), "a long, b long").distinct(), "links")


def link(docs: DataFrame, s: Similarity) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Documents of equal sets are one node. Shingles are ordered rare first, by a frequency sketch over all documents,
    then by hash; two similar sets share a shingle within the first n - ceil(n * percent / 100) + 1 of each. Of the
    sets that share such a shingle, all are first paired with the one that has the fewest rarer shingles before it,
    as the common origin of near copies has; what that leaves in different components is then paired with each
    other. Pairs must pass the length, positional and suffix filters and are compared once, on their whole texts.
    Only pairs inside one component are left out, so no two similar sets end in different components.

    A text without words has size 0 and links with nothing, nor does a row with a null doc_id, whose component is
    null. Where rows share a doc_id, each goes by its own text. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(_sets(docs, s, _frequency_sketch(docs, s)), "sets")
    same = ["n_shingles", "fp1", "fp2"]
    linked = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(linked.groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    reps = linked.join(classes, same).filter("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "prefix", "ranges").dropDuplicates(["rep", "n", "prefix"])
    reps = materialize(reps, "reps")

    postings = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    common = postings.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    earlier = Window.partitionBy("rep", "n").orderBy("pos")
    met = materialize(postings.join(common, "token").withColumn("live", F.row_number().over(earlier) - 1), "met")
    hubs = met.groupBy("token").agg(F.min(F.struct("pos", "rep", "n", "live")).alias("hub"))
    shared = met.join(hubs, "token")
    to_hub = shared.alias("x").filter((F.col("rep") != F.col("hub.rep")) & _passes("x", "hub", s))
    first = to_hub.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
    links = _verified(_suffix_filter(first, reps, s), docs, s)
    grouped = materialize(components(links), "components")

    placed = met.join(grouped.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    placed = materialize(placed.join(mixed, "token"), "placed")
    x, y = placed.alias("x"), placed.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
    rest = x.join(y, apart & _passes("x", "y", s)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = _verified(_suffix_filter(rest.join(first, ["a", "b"], "left_anti"), reps, s), docs, s)
    roots = components(links.union(more))

    named = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc_id", *same).join(named, same, "left")
    lone = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", lone.alias("component_id"))


def keep_one(docs: DataFrame, s: Similarity) -> DataFrame:
    """docs without near duplicates: of each component the row of the least doc_id stays, all columns kept.

    Rows of one doc_id count as one document and stay together; rows with a null doc_id stay.
    """
    gone = unused(docs.columns, "_near_id")
    found = link(docs, s).filter("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(gone), "left_anti")

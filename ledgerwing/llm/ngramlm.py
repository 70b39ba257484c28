"""Language-model scores from a log-frequency Bloom filter: quantised n-gram counts, read back by repeated probes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwing.llm import textwords, worker
from ledgerwing.llm.storage import WHILE_WRITING, drop_materialized, held, id_bucket, materialize, shuffle_width

END = np.uint64(0x1B873593CC9E2D51)
START = np.uint64(0x2545F4914F6CDD1D)
UNIGRAM, BIGRAM, CONTEXT = 0, 1, 2
#: Bits of a segment that a 32-bit place can name.
MOST_BITS = 1 << 32
#: Texts travel in chunks of about so many bytes, and n-grams of a segment are looked up in runs of about so many.
CHUNK = 1 << 22
#: Bytes of text for each bucket of n-grams.
BUCKET_BYTES = 1 << 21
#: Rows of an Arrow batch where a row is a chunk.
CHUNKS_PER_BATCH = 32


#: Denominators are rounded up to powers of this ratio.
DENOMINATOR_STEP = 1.001


@dataclass(frozen=True)
class Settings:
    """Size and accuracy of the filter.

    Every n-gram takes probes bits for each level of its count in a segment of bits_per_probe times as many bits, so
    the filter grows with the n-grams counted, and none is left out. probes, unless given, grow with the logarithm of
    the text, so that a context's false followers do not grow with the words. frequent_words bounds the exact counts that are
    broadcast; all rarer words are looked up by a join.
    """

    bits_per_probe: float = 2.0
    probes: int | None = None
    base: float = 1.6
    frequent_words: int = 500_000

    def for_bytes(self, total: int) -> Settings:
        return replace(self, probes=self.probes or int(np.clip(np.ceil(np.log2(max(total >> 18, 2))), 8, 40)))


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """The level of each count: 1 for a count of one, one more for each factor of base."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9).astype(np.int64)


def level_values(base: float, most: int = 128) -> np.ndarray:
    """What a level stands for: the mean of the whole numbers in it, or its geometric middle if it holds none."""
    out = np.zeros(most + 1)
    for q in range(1, most + 1):
        lo, hi = base ** (q - 1), base**q
        first, last = int(np.ceil(lo - 1e-9)), int(np.ceil(hi - 1e-9)) - 1
        out[q] = (first + last) / 2 if last >= first else (lo * hi) ** 0.5
    return out


def _seeds(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of n-grams at a level, from which all probes follow."""
    with np.errstate(over="ignore"):
        g = textwords.mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)


def _bits(first: np.ndarray, step: np.ndarray, probe: int, sizes: np.ndarray) -> np.ndarray:
    """Places of the probe-th bit in segments of the given sizes (below 2^32)."""
    return (((first + np.uint64(probe) * step) & np.uint64(0xFFFFFFFF)) * sizes >> np.uint64(32)).astype(np.int64)


def segment(h: np.ndarray, counts: np.ndarray, bound: int, s: Settings) -> tuple[int, np.ndarray]:
    """One segment of the filter as (bits, bytes): every n-gram once for each of its levels.

    A segment over bound bits is an error: more buckets are needed, as none is left out to make it fit.
    """
    q = levels(counts, s.base)
    bits = -(-int(q.sum() * s.probes * s.bits_per_probe) // 64) * 64
    if bits > bound:
        raise ValueError(f"a segment of {bits} bits is over the {bound} that its places can name")
    table = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        first, step = _seeds(h[q >= level], level)
        for probe in range(s.probes):
            table[_bits(first, step, probe, np.uint64(bits))] = True
    return bits, np.packbits(table)


def false_share(table: np.ndarray, bits: int, probes: int) -> float:
    """The chance that an n-gram which was never entered is read at the first level."""
    return float((np.bitwise_count(table).sum() / bits) ** probes) if bits else 0.0


def denominator_codes(sums: np.ndarray, false_mass: float) -> np.ndarray:
    """Sums of the readings of a context's followers, the expected false ones too, as 16-bit logarithms rounded up.

    0 for a context without followers.
    """
    steps = np.ceil(np.log(np.maximum(sums, 1) + false_mass) / np.log(DENOMINATOR_STEP) - 1e-9)
    return np.where(sums > 0, np.minimum(1 + steps, 65535), 0).astype(np.uint16)


def denominators(codes: np.ndarray) -> np.ndarray:
    return DENOMINATOR_STEP ** (codes.astype(np.float64) - 1)


def frequent_counts(unigrams: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and exact counts of the most frequent words, at most `most` of them.

    The least count comes from a histogram over steps of count, of which there are at most a thousand.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    histogram = sorted(((r["step"], r["n"]) for r in unigrams.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for at, n in histogram:
        if total + n > most:
            break
        least, total = at, total + n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], names=["h", "c"])

    rows = unigrams.filter(step >= least).mapInArrow(worker.lean(pack), "h binary, c binary").collect()
    h, c = [np.frombuffer(b"".join(bytes(r[k]) for r in rows), np.int64) for k in ("h", "c")]
    order = np.argsort(h)
    return h[order], c[order]


@dataclass
class Filter:
    """Segments end to end; kind and leading bits of a hash say which one holds an n-gram."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    buckets: int
    values: np.ndarray
    probes: int

    def level(self, h: np.ndarray, kind: int) -> np.ndarray:
        """The highest level up to which all probes of all levels hit; 0 for an n-gram that was never entered."""
        place = kind * self.buckets + bucket_of(h, self.buckets)
        found = np.zeros(len(h), np.int64)
        all_sizes, all_starts = self.sizes[place].astype(np.uint64), self.starts[place]
        alive = np.flatnonzero(all_sizes)
        level = 1
        while len(alive) and level < len(self.values) - 1:
            first, step = _seeds(h[alive], level)
            for probe in range(self.probes):
                at = all_starts[alive] + _bits(first, step, probe, all_sizes[alive])
                hit = np.flatnonzero((self.data[at >> 3] << (at & 7).astype(np.uint8)) & np.uint8(0x80))
                if len(hit) < len(alive):
                    alive, first, step = alive[hit], first[hit], step[hit]
            found[alive] = level
            level += 1
        return found


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def keys_in_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """40 bits that tell the hashes of one bucket apart, in their order; a bucket's size does not grow with the data."""
    with np.errstate(over="ignore"):
        inside = (h >> np.uint64(32)) * np.uint64(buckets) & np.uint64(0xFFFFFFFF)
    return (inside << np.uint64(8)) | ((h & np.uint64(0xFFFFFFFF)) >> np.uint64(24))


KEY_BYTES = 5


def packed_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, the token before each, and offsets."""
    found = textwords.words(texts)
    h = np.insert(found.hashes, found.offsets[1:], END)
    offsets = found.offsets + np.arange(len(found.offsets))
    before = np.concatenate([[START], h[:-1]])
    before[offsets[:-1]] = START
    return h, before, offsets


def _merged(h: np.ndarray, counts: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct hashes, summed counts, and the other columns, which depend on the hash alone."""
    order = np.argsort(h, kind="stable")
    h, counts = h[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(counts, first) if len(first) else counts, *[x[order][first] for x in others]


COUNTED = "kind int, bucket int, hashes binary, counts binary, bits long, segment binary, mass double, false_share double"


def count_ngrams(train: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """Per kind and bucket of hashes: the exact counts of unigrams, and the filter segment of either kind.

    Counts are summed in each batch, so a frequent word sends one count a batch. Rows of kind CONTEXT hold what a
    segment's bigrams add to the denominators of their contexts, in the contexts' buckets: sums of what is read for
    their counts, not of the counts. mass is the sum of what is read for a segment's own n-grams.
    """
    values = level_values(s.base)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, list[tuple[np.ndarray, ...]]] = {UNIGRAM: [], BIGRAM: []}
            for _, run in textwords.blocks(batch.column(0).to_pylist()):
                h, before, _ = tokens(run)
                for kind, grams in _kinds(h, before):
                    codes, distinct = pd.factorize(grams)
                    first = np.zeros(len(distinct), np.int64)
                    first[codes[::-1]] = np.arange(len(codes))[::-1]
                    sums[kind].append((distinct, np.bincount(codes, minlength=len(distinct)), before[first]))
            for kind, parts in sums.items():
                if not parts:
                    continue
                h, c, context = _merged(*map(np.concatenate, zip(*parts, strict=True)))
                c = c.astype(np.uint32)
                cuts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
                rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                sent = keys_in_bucket(h, buckets) if kind == BIGRAM else h
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(rows), pa.int32()),
                        pa.array([k for k, _, _ in rows], pa.int32()),
                        pa.array([packed_keys(sent[a:b]) if kind == BIGRAM else sent[a:b].tobytes() for _, a, b in rows], pa.binary()),
                        pa.array([c[a:b].tobytes() for _, a, b in rows], pa.binary()),
                        pa.array([context[a:b].tobytes() if kind == BIGRAM else b"" for _, a, b in rows], pa.binary()),
                    ],
                    names=["kind", "bucket", "hashes", "counts", "contexts"],
                )

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind, bucket = int(key[0]), int(key[1])
        h, c, context = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for part in parts:
            more = [np.frombuffer(x, np.uint64) if kind == UNIGRAM else unpacked_keys(x) for x in part["hashes"]], [np.frombuffer(x, np.uint32).astype(np.int64) for x in part["counts"]], [np.frombuffer(x, np.uint64) for x in part["contexts"]]
            if kind == UNIGRAM:
                h, c = _merged(np.concatenate([h, *more[0]]), np.concatenate([c, *more[1]]))
            else:
                h, c, context = _merged(*[np.concatenate([x, *y]) for x, y in zip((h, c, context), more, strict=True)])
        bits, table = segment(keys_in_bucket(h, buckets) if kind == UNIGRAM else h, c, MOST_BITS, s)
        read = values[levels(c, s.base)]
        exact = (h.tobytes(), c.tobytes()) if kind == UNIGRAM else (b"", b"")
        rows = [(kind, bucket, *exact, bits, table.tobytes(), float(read.sum()), false_share(table, bits, s.probes))]
        if kind == BIGRAM:
            of, total = _merged(context, read)
            cuts = np.searchsorted(bucket_of(of, buckets), np.arange(buckets + 1))
            rows += [(CONTEXT, k, of[a:b].tobytes(), total[a:b].tobytes(), None, None, None, None) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in COUNTED.split(", ")]).astype({"bits": "Int64"})

    partial = train.select(F.coalesce(F.col("text"), F.lit("")).cast("binary")).mapInArrow(worker.lean(count), "kind int, bucket int, hashes binary, counts binary, contexts binary")
    return materialize(partial.groupBy("kind", "bucket").applyInPandas(add, COUNTED), "ngram-counts")


def context_sums(counted: DataFrame) -> DataFrame:
    """bucket, hashes, sums: the sum of what is read for the followers of each context, contexts sorted by hash."""

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, total = np.zeros(0, np.uint64), np.zeros(0)
        for part in parts:
            h, total = _merged(np.concatenate([h, *[np.frombuffer(x, np.uint64) for x in part["hashes"]]]), np.concatenate([total, *[np.frombuffer(x, np.float64) for x in part["counts"]]]))
        yield pd.DataFrame({"bucket": [int(key[0])], "hashes": [h.tobytes()], "sums": [total.tobytes()]})

    rows = counted.filter(F.col("kind") == CONTEXT).select("bucket", "hashes", "counts")
    return materialize(rows.groupBy("bucket").applyInPandas(add, "bucket int, hashes binary, sums binary"), "ngram-contexts")


def sum_of(contexts: DataFrame, h: np.uint64, buckets: int) -> float:
    """The sum of one context, 0 if it has no followers."""
    row = contexts.filter(F.col("bucket") == int(bucket_of(np.array([h]), buckets)[0])).first()
    if not row:
        return 0.0
    found = np.frombuffer(row["sums"], np.float64)[np.frombuffer(row["hashes"], np.uint64) == h]
    return float(found.sum())


def unigram_table(counted: DataFrame) -> DataFrame:
    """hash, c of every distinct training token."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_py(), np.int64)), pa.array(np.frombuffer(c.as_py(), np.int64))], names=["hash", "c"])

    return counted.filter(F.col("kind") == UNIGRAM).select("hashes", "counts").mapInArrow(worker.lean(unpack), "hash long, c long")


def pack_chunks(named: DataFrame) -> DataFrame:
    """chunk, body: runs of rows (uid, doc_id, held_out, text), each as one Arrow stream and named by its first uid."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x or b"") for x in batch.column(3).to_pylist()])
            cuts = np.flatnonzero(np.diff(sizes // CHUNK, prepend=0, append=-1))
            cuts = np.unique(np.concatenate([[0], cuts[cuts < len(sizes)], [len(sizes)]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "body"])

    return materialize(named.mapInArrow(worker.lean(pack), "chunk long, body binary"), "lm-chunks")


def _unpack(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as stream:
        return stream.read_next_batch()


def _kinds(h: np.ndarray, before: np.ndarray) -> tuple[tuple[int, np.ndarray], ...]:
    return (UNIGRAM, h), (BIGRAM, textwords.pair_hash(before, h))


def look_up(chunks: DataFrame, counted: DataFrame, contexts: DataFrame, false_mass: float, s: Settings, buckets: int) -> DataFrame:
    """chunk, kind, bucket, levels: the levels of each chunk's distinct n-grams in the order of their hashes.

    For words, their denominators as contexts follow as 16-bit codes. The n-grams go to the segments, bucket by
    bucket, so no task holds more than one segment of the filter.
    """
    values = level_values(s.base)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, before, _ = tokens([x or b"" for x in _unpack(body.as_py()).column(3).to_pylist()])
                for kind, grams in _kinds(h, before):
                    distinct = np.sort(pd.unique(grams))
                    cuts = np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1))
                    keys = keys_in_bucket(distinct, buckets)
                    found = np.flatnonzero(np.diff(cuts))
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, kind, np.int32)),
                            pa.array(found.astype(np.int32)),
                            pa.array(np.full(n, chunk, np.int64)),
                            pa.array([packed_keys(keys[cuts[k] : cuts[k + 1]]) for k in found], pa.binary()),
                            pa.nulls(n, pa.int64()),
                            pa.nulls(n, pa.binary()),
                        ],
                        names=["kind", "bucket", "chunk", "hashes", "bits", "segment"],
                    )

    def levels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_sums = np.zeros(0, np.uint64), np.zeros(0)
        key, held, sums, run, size = None, None, no_sums, [], 0

        def codes(h: np.ndarray) -> np.ndarray:
            known, total = sums
            if not len(known):
                return np.zeros(len(h), np.uint16)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            return denominator_codes(np.where(known[at] == h, total[at], 0), false_mass)

        def answer() -> pa.RecordBatch:
            h = [unpacked_keys(x) for _, x in run]
            every = np.concatenate(h)
            level = (held.level(every, 0) if held else np.zeros(len(every), np.int64)).astype(np.uint8)
            cuts = np.cumsum([len(x) for x in h])[:-1]
            parts = [x.tobytes() for x in np.split(level, cuts)]
            if key[0] == UNIGRAM:
                parts = [x + y.tobytes() for x, y in zip(parts, np.split(codes(every), cuts), strict=True)]
            n = len(run)
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in run], pa.int64()), pa.array([key[0]] * n, pa.int32()), pa.array([key[1]] * n, pa.int32()), pa.array(parts, pa.binary())],
                names=["chunk", "kind", "bucket", "levels"],
            )

        for batch in batches:
            kinds, places, chunk_ids, sizes = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
            for k in range(batch.num_rows):
                if (kinds[k], places[k]) != key or size >= CHUNK:
                    if run:
                        yield answer()
                    if (kinds[k], places[k]) != key:
                        held, sums = None, no_sums
                    key, run, size = (kinds[k], places[k]), [], 0
                if not batch.column(5)[k].is_valid:
                    run.append((chunk_ids[k], batch.column(3)[k].as_py()))
                    size += len(run[-1][1])
                elif sizes[k] is None:
                    sums = keys_in_bucket(np.frombuffer(batch.column(3)[k].as_py(), np.uint64), buckets), np.frombuffer(batch.column(5)[k].as_py(), np.float64)
                else:
                    held = Filter(np.frombuffer(batch.column(5)[k].as_py(), np.uint8), np.array([0]), np.array([sizes[k]]), 1, values, s.probes)
        if run:
            yield answer()

    asked = chunks.mapInArrow(worker.lean(probes), "kind int, bucket int, chunk long, hashes binary, bits long, segment binary")
    none = F.lit(None)
    segments = counted.filter(F.col("kind") != CONTEXT).select("kind", "bucket", none.cast("long").alias("chunk"), none.cast("binary").alias("hashes"), "bits", "segment")
    sums = contexts.select(F.lit(UNIGRAM).alias("kind"), "bucket", none.cast("long").alias("chunk"), "hashes", none.cast("long").alias("bits"), F.col("sums").alias("segment"))
    # nulls first: a segment comes before all that is asked of it
    dealt = segments.unionByName(sums).unionByName(asked).repartition(shuffle_width(chunks.sparkSession), "kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk")
    return materialize(dealt.mapInArrow(worker.lean(levels_of), "chunk long, kind int, bucket int, levels binary"), "lm-levels", CHUNKS_PER_BATCH)


#: Classes of contexts that get a share each, by factors of two of the denominator; class 0 has no followers.
CLASSES = 64
SHARES = np.array([0.0, 0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])


def share_class(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.minimum(1 + np.log2(np.maximum(denominators(codes), 1)).astype(np.int64), CLASSES - 1), 0)


@dataclass
class Model:
    """What turns readings into probabilities: read values, their sum over words, the number of words, the start's code."""

    values: np.ndarray
    mass: float
    distinct: float
    start: int

    def parts(self, context: np.ndarray, own: np.ndarray, pair: np.ndarray, seen: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Unigram and bigram probability of tokens; seen: own occurrences to leave out.

        Either sums to one over all words and one unknown word, as both are divided by the sum of what is read.
        """
        p1 = (np.maximum(self.values[own] - seen, 0) + 0.5) / (max(self.mass - seen, 0) + 0.5 * (self.distinct + 1))
        rest = denominators(context) - seen
        p2 = np.where((context > 0) & (rest > 0), np.maximum(self.values[pair] - seen, 0) / np.where(rest > 0, rest, 1), 0)
        return p1, np.minimum(p2, 1.0)

    def probability(self, shares: np.ndarray, context: np.ndarray, own: np.ndarray, pair: np.ndarray) -> np.ndarray:
        p1, p2 = self.parts(context, own, pair)
        share = np.where(context > 0, shares[share_class(context)], 0.0)
        return share * p2 + (1 - share) * p1


def _combinations(own: list[bytes], pair: list[bytes], codes: list[bytes], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Readings of many texts: which combination each token has, the context's code, own and pair level of each
    combination, and where each text begins. The context of a text's first token is the text's start."""
    offsets = np.cumsum([0, *[len(x) for x in own]])
    each, both = (np.frombuffer(b"".join(x), np.uint8).astype(np.int64) for x in (own, pair))
    context = np.concatenate([[0], np.frombuffer(b"".join(codes), np.uint16).astype(np.int64)[:-1]])
    context[offsets[:-1]] = start
    at, found = pd.factorize((context << 16) | (each << 8) | both)
    return at, found >> 16, (found >> 8) & 255, found & 255, offsets


def tune(train: DataFrame, model: Model) -> np.ndarray:
    """The share of the bigram probability for each class of contexts.

    That of greatest likelihood over all training documents, each token's own occurrence left out of the counts.
    """

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, len(SHARES)))
        for batch in batches:
            if not batch.num_rows:
                continue
            at, context, own, pair, _ = _combinations(*[batch.column(k).to_pylist() for k in range(3)], model.start)
            times = np.bincount(at, minlength=len(context))
            p1, p2 = model.parts(context, own, pair, 1)
            of = share_class(context)
            for k, share in enumerate(SHARES):
                sums[:, k] += np.bincount(of, times * np.log(share * p2 + (1 - share) * p1), CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(CLASSES), len(SHARES))), pa.array(np.tile(np.arange(len(SHARES)), CLASSES)), pa.array(sums.ravel())], names=["level", "k", "ll"])

    with held(train.sparkSession, WHILE_WRITING):
        rows = train.select("own", "pair", "codes").mapInArrow(worker.lean(likelihood), "level long, k long, ll double").groupBy("level", "k").agg(F.sum("ll").alias("ll")).collect()
    table = np.zeros((CLASSES, len(SHARES)))
    for r in rows:
        table[r["level"], r["k"]] = r["ll"]
    return SHARES[table.argmax(axis=1)]


def _ranks(h: np.ndarray) -> np.ndarray:
    """The place of each hash among the sorted distinct ones."""
    codes, distinct = pd.factorize(h)
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(distinct)] = np.arange(len(distinct))
    return rank[codes]


LEVELLED = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, own binary, pair binary, codes binary, hash long, tf long"


def level_documents(chunks: DataFrame, answers: DataFrame, frequent: Broadcast) -> DataFrame:
    """Each row's levels token by token and the base score of its frequent words; each rarer word in a row of its own."""

    def levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_hash, top_count = frequent.value
        names = [f.split()[0] for f in LEVELLED.split(", ")]
        body, parts = None, {}

        def finish() -> Iterator[pa.RecordBatch]:
            rows = _unpack(body)
            h, before, offsets = tokens([x or b"" for x in rows.column(3).to_pylist()])
            n = rows.num_rows
            owner = np.repeat(np.arange(n), np.diff(offsets))
            level = {}
            for kind, grams in _kinds(h, before):
                place = _ranks(grams)
                width = 3 if kind == UNIGRAM else 1
                level[kind] = np.frombuffer(b"".join(x[: len(x) // width] for x in parts[kind]), np.uint8)[place]
                if kind == UNIGRAM:
                    codes_of = np.frombuffer(b"".join(x[len(x) // width :] for x in parts[kind]), np.uint16)[place]
            signed = h.view(np.int64)
            codes, distinct = pd.factorize(signed)
            place = np.minimum(np.searchsorted(top_hash, distinct), max(len(top_hash) - 1, 0))
            found = top_hash[place] == distinct if len(top_hash) else np.zeros(len(distinct), bool)
            hit, place = found[codes], place[codes]
            base = np.bincount(owner[hit], np.log10(top_count[place[hit]] + 0.5), n)
            known = np.bincount(owner[hit], minlength=n)
            rare_owner, rare = owner[~hit], signed[~hit]
            order = np.lexsort((rare, rare_owner))
            rare_owner, rare = rare_owner[order], rare[order]
            new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (rare_owner[1:] != rare_owner[:-1])])) if len(rare) else np.zeros(0, np.int64)
            tf = np.diff(np.concatenate([new, [len(rare)]]))
            own, pair, as_context = ([x[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] for x in (level[UNIGRAM], level[BIGRAM], codes_of))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), pa.array(np.diff(offsets)), pa.array(known), pa.array(base), pa.array(own, pa.binary()), pa.array(pair, pa.binary()), pa.array(as_context, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                names=names,
            )
            m, uid = len(new), rows.column(0).to_numpy()
            empty = [pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(uid[rare_owner[new]]), *empty, pa.array(rare[new]), pa.array(tf)], names=names)

        for batch in batches:
            kinds = batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                if kinds[k] is None:
                    if body is not None:
                        yield from finish()
                    body, parts = batch.column(3)[k].as_py(), {UNIGRAM: [], BIGRAM: []}
                else:
                    parts[kinds[k]].append(batch.column(3)[k].as_py())
        if body is not None:
            yield from finish()

    bodies = chunks.select("chunk", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("int").alias("bucket"), F.col("body").alias("levels"))
    # nulls first: a chunk comes before its answers
    dealt = bodies.unionByName(answers).repartition(shuffle_width(chunks.sparkSession), "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return materialize(dealt.mapInArrow(worker.lean(levelled), LEVELLED), "lm-scores")


def score_documents(docs: DataFrame, held_out: Column, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Learns from the rows that held_out leaves. Tokens are words with A-Z in lower case, and one end a text; a null
    text is empty. base_score is the add-half unigram log10 probability from exact counts. score mixes add-half
    unigrams with bigrams, by shares fitted for each class of contexts. Its counts come from a log-frequency Bloom
    filter, so both are divided by the sums of what is read, for contexts with the false readings that are to be
    expected: the probabilities after a context sum to one over all words and one unknown word, up to a thousandth
    that rounding takes off.

    The filter holds every n-gram, in segments that n-grams are sent to; their number grows with the text. Only the
    exact counts of the most frequent words are broadcast, a bounded number; other words' counts are joined. Repeated
    rows repeat. Without training documents all counts are zero.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    total_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    s = (settings or Settings()).for_bytes(total_bytes)
    buckets = max(256, total_bytes // BUCKET_BYTES)
    counted = count_ngrams(rows.filter(~F.col("held_out")), s, buckets)
    unigrams = materialize(unigram_table(counted), "unigrams")
    total, distinct = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    of_kind = {r["kind"]: r for r in counted.groupBy("kind").agg(F.sum("mass").alias("mass"), F.avg("false_share").alias("false")).collect()}
    false_mass = distinct * (of_kind[BIGRAM]["false"] if BIGRAM in of_kind else 0.0)
    contexts = context_sums(counted)
    start = denominator_codes(np.array([sum_of(contexts, START, buckets)]), false_mass)
    model = Model(level_values(s.base), float(of_kind[UNIGRAM]["mass"]) if UNIGRAM in of_kind else 0.0, float(distinct), int(start[0]))
    frequent = spark.sparkContext.broadcast(frequent_counts(unigrams, s.frequent_words))
    named = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    chunks = pack_chunks(named)
    answers = look_up(chunks, counted, contexts, false_mass, s, buckets)
    drop_materialized(counted)
    drop_materialized(contexts)
    levelled = level_documents(chunks, answers, frequent)
    drop_materialized(chunks)
    drop_materialized(answers)
    main = levelled.filter("hash is null")
    shares = tune(main.filter(~F.col("held_out")), model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, context, own, pair, offsets = _combinations(*[batch.column(k).to_pylist() for k in (6, 7, 8)], model.start)
            log_p = np.add.reduceat(np.log10(model.probability(shares, context, own, pair))[at], offsets[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(log_p)], names=[*batch.schema.names[:6], "score"])

    counts = levelled.filter("hash is not null").select("uid", "hash", "tf").join(unigrams, "hash", "left")
    log_c = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    joined = counts.groupBy("uid").agg(F.sum(log_c).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    norm = F.log10(F.lit(float(total)) + 0.5 * (F.lit(float(distinct)) + 1))
    scored = main.drop("hash", "tf").mapInArrow(worker.lean(score), "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    return (
        materialize(scored, "lm-sums")
        .join(joined, "uid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
            "score",
        )
    )


def held_out_scores(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Scores learned from the documents outside one fold of crc32(doc_id as text); a null doc_id is the empty text."""
    return score_documents(docs, id_bucket(F.col("doc_id"), folds) == fold)

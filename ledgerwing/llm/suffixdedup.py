"""Removal of repeated passages by a distributed merge sort of suffixes that never compares a known prefix again.

Only the suffixes that start at anchors are sorted. The anchor of a window of LENGTH bytes is the leftmost of its
CORE-byte strings of least hash, so equal windows have equal anchors at equal distances; each anchor serves a run of
windows. Anchors whose core occurs once in the corpus cannot serve a repeated window and leave first. The suffixes of
the others, with the bytes before them, are sorted in runs, sent front-coded, and merged by loser trees that carry
the length of each contender's known common prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwing.llm import textwords, worker
from ledgerwing.llm.ngramlm import bucket_of
from ledgerwing.llm.storage import drop_materialized, materialize, shuffle_width, unused

LENGTH = 200
CORE = 100
#: Anchors that make up one run at most.
RUN_ANCHORS = 30_000
#: Bits of a core's rank that hold its place in a piece of text; the bits above them are its hash's, the same number
#: for all pieces, so that equal windows choose equal anchors wherever they stand.
PLACE_BITS = 26
#: Bytes of text for each bucket of cores.
BUCKET_BYTES = 4 << 20


def pieces(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Runs of about textwords.BLOCK bytes: the text that each piece is of, where it starts there, and the pieces.

    A longer text comes in pieces that overlap by LENGTH - 1 bytes, so that each window is in exactly one of them.
    """
    owners, starts, run, size = [], [], [], 0
    for k, text in enumerate(texts):
        text = text or b""
        for at in range(0, max(len(text) - LENGTH + 1, 1), textwords.BLOCK):
            owners.append(k)
            starts.append(at)
            run.append(text[at : at + textwords.BLOCK + LENGTH - 1])
            size += len(run[-1])
            if size >= textwords.BLOCK:
                yield np.array(owners), np.array(starts), run
                owners, starts, run, size = [], [], [], 0
    if run:
        yield np.array(owners), np.array(starts), run


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text index, place, first window, last window and core hash of every anchor; places count within the text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, np.zeros(0, np.uint64)
    at = np.arange(len(data) - CORE + 1)
    h = textwords.substring_hashes(textwords.prefix_sums(data), at, at + CORE)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, width, span = (h & ~low) | at.astype(np.uint64), 1, LENGTH - CORE + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :]) if span > width else least
    ok = np.flatnonzero(lengths >= LENGTH)
    counts = lengths[ok] - LENGTH + 1
    if not len(ok):
        return none, none, none, none, np.zeros(0, np.uint64)
    windows = np.repeat(first[ok] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    anchor = (least[windows] & low).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]]) - 1
    place = anchor[begin]
    owner = np.searchsorted(first, place, "right") - 1
    return owner, place - first[owner], windows[begin] - first[owner], windows[end] - first[owner], h[place]


def _run_ids() -> Iterator[int]:
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 32
    while True:
        yield base
        base += 1


CORES = "run long, bucket int, hashes binary, repeated binary, counts binary, keys binary, places binary"


def _core_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """Sorted runs of distinct core hashes, in buckets, each with the anchors it stands for."""

    def rows(run: int, h: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h, kind="stable")
        h, keys, places = h[order], keys[order], places[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts = np.diff(np.concatenate([start, [len(h)]]))
        distinct = h[start]
        cuts = np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1))
        ends = np.concatenate([start, [len(h)]])
        found = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([run] * len(found), pa.int64()),
                pa.array([k for k, _, _ in found], pa.int32()),
                pa.array([distinct[a:b].tobytes() for _, a, b in found], pa.binary()),
                pa.array([np.packbits(counts[a:b] > 1).tobytes() for _, a, b in found], pa.binary()),
                pa.array([counts[a:b].astype(np.uint32).tobytes() for _, a, b in found], pa.binary()),
                pa.array([keys[ends[a] : ends[b]].tobytes() for _, a, b in found], pa.binary()),
                pa.array([places[ends[a] : ends[b]].astype(np.int32).tobytes() for _, a, b in found], pa.binary()),
            ],
            names=[f.split()[0] for f in CORES.split(", ")],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = _run_ids(), [], 0
        for batch in batches:
            key = batch.column(0).to_numpy()
            for texts, starts, run in pieces(batch.column(1).to_pylist()):
                owner, place, _, _, h = anchors(run)
                held.append((h, key[texts[owner]], starts[owner] + place))
                size += len(h)
                if size >= 4 * RUN_ANCHORS:
                    yield rows(next(ids), *map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield rows(next(ids), *map(np.concatenate, zip(*held, strict=True)))

    return docs.select("key", "data").mapInArrow(worker.lean(scan), CORES)


def _repeated_cores(runs: DataFrame) -> DataFrame:
    """run, bucket, and a bit for each of the run's cores: whether it occurs more than once in the corpus."""

    def tell(parts: pd.DataFrame) -> pd.DataFrame:
        h = [np.frombuffer(x, np.uint64) for x in parts["hashes"]]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(parts["repeated"], h, strict=True)]
        _, at, n = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        marked = np.zeros(len(n), bool)
        marked[at[np.concatenate(twice) > 0]] = True
        hit = np.split((n > 1)[at] | marked[at], np.cumsum([len(x) for x in h])[:-1])
        worker.return_memory()
        return pd.DataFrame({"run": parts["run"], "bucket": parts["bucket"], "hit": [np.packbits(x).tobytes() for x in hit]})

    return runs.select("run", "bucket", "hashes", "repeated").groupBy("bucket").applyInPandas(tell, "run long, bucket int, hit binary")


def _candidates(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """key, places: per document the anchors whose core is repeated."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, keys, places, hit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                counts = np.frombuffer(counts, np.uint32)
                kept = np.repeat(np.unpackbits(np.frombuffer(hit, np.uint8), count=len(counts)) > 0, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)[kept]), pa.array(np.frombuffer(places, np.int32)[kept])], names=["key", "place"])

    both = runs.join(answers, ["run", "bucket"]).select("counts", "keys", "places", "hit")
    return both.mapInArrow(worker.lean(unpack), "key long, place int").groupBy("key").agg(F.collect_set("place").alias("places"))


RUNS = "run long, bucket int, suffixes binary, members binary"


def front_code(strings: list[bytes], before: list[bytes], repeated: list[bool]) -> bytes:
    """A sorted run: common prefix with the one before, the rest of each string, and the bytes before it as they are."""
    lcps, rests, last = np.zeros(len(strings), np.uint8), [], b""
    for k, s in enumerate(strings):
        lcps[k] = n = common_prefix(last, s, 0)
        rests.append(s[n:])
        last = s
    sizes = np.array([[len(r) for r in rests], [len(b) for b in before]], np.uint8)
    head = np.array([len(strings)], np.uint32).tobytes()
    return b"".join([head, lcps.tobytes(), sizes.tobytes(), np.array(repeated, np.uint8).tobytes(), *rests, *before])


class Run:
    """Reads a front-coded run string by string."""

    def __init__(self, data: bytes):
        n = self.n = int(np.frombuffer(data[:4], np.uint32)[0])
        head = np.frombuffer(data[4 : 4 + 4 * n], np.uint8).reshape(4, n)
        self.lcps, self.sizes = head[0].tolist(), head[1].tolist()
        self.repeated = head[3] > 0
        self.data, self.at, self.next, self.string = data, 4 + 4 * n, 0, b""
        ends = 4 + 4 * n + int(head[1].sum(dtype=np.int64)) + np.cumsum(head[2], dtype=np.int64)
        self.before = [data[e - s : e] for e, s in zip(ends.tolist(), head[2].tolist(), strict=True)]

    def advance(self) -> int:
        """The next string's common prefix with the one before, -1 at the end."""
        k = self.next
        if k >= self.n:
            return -1
        n, end = self.lcps[k], self.at + self.sizes[k]
        self.string = self.string[:n] + self.data[self.at : end]
        self.at, self.next = end, k + 1
        return n


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which the first known bytes are not looked at."""
    n = min(len(a), len(b))
    while known + 16 <= n and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


def merge_runs(runs: list[Run]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Merge sorted runs: run and index of each string in order, its common prefix with the one before, its length.

    A loser tree. Every contender carries the length of its common prefix with the last string put out; of two, the
    one with more in common is the smaller, and only at a tie are bytes compared, from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    shared = [run.advance() for run in runs] + [-1] * (width - len(runs))  # -1: exhausted, behind all others
    shared = [0 if s >= 0 else -1 for s in shared]
    losers = [-1] * width
    out_run, out_index, out_lcp, out_len = [], [], [], []

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's common prefix becomes that with the winner."""
        x, y = shared[a], shared[b]
        if x > y:
            return a, b
        if x < y:
            return b, a
        if x < 0:
            return a, b
        s, t = runs[a].string, runs[b].string
        n = common_prefix(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            if n == len(s) == len(t) and b < a:
                a, b = b, a
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    level = list(range(width))
    node = width
    while node > 1:  # first round, from the leaves up
        node //= 2
        following = []
        for k in range(node):
            w, lose = play(level[2 * k], level[2 * k + 1])
            losers[node + k] = lose
            following.append(w)
        level = following
    winner = level[0]
    while shared[winner] >= 0:
        run = runs[winner]
        out_run.append(winner)
        out_index.append(run.next - 1)
        out_lcp.append(shared[winner])
        out_len.append(len(run.string))
        shared[winner] = run.advance()
        node = (width + winner) // 2
        while node:
            other = losers[node]
            x, y = shared[winner], shared[other]
            if x < y:
                losers[node], winner = winner, other
            elif x == y and x >= 0:
                w, lose = play(winner, other)
                losers[node], winner = lose, w
            node //= 2
    return out_run, out_index, out_lcp, out_len


def repeated_windows(lcps: np.ndarray, lengths: np.ndarray, before: list[bytes], repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows repeat: (record, first byte, end) relative to the anchor, as covered spans, from sorted records.

    A window that starts d bytes before the anchor repeats if another record shares LENGTH - d bytes after it and
    the d bytes before it. The first is a class of neighbours in suffix order, the second one in the order of the
    reversed bytes before; for each d the pairs of classes are counted.
    """
    none = np.zeros(0, np.int64)
    n = len(lcps)
    linked = np.zeros(n, bool)
    linked[1:] = lcps[1:] >= CORE
    group = np.cumsum(~linked)
    keep = repeated | linked
    keep[:-1] |= linked[1:]
    chosen = np.flatnonzero(keep)
    if not len(chosen):
        return none, none, none
    # a run of chosen records keeps its neighbours, so common prefixes stay those of neighbours
    lcp, length, repeated, group = np.where(linked, lcps, 0)[chosen], lengths[chosen], repeated[chosen], group[chosen]
    texts = [before[i] for i in chosen]
    m = len(chosen)
    order = sorted(range(m), key=lambda i: (group[i], texts[i]))
    left_lcp = np.zeros(m, np.int64)
    for k in range(1, m):
        i, j = order[k - 1], order[k]
        left_lcp[k] = common_prefix(texts[i], texts[j], 0) if group[i] == group[j] else -1
    left_lcp[0] = -1
    order = np.array(order)
    left_length = np.array([len(t) for t in texts], np.int64)
    hit = np.zeros((m, LENGTH - CORE + 2), bool)
    for d in range(LENGTH - CORE + 1):
        valid = (left_length >= d) & (length >= LENGTH - d)
        if not valid.any():
            continue
        right_class = np.cumsum(lcp < LENGTH - d)
        left_class = np.empty(m, np.int64)
        left_class[order] = np.cumsum(left_lcp < d)
        pair = right_class[valid] * np.int64(m + 1) + left_class[valid]
        by = np.argsort(pair, kind="stable")
        ranked = pair[by]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(pair), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        hit[np.flatnonzero(valid)[twice | repeated[valid]], d] = True
    step = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    record, first_d = np.nonzero(step == 1)
    _, last_d = np.nonzero(step == -1)
    return chosen[record], -(last_d - 1), LENGTH - first_d


def _suffix_runs(docs: DataFrame, candidates: DataFrame, buckets: int) -> DataFrame:
    """Sorted front-coded runs of the suffixes at candidate anchors, in buckets by core."""

    def encode(run: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: r[:3])  # bucket, suffix, bytes before it
        out = []
        at = 0
        while at < len(held):
            bucket, end = held[at][0], at
            strings, before, repeated, counts, keys, places, sizes = [], [], [], [], [], [], []
            while end < len(held) and held[end][0] == bucket:
                _, s, b, key, place, size = held[end]
                if strings and strings[-1] == s and before[-1] == b:
                    counts[-1] += 1
                    repeated[-1] = True
                else:
                    strings.append(s)
                    before.append(b)
                    repeated.append(False)
                    counts.append(1)
                keys.append(key)
                places.append(place)
                sizes.append(size)
                end += 1
            members = np.array([len(counts)], np.uint32).tobytes() + np.array(counts, np.uint32).tobytes() + np.array(keys, np.int64).tobytes() + np.array([places, sizes], np.int64).tobytes()
            out.append((run, bucket, front_code(strings, before, repeated), members))
            at = end
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["run", "bucket", "suffixes", "members"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = _run_ids(), []
        for batch in batches:
            keys, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            all_texts = batch.column(1).to_pylist()
            for texts, starts, run in pieces(all_texts):
                owner, place, lo, hi, h = anchors(run)
                of, shift = texts[owner], starts[owner]
                ask = np.concatenate([np.asarray(wanted[k], np.int64) + (k << 40) for k in np.unique(texts).tolist()])
                hit = np.flatnonzero(np.isin(shift + place + (of << 40), ask))
                bucket = bucket_of(h[hit], buckets).tolist()
                for b, o, a, first, last in zip(bucket, of[hit].tolist(), *[(shift + x)[hit].tolist() for x in (place, lo, hi)], strict=True):
                    text = all_texts[o]
                    held.append((b, text[a : last + LENGTH], text[first:a][::-1], keys[o], a, len(text)))
                if len(held) >= RUN_ANCHORS:
                    yield from encode(next(ids), held)
                    held = []
        if held:
            yield from encode(next(ids), held)

    return docs.join(candidates, "key").select("key", "data", "places").mapInArrow(worker.lean(scan), RUNS)


def _merged_spans(runs: DataFrame) -> DataFrame:
    """run, bucket, spans: what the merge of a bucket's runs tells each of them, packed."""

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        opened = [Run(x) for x in parts["suffixes"]]
        of, index, lcps, lengths = merge_runs(opened)
        before = [opened[r].before[i] for r, i in zip(of, index, strict=True)]
        repeated = np.array([opened[r].repeated[i] for r, i in zip(of, index, strict=True)], bool)
        record, first, end = repeated_windows(np.array(lcps, np.int64), np.array(lengths, np.int64), before, repeated)
        of, index = np.array(of, np.int64), np.array(index, np.int64)
        packed = []
        for r in range(len(opened)):
            mine = of[record] == r
            packed.append(np.stack([index[record[mine]], first[mine], end[mine]]).astype(np.int32).tobytes())
        worker.return_memory()
        return pd.DataFrame({"run": parts["run"], "bucket": parts["bucket"], "spans": packed})

    return runs.select("run", "bucket", "suffixes").groupBy("bucket").applyInPandas(merge, "run long, bucket int, spans binary")


def _document_spans(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """key, n_bytes, spans: every document's repeated spans, not yet joined where they overlap."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                index, first, end = np.frombuffer(found, np.int32).reshape(3, -1).astype(np.int64)
                n = int(np.frombuffer(members[:4], np.uint32)[0])
                counts = np.frombuffer(members[4 : 4 + 4 * n], np.uint32).astype(np.int64)
                total = int(counts.sum())
                keys = np.frombuffer(members[4 + 4 * n : 4 + 4 * n + 8 * total], np.int64)
                places, sizes = np.frombuffer(members[4 + 4 * n + 8 * total :], np.int64).reshape(2, total)
                starts = np.cumsum(counts) - counts
                repeat = counts[index]
                at = np.repeat(starts[index] - (np.cumsum(repeat) - repeat), repeat) + np.arange(int(repeat.sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at]), pa.array(sizes[at]), pa.array(places[at] + np.repeat(first, repeat)), pa.array(places[at] + np.repeat(end, repeat))],
                    names=["key", "n_bytes", "start", "end"],
                )

    both = runs.join(spans, ["run", "bucket"]).select("members", "spans")
    rows = both.mapInArrow(worker.lean(unpack), "key long, n_bytes long, start long, end long")
    return rows.groupBy("key", "n_bytes").agg(F.collect_set(F.struct("start", "end")).alias("raw"))


def _union(spans: Column) -> Column:
    """Sorted spans that neither overlap nor touch."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(F.size(done) == 0, F.array(x)).otherwise(
            F.when(x["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x)))
        )

    return F.aggregate(F.sort_array(spans), start, add)


def _cut(texts: pa.Array, all_spans: pa.Array) -> list[bytes | None]:
    out = []
    for text, spans in zip(texts.to_pylist(), all_spans.to_pylist(), strict=True):
        if spans:
            edges = [0, *[x for s in spans for x in (s["start"], s["end"])], len(text)]
            text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append(text)
    worker.return_memory()
    return out


def kept_bytes(data: Column, spans: Column) -> Column:
    """data without the bytes in spans."""

    @F.arrow_udf("binary")
    def cut(texts: pa.Array, all_spans: pa.Array) -> pa.Array:
        return pa.array(_cut(texts, all_spans), pa.binary())

    return F.when(F.size(spans) > 0, cut(data, spans)).otherwise(data)


def kept_text(data: Column, spans: Column) -> Column:
    """data without the bytes in spans, as text; what is left of a cut character goes."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, all_spans: pa.Array) -> pa.Array:
        return pa.array([x.decode("utf-8", "ignore") if x is not None else None for x in _cut(texts, all_spans)], pa.string())

    return cut(data, spans)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", data_col: str = "data", spans_col: str = "spans") -> DataFrame:
    """docs with two more columns: data_col (the text as bytes) and spans_col (the byte ranges that occur elsewhere too).

    The spans hold each byte covered by a LENGTH-byte string that also starts at another place, in this document or
    another, as sorted ranges with gaps between them. A null text is empty; texts under LENGTH bytes have no spans.
    Equal rows are each other's copies. An empty table gives no rows. The two names must not be columns of docs. A
    very long text is taken in overlapping pieces. What a task holds is one run of at most RUN_ANCHORS anchors, or
    one bucket of all runs, of which there is one for BUCKET_BYTES of text; equal suffixes of a run count once there,
    so copies of a passage meet only as one record a run.
    """
    if {data_col, spans_col} & set(docs.columns):
        raise ValueError(f"{data_col} and {spans_col} must not be columns of the documents")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.xxhash64(F.col(id_col), F.col(id_col).isNull(), data)
    keyed = docs.select(key.alias("key"), data.alias("data")).filter(F.octet_length("data") >= LENGTH)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    buckets = max(64, 16 * shuffle_width(docs.sparkSession), total // BUCKET_BYTES)
    cores = materialize(_core_runs(keyed, buckets), "core-runs")
    candidates = _candidates(cores, _repeated_cores(cores))
    runs = materialize(_suffix_runs(keyed, candidates, buckets), "suffix-runs")
    drop_materialized(cores)
    found = materialize(_document_spans(runs, _merged_spans(runs)), "spans")
    drop_materialized(runs)
    rep_key, rep_bytes = (unused([*docs.columns, data_col, spans_col], x) for x in ("_rep_key", "_rep_bytes"))
    named = found.select(F.col("key").alias(rep_key), F.col("n_bytes").alias(rep_bytes), _union(F.col("raw")).alias(spans_col))
    rows = docs.withColumn(data_col, data)
    key = F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(data_col))
    joined = rows.join(named, (key == F.col(rep_key)) & (F.octet_length(data_col) == F.col(rep_bytes)), "left")
    return joined.drop(rep_key, rep_bytes).withColumn(spans_col, F.coalesce(spans_col, F.array().cast("array<struct<start:bigint,end:bigint>>")))


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = with_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.octet_length("data").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(kept_bytes(F.col("data"), F.col("spans")), 256).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with each text cut down to what is left of it; where a cut falls inside a character, its rest goes too.

    Other columns stay as they are, but n_chars, if there is one, counts the new text where something was cut.
    """
    columns = docs.columns
    data, spans = (unused(columns, x) for x in ("_rep_data", "_rep_spans"))
    found = with_repeats(docs, data_col=data, spans_col=spans)
    some = F.size(spans) > 0
    found = found.withColumn("text", F.when(some, kept_text(F.col(data), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*columns)

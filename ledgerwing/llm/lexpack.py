"""Packing of documents into token windows: a sharded BM25 index gives each seed its unused neighbours, which fill its window.

Documents are tokenized once. Their order goes by min-hashes of their token sets, so documents of like words stand near
each other; ranges of that order are cut into shards of bounded size. A shard's inverted index holds BM25 impacts of
its documents, with document counts and lengths of the whole table. Windows are filled one by one: a seed, then the best
of its unused neighbours, the last of which is cut; what is left of it seeds the next window. So every window is
full but the last of a partition, whose tokens go into sequences of powers of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwing.llm import worker
from ledgerwing.llm.bpe import byte_alphabet
from ledgerwing.llm.storage import drop_materialized, materialize, shuffle_width
from ledgerwing.llm.textwords import LOWER, prefix_sums, substring_hashes

WINDOW = 4096
END_ID = 2
#: Usual BM25 parameters: how soon a frequency saturates, and how much a document's length counts.
K1, B = 1.2, 0.75
#: A shard is closed once its documents have so many tokens between them.
SHARD_TOKENS = 1 << 18
#: Bytes of text that are taken apart at once; a longer text goes in parts that end with a blank.
BLOCK = 1 << 21
#: Pieces that a worker remembers; then it starts anew.
REMEMBERED = 800_000
#: Bits of a sequence id below the partition's number.
SEQUENCE_BITS = 36
PART_KEYS = 3

SPACE, LETTER, NUMBER, OTHER = range(4)
#: What a byte belongs to; bytes of characters beyond ASCII are letters, but for those named below.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
CLASS[range(0x30, 0x3A)] = NUMBER
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
#: Second bytes of the characters U+0080 to U+00BF, and the two signs among U+00C0 to U+00FF.
FIRST_LATIN = np.full(256, OTHER, np.uint8)
FIRST_LATIN[[0xAA, 0xB5, 0xBA]] = LETTER
FIRST_LATIN[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
FIRST_LATIN[[0x85, 0xA0]] = SPACE
SIGNS = (0x97, 0xB7)
#: Bytes that a text may have to be taken apart here: those of characters below U+0240.
USUAL = bytes(range(0xC9))
#: A capital whose lower case has two characters.
DOTTED = "İ".encode()
ENDINGS_1, ENDINGS_2 = np.frombuffer(b"stmd", np.uint8), (b"re", b"ve", b"ll")


def pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that the vocabulary's file takes lower-case text apart into.

    Runs of letters, single numbers and runs of other signs; a lone apostrophe takes one of seven endings with it.
    """
    kind = CLASS[data]
    at = np.flatnonzero(data == 0xC2)
    kind[at] = kind[at + 1] = FIRST_LATIN[data[at + 1]]
    at = np.flatnonzero(data == 0xC3)
    at = at[np.isin(data[at + 1], SIGNS)]
    kind[at] = kind[at + 1] = OTHER
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
    edges = np.append(np.flatnonzero(new), len(data))
    starts, ends, kinds = edges[:-1], edges[1:].copy(), kind[edges[:-1]]
    starts = starts.copy()
    lone = np.flatnonzero((kinds[:-1] == OTHER) & (ends[:-1] - starts[:-1] == 1) & (data[starts[:-1]] == 0x27) & (kinds[1:] == LETTER))
    head = starts[lone + 1]
    taken = np.isin(data[head], ENDINGS_1).astype(np.int64)
    second = np.minimum(head + 1, ends[lone + 1] - 1)
    for a, b in ENDINGS_2:
        taken[(data[head] == a) & (data[second] == b) & (second > head)] = 2
    ends[lone] += taken
    starts[lone + 1] += taken
    keep = (kinds != SPACE) & (ends > starts)
    return starts[keep], ends[keep]


class WordTokens:
    """Token ids of texts by a tokenizer file with word ends; its pieces are remembered by hash, as most repeat.

    Below U+0240 a text is in normal form as it is and its lower case does not depend on neighbours, so it is taken apart
    in numpy and only pieces not met before go to the tokenizer's model. Other texts, and those that may hold a special token, go to
    the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.char_of = {byte: char for char, byte in byte_alphabet().items()}
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.first, self.count, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, self.kind)
        self.used = 0

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind)

    def usual(self, text: bytes) -> bool:
        return not text.translate(None, USUAL) and DOTTED not in text and not any(s in text for s in self.specials)

    def _learn(self, value: int, piece: bytes) -> int:
        """Remember a piece's ids; its number."""
        if piece.isascii():  # in lower case already
            chars = piece.decode()
            chars = chars if chars.isprintable() else chars.translate(self.char_of)
        else:
            chars = piece.decode("utf-8", "replace").lower().encode().decode("latin-1").translate(self.char_of)
        ids = [t.id for t in self.tokenizer.model.tokenize(chars)]
        n = self.place[value] = len(self.place)
        if n == len(self.first):
            self.first, self.count = np.resize(self.first, 2 * n), np.resize(self.count, 2 * n)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[n], self.count[n] = self.used, len(ids)
        self.used += len(ids)
        return n

    def block(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of usual texts, taken apart together."""
        data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        starts, ends = pieces(data)
        if len(self.place) > REMEMBERED:
            self.forget()
        distinct, at, inverse = np.unique(substring_hashes(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
        get = self.place.get
        numbers = [get(h) for h in distinct.tolist()]
        for k, n in enumerate(numbers):
            if n is None:
                i = at[k]
                numbers[k] = self._learn(int(distinct[k]), data[starts[i] : ends[i]].tobytes())
        number = np.array(numbers, np.int64)[inverse]
        counts = self.count[number]
        behind = np.cumsum(counts)
        ids = self.flat[np.repeat(self.first[number] - (behind - counts), counts) + np.arange(behind[-1] if len(behind) else 0)]
        borders = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])[:-1])
        return np.split(ids, np.concatenate([[0], behind])[borders])

    def _parts(self, text: bytes) -> Iterator[bytes]:
        """Parts of a long text, each up to a blank, as no piece spans one."""
        at = 0
        while at < len(text):
            end = text.find(b" ", at + BLOCK)
            end = len(text) if end < 0 else end + 1
            yield text[at:end]
            at = end

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, short ones in blocks."""
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        run: list[int] = []
        size = 0

        def flush() -> None:
            for k, ids in zip(run, self.block([texts[k] for k in run]), strict=True):
                out[k] = ids

        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.usual(text):
                out[k] = self.whole(text)
            elif len(text) > BLOCK:
                out[k] = np.concatenate([self.block([part])[0] for part in self._parts(text)])
            else:
                run.append(k)
                size += len(text)
                if size >= BLOCK:
                    flush()
                    run, size = [], 0
        if run:
            flush()
        return out


def _tokens(path: str) -> WordTokens:
    return worker.state(("words", path), lambda: WordTokens(path))


def _encoded(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to ids with end_id behind them (as bytes), a key by which documents of like tokens stand together, and a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        size = max(tokens.tokenizer.get_vocab_size(), end_id + 1)
        mixed = [np.random.default_rng(20240307 + k).permutation(size) for k in range(PART_KEYS)]
        row = TaskContext.get().partitionId() << 40
        end = np.array([end_id], tokens.kind)
        for batch in batches:
            ids = [np.concatenate([own, end]) for own in tokens.ids([text or b"" for text in batch.column("text").to_pylist()])]
            near = [sum(int(m[own].min()) << 20 * (PART_KEYS - 1 - k) for k, m in enumerate(mixed)) for own in ids]
            spread = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            columns = [batch.column("doc_id"), pa.array([own.tobytes() for own in ids], pa.binary()), pa.array(near, pa.int64()), pa.array(spread)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "near", "spread"])
        worker.return_memory(at_once=True)

    return run


def _frequencies(kind: np.dtype, vocabulary: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many documents of a task hold each token; the last rows, of token -1 and -2, count documents and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary, np.int64)
        docs = total = 0
        for batch in batches:
            for ids in batch.column("ids"):
                own = np.frombuffer(ids.as_buffer(), kind)
                df[np.unique(own)] += 1
                docs, total = docs + 1, total + len(own)
        held = np.flatnonzero(df)
        token = np.concatenate([held, [-1, -2]])
        yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(np.concatenate([df[held], [docs, total]]))], names=["token", "n"])

    return run


@dataclass
class Statistics:
    """Of the whole table: weight of each token (its inverse document frequency), and the mean length."""

    weights: np.ndarray
    mean: float


class Shard:
    """An inverted index of BM25 impacts over some documents, and which of them are still unused."""

    def __init__(self, docs: list[tuple[object, np.ndarray]], of: Statistics):
        self.docs = docs
        owners = np.repeat(np.arange(len(docs)), [len(ids) for _, ids in docs])
        key, tf = np.unique(owners * len(of.weights) + np.concatenate([ids for _, ids in docs]), return_counts=True)
        owner, token = key // len(of.weights), key % len(of.weights)
        lengths = np.array([len(ids) for _, ids in docs])
        impact = of.weights[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / of.mean))
        self.first = np.searchsorted(owner, np.arange(len(docs) + 1))  # a document's tokens, as places in the lists below
        order = np.argsort(token, kind="stable")
        self.owner, self.impact = owner[order].astype(np.int32), impact[order].astype(np.float32)
        distinct, starts = np.unique(token[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        place = np.searchsorted(distinct, token)
        self.starts, self.ends = starts[place], ends[place]
        self.unused = np.ones(len(docs), bool)
        self.next = 0

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a token with the seed, by falling BM25 score of its tokens, ties in order."""
        own = slice(self.first[seed], self.first[seed + 1])
        starts, ends = self.starts[own], self.ends[own]
        lengths = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        scores = np.bincount(self.owner[at], self.impact[at], len(self.docs))
        found = np.flatnonzero(self.unused & (scores > 0))
        return found[np.argsort(-scores[found], kind="stable")]

    def any_unused(self) -> int | None:
        while self.next < len(self.docs) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.docs) else None


@dataclass
class Packer:
    """Windows of one partition; what one shard leaves open goes on with the next."""

    window: int
    sequence: int
    filled: int = 0
    open: list[tuple[object, np.ndarray, int, int]] = field(default_factory=list)
    out: list[tuple] = field(default_factory=list)

    def put(self, doc: object, ids: np.ndarray, start: int, end: int) -> int:
        """Lay ids[start:end] into the open window, as many as it has room for; the number laid."""
        taken = min(end - start, self.window - self.filled)
        self.open.append((doc, ids, start, taken))
        self.filled += taken
        if self.filled == self.window:
            self.close()
        return taken

    def close(self) -> None:
        at = 0
        for doc, ids, start, length in self.open:
            self.out.append((doc, start, length, len(ids), self.sequence, at, ids[start : start + length].astype("<u4").tobytes()))
            at += length
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def pack(self, shard: Shard) -> None:
        """All documents of a shard: full windows of the seed first, then neighbours of the seed, then the next in order."""
        seed: int | None = None
        start = 0
        while True:
            if seed is None:
                seed, start = shard.any_unused(), 0
                if seed is None:
                    return
                shard.unused[seed] = False
            doc, ids = shard.docs[seed]
            while start < len(ids):
                start += self.put(doc, ids, start, len(ids))
            rest = None
            if self.filled:
                for near in shard.neighbours(seed).tolist():
                    shard.unused[near] = False
                    doc, ids = shard.docs[near]
                    laid = self.put(doc, ids, 0, len(ids))
                    if not self.filled:  # the window is full, and what is left of this one seeds the next
                        rest = (near, laid) if laid < len(ids) else None
                        break
            seed, start = rest if rest else (None, 0)

    def finish(self) -> None:
        """The last window's tokens, in sequences of falling powers of two: they need no padding."""
        if not self.filled:
            return
        pieces, left = self.open, self.filled
        self.open, self.filled, whole = [], 0, self.window
        for doc, ids, start, length in pieces:
            end = start + length
            while start < end:
                if not self.filled:
                    self.window = 1 << (left.bit_length() - 1)
                    left -= self.window
                start += self.put(doc, ids, start, end)
        self.window = whole


def _packed(of: Statistics, kind: np.dtype, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64()] * 6 + [pa.binary()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << SEQUENCE_BITS)
        docs: list[tuple[object, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append((doc, np.frombuffer(ids, kind)))
                held += len(ids) // kind.itemsize
                if held >= SHARD_TOKENS:
                    packer.pack(Shard(docs, of))
                    docs, held = [], 0
                    if packer.out:
                        yield rows(packer.out)
                        packer.out = []
        if docs:
            packer.pack(Shard(docs, of))
        packer.finish()
        if packer.out:
            yield rows(packer.out)

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids of every piece of every document.

    A document's tokens are those of its whole text by the tokenizer file at path (on every worker), then end_id; a null
    text is empty. ids are little-endian unsigned 32-bit. A sequence has window tokens, or a power of two of them
    where a partition ends, so none needs padding. Rows of one doc_id are documents of their own. An empty table gives
    no rows. Equal texts stand together in the order, and rows that are equal in all are told apart by their place in
    the input, so a group of copies spreads over ranges like other rows. A shard's index is bounded; one document alone
    may go beyond, and then is a shard.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    tokens = materialize(rows.mapInArrow(_encoded(path, end_id), "doc_id long, ids binary, near long, spread long"), "pack-tokens")
    counts = {r["token"]: r["n"] for r in tokens.select("ids").mapInArrow(worker.lean(_frequencies(kind, vocabulary)), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n = counts.pop(-1, 0)
    total = counts.pop(-2, 0)
    df = np.zeros(vocabulary)  # bounded by the vocabulary
    for token, k in counts.items():
        df[token] = k
    of = Statistics(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), total / max(n, 1))
    order = ["near", "doc_id", "spread"]
    ordered = tokens.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    packed = ordered.mapInArrow(
        worker.lean(_packed(of, kind, window)), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    out = materialize(packed, "pack-pieces")
    drop_materialized(tokens)
    return out


def packed_digests(docs: DataFrame, path: str) -> DataFrame:
    """pack()'s pieces with the CRC-32 of their ids in the place of the ids."""
    found = pack(docs, path)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Byte-level BPE: encoding with a queue of merge ranks over a linked symbol list, decoding by concatenation."""

from __future__ import annotations

import json
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwing.llm import worker

#: Fixed value: what byte-level BPE vocabularies of this kind split on. Letters come first, as no other branch
#: can match where they do and most pieces are words.
SPLIT_PATTERN = r""" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that a worker's remembered pieces may take, in each of two generations; what an entry takes beside its strings.
CACHE_BYTES, ENTRY_BYTES = 56_000_000, 190
#: Bits of a queue entry that hold the position, in short pieces and in others; the rank stands above them.
SHORT_BITS, LONG_BITS = 13, 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file, as character -> byte.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceCache(dict):
    """Text -> its token ids as packed int32. When it is full, it becomes the older generation of a new one."""

    def __init__(self, encode: Callable[[str], bytes], room: int = CACHE_BYTES):
        self.encode, self.most, self.room, self.older = encode, room, room, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.encode(text)
            if len(text) > 64:
                return found
        self.room -= ENTRY_BYTES + len(text) + len(found)
        if self.room < 0:
            self.older, self.room = dict(self), self.most
            self.clear()
        self[text] = found
        return found


class ByteBpe:
    """One vocabulary, read from a tokenizer file; lives in a worker and serves all its batches."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        require_byte_level(spec)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = [0] * 256
        for char, byte in alphabet.items():
            self.byte_ids[byte] = vocab[char]
        #: rank of a pair of ids, and the merged id of each rank
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}.get
        self.merged = [vocab[a + b] for a, b in pairs]
        lengths = np.zeros(max(self.pieces) + 1, np.int64)
        for i, piece in self.pieces.items():
            lengths[i] = len(piece)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.pieces.get(i, b"") for i in range(len(lengths))), np.uint8)
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache = PieceCache(self._merged)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one piece: the pair of least rank, leftmost first, merges until none is left."""
        byte_ids, rank_of, merged_id = self.byte_ids, self.rank_of, self.merged
        ids = [byte_ids[b] for b in data]
        n = len(ids)
        if n == 1:
            return tuple(ids)
        shift = SHORT_BITS if n >> SHORT_BITS == 0 else LONG_BITS
        mask = (1 << shift) - 1
        #: rank of the pair that starts at each symbol, None if it has none or was merged away
        current = [rank_of(pair) for pair in zip(ids, ids[1:], strict=False)]
        queue = [rank << shift | i for i, rank in enumerate(current) if rank is not None]
        if not queue:
            return tuple(ids)
        heapify(queue)
        current.append(None)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            i, rank = entry & mask, entry >> shift
            if current[i] != rank:
                continue  # stale: one side has merged with another symbol meanwhile
            j = right[i]
            symbol = ids[i] = merged_id[rank]
            ids[j] = -1
            current[j] = None
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                found = current[i] = rank_of((symbol, ids[after]))
                if found is not None:
                    heappush(queue, found << shift | i)
            else:
                current[i] = None
            before = left[i]
            if before >= 0:
                found = current[before] = rank_of((ids[before], symbol))
                if found is not None:
                    heappush(queue, found << shift | before)
        return tuple([x for x in ids if x >= 0])

    def _merged(self, piece: str) -> bytes:
        ids = self.merge(piece.encode("utf-8"))
        return pack(f"={len(ids)}i", *ids)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def encode(self, text: str) -> np.ndarray:
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special(text)
            packed = b"".join(pack("=i", self.special[part]) if k % 2 else self._plain(part) for k, part in enumerate(parts))
        else:
            packed = self._plain(text)
        return np.frombuffer(packed, np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids' vocabulary strings, joined."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return np.zeros(0, np.uint8)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[at + np.arange(ends[-1])]


def require_byte_level(spec: dict) -> None:
    """Refuse a tokenizer file of another kind than the one that this module encodes as."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    plain = (
        model.get("type", "BPE") == "BPE"
        and not spec.get("normalizer")
        and not model.get("ignore_merges")
        and not model.get("dropout")
        and [x.get("type") for x in steps] == ["ByteLevel"]
        and not steps[0].get("add_prefix_space")
        and steps[0].get("use_regex", True)
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", []))
    )
    if not plain:
        raise ValueError("not a plain byte-level BPE file: " + json.dumps({k: v for k, v in spec.items() if k in ("normalizer", "pre_tokenizer", "added_tokens")})[:500])


def _bpe(path: str) -> ByteBpe:
    return worker.state(("bpe", path), lambda: ByteBpe(path))


def _encoded(texts: pa.Array, bpe: ByteBpe) -> list[np.ndarray]:
    return [bpe.encode(x.decode("utf-8", "replace")) for x in texts.to_pylist()]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *[len(x) for x in parts]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode_column(text: Column, path: str) -> Column:
    """Token ids of a text column, as array<int>. Null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _lists(_encoded(texts, _bpe(path)))

    return encode(F.coalesce(text.cast("binary"), F.lit(b"")))


def decode_column(ids: Column, path: str) -> Column:
    """The text that token ids stand for: their vocabulary strings, joined. Null gives null."""

    @F.arrow_udf("string")
    def decode(arrays: pa.Array) -> pa.Array:
        bpe = _bpe(path)
        return pa.array(
            [bpe.decode(x.values.to_numpy(zero_copy_only=False)).tobytes().decode("utf-8", "replace") if x.is_valid else None for x in arrays],
            pa.string(),
        )

    return decode(ids)


def round_trip_column(text: Column, path: str) -> Column:
    """struct<ids: array<int>, decoded: string>: both ways in one pass, as a chain of both columns would encode twice."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        bpe = _bpe(path)
        parts = _encoded(texts, bpe)
        decoded = pa.array([bpe.decode(x).tobytes().decode("utf-8", "replace") for x in parts], pa.string())
        worker.return_memory()
        return pa.StructArray.from_arrays([_lists(parts), decoded], names=["ids", "decoded"])

    return both(F.coalesce(text.cast("binary"), F.lit(b"")))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every document, in its partition: no shuffle.

    Null and empty texts give an empty array, repeated rows repeat, other columns are left out. A very long
    text is one row; its longest unbroken piece sets the size of the merge queue. The file at path must be on
    every worker; a file of another kind is refused.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), encode_column(F.col(text_col), path).alias("ids"))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with the column decoded beside it."""
    return tokens.withColumn("decoded", decode_column(F.col(ids_col), path))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids joined by commas and of the decoded text."""
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), round_trip_column(F.col("text"), path).alias("both"))
    return both.select(
        "doc_id",
        F.size("both.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("both.ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("both.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

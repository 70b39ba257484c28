"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts are hashed in blocks of about so many bytes.
BLOCK = 1 << 18
_powers = _inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BLOCK * 2)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, pow(_BASE, -1, 2**64), np.uint64)]), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def power_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of 64-bit symbol codes times powers of a base, from which any substring's hash follows."""
    _grow(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * _powers[: len(codes)], out=out[1:])
    return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    return power_sums(_BYTE[data])


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * _inverse[starts])


@dataclass
class Words:
    """Words of consecutive texts: hashes in order, and offsets[i] : offsets[i + 1] for text i."""

    hashes: np.ndarray
    offsets: np.ndarray


def words(texts: list[bytes]) -> Words:
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = ~BREAKS[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    return Words(substring_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, first))


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about BLOCK bytes, with the place of the first. A null text is an empty one."""
    at, size, run = 0, 0, []
    for k, text in enumerate(texts):
        run.append(text or b"")
        size += len(text or b"")
        if size >= BLOCK:
            yield at, run
            at, size, run = k + 1, 0, []
    if run:
        yield at, run


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0x9DDFEA08EB382D69) + right)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted by hash: (hashes, offsets).

    A text of fewer than n words has its whole sequence as one shingle, one without words none.
    """
    found = words(texts)
    h, offsets = found.hashes, found.offsets
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(texts)), counts)
    rolled = h.copy()
    for k in range(1, n):
        rolled[: max(len(h) - k, 0)] = pair_hash(rolled[: max(len(h) - k, 0)], h[k:])
    place = np.arange(len(h)) - offsets[:-1][owner]
    full = place + n <= counts[owner]
    values, owners = [rolled[full]], [owner[full]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        whole = h[offsets[i] : offsets[i] + 1]
        for k in range(offsets[i] + 1, offsets[i + 1]):
            whole = pair_hash(whole, h[k : k + 1])
        values.append(mix(whole + np.uint64(counts[i])))
        owners.append(np.array([i]))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))

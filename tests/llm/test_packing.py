"""Packing: every token in exactly one piece, full windows, and neighbours that share words."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest

from ledgerwing.llm import lexpack
from ledgerwing.llm.registry import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
#: Letters, signs and cases that the tokenizer treats in its own ways.
ODD = ["İstanbul ΑΣ Σας", "été Éte", "a b\u0085c\x1cd", "it's WE'LL don'T", "12½ ²x ªº", "<|endoftext|> end", "a<|startoftext|>b", "漢字 かな 😀!", "\x00\x01", "ﬁ ǅ ẞ ŉ", "x" * 9000, " \t\n", "Ünïcödé--//..", "naïve‍text"]


def rows() -> list[tuple]:
    rng = random.Random(4)
    words = {t: [f"{t}{rng.randrange(300)}" for _ in range(200)] for t in ("alpha", "beta")}
    out = [(i, " ".join(rng.choices(words["alpha" if i % 2 else "beta"], k=rng.randrange(1, 400))), 1) for i in range(80)]
    out += [(100 + i, t, 1) for i, t in enumerate(ODD)] + [(None, "no id here", 1), (300, None, 1), (301, "", 1)]
    out += [(302, "copy of a text. " * 20, 1)] * 30 + [(303, "long text of words " * 40_000, 1)]
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text: str | None) -> np.ndarray:
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_each_token_lies_in_one_piece(spark, library, monkeypatch):
    monkeypatch.setattr(lexpack, "SHARD_TOKENS", 8000)
    monkeypatch.setattr(lexpack, "BLOCK", 1000)
    monkeypatch.setattr(lexpack, "REMEMBERED", 50)
    table = spark.createDataFrame(rows(), "doc_id long, text string, ids int").repartition(3)
    found = [tuple(r) for r in lexpack.packed_digests(table, PATH).collect()]
    sequences = collections.defaultdict(list)
    for doc, start, length, crc, n, sequence, offset in found:
        sequences[sequence].append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    pieces = collections.Counter((doc, start, length, crc, n) for doc, start, length, crc, n, _, _ in found)
    want: collections.Counter = collections.Counter()
    cuts = collections.defaultdict(list)
    for doc, start, length, *_ in found:
        cuts[doc].append((start, length))
    for doc, text, _ in rows():
        ids = ids_of(library, text)
        if doc == 302:  # 30 equal rows: their pieces together cover each token 30 times
            continue
        at = 0
        for start, length in sorted(cuts[doc]):
            assert start == at
            want[doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)] += 1
            at += length
        assert at == len(ids)
    copies = ids_of(library, rows()[-2][1])
    covered = np.zeros(len(copies), int)
    for start, length in cuts[302]:
        covered[start : start + length] += 1
    assert (covered == 30).all()
    assert want == collections.Counter({k: n for k, n in pieces.items() if k[0] != 302})


def test_ids_are_the_librarys(library):
    """Every character below U+0250 beside letters, numbers, signs and blanks, and endings after apostrophes."""
    texts = [f"a{chr(c)}b 1{chr(c)}2 -{chr(c)}-  {chr(c)}{chr(c)} '{chr(c)}S x'{chr(c)}" for c in range(0x250)]
    texts += ["'s't're'm'll'd''s '' 'lla 'l 'r 've've  can't've --'s x's's 's1 1's é's 'sé 'É ''re 're're", "'", "a'", "'ll", "x 'L", *ODD, *[t or "" for _, t, _ in rows()]]
    tokens = lexpack.WordTokens(PATH)
    for text, ids in zip(texts, tokens.ids([t.encode() for t in texts]), strict=True):
        assert (text[:40], ids.tolist()) == (text[:40], library.encode(text, add_special_tokens=False).ids)


def test_empty_table(spark):
    assert lexpack.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_window_takes_its_seeds_nearest_neighbours():
    """Against scores by the formula, document by document."""
    rng = np.random.default_rng(5)
    docs = [(i, rng.integers(0, 40, rng.integers(5, 60)) + 40 * (i % 2)) for i in range(30)]
    vocabulary = 80
    df = np.sum([np.isin(np.arange(vocabulary), ids) for _, ids in docs], axis=0)
    mean = float(np.mean([len(ids) for _, ids in docs]))
    of = lexpack.Statistics(np.log1p((30 - df + 0.5) / (df + 0.5)).astype(np.float32), mean)
    shard = lexpack.Shard(docs, of)
    shard.unused[[0, 4]] = False

    def score(seed: int, other: int) -> float:
        ids = docs[other][1]
        out = 0.0
        for t in np.unique(docs[seed][1]):
            tf = int((ids == t).sum())
            out += float(of.weights[t]) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ids) / mean))
        return out

    found = shard.neighbours(0).tolist()
    assert set(found) == {i for i in range(2, 30, 2) if i != 4}
    scores = [score(0, i) for i in found]
    assert all(a >= b - 1e-4 for a, b in zip(scores, scores[1:], strict=False))


def test_other_windows(spark):
    table = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z")], "doc_id long, text string")
    sizes = [r["length"] for r in lexpack.pack(table, PATH, window=16).orderBy("sequence_id").collect()]
    assert sizes == [16, 8, 2, 1]
    with pytest.raises(ValueError):
        lexpack.pack(table, PATH, window=100)

"""Operators without SQL against plain Python versions that hold everything in dictionaries."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwing.llm import language, multiprobe, voronoi
from tests.llm.test_operators import corpus

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    letters = "aeiounrstéß中İΣ"
    odd = [(1000 + i, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))).title() for _ in range(rng.randrange(0, 40))) + rng.choice(["", "\n", "1́", "--"]), rng.choice(["en", "de", "xx", None]), "s", 1) for i in range(150)]
    return spark.createDataFrame(corpus() + odd, "doc_id long, text string, lang string, source string, shard int").cache()


def words_of(text: str) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def brute_languages(rows: list[tuple], longest: int = 5, penalty: float = -7.0, folds: bool = True) -> list[tuple]:
    def held(key) -> bool:
        return folds and zlib.crc32(("" if key is None else str(key)).encode()) % 3 == 1

    counts: dict = collections.defaultdict(collections.Counter)
    learned = {lang for key, _, lang in rows if not held(key) and lang is not None and key is not None}
    for key, text, lang in rows:
        if not held(key) and key is not None and lang is not None and text is not None:
            for w in words_of(text):
                counts[0, lang][w] += 1
                for n in range(1, longest + 1):
                    for g in grams_of(w, n):
                        counts[n, lang][g] += 1
    languages = sorted(learned)
    known = {n: set().union(*[counts[n, lang] for lang in languages]) if languages else set() for n in range(longest + 1)}

    def score(n: int, term: str) -> np.ndarray:
        return np.array([math.log10(counts[n, x][term] / sum(counts[n, x].values())) if counts[n, x][term] else penalty for x in languages])

    out = []
    for key, text, _ in rows:
        found = []
        for w in words_of(text or ""):
            s = np.zeros(len(languages))
            if w in known[0]:
                s = score(0, w)
            else:
                for n in range(longest, 0, -1):
                    hits = [score(n, g) for g in grams_of(w, n) if g in known[n]]
                    if hits:
                        s = np.mean(hits, axis=0)
                        break
            found.append(s)
        if not found or not languages:
            out.append((str(key), held(key), "und", 0.0))
            continue
        mean = np.mean(found, axis=0)
        odds = 10.0 ** ((mean - mean.max()) * min(len(found), 10))
        out.append((str(key), held(key), languages[int(mean.argmax())], round(1 / odds.sum(), 3)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_language(docs, block):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    expected = brute_languages(rows)
    before, language.BLOCK = language.BLOCK, block
    try:
        held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
        model = language.fit(docs, ~held, docs_per_language=1000)
        names, scores = model.predict([r[1] for r in rows])
        found = sorted((str(r[0]), e, name, round(float(s), 3)) for r, e, name, s in zip(rows, [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 1 for r in rows], names, scores, strict=True))
    finally:
        language.BLOCK = before
    assert [x[:3] for x in found] == [x[:3] for x in expected]
    assert all(abs(a[3] - b[3]) <= 0.002 for a, b in zip(found, expected, strict=True))
    spread = language.held_out_languages(docs, docs_per_language=1000).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"]) for r in spread) == [x[:3] for x in expected]


def test_bounded_sample(docs):
    """No language teaches more than the documented number of documents; their whole vocabulary is kept."""
    languages, sample = language.sample_per_language(docs.filter("doc_id is not null and lang is not null").select("doc_id", "lang", "text"), 20)
    counts = {r["lang"]: r["n"] for r in sample.join(docs.dropDuplicates(["doc_id"]).select("text", "doc_id"), "text").groupBy("lang").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert languages == ["de", "en", "xx"] and sample.count() <= 70 and set(counts) == set(languages)


def brute_nearest(data: dict[int, np.ndarray], step: int, k: int) -> dict[int, list[int]]:
    unit = {i: v / np.linalg.norm(v) for i, v in data.items()}
    return {q: [i for _, i in sorted((-round(float(unit[q] @ unit[i]), 12), i) for i in data if i != q)[:k]] for q in data if q % step == 0}


def vector_cases() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    outliers = rng.normal(0, 1e-3, (400, 8)) + 1.0
    outliers[[0, 50, 100, 150]] = rng.normal(0, 1, (4, 8))
    centres = rng.normal(0, 1, (20, 8))
    mixed = centres[rng.integers(0, 20, 1000)] + rng.normal(0, 0.05, (1000, 8))
    diffuse = rng.random(1000) < 0.05
    mixed[diffuse] = rng.normal(0, 1, (int(diffuse.sum()), 8))
    return {"outliers": outliers, "mixed": mixed, "few": rng.normal(0, 1, (4, 8)), "one": rng.normal(0, 1, (1, 8)), "copies": np.repeat(rng.normal(0, 1, (3, 8)), 60, axis=0)}


@pytest.mark.parametrize("name", sorted(vector_cases()))
def test_every_query_gets_its_neighbours(spark, name):
    """Far-off queries, clusters of mixed density, fewer rows than k, and copies: k rows each, or all candidates."""
    data = dict(enumerate(vector_cases()[name]))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in sorted(multiprobe.nearest5(table).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["vec_id"])
    expected = brute_nearest(data, 50, 5)
    assert all(len(found[q]) == min(5, len(data) - 1) for q in expected) and set(found) <= set(expected)
    total = sum(len(x) for x in expected.values())
    assert sum(len(set(found[q]) & set(x)) for q, x in expected.items()) >= 0.9 * total


def test_reach_is_the_distance_found_with_the_goal():
    """Pairs at the reach share a visited bucket as often as promised, measured on real vectors and functions."""
    rng = np.random.default_rng(3)
    for functions, tables, probes in ((2, 3, 40), (4, 3, 40), (8, 2, 40)):
        far = multiprobe.reach(functions, tables, probes, 0.9, 7)
        hits = []
        for _ in range(30):  # the promise is over the draw of the functions too
            x, step = rng.standard_normal((100, 16)), rng.standard_normal((100, 16))
            y = x + 0.7 * step / np.linalg.norm(step, axis=1)[:, None]
            index = multiprobe.Index(rng.standard_normal((tables, functions, 16)), rng.uniform(0, 1, (tables, functions)), 0.7 / far, probes, far)
            keys = multiprobe.bucket_key(np.floor(index.positions(y)).astype(np.int64))
            hits.append((multiprobe.probe_keys(index, x) == keys[:, :, None]).any(axis=2).any(axis=1).mean())
        hit = np.mean(hits)
        assert abs(hit - 0.9) < 0.06


def test_a_vector_of_another_length_empties_nothing(spark):
    """One longer vector is left out; the usual ones keep their answers, in both searches."""
    rng = np.random.default_rng(4)
    data = {i: rng.normal(0, 1, 8) for i in range(201)}
    rows = [(i, v.tolist()) for i, v in data.items()]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = spark.createDataFrame([*rows, (900, [1.0] * 9), (1000, [2.0] * 7)], "vec_id long, embedding array<double>")
    for search in (multiprobe.nearest5, voronoi.scaled_top10):
        found = sorted(tuple(r) for r in search(odd).collect())
        assert found == sorted(tuple(r) for r in search(plain).collect()) and found


def brute_repeats(texts: list[tuple], length: int = 200) -> dict:
    """What is left of each text, by bytes."""
    seen = collections.Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = {}
    for key, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out[key] = np.frombuffer(t, np.uint8)[~gone].tobytes()
    return out


@pytest.mark.parametrize("block", [1 << 18, 700])
def test_repeats_are_cut_and_other_columns_stay(spark, monkeypatch, block):
    """Values of the cut texts, in blocks of any size, long texts in pieces; data, spans and n_bytes are the caller's."""
    from ledgerwing.llm import suffixdedup, textwords

    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = {i: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(50, 2500))) + (passage if i % 3 == 0 else "") + "é" * (i % 2) for i in range(40)}
    texts |= {100: "xy" * 2000, 101: passage + "z" + passage, 102: "", 103: "q" * 200}
    rows = [(i, t, 7, "spans", f"b{i}", len(t)) for i, t in texts.items()] + [(104, None, 7, "spans", "b104", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data int, spans string, n_bytes string, n_chars long")
    if block != textwords.BLOCK:  # what the workers run, here in this process
        monkeypatch.setattr(textwords, "BLOCK", block)
        found = {}
        for owners, starts, run in suffixdedup.pieces([t.encode() for t in texts.values()]):
            owner, place, lo, hi, h = suffixdedup.anchors(run)
            for o, p, a, b, x in zip(owners[owner].tolist(), (starts[owner] + place).tolist(), (starts[owner] + lo).tolist(), (starts[owner] + hi).tolist(), h.tolist(), strict=True):
                for w in range(a, b + 1):
                    assert (o, w) not in found
                    found[o, w] = (p - w, x)
        by_window = {}
        for (o, w), anchor in found.items():
            window = list(texts.values())[o].encode()[w : w + 200]
            assert len(window) == 200 and by_window.setdefault(window, anchor) == anchor  # equal windows, equal anchors
        assert len(found) == sum(max(len(t.encode()) - 199, 0) for t in texts.values())
        return
    expected = {k: v.decode("utf-8", "ignore") for k, v in brute_repeats([(i, t.encode()) for i, t in texts.items()]).items()}
    kept = suffixdedup.remove_repeats(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert r["text"] == (expected[r["doc_id"]] if r["doc_id"] != 104 else None)
        assert (r["data"], r["spans"], r["n_bytes"]) == (7, "spans", f"b{r['doc_id']}")
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)


def test_a_weight_of_zero_leaves_out(spark):
    import duckdb

    from ledgerwing.llm import mixing

    docs = spark.createDataFrame([(i, "a b c d " * (i % 7 + 1), ["en", "de", "fr"][i % 3], f"s{i % 5}") for i in range(200)], "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    for mixture in (mixing.Mixture((), (("de", 0),), (("s1", 0),), 3, 4), mixing.Mixture((("web", 0), ("books", 0), ("code", 0)), ())):
        found = sorted(tuple(r) for r in mixing.mixed(docs, mixture).select("doc_id", "lang", "source", "epoch").collect())
        assert found == sorted(con.sql(f"SELECT doc_id, lang, source, epoch FROM ({mixing.oracle_sql(mixture)})").fetchall())
        assert not any(lang == "de" or source == "s1" for _, lang, source, _ in found)
        assert bool(found) == (mixture.budget_of == 4)


def brute_shards(rows: list[tuple], shards: int = 8) -> collections.Counter:
    """doc_id, shard, slot: one sorted list cut at equal byte counts; equal texts go whole up to a twentieth of a shard."""
    import hashlib

    n = len(rows)
    copies = collections.Counter(t or "" for _, t in rows)
    hot = {t: math.ceil(c / max(n / 4096, 64)) for t, c in copies.items() if c > max(n / 4096, 64)}

    def order(row: tuple) -> tuple:
        key = hashlib.md5((row[1] or "").encode()).hexdigest()
        parts = hot.get(row[1] or "")
        part = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % parts if parts else 0
        return key[:3], parts is None, key if parts else "", part, key, row[0] is not None, row[0] or 0

    ranked = sorted(rows, key=order)
    at, starts, group_at = 0, [], {}
    for _, t in ranked:
        starts.append(at)
        group_at.setdefault(t or "", at)
        at += len((t or "").encode()) + 1
    out, slots = collections.Counter(), collections.Counter()
    for (key, t), start in zip(ranked, starts, strict=True):
        size = len((t or "").encode()) + 1
        group = copies[t or ""] * size
        middle = 2 * group_at[t or ""] + group if group * 20 * shards <= at else 2 * start + size
        shard = min(middle * shards // (2 * at), shards - 1)
        out[key, shard, slots[shard]] += 1
        slots[shard] += 1
    return out


def test_shards_against_one_sorted_list(spark):
    """Copies far below and far above a twentieth of a shard, nulls, empty texts, repeated rows and one long text."""
    from ledgerwing.llm import sharding

    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(0, 60) + str(i % 211)) for i in range(3000)]
    rows += [(5000 + i, "many copies " * 3) for i in range(900)] + [(7000 + i, f"some {i % 3}") for i in range(210)]
    rows += [(9000, None), (9001, ""), (None, "no id"), (9002, "long " * 900), (9003, "twice"), (9003, "twice")]
    found = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter((r["doc_id"], r["shard"], r["slot"]) for r in found.collect()) == brute_shards(rows)


def brute_language_model(rows: list[tuple], base: float = 1.6) -> tuple[dict, dict]:
    """Scores of all texts, and the sum of the probabilities over all words after each context, from dictionaries."""
    import re

    from ledgerwing.llm import ngramlm

    def level(c: int) -> int:
        q = 0
        while c >= base**q - 1e-9:
            q += 1
        return q

    values = ngramlm.level_values(base)
    texts = {key: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + ["end"] for key, t in rows}
    train = [k for k in texts if zlib.crc32(str(k).encode()) % 5 != 1]
    one, two = collections.Counter(), collections.Counter()
    for k in train:
        one.update(texts[k])
        two.update(zip(["start", *texts[k]], texts[k]))
    read1, read2 = {w: values[level(c)] for w, c in one.items()}, {g: values[level(c)] for g, c in two.items()}
    mass, v = sum(read1.values()), len(one)
    followers = collections.Counter()
    for (c, _), x in read2.items():
        followers[c] += x

    def code(context) -> int:
        return int(ngramlm.denominator_codes(np.array([followers.get(context, 0.0)]), 0.0)[0])

    codes = {c: code(c) for c in [*one, "start"]}

    def parts(context, w, seen=0):
        k = codes.get(context, 0)
        d = 1.001 ** (k - 1) - seen
        p1 = (max(read1.get(w, 0) - seen, 0) + 0.5) / (mass - seen + 0.5 * (v + 1))
        p2 = min(max(read2.get((context, w), 0) - seen, 0) / d, 1) if k and d > 0 else 0
        return k, p1, p2

    likelihood = collections.defaultdict(lambda: np.zeros(len(ngramlm.SHARES)))
    for k in train:
        for c, w in zip(["start", *texts[k]], texts[k]):
            code_, p1, p2 = parts(c, w, 1)
            likelihood[int(ngramlm.share_class(np.array([code_]))[0])] += np.log(ngramlm.SHARES * p2 + (1 - ngramlm.SHARES) * p1)

    def p(c, w):
        code_, p1, p2 = parts(c, w)
        of = int(ngramlm.share_class(np.array([code_]))[0])
        share = ngramlm.SHARES[likelihood[of].argmax()] if code_ and of in likelihood else 0.0
        return share * p2 + (1 - share) * p1

    scores = {k: sum(math.log10(p(c, w)) for c, w in zip(["start", *ws], ws)) for k, ws in texts.items()}
    sums = {c: sum(p(c, w) for w in one) + p(c, "unheard of") for c in [*list(one)[:60], "start", "unheard of"]}
    return scores, sums


def test_language_model_scores(spark):
    """Scores are what a plain model gives, and its probabilities after any context sum to one."""
    from ledgerwing.llm import ngramlm

    rng = random.Random(6)
    words = ["the", "of", "and", *[f"w{i}" for i in range(120)]]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([4, 20, 123])]) for _ in range(rng.randrange(0, 60))) + (" Unique" + str(i) if i % 7 == 0 else "")) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (1003, "never seen words")]
    expected, sums = brute_language_model(rows)
    assert all(0.998 <= x <= 1 + 1e-9 for x in sums.values())
    found = ngramlm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, ngramlm.Settings(probes=30)).collect()
    assert {r["doc_id"] for r in found} == set(expected)
    assert all(abs(r["score"] - expected[r["doc_id"]]) < 1e-6 * max(1, abs(expected[r["doc_id"]])) for r in found)


def test_false_readings_are_expected():
    """A filter of few probes reads about as much for words that were never entered as the denominators allow for."""
    from ledgerwing.llm import ngramlm, textwords

    s = ngramlm.Settings(probes=4)
    h = textwords.mix(np.arange(1, 4001, dtype=np.uint64))
    bits, table = ngramlm.segment(h, np.ones(4000, np.int64), 1 << 30, s)
    reader = ngramlm.Filter(table, np.array([0]), np.array([bits]), 1, ngramlm.level_values(s.base), s.probes)
    others = textwords.mix(np.arange(10**6, 10**6 + 200_000, dtype=np.uint64))
    assert abs((reader.level(others, 0) > 0).mean() / ngramlm.false_share(table, bits, s.probes) - 1) < 0.1


def test_rows_out_of_reach_are_left_behind(spark, monkeypatch):
    """Queries of one tight cluster among many: their group gets a small part of the rows, and the answer is exact."""
    from ledgerwing.llm import voronoi

    rng = np.random.default_rng(12)
    centres = 4000 * rng.standard_normal((40, 6))
    data = {i: np.floor(centres[i % 40] + 20 * rng.standard_normal(6)).astype(int) for i in range(4000)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "vec_id long, v array<long>")
    sent, write = {}, voronoi.materialize
    monkeypatch.setattr(voronoi, "materialize", lambda df, name: sent.setdefault(name, write(df, name)))
    found = voronoi.top_inner_products(rows, F.col("vec_id") % 400 == 0, k=3).collect()
    expected = []
    for q in range(0, 4000, 400):
        best = sorted((-int(data[q] @ v), i) for i, v in data.items() if i != q)[:3]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert sent["knn-replicas"].count() < 400

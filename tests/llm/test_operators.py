"""Each operator against a brute-force answer on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwing.llm import bpe, connected, language, mixing, multiprobe, nearjoin, ngramlm, registry, sharding, suffixdedup, textwords, urlfilter, voronoi
from tests.compare import connect, rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def corpus(seed: int = 1) -> list[tuple[int | None, str | None, str | None, str | None, int]]:
    """doc_id, text, lang, source, shard: prose with copies, near copies, shared passages, nulls and repeated rows."""
    rng = random.Random(seed)
    vocabulary = {"en": "the of and to in that is was for on are with as his they be at one have this".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}

    def prose(lang: str, n: int) -> str:
        return " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "x", "ung", "tion", str(rng.randrange(99))]) for _ in range(n))

    passage = prose("en", 60)
    out: list[tuple[int | None, str | None, str | None, str | None, int]] = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        out.append((i, prose(lang, rng.randrange(1, 120)) + (f" {passage} " + prose(lang, 20) if i % 5 == 0 else ""), lang, f"s{i % 4}", 7))
    base = prose("en", 150)
    out += [(100 + i, base, "en", "s0", 7) for i in range(12)]
    for i in range(12):
        words = base.split()
        words[rng.randrange(150)] = f"edit{i}"
        out.append((200 + i, " ".join(words), "en", "s0", 7))
    out += [(300, None, None, None, 7), (301, "", "en", None, 7), (302, " \n\t", "de", "s1", 7), (None, passage, "en", "s1", 7), (303, "12 34 !!", None, "s2", 7)]
    out += [(304, "ab" * 400, "en", "s2", 7), (305, "a", "en", "s2", 7), (306, "x y", "en", "s2", 7), (306, "x y", "en", "s2", 7), (307, prose("en", 3000), "en", "s3", 7), (308, "é" * 300 + " ß", "de", "s3", 7)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    # shard, spans, key and data clash with names that operators use themselves
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, shard int")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit("k")).withColumn("data", F.lit(1)).withColumn("component_id", F.lit(-1)).cache()


def empty(docs):
    return docs.limit(0)


def texts_of(docs) -> list[tuple[int | None, bytes]]:
    return [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]


def test_repeats(docs):
    texts = texts_of(docs)
    n = suffixdedup.LENGTH
    seen = collections.Counter(t[i : i + n] for _, t in texts for i in range(len(t) - n + 1))
    expected = collections.Counter()
    for key, t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                mark[i] += 1
                mark[i + n] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected[(key, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    found = collections.Counter(tuple(r) for r in suffixdedup.repeat_digests(docs).collect())
    assert found == expected and sum(k[2] for k in expected) > 1000
    assert suffixdedup.repeat_digests(empty(docs)).count() == 0
    kept = suffixdedup.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_merge_of_runs_is_the_sorted_order():
    rng = random.Random(3)
    for k in (1, 2, 3, 5):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 30))) for _ in range(k)]
        opened = [suffixdedup.Run(suffixdedup.front_code(r, [b""] * len(r), [False] * len(r))) for r in runs]
        of, index, lcps, lengths = suffixdedup.merge_runs(opened)
        merged = [runs[r][i] for r, i in zip(of, index, strict=True)]
        assert merged == sorted(x for r in runs for x in r) and lengths == [len(x) for x in merged]
        assert lcps[1:] == [suffixdedup.common_prefix(a, b, 0) for a, b in zip(merged, merged[1:], strict=False)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((4, 8))
    data = [(i, (centres[i % 4] + 0.3 * rng.standard_normal(8)).tolist()) for i in range(300)]
    data += [(400 + i, data[0][1]) for i in range(20)] + [(100, data[100][1]), (500, None), (501, [float("nan")] * 8), (502, [0.0] * 8), (None, data[1][1]), (503, [1.0] * 3), (504, [None] + [1.0] * 7)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))


def usable(vectors) -> dict[int, np.ndarray]:
    found = {}
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v):
            found[r["vec_id"]] = np.array(v, np.float64)
    return found


def test_exact_top_k(vectors):
    data = {k: np.floor(1024 * v).astype(int) for k, v in usable(vectors).items()}
    expected = []
    for q in (k for k in data if k % 100 == 0):
        ranked = sorted(((-int(data[q] @ v), k) for k, v in data.items() if k != q))[:10]
        expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(ranked)]
    assert sorted(tuple(r) for r in voronoi.scaled_top10(vectors).collect()) == sorted(expected)
    few = voronoi.top_inner_products(voronoi_rows(vectors), F.col("vec_id") % 100 == 0, n_pivots=12, queries_per_group=1, rows_per_block=64)
    assert sorted(tuple(r) for r in few.collect()) == sorted(expected)
    assert voronoi.scaled_top10(vectors.limit(0)).count() == 0


def voronoi_rows(vectors):
    from ledgerwing.llm.vectors import finite

    good = vectors.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(1024.0 * x.cast("double")).cast("long")).alias("v"))


def test_nearest_neighbours(spark, vectors):
    data = {k: v for k, v in usable(vectors).items() if v.any()}
    exact = set()
    for q in (k for k in data if k % 50 == 0):
        ranked = sorted((-(data[q] * v).sum() / (math.sqrt((data[q] ** 2).sum()) * math.sqrt((v**2).sum())), k) for k, v in data.items() if k != q)[:5]
        exact |= {(q, k) for _, k in ranked}
    found = multiprobe.nearest5(vectors).collect()
    hit = {(r["query_id"], r["vec_id"]) for r in found}
    assert len(hit & exact) / len(exact) >= 0.9
    assert all(abs(r["score"] - float(data[r["query_id"]] @ data[r["vec_id"]] / np.linalg.norm(data[r["query_id"]]) / np.linalg.norm(data[r["vec_id"]]))) < 1e-12 for r in found)
    table = spark.createDataFrame(sorted(exact), "query_id long, vec_id long")
    assert multiprobe.recall(multiprobe.nearest5(vectors), table) >= 0.9
    assert multiprobe.nearest5(vectors.limit(0)).count() == 0


def test_perturbations_come_in_order_of_cost():
    low = np.array([0.2, 0.5, 0.9])
    found = multiprobe.perturbations(low[None, :], 27)[0]
    costs = [sum((low[f] if s < 0 else 1 - low[f]) ** 2 for f, s in enumerate(steps) if s) for steps in found]
    assert costs == sorted(costs) and len({tuple(x) for x in found}) == 27 and not found[0].any()


def test_language(docs):
    found = language.held_out_languages(docs, docs_per_language=1000).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1) for r in found)
    assert {by_id[i]["lang_pred"] for i in (300, 301, 302, 303)} == {"und"} and by_id[300]["score"] == 0.0
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    told = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in told) / len(told) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    assert language.held_out_languages(empty(docs)).count() == 0
    unlabelled = language.held_out_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_sharding(docs):
    found = sharding.byte_shards(docs).collect()
    texts = collections.Counter((k, len(t) + 1, zlib.crc32(t)) for k, t in texts_of(docs))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == texts
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.byte_shards(empty(docs)).count() == 0


def test_shards_are_near_equal_and_keep_groups(spark):
    df = spark.createDataFrame([(i, f"text {i % 900}" * 5) for i in range(4000)] + [(9000 + i, "hot" * 20) for i in range(2000)], "doc_id long, text string")
    found = sharding.byte_shards(df).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() / sizes.min() < 1.01
    cold = found[found["doc_id"] < 9000]
    assert cold.groupby("text_crc32")["shard"].nunique().max() == 1


def test_texts_of_many_copies_share_a_shard(spark):
    """Texts of 65 to 100 copies, each far below a twentieth of a shard, stay whole wherever a cut falls."""
    rows = [(k * 1000 + i, f"text {k} " * 3) for k in range(400) for i in range(65 + k % 36)]
    found = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(found) == len(rows) and found["shard"].nunique() == 8
    assert found.groupby("text_crc32")["shard"].nunique().max() == 1
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_language_model(docs):
    texts = texts_of(docs)
    held = {k: zlib.crc32(str(k if k is not None else "").encode()) % 5 == 1 for k, _ in texts}
    tokens = [(k, [*WORD.findall(t.translate(LOWER)), None]) for k, t in texts]
    c = collections.Counter(w for k, ws in tokens if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(k), held[k], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for k, ws in tokens)
    for frequent in (500_000, 5):
        found = ngramlm.score_documents(docs, registry_fold(docs), ngramlm.Settings(frequent_words=frequent)).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
        assert all(r["score"] <= 0 for r in found)
    assert ngramlm.held_out_scores(empty(docs)).count() == 0


def registry_fold(docs):
    from ledgerwing.llm.storage import id_bucket

    return id_bucket(F.col("doc_id"), 5) == 1


def test_filter_never_forgets():
    rng = np.random.default_rng(2)
    h, counts = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(1, 3000, 5000)
    s = ngramlm.Settings(probes=8)
    bits, data = ngramlm.segment(h, counts, 1 << 30, s)
    f = ngramlm.Filter(data, np.array([0, 0]), np.array([bits, 0]), 1, ngramlm.level_values(s.base), s.probes)
    assert (f.level(h, 0) >= ngramlm.levels(counts, s.base)).all()
    assert (f.level(rng.integers(0, 2**63, 5000, dtype=np.uint64), 0) > 0).mean() < 0.1
    assert (f.level(h, 1) == 0).all()


def test_no_ngram_is_left_out_of_a_filter():
    h = textwords.mix(np.arange(1, 5001, dtype=np.uint64))
    with pytest.raises(ValueError):
        ngramlm.segment(h, np.full(5000, 3), 1 << 10, ngramlm.Settings(probes=8))
    assert not hasattr(ngramlm.Settings(), "filter_bytes")


def test_shares_are_fitted_over_all_training_documents(spark):
    """1,500 texts: all of them must enter the likelihood, and a segment's levels must come back to every token."""
    docs = spark.createDataFrame([(i, f"a b w{i % 700} c") for i in range(1500)], "doc_id long, text string")
    seen = []
    fit = ngramlm.tune

    def counted(train, *rest):
        seen.append(train.count())
        return fit(train, *rest)

    ngramlm.tune = counted
    try:
        found = ngramlm.score_documents(docs, F.lit(False)).collect()
    finally:
        ngramlm.tune = fit
    assert seen == [1500] and not hasattr(ngramlm.Settings(), "tuning_docs")
    assert len(found) == 1500 and all(r["n_tokens"] == 5 and r["n_known"] == 5 and r["score"] > r["base_score"] for r in found)


def shingles(text: bytes, n: int) -> frozenset:
    w = WORD.findall(text.translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_near_join(docs, n, percent):
    sets = [(k, shingles(t, n)) for k, t in texts_of(docs)]
    parent = {k: k for k, _ in sets if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(k, s) for k, s in sets if k is not None and s]
    for i, (a, x) in enumerate(named):
        for b, y in named[:i]:
            if 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = sorted((str(k), len(s), str(None if k is None else find(k))) for k, s in sets)
    found = nearjoin.link(docs, nearjoin.Similarity(n, percent)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == expected
    kept = nearjoin.keep_one(docs, nearjoin.Similarity(n, percent))
    assert kept.columns == docs.columns
    assert nearjoin.link(empty(docs), nearjoin.Similarity(n, percent)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 5)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    found = {r["id"]: r["component"] for r in connected.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and 100 not in found
    assert connected.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, docs):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    for mixture in (mixing.CORPUS_MIXTURE, mixing.PIPELINE_MIXTURE, mixing.Mixture((), (), budget_parts=1, budget_of=50)):
        df = mixing.mixed(docs, mixture)
        result = con.sql(mixing.oracle_sql(mixture))
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(result.columns), result.fetchall())
    assert mixing.mixed(empty(docs), mixing.CORPUS_MIXTURE).count() == 0
    kept = mixing.select_documents(docs, mixing.PIPELINE_MIXTURE)
    taken = mixing.mixed(docs, mixing.PIPELINE_MIXTURE)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in taken.collect())


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 10), ("a", "en", "y", 1000), ("b", "en", "z", 1000)], "domain string, lang string, source string, tokens long")
    found = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, mixing.Mixture((), (), budget_parts=200, budget_of=2010)).collect()}
    assert found == {"x": 10, "y": 90, "z": 100}


def test_url_filter(spark):
    day = "to_date('2024-01-{0:02d}')".format
    entries = spark.sql(
        " union all ".join(f"select '{p}' as pattern, {day(n)} as listed_on, '{a}' as action" for p, n, a in [("b.com", 5, "block"), ("b.com", 10, "clear"), ("x.b.com", 7, "allow"), ("x.b.com/ads", 1, "block"), ("b.com", 5, "block")])
        + " union all select null, to_date('2024-01-01'), 'block'"
    )
    asked = [("http://b.com/", 4, None), ("http://b.com/", 5, "block"), ("http://b.com/", 9, "block"), ("http://b.com/", 10, "clear"), ("https://x.b.com/q", 6, "block"), ("https://x.b.com/q", 7, "allow"), ("http://u@X.B.com:80/ads/1", 20, "block"), (None, 5, None), ("no url", 5, None), ("http://com/", 5, None)]
    captures = spark.createDataFrame([(i, u, n) for i, (u, n, _) in enumerate(asked)] + [(0, asked[0][0], asked[0][1])], "page_id long, url string, n int").select("page_id", "url", F.expr("date_add(to_date('2023-12-31'), n)").alias("fetched_on"))
    found = {r["page_id"]: (r["action"], r["n_captures"]) for r in urlfilter.filter_captures(captures, entries).collect()}
    assert found == {i: (a, 2 if i == 0 else 1) for i, (_, _, a) in enumerate(asked)}
    assert urlfilter.filter_captures(captures.limit(0), entries).count() == 0


def test_bpe(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = registry.tokenizer_path()
    reference = tokenizers.Tokenizer.from_file(path)
    own = bpe.ByteBpe(path)
    rng = random.Random(6)
    alphabet = "ab  \n\t\x1c\x85\xa0é'sñ1²Ⅷ٣!?​\U0001f600ſ"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)] + ["<|endoftext|>", "a<|endoftext|><|endoftext|>b", "x" * 20000]
    for text in [*odd, *[t.decode() for _, t in texts_of(docs)]]:
        ids = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids, int)).tobytes().decode("utf-8", "replace") == reference.decode(ids, skip_special_tokens=False)
    expected = collections.Counter()
    for key, t in texts_of(docs):
        ids = reference.encode(t.decode(), add_special_tokens=False).ids
        expected[(key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in bpe.round_trip_digests(docs, path).collect()) == expected
    assert bpe.round_trip_digests(empty(docs), path).count() == 0


def test_words_and_shingles():
    texts = [b"A b\tc  D", b"", b"one", b" x y x y x y ", "é è".encode()]
    value, offsets = textwords.shingle_sets(texts, 3)
    assert np.diff(offsets).tolist() == [len(shingles(t, 3)) for t in texts]
    found = textwords.words(texts)
    assert np.diff(found.offsets).tolist() == [len(WORD.findall(t)) for t in texts]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_registered_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    result = connect(sf_dir).sql(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(result.columns), result.fetchall())

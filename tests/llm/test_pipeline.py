"""The pipeline's stages: columns, what each one drops, and the whole run."""

from __future__ import annotations

import pytest

import corpus_pipeline
from ledgerwing.llm.storage import materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialize(stage(spark, docs, sf_dir), f"test{k}")
        counts.append(after.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
            docs = after
    # most is in a known language; copies and near copies go; cutting passages drops no document; the mixture drops some
    assert counts[0] >= 0.95 * before and counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["ids_digest"] for r in again.selectExpr("sha2(cast(array_join(cast(ids as array<string>), ',') as binary), 256) ids_digest").collect()) == sorted(
        r["ids_digest"] for r in after.selectExpr("sha2(cast(array_join(cast(ids as array<string>), ',') as binary), 256) ids_digest").collect()
    )
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "repeated passages", "mixture", "tokens"]


def brute_groups(rows: list[tuple], n: int = 5) -> dict:
    """doc_id -> the least doc_id of its group, by comparing all pairs."""
    from tests.llm.test_operators import shingles

    sets = [(k, shingles((t or "").encode(), n)) for k, t in rows if k is not None]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in root}


def test_each_stage_against_brute_force(spark):
    """Nulls, empty texts, ties, copies, repeated rows and clashing names; each stage judged on its own input."""
    import collections
    import hashlib

    import duckdb
    from pyspark.sql import functions as F

    from ledgerwing.llm import mixing, registry
    from tests.llm.test_brute_force import brute_languages, brute_repeats
    from tests.llm.test_operators import corpus

    def counted(df) -> collections.Counter:
        return collections.Counter((r["doc_id"], r["text"], r["lang"], r["data"], r["component_id"]) for r in df.collect())

    docs = spark.createDataFrame(corpus(3), "doc_id long, text string, lang string, source string, shard int")
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("data", F.lit("d")).withColumn("component_id", F.lit(-1)).cache()
    stages = {name: stage for name, stage in corpus_pipeline.STAGES}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    told = collections.Counter(zip([str(k) for k, _ in rows], [t for _, t in rows], strict=True))
    verdicts = brute_languages([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], folds=False)
    stay = collections.Counter(k for k, _, lang, score in verdicts if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE)
    found = stages["language"](spark, docs, "")
    assert found.columns == docs.columns and collections.Counter(str(r["doc_id"]) for r in found.collect()) == stay
    assert set(counted(found)) <= set(counted(docs)) and sum(told.values()) == len(rows)

    least = brute_groups(rows)
    kept = stages["near duplicates"](spark, docs, "")
    assert kept.columns == docs.columns
    assert counted(kept) == collections.Counter({k: n for k, n in counted(docs).items() if k[0] is None or least[k[0]] == k[0]})

    cut = stages["repeated passages"](spark, docs, "")
    left = collections.Counter()
    marked = brute_repeats([(n, (t or "").encode()) for n, (_, t) in enumerate(rows)])
    for n, (k, t) in enumerate(rows):
        left[k, marked[n].decode("utf-8", "ignore") if t is not None else None] += 1
    assert cut.columns == docs.columns and collections.Counter((r["doc_id"], r["text"]) for r in cut.collect()) == left

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    taken = collections.Counter(r[0] for r in con.sql(f"SELECT doc_id FROM ({mixing.oracle_sql(mixing.PIPELINE_MIXTURE)})").fetchall())
    mixed = stages["mixture"](spark, docs, "")
    assert mixed.columns == docs.columns and collections.Counter(r["doc_id"] for r in mixed.collect()) == taken

    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(registry.tokenizer_path())
    expected = collections.Counter()
    for k, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        expected[k, len(ids), tuple(ids), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    tokens = stages["tokens"](spark, docs, "")
    assert collections.Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in tokens.collect()) == expected

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_stages_keep_columns_of_the_names_that_they_use(spark):
    """Names that operators give their own columns, in any case, stay as they came."""
    from pyspark.sql import functions as F

    from tests.llm.test_operators import corpus

    names = ["_language", "_language0", "_near_id", "_mix_domain", "_MIX_lang", "_mix_source", "_mix_epochs", "_mix_cut", "_rep_key", "_rep_bytes", "_rep_data", "_REP_spans", "key", "n", "text_key"]
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, shard int").drop("shard")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    docs = materialize(docs, "clash-in")
    for k, (stage, f) in enumerate(corpus_pipeline.STAGES[:4]):
        after = materialize(f(spark, docs, ""), f"clash{k}")
        assert after.columns == docs.columns, stage
        wrong = [F.col(f"`{n}`") != F.concat(F.lit(f"{j}-"), F.col("doc_id").cast("string")) for j, n in enumerate(names)]
        assert after.count() > 0 and after.filter(F.greatest(*[w.cast("int") for w in wrong]) == 1).count() == 0, stage
        docs = after

"""Many keywords looked for in many texts at once, inside words too: one automaton a task for each pass over the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of keywords that one automaton is built of; more keywords are looked for in several passes.
PASS_BYTES = 1 << 22


def _automaton(words: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for n, word in enumerate(words):
        automaton.add_word(word, n)
    automaton.make_automaton()
    return automaton


def _matcher(words: list[str], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(words)
        for batch in batches:
            found = [(row, n) for row, value in enumerate(batch.column(text).to_pylist()) if value for n in {n for _, n in automaton.iter(value)}]
            rows = batch.take(pa.array([row for row, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([words[n] for _, n in found], pa.string())], names=[*batch.schema.names, "keyword"])

    return run


def _sieve(words: list[str], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(words)
        for batch in batches:
            yield batch.filter(pa.array([not value or next(automaton.iter(value), None) is None for value in batch.column(text).to_pylist()], pa.bool_()))

    return run


def _passes(keywords: DataFrame, keyword: str) -> Iterator[list[str]]:
    """The keywords, each once, in passes of PASS_BYTES; null and empty ones are left out."""
    words = keywords.select(F.col(keyword).cast("string").alias("keyword")).filter("keyword <> ''").distinct()
    size = words.agg(F.coalesce(F.sum(F.octet_length("keyword") + 1), F.lit(0))).first()[0]
    passes = max(1, -(-size // PASS_BYTES))
    for n in range(passes):
        own = [r["keyword"] for r in words.filter(F.pmod(F.xxhash64("keyword"), F.lit(passes)) == n).collect()]  # bounded by the pass
        if own:
            yield own


def without(texts: DataFrame, keywords: DataFrame, text: str, keyword: str) -> DataFrame:
    """Rows of texts whose text contains none of the keywords, inside words too; case counts. Null texts stay.

    Rows go through one automaton a pass where they lie: nothing is shuffled, sorted or joined.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    for own in _passes(keywords, keyword):
        texts = texts.mapInArrow(_sieve(own, text), schema)
    return texts


def containing(texts: DataFrame, keywords: DataFrame, text: str, keyword: str, keep_text: bool = True) -> DataFrame:
    """Rows of texts with each keyword that their text contains, once, inside words too; case counts.

    Keywords travel to the tasks in passes of PASS_BYTES, so what a task holds is bounded however many there are; texts
    are not shuffled. Null texts and null or empty keywords match nothing. keep_text: the text stays in the rows.
    """
    kept = [c for c in texts.columns if keep_text or c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    out = None
    for own in _passes(keywords, keyword):
        found = texts.mapInArrow(_matcher(own, text), f"{schema}, keyword string").select(*kept, "keyword")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return texts.limit(0).select(*kept, F.lit(None).cast("string").alias("keyword"))
    return out

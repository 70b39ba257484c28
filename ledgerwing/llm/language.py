"""Language identification, word first: known words by log frequency, unseen ones by ever shorter n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwing.llm import textwords, worker
from ledgerwing.llm.storage import WHILE_WRITING, held, id_bucket, unused

UNDETERMINED = "und"
#: Words are taken from stretches of about so many characters.
BLOCK = 1 << 18
#: A mean score counts as the evidence of so many words at most when it becomes odds.
MOST_WORDS = 10
BLANK = 0x20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter (general category L)."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def _codes(points: np.ndarray) -> np.ndarray:
    return textwords.mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


@dataclass
class Stretch:
    """Words of a stretch of lower-case texts: code points, where words start and end, and the text of each."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray

    def hashes(self) -> np.ndarray:
        return textwords.substring_hashes(textwords.power_sums(_codes(self.points)), self.starts, self.ends)


def stretches(texts: list[str | None]) -> Iterator[Stretch]:
    """The words of all texts, in stretches of about BLOCK characters; a longer text is cut between two words."""
    parts: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def found() -> Stretch:
        points = np.concatenate(parts)
        inside = letters()[points]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        first = np.cumsum([0, *[len(x) for x in parts[:-1]]])
        place = np.searchsorted(first, edges[::2], side="right") - 1
        return Stretch(points, edges[::2], edges[1::2], np.array(owners)[place])

    for k, text in enumerate(texts):
        points = np.frombuffer(f"{(text or '').lower()} ".encode("utf-32-le"), np.uint32)
        at = 0
        while at < len(points):
            end = at + BLOCK
            if end < len(points):
                gaps = np.flatnonzero(~letters()[points[end:]])
                end += int(gaps[0]) + 1  # the last character is a blank
            parts.append(points[at:end])
            owners.append(k)
            size += len(parts[-1])
            at = end
            if size >= BLOCK:
                yield found()
                parts, owners, size = [], [], 0
    if parts:
        yield found()


def n_grams(s: Stretch, words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n from longest to 1: the place in words, and the hash, of each n-gram of those words between two blanks."""
    lengths = s.ends[words] - s.starts[words] + 2
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    points = np.full(int(lengths.sum()), BLANK, np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - first[owner]
    inside = (place > 0) & (place < lengths[owner] - 1)
    points[inside] = s.points[(s.starts[words][owner] + place - 1)[inside]]
    sums = textwords.power_sums(_codes(points))
    for n in range(longest, 0, -1):
        at = np.flatnonzero(place + n <= lengths[owner])
        yield n, owner[at], textwords.substring_hashes(sums, at, at + n)


@dataclass
class Table:
    """Sorted hashes of terms, and for each the log10 relative frequency in every language."""

    keys: np.ndarray
    scores: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each hash, and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h


@dataclass
class LanguageModel:
    """tables[0] has the words, tables[n] the n-grams; columns of scores follow the sorted languages."""

    languages: list[str]
    tables: list[Table]

    def word_scores(self, s: Stretch, words: np.ndarray, h: np.ndarray) -> np.ndarray:
        """words x languages: a known word's own scores, else the mean over its longest n-grams that any language knows."""
        at, known = self.tables[0].find(h)
        out = np.zeros((len(words), len(self.languages)))
        out[known] = self.tables[0].scores[at[known]]
        rest = np.flatnonzero(~known)
        open_ = np.ones(len(rest), bool)
        for n, owner, grams in n_grams(s, words[rest], len(self.tables) - 1):
            at, hit = self.tables[n].find(grams)
            hit &= open_[owner]
            counts = np.bincount(owner[hit], minlength=len(rest))
            done = counts > 0
            for k in range(len(self.languages)):
                sums = np.bincount(owner[hit], self.tables[n].scores[at[hit], k], len(rest))
                out[rest[done], k] = sums[done] / counts[done]
            open_ &= ~done
            if not open_.any():
                break
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of the highest mean score of each text, a tie to the first by name, and its share of the odds."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts), np.int64)
        for s in stretches(texts):
            codes, distinct = pd.factorize(s.hashes())
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            scores = self.word_scores(s, first, distinct)
            counts += np.bincount(s.owner, minlength=len(texts))
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(s.owner, scores[codes, k], len(texts))
        mean = total / np.maximum(counts, 1)[:, None]
        best = mean.argmax(axis=1)
        odds = np.exp((mean - mean.max(axis=1)[:, None]) * np.log(10) * np.minimum(counts, MOST_WORDS)[:, None])
        names = [self.languages[k] if n else UNDETERMINED for k, n in zip(best, counts, strict=True)]
        return names, np.where(counts > 0, 1 / odds.sum(axis=1), 0.0)


def _count_terms(languages: list[str], longest: int):
    """mapInArrow: (lang, text) to lang, n, h, c; n is 0 for words. An n-gram weighs as often as its words occur."""
    column = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([column[x] for x in batch.column(0).to_pylist()], np.int64)
            for s in stretches(batch.column(1).to_pylist()):
                h = s.hashes()
                for k in np.unique(lang[s.owner]):
                    mine = np.flatnonzero(lang[s.owner] == k)
                    codes, distinct = pd.factorize(h[mine])
                    times = np.bincount(codes, minlength=len(distinct))
                    first = np.zeros(len(distinct), np.int64)
                    first[codes[::-1]] = mine[::-1]
                    terms = [(0, distinct, times)]
                    for n, owner, grams in n_grams(s, first, longest):
                        codes, found = pd.factorize(grams)
                        terms.append((n, found, np.bincount(codes, times[owner], len(found)).astype(np.int64)))
                    for n, found, c in terms:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(found), k, np.int32)), pa.array(np.full(len(found), n, np.int32)), pa.array(found.view(np.int64)), pa.array(c)],
                            names=["lang", "n", "h", "c"],
                        )

    return count


#: Sampled ids that may be broadcast, 8 bytes each; a noisy label column may give more.
BROADCAST_IDS = 1_000_000


def sample_per_language(labelled: DataFrame, limit: int) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, text) of at most limit documents of each, those of smallest hashed id.

    Ids are first thinned to twice the limit, by the languages' counts, so that a language's ids never meet in one
    task. Rows of one id count as one document.
    """
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], labelled.select("lang", "text")
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (2 * limit + 100) / n)))])
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    thinned = ids.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).distinct()
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = thinned.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= limit).select("doc_id").distinct()
    if limit * len(counts) <= BROADCAST_IDS:  # else the texts travel to the ids
        chosen = F.broadcast(chosen)
    return sorted(counts), labelled.join(chosen, "doc_id", "left_semi").select("lang", "text")


def fit(
    docs: DataFrame,
    train: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    docs_per_language: int = 4000,
    longest: int = 5,
    penalty: float = -7.0,
) -> LanguageModel:
    """Learn from a bounded sample of the labelled rows that train admits.

    The bound is the parameter docs_per_language: whole texts of so many documents of each language, those of smallest
    hashed id. Every word of theirs and every n-gram up to longest is kept, as a 64-bit hash with a score in single
    precision for each language, so what reaches the driver and the workers is limited by the sample. Rows with a null
    id, label or text teach nothing. penalty is the score of a word or n-gram that a language lacks and another has.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), train.alias("train"))
    labelled = named.filter(F.col("train") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).drop("train")
    languages, sample = sample_per_language(labelled, docs_per_language)
    if not languages:
        return LanguageModel([], [])
    terms = sample.filter(F.col("text").isNotNull()).mapInArrow(worker.lean(_count_terms(languages, longest)), "lang int, n int, h long, c long")
    with held(docs.sparkSession, WHILE_WRITING):
        rows = terms.groupBy("lang", "n", "h").agg(F.sum("c").alias("c")).toArrow()
    lang, n, h, c = (rows.column(k).to_numpy() for k in ("lang", "n", "h", "c"))
    h = h.view(np.uint64)
    tables = []
    for length in range(longest + 1):
        mine = n == length
        keys, at = np.unique(h[mine], return_inverse=True)
        scores = np.full((len(keys), len(languages)), penalty, np.float32)
        totals = np.bincount(lang[mine], c[mine], len(languages))
        scores[at, lang[mine]] = np.log10(c[mine]) - np.log10(totals[lang[mine]])
        tables.append(Table(keys, scores))
    return LanguageModel(languages, tables)


def predict_column(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred, score> of a text column, by the whole text; the bounded model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        worker.state("language", dict)  # drops what other functions keep; the model is the broadcast's
        names, scores = shared.value.predict(texts.to_pylist())
        worker.return_memory()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, held_out: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by its whole text alone; no shuffle.

    A null text, or one without a letter, is `und` with score 0, as is everything where nothing was learned.
    Repeated rows repeat; other columns are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), predict_column(docs, model, F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float) -> DataFrame:
    """The documents, all columns, whose language is found with at least least_score; `und` goes."""
    told = unused(docs.columns, "_language")
    p = docs.withColumn(told, predict_column(docs, model, F.col("text")))
    return p.filter((F.col(f"{told}.lang_pred") != UNDETERMINED) & (F.col(f"{told}.score") >= least_score)).drop(told)


def held_out_languages(docs: DataFrame, folds: int = 3, fold: int = 1, **parameters) -> DataFrame:
    """Fit on the documents outside one fold of crc32(doc_id as text), predict all of them.

    A null doc_id counts as the empty text.
    """
    held_out = id_bucket(F.col("doc_id"), folds) == fold
    return identify(docs, fit(docs, ~held_out, **parameters), held_out)

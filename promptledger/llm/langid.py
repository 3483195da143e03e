"""Language identification: known words first, then ever shorter character n-grams.

A word is a run of letters, lower-cased. ``train`` counts words and the n-grams of words
(edges marked) per language in a bounded sample of labelled texts: at most ``SAMPLE_DOCS``,
those with the smallest hash of their id. A word seen at least twice is scored by its log
frequency in each language. For any other word the longest order of n-grams of which at
least half are known gives the mean of their log frequencies. A text's evidence is the sum
over all its words; the score is the chosen language's share after a softmax.

Result: one row per document. A null text or one without a letter is ``und`` with score 0;
so is every text where nothing was labelled. Languages with equal evidence: the first by
name. Repeated rows are judged alike, an empty table gives an empty result, other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
SAMPLE_DOCS = 4_000
#: Orders of n-grams, longest first; each must occur so often in the sample, as must words.
ORDERS = (5, 4, 3, 2, 1)
LEAST_COUNT = 2
#: Added to each count.
SMOOTHING = 0.1
#: Words whose evidence a worker remembers; beyond it starts anew.
MEMORY_WORDS = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    """Log frequencies per language: of words (order 0) and of the n-grams of each order."""

    languages: list[str]
    known: dict[int, dict[str, np.ndarray]]
    _rows: dict[str, int] = field(default_factory=dict)
    _evidence: np.ndarray | None = None

    def of_word(self, word: str) -> np.ndarray:
        found = self.known[0].get(word)
        if found is not None:
            return found
        for order in ORDERS:
            grams = grams_of(word, order)
            hits = [v for v in map(self.known[order].get, grams) if v is not None]
            if hits and 2 * len(hits) >= len(grams):
                return np.mean(hits, axis=0)
        return np.zeros(len(self.languages))

    def _row(self, word: str) -> int:
        row = self._rows[word] = len(self._rows) + 1
        if row >= len(self._evidence):
            self._evidence = np.concatenate([self._evidence, np.zeros_like(self._evidence)])
        self._evidence[row] = self.of_word(word)
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if self._evidence is None or len(self._rows) > MEMORY_WORDS:
            self._rows, self._evidence = {}, np.zeros((1024, len(self.languages)))
        rows = list(map(self._rows.get, words))
        if None in rows:
            for word in set(words).difference(self._rows):
                self._row(word)
            rows = list(map(self._rows.__getitem__, words))
        total = self._evidence[rows].sum(axis=0)
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.languages[best], float(share[best] / share.sum())


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: Counter[tuple[str, str]] = Counter()
        for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.update((language, word) for word in words_of(text))
        totals: Counter[tuple[str, int, str]] = Counter()
        for (language, word), count in words.items():
            totals[language, 0, word] += count
            for order in ORDERS:
                for gram in grams_of(word, order):
                    totals[language, order, gram] += count
        keys = list(totals)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.string()),
                pa.array(list(totals.values()), pa.int64()),
            ],
            ["lang", "level", "token", "count"],
        )


def train(docs: DataFrame) -> Model:
    """Fit to labelled documents (doc_id, text, lang)."""
    labelled = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where("lang is not null and doc_id is not null")
    sample = (
        labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    )
    counts = (
        labelled.join(F.broadcast(sample), "doc_id")
        .select("text", "lang")
        .mapInArrow(_count, "lang STRING, level INT, token STRING, count BIGINT")
        .groupBy("lang", "level", "token")
        .agg(F.sum("count").alias("count"))
    )
    # Tokens seen once in all only count towards the totals of their language.
    rare = F.sum("count").over(Window.partitionBy("level", "token")) < LEAST_COUNT
    slim = (
        counts.withColumn("token", F.when(rare, F.lit(None)).otherwise(F.col("token")))
        .groupBy("lang", "level", "token")
        .agg(F.sum("count").alias("count"), F.count("*").alias("tokens"))
    )
    return model_of(slim.toLocalIterator())


def model_of(rows: Iterable[Row]) -> Model:
    """From counts (lang, level, token, count, tokens): level 0 for words, else the order.
    The rare tokens of a language and level share one row, whose token is null."""
    known: dict[int, dict[str, dict[str, int]]] = {o: {} for o in (0, *ORDERS)}
    totals: Counter[tuple[str, int]] = Counter()
    size: Counter[int] = Counter()
    for row in rows:
        totals[row.lang, row.level] += row["count"]
        if row.token is None:
            size[row.level] += row.tokens
        else:
            known[row.level].setdefault(row.token, {})[row.lang] = row["count"]
    names = sorted({lang for lang, _ in totals})
    logs = {}
    for order, tokens in known.items():
        below = np.log(
            np.array([totals[n, order] for n in names], dtype=float) + SMOOTHING * (len(tokens) + size[order] + 1)
        )
        logs[order] = {t: np.log(np.array([c.get(n, 0) for n in names]) + SMOOTHING) - below for t, c in tokens.items()}
    return Model(names, logs)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """All documents: doc_id, lang_pred, score."""
    # A worker loads a broadcast model once and keeps what it remembers between tasks. Its
    # size is bounded by the sample it was fitted to.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(judge, "doc_id BIGINT, lang_pred STRING, score DOUBLE")


def fold(name: str, parts: int) -> Column:
    """The crc32 of an id as text, modulo the number of folds."""
    return F.crc32(F.col(name).cast("bigint").cast("string").cast("binary")) % parts


def languages(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Train outside the held-out fold and judge all documents: doc_id, held_out, lang_pred,
    score."""
    model = train(docs.where(fold("doc_id", folds) != held_out))
    return identified(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )

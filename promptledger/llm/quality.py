"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics_of`` turns every whole text into numbers: shares of kinds of bytes, lengths of
words and lines, repetition of words, word pairs and lines. ``train`` fits boosted trees of
the logistic loss: values are binned by quantiles, splits are found on histograms of
gradients. The trees are complete and flattened into arrays, so a batch of texts goes
through all of them one level at a time in numpy.

The model is fitted on the driver from at most ``SAMPLE_ROWS`` labelled documents, those
with the smallest hash of their id; everything else covers all rows.

Result: one row per document. Null and empty texts have zero statistics and a score like any
other. A null id is never labelled nor held out. Of several labels of one id the largest
counts; repeated documents are scored each. Without labelled documents every score is 0.5,
with one class only that class's. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.llm.textgrams import FOLDED, Words, byte_chunks, span_hashes

SAMPLE_ROWS = 20_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.2
#: Least sum of second derivatives in a leaf, and the penalty on leaf values.
LEAST_WEIGHT = 3.0
PENALTY = 1.0

_CODES = np.arange(256)
_CHARS = [chr(c) if c < 128 else "" for c in _CODES]
KINDS = {
    "lower": np.array([c.islower() for c in _CHARS]),
    "upper": np.array([c.isupper() for c in _CHARS]),
    "digit": np.array([c.isdigit() for c in _CHARS]),
    "stop": np.isin(_CODES, [ord(c) for c in ".,;:?'\"()-"]),
    "mark": np.array([0x21 <= k < 0x7F and not c.isalnum() and c not in ".,;:?'\"()-" for k, c in enumerate(_CHARS)]),
    "line": _CODES == 10,
    "wide": _CODES >= 128,
}
STATISTICS = (
    *(f"{kind}_share" for kind in KINDS),
    "log_words",
    "log_lines",
    "word_bytes",
    "word_bytes_spread",
    "short_words",
    "distinct_words",
    "top_word",
    "equal_neighbours",
    "distinct_pairs",
    "distinct_triples",
    "distinct_lines",
    "top_line",
    "line_bytes",
    "marked_words",
)


def _most(values: np.ndarray) -> tuple[int, int]:
    """Distinct values, and how often the most frequent occurs."""
    if not len(values):
        return 0, 0
    ordered = np.sort(values)
    cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return len(cuts), int(np.diff(np.append(cuts, len(ordered))).max())


def statistics_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows: first row, end row, one line of statistics per text."""
    for lo, hi, data, offsets in byte_chunks(texts):
        words = Words(data, offsets)
        size = np.maximum(np.diff(offsets), 1)
        result = np.zeros((hi - lo, len(STATISTICS)))
        for column, member in enumerate(KINDS.values()):
            upto = np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])
            result[:, column] = np.diff(upto[offsets]) / size
        line_cut = np.zeros(len(data) + 1, dtype=bool)
        line_cut[offsets] = True
        line_cut[1:][data == 10] = True
        starts = np.flatnonzero(line_cut[:-1])
        ends = np.append(starts[1:], len(data))[: len(starts)]
        lines = span_hashes(data, starts, ends, FOLDED)
        line_bounds = np.searchsorted(starts, offsets)
        pairs, _ = words.grams(2)
        triples, _ = words.grams(3)
        lengths = words.ends - words.starts
        last = data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
        marked = KINDS["mark"][last]
        at = len(KINDS)
        for r in range(hi - lo):
            a, b = words.bounds[r], words.bounds[r + 1]
            n = b - a
            if n == 0:
                continue
            own, own_lengths = words.hashes[a:b], lengths[a:b]
            distinct, top = _most(own)
            own_lines = lines[line_bounds[r] : line_bounds[r + 1]]
            distinct_lines, top_line = _most(own_lines)
            result[r, at:] = (
                np.log1p(n),
                np.log1p(len(own_lines)),
                own_lengths.mean(),
                own_lengths.std(),
                (own_lengths <= 3).mean(),
                distinct / n,
                top / n,
                (own[1:] == own[:-1]).sum() / n,
                _most(pairs[a : b - 1])[0] / max(n - 1, 1),
                _most(triples[a : b - 2])[0] / max(n - 2, 1),
                distinct_lines / len(own_lines),
                top_line / len(own_lines),
                size[r] / len(own_lines),
                marked[a:b].mean(),
            )
        yield lo, hi, result


@dataclass
class Trees:
    """Complete trees in level order: split column and threshold of the inner nodes, values
    of the leaves, one line per tree."""

    column: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each line of statistics."""
        inner = self.column.shape[1]
        node = np.zeros((len(rows), len(self.column)), dtype=np.int64)
        tree = np.arange(len(self.column))
        line = np.arange(len(rows))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            right = rows[line, self.column[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        total = self.start + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def _best_splits(bins, gradient, weight, node, nodes):
    """For each node of a level the column and bin with the largest gain."""
    columns = bins.shape[1]
    cell = (node[:, None] * columns + np.arange(columns)) * BINS + bins
    shape = (nodes, columns, BINS)
    g = np.bincount(cell.ravel(), np.repeat(gradient, columns), nodes * columns * BINS).reshape(shape).cumsum(axis=2)
    h = np.bincount(cell.ravel(), np.repeat(weight, columns), nodes * columns * BINS).reshape(shape).cumsum(axis=2)
    all_g, all_h = g[:, :, -1:], h[:, :, -1:]
    gain = g**2 / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g**2 / (all_h + PENALTY)
    gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = 0
    flat = gain.reshape(nodes, -1)
    best = flat.argmax(axis=1)
    return best // BINS, best % BINS, flat[np.arange(nodes), best] > 1e-9


def train(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Fit to lines of statistics and labels 0 and 1."""
    inner = 2**DEPTH - 1
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        none = np.zeros((0, inner))
        return Trees(none.astype(np.int64), none, np.zeros((0, inner + 1)), start * 10 * bool(len(labels)))
    edges = np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    bins = np.stack([np.searchsorted(edges[:, c], rows[:, c]) for c in range(rows.shape[1])], axis=1)
    columns, thresholds, values = [], [], []
    total = np.full(len(labels), start)
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-total))
        gradient, weight = chance - labels, chance * (1 - chance)
        column, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(labels), dtype=np.int64)
        for level in range(DEPTH):
            nodes, first = 2**level, 2**level - 1
            split, cut, useful = _best_splits(bins, gradient, weight, node, nodes)
            # The last bin has no upper edge; such a split sends all rows left.
            useful &= cut < BINS - 1
            column[first : first + nodes] = split
            threshold[first : first + nodes] = np.where(useful, edges[np.minimum(cut, BINS - 2), split], np.inf)
            here = rows[np.arange(len(rows)), split[node]]
            node = 2 * node + (here > threshold[first + node])
        leaves = inner + 1
        value = -RATE * np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + PENALTY)
        total += value[node]
        columns.append(column)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(columns), np.array(thresholds), np.array(values), start)


def fold(name: str, parts: int) -> Column:
    """The crc32 of an id as text, modulo the number of folds."""
    return F.crc32(F.col(name).cast("bigint").cast("string").cast("binary")) % parts


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample of documents (doc_id, label 0 or 1)."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, lines in statistics_of(batch.column(0)):
                held = [column.slice(lo, hi - lo) for column in batch.columns[1:]]
                held.append(pa.array(list(lines), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(held, ["doc_id", "label", "line"])

    sample = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_ROWS)
    )
    found = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .select("text", "doc_id", "label")
        .mapInArrow(measure, "doc_id BIGINT, label INT, line ARRAY<DOUBLE>")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "line")
        .limit(SAMPLE_ROWS)
        .collect()
    )
    rows = np.array([r.line for r in found]).reshape(-1, len(STATISTICS))
    return rows, np.array([r.label for r in found], dtype=np.float64)


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """All documents: doc_id, score, predicted."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, lines in statistics_of(batch.column(1)):
                score = trees.score(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(score),
                        pa.array((score >= 0.5).astype(np.int32)),
                    ],
                    ["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(judge, "doc_id BIGINT, score DOUBLE, predicted INT")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the documents, all columns, that trees fitted to all labels (doc_id, quality)
    score 0.5 or more."""
    trees = train(*labelled_statistics(docs, labels.select("doc_id", F.col("quality").alias("label"))))
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, lines in statistics_of(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(trees.score(lines) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Train on labels (doc_id, quality) outside the held-out fold and score all documents:
    doc_id, held_out, score, predicted."""
    known = labels.where(fold("doc_id", folds) != held_out).select("doc_id", F.col("quality").alias("label"))
    trees = train(*labelled_statistics(docs, known))
    return scored(docs, trees).select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        "predicted",
    )

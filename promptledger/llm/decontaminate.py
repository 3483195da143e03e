"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Test items are cut into n-grams of two words, one after the other. One pass over the corpus
   counts them, words being up to two others apart, and each item keeps its rarest ones as
   seeds. How many follows from the least score (``seed_rule``): no passage of that score can
   do without so many of them, whatever was edited, left out or put in.
2. A second pass finds the seeds in the documents. They are joined with those of the items; a
   document that holds enough seeds of an item is held against it.
3. Around the n-grams they share, bounds that no alignment can exceed (``shared_words``,
   ``most_score``) drop what shares but common phrases. What is left is aligned with the item,
   word by word; case and ASCII punctuation do not count. The score is the best local
   alignment's, as a share of what the item scores against itself: match 2, mismatch -1, gap
   -1. Inserted, dropped and replaced words cost little, so edited and paraphrased copies
   score high, unrelated text with a few equal words low.

Items of up to three words must occur whole, as a part of them is a common phrase; so short
items have single words as seeds. Items travel as tables. Tasks carry a Bloom filter of the
n-grams of at most 32 MB; with more items than that suits it passes more, and the join drops
them. Equal texts are aligned once.

Result: one row per document and item with at least the least score, all such pairs. Null and
blank texts hold nothing. Items without words match nothing. Repeated documents or items each
report theirs. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptledger.llm.tables import stored
from promptledger.llm.textgrams import IS_MARK, PLACE, Words, mix, text_chunks

LEAST_SCORE = 0.5
#: Words of a text that may lie between the two of an n-gram.
MOST_BETWEEN = 2
#: Items of so many words must occur whole.
WHOLE_WORDS = 3
#: Seeds an item has beyond those it needs; a document must hold as many more.
MORE_SEEDS = 2
#: The Bloom filter has 2 to this power of bits at most, tested at these shifts of a hash.
MOST_FILTER_POWER = 28
FILTER_SHIFTS = (0, 9, 18, 27, 36)
MATCH, MISMATCH, GAP = 2, -1, -1


def plain_words(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Words without regard to case and ASCII punctuation, which copies often change."""
    return text_chunks(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), IS_MARK)


HIT_SCHEMA = "doc_id BIGINT, item_id BIGINT, score DOUBLE, first_word BIGINT, last_word BIGINT"
SEED_SCHEMA = "item BIGINT, words BINARY, place INT, gram BIGINT, most INT, least_seeds INT, pairs BOOLEAN"
PASSAGE_SCHEMA = "key BIGINT, key2 BIGINT, item BIGINT, score DOUBLE, first_word BIGINT, last_word BIGINT"


def needed(words: int, least: float) -> int:
    """The least alignment score of a passage of an item of so many words."""
    share = 1.0 if words <= WHOLE_WORDS else min(least, 1.0)
    return max(1, math.ceil(share * MATCH * words - 1e-9))


def seed_rule(words: int, least: float) -> tuple[bool, int, int]:
    """Whether an item of so many words has pairs or single words as seeds, how many seeds,
    and how many of them any passage of the least score holds.

    Words 0 and 1, 2 and 3 and so on make pairs. A pair that a passage lacks costs it at least
    3 of the item's own score: a mismatch or a left out word loses a match and 1, and three
    words put in between cost 1 each. At both ends a passage may stop within a pair, for 2. So
    a score of ``need`` leaves out at most (2 * words - need + 2) / 3 pairs. A single word left
    out costs 2. Where there are not enough pairs, single words are taken.
    """
    lost = MATCH * words - needed(words, least)
    pairs, missing = True, (lost + 2) // 3
    if missing + 1 > words // 2:
        pairs, missing = False, lost // MATCH
    seeds = min(words // 2 if pairs else words, missing + 1 + MORE_SEEDS)
    return pairs, seeds, seeds - missing


def gapped(hashes: np.ndarray, distance: int) -> np.ndarray:
    """Hashes of the two words at each place and so many words on; of one word for 0."""
    if not distance:
        return hashes
    return mix(hashes[:-distance] * PLACE[0] + hashes[distance:] * PLACE[1])


def own_grams(words: np.ndarray, pairs: bool) -> np.ndarray:
    """The n-grams of an item, by place."""
    return gapped(words, 1)[::2] if pairs else words


def _seeds(least: float):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            for lo, hi, found in plain_words(texts):
                for k in range(lo, hi):
                    words = found.hashes[found.bounds[k - lo] : found.bounds[k - lo + 1]]
                    if not len(words):
                        continue
                    pairs, most, least_seeds = seed_rule(len(words), least)
                    grams = own_grams(words, pairs)
                    # The words travel with the first of an item's rows only.
                    held = [words.astype("<u8").tobytes()] + [None] * (len(grams) - 1)
                    same = [keys[k].as_py(), most, least_seeds, pairs]
                    item, most, least_seeds, pairs = ([x] * len(grams) for x in same)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(item, pa.int64()),
                            pa.array(held, pa.binary()),
                            pa.array(np.arange(len(grams)), pa.int32()),
                            pa.array(grams.view(np.int64)),
                            pa.array(most, pa.int32()),
                            pa.array(least_seeds, pa.int32()),
                            pa.array(pairs),
                        ],
                        ["item", "words", "place", "gram", "most", "least_seeds", "pairs"],
                    )

    return cut


class Sieve:
    """A Bloom filter of n-grams, and the distances of words to look at."""

    def __init__(self, grams: DataFrame):
        """``grams`` has distinct ones and whether they are pairs."""
        facts = grams.agg(F.count("*"), F.bool_or("pairs"), F.bool_or(~F.col("pairs"))).first()
        bits = 1 << min(MOST_FILTER_POWER, max(10, (16 * facts[0]).bit_length()))
        place = F.array(*(F.shiftrightunsigned("gram", n).bitwiseAND(F.lit(bits - 1)) for n in FILTER_SHIFTS))
        held = (
            grams.select(F.explode(place).alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("held"))
            .toArrow()
        )
        self.held = np.zeros(bits >> 6, dtype=np.uint64)
        self.held[held["at"].to_numpy()] = held["held"].to_numpy().view(np.uint64)
        self.distances = [0] * bool(facts[2]) + [*range(1, MOST_BETWEEN + 2)] * bool(facts[1])

    def passing(self, values: np.ndarray) -> np.ndarray:
        """Positions of the values that may be in the filter."""
        at, mask = None, np.uint64((len(self.held) << 6) - 1)
        for shift in FILTER_SHIFTS:
            bit = (values >> np.uint64(shift)) & mask
            fine = np.flatnonzero(self.held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
            values, at = values[fine], fine if at is None else at[fine]
        return at

    def grams(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of the n-grams of texts that may be in the filter."""
        rows, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for distance in self.distances:
            hashes = gapped(words.hashes, distance)
            at = self.passing(hashes)
            row = np.searchsorted(words.bounds, at, side="right") - 1
            inside = at + distance < words.bounds[row + 1]
            rows.append(row[inside])
            grams.append(hashes[at[inside]])
        return np.concatenate(rows), np.concatenate(grams)


def _counted(docs: DataFrame, sieve: Sieve) -> DataFrame:
    """How often the corpus holds the n-grams: gram, held."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.grams(words)[1] for *_, words in plain_words(batch.column(0))]
            grams, held = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(held)], ["gram", "held"])

    rows = docs.select(_text()).mapInArrow(count, "gram BIGINT, held BIGINT")
    return rows.groupBy("gram").agg(F.sum("held").alias("held"))


def _found(docs: DataFrame, sieve: Sieve) -> DataFrame:
    """The n-grams that each distinct text may hold: key, key2, gram."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, key2, texts = batch.columns
            for lo, hi, words in plain_words(texts):
                rows, grams = shared.value.grams(words)
                rows = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays(
                    [key.take(rows), key2.take(rows), pa.array(grams.view(np.int64))], ["key", "key2", "gram"]
                )

    rows = docs.select(*_keys(_text()), _text().alias("text"))
    return rows.mapInArrow(find, "key BIGINT, key2 BIGINT, gram BIGINT").distinct()


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keys(text: Column) -> tuple[Column, Column]:
    """Two hashes that tell texts apart."""
    return F.xxhash64(text).alias("key"), F.xxhash64(F.lit("second"), text).alias("key2")


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: its share of the item's own score, first and last text word."""
    best, first, last = 0, 0, -1
    score = np.zeros(len(text) + 1, dtype=np.int64)
    begin = np.arange(len(text) + 1)
    steps = np.arange(len(text) + 1)
    for word in item:
        diagonal = score[:-1] + np.where(text == word, MATCH, MISMATCH)
        above = score[1:] + GAP
        now, origin = np.zeros_like(score), steps.copy()
        now[1:] = np.maximum(np.maximum(diagonal, above), 0)
        origin[1:] = np.where(
            now[1:] == 0, steps[1:], np.where(diagonal >= above, begin[:-1], begin[1:])
        )
        # Gaps along the text: the best earlier cell, less one per step.
        reach = now - GAP * steps
        top = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == top, steps, 0))
        gapped = top + GAP * steps
        longer = gapped > now
        score, begin = np.where(longer, gapped, now), np.where(longer, origin[source], origin)
        k = int(np.argmax(score))
        if score[k] > best:
            best, first, last = int(score[k]), int(begin[k]), k - 1
    return best / (MATCH * len(item)), first, last


def shared_words(known: np.ndarray, wanted: np.ndarray, text: np.ndarray) -> int:
    """Words in common with an item, given by its distinct words and how often it has each;
    a word counts as often as it occurs in both."""
    at = np.searchsorted(known, text)
    at[at == len(known)] = 0
    held = np.bincount(at[known[at] == text], minlength=len(known))
    return int(np.minimum(held, wanted).sum())


def most_score(known: np.ndarray, text: np.ndarray) -> int:
    """What no local alignment exceeds: every word of the text inside it is a match, or a
    mismatch or gap, and only words of the item can match."""
    total = np.zeros(len(text) + 1, dtype=np.int64)
    at = np.searchsorted(known, text)
    at[at == len(known)] = 0
    np.cumsum(np.where(known[at] == text, MATCH, max(MISMATCH, GAP)), out=total[1:])
    return int((total - np.minimum.accumulate(total)).max())


def _stretches(places: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Runs of places no further apart than the reach."""
    cuts = np.flatnonzero(np.diff(places) > reach) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(places, cuts)]


def best_passage(item: np.ndarray, text: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """Score, first and last word of the text's best passage of the item, if good enough."""
    need, (known, wanted) = needed(len(item), least), np.unique(item, return_counts=True)
    pairs, *_ = seed_rule(len(item), least)
    grams = np.unique(own_grams(item, pairs))
    places = [np.flatnonzero(np.isin(gapped(text, d), grams)) for d in (range(1, MOST_BETWEEN + 2) if pairs else [0])]
    places = np.unique(np.concatenate(places))
    if not len(places):
        return None
    # A passage has as many words as the item, and inserted ones that cost a gap each.
    reach = len(item) + MATCH * len(item) - need
    best = None
    for begin, end in _stretches(places, reach):
        begin, end = max(0, begin - reach), min(len(text), end + reach + MOST_BETWEEN + 2)
        part = text[begin:end]
        if MATCH * shared_words(known, wanted, part) < need or most_score(known, part) < need:
            continue  # no alignment scores more
        score, first, last = align(item, part)
        if score * MATCH * len(item) >= need - 1e-6 and (best is None or score > best[0]):
            best = score, begin + first, begin + last
    return best


def _aligned(pairs: DataFrame, least: float) -> DataFrame:
    """The passages among rows of key, key2, item, words and text."""

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, key2, item, held, texts = batch.columns
            rows, found = [], []
            for lo, hi, words in plain_words(texts):
                for k in range(lo, hi):
                    text = words.hashes[words.bounds[k - lo] : words.bounds[k - lo + 1]]
                    best = best_passage(np.frombuffer(held[k].as_py(), dtype="<u8"), text, least)
                    if best is not None:
                        rows.append(k)
                        found.append(best)
            rows = pa.array(rows, pa.int64())
            score, first, last = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    key.take(rows),
                    key2.take(rows),
                    item.take(rows),
                    pa.array(score, pa.float64()),
                    pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()),
                ],
                ["key", "key2", "item", "score", "first_word", "last_word"],
            )

    return pairs.select("key", "key2", "item", "words", "text").mapInArrow(report, PASSAGE_SCHEMA)


def rare_seeds(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """The rarest n-grams of each item, as many as ``seed_rule`` says. What counts is how many
    pairs of a text and an item a seed brings together."""
    held = grams.groupBy("gram").agg(F.bool_or("pairs").alias("pairs"), F.count("*").alias("items"))
    held = stored(held, "item-grams")
    counts = held.join(_counted(docs, Sieve(held)), "gram", "left")
    brought = counts.select("gram", (F.coalesce("held", F.lit(0)) * F.col("items")).alias("brought"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("brought", "place"))
    chosen = grams.drop("words").join(brought, "gram").withColumn("rank", rank).where("rank <= most")
    return stored(chosen.select("gram", "item", "place", "least_seeds", "pairs"), "seeds")


def _passages(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """The passages of distinct items (item, text) in distinct texts, stored."""
    grams = stored(items.select("item", "text").mapInArrow(_seeds(least), SEED_SCHEMA), "items")
    seeds = rare_seeds(docs, grams)
    sieve = Sieve(seeds.groupBy("gram").agg(F.bool_or("pairs").alias("pairs")))
    candidates = _found(docs, sieve).join(seeds, "gram").groupBy("key", "key2", "item").agg(
        F.count("*").alias("seeds"), F.max("least_seeds").alias("least_seeds")
    )
    candidates = stored(candidates.where("seeds >= least_seeds").select("key", "key2", "item"), "candidates")
    texts = docs.select(*_keys(_text()), _text().alias("text"))
    texts = texts.join(candidates.select("key", "key2").distinct(), ["key", "key2"], "left_semi")
    texts = texts.groupBy("key", "key2").agg(F.any_value("text").alias("text"))
    words = grams.where("words IS NOT NULL").select("item", "words")
    return stored(_aligned(candidates.join(words, "item").join(texts, ["key", "key2"]), least), "passages")


def _distinct_items(items: DataFrame) -> DataFrame:
    texts = items.select(_text().alias("text")).distinct()
    return stored(texts.select("text", F.monotonically_increasing_id().alias("item")), "item-texts")


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents that hold a passage of an item: doc_id, item_id, score, first_word and
    last_word (the passage's words in the document, from 0)."""
    texts = _distinct_items(items)
    found = _passages(docs, texts, least)
    ids = items.select(F.col("item_id").cast("bigint").alias("item_id"), _text().alias("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_keys(_text()))
    named = found.join(ids.join(texts, "text").select("item_id", "item"), "item")
    return rows.join(named, ["key", "key2"]).select("doc_id", "item_id", "score", "first_word", "last_word")


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of the documents, all columns, that hold no passage of an item."""
    leaks = _passages(docs, _distinct_items(items), least).select("key", "key2").distinct()
    key, key2 = _keys(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(leaks, (key == leaks["key"]) & (key2 == leaks["key2"]), "left_anti")

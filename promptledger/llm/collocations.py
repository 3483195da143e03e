"""Phrase collocations by stripes: each prefix keys an associative counter of next words.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``. Everything is counted per language.

1. A task turns a buffer of texts into stripes (language, prefix, {next word: count}), so a
   prefix leaves it once however often it occurs. The end of a piece counts as a next word.
2. Stripes of one prefix are merged elementwise, in sorted streams. A merged stripe gives the
   prefix's total, the counts of its extensions, and the largest of them.
3. Prefixes of one word give all words and word pairs; prefixes of two words the triples, and
   so on. Of a longer phrase both parts that lack an end word must be frequent. A filter of
   fixed size that holds all frequent phrases drops most others before the shuffle; what it
   lets through by mistake falls to the exact count.

Hot prefixes: a word with more than two of ``HOT_PARTS`` parts of all words is hot, and there
are at most ``HOT_PARTS`` hot words. The stripe of a prefix of hot words only is cut into
``SEGMENTS`` by a hash of the next word, each merged by itself. That moves work, not results.

A cut of a phrase after k words scores floor(scale * a * a / (l * r)) from the counts of the
phrase and of its two parts; the lowest cut counts. All arithmetic is on decimals of 38
digits, exact below 10^15 words. A phrase is covered, and dropped, if one that is a word
longer holds it and has the given share of its count; a still longer one has no more.

Result: rank, phrase, counts and score of the best phrases of each language. Null and empty
texts and texts without words hold nothing, a null language is ``und``. Repeated rows count
each. Equal scores: larger count, then phrase in byte order. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptledger.llm.tables import stored
from promptledger.llm.textgrams import FOLDED, PLACE, Words, byte_chunks, mix, span_hashes

UNKNOWN = "und"
MOST_WORDS = 3
LEAST_COUNT = 10
#: Percent of a phrase's count that covers it.
COVERED = 50
SCALE = 1_000_000
BEST = 2_000
#: Bytes of text that a task turns into stripes at a time; a longer text is taken alone.
BUFFER_BYTES = 8 << 20
#: Entries of stripes merged at a time, and rows handed over together.
MERGED_ENTRIES = 1_000_000
ROWS = 20_000
HOT_PARTS = 1_024
SEGMENTS = 64
#: Bits of the filter of frequent phrases, two for each phrase: 16 MB at any size.
FILTER_BITS = 1 << 27
#: Parts that a language's candidates are ranked in before the last ranking.
RANK_PARTS = 64

_CODES = np.arange(256)
_ENDS_PIECE = np.isin(_CODES, [*b".,;:!?", *range(0x0A, 0x0E)])
_PARTS_WORDS = _ENDS_PIECE | np.isin(_CODES, [0x20, 0x09])

#: A stripe travels as its next words, parted by blanks, and their counts, 64 bits each. An
#: empty next word is the end of the piece.
STRIPE_SCHEMA = "prefix STRING, lang STRING, segment INT, nexts STRING, counts BINARY"
MERGED_SCHEMA = "lang STRING, prefix STRING, total BIGINT, nexts ARRAY<STRING>, counts ARRAY<BIGINT>"


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of strings, and the offsets of each in them; nulls are empty."""
    values = values.cast(pa.large_string()).fill_null("")
    _, raw_offsets, raw = values.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Sequence:
    """The words of many texts in a row, as codes of a dictionary. Bytes are read in short
    runs, so only what is kept for each word grows with the texts."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        tags = langs.cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
        self.lang_names = tags.dictionary
        tag = tags.indices.to_numpy().astype(np.int64)
        hashes, sizes, letters, of_lang, goes_on = [], [], [], [], []
        for lo, hi, data, offsets in byte_chunks(texts):
            words = Words(data, offsets, _PARTS_WORDS)
            many = np.diff(words.bounds)
            piece = np.cumsum(_ENDS_PIECE[data], dtype=np.int32)
            text = np.repeat(np.arange(hi - lo), many)
            on = np.zeros(len(words.starts), bool)
            on[:-1] = (piece[words.starts[1:]] == piece[words.starts[:-1]]) & (text[1:] == text[:-1])
            hashes.append(words.hashes)
            sizes.append(words.ends - words.starts)
            letters.append(FOLDED[data[~_PARTS_WORDS[data]]])
            of_lang.append(np.repeat(tag[lo:hi], many))
            goes_on.append(on)
        if not sizes:
            hashes, sizes, letters, of_lang, goes_on = ([np.zeros(0, t)] for t in (np.uint64, np.int64, np.uint8, np.int64, bool))
        self.hashes, self.langs = np.concatenate(hashes), np.concatenate(of_lang)
        #: Whether the next word belongs to the same piece.
        self.goes_on = np.concatenate(goes_on)
        bounds = np.concatenate([[0], *sizes]).cumsum()
        held = pa.Array.from_buffers(
            pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.concatenate(letters))]
        ).dictionary_encode()
        self.dictionary = held.dictionary.cast(pa.string())
        self.codes = held.indices.to_numpy().astype(np.int64)

    def first_places(self) -> np.ndarray:
        """A place of each word of the dictionary."""
        places = np.zeros(len(self.dictionary), np.int64)
        places[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
        return places


def combined(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of the language and of the words in order."""
    total = langs.copy()
    for k, hashes in enumerate(words):
        total += hashes * PLACE[k]
    return mix(total)


def _span_hashes(values: pa.Array) -> np.ndarray:
    """A hash of each whole string, whatever it holds."""
    data, offsets = bytes_of(values)
    return span_hashes(data, offsets[:-1], offsets[1:], FOLDED)


def places_of(hashes: np.ndarray) -> list[np.ndarray]:
    """The two bits of the filter that stand for each phrase."""
    low = hashes & np.uint64(FILTER_BITS - 1)
    return [low, (hashes >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)]


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each phrase; true for all that it does hold."""
    found = np.ones(len(hashes), bool)
    for at in places_of(hashes):
        found &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def stripes_of(words: Sequence, prefix_words: int, hot: pa.Array, bitmap: np.ndarray | None) -> pa.Table:
    """The stripes of a buffer for prefixes of so many words."""
    end = len(words.dictionary)
    whole = np.ones(len(words.codes), bool)
    for k in range(prefix_words - (bitmap is None)):
        goes_on = np.zeros(len(whole), bool)
        goes_on[: max(0, len(whole) - k)] = words.goes_on[k:]
        whole &= goes_on
    at = np.flatnonzero(whole)
    if bitmap is not None:
        tags = _span_hashes(words.lang_names)[words.langs[at]]
        spelled = [words.hashes[at + k] for k in range(prefix_words + 1)]
        likely = may_hold(bitmap, combined(tags, spelled[:-1])) & may_hold(bitmap, combined(tags, spelled[1:]))
        at = at[likely]
        following = words.codes[at + prefix_words]
    else:
        last = at + prefix_words - 1
        following = np.full(len(at), end)
        on = words.goes_on[last]
        following[on] = words.codes[last[on] + 1]
    prefix = words.langs[at] * end + words.codes[at]
    for k in range(1, prefix_words):
        prefix = np.unique(prefix, return_inverse=True)[1] * end + words.codes[at + k]
    if prefix_words > 1:  # numbered, so that entries fit into 64 bits
        _, first, prefix = np.unique(prefix, return_index=True, return_inverse=True)
    entries, counts = np.unique(prefix * (end + 1) + following, return_counts=True)
    prefix, following = np.divmod(entries, end + 1)
    if prefix_words > 1:
        place = at[first][prefix]
        tag, spelled = words.langs[place], [words.codes[place + k] for k in range(prefix_words)]
    else:
        tag, spelled = prefix // max(end, 1), [prefix % max(end, 1)]
    is_hot = np.append(pc.is_in(words.dictionary, hot).to_numpy(zero_copy_only=False), False).astype(bool)
    all_hot = np.ones(len(entries), bool)
    for codes in spelled:
        all_hot &= is_hot[codes]
    segment = np.zeros(len(entries), np.int32)
    order = np.arange(len(entries))
    if all_hot.any():
        spread = np.append(words.hashes[words.first_places()] % np.uint64(SEGMENTS), 0).astype(np.int32) + 1
        segment[all_hot] = spread[following[all_hot]]
        order = np.lexsort((segment, prefix))
    prefix, following, counts, segment = prefix[order], following[order], counts[order], segment[order]
    begins = np.ones(len(entries), bool)
    begins[1:] = (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])
    rows = np.flatnonzero(begins)
    bounds = np.append(rows, len(entries))
    texts = [words.dictionary.take(pa.array(codes[order[rows]])) for codes in spelled]
    return pa.table(
        {
            "prefix": pc.binary_join_element_wise(*texts, " ") if prefix_words > 1 else texts[0],
            "lang": words.lang_names.take(pa.array(tag[order[rows]])),
            "segment": segment[rows],
            **travelling(pa.concat_arrays([words.dictionary, pa.array([""])]).take(pa.array(following)), counts, bounds),
        }
    )


def travelling(nexts: pa.Array, counts: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
    """Stripes as columns: the next words and counts between each two bounds."""
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), nexts)
    raw = pa.py_buffer(np.ascontiguousarray(counts, np.int64))
    offsets = pa.py_buffer((8 * bounds).astype(np.int32))
    return {
        "nexts": pc.binary_join(lists, " "),
        "counts": pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, raw]),
    }


def arrived(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The next words and counts of stripes, and the bounds of each stripe's."""
    lists = pc.split_pattern(rows["nexts"].combine_chunks(), " ")
    raw = rows["counts"].combine_chunks()
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    counts = np.frombuffer(raw.buffers()[2], np.int64)[offsets[0] // 8 : offsets[-1] // 8]
    return lists.flatten(), counts, (offsets - offsets[0]) // 8


def buffers(batches: Iterable[pa.RecordBatch]) -> Iterator[Sequence]:
    """The words of runs of rows (text, lang) of bounded bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False)
        lo = 0
        for hi in range(1, len(lengths) + 1):
            size += int(lengths[hi - 1])
            if size >= BUFFER_BYTES:
                held.append(batch.slice(lo, hi - lo))
                yield _sequence(held)
                held, size, lo = [], 0, hi
        if lo < len(lengths):
            held.append(batch.slice(lo))
    if held:
        yield _sequence(held)


def _sequence(held: list[pa.RecordBatch]) -> Sequence:
    texts = [batch.column(0).cast(pa.large_string()) for batch in held]
    langs = [batch.column(1).cast(pa.large_string()) for batch in held]
    return Sequence(pa.concat_arrays(texts), pa.concat_arrays(langs))


def merge(rows: pa.Table) -> pa.Table:
    """Add up the stripes of equal keys, elementwise; equal keys stand together."""
    if rows.num_rows == 0:
        return rows
    rows = rows.combine_chunks()
    changes = np.zeros(rows.num_rows, bool)
    changes[0] = True
    for name in ("lang", "prefix", "segment"):
        column = rows[name].combine_chunks()
        changes[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    group = np.cumsum(changes) - 1
    nexts, counts, bounds = arrived(rows)
    words = nexts.dictionary_encode()
    width = max(1, len(words.dictionary))
    key = np.repeat(group, np.diff(bounds)) * width + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(begins)
    owner, code = np.divmod(key[at], width)
    kept = rows.select(["prefix", "lang", "segment"]).take(pa.array(np.flatnonzero(changes)))
    merged = travelling(
        words.dictionary.take(pa.array(code)),
        np.add.reduceat(counts[order], at),
        np.searchsorted(owner, np.arange(group[-1] + 2)),
    )
    for name, column in merged.items():
        kept = kept.append_column(name, column)
    return kept


def _frequent_part(rows: pa.Table, totals: bool) -> Iterator[pa.RecordBatch]:
    """Of merged stripes the totals and the extensions that are frequent. Rare words are
    left out, but for their sum."""
    if rows.num_rows == 0:
        return
    nexts, flat, bounds = arrived(rows)
    total = np.diff(np.concatenate([[0], np.cumsum(flat)])[bounds])
    extends = (flat >= LEAST_COUNT) & pc.not_equal(nexts, "").to_numpy(zero_copy_only=False)
    many = np.concatenate([[0], np.cumsum(extends)])[bounds]
    segment = rows["segment"].to_numpy()
    stays = np.diff(many) > 0
    if totals:
        stays |= (total >= LEAST_COUNT) | (segment > 0)
    inside = pa.array(np.flatnonzero(extends & np.repeat(stays, np.diff(bounds))))
    at = pa.array(np.flatnonzero(stays))
    kept_bounds = np.concatenate([[0], np.cumsum(np.diff(many)[stays])]).astype(np.int32)
    out = pa.table(
        {
            "lang": rows["lang"].combine_chunks().take(at),
            "prefix": rows["prefix"].combine_chunks().take(at),
            "total": total[stays],
            "nexts": pa.ListArray.from_arrays(pa.array(kept_bounds), nexts.take(inside)),
            "counts": pa.ListArray.from_arrays(pa.array(kept_bounds), pa.array(flat).take(inside)),
        }
    )
    yield from out.to_batches(ROWS)
    if totals and not stays.all():
        rest = pa.table({"lang": rows["lang"], "total": total}).filter(pa.array(~stays))
        rest = rest.group_by("lang").aggregate([("total", "sum")])
        empty = pa.array([[]] * rest.num_rows, pa.list_(pa.string()))
        yield from pa.table(
            {
                "lang": rest["lang"],
                "prefix": pa.nulls(rest.num_rows, pa.string()),
                "total": rest["total_sum"],
                "nexts": empty,
                "counts": empty.cast(pa.list_(pa.int64())),
            }
        ).to_batches()


def merged_streams(batches: Iterable[pa.RecordBatch], totals: bool) -> Iterator[pa.RecordBatch]:
    """Merge stripes that come sorted by key. Only the last key's may go on."""
    held: list[pa.RecordBatch] = []
    entries = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        entries += batch.column(4).nbytes // 8
        if entries >= MERGED_ENTRIES:
            done = merge(pa.Table.from_batches(held))
            yield from _frequent_part(done.slice(0, done.num_rows - 1), totals)
            held, entries = done.slice(done.num_rows - 1).combine_chunks().to_batches(), 0
    if held:
        yield from _frequent_part(merge(pa.Table.from_batches(held)), totals)


def hot_words(rows: DataFrame) -> list[str]:
    """Words with a large share of all words, of any language: all above two of
    ``HOT_PARTS`` parts, none below one, hence at most ``HOT_PARTS``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in buffers(batches):
            many = np.bincount(words.codes, minlength=len(words.dictionary))
            at = np.flatnonzero(many * HOT_PARTS >= len(words.codes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([words.dictionary.take(pa.array(at)), pa.nulls(1, pa.string())]),
                    pa.array(np.append(many[at], len(words.codes)).astype(np.int64)),
                ],
                ["word", "n"],
            )

    counted = rows.mapInArrow(count, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "hot-words")
    total = counted.where("word IS NULL").agg(F.sum("n").alias("n")).first().n
    found = counted.where("word IS NOT NULL").where(F.col("n") >= F.lit((total or 0) / HOT_PARTS))
    return [r.word for r in found.collect()]


def filter_of(frequent: DataFrame, words: int) -> np.ndarray:
    """The bitmap of all frequent phrases (lang, phrase) of so many words: its 64-bit parts
    are ORed in Spark, at most ``FILTER_BITS`` / 64 rows arrive."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = Sequence(batch.column(1), batch.column(0))
            lines = spelled.hashes.reshape(-1, words)
            tags = _span_hashes(spelled.lang_names)[spelled.langs[::words]]
            for at in places_of(combined(tags, [lines[:, k] for k in range(words)])):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

    bits = (
        frequent.select("lang", "phrase")
        .mapInArrow(hashed, "at BIGINT")
        .groupBy(F.shiftright("at", 6).alias("part"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[bits["part"].to_numpy()] = bits["bits"].to_numpy()
    return bitmap.view(np.uint8)


def merged_stripes(rows: DataFrame, prefix_words: int, hot: list[str], bitmap: np.ndarray | None) -> DataFrame:
    """Merged stripes (lang, prefix, total, frequent nexts, their counts) of all texts. The
    total is that of the prefix for single words only."""
    context = rows.sparkSession.sparkContext
    known = context.broadcast((hot, None if bitmap is None else bitmap.tobytes()))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_list, raw = known.value
        hot_array = pa.array(hot_list, pa.string())
        bits = None if raw is None else np.frombuffer(raw, np.uint8)
        for words in buffers(batches):
            if len(words.codes):
                yield from stripes_of(words, prefix_words, hot_array, bits).to_batches(ROWS)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged_streams(batches, bitmap is None)

    key = ("prefix", "lang", "segment")
    dealt = rows.mapInArrow(cut, STRIPE_SCHEMA).repartition(*key).sortWithinPartitions(*key)
    return stored(dealt.mapInArrow(add, MERGED_SCHEMA), f"stripes-{prefix_words}")


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """Frequent phrases of one to ``most_words`` words of documents (text, lang): lang, phrase,
    words, n. The row without a phrase holds the number of all words of a language."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    hot = hot_words(rows)
    stripes = merged_stripes(rows, 1, hot, None)
    single = stripes.groupBy("lang", "prefix").agg(F.sum("total").alias("n"))
    found = [
        single.where(F.col("n") >= LEAST_COUNT).where("prefix IS NOT NULL").select("lang", F.col("prefix").alias("phrase"), F.lit(1).alias("words"), "n"),
        single.groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("words"), "n"),
    ]
    for words in range(2, most_words + 1):
        longer = stripes.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e")).select(
            "lang", F.concat_ws(" ", "prefix", "e.nexts").alias("phrase"), F.lit(words).alias("words"), F.col("e.counts").alias("n")
        )
        found.append(longer)
        if words < most_words:
            stripes = merged_stripes(rows, words, hot, filter_of(longer, words))
    return stored(reduce(DataFrame.unionAll, found), "phrase-counts")


def candidates(counts: DataFrame) -> DataFrame:
    """Phrases of two words and more that no longer one covers, with their lowest cut:
    lang, phrase, a, l, r, score."""
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    parts = counts.where("words >= 1").select("lang", F.col("phrase").alias("part"), "n")
    split = phrases.withColumn("spelled", F.split("phrase", " ", -1))
    shorter = split.where("words >= 3").select(
        "lang",
        F.col("a").alias("longer"),
        F.explode(
            F.array(
                F.concat_ws(" ", F.slice("spelled", F.lit(1), F.col("words") - 1)),
                F.concat_ws(" ", F.slice("spelled", F.lit(2), F.col("words") - 1)),
            )
        ).alias("phrase"),
    )
    widest = shorter.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    bare = split.join(widest, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * COVERED)
    )
    cuts = bare.select(
        "lang",
        "phrase",
        "a",
        F.posexplode(
            F.expr(
                "transform(sequence(1, words - 1), k -> struct("
                "concat_ws(' ', slice(spelled, 1, k)) AS left, "
                "concat_ws(' ', slice(spelled, k + 1, words - k)) AS right))"
            )
        ).alias("k", "part"),
    ).select("lang", "phrase", "a", "k", "part.left", "part.right")
    counted = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("part").alias("right"), F.col("n").alias("r")), ["lang", "right"]
    )
    wide = {name: F.col(name).cast("decimal(15,0)") for name in ("a", "l", "r")}
    product = (wide["a"] * wide["a"]) * F.lit(SCALE).cast("decimal(7,0)")
    scored = counted.withColumn("_above", product).withColumn("_below", wide["l"] * wide["r"])
    scored = scored.withColumn("score", F.expr("_above div _below").cast("bigint"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, best: int = BEST) -> DataFrame:
    """The best phrases of each language of documents (text, lang): lang, rank, phrase, a, l,
    r, n, score."""
    counts = phrase_counts(docs)
    found = candidates(counts).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language may hold all candidates: ranked in parts first, the best of each once more.
    ahead = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = (
        found.withColumn("_ahead", ahead)
        .where(F.col("_ahead") <= best)
        .withColumn("rank", last.cast("bigint"))
        .where(F.col("rank") <= best)
    )
    everything = counts.where("words = 0").select("lang", "n")
    return ranked.join(everything, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

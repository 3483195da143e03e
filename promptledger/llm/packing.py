"""Best-fit packing of tokenised documents into sequences of bounded length.

A document's ids end with an end id. Only documents above the capacity are cut: all pieces
but the first have exactly the capacity. Pieces of the capacity fill a sequence alone and are
numbered where they are. The other pieces are dealt by a hash of their place in the table,
whatever their ids, into groups of bounded size, whose mixture of lengths is alike; each group
is packed by itself, which can waste less than one sequence per group.

Within a group best fit places the pieces by falling length. A local search then empties
the least full sequence: it moves a piece out, exchanges one piece for a smaller one, one
for two smaller in sum, or two for one smaller than both. If none of the least full ones can
be emptied, they exchange pieces among themselves to make some fuller. Each step increases
the sum of squared fills, so the search ends.

Result: one row per piece. Null and empty texts hold the end id only. Repeated rows are
packed as often as they occur. An empty table gives an empty result. Other columns of the
documents are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.tables import stored
from promptledger.llm.tokens import token_chunks

CAPACITY = 2048
END_ID = 0
#: The search tries to empty so many of the least full sequences, and lets them exchange
#: pieces among themselves so many times, before it stops.
TRIES = 8
ROUNDS = 6
#: Pieces that one task packs together.
GROUP_PIECES = 16_384

PIECE_SCHEMA = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"


def token_pieces(
    docs: DataFrame,
    path: str,
    keeps_blanks: bool = True,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as an array."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.columns
            for lo, hi, ids, bounds in token_chunks(texts, path, keeps_blanks):
                rows, piece, start, length, crc, held = [], [], [], [], [], []
                for r in range(hi - lo):
                    own = np.append(ids[bounds[r] : bounds[r + 1]], np.uint32(end_id)).astype("<u4")
                    at, end = 0, len(own) - capacity * ((len(own) - 1) // capacity)
                    while at < len(own):
                        rows.append(r)
                        piece.append(0 if at == 0 else piece[-1] + 1)
                        start.append(at)
                        length.append(end - at)
                        crc.append(zlib.crc32(own[at:end]))
                        if with_ids:
                            held.append(own[at:end].astype(np.int64))
                        at, end = end, end + capacity
                columns = [
                    doc_ids.slice(lo, hi - lo).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(v, pa.int64()) for v in (start, length, crc)),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, PIECE_SCHEMA + (", ids ARRAY<BIGINT>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: items by falling length, each into the fullest bin it fits."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin has room r
    count = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        above = rooms >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, count = capacity, count, count + 1
        bins[item] = chosen
        with_room[room - length].append(chosen)
        rooms |= 1 << (room - length)
    return bins


class _Search:
    """Local search that empties underfull bins one by one."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)
        self.pool = np.flatnonzero(self.fill[bins] < capacity)

    def put(self, item: int, target: int) -> None:
        self.fill[self.bins[item]] -= self.lengths[item]
        self.fill[target] += self.lengths[item]
        self.bins[item] = target

    def run(self) -> None:
        spare = int((self.capacity - self.fill[self.fill > 0]).sum())
        stuck: set[int] = set()
        rounds = 0
        while spare >= self.capacity and rounds < ROUNDS:
            used = [b for b in self.least_full(TRIES) if b not in stuck]
            if used:
                if self.empty(used[0]):
                    spare -= self.capacity
                    stuck.clear()
                else:
                    stuck.add(used[0])
            elif self.fill_up():
                stuck.clear()
                rounds += 1
            else:
                return

    def least_full(self, count: int) -> list[int]:
        """The least full of the bins that are neither empty nor full."""
        used = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        return used[np.argsort(self.fill[used], kind="stable")][:count].tolist()

    def fill_up(self) -> bool:
        """Exchange one for one between the least full bins while that makes any fuller."""
        bins, lengths, fill = self.bins, self.lengths, self.fill
        changed = False
        for target in reversed(self.least_full(TRIES)):
            low = self.least_full(TRIES)
            items = self.pool[np.isin(bins[self.pool], low)]
            own, other = items[bins[items] == target], items[bins[items] != target]
            if not len(own) or not len(other):
                continue
            more = lengths[other] - lengths[own][:, None]
            better = (more > 0) & (more <= self.capacity - fill[target]) & (fill[target] + more > fill[bins[other]])
            if better.any():
                i, j = np.unravel_index(np.argmax(np.where(better, more, 0)), more.shape)
                giver = int(bins[other[j]])
                self.put(own[i], giver)
                self.put(other[j], target)
                changed = True
        return changed

    def empty(self, victim: int) -> bool:
        """Whether steps that each leave less in the bin have emptied it."""
        while self.fill[victim]:
            if not self.step(victim):
                return False
        return True

    def step(self, victim: int) -> bool:
        lengths, bins, fill = self.lengths, self.bins, self.fill
        self.pool = self.pool[fill[bins[self.pool]] < self.capacity]
        own = self.pool[bins[self.pool] == victim]
        own = own[np.argsort(-lengths[own], kind="stable")]
        other = self.pool[bins[self.pool] != victim]
        room = self.capacity - fill
        open_bins = np.unique(bins[other])
        if not len(open_bins):
            return False
        for item in own:  # move
            fits = open_bins[room[open_bins] >= lengths[item]]
            if len(fits):
                self.put(item, fits[np.argmin(room[fits])])
                return True
        ceiling = lengths[other] + room[bins[other]]
        best, plan = 0, None
        for item in own:  # one for one
            gain = np.where(ceiling >= lengths[item], lengths[item] - lengths[other], 0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, plan = int(gain[k]), ([item], [other[k]])
        for a in range(len(own)):  # two for one
            for b in range(a + 1, len(own)):
                both = lengths[own[a]] + lengths[own[b]]
                gain = np.where(ceiling >= both, both - lengths[other], 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, plan = int(gain[k]), ([own[a], own[b]], [other[k]])
        if plan is None:  # one for two of one bin, neighbours by length
            plan = self.one_for_two(own, other, room)
        if plan is None:
            return False
        target = int(bins[plan[1][0]])
        for item in plan[1]:
            self.put(item, victim)
        for item in plan[0]:
            self.put(item, target)
        return True

    def one_for_two(self, own, other, room):
        lengths, bins = self.lengths, self.bins
        order = other[np.lexsort((lengths[other], bins[other]))]
        for distance in (1, 2, 3):
            first, second = order[:-distance], order[distance:]
            together = bins[first] == bins[second]
            pair = lengths[first] + lengths[second]
            for item in own:
                fits = together & (pair < lengths[item]) & (lengths[item] - pair <= room[bins[first]])
                if fits.any():
                    k = int(np.argmax(np.where(fits, lengths[item] - pair, 0)))
                    return [item], [first[k], second[k]]
        return None


def packed_bins(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item, none above the capacity, numbered from 0 without gaps."""
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    bins = best_fit(lengths, capacity)
    _Search(lengths, bins, capacity).run()
    return np.unique(bins, return_inverse=True)[1]


def pack(pieces: DataFrame, groups: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length, best of a stored
    table, as they are read twice. Without a number of groups they are of bounded size."""
    names = pieces.columns
    short = pieces.where(F.col("length") < capacity)
    if groups is None:
        groups = max(1, -(-short.count() // GROUP_PIECES))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        bins = packed_bins(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, np.diff(bins[order]) > 0]
        offset = np.empty(len(bins), dtype=np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        group = table["pack_group"].to_numpy()
        return pa.table(
            [table[c] for c in names] + [pa.array((group << 32) + bins), pa.array(offset)],
            [*names, "sequence_id", "offset"],
        )

    schema = [f"{name} {kind}" for name, kind in pieces.dtypes] + ["sequence_id BIGINT", "offset BIGINT"]
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    together = (
        short.select(*names, dealt.alias("pack_group")).groupBy("pack_group").applyInArrow(place, ", ".join(schema))
    )
    whole = pieces.where(F.col("length") >= capacity)
    # Groups count from 0; below it is room for the sequences of one piece.
    alone = whole.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return together.unionAll(alone)


def pack_documents(docs: DataFrame, path: str, keeps_blanks: bool = True) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(token_pieces(docs, path, keeps_blanks), "token-pieces"))


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence in order, from packed pieces that carry their ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")
    )

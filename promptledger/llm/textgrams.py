"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D`` of the UTF-8 text,
with A-Z lower-cased. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed in one go; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


#: Bytes as they are, and with A-Z lower-cased.
AS_IS = np.arange(256, dtype=np.uint8)
FOLDED = np.where((AS_IS >= ord("A")) & (AS_IS <= ord("Z")), AS_IS + 32, AS_IS).astype(np.uint8)
IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: All ASCII characters but letters and digits.
IS_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Multipliers that make the hash of a word sequence depend on the order.
PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)


#: The first bytes of a little-endian block of eight.
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the byte spans of ``data``; ``fold`` gives each byte another one to count as.

    The blocks of eight bytes of a span are mixed with their places, one by one, before they
    are added, so no regular pattern of bytes makes sums equal as it does for polynomials.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    held = np.zeros(len(data) + 8, dtype=np.uint8)
    held[: len(data)] = fold[data]
    block_at = np.ndarray(len(data) + 1, dtype="<u8", buffer=held, strides=(1,))
    lengths = ends - starts
    many = (lengths + 7) >> 3
    begin = np.cumsum(many) - many
    owner = np.repeat(np.arange(len(starts)), many)
    place = np.arange(len(owner)) - begin[owner]
    value = block_at[starts[owner] + 8 * place] & _FIRST_BYTES[np.minimum(lengths[owner] - 8 * place, 8)]
    value = mix(mix(value + np.uint64(salt)) ^ ((place + 1).astype(np.uint64) * _GAMMA))
    total = np.zeros(len(starts), dtype=np.uint64)
    filled = many > 0
    if filled.any():
        total[filled] = np.add.reduceat(value, begin[filled])
    return mix(total ^ (lengths.astype(np.uint64) * _GAMMA))


class Words:
    """Words of consecutive texts. ``bounds[r]:bounds[r + 1]`` are those of text ``r``;
    ``starts`` and ``ends`` are byte positions in ``data``, ``bases`` those of the texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_BLANK):
        inside = ~blank[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets[:-1]] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.data = data
        self.bases = offsets
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(data, self.starts, self.ends, FOLDED)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows, by first word, and which lie within one text."""
        count = max(0, len(self.hashes) - n + 1)
        total = np.zeros(count, dtype=np.uint64)
        for k in range(n):
            total += self.hashes[k : k + count] * PLACE[k]
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))[:count]
        return mix(total), np.arange(count) + n <= last

    def shingle_sets(self, n: int) -> Iterator[np.ndarray]:
        """For each text the sorted distinct hashes of its n-word windows; a text of
        fewer words has its whole sequence as one, a text without words none."""
        grams, _ = self.grams(n)
        for lo, hi in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                placed = self.hashes[lo:hi] * PLACE[: hi - lo]
                yield mix(placed.sum(dtype=np.uint64, keepdims=True) ^ PLACE[hi - lo])
            else:
                yield np.zeros(0, dtype=np.uint64)


def byte_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of rows of bounded bytes: first row, end row, UTF-8
    bytes, offsets of the rows in them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        part = data[offsets[lo] : offsets[hi]]
        yield lo, hi, part, offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def text_chunks(texts: pa.Array, blank: np.ndarray = IS_BLANK) -> Iterator[tuple[int, int, Words]]:
    """The words of runs of rows of bounded bytes: first row, end row, words. ``blank``
    tells which bytes part words."""
    for lo, hi, data, offsets in byte_chunks(texts):
        yield lo, hi, Words(data, offsets, blank)

"""Token ids of whole texts by a public tokenizer, one library call per distinct piece.

A text is cut only where no token can cross: before blanks that follow other characters,
and between a letter or digit and ASCII punctuation. The ids of a piece then do not depend
on what surrounds it, so repeated pieces are looked up by a 64-bit hash, and a second one of
64 bits tells whether it is the same piece; where it is not, the texts are encoded by the
library as they are. Vocabulary files are named by a path and never copied. Null texts count as empty. Strings of special tokens
in a text become their ids, as the library does by default; none may contain a blank.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from promptledger.llm.textgrams import AS_IS, byte_chunks, span_hashes

#: Distinct pieces, and ids of them, that a worker remembers; beyond it starts anew.
MEMORY_PIECES = 2_000_000
MEMORY_IDS = 16_000_000

_CODES = np.arange(256)
_BLANK = np.isin(_CODES, [0x20, 0x0A, 0x09, 0x0D])
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in _CODES])
_PUNCT = np.array([0x21 <= c < 0x7F and not chr(c).isalnum() and chr(c) != "'" for c in _CODES])
#: Control characters that some patterns take for white space.
_CONTROL = _CODES < 0x20
_SECOND = 0x9FB21C651E98DF25


def _before(data: np.ndarray, steps: int) -> np.ndarray:
    """The byte that many places earlier; 0 before the start."""
    moved = np.zeros_like(data)
    moved[steps:] = data[:-steps] if steps else data
    return moved


def _letter_ends(data: np.ndarray) -> np.ndarray:
    """Where an ASCII letter or digit, or a Latin letter of two bytes, ends."""
    lead = _before(data, 1)
    two = (lead >= 0xC3) & (lead <= 0xC9) & (data >= 0x80) & (data < 0xC0)
    signs = (lead == 0xC3) & ((data == 0x97) | (data == 0xB7))
    # The lower case of U+0130 ends with a mark, which is no letter.
    dotted = (lead == 0xC4) & (data == 0xB0)
    return _ALNUM[data] | (two & ~signs & ~dotted)


def _wide_blank_ends(data: np.ndarray) -> np.ndarray:
    """Where white space of several bytes may end; some other characters are included."""
    one, two = _before(data, 1), _before(data, 2)
    return (
        ((one == 0xC2) & ((data == 0x85) | (data == 0xA0)))
        | ((two == 0xE2) & ((one == 0x80) | (one == 0x81)))
        | ((two == 0xE1) & (one == 0x9A))
        | ((two == 0xE3) & (one == 0x80))
    )


def piece_spans(
    data: np.ndarray, offsets: np.ndarray, keeps_blanks: bool, punct: np.ndarray = _PUNCT
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces; without ``keeps_blanks`` blanks belong to none."""
    size = len(data)
    if size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = _BLANK[data]
    ended = _letter_ends(data)
    cut = np.zeros(size + 1, dtype=bool)
    if keeps_blanks:
        open_end = blank | _CONTROL[data] | _wide_blank_ends(data)
        cut[1:size] = blank[1:] & ~open_end[:-1]
    else:
        cut[1:size] = blank[1:] != blank[:-1]
    cut[1:size] |= punct[data[1:]] & ended[:-1]
    cut[offsets] = True
    cut[size] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], size)
    if not keeps_blanks:
        solid = ~blank[starts]
        starts, ends = starts[solid], ends[solid]
    return starts, ends


class PieceTokenizer:
    """``keeps_blanks``: whether the vocabulary has tokens for white space."""

    def __init__(self, path: str, keeps_blanks: bool):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._keeps_blanks = keeps_blanks
        # Special tokens must not be cut.
        self._punct = _PUNCT.copy()
        for special in self._library.get_added_tokens_decoder().values():
            for a, b in zip(special.content, special.content[1:], strict=False):
                if a.isalnum() and ord(b) < 128:
                    self._punct[ord(b)] = False
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._seconds = np.zeros(0, np.uint64)
        self._firsts = np.zeros(0, np.int64)
        self._counts = np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, seconds: np.ndarray, pieces: list[str]) -> None:
        found = [e.ids for e in self._library.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
        firsts = len(self._flat) + np.cumsum(counts) - counts
        at = np.searchsorted(self._hashes, hashes)
        self._hashes = np.insert(self._hashes, at, hashes)
        self._seconds = np.insert(self._seconds, at, seconds)
        self._firsts = np.insert(self._firsts, at, firsts)
        self._counts = np.insert(self._counts, at, counts)
        self._flat = np.concatenate([self._flat, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and the bounds of each text's ids in them."""
        starts, ends = piece_spans(data, offsets, self._keeps_blanks, self._punct)
        hashes = span_hashes(data, starts, ends, AS_IS)
        seconds = span_hashes(data, starts, ends, AS_IS, _SECOND)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._hashes) + len(distinct) > MEMORY_PIECES or len(self._flat) > MEMORY_IDS:
            self._forget()
        new = ~np.isin(distinct, self._hashes, assume_unique=True)
        if new.any():
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._learn(distinct[new], seconds[first[new]], [raw[a:b].decode() for a, b in spans])
        at = np.searchsorted(self._hashes, distinct)[inverse]
        if (self._seconds[at] != seconds).any():  # two pieces of one hash
            return self._encode_whole(data, offsets)
        counts = self._counts[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        place = np.repeat(self._firsts[at] - upto[:-1], counts) + np.arange(upto[-1])
        return self._flat[place], upto[np.searchsorted(starts, offsets)]


    def _encode_whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        found = [np.array(e.ids, np.uint32) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(ids) for ids in found])])


@cache
def tokenizer(path: str, keeps_blanks: bool) -> PieceTokenizer:
    """One tokenizer per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceTokenizer(path, keeps_blanks)


def token_chunks(
    texts: pa.Array, path: str, keeps_blanks: bool
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of bounded bytes: first row, end row, ids, bounds of the rows in them."""
    encoder = tokenizer(path, keeps_blanks)
    for lo, hi, data, offsets in byte_chunks(texts):
        yield lo, hi, *encoder.encode(data, offsets)

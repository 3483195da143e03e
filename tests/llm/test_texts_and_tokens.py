import random
import re

import numpy as np
import pyarrow as pa
import pytest

from promptledger.llm import packing, textgrams, tokenfile, tokens
from promptledger.llm.queries import vocabulary

ALPHABET = [*"ab Z9.,'!é×÷ñΣσß\n\t\r\x0b\x1c\x85\xa0   　İ=", "<|endoftext|>", "'s", "́", "中", "Ⅷ", "😀"]
VOCABULARIES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def random_texts(count, longest=14, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choices(ALPHABET, k=draw.randint(0, longest))) for _ in range(count)]


def plain_sets(text, n=5):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_shingle_sets_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(textgrams, "CHUNK_BYTES", 64)
    texts = [None, "", "a B c d e f", "x " * 40, *random_texts(300, 40)]
    seen = {}
    for lo, hi, words in textgrams.text_chunks(pa.array(texts)):
        for text, shingles in zip(texts[lo:hi], words.shingle_sets(5), strict=True):
            plain = plain_sets(text)
            assert len(shingles) == len(plain) and (np.diff(shingles.view(np.int64)) != 0).all()
            key = frozenset(plain)
            assert seen.setdefault(key, shingles.tobytes()) == shingles.tobytes()
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("name", "keeps_blanks"), VOCABULARIES)
def test_pieces_give_the_ids_of_whole_texts(name, keeps_blanks):
    path = vocabulary(name)
    texts = [None, "", "word, word. WORD", "a  b\n\n c\t", "x" * 5000, *random_texts(20_000)]
    library = tokens.tokenizer(path, keeps_blanks)._library
    for lo, hi, ids, bounds in tokens.token_chunks(pa.array(texts), path, keeps_blanks):
        expected = library.encode_batch([t or "" for t in texts[lo:hi]], add_special_tokens=False)
        for k, whole in enumerate(expected):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.ids, repr(texts[lo + k])


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_PIECES", 50)
    encoder = tokens.PieceTokenizer(vocabulary("byte_bpe_50k.json"), True)
    for seed in range(5):
        texts = random_texts(60, seed=seed)
        for _, _, data, offsets in textgrams.byte_chunks(pa.array(texts)):
            ids, bounds = encoder.encode(data, offsets)
            whole = [e.ids for e in encoder._library.encode_batch(texts, add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == whole


@pytest.mark.parametrize("count", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("kind", ["equal", "small", "wide", "outliers"])
def test_blocks_round_trip(count, kind):
    draw = np.random.default_rng(count)
    ids = {
        "equal": lambda: np.full(count, 7),
        "small": lambda: draw.integers(100, 130, count),
        "wide": lambda: draw.integers(0, 2**32, count),
        "outliers": lambda: np.where(draw.random(count) < 0.005, draw.integers(0, 2**32, count), draw.integers(0, 9, count)),
    }[kind]().astype(np.uint32)
    blocks = tokenfile.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    if blocks:
        assert (tokenfile.decode_blocks(b"".join(blocks), starts)[:count] == ids).all()
    if kind == "outliers" and count == 5000:
        assert sum(map(len, blocks)) < 2 * count


def test_documents_are_read_alone(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "RUN_BLOCKS", 2)
    draw = np.random.default_rng(5)
    store, path = tokenfile.open_store(str(tmp_path / "f"))
    writer = tokenfile.TokenWriter(store, path)
    held = [draw.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 3000, 0, 5000, 17)]
    for k, ids in enumerate(held):
        writer.append(np.array([k]), ids, np.array([0, len(ids)]))
    writer.close()
    reader = tokenfile.TokenReader(store, path)
    assert reader.doc_ids.tolist() == list(range(len(held)))
    assert all((reader.document(k) == ids).all() and len(reader.document(k)) == len(ids) for k, ids in enumerate(held))
    assert np.concatenate(list(reader.scan())).tolist() == np.concatenate(held).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_bins_hold_all_items_and_no_more(seed):
    draw = np.random.default_rng(seed)
    lengths = [draw.integers(1, 2048, 500), draw.integers(300, 900, 700), np.full(40, 2048), draw.integers(1, 40, 3000)][seed]
    bins = packing.packed_bins(lengths)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 2048 and fill.min() > 0 and len(bins) == len(lengths)
    assert bins.max() <= packing.best_fit(lengths, 2048).max()
    assert packing.packed_bins(lengths[:0]).tolist() == []


def test_the_search_empties_bins_that_best_fit_leaves():
    # Best fit by falling length takes three bins of 10; two suffice.
    lengths = np.array([5, 4, 4, 3, 2, 2])
    assert packing.best_fit(lengths, 10).max() + 1 == 3
    assert packing.packed_bins(lengths, 10).max() + 1 == 2


def regular_words():
    """Words that polynomial hashes modulo 2 ** 64 cannot tell apart, in sizes."""
    for size in (8, 64, 1024, 2048, 4096):
        parity = [bin(k).count("1") % 2 for k in range(size)]
        yield "".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity)


def test_regular_words_have_different_hashes():
    for one, two in regular_words():
        words = next(textgrams.text_chunks(pa.array([f"{one} {two} {one.upper()}"])))[2]
        assert words.hashes[0] != words.hashes[1] and words.hashes[0] == words.hashes[2]
        blocks = [one[k : k + 8] for k in range(0, len(one), 8)]
        turned = "".join(blocks[::-1])
        if turned != one:
            assert next(textgrams.text_chunks(pa.array([turned])))[2].hashes[0] != words.hashes[0]


def test_span_hashes_equal_a_plain_sum():
    mask, gamma = 2**64 - 1, 0x9E3779B97F4A7C15

    def plain_mix(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & mask
        x ^= x >> 29
        x = x * 0xA24BAED4963EE407 & mask
        return x ^ (x >> 32)

    def plain(span):
        total = sum(plain_mix(plain_mix(int.from_bytes(span[k : k + 8], "little")) ^ ((k // 8 + 1) * gamma & mask)) for k in range(0, len(span), 8))
        return plain_mix((total & mask) ^ (len(span) * gamma & mask))

    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    starts, ends = np.array([0, 5, 5, 100, 760, 768]), np.array([768, 5, 6, 117, 768, 768])
    got = textgrams.span_hashes(data, starts, ends, textgrams.AS_IS)
    assert got.tolist() == [plain(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("name, keeps_blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_regular_words_equal_the_library(name, keeps_blanks, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = [w for pair in regular_words() for w in pair] + ["a b a", "", "x " * 50]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    def encoded():
        found = []
        encoder = tokens.PieceTokenizer(path, keeps_blanks)
        for _, _, data, offsets in textgrams.byte_chunks(pa.array(texts)):
            ids, bounds = encoder.encode(data, offsets)
            found += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return found

    assert encoded() == expected
    # Where all first hashes collide, the second tells, and the library encodes whole texts.
    whole = textgrams.span_hashes

    def blunt(data, starts, ends, fold, salt=0):
        hashes = whole(data, starts, ends, fold, salt)
        return hashes if salt else hashes & np.uint64(1)

    monkeypatch.setattr(tokens, "span_hashes", blunt)
    assert encoded() == expected

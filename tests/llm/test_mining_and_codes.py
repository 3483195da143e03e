"""Phrase collocations and vector codes against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptledger.llm import anchorcodes, collocations, queries
from promptledger.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


def as_sql(name, tables):
    engine = duckdb.connect()
    for t in tables:
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = engine.execute(ORACLES[name])
    return [d[0] for d in result.description], result.fetchall()


@pytest.mark.parametrize("name, tables", [
    ("op7_signature_tree_join", ["documents"]), ("op9_graph_near_duplicates", ["embeddings"]),
    ("op12_stripe_collocations", ["documents"]), ("op13_anchor_codes", ["embeddings"]),
])
def test_equal_to_sql(spark, name, tables):
    columns, expected = as_sql(name, tables)
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected) and got


# --- phrases


def plain_phrases(rows, best=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in (1, 2, 3):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        lines = []
        for p, a in found.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and p in (q[:2], q[1:]) for q, b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            lines.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(lines)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrases(spark, rows, best=2000):
    docs = spark.createDataFrame(rows, "text STRING, lang STRING")
    extra = {c: F.lit(k) for k, c in enumerate(("phrase", "rank", "segment", "prefix", "n", "a", "_part", "doc_id"))}
    got = collocations.collocations(docs.withColumns(extra).repartition(3), best)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def random_rows(seed, texts=60):
    draw = random.Random(seed)
    words = ["a", "B", "b", "ab", "é", "İ", "x-y", "7", "the", " ", "K"]
    rows = []
    for _ in range(texts):
        weights = [draw.random() ** 3 for _ in words]
        size = draw.choice([0, 1, 2, 5, 40, 200])
        text = "".join(w + draw.choice([" ", "  ", "\t", " ", ", ", ".\n", " ;"]) for w in draw.choices(words, weights, k=size))
        rows.append((text, draw.choice(["en", "de", None, ""])))
    return rows


@pytest.mark.parametrize("seed, best", [(1, 2000), (2, 5)])
def test_phrases_equal_plain_counts(spark, seed, best):
    rows = [*random_rows(seed), (None, "en"), ("", None), (" \t\n", "de"), ("word", "xx"), ("THE the " * 400, "en")] * 2
    expected = plain_phrases(rows, best)
    assert phrases(spark, rows, best) == expected and len(expected) > 10


def test_no_phrases(spark):
    assert phrases(spark, []) == [] and phrases(spark, [(None, None), ("a b", "en")]) == []


def test_long_text_with_hot_words(spark):
    draw = random.Random(5)
    long = " ".join(draw.choice(["of", "the", f"w{draw.randrange(300)}", "."]) for _ in range(40_000))
    rows = [(long, "en"), *[("of the same hot passage of the text", "en")] * 300]
    assert phrases(spark, rows) == plain_phrases(rows)


def test_stripes_merge_in_any_cut():
    """Cut segments, small buffers and small merges change nothing."""
    rows = random_rows(9, 200)
    texts, langs = pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())
    hot = pa.array(["a", "b", "the"])
    whole = collocations.Sequence(texts, langs)

    def entries(tables):
        found = Counter()
        for t in tables:
            for r in t.to_pylist():
                packed = isinstance(r["nexts"], str)
                words = r["nexts"].split(" ") if packed else r["nexts"]
                counts = np.frombuffer(r["counts"], np.int64).tolist() if packed else r["counts"]
                for w, c in zip(words, counts, strict=True):
                    found[r["lang"], r["prefix"], w] += c
        return found

    for prefix_words in (1, 2):
        bits = None if prefix_words == 1 else np.full(collocations.FILTER_BITS // 8, 255, np.uint8)
        one = collocations.stripes_of(whole, prefix_words, hot, bits)
        parts = [
            collocations.stripes_of(collocations.Sequence(texts[k : k + 20], langs[k : k + 20]), prefix_words, hot, bits)
            for k in range(0, len(rows), 20)
        ]
        together = pa.concat_tables(parts).sort_by([(c, "ascending") for c in ("prefix", "lang", "segment")])
        merged = collocations.merge(together)
        assert entries([merged]) == entries([one]) == entries(parts)
        assert merged.num_rows == one.num_rows and len(set(one["segment"].to_pylist())) > 3
        streamed = list(collocations.merged_streams(iter(together.to_batches(5)), prefix_words == 1))
        frequent = {k: c for k, c in entries([one]).items() if c >= 10 and k[2]}
        assert {k: c for k, c in entries([pa.Table.from_batches(streamed)]).items()} == frequent
        if prefix_words == 1:
            assert sum(sum(b.column(2).to_pylist()) for b in streamed) == len(whole.codes)


# --- vector codes


def plain_codes(rows, entries=64):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    ints = np.array([[int(np.floor(np.float64(x) * 256)) for x in v] for _, v, _ in kept], dtype=object).reshape(len(kept), -1)
    width = ints.shape[1] // 16
    books, codes, error = [], [""] * len(kept), [0] * len(kept)
    for p in range(16):
        part = [tuple(r) for r in ints[:, p * width : (p + 1) * width]]
        book = part[:entries]

        def nearest(x, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

        for _ in range(2):
            found = defaultdict(list)
            for x in part:
                found[nearest(x, book)[1]].append(x)
            book = [tuple(sum(c) // len(found[k]) for c in zip(*found[k], strict=True)) if k in found else c for k, c in enumerate(book)]
        for n, x in enumerate(part):
            d, k = nearest(x, book)
            codes[n] += f"{k:02x}"
            error[n] += d
        books += [x for c in book for x in c]
    sums = Counter()
    for e, (_, _, g) in zip(error, kept, strict=True):
        sums[g] += e
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return [(i, c, e, sums[g], sha) for (i, _, g), c, e in zip(kept, codes, error, strict=True)]


def codes(spark, rows):
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    extra = {c: F.lit(k) for k, c in enumerate(("code", "error", "label_error", "_label", "ids", "trees"))}
    return [tuple(r) for r in anchorcodes.vector_codes(table.withColumns(extra).repartition(3)).collect()]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_equal_plain_rounds(spark, seed):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(300, 32)).astype(np.float32)
    base[100:200] = base[draw.integers(0, 5, 100)]  # copies
    base[200:260] = np.round(base[200:260])  # ties
    rows = [(int(i), v.tolist(), int(g) if g else None) for i, v, g in zip(draw.permutation(300) * 3, base, draw.integers(0, 3, 300), strict=True)]
    rows += [(7, None, 1), (8, [None] * 32, 1), (10, [float("nan")] * 32, 1), (11, [float("inf")] + [0.0] * 31, None)]
    rows += [rows[0], (rows[0][0], [0.0] * 32, 1), (None, [1.0] * 32, None)]
    assert by_text(codes(spark, rows)) == by_text(plain_codes(rows))


def test_few_odd_and_no_vectors(spark):
    assert codes(spark, []) == [] and codes(spark, [(1, None, 1)]) == []
    one = [(1, [0.5] * 16, None)]
    assert codes(spark, one) == plain_codes(one)
    got = codes(spark, [*one, (2, [1.0] * 32, None), (3, [], None)])
    assert sorted((r[0], r[1]) for r in got) == [(1, "00" * 16), (2, None), (3, None)]
    assert [r[1] for r in codes(spark, [(1, [1.0] * 5, 1)])] == [None]


@pytest.mark.parametrize("kind", ["normal", "equal", "grid", "lines"])
def test_trees_equal_full_comparison(kind):
    draw = np.random.default_rng(3)
    points = draw.normal(scale=40, size=(3000, 4))
    if kind == "equal":
        points[500:2500] = points[0]
    elif kind == "grid":
        points = np.round(points / 40)
    elif kind == "lines":
        points[:, 1:] = 0
    points = np.floor(points).astype(np.int64)
    book = points[draw.integers(0, len(points), 64)]
    tree = anchorcodes.Tree.build(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    near, sums, counts = tree.assign(book)
    whole = ((points[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
    assert (near == whole[tree.order]).all()
    assert (counts == np.bincount(whole, minlength=64)).all()
    for entry in range(64):
        assert (sums[entry] == points[whole == entry].sum(axis=0)).all()
    again = anchorcodes.unpacked(anchorcodes.packed([tree]))[0].assign(book)
    assert all((a == b).all() for a, b in zip(again, (near, sums, counts), strict=True))


def test_large_components_are_refused():
    with pytest.raises(ValueError, match="too large"):
        anchorcodes.whole_numbers(np.full((1, 16), 1e30))

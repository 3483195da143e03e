"""Similarity join, components, near-duplicate vectors and decontamination by brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptledger.llm import decontaminate, signature_join, tables, vectorgraph
from tests.llm.test_texts_and_tokens import plain_sets

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near_copies(seed=3):
    """Groups of edited copies around the threshold, exact copies, short and blank texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    shared = [word() for _ in range(50)]
    texts = [None, "", "  \n", "one two", "ONE two", "a b c d e", "A b c d e"]
    for group in range(25):
        base = [word() for _ in range(draw.choice([8, 40, 150]))] + (shared if group % 2 else [])
        for _ in range(draw.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(draw.randint(0, len(base) // 25 + 1)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return list(enumerate(texts, 10))


def brute_components(rows):
    sets = [(n, plain_sets(t)) for n, t in rows]
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    ids = roots([n for n, _ in sets], links)
    return {n: (len(s), ids[n]) for n, s in sets}


@pytest.mark.parametrize("tile", [250_000, 300])
def test_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(signature_join, "TILE_SHINGLES", tile)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumns(
        {"rep": F.lit(1), "cluster": F.lit("x"), "bands": F.lit(None)}
    )
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.similarity_components(docs).collect()}
    assert got == brute_components(rows)


def test_join_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.similarity_components(docs).collect()}
    assert got == brute_components(rows)


def test_one_document_stays_of_each_group(spark):
    rows = near_copies()
    expected = {component for _, component in brute_components(rows).values()}
    table = spark.createDataFrame([*rows, rows[9], rows[9]], "doc_id BIGINT, text STRING")
    kept = [r.doc_id for r in signature_join.one_per_group(table).collect()]
    assert sorted(kept) == sorted(expected)


def test_rows_that_share_or_lack_an_id(spark):
    one, two, three = (" ".join(f"{c}{n}" for n in range(40)) for c in "abc")
    rows = [(1, one), (1, two), (2, one), (3, three), (3, three + " more"), (4, three), (None, two + " x"), (None, "alone words here"),
            (None, "alone words here"), (9, ""), (9, ""), (9, None), (None, None)]
    extra = {c: F.lit(0) for c in ("row_key", "mark", "shared_id", "_mark", "stays", "id", "first")}
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumns(extra)
    kept = signature_join.one_per_group(table)
    assert kept.columns == table.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    threes = [r for r in kept if r[0] == 3]
    assert len(threes) == 1 and threes[0] in rows
    expected = [(1, one), (1, two), (None, "alone words here"), (9, ""), (9, ""), (9, None), (None, None)]
    assert sorted(map(str, [r for r in kept if r[0] != 3])) == sorted(map(str, expected))


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert signature_join.similarity_components(empty).count() == 0


@pytest.mark.parametrize("free", [None, 4])
def test_trees_equal_all_pairs(free):
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, (6, 200)).astype(np.uint64)
    sets = []
    for _ in range(90):
        kept = base[draw.integers(6)][draw.random(200) > draw.choice([0.05, 0.12, 0.3])]
        sets.append(np.unique(np.append(kept, draw.integers(0, 2**63, 4).astype(np.uint64))))
    tied = [] if free is None else [(free, i) for i in range(free, 90)]
    all_links = [(i, j) for i in range(90) for j in range(i) if signature_join.similar(sets[i], sets[j])]
    if free is not None:
        all_links = [(i, j) for i, j in all_links if j < free]
    found = signature_join.spanning_links(sets, free)
    assert roots(range(90), found + tied) == roots(range(90), all_links + tied)


def cluster_of(spark, texts):
    """Members of one cluster, as ``links_in_clusters`` takes them."""
    rows = [(5, n, len(plain_sets(t)), 1, t) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "cluster BIGINT, rep BIGINT, n_shingles BIGINT, degree BIGINT, text STRING")


def test_texts_that_share_a_passage_only_meet_in_no_tile(spark, monkeypatch):
    def traversed(table):
        raise AssertionError("a tile of texts that are not alike")

    monkeypatch.setattr(signature_join, "TILE_SHINGLES", 1000)
    monkeypatch.setattr(signature_join, "_links_of_tiles", traversed)
    passage = " ".join(f"common{n}" for n in range(25))
    texts = [f"{passage} {' '.join(f'w{i}x{n}' for n in range(30))}" for i in range(60)]
    texts += [texts[7] + " more", "other " + texts[7], texts[9] + " again"]
    found = signature_join.links_in_clusters(cluster_of(spark, texts)).collect()
    assert roots(range(63), [(r.a, r.b) for r in found]) == roots(range(63), [(7, 60), (7, 61), (9, 62)])


def drifting(seed=6):
    """Copies of copies with an edit each, in two strands with a passage in common; the ends of a strand are not alike."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    shared = [word() for _ in range(70)]
    texts = []
    for _ in range(2):
        words = shared + [word() for _ in range(draw.randint(25, 35))]
        for _ in range(25):
            words = list(words)
            words[draw.randrange(len(words))] = word()
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("tile", [400, 1500])
def test_drifting_copies_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(signature_join, "TILE_SHINGLES", tile)
    texts = drifting()
    assert len({component for _, component in brute_components([*enumerate(texts)]).values()}) > 1
    found = signature_join.links_in_clusters(cluster_of(spark, texts)).collect()
    got = roots(range(len(texts)), [(r.a, r.b) for r in found])
    assert got == {n: component for n, (_, component) in brute_components([*enumerate(texts)]).items()}


def test_parts_hold_all_similar_pairs_and_tell_passages_apart(spark):
    texts = [t for _, t in near_copies(8) if t and t.split()] + drifting()
    members = cluster_of(spark, texts).select("cluster", "rep", "text")
    twice = members.unionAll(members.where("rep = 9").withColumn("text", F.lit(texts[40])))  # an id with two texts
    parts = {r.rep: r.cluster for r in signature_join.parted(twice).collect()}
    sets = [plain_sets(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                assert parts[i] == parts[j]
    assert parts[9] == parts[40]
    assert len(set(parts.values())) > 10


def test_band_keys_of_many_sets_equal_plain_ones():
    draw = np.random.default_rng(3)
    sizes = [1, 7, signature_join.PART_SHINGLES - 8, 1, signature_join.PART_SHINGLES + 5, 300, 40_000, 2]
    sets = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64)) for n in sizes]
    mix = signature_join.mix
    first, second, keys = signature_join._fingerprints_and_keys(sets)
    for k, shingles in enumerate(sets):
        smallest = mix(np.array([(shingles * m).min() for m in signature_join.MULTIPLIERS]))
        expected = np.arange(signature_join.BANDS, dtype=np.uint64)
        for column in smallest.reshape(signature_join.BANDS, -1).T:
            expected = mix(expected + column)
        assert (keys[k] == expected).all()
        assert first[k] == mix(shingles).sum(dtype=np.uint64)
        assert second[k] == mix(shingles ^ signature_join.MULTIPLIERS[0]).sum(dtype=np.uint64)


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)]
    links += [(200, 200)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(70)]
    got = {r.node: r.component for r in tables.components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(nodes, links=[(a, b) for a, b in links if a != b])
    assert tables.components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def vectors(seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for centre in draw.normal(size=(12, 16)):
            for _ in range(int(draw.choice([1, 4, 60]))):
                rows.append((len(rows), (centre + draw.normal(size=16) * draw.choice([0.02, 0.25])).tolist(), label))
    rows += [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] + [1.0] * 15, 0), (9003, [1.0] * 3, 0)]
    rows += [(9004, [2.0] * 3, 0), (9005, [None] * 16, 1), (9006, [float("inf")] * 16, 1)]
    return rows


@pytest.mark.parametrize("shard_bytes", [4 << 20, 6000])
def test_vectors_equal_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(vectorgraph, "SHARD_BYTES", shard_bytes)
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT").withColumn("home", F.lit(3))
    got = {r.vec_id: r for r in vectorgraph.near_duplicates(table).collect()}
    unit = {
        n: (label, np.array(v) / np.linalg.norm(v))
        for n, v, label in rows
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    }
    links = [
        (a, b)
        for a, (x, u) in unit.items()
        for b, (y, w) in unit.items()
        if a < b and x == y and len(u) == len(w) and u @ w >= 0.93
    ]
    expected = roots([n for n, *_ in rows], links)
    found = sum(r.n_links for r in got.values())
    assert 0.97 * 2 * len(links) <= found <= 2 * len(links)
    assert {n: r.component_id for n, r in got.items()} == expected
    assert all(r.kept == (r.component_id == n) for n, r in got.items())


def vectors_with_a_large_group():
    """Most links are those of one group; the others have one each."""
    draw = np.random.default_rng(5)
    near = lambda v: v + draw.normal(size=v.shape) * 0.02
    centre, others = draw.normal(size=64), draw.normal(size=(900, 64))
    copies = np.repeat(draw.normal(size=(1, 64)), 100, axis=0)
    return np.concatenate([near(np.tile(centre, (600, 1))), copies, others, near(others)])


@pytest.mark.parametrize("pair", [False, True])
def test_small_groups_are_found_beside_a_large_one(pair):
    lines = vectors_with_a_large_group()
    lines = lines[np.random.default_rng(6).permutation(len(lines))]
    home = np.arange(len(lines)) % 2 if pair else np.zeros(len(lines), dtype=int)
    table = pa.table(
        {"vec_id": np.arange(len(lines)), "home": home, "graph": np.zeros(len(lines), dtype=int), "embedding": list(lines)}
    )
    got = vectorgraph._shard_pair(table).to_pydict()
    unit = lines / np.linalg.norm(lines, axis=1)[:, None]
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    if pair:
        linked &= home[:, None] != home
    links = dict(zip(got["vec_id"], got["n_links"], strict=True))
    truth = linked.sum(axis=1)
    small = [n for n in range(len(lines)) if 0 < truth[n] < 40]
    assert sum(links[n] for n in small) >= 0.99 * sum(truth[n] for n in small)
    assert all(links[n] <= truth[n] for n in links)
    assert sum(links.values()) >= 0.99 * truth.sum()


def test_few_links_are_not_taken_for_none(monkeypatch):
    """Two shards with a single linked pair, whose query is not among the first audited."""
    monkeypatch.setattr(vectorgraph, "AUDITED", 8)
    monkeypatch.setattr(vectorgraph.Graph, "query", lambda *args: None)  # a graph that finds nothing
    lines = np.random.default_rng(7).normal(size=(400, 64))
    lines[399] = lines[16] + 0.01
    home = np.arange(400) % 2
    table = pa.table({"vec_id": np.arange(400), "home": home, "graph": np.zeros(400, dtype=int), "embedding": list(lines)})
    got = vectorgraph._shard_pair(table).to_pydict()
    assert {n for n, links in zip(got["vec_id"], got["n_links"], strict=True) if links} == {16, 399}


def test_short_vectors_come_in_bounded_shards(spark, monkeypatch):
    monkeypatch.setattr(vectorgraph, "SHARD_VECTORS", 40)
    asked = []
    monkeypatch.setattr(vectorgraph, "stored", lambda df, name: asked.append((name, df)) or df)
    rows = [(n, [float(n % 7), 1.0], 0) for n in range(400)]
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    monkeypatch.setattr(vectorgraph, "components", lambda links: links.select(links.b.alias("node"), links.a.alias("component")))
    vectorgraph.near_duplicates(table)
    assert dict(asked)["vector-shards"].first().shards == 10


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    assert vectorgraph.near_duplicates(empty).count() == 0


def plain_alignment(item, text):
    table = [[0] * (len(text) + 1)]
    for a in item:
        line = [0]
        for k, b in enumerate(text, 1):
            line.append(max(0, table[-1][k - 1] + (2 if a == b else -1), table[-1][k] - 1, line[-1] - 1))
        table.append(line)
    return max(map(max, table)) / (2 * len(item))


def test_alignment_equals_the_plain_table():
    draw = np.random.default_rng(8)
    for _ in range(200):
        item, text = (draw.integers(0, 5, draw.integers(1, 25)).astype(np.uint64) for _ in range(2))
        score, first, last = decontaminate.align(item, text)
        assert score == plain_alignment(item.tolist(), text.tolist())
        if score:
            assert plain_alignment(item.tolist(), text[first : last + 1].tolist()) == score


def benchmark_case():
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    items = [[word() for _ in range(draw.randint(15, 50))] for _ in range(12)]
    docs, truth = [], set()
    for n in range(300):
        text = [word() for _ in range(draw.randint(0, 300))]
        if n % 3 == 0:
            k = 0 if n % 2 else draw.randrange(len(items))
            passage = list(items[k])
            for _ in range(len(passage) // 10 if n % 4 else 0):
                at = draw.randrange(len(passage))
                passage[at : at + 1] = draw.choice([[], [word()], [passage[at], word()]])
            at = draw.randint(0, len(text))
            text[at:at] = [w.upper() + "!" for w in passage] if n % 5 == 0 else passage
            truth.add((n, k))
        docs.append((n, " ".join(text)))
    return docs, [(k, " ".join(words)) for k, words in enumerate(items)], truth


def test_edited_copies_are_found_and_nothing_else(spark):
    docs, items, truth = benchmark_case()
    documents = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id BIGINT, text STRING").withColumn("item_id", F.lit(7))
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "two words")], "item_id BIGINT, text STRING")
    found = decontaminate.contaminated(documents, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == truth
    kept = decontaminate.clean(documents, benchmark)
    assert {r.doc_id for r in kept.collect()} == {n for n, _ in docs} - {n for n, _ in truth} | {1000, 1001}
    assert kept.columns == documents.columns
    for a, b in ((documents.limit(0), benchmark), (documents, benchmark.limit(0))):
        assert decontaminate.contaminated(a, b).count() == 0


def plain_truth(docs, items):
    """Scores of all pairs of texts and items, lists of words, that are high enough."""
    least = lambda item: 0.5 if len(item) > 3 else 1.0
    scores = {(n, k): plain_alignment(item, text) for n, text in docs for k, item in items if item}
    return {(n, k): x for (n, k), x in scores.items() if x >= least(dict(items)[k])}


def found_scores(spark, docs, items):
    documents = spark.createDataFrame([(n, " ".join(t)) for n, t in docs], "doc_id BIGINT, text STRING")
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id BIGINT, text STRING")
    kept = {r.doc_id for r in decontaminate.clean(documents, benchmark).collect()}
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(documents, benchmark).collect()}
    assert kept == {n for n, _ in docs} - {n for n, _ in found}
    return found


def test_regular_edits_equal_brute_force(spark):
    """Each second, third or fourth word replaced, left out, or followed by new ones."""
    draw = random.Random(21)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 20, 30, 31, 60])]
    docs = []
    for _, item in items:
        for step in (1, 2, 3, 4):
            for start in range(step):
                edited = lambda new: [x for i, w in enumerate(item) for x in (new(w) if i % step == start else [w])]  # noqa: E731, B023
                docs.extend(map(edited, (lambda w: [word()], lambda w: [], lambda w: [w, word()], lambda w: [w, word(), word()])))
        docs.extend([item[: (len(item) + 1) // 2], item[len(item) // 2 :], [*item, *item]])
    docs = [(n, [word() for _ in range(n % 7)] + text + [word() for _ in range(n % 5)]) for n, text in enumerate(docs)]
    truth = plain_truth(docs, items)
    assert 200 < len(truth) < len(docs) + 50
    assert found_scores(spark, docs, items) == truth


@pytest.mark.parametrize("letters", [3, 30])
def test_few_words_equal_brute_force(spark, letters):
    """Texts of few words have many seeds in common."""
    draw = random.Random(letters)
    word = lambda: f"w{draw.randrange(letters)}"
    items = [(k, [word() for _ in range(draw.randint(1, 14))]) for k in range(25)]
    docs = [(n, [word() for _ in range(draw.randint(0, 40))]) for n in range(120)]
    truth = plain_truth(docs, items)
    assert truth and found_scores(spark, docs, items) == truth


def test_no_passage_lacks_the_seeds():
    """Whichever n-grams of an item are the rare ones, a good passage holds enough of them."""
    draw, seen = random.Random(4), 0
    for _ in range(3000):
        n = draw.randint(1, 24)
        item = np.array([draw.randrange(1, 1 << 40) for _ in range(n)], dtype=np.uint64)
        text, share = [], draw.random() * 0.5
        for w in item.tolist():
            kind = draw.random()
            if kind < share / 3:
                text.append(draw.randrange(1, 1 << 40))
            elif kind > share / 1.5:
                text.append(w)
            text.extend(draw.randrange(1, 1 << 40) for _ in range(draw.choice([0, 0, 0, 1, 2, 3]) if draw.random() < share else 0))
        text = np.array(text, dtype=np.uint64)
        least = draw.choice([0.3, 0.5, 0.5, 0.7, 1.0])
        pairs, most, held = decontaminate.seed_rule(n, least)
        grams = decontaminate.own_grams(item, pairs)
        assert 1 <= held <= most <= len(grams)
        if len(text) == 0 or plain_alignment(item.tolist(), text.tolist()) * 2 * n < decontaminate.needed(n, least):
            continue
        seen += 1
        distances = range(1, 4) if pairs else [0]
        has = np.isin(grams, np.concatenate([decontaminate.gapped(text, d) for d in distances if d < max(1, len(text))]))
        # The worst choice takes the missing ones first.
        assert most - min(most, int((~has).sum())) >= held
    assert seen > 500


def test_repeated_rows_and_other_columns(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(1, f"a {item} b", 5), (1, f"a {item} b", 6), (None, f"a {item} b", 7), (2, "a b c", 8), (2, "a b c", 8), (None, None, 9)],
        "doc_id BIGINT, text STRING, key BIGINT",
    ).withColumn("key2", F.lit("x")).withColumn("item", F.lit(3)).withColumn("words", F.lit("y"))
    items = spark.createDataFrame([(4, item, 1), (4, item, 2), (None, item, 3), (6, "", 4)], "item_id BIGINT, text STRING, gram INT")
    found = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in found) == sorted((d, i) for d in (1, 1, 0) for i in (4, 4, 0))
    assert {(r.score, r.first_word, r.last_word) for r in found} == {(1.0, 1, 10)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.key for r in kept.collect()) == [8, 8, 9]


def hot_benchmark_case():
    """Items that many documents hold: with the same edit, shortened, or exact but for one."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    items = [[word() for _ in range(50)] for _ in range(3)]
    edit = lambda words: [*words[:20], word(), word(), word(), *words[23:]]
    passages = [edit(items[0])] * 30 + [items[1][:40]] * 30 + [items[2]] * 30
    passages += [edit(items[2]), items[1][:20], items[0][:3], []]
    docs = []
    for n, passage in enumerate(passages):
        before, after = ([word() for _ in range(draw.randint(0, 40))] for _ in range(2))
        docs.append((n, [*before, *passage, *after]))
    return docs, items


def test_copies_of_hot_items_equal_brute_force(spark):
    docs, items = hot_benchmark_case()
    scores = {(n, k): plain_alignment(item, text) for n, text in docs for k, item in enumerate(items)}
    truth = {pair: score for pair, score in scores.items() if score >= 0.5}
    assert len(truth) == 91
    documents = spark.createDataFrame([(n, " ".join(text)) for n, text in docs], "doc_id BIGINT, text STRING")
    benchmark = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id BIGINT, text STRING")
    found = decontaminate.contaminated(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == truth
    kept = decontaminate.clean(documents, benchmark)
    assert {r.doc_id for r in kept.collect()} == {n for n, _ in docs} - {n for n, _ in truth}


def test_no_alignment_exceeds_the_bounds():
    draw = np.random.default_rng(9)
    for _ in range(200):
        item, text = (draw.integers(0, 12, draw.integers(1, 25)).astype(np.uint64) for _ in range(2))
        known, wanted = np.unique(item, return_counts=True)
        score = decontaminate.align(item, text)[0] * 2 * len(item)
        assert score <= decontaminate.most_score(known, text)
        assert score <= 2 * decontaminate.shared_words(known, wanted, text)

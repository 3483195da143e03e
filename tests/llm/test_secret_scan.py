"""The secret scan: patterns by a plain reading, gradients by differences, held-out findings."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptledger.llm import queries, secretscan

SF = "/root/testdata/sf0.01"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_assign(text):
    """Findings of assignments, read character by character."""
    low, found, at = lowered(text), [], 0
    while at < len(text):
        name = next((n for n in NAMES if low.startswith(n, at)), None)
        end = at + len(name) if name else 0
        if name and text[end : end + 1] in ('"', "'") and text[end : end + 1]:
            end += 1
        while name and text[end : end + 1] == " ":
            end += 1
        if not name or text[end : end + 1] not in (":", "=") or not text[end : end + 1]:
            at += 1
            continue
        end += 1
        while text[end : end + 1] == " ":
            end += 1
        if text[end : end + 1] in ('"', "'") and text[end : end + 1]:
            end += 1
        size = 0
        while end + size < len(text) and text[end + size] in VALUE:
            size += 1
        if not size:
            at += 1
            continue
        if size >= 6:
            found.append((at, 0, end + size))
        at = end + size
    return found


def plain_base(text):
    found = plain_assign(text)
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def random_text(draw):
    parts = [*NAMES, "Token", "SECRET", "api", "key", "_", '"', "'", " ", "  ", ":", "=", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef01234567", "é", "ſecret", "toKen", "x", "-", "\n", "中", "short", "longer7value"]
    return "".join(draw.choices(parts, k=draw.randrange(60)))


def test_patterns_equal_a_plain_reading():
    draw = random.Random(3)
    for _ in range(3000):
        text = random_text(draw)
        assert secretscan.base_spans(text) == plain_base(text), text


def test_candidates_and_windows_cover_all_of_a_run():
    text = "see xyz.1234567890, or " + "Ab1" * 50 + "=, wordswithoutnumbers 1234567"
    spans = secretscan.candidates(text)
    assert [text[a:b] for a, b in spans] == ["xyz.1234567890", "Ab1" * 50]
    lines, owners = secretscan.windows(text, spans)
    assert owners.tolist() == [0] + [1] * 5
    tile = lines[:, secretscan.BEFORE : secretscan.BEFORE + secretscan.TILE]
    read = [bytes(int(c) - 2 for c in row if c > 1).decode() for row in tile]
    assert read[0] == "xyz.1234567890" and all(r in "Ab1" * 50 and len(r) == 32 for r in read[1:])
    assert secretscan.windows("", [])[0].shape == (0, secretscan.WIDTH)


def test_touching_spans():
    base = [(0, 0, 50), (10, 2, 20), (60, 1, 70)]
    spans = [(45, 48), (50, 60), (69, 90), (70, 75), (55, 61)]
    assert secretscan.touches(spans, base).tolist() == [True, False, True, False, True]
    assert secretscan.touches(spans, []).tolist() == [False] * 5 and secretscan.touches([], base).tolist() == []


def test_gradients_equal_differences():
    draw = np.random.default_rng(4)
    network = secretscan.Network.fresh(draw)
    for name in ("embedding", "filters", "offset", "hidden", "hidden_offset", "out"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    codes = draw.integers(0, secretscan.CODES, (6, secretscan.WIDTH)).astype(np.uint8)
    labels, weight = np.array([0, 1, 1, 0, 1, 0.0]), draw.random(6)

    def loss():
        p = secretscan.chance(network.forward(codes)[0])
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weight.sum()

    for values, gradient in zip(network.weights(), network.gradients(codes, labels, weight), strict=True):
        for at in draw.integers(0, values.size, 12):
            spot = np.unravel_index(at, values.shape)
            kept, step = values[spot], 1e-5
            values[spot] = kept + step
            high = loss()
            values[spot] = kept - step
            low = loss()
            values[spot] = kept
            assert abs((high - low) / (2 * step) - gradient[spot]) < 1e-4 * max(1, abs(gradient[spot]))


def random_value(draw):
    letters = draw.choice(["0123456789abcdef", "ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"])
    return "".join(draw.choices(letters, k=draw.randrange(26, 44)))


def random_document(draw, secret):
    words = [draw.choice(["the", "of", "reach", "über", "lines", "a"]) for _ in range(draw.randrange(5, 60))]
    decoys = [f"{draw.randrange(10**15, 10**16)}", f"{draw.randrange(256)}.{draw.randrange(256)}.{draw.randrange(256)}.17", "2021-05-0%d" % draw.randrange(1, 9), "a.b%02d@mail.example.com" % draw.randrange(100)]
    words[1:1] = [draw.choice(decoys)]
    if secret:
        value = random_value(draw)
        words[3:3] = [draw.choice(['token = "%s"', "password: %s", "api_key='%s'"]) % value]
    return " ".join(words)


@pytest.fixture(scope="module")
def documents(spark):
    draw = random.Random(8)
    rows = [(k, random_document(draw, k % 3 == 0)) for k in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)


def test_findings_with_a_trained_network(spark, documents):
    rows, table = documents
    network = secretscan.train(secretscan.labelled_examples(table))
    assert 0.5 <= network.threshold <= 1
    # Unseen values: secrets behind names that no pattern knows, and plain numbers.
    draw = random.Random(99)
    secret = [f"the lines of credential {random_value(draw)} reach" for _ in range(40)]
    clean = [random_document(draw, False) for _ in range(300)]
    held = spark.createDataFrame(list(enumerate([*secret, *clean])), "doc_id BIGINT, text STRING")
    found = {r.doc_id: r.found for r in secretscan.scanned(held, network).collect()}
    assert sum(bool(found[k]) for k in range(40)) >= 30
    assert sum(bool(found[k]) for k in range(40, 340)) <= 6
    digest = {r.doc_id: r for r in secretscan.finding_digest(secretscan.scanned(table, network)).collect()}
    for doc_id, text in rows:
        base, r = plain_base(text), digest[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        plain = ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert not base or set(plain.split(",")) <= set(r.spans.split(","))
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_recall_of_labelled_findings(spark, documents):
    """Without the patterns the network alone finds the findings of documents it has not seen."""
    _, table = documents
    network = secretscan.train(secretscan.labelled_examples(table))
    draw = random.Random(12)
    hits, misses, wrong = 0, 0, 0
    for k in range(300):
        text = random_document(draw, k % 2 == 0)
        spans = secretscan.candidates(text)
        sure = secretscan.touches(spans, secretscan.base_spans(text))
        lines, owners = secretscan.windows(text, spans)
        judged = secretscan.highest(network.probabilities(lines), owners, len(spans)) >= network.threshold
        hits, misses, wrong = hits + (judged & sure).sum(), misses + (~judged & sure).sum(), wrong + (judged & ~sure).sum()
    assert hits >= 0.95 * (hits + misses) and wrong <= 0.02 * hits + 3


def test_all_candidates_of_all_texts_are_learned_from(spark):
    long = " ".join(f"number {k:010d}" for k in range(300)) + " password=" + "k3" * 40
    texts = [long, long, *(f"item {k:010d}" for k in range(4500)), None, "", "none"]
    table = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(3)
    examples = secretscan.labelled_examples(table)
    spans = examples.select("name", "start").distinct()
    assert spans.count() == 301 + 4500
    lines, owners = secretscan.windows(long, secretscan.candidates(long))
    got = examples.groupBy("name").agg(F.count("line").alias("n"), F.sort_array(F.collect_list(F.struct("start", "tile", "line", "known"))).alias("w"))
    r = got.orderBy(F.desc("n")).first()
    assert [bytes(w.line) for w in r.w] == [line.tobytes() for line in lines]
    assert [w.known for w in r.w] == [owner == 300 for owner in owners.tolist()]


def test_shards_cover_all_windows_and_learn_together(spark, documents, monkeypatch):
    """With many shards the averaged network still tells findings apart, however rows lie."""
    _, table = documents
    monkeypatch.setattr(secretscan, "SHARD_WINDOWS", 200)
    networks = [secretscan.train(secretscan.labelled_examples(table.repartition(n))) for n in (1, 5)]
    for a, b in zip(*(n.weights() for n in networks), strict=True):
        assert np.array_equal(a, b)
    draw = random.Random(12)
    secret = [f"the lines of credential {random_value(draw)} reach" for _ in range(60)]
    clean = [random_document(draw, False) for _ in range(200)]
    added = secretscan.learned_spans([*secret, *clean], [[] for _ in range(260)], networks[0])
    assert sum(map(bool, added[:60])) >= 45 and sum(map(bool, added[60:])) <= 6


def test_blocks_of_shards():
    draw = np.random.default_rng(5)
    sizes = {2: 5000, 7: 1, 9: 4096, 11: 300}
    lines = {k: draw.integers(0, 130, (n, secretscan.WIDTH)).astype(np.uint8) for k, n in sizes.items()}
    rows = [(k, bool(line[0] % 2), line.tobytes()) for k in sizes for line in lines[k]]
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, ["shard", "known", "line"])
    for step in (700, 10_000):
        parts = list(secretscan.shard_blocks(batch.slice(lo, step) for lo in range(0, batch.num_rows, step)))
        for k in sizes:
            codes = np.concatenate([c for shard, c, _ in parts if shard == k])
            labels = np.concatenate([x for shard, _, x in parts if shard == k])
            assert np.array_equal(codes, lines[k]) and np.array_equal(labels, lines[k][:, 0] % 2)
        assert [len(c) for shard, c, _ in parts if shard == 2] == [2048, 2048, 904]


def test_threshold_and_scaling_over_all_scores(spark):
    draw = np.random.default_rng(6)
    scores = np.concatenate([draw.normal(size=700), [0.0, -0.0, 5.0, 5.0]]).astype(np.float32)
    known = draw.random(len(scores)) < secretscan.chance(2.5 * scores - 1)
    rows = zip(scores.tolist(), secretscan.ranks(scores).tolist(), known.tolist(), strict=True)
    table = spark.createDataFrame(list(rows), "score DOUBLE, rank BIGINT, known BOOLEAN").repartition(3)
    ordered = np.sort(scores)
    for k in (0, 13, 350, 360, len(scores) - 1):
        assert secretscan.score_of(secretscan.smallest(table, k))[0] == ordered[k]
    network = secretscan.Network.fresh(draw)
    secretscan.calibrate(network, table, int((~known).sum()), int(known.sum()))
    assert abs(network.slope - 2.5) < 0.6 and abs(network.shift + 1) < 0.4
    target = np.where(known, (known.sum() + 1) / (known.sum() + 2), 1 / ((~known).sum() + 2))
    off = secretscan.chance(network.slope * scores.astype(float) + network.shift) - target
    assert abs(off.sum()) < 0.01 and abs((off * scores).sum()) < 0.01


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "password=abcdef"), (3, "password=abcdef"), (None, "AKIA" + "B" * 16), (4, "x1" * 100_000), (5, "中 secret: 中abc")]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumns({c: F.lit(1) for c in ("found", "kind", "hash", "sure", "spans")})
    got = secretscan.finding_digest(secretscan.secrets(table)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(((r.doc_id or 0), r.n_assign, r.n_access, r.n_hex, r.spans) for r in got) == [
        (0, 0, 1, 0, "access:0:20"), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 1, 0, 0, "assign:0:15"), (3, 1, 0, 0, "assign:0:15"), (4, 0, 0, 0, ""), (5, 0, 0, 0, ""),
    ]
    assert {r.base_sha256 for r in got if r.spans == ""} == {empty}
    assert secretscan.finding_digest(secretscan.secrets(table.limit(0))).collect() == []


def test_query(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op11_convolved_secrets(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id] or "")
        plain = ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()

"""Secret scan: patterns, and a character convolutional network over every candidate.

The patterns find assignments to names like ``password`` or ``api_key``, access key ids and
long hexadecimal runs. Their findings are certain and label the network's training data.

A candidate is a run of at least ``LEAST_CHARS`` characters ``[A-Za-z0-9+/_.=-]`` with a digit,
without marks at its ends. It is read in windows of ``TILE`` characters, so that a long one
is read as a whole, each with ``BEFORE`` characters of context before the candidate and
``AFTER`` after it. The network embeds characters, convolves them, keeps each filter's
largest response in the context before, in the candidate and in the context behind, and
judges these by one hidden layer. A candidate's score is that of its highest window.

``train`` learns from every candidate of every distinct text; a text's crc32 decides whether
it trains, calibrates or sets the threshold. The windows that train are dealt to shards by
their hash. In each epoch every shard starts from the same weights and descends over all of
its windows, then the weights and Adam's moments are averaged by the shards' sizes. What a
task holds does not grow with its shard. Platt scaling on the calibration part turns scores
into probabilities; its sums are taken over all scores by Spark. The threshold is the highest
that still finds ``LEAST_RECALL`` of all labelled findings of the last part, counted exactly,
but never below one half. Candidates that reach it and touch no pattern's finding are added
as ``learned``.

Result: one row per document. Offsets are code points, ends are exclusive. Null texts count
as empty and hold nothing. Where a part has no findings or nothing else, the network
adds nothing. Repeated rows are scanned alike, an empty table gives an empty result, other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from promptledger.llm.tables import stored

#: Fixed patterns, in the order of their kinds; the length that the whole match, or for
#: assignments the value, must have.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
LEAST_ACCESS = 20
LEARNED = "learned"

LEAST_CHARS = 8
_RUNS = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CHARS)
_DIGIT = re.compile(r"[0-9]")

BEFORE, TILE, AFTER = 24, 32, 8
WIDTH = BEFORE + TILE + AFTER
#: Character codes: 0 outside the text, 1 not ASCII, else from the character.
CODES = 130
EMBEDDED, FILTERS, REACH, HIDDEN = 8, 24, 5, 16
#: Windows judged together.
TOGETHER = 2_048
#: Texts read together.
TEXTS = 256

EPOCHS = 12
BATCH = 128
#: Windows of a shard; beyond ``MOST_SHARDS`` shards they become larger.
SHARD_WINDOWS = 8_192
MOST_SHARDS = 256
RATE = 0.01
#: Share of training windows whose context before is blanked, so that values count as well.
BLANKED = 0.3
LEAST_RECALL = 0.98
LEAST_CHANCE = 0.5

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """Findings of the patterns by start, then kind: (start, number of the kind, end)."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that could be secrets, by start."""
    found = []
    for m in _RUNS.finditer(text):
        run = m.group()
        inner = run.strip("+/_.=-")
        if len(inner) >= LEAST_CHARS and _DIGIT.search(inner):
            start = m.start() + len(run) - len(run.lstrip("+/_.=-"))
            found.append((start, start + len(inner)))
    return found


def encoded(text: str) -> np.ndarray:
    """A code for each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points + 2, 1).astype(np.uint8)


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all spans, and the span of each."""
    if not spans:
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64)
    codes = encoded(text)
    lines, owners = [], []
    for number, (start, end) in enumerate(spans):
        before = codes[max(0, start - BEFORE) : start]
        after = codes[end : end + AFTER]
        for at in range(start, end, TILE):
            line = np.zeros(WIDTH, np.uint8)
            line[BEFORE - len(before) : BEFORE] = before
            # The last window of a long candidate reaches back to be full.
            lo = max(start, min(at, end - TILE))
            tile = codes[lo : min(lo + TILE, end)]
            line[BEFORE : BEFORE + len(tile)] = tile
            line[BEFORE + TILE : BEFORE + TILE + len(after)] = after
            lines.append(line)
            owners.append(number)
    return np.stack(lines), np.array(owners)


@dataclass
class Network:
    """Weights, and the calibration of its scores."""

    embedding: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    hidden: np.ndarray
    hidden_offset: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    @classmethod
    def fresh(cls, draw: np.random.Generator) -> Network:
        def normal(*shape: int, fan: int) -> np.ndarray:
            return draw.normal(scale=np.sqrt(2 / fan), size=shape).astype(np.float32)

        return cls(
            embedding=draw.normal(scale=0.5, size=(CODES, EMBEDDED)).astype(np.float32),
            filters=normal(REACH, EMBEDDED, FILTERS, fan=REACH * EMBEDDED),
            offset=np.zeros(FILTERS, np.float32),
            hidden=normal(3 * FILTERS, HIDDEN, fan=3 * FILTERS),
            hidden_offset=np.zeros(HIDDEN, np.float32),
            out=normal(HIDDEN + 1, fan=HIDDEN),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.offset, self.hidden, self.hidden_offset, self.out]

    def respond(self, codes: np.ndarray) -> np.ndarray:
        """The convolution at every place. A filter's weights are applied to the embedding of
        all characters once, then looked up."""
        size = codes.shape[1] - REACH + 1
        by_code = np.einsum("ce,ref->rcf", self.embedding, self.filters)
        total = np.broadcast_to(self.offset, (len(codes), size, FILTERS)).copy()
        for k in range(REACH):
            total += by_code[k][codes[:, k : k + size]]
        return total

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        response = self.respond(codes)
        places = [response[:, lo:hi].argmax(axis=1) + lo for lo, hi in REGIONS]
        line, each = np.arange(len(codes))[:, None], np.arange(FILTERS)
        pooled = np.concatenate([response[line, p, each] for p in places], axis=1)
        kept = np.maximum(pooled, 0)
        inner = np.maximum(kept @ self.hidden + self.hidden_offset, 0)
        return inner @ self.out[:-1] + self.out[-1], inner, kept, np.concatenate(places, axis=1)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.forward(codes[lo : lo + TOGETHER])[0] for lo in range(0, len(codes), TOGETHER)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def gradients(self, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        score, inner, kept, places = self.forward(codes)
        error = ((1 / (1 + np.exp(-score)) - labels) * weight / weight.sum()).astype(np.float32)
        d_out = np.append(inner.T @ error, error.sum())
        d_inner = error[:, None] * self.out[:-1] * (inner > 0)
        d_pooled = (d_inner @ self.hidden.T) * (kept > 0)
        d_embedding, d_filters = np.zeros_like(self.embedding), np.zeros_like(self.filters)
        filter_of = np.tile(np.arange(FILTERS), 3)
        line = np.arange(len(codes))[:, None]
        one_hot = np.eye(FILTERS, dtype=np.float32)[filter_of]
        for k in range(REACH):
            seen = codes[line, places + k]
            letters = self.embedding[seen]
            d_filters[k] = np.einsum("bpe,bp,pf->ef", letters, d_pooled, one_hot, optimize=True)
            back = d_pooled[:, :, None] * self.filters[k].T[filter_of]
            np.add.at(d_embedding, seen.ravel(), back.reshape(-1, EMBEDDED))
        d_offset = d_pooled.reshape(-1, 3, FILTERS).sum(axis=(0, 1))
        return [d_embedding, d_filters, d_offset, kept.T @ d_inner, d_inner.sum(axis=0), d_out]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return chance(self.slope * self.scores(codes) + self.shift)


#: Places of the convolution whose window begins in each region.
REGIONS = ((0, BEFORE), (BEFORE, BEFORE + TILE - REACH + 1), (BEFORE + TILE - REACH + 1, WIDTH - REACH + 1))


def chance(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass
class Descent:
    """Adam on the logistic loss, where it stands."""

    network: Network
    step: int = 0
    first: list[np.ndarray] = field(default_factory=list)
    second: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.first = self.first or [np.zeros_like(w) for w in self.network.weights()]
        self.second = self.second or [np.zeros_like(w) for w in self.network.weights()]

    def numbers(self) -> list[np.ndarray]:
        return [*self.network.weights(), *self.first, *self.second]

    def read(self, flat: np.ndarray) -> None:
        """Take over all numbers, one behind the other."""
        at = 0
        for values in self.numbers():
            values[...] = flat[at : at + values.size].reshape(values.shape)
            at += values.size

    def flat(self) -> np.ndarray:
        return np.concatenate([values.ravel() for values in self.numbers()])

    def over(self, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray, draw: np.random.Generator) -> None:
        """Steps over all windows, in a drawn order."""
        order = draw.permutation(len(codes))
        for lo in range(0, len(codes), BATCH):
            rows = order[lo : lo + BATCH]
            seen = codes[rows].copy()
            seen[draw.random(len(rows)) < BLANKED, :BEFORE] = 0
            self.step += 1
            gradients = self.network.gradients(seen, labels[rows], weight[rows])
            for w, g, m, v in zip(self.network.weights(), gradients, self.first, self.second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (RATE * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)).astype(w.dtype)


def window_codes(lines: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(lines.to_pylist()), np.uint8).reshape(-1, WIDTH)


def fit(examples: DataFrame, others: int, known: int) -> Network:
    """Learn from all windows, ``known`` of which are findings; both labels weigh the same in all."""
    share = known / (known + others)
    shards = min(MOST_SHARDS, -(-(known + others) // SHARD_WINDOWS))
    place = ("name", "start", "tile")
    mixed = F.xxhash64(*place)
    dealt = (
        examples.select("known", "line", *place, mixed.alias("mixed"), F.pmod(mixed, F.lit(shards)).alias("shard"))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "mixed", *place)
        .select("shard", "known", "line")
        .persist(StorageLevel.DISK_ONLY)
    )
    now = Descent(Network.fresh(np.random.default_rng(11)))
    try:
        for epoch in range(EPOCHS):
            rows = dealt.mapInArrow(descend(now, epoch, share), "shard BIGINT, many BIGINT, step BIGINT, flat BINARY").collect()
            total = np.zeros(now.flat().size)
            for r in sorted(rows, key=lambda r: r.shard):
                total += r.many * np.frombuffer(bytes(r.flat), np.float32).astype(np.float64)
            now.read(total / sum(r.many for r in rows))
            now.step = max(r.step for r in rows)
    finally:
        dealt.unpersist()
    return now.network


def descend(begin: Descent, epoch: int, share: float):
    """One epoch of each shard; rows (shard, known, line) come shard by shard."""
    flat, step = begin.flat(), begin.step

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, many, draw, local = None, 0, None, None

        def result() -> pa.RecordBatch:
            columns = [[shard], [many], [local.step], [local.flat().astype(np.float32).tobytes()]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["shard", "many", "step", "flat"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for number, codes, labels in shard_blocks(batches):
            if number != shard:
                if shard is not None:
                    yield result()
                shard, many, draw = number, 0, np.random.default_rng([11, epoch, number])
                local = Descent(Network.fresh(np.random.default_rng(11)), step)
                local.read(flat)
            weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
            local.over(codes, labels, weight, draw)
            many += len(codes)
        if shard is not None:
            yield result()

    return run


def shard_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of ``TOGETHER`` windows of one shard, however the rows (shard, known, line) arrive;
    only the last block of a shard is smaller."""
    shard: int | None = None
    codes, labels = np.zeros((0, WIDTH), np.uint8), np.zeros(0)
    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        lines, known = window_codes(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else [0]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if shard != numbers[lo]:
                if len(codes):
                    yield shard, codes, labels
                shard, codes, labels = int(numbers[lo]), codes[:0], labels[:0]
            codes, labels = np.concatenate([codes, lines[lo:hi]]), np.concatenate([labels, known[lo:hi]])
            while len(codes) >= TOGETHER:
                yield shard, codes[:TOGETHER], labels[:TOGETHER]
                codes, labels = codes[TOGETHER:], labels[TOGETHER:]
    if len(codes):
        yield shard, codes, labels


def candidate_scores(examples: DataFrame, network: Network) -> DataFrame:
    """Every candidate's part, label and highest score; ``rank`` orders the scores exactly."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = network.scores(window_codes(batch.column(4))).astype(np.float32)
            columns = [*batch.columns[:4], pa.array(scores.astype(np.float64)), pa.array(ranks(scores))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "name", "start", "known", "score", "rank"])

    rows = examples.select("part", "name", "start", "known", "line").mapInArrow(
        judge, "part INT, name BINARY, start BIGINT, known BOOLEAN, score DOUBLE, rank BIGINT"
    )
    return rows.groupBy("part", "name", "start", "known").agg(F.max("score").alias("score"), F.max("rank").alias("rank"))


def ranks(scores: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores, which are singles."""
    bits = scores.view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)


def score_of(rank: int) -> np.ndarray:
    """The score of a rank, as an array of one single."""
    size = np.array([abs(rank)], np.int32).view(np.float32)
    return -size if rank < 0 else size


def smallest(rows: DataFrame, k: int) -> int:
    """The rank that ``k`` others precede, by counting: first ranges of ranks, then the ranks of
    the one range that holds it."""
    for cut in (1 << 16, 1):
        counted = rows.groupBy(F.expr(f"rank DIV {cut} - CAST(rank < 0 AND rank % {cut} <> 0 AS INT)").alias("at")).count()
        for at, many in sorted((r["at"], r["count"]) for r in counted.collect()):
            if k < many:
                break
            k -= many
        rows = rows.where(F.col("rank").between(at * cut, at * cut + cut - 1))
    return at


def calibrate(network: Network, scored: DataFrame, others: int, ones: int) -> None:
    """Platt scaling by Newton's method, on smoothed labels; the sums are taken by Spark."""
    at = np.array([1.0, 0.0])
    for _ in range(50):
        line = F.col("score") * float(at[0]) + float(at[1])
        p = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))
        target = F.when(F.col("known"), (ones + 1) / (ones + 2)).otherwise(1 / (others + 2))
        each = scored.select("score", (p - target).alias("off"), (p * (1 - p)).alias("bend"))
        r = each.agg(
            *(F.sum(F.expr(e)).alias(n) for n, e in (("ss", "bend * score * score"), ("s", "bend * score"), ("n", "bend"), ("ds", "off * score"), ("d", "off")))
        ).first()
        curve = np.array([[r.ss, r.s], [r.s, r.n]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, np.array([r.ds, r.d]) + 1e-3 * (at - np.array([1.0, 0.0])))
        at = at - move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-9:
            break
    network.slope, network.shift = float(max(at[0], 1e-3)), float(at[1])


def train(examples: DataFrame) -> Network | None:
    """From the windows of ``labelled_examples``; None if a label or a part is missing."""
    role = F.when(F.col("part") < 6, 0).when(F.col("part") < 8, 1).otherwise(2)
    first = F.count_if(F.col("tile") == 0)
    counted = examples.groupBy(role.alias("role"), "known").agg(F.count(F.lit(1)).alias("windows"), first.alias("spans"))
    many = {(r.role, r.known): r for r in counted.collect()}
    if len(many) < 6:
        return None
    network = fit(examples.where("part < 6"), many[0, False].windows, many[0, True].windows)
    scored = stored(candidate_scores(examples.where("part >= 6"), network), "secret-scores")
    calibrate(network, scored.where("part < 8"), many[1, False].spans, many[1, True].spans)
    least = smallest(scored.where("part >= 8 and known"), int((1 - LEAST_RECALL) * many[2, True].spans))
    network.threshold = max(LEAST_CHANCE, float(chance(network.slope * score_of(least) + network.shift)[0]))
    return network


def highest(values: np.ndarray, owners: np.ndarray, many: int) -> np.ndarray:
    """The largest value of each candidate's windows."""
    best = np.full(many, -np.inf)
    np.maximum.at(best, owners, values)
    return best


def touches(spans: list[tuple[int, int]], base: list[Span]) -> np.ndarray:
    """Whether each span overlaps a finding."""
    if not base or not spans:
        return np.zeros(len(spans), bool)
    starts = np.array([s for s, _, _ in base])
    ends = np.maximum.accumulate(np.array([e for _, _, e in base]))
    lo, hi = np.array(spans).T
    before = np.searchsorted(starts, hi)  # findings that start before the span's end
    return (before > 0) & (ends[np.maximum(before - 1, 0)] > lo)


def few_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            yield batch.slice(lo, TEXTS)


def labelled_examples(docs: DataFrame) -> DataFrame:
    """The windows of all candidates of all distinct texts, labelled by the patterns: the text's
    part (0 to 9) and hash, the candidate's start, the window's number, and whether the candidate
    touches a finding. Stored, as every epoch reads them."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_texts(batches):
            for text in batch.column(0).to_pylist():
                spans = candidates(text)
                if not spans:
                    continue
                held = text.encode("utf-8", "surrogatepass")
                part, name = zlib.crc32(held) % 10, hashlib.sha256(held).digest()[:16]
                known = touches(spans, base_spans(text))
                for lo in range(0, len(spans), TEXTS):
                    some = spans[lo : lo + TEXTS]
                    base = max(0, some[0][0] - BEFORE)
                    lines, owners = windows(text[base : some[-1][1] + AFTER], [(a - base, b - base) for a, b in some])
                    columns = [
                        pa.array(np.full(len(lines), part, np.int32)),
                        pa.array([name] * len(lines), pa.binary()),
                        pa.array(np.array(some)[owners, 0]),
                        pa.array(np.arange(len(owners)) - np.searchsorted(owners, owners)),
                        pa.array(known[lo:][owners]),
                        pa.array([line.tobytes() for line in lines], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "name", "start", "tile", "known", "line"])

    schema = "part INT, name BINARY, start BIGINT, tile BIGINT, known BOOLEAN, line BINARY"
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(texts.mapInArrow(cut, schema).distinct(), "secret-examples")  # copies are one example


def joined(spans: Iterable[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def learned_spans(texts: list[str], bases: list[list[Span]], network: Network | None) -> list[list[tuple[int, int]]]:
    """The candidates of each text that the network adds."""
    added: list[list[tuple[int, int]]] = [[] for _ in texts]
    if network is None:
        return added
    lines, owners, spans = [], [], []
    for k, (text, base) in enumerate(zip(texts, bases, strict=True)):
        found = candidates(text)
        found = [span for span, known in zip(found, touches(found, base), strict=True) if not known]
        codes, own = windows(text, found)
        lines.append(codes)
        owners.append(own + len(spans))
        spans.extend((k, *span) for span in found)
    if spans:
        score = highest(network.probabilities(np.concatenate(lines)), np.concatenate(owners), len(spans))
        for (k, start, end), value in zip(spans, score.tolist(), strict=True):
            if value >= network.threshold:
                added[k].append((start, end))
    return added


def scanned(docs: DataFrame, network: Network | None) -> DataFrame:
    """All documents (doc_id, text): doc_id and findings (kind, start, end) by start, then
    kind, those of the patterns and the learned ones."""
    model = docs.sparkSession.sparkContext.broadcast(network)
    names = (*KINDS, LEARNED)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_texts(batches):
            texts = [text or "" for text in part.column(1).to_pylist()]
            bases = [base_spans(text) for text in texts]
            added = learned_spans(texts, bases, model.value)
            rows = [
                [
                    {"kind": names[kind], "start": start, "end": end}
                    for start, kind, end in sorted([*base, *((start, len(KINDS), end) for start, end in more)])
                ]
                for base, more in zip(bases, added, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, FOUND)], ["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id BIGINT, found ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT>>")


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(docs: DataFrame) -> DataFrame:
    """Train on the documents (doc_id, text) and scan all: doc_id, found."""
    return scanned(docs, train(labelled_examples(docs)))


def finding_digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of findings of each pattern, a SHA-256 of them, and all spans."""

    def text_of(spans: str) -> str:
        return f"array_join(transform({spans}, f -> concat_ws(':', f.kind, f.start, f.end)), ',')"

    base = f"filter(found, f -> f.kind <> '{LEARNED}')"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(found, f -> f.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.expr(text_of(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(text_of("found")).alias("spans"),
    )

"""Compression of vectors to codes by k-means per part, over anchors-hierarchy metric trees.

Each component x becomes the integer floor(256 * x). Vectors are cut into equal consecutive
parts, each of which has a codebook. Runs of vectors become chunks, and each part of a chunk
a metric tree, built once from the middle out: about sqrt(n) anchors, each new one the point
farthest from the widest anchor, which takes over the points nearer to it; anchors are merged
upwards to one ball and split downwards the same way. Balls cache the sum and the number of
their points.

An assignment walks the tree with lists of candidate entries. A ball inherits its parent's
list and loses each entry that another one beats, strictly, at all of its points. A ball with
one entry left is wholly owned: its cached sum counts, its points are not looked at. What is
left in leaves is compared exactly, in integers. Ties go to the lower entry, as only strictly
worse entries ever leave a list.

Trees are stored once and read in every round; only sums per entry leave a task, so codebooks
are the only thing that the driver holds.

Result: one row per vector: vec_id, code, error, label_error, codebooks_sha256. Vectors that
are null or have null or non-finite components are dropped. The vector with the smallest
vec_id tells the length; vectors of another length, and all if it cannot be cut into equal
parts, have a null code and error. Null ids come last among the first entries, rows of equal
id in order of their vectors. Null labels are one group. Fewer vectors than entries make
smaller codebooks. Components too large for exact 64-bit distances raise an error. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.tables import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors that share trees, and points that a ball holds without being split.
CHUNK_VECTORS = 4_096
LEAF_POINTS = 64

CHUNK_COLUMNS = "ids ARRAY<BIGINT>, labels ARRAY<{label}>, trees BINARY"


def anchors(points: np.ndarray, most: int) -> np.ndarray:
    """The anchor of each point: at most so many, fewer if points are equal."""
    owner = np.zeros(len(points), np.int64)
    pivots = points[:1]
    far = np.sqrt(((points - pivots[0]) ** 2).sum(axis=1))
    while len(pivots) < most:
        last = int(far.argmax())
        if far[last] == 0:
            break
        new = points[last]
        gap = np.sqrt(((pivots - new) ** 2).sum(axis=1))
        # Points nearer to their anchor than half the way to the new one stay.
        open_ = np.flatnonzero(2 * far >= gap[owner])
        reach = np.sqrt(((points[open_] - new) ** 2).sum(axis=1))
        won = reach < far[open_]
        owner[open_[won]] = len(pivots)
        far[open_[won]] = reach[won]
        pivots = np.concatenate([pivots, new[None]])
    return owner


def merged_upwards(centers: np.ndarray, radii: np.ndarray) -> int | tuple:
    """Pairs of balls, nested, merged in order of the smallest ball around two of them."""
    many = len(radii)
    centers, radii = centers.copy(), radii.copy()
    trees: list[int | tuple] = list(range(many))
    alive = np.ones(many, bool)

    def around(k: int) -> np.ndarray:
        gap = np.sqrt(((centers - centers[k]) ** 2).sum(axis=1))
        size = np.maximum((gap + radii + radii[k]) / 2, np.maximum(radii, radii[k]))
        size[~alive] = size[k] = np.inf
        return size

    size = np.stack([around(k) for k in range(many)])
    for _ in range(many - 1):
        a, b = divmod(int(size.argmin()), many)
        gap = float(np.sqrt(((centers[a] - centers[b]) ** 2).sum()))
        if gap + radii[a] <= radii[b]:
            centers[a], radii[a] = centers[b], radii[b]
        elif gap + radii[b] > radii[a]:
            wide = (gap + radii[a] + radii[b]) / 2
            centers[a] += (centers[b] - centers[a]) * ((wide - radii[a]) / gap)
            radii[a] = wide
        trees[a] = (trees[a], trees[b])
        alive[b] = False
        size[b] = size[:, b] = np.inf
        size[a] = size[:, a] = around(a)
    return trees[int(np.flatnonzero(alive)[0])]


@dataclass
class Tree:
    """Points in the order of the tree and its balls: each is a run of points. ``left`` and
    ``right`` are balls, -1 for leaves; the first ball is the whole."""

    order: np.ndarray
    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        """Of integer points."""
        placed = points.astype(np.float64)
        runs: list[np.ndarray] = []
        balls: list[list[int]] = []  # lo, hi, left, right
        size = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal size
            owner = anchors(placed[rows], int(np.sqrt(len(rows)))) if len(rows) > LEAF_POINTS else np.zeros(len(rows), int)
            many = int(owner.max()) + 1
            if many == 1:
                balls.append([size, size + len(rows), -1, -1])
                runs.append(rows)
                size += len(rows)
                return len(balls) - 1
            groups = [rows[owner == k] for k in range(many)]
            centers = np.stack([placed[g].mean(axis=0) for g in groups])
            radii = np.array([np.sqrt(((placed[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centers, strict=True)])
            return place(merged_upwards(centers, radii), groups)

        def place(tree: int | tuple, groups: list[np.ndarray]) -> int:
            if isinstance(tree, int):
                return grow(groups[tree])
            own = len(balls)
            balls.append([size, 0, 0, 0])
            balls[own][2] = place(tree[0], groups)
            balls[own][3] = place(tree[1], groups)
            balls[own][1] = size
            return own

        grow(np.arange(len(points)))
        order = np.concatenate(runs)
        lo, hi, left, right = np.array(balls, np.int32).T
        points = points[order]
        upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), points.cumsum(axis=0)])
        total = upto[hi] - upto[lo]
        center = total / (hi - lo)[:, None]
        placed = placed[order]
        radius = np.array([((placed[a:b] - c) ** 2).sum(axis=1).max() for a, b, c in zip(lo, hi, center, strict=True)])
        return cls(order.astype(np.int32), points, lo, hi, left, right, center, np.sqrt(radius), total)

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each point, in the order of the tree, and the sum and number
        of each entry's points."""
        entries = len(book)
        near = np.zeros(len(self.points), np.int64)
        sums, counts = np.zeros_like(book), np.zeros(entries, np.int64)
        placed = book.astype(np.float64)
        gaps = np.sqrt(((placed[:, None] - placed) ** 2).sum(axis=2))
        square = (placed**2).sum(axis=1)
        slack = 1e-9 * (1 + square.max() + (self.center**2).sum(axis=1).max() + self.radius.max() ** 2)
        # Of equal entries only the first can be chosen.
        first = ~np.triu((book[:, None] == book).all(axis=2), 1).any(axis=0)
        balls, listed = np.zeros(1, np.int64), first[None]
        while len(balls):
            away = np.where(listed, square - 2 * self.center[balls] @ placed.T, np.inf)
            best = away.argmin(axis=1)
            ahead = away - away[np.arange(len(balls)), best][:, None]
            listed = listed & ~(ahead > 2 * self.radius[balls][:, None] * gaps[best] + slack)
            owned = listed.sum(axis=1) == 1
            for ball, entry in zip(balls[owned].tolist(), best[owned].tolist(), strict=True):
                near[self.lo[ball] : self.hi[ball]] = entry
                sums[entry] += self.total[ball]
                counts[entry] += self.hi[ball] - self.lo[ball]
            is_leaf = self.left[balls] < 0
            ends = ~owned & is_leaf
            if ends.any():
                rows, found = self._compare(balls[ends], listed[ends], book)
                near[rows] = found
                np.add.at(sums, found, self.points[rows])
                counts += np.bincount(found, minlength=entries)
            split = ~owned & ~is_leaf
            balls = np.concatenate([self.left[balls[split]], self.right[balls[split]]])
            listed = np.concatenate([listed[split], listed[split]])
        return near, sums, counts

    def _compare(self, leaves: np.ndarray, listed: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of leaves, and the nearest of the entries listed for their leaf."""
        sizes = self.hi[leaves] - self.lo[leaves]
        leaf = np.repeat(np.arange(len(leaves)), sizes)
        rows = np.arange(len(leaf)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.lo[leaves][leaf]
        many = listed.sum(axis=1)
        flat = np.nonzero(listed)[1]
        width = many[leaf]
        begin = np.cumsum(width) - width
        line = np.repeat(np.arange(len(rows)), width)
        entry = flat[np.arange(len(line)) - begin[line] + (np.cumsum(many) - many)[leaf[line]]]
        distance = ((self.points[rows[line]] - book[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, begin)
        hits = np.flatnonzero(distance == least[line])
        first = np.ones(len(hits), bool)
        first[1:] = line[hits[1:]] != line[hits[:-1]]
        return rows, entry[hits[first]]


_FIELDS = tuple(Tree.__dataclass_fields__)


def packed(trees: list[Tree]) -> bytes:
    held = io.BytesIO()
    # The order of a tree and integers that fit are stored in 32 bits.
    arrays = {}
    for k, tree in enumerate(trees):
        for name in _FIELDS:
            value = getattr(tree, name)
            if name == "points" and np.abs(value).max(initial=0) < 1 << 31:
                value = value.astype(np.int32)
            if name not in ("total", "center"):  # sums of runs of points
                arrays[f"{name}-{k}"] = value
    np.savez(held, **arrays)
    return held.getvalue()


def unpacked(raw: bytes) -> list[Tree]:
    arrays = np.load(io.BytesIO(raw))
    trees = []
    while f"order-{len(trees)}" in arrays:
        k = len(trees)
        fields = {name: arrays[f"{name}-{k}"] for name in _FIELDS if name not in ("total", "center")}
        points = fields["points"] = fields["points"].astype(np.int64)
        upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), points.cumsum(axis=0)])
        fields["total"] = upto[fields["hi"]] - upto[fields["lo"]]
        fields["center"] = fields["total"] / (fields["hi"] - fields["lo"])[:, None]
        trees.append(Tree(**fields))
    return trees


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x), if distances of such vectors fit into 64 bits."""
    scaled = np.floor(vectors * SCALE)
    if 4 * vectors.shape[1] * np.abs(scaled).max(initial=0) ** 2 >= 2.0**62:
        raise ValueError("vector components are too large for exact distances")
    return scaled.astype(np.int64)


def trees_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows (vec_id, label, vector), all of one length, with a tree per part."""
    held: list[pa.RecordBatch] = []

    def chunk() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        vectors = rows.column(2).chunk(0).flatten().to_numpy().reshape(rows.num_rows, -1)
        trees = packed([Tree.build(part) for part in np.split(whole_numbers(vectors), PARTS, axis=1)])
        bounds = pa.array([0, rows.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, rows.column(k).chunk(0)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.binary())], ["ids", "labels", "trees"])

    size = 0
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            part = batch.slice(lo, CHUNK_VECTORS - size)
            held.append(part)
            lo, size = lo + part.num_rows, size + part.num_rows
            if size == CHUNK_VECTORS:
                yield chunk()
                held, size = [], 0
    if held:
        yield chunk()


Books = list[np.ndarray]


def renewed(chunks: DataFrame, books: Books) -> Books:
    """Replace each entry by the mean of its parts, rounded down; unused ones stay."""
    held = chunks.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in held.value], [np.zeros(len(b), np.int64) for b in held.value]
        for batch in batches:
            for raw in batch.column(0):
                for part, tree in enumerate(unpacked(raw.as_py())):
                    _, more, many = tree.assign(held.value[part])
                    sums[part] += more
                    counts[part] += many
        for part, (total, many) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), part, np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array(many[used]),
                    pa.array(list(total[used]), pa.list_(pa.int64())),
                ],
                ["part", "entry", "n", "total"],
            )

    wide = "decimal(38,0)"
    rows = (
        chunks.select("trees")
        .mapInArrow(add, "part INT, entry INT, n BIGINT, total ARRAY<BIGINT>")
        .select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
        .groupBy("part", "entry", "place")
        .agg(F.sum(F.col("x").cast(wide)).alias("x"), F.sum("n").alias("n"))
        .collect()  # one row per component of the codebooks at most
    )
    books = [book.copy() for book in books]
    for r in rows:
        books[r.part][r.entry, r.place] = int(r.x) // r.n
    return books


def coded(chunks: DataFrame, books: Books, label_type: str) -> DataFrame:
    """vec_id, label, code and error of all vectors of the chunks."""
    held = chunks.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                trees = unpacked(batch.column(2)[row].as_py())
                codes = np.zeros((len(trees[0].order), len(trees)), np.uint8)
                error = np.zeros(len(codes), np.int64)
                for part, tree in enumerate(trees):
                    near = tree.assign(held.value[part])[0]
                    codes[tree.order, part] = near
                    error[tree.order] += ((tree.points - held.value[part][near]) ** 2).sum(axis=1)
                digits, width = codes.tobytes().hex(), 2 * len(trees)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, 1).flatten(),
                        batch.column(1).slice(row, 1).flatten(),
                        pa.array([digits[k : k + width] for k in range(0, len(digits), width)], pa.string()),
                        pa.array(error),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return chunks.mapInArrow(code, f"vec_id BIGINT, label {label_type}, code STRING, error BIGINT")


def codebooks(chunks: DataFrame, first: np.ndarray) -> Books:
    """The codebooks after all rounds, from the first vectors."""
    books = np.split(whole_numbers(first), PARTS, axis=1)
    for _ in range(ROUNDS):
        books = renewed(chunks, books)
    return books


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """One row per kept vector (vec_id, embedding, label): vec_id, code, error, label_error,
    codebooks_sha256."""
    label_type = vectors.schema["label"].dataType.simpleString()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(F.coalesce(finite, F.lit(False)))
    order = [F.asc_nulls_last("vec_id"), "embedding"]
    widest = kept.orderBy(*order).select(F.size("embedding").alias("width")).first()
    width = widest.width if widest and widest.width % PARTS == 0 else 0
    fits = F.size("embedding") == F.lit(width) if width else F.lit(False)
    chunks = stored(kept.where(fits).mapInArrow(trees_of, CHUNK_COLUMNS.format(label=label_type)), "part-trees")
    first = kept.where(fits).orderBy(*order).limit(ENTRIES).collect() if width else []
    books = codebooks(chunks, np.array([r.embedding for r in first], np.float64)) if first else []
    others = kept.where(~fits).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")
    )
    codes = stored(coded(chunks, books, label_type).unionAll(others), "vector-codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return codes.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )

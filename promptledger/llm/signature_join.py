"""Similarity join of word-shingle sets by signature trees.

1. ``signatures``: each text's shingle set gives its size, a 128-bit fingerprint and band
   keys. Equal sets become one class with one representative.
2. ``clusters``: representatives that share a band key belong to one cluster. A band key
   joins three minhashes; at similarity 0.8 a pair misses all 40 bands with probability
   (1 - 0.8 ** 3) ** 40 < 4e-13. A passage common to unrelated texts rarely fills a band.
3. Every cluster becomes signature trees over the whole shingle sets, whose nodes hold
   OR-combined token bitmaps and size ranges. A dual traversal drops node pairs whose
   largest possible overlap is too small, and node pairs that are already connected; what
   is left is compared exactly. A cluster beyond ``TILE_SHINGLES`` is parted first, without
   loss: two similar sets share one of the rarest shingles of each (``parted``). What stays
   that large is split into tiles: all members are compared with one central member and
   within their tile, and only tile pairs that hold a member not connected to the centre
   by then are traversed.
4. Links become components.

Result: one row per document. Null and blank texts have no shingles and link with
nothing. Repeated ids each keep their row; they share the id and hence the component of
the smallest one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.tables import components, stored
from promptledger.llm.textgrams import mix, text_chunks

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS = 40
ROWS_PER_BAND = 3
#: Shingles that one traversal task holds on each side (8 bytes each).
TILE_SHINGLES = 250_000
#: Sets in a leaf of a tree, and bits of a bitmap per token of a set of mean size.
LEAF_SETS = 32
BITS_PER_TOKEN = 32

MULTIPLIERS = mix(np.arange(1, BANDS * ROWS_PER_BAND + 1, dtype=np.uint64)) | np.uint64(1)


#: Shingles that are multiplied in one go.
PART_SHINGLES = 16_384


def band_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One key per band of each set, from the smallest products of its shingles with fixed
    multipliers. The sets lie one behind the other, none is empty."""
    smallest = np.empty((BANDS * ROWS_PER_BAND, len(starts)), dtype=np.uint64)
    product = np.empty_like(shingles)
    for row, multiplier in zip(smallest, MULTIPLIERS, strict=True):
        np.multiply(shingles, multiplier, out=product)
        np.minimum.reduceat(product, starts, out=row)
    bands = mix(smallest).reshape(BANDS, ROWS_PER_BAND, len(starts))
    key = np.arange(BANDS, dtype=np.uint64)[:, None]
    for column in range(ROWS_PER_BAND):
        key = mix(key + bands[:, column])
    return key.T


def _fingerprints_and_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both fingerprints and the band keys of sets that are not empty."""
    ends = np.cumsum([len(s) for s in sets])
    first, second, keys = [], [], []
    lo = 0
    while lo < len(sets):
        begin = ends[lo] - len(sets[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + PART_SHINGLES, side="right")))
        shingles = np.concatenate(sets[lo:hi])
        starts = np.append(0, ends[lo : hi - 1] - begin)
        first.append(np.add.reduceat(mix(shingles), starts))
        second.append(np.add.reduceat(mix(shingles ^ MULTIPLIERS[0]), starts))
        keys.append(band_keys(shingles, starts))
        lo = hi
    return tuple(np.concatenate(parts) for parts in (first, second, keys))


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        for lo, hi, words in text_chunks(texts):
            sets = list(words.shingle_sets(SHINGLE_WORDS))
            size = np.array([len(s) for s in sets], dtype=np.int64)
            filled = size > 0
            prints = np.zeros((2, len(sets)), dtype=np.uint64)
            flat = np.zeros(0, dtype=np.uint64)
            if filled.any():
                prints[0, filled], prints[1, filled], keys = _fingerprints_and_keys([s for s in sets if len(s)])
                flat = keys.ravel()
            ends = np.append(0, np.cumsum(filled * BANDS))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    pa.array(size),
                    pa.array(prints[0].view(np.int64)),
                    pa.array(prints[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64))),
                ],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint (fp1, fp2) and band keys of each text."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _sign, "doc_id BIGINT, n_shingles BIGINT, fp1 BIGINT, fp2 BIGINT, bands ARRAY<BIGINT>"
    )


class Node:
    """A run of sets in tree order: which tokens' bits any of them has, their sizes, and
    the most tokens that one of them hides behind a bit another token also has. A leaf
    keeps the bits of each of its sets."""

    __slots__ = ("bits", "each", "hi", "hidden", "high", "left", "lo", "low", "right")

    def __init__(self, lo, hi, bits, low, high, hidden, left=None, right=None, each=None):
        self.lo, self.hi, self.bits = lo, hi, bits
        self.low, self.high, self.hidden = low, high, hidden
        self.left, self.right, self.each = left, right, each


def bitmap(shingles: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, dtype=bool)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def tree_of(sets: list[np.ndarray], lo: int, hi: int, width: int) -> Node:
    if hi - lo <= LEAF_SETS:
        each = np.stack([bitmap(s, width) for s in sets[lo:hi]])
        sizes = np.array([len(s) for s in sets[lo:hi]])
        hidden = sizes - np.bitwise_count(each).sum(axis=1, dtype=np.int64)
        merged = np.bitwise_or.reduce(each, axis=0)
        return Node(lo, hi, merged, sizes.min(), sizes.max(), hidden.max(), each=(each, sizes, hidden))
    middle = (lo + hi) // 2
    a, b = tree_of(sets, lo, middle, width), tree_of(sets, middle, hi, width)
    return Node(
        lo, hi, a.bits | b.bits, min(a.low, b.low), max(a.high, b.high), max(a.hidden, b.hidden), a, b
    )


def enough(overlap, sizes):
    """Whether sets of so many elements in all reach the similarity with this overlap."""
    return 100 * overlap >= PERCENT * (sizes - overlap)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not enough(min(len(a), len(b)), len(a) + len(b)):
        return False
    return enough(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b))


def _possible(a: Node, b: Node) -> list[tuple[int, int]]:
    """Pairs of two leaves' sets that may link by their bits and sizes, likeliest first."""
    (bits_a, size_a, hidden_a), (bits_b, size_b, hidden_b) = a.each, b.each
    step = max(1, 2**20 // bits_b.size)
    shared = np.concatenate(
        [
            np.bitwise_count(bits_a[k : k + step, None, :] & bits_b).sum(axis=2, dtype=np.int64)
            for k in range(0, len(bits_a), step)
        ]
    )
    bound = shared + np.minimum(hidden_a[:, None], hidden_b)
    bound = np.minimum(bound, np.minimum(size_a[:, None], size_b))
    i, j = np.nonzero(enough(bound, size_a[:, None] + size_b))
    order = np.argsort(-shared[i, j], kind="stable")
    return [(a.lo + x, b.lo + y) for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True)]


def spanning_links(sets: list[np.ndarray], free: int | None = None) -> list[tuple[int, int]]:
    """Pairs that connect what the links connect, as stars. Sets from position ``free`` on
    are known to be connected already; they are not compared with each other."""
    if len(sets) == 2 and free is None:
        return [(0, 1)] if similar(sets[0], sets[1]) else []
    free = len(sets) if free is None else free
    if not free:
        return []
    # Sets with the same smallest hash are often alike: neighbours in the tree.
    order = sorted(range(free), key=lambda i: sets[i][0]) + sorted(range(free, len(sets)), key=lambda i: sets[i][0])
    sets = [sets[i] for i in order]
    mean = sum(map(len, sets)) // len(sets) + 1
    width = max(64, 1 << (BITS_PER_TOKEN * mean - 1).bit_length())
    group = np.arange(len(sets))
    group[free:] = free
    roots = [tree_of(sets, 0, free, width)]
    if free < len(sets):
        roots.append(tree_of(sets, free, len(sets), width))
    todo = [(roots[0], roots[-1])] if len(roots) == 2 else []
    todo.append((roots[0], roots[0]))
    while todo:
        a, b = todo.pop()
        here, there = group[a.lo : a.hi], group[b.lo : b.hi]
        if (here == here[0]).all() and (there == here[0]).all():
            continue
        if a is b and a.left:
            todo += [(a.left, a.right), (a.right, a.right), (a.left, a.left)]
            continue
        if a is not b:
            if not enough(min(a.high, b.high), min(a.high, b.high) + max(a.low, b.low)):
                continue
            shared = int(np.bitwise_count(a.bits & b.bits).sum(dtype=np.int64)) + min(a.hidden, b.hidden)
            if not enough(min(shared, a.high, b.high), a.low + b.low):
                continue
            if a.left and (not b.left or a.hi - a.lo >= b.hi - b.lo):
                todo += [(a.left, b), (a.right, b)]
                continue
            if b.left:
                todo += [(a, b.left), (a, b.right)]
                continue
        for i, j in _possible(a, b):
            if group[i] != group[j] and similar(sets[i], sets[j]):
                group[group == group[j]] = group[i]
    # The connected ones stand for their group.
    first = {int(group[free]): free} if free < len(sets) else {}
    centre = [first.setdefault(g, i) for i, g in enumerate(group.tolist())]
    return [(order[i], order[c]) for i, c in enumerate(centre) if i != c and i < free]


def _shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    return [s for *_, words in text_chunks(texts) for s in words.shingle_sets(SHINGLE_WORDS)]


LINK_SCHEMA = "a BIGINT, b BIGINT"
TILE_LINK_SCHEMA = f"{LINK_SCHEMA}, tied BOOLEAN"


def _links_of_bin(table: pa.Table) -> pa.Table:
    """Trees over each cluster of a bin of whole clusters."""
    table = table.sort_by([("cluster", "ascending"), ("n_shingles", "ascending"), ("rep", "ascending")])
    rep = table["rep"].to_numpy()
    cluster = table["cluster"].to_numpy()
    sets = _shingle_sets(table["text"].combine_chunks())
    cuts = np.flatnonzero(np.diff(cluster)) + 1
    found = [
        (rep[lo + i], rep[lo + j])
        for lo, hi in zip([0, *cuts], [*cuts, len(rep)], strict=True)
        for i, j in spanning_links(sets[lo:hi])
    ]
    return _link_table(found)


def _links_of_tiles(table: pa.Table) -> pa.Table:
    """Trees over one tile or two of a cluster; tied members are connected to its centre.
    A link to a tied member ties the other."""
    table = table.sort_by([("tied", "ascending"), ("n_shingles", "ascending"), ("rep", "ascending")])
    rep = table["rep"].to_numpy()
    free = len(rep) - int(table["tied"].to_numpy(zero_copy_only=False).sum())
    sets = _shingle_sets(table["text"].combine_chunks())
    found = spanning_links(sets, free)
    ties = pa.array([j >= free for _, j in found], pa.bool_())
    return _link_table([(rep[i], rep[j]) for i, j in found]).append_column("tied", ties)


def _link_table(found: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _tied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which members link with their cluster's centre."""
    for batch in batches:
        names = batch.schema.names
        members = _shingle_sets(batch.column(names.index("text")))
        centres = batch.column(names.index("centre_text")).dictionary_encode()
        known = _shingle_sets(centres.dictionary)
        tied = [
            similar(member, known[k])
            for member, k in zip(members, centres.indices.to_numpy(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index(c)) for c in ("rep", "centre")] + [pa.array(tied, pa.bool_())],
            ["rep", "centre", "tied"],
        )


def _meetings(keys: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Each rep with the leaders of its keys (rep, the columns in ``by``); keys of one rep alone
    lead nowhere. ``rows``: at most how many there are. holders: members of these keys."""
    leaders = stored(
        keys.groupBy(*by).agg(F.min("rep").alias("leader"), F.count("*").alias("holders")).where("holders > 1"),
        "leaders",
        rows,
    )
    return stored(
        keys.join(leaders, by).groupBy("rep", "leader").agg(F.sum("holders").alias("holders")), "meetings", rows
    )


def _shingle_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text, the last column, beside the other columns."""
    for batch in batches:
        *others, texts = batch.columns
        for lo, hi, words in text_chunks(texts):
            sets = list(words.shingle_sets(SHINGLE_WORDS))
            ends = np.append(0, np.cumsum([len(s) for s in sets]))
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(lo, hi - lo) for c in others), lists], [*batch.schema.names[:-1], "shingles"]
            )


def parted(members: DataFrame) -> DataFrame:
    """(rep, cluster) anew for members (cluster, rep, text) of clusters; the others have no link.

    Order the shingles of a cluster, those of few members first. Of two similar sets each has
    PERCENT of its shingles in common with the other, so the first common one is not behind
    the first ``n - ceil(n * PERCENT / 100) + 1`` of either. Members that share such a shingle
    stay together. A passage that many texts hold is frequent and comes last: it keeps texts
    together only where little else is in them.
    """
    sets = stored(
        members.select("cluster", "rep", F.xxhash64("text").alias("row"), "text").mapInArrow(
            _shingle_rows, "cluster BIGINT, rep BIGINT, row BIGINT, shingles ARRAY<BIGINT>"
        ),
        "shingle-sets",
    )
    rows = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    exploded = sets.select("cluster", "rep", "row", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = stored(
        exploded.groupBy("cluster", "shingle").agg(F.count("*").alias("members")).where("members > 1"),
        "shared-shingles",
        rows,
    )
    # Shingles of one member come first and meet nobody; they only take their places.
    prefix = F.expr(f"greatest(n - (n * {PERCENT} + 99) div 100 + 1 - (n - size(common)), 0)").cast("int")
    keys = stored(
        exploded.join(shared, ["cluster", "shingle"])
        .groupBy("cluster", "rep", "row", "n")
        .agg(F.sort_array(F.collect_list(F.struct("members", "shingle"))).alias("common"))
        .select("cluster", "rep", F.explode(F.slice("common", 1, prefix)).alias("key"))
        .select("cluster", "rep", F.col("key.shingle").alias("shingle")),
        "rare-shingles",
        rows,
    )
    met = _meetings(keys, ["cluster", "shingle"], rows)
    joined = components(met.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    return joined.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def _cluster_sizes(members: DataFrame, rows: int) -> DataFrame:
    return stored(
        members.groupBy("cluster").agg(
            F.sum("n_shingles").alias("shingles"),
            F.max(F.struct("degree", F.negative("rep").alias("rep"))).alias("top"),
        ),
        "cluster-sizes",
        rows,
    )


def links_in_clusters(members: DataFrame) -> DataFrame:
    """Spanning links (a, b) of members (cluster, rep, n_shingles, degree, text)."""
    rows = members.count()
    sizes = _cluster_sizes(members, rows)
    large = sizes.where(F.col("shingles") > TILE_SHINGLES).select("cluster")
    sized = members.join(sizes.select("cluster", "shingles"), "cluster")
    if not large.isEmpty():
        whole = members.join(large, "cluster", "left_anti").select("rep", "cluster").distinct()
        clusters = stored(parted(members.join(large, "cluster")).unionByName(whole), "parted", rows)
        sizes = _cluster_sizes(members.drop("cluster").join(clusters, "rep"), rows)
        sized = members.drop("cluster").join(
            clusters.join(sizes.select("cluster", "shingles"), "cluster").hint("shuffle_hash"), "rep"
        )
    small_total = sizes.where(F.col("shingles") <= TILE_SHINGLES).agg(F.sum("shingles")).first()[0] or 0
    workers = members.sparkSession.sparkContext.defaultParallelism
    bins = max(-(-small_total // TILE_SHINGLES), 4 * workers)
    # Numbers of tasks are given here and below: the work of a task is not in its bytes.
    in_bins = (
        sized.where(F.col("shingles") <= TILE_SHINGLES)
        .withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins)))
        .select("bin", "cluster", "rep", "n_shingles", "text")
        .repartition(bins, "bin")
        .groupBy("bin")
        .applyInArrow(_links_of_bin, LINK_SCHEMA)
    )
    large = sizes.where(F.col("shingles") > TILE_SHINGLES)
    tile_count = large.agg(F.sum(F.ceil(F.col("shingles") / TILE_SHINGLES))).first()[0]
    if not tile_count:
        return in_bins
    tiled = stored(sized.where(F.col("shingles") > TILE_SHINGLES), "large-clusters")
    centre = F.negative("top.rep")
    centres = (
        tiled.join(large.select("cluster", centre.alias("rep")), ["cluster", "rep"])
        .select("cluster", F.col("rep").alias("centre"), F.col("text").alias("centre_text"))
    )
    ties = stored(
        tiled.join(centres, "cluster")
        .select("rep", "centre", "text", "centre_text")
        .mapInArrow(_tied, "rep BIGINT, centre BIGINT, tied BOOLEAN"),
        "ties",
    )
    marked = tiled.join(ties.select("rep", "tied"), "rep")
    in_tiles = stored(
        marked.join(marked.where(~F.col("tied")).select("cluster").distinct(), "cluster", "left_semi")
        .withColumn("tile", F.expr(f"pmod(xxhash64(rep, 'first'), ceil(shingles / {TILE_SHINGLES}))"))
        .select("cluster", "tile", "rep", "n_shingles", "tied", "text")
        .repartition(max(int(tile_count), 4 * workers), "cluster", "tile")
        .groupBy("cluster", "tile")
        .applyInArrow(_links_of_tiles, TILE_LINK_SCHEMA),
        "tile-links",
    )
    newly = in_tiles.where("tied").select(F.col("a").alias("rep"), F.lit(True).alias("newly")).distinct()
    marked = marked.join(newly, "rep", "left").withColumn("tied", F.col("tied") | F.col("newly").isNotNull())
    tiles = stored(
        marked.groupBy("cluster").agg(
            *(
                F.coalesce(
                    F.ceil(F.sum(F.when(F.col("tied") == tied, F.col("n_shingles"))) / TILE_SHINGLES), F.lit(0)
                ).cast("bigint").alias(name)
                for name, tied in (("open_tiles", False), ("tied_tiles", True))
            )
        ).where("open_tiles > 0"),
        "tiles",
        rows,
    )
    to_centre = ties.where("tied").select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    links = in_bins.unionAll(in_tiles.select("a", "b")).unionAll(to_centre)
    # Open tiles meet each other and every tied tile; tied tiles do not meet.
    pair_count = tiles.agg(F.expr("sum(open_tiles * (open_tiles + 1) div 2 + open_tiles * tied_tiles)")).first()[0]
    if not pair_count:
        return links
    pairs = (
        marked.join(tiles, "cluster")
        .withColumn("at", F.xxhash64("rep", F.lit("tile")))
        .withColumn(
            "tile",
            F.when(F.col("tied"), F.col("open_tiles") + F.expr("pmod(at, greatest(tied_tiles, 1))")).otherwise(
                F.expr("pmod(at, open_tiles)")
            ),
        )
        .withColumn(
            "other",
            F.explode(
                F.when(F.col("tied"), F.expr("sequence(0L, open_tiles - 1)")).otherwise(
                    F.expr("sequence(0L, open_tiles + tied_tiles - 1)")
                )
            ),
        )
        .select(
            "cluster",
            F.least("tile", "other").alias("one"),
            F.greatest("tile", "other").alias("two"),
            "rep",
            "n_shingles",
            "tied",
            "text",
        )
    )
    within = (
        pairs.repartition(max(int(pair_count), 4 * workers), "cluster", "one", "two")
        .groupBy("cluster", "one", "two")
        .applyInArrow(_links_of_tiles, TILE_LINK_SCHEMA)
    )
    return links.unionAll(within.select("a", "b"))


def similarity_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked id)."""
    signed = stored(signatures(docs), "signatures")
    rows = signed.count()
    classes = stored(
        signed.where("n_shingles > 0")
        .groupBy("fp1", "fp2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")),
        "classes",
        rows * BANDS // 4,
    )
    keys = classes.select("rep", F.explode("bands").alias("key"))
    met = _meetings(keys, ["key"], rows * BANDS)
    clusters = components(met.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    degrees = met.groupBy("rep").agg(F.sum("holders").alias("degree"))
    members = stored(
        clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        .join(degrees, "rep")
        .join(classes.select("rep", "n_shingles"), "rep"),
        "members",
        rows,
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string"))
    # Shuffled at every size: a plan that moves texts only beyond some size is no plan.
    chosen = texts.join(members.hint("shuffle_hash"), "rep").dropDuplicates(["rep", "text"])
    chosen = stored(chosen, "member-texts")
    joined = components(links_in_clusters(chosen))
    roots = joined.select(F.col("node").alias("rep"), "component")
    found = stored(
        classes.select("fp1", "fp2", "n_shingles", "rep")
        .join(roots, "rep", "left")
        .select("fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component_id")),
        "class-components",
        rows,
    )
    return signed.join(found, ["fp1", "fp2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


#: Made keys are above all ids.
MADE = 1 << 62


def _free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, longer where the documents have such columns."""
    taken = {c.lower() for c in docs.columns}
    return ["_" * max([0, *(len(c) for c in taken if c.endswith(n))]) + n for n in names]


def _row_keys(docs: DataFrame, key: str) -> DataFrame:
    """The documents with a key: their id, or where several texts share it or it is null, a
    hash above all ids that tells (id, text) apart."""
    own, shared_id, mark = F.col("doc_id").cast("bigint"), *_free_names(docs, "shared_id", "mark")
    text = F.col("text").cast("string")
    shared = stored(
        docs.select(own.alias(shared_id), F.xxhash64(text).alias("h"))
        .where(F.col(shared_id).isNotNull())
        .groupBy(shared_id)
        .agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
        .where("lo <> hi")
        .select(shared_id, F.lit(True).alias(mark)),
        "shared-ids",
        docs.count(),
    )
    made = F.lit(MADE) + F.pmod(F.xxhash64(own, text), F.lit(1 << 61))
    alone = F.col(mark).isNull() & own.isNotNull()
    joined = docs.join(shared, own == F.col(shared_id), "left").withColumn(key, F.when(alone, own).otherwise(made))
    return joined.drop(shared_id, mark)


def one_per_group(docs: DataFrame) -> DataFrame:
    """Rows of the documents, all columns: of each group of linked documents the one with
    the smallest id. Rows that share an id, or have none, are told apart by their texts: each
    stays unless its own text is linked to that of the row that stays. Rows without an id come
    after all others. Of rows equal in id and text one stays; texts without words all stay."""
    key = _free_names(docs, "row_key")[0]
    keyed = _row_keys(docs, key)
    ids = keyed.select(F.col(key).alias("doc_id"), "text", F.col("doc_id").cast("bigint").alias("id"))
    found = stored(similarity_components(ids).where("n_shingles > 0"), "row-components")
    made = ids.where(F.col("doc_id") >= MADE).select("doc_id", F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"))
    named = found.join(made.distinct(), "doc_id", "left")
    rank = F.struct(F.coalesce("id", "doc_id").alias("id"), F.col("doc_id").alias("key"))
    groups = named.groupBy("component_id").agg(F.min(rank).alias("first"), F.count("*").alias("rows"))
    groups = groups.where("rows > 1").select("component_id", F.col("first.key").alias("first"))
    members = stored(
        found.join(groups, "component_id")
        .select(F.col("doc_id").alias(key), (F.col("doc_id") == F.col("first")).alias("stays"))
        .distinct(),
        "not-alone",
        docs.count(),
    )
    # Shuffled at every size, as the texts of candidates are.
    single = keyed.join(members.select(key).hint("shuffle_hash"), key, "left_anti")
    first = keyed.join(members.where("stays").select(key), key, "left_semi").dropDuplicates([key])
    return single.unionByName(first).select(*docs.columns)

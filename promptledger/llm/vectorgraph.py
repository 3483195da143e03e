"""Near-duplicate embeddings by hierarchical navigable small-world graphs per shard.

Vectors of one label and length are dealt by hash into shards of bounded bytes and number. Every shard
gets a graph: layers of fewer and fewer vectors, each linked to close ones in several
directions. Each shard's vectors query their own graph and those of the shards before, so
every pair of shards meets once, in a task of its own.

A query descends greedily and then searches the lowest layer with a beam. Vectors it comes
across with a cosine of at least the threshold, in double precision, are links. Equal vectors
are one vertex and one query. Queries of a fixed random choice are audited against all vectors
of the shard: each of them that has links must reach ``RECALL`` by itself, or the beam is
doubled. Where too few of them have links besides those of the largest group, more are audited.
Where ``WIDEST`` does not do, every vector is compared with every other.

Result: one row per vector: vec_id, n_links, component_id, kept. A vector that is null, zero
or has null or non-finite components, or whose label is null, links with nothing. Rows of
one id are not linked with each other and share their links. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.tables import components, stored
from promptledger.llm.textgrams import mix

THRESHOLD = 0.93
#: What single precision may make of it at least.
CLOSE = THRESHOLD - 1e-4
#: Bytes of a shard's vectors, eight per component.
SHARD_BYTES = 4 << 20
#: Vectors of a shard, however short: the table of links found has this many squared.
SHARD_VECTORS = 8_192
#: Links of a vector in the lowest layer; half as many above.
DEGREE = 16
BEAM = 32
RECALL = 0.99
#: Queries audited at first, and how many of them must have links besides the largest group's.
AUDITED = 512
LINKED = 64
#: Beam beyond which it costs less to compare all vectors of a shard.
WIDEST = 8 * BEAM
#: Vectors inserted or queried together.
TOGETHER = 512


class Layer:
    """Links of the first ``size`` vectors: a fixed number of places each, -1 if empty."""

    def __init__(self, vectors: np.ndarray, size: int, degree: int):
        self.vectors, self.degree = vectors, degree
        self.links = np.full((size, degree), -1, dtype=np.int64)

    def search(
        self, queries: np.ndarray, entries: np.ndarray, beam: int, seen_by=None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The beam's vectors and cosines per query, best first; -1 where there are fewer.
        ``seen_by`` is told all vectors the queries come across, with their cosines."""
        count = len(queries)
        line = np.arange(count)
        visited = np.zeros((count, len(self.links) + 1), dtype=bool)  # the last is for -1
        visited[:, -1] = True
        ids = np.full((count, beam), -1, dtype=np.int64)
        near = np.full((count, beam), -np.inf, dtype=np.float32)
        done = np.ones((count, beam), dtype=bool)
        ids[:, 0], done[:, 0] = entries, False
        near[:, 0] = np.einsum("qd,qd->q", self.vectors[entries], queries)
        visited[line, entries] = True
        if seen_by:
            seen_by(line, entries, near[:, 0])
        active = line
        while len(active):
            waiting = np.where(done[active], -np.inf, near[active])
            best = waiting.argmax(axis=1)
            open_ = waiting[np.arange(len(active)), best] > -np.inf
            active, best = active[open_], best[open_]
            if not len(active):
                break
            done[active, best] = True
            around = self.links[ids[active, best]]
            new = ~visited[active[:, None], around]
            visited[active[:, None], around] = True
            cosine = np.einsum("qmd,qd->qm", self.vectors[around], queries[active])
            cosine[~new] = -np.inf
            if seen_by:
                at, place = np.nonzero(new)
                seen_by(active[at], around[at, place], cosine[at, place])
            better = (cosine > near[active, -1][:, None]).any(axis=1)
            rows = active[better]
            all_near = np.concatenate([near[rows], cosine[better]], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            near[rows] = np.take_along_axis(all_near, order, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], around[better]], axis=1), order, 1)
            unseen = np.concatenate([done[rows], ~new[better]], axis=1)
            done[rows] = np.take_along_axis(unseen, order, 1) | ~np.isfinite(near[rows])
        return np.where(np.isfinite(near), ids, -1), near

    def select(self, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of candidates per line, best first, those closer to the vector than to any chosen
        before, filled up with the best of the others."""
        count, width = ids.shape
        chosen = np.zeros((count, width), dtype=bool)
        held = self.vectors[ids]
        between = np.einsum("qad,qbd->qab", held, held)
        for k in range(width):
            rival = (between[:, k, :] * chosen).max(axis=1, initial=-1, where=chosen)
            chosen[:, k] = (near[:, k] > rival) & (ids[:, k] >= 0) & (chosen.sum(axis=1) < self.degree)
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, : self.degree]
        result = np.full((count, self.degree), -1, dtype=np.int64)
        result[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
        return result

    def connect(self, new: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        """Link new vectors to candidates, and those back to them."""
        self.links[new] = self.select(ids, near)
        back, target = np.repeat(new, self.degree), self.links[new].ravel()
        back, target = back[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        back, target = back[order], target[order]
        owners, first, counts = np.unique(target, return_index=True, return_counts=True)
        width = self.degree + int(counts.max(initial=0))
        for lo in range(0, len(owners), TOGETHER):
            own, many, at = (x[lo : lo + TOGETHER] for x in (owners, counts, first))
            candidates = np.full((len(own), width), -1, dtype=np.int64)
            candidates[:, : self.degree] = self.links[own]
            for r in range(len(own)):
                candidates[r, self.degree : self.degree + many[r]] = back[at[r] : at[r] + many[r]]
            cosine = np.einsum("qmd,qd->qm", self.vectors[candidates], self.vectors[own])
            cosine[candidates < 0] = -np.inf
            order = np.argsort(-cosine, axis=1, kind="stable")[:, : 2 * self.degree]
            self.links[own] = self.select(
                np.take_along_axis(candidates, order, 1), np.take_along_axis(cosine, order, 1)
            )


class Graph:
    """A graph over unit vectors; ``salt`` fixes which of them reach the upper layers."""

    def __init__(self, vectors: np.ndarray, salt: np.ndarray):
        chance = (mix(salt) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.floor(-np.log(np.maximum(chance, 1e-300)) / np.log(DEGREE / 2)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        level = level[self.order]
        self.vectors = vectors[self.order].astype(np.float32)
        sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)]
        self.layers = [Layer(self.vectors, n, DEGREE if k == 0 else DEGREE // 2) for k, n in enumerate(sizes)]
        self._build()
        self._targets = self.layers[0].links.ravel()
        self._sources = np.repeat(np.arange(len(self.vectors)), DEGREE)

    def _build(self) -> None:
        lo = 1
        while lo < len(self.vectors):
            hi = min(len(self.vectors), lo + min(TOGETHER, lo))
            new = np.arange(lo, hi)
            entries = np.zeros(len(new), dtype=np.int64)
            for layer in reversed(self.layers):
                here = new < len(layer.links)
                ids, near = layer.search(self.vectors[new], entries, BEAM if here.any() else 1)
                entries = ids[:, 0]
                if here.any():
                    own = new[here]
                    among = self.vectors[own] @ self.vectors[own].T
                    among[np.triu_indices(len(own))] = -np.inf  # earlier ones of the same batch
                    all_ids = np.concatenate([ids[here], np.broadcast_to(own, among.shape)], axis=1)
                    all_near = np.concatenate([near[here], among], axis=1)
                    order = np.argsort(-all_near, axis=1, kind="stable")[:, : 2 * DEGREE]
                    best = np.take_along_axis(all_near, order, 1)
                    found = np.where(np.isfinite(best), np.take_along_axis(all_ids, order, 1), -1)
                    layer.connect(own, found, best)
            lo = hi

    def query(self, queries: np.ndarray, beam: int, seen_by) -> None:
        """Tell ``seen_by`` (query, vector, cosine) of all that the queries come across. A
        beam full of links widens to all that links lead to or come from."""
        entries = np.zeros(len(queries), dtype=np.int64)
        for layer in reversed(self.layers[1:]):
            entries = layer.search(queries, entries, 1)[0][:, 0]
        ids, near = self.layers[0].search(
            queries, entries, beam, lambda q, v, cosine: seen_by(q, self.order[v], cosine)
        )
        for q in np.flatnonzero(near[:, -1] >= CLOSE):
            visited = np.zeros(len(self.order) + 1, dtype=bool)
            visited[-1] = True
            front = ids[q]
            visited[front] = True
            while len(front):
                reached = np.zeros_like(visited)
                reached[self.layers[0].links[front]] = True
                here = np.zeros_like(visited)
                here[front] = True
                reached[self._sources[here[self._targets]]] = True
                front = np.flatnonzero(reached & ~visited)
                visited[front] = True
                cosine = self.vectors[front] @ queries[q]
                front, cosine = front[cosine >= CLOSE], cosine[cosine >= CLOSE]
                seen_by(np.full(len(front), q), self.order[front], cosine)


def compared(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which members each query is linked with, all of them compared."""
    found = np.zeros((len(queries), len(members)), dtype=bool)
    for lo in range(0, len(queries), TOGETHER):
        found[lo : lo + TOGETHER] = queries[lo : lo + TOGETHER] @ members.T >= THRESHOLD
    return found


def distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each set of equal ones, in order, and the set of each row."""
    rows = np.ascontiguousarray(vectors + 0.0)  # no negative zeros
    whole = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    return np.sort(first), rank[number]


def audit(queries: np.ndarray, members: np.ndarray, order: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Queries to audit and their true links: as many, in the given order, as it takes for
    ``LINKED`` to have some besides those of the largest group, or all of them."""
    size = AUDITED
    while True:
        truth = compared(queries[order[:size]], members)
        links = truth.sum(axis=1)
        others = links > alone  # queries that are members find themselves
        if others.any():
            largest = truth[links.argmax()]
            others &= ~(truth & largest).any(axis=1)
        if size >= len(order) or others.sum() >= LINKED:
            return order[:size], truth
        size *= 4


def matches(queries: np.ndarray, members: np.ndarray, salt: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which members each query is linked with, as a table of booleans: what a search of the
    members' graph comes across, whatever their number. ``salt`` is the graph's, ``order`` the
    one in which queries are audited."""
    audited, truth = audit(queries, members, order, members is queries)
    graph, beam = Graph(members, salt), BEAM
    while beam <= WIDEST:
        found = np.zeros((len(queries), len(members)), dtype=bool)
        for lo in range(0, len(queries), TOGETHER):
            part = queries[lo : lo + TOGETHER]

            def seen(q, v, cosine, lo=lo, part=part):
                close = cosine >= CLOSE
                q, v = q[close], v[close]
                exact = np.einsum("nd,nd->n", part[q], members[v]) >= THRESHOLD
                found[lo + q[exact], v[exact]] = True

            graph.query(part.astype(np.float32), beam, seen)
        known = found[audited]
        if members is queries:  # a query's own vector stands for its copies, and tells nothing
            np.fill_diagonal(found, True)
            known = known | found[:, audited].T
            known[np.arange(len(audited)), audited] = truth[np.arange(len(audited)), audited] = False
        if ((known & truth).sum(axis=1) >= RECALL * truth.sum(axis=1)).all():
            return found
        beam *= 2
    return compared(queries, members)


def smallest_linked(found: np.ndarray) -> np.ndarray:
    """Component number of each row of a symmetric table: its smallest row."""
    label = np.arange(len(found))
    while True:
        least = label.copy()
        for lo in range(0, len(found), TOGETHER):
            part = found[lo : lo + TOGETHER]
            least[lo : lo + TOGETHER] = np.minimum(
                label[lo : lo + TOGETHER], np.where(part, label, len(found)).min(axis=1, initial=len(found))
            )
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


RESULT_SCHEMA = "vec_id BIGINT, n_links BIGINT, a BIGINT"


def _shard_pair(table: pa.Table) -> pa.Table:
    """Rows (vec_id, links found, a vector of the same component) of two shards."""
    ids = table["vec_id"].to_numpy()
    member = table["home"].to_numpy() == table["graph"].to_numpy()
    flat = table["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64)
    vectors = flat.reshape(len(ids), -1)
    vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    order = np.lexsort((np.arange(len(ids)), ids))
    ids, member, vectors = ids[order], member[order], vectors[order]
    members, member_ids = vectors[member], ids[member]
    alone = bool(member.all())
    asking, asking_ids = (members, member_ids) if alone else (vectors[~member], ids[~member])
    if not len(members) or not len(asking):
        return pa.table({"vec_id": ids[:0], "n_links": ids[:0], "a": ids[:0]})
    first, number = distinct(members)
    points, salt = members[first], member_ids[first].astype(np.uint64)
    first, asked = (first, number) if alone else distinct(asking)
    order = np.argsort(mix(asking_ids[first].astype(np.uint64) + np.uint64(1)), kind="stable")
    found = matches(points if alone else asking[first], points, salt, order)[asked][:, number]
    found[asking_ids[:, None] == member_ids] = False
    if alone:
        found |= found.T
        everyone, links, whole = member_ids, found.sum(axis=1), found
        root = everyone[smallest_linked(whole)]
    else:
        everyone = np.concatenate([member_ids, asking_ids])
        links = np.concatenate([found.sum(axis=0), found.sum(axis=1)])
        root = _bipartite_roots(found, everyone)
    return pa.table({"vec_id": everyone, "n_links": links.astype(np.int64), "a": root})


def _bipartite_roots(found: np.ndarray, everyone: np.ndarray) -> np.ndarray:
    """A vector of each one's component, of members and then queries."""
    queries, members = found.shape
    label = np.arange(members + queries)
    while True:
        left, right = label[:members], label[members:]
        new = label.copy()
        for lo in range(0, queries, TOGETHER):
            part = found[lo : lo + TOGETHER]
            here = slice(members + lo, members + lo + len(part))
            new[here] = np.minimum(new[here], np.where(part, left, len(label)).min(axis=1, initial=len(label)))
            new[:members] = np.minimum(
                new[:members], np.where(part, new[here][:, None], len(label)).min(axis=0, initial=len(label))
            )
        new = np.minimum(new, new[new])
        if (new == label).all():
            return everyone[label]
        label = new


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vector (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("label"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.coalesce(finite, F.lit(False))
        & F.exists("embedding", lambda x: x != 0)
    ).withColumn("dims", F.size("embedding"))
    sizes = stored(
        usable.groupBy("label", "dims")
        .count()
        .select(
            "label",
            "dims",
            F.ceil(
                F.greatest(F.col("count") * F.col("dims") * 8 / SHARD_BYTES, F.col("count") / SHARD_VECTORS)
            ).cast("int").alias("shards"),
        ),
        "vector-shards",
    )
    # One line per label and length; a vector goes to the graphs of its own and earlier shards.
    dealt = (
        usable.join(sizes, ["label", "dims"])
        .withColumn("home", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .withColumn("graph", F.least("home", "other"))
        .withColumn("asking", F.greatest("home", "other"))
    )
    found = stored(
        dealt.select("label", "dims", "graph", "asking", "home", "vec_id", "embedding")
        .groupBy("label", "dims", "graph", "asking")
        .applyInArrow(_shard_pair, RESULT_SCHEMA),
        "vector-links",
    )
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    joined = components(found.select("a", F.col("vec_id").alias("b")))
    return (
        rows.select("vec_id")
        .join(counts, "vec_id", "left")
        .join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("vec_id")), F.lit(True)).alias("kept"),
        )
    )

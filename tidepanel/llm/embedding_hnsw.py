"""Embedding near-duplicates with hierarchical navigable small-world graphs, one per shard of a label.

Equal vectors of a label are one vertex. The vertices of a label are dealt into shards of bounded size; each shard gets a
graph, built in batches with numpy. Every shard is queried with every shard of its label (each unordered pair of shards
once): searches of many queries run in step through the layers. A bounded audit decides on the beams: a fixed number of
random queries is compared with the whole shard, and disturbed copies of indexed vectors must find what they were made
from. Beams are widened until the audit misses nothing, and further for each query whose beam is full of links; queries
that the widest beam does not settle are compared with all vectors of the shard. Cosines of what is found are verified in
double precision; links inside a pair of shards are counted and thinned to a spanning forest before they leave the task,
and the forests are united as Spark jobs. `recall` reports what the graphs alone find.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.components import components
from tidepanel.llm.store import cut, tidy

THRESHOLD = 0.98
#: Vertices a shard holds on average at most, and bytes of its vectors in double precision.
SHARD, SHARD_BYTES = 100_000, 48 << 20
DEGREE, BUILD_BEAM, BEAM, EXPAND, CHUNK = 12, 32, 32, 4, 1024
#: Queries of a pair of shards that are compared with all vectors, and disturbed copies that are searched.
AUDIT, PROBES = 64, 256
#: Queries that need a wider beam are compared with all vectors of the shard.
WIDEST = 256
#: Shards that meet a shard in one task at most.
PARTNERS = 16
SLACK = 1e-5
#: Bytes of the marks of visited vertices of one chunk of queries, and of one block of compared queries.
MARKS = 64 << 20


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds all of them, each higher one about a DEGREE-th."""

    def __init__(self, unit: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.unit, self.layers = unit, layers  # layer: (members, neighbours as row numbers or -1)

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 1) -> Graph:
        n = len(unit)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(rng.random(n)) / np.log(DEGREE)).astype(int) if n else np.zeros(0, int)
        graph, above = cls(unit, []), None
        for layer in range(int(level.max()) if n else 0, -1, -1):
            members = np.flatnonzero(level >= layer)
            links = np.full((n, 2 * DEGREE if layer == 0 else DEGREE), -1, dtype=np.int32)
            start = members[:1] if above is None else above[:1]
            done = min(len(members), 2 * DEGREE)
            # members of the layer above come first: their entry points are themselves
            order = members if above is None else np.concatenate((above, np.setdiff1d(members, above)))
            graph._connect(order[:done], order[:0], None, links)
            while done < len(order):
                part = order[done : done + min(done, CHUNK)]
                entry = graph.descend(unit[part], start)
                found, _ = search(unit, links, unit[part], entry, BUILD_BEAM)
                graph._connect(part, part, found, links)
                done += len(part)
            graph.layers.insert(0, (members, links))
            above = members
        return graph

    def descend(self, queries: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Best node of the layers built so far above the one at hand, from the top down."""
        entry = np.full(len(queries), start[0])
        for _, links in self.layers[::-1]:
            entry = search(self.unit, links, queries, entry, 1)[0][:, 0]
        return entry

    def _connect(self, part: np.ndarray, peers: np.ndarray, found: np.ndarray | None, links: np.ndarray) -> None:
        """Link the nodes of part to their best candidates (found earlier, and each other), and those back."""
        peers = part
        near = self.unit[part] @ self.unit[peers].T
        np.fill_diagonal(near, -2)
        k = min(len(peers) - 1, BUILD_BEAM)
        own = peers[np.argpartition(-near, k - 1, 1)[:, :k]] if k > 0 else np.zeros((len(part), 0), dtype=np.int64)
        both = own if found is None else np.concatenate((own, found), 1)
        if not both.shape[1]:
            return
        chosen = self._diverse(part, both, links.shape[1] // 2 if links.shape[1] > DEGREE else DEGREE)
        links[part, : chosen.shape[1]] = chosen
        # backward links, merged with those that a node has and thinned
        to, new = chosen.reshape(-1), np.repeat(part, chosen.shape[1])
        ok = to >= 0
        to, new = to[ok], new[ok]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        more = np.full((len(nodes), width), -1, dtype=np.int64)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = new
        for lo in range(0, len(nodes), CHUNK):
            some = nodes[lo : lo + CHUNK]
            all_of = np.concatenate((links[some], more[lo : lo + CHUNK]), 1)
            used = (all_of >= 0).sum(1)
            room = used <= links.shape[1]
            if room.any():
                packed = -np.sort(-all_of[room], 1)[:, : links.shape[1]]
                links[some[room], : packed.shape[1]] = packed
            if (~room).any():
                links[some[~room]] = -1
                thin = self._diverse(some[~room], all_of[~room], links.shape[1])
                links[some[~room], : thin.shape[1]] = thin

    def _diverse(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Per node up to `most` candidates, nearest first, each nearer to the node than to those taken before; filled up
        with the nearest others."""
        out = np.full((len(nodes), min(most, candidates.shape[1])), -1, dtype=np.int64)
        for lo in range(0, len(nodes), 256):
            own, cand = nodes[lo : lo + 256], candidates[lo : lo + 256]
            cand = -np.sort(-cand, 1)
            same = np.zeros(cand.shape, dtype=bool)
            same[:, 1:] = cand[:, 1:] == cand[:, :-1]
            bad = same | (cand < 0) | (cand == own[:, None])
            vec = self.unit[cand]
            sim = np.where(bad, -3, np.einsum("ncd,nd->nc", vec, self.unit[own], optimize=True))
            order = np.argsort(-sim, 1, kind="stable")[:, : BUILD_BEAM + 2 * DEGREE]
            sim, cand = np.take_along_axis(sim, order, 1), np.take_along_axis(cand, order, 1)
            vec = np.take_along_axis(vec, order[:, :, None], 1)
            cross = vec @ vec.transpose(0, 2, 1)
            taken = np.zeros(sim.shape, dtype=bool)
            closest = np.full(sim.shape, -2.0)
            count = np.zeros(len(own), dtype=int)
            for c in range(sim.shape[1]):
                take = (sim[:, c] > -2.5) & (closest[:, c] < sim[:, c]) & (count < most)
                taken[:, c] = take
                count += take
                closest = np.where(take[:, None], np.maximum(closest, cross[:, c]), closest)
            rank = np.argsort(np.where(sim <= -2.5, 2, np.where(taken, 0, 1)) * 1000 + np.arange(sim.shape[1]), 1)[:, : out.shape[1]]
            pick = np.take_along_axis(cand, rank, 1)
            out[lo : lo + 256, : pick.shape[1]] = np.where(np.take_along_axis(sim, rank, 1) > -2.5, pick, -1)
        return out

    def query(self, queries: np.ndarray, beam: int, own: np.ndarray | None = None):
        """(ids, cosines) of the beam of each query, best first; own: the queries' rows where they are in this graph."""
        if own is None:
            top, rest = self.layers[-1][0][:1], self.layers[:0:-1]
            own = np.full(len(queries), top[0])
            for _, links in rest:
                own = search(self.unit, links, queries, own, 1)[0][:, 0]
        return search(self.unit, self.layers[0][1], queries, own, beam)

    def dump(self) -> bytes:
        """The layers alone; the vectors travel beside them."""
        out = io.BytesIO()
        np.savez(out, **{f"m{k}": m for k, (m, _) in enumerate(self.layers)}, **{f"l{k}": x for k, (_, x) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data, unit: np.ndarray) -> Graph:
        z = np.load(io.BytesIO(data))
        return cls(unit, [(z[f"m{k}"], z[f"l{k}"]) for k in range(len(z.files) // 2)])


def search(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int):
    """Beam search of all queries in step over one layer: (ids, cosines), -1 and -2 where a beam is not filled."""
    q, n = len(queries), len(unit)
    ids, sims = np.full((q, beam), -1, dtype=np.int64), np.full((q, beam), -2.0, dtype=np.float32)
    chunk = max(1, min(CHUNK, MARKS // max(1, n)))
    for lo in range(0, q, chunk):
        part = slice(lo, min(q, lo + chunk))
        ids[part], sims[part] = _search(unit, links, queries[part], entry[part], beam, n)
    return ids, sims


def _search(unit, links, queries, entry, beam, n):
    q = len(queries)
    rows = np.arange(q)
    ids, sims = np.full((q, beam), -1, dtype=np.int64), np.full((q, beam), -2.0, dtype=np.float32)
    open_ = np.zeros((q, beam), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("qd,qd->q", unit[entry], queries), True
    seen[rows, entry] = True
    live = rows
    wide = min(max(EXPAND, beam // 8), beam)
    while len(live):
        score = np.where(open_[live], sims[live], -3)
        best = np.argpartition(-score, wide - 1, 1)[:, :wide] if wide < beam else np.tile(np.arange(beam), (len(live), 1))
        real = np.take_along_axis(score, best, 1) > -3
        nodes = np.where(real, np.take_along_axis(ids[live], best, 1), -1)
        open_[live[:, None], best] = False
        near = np.where((nodes >= 0)[:, :, None], links[nodes], -1).reshape(len(live), -1).astype(np.int64)
        near = -np.sort(-near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near] & (near >= 0)] = -1
        r, c = np.nonzero(near >= 0)
        seen[live[r], near[r, c]] = True
        value = np.full(near.shape, -2.0, dtype=np.float32)
        value[r, c] = np.einsum("qd,qd->q", unit[near[r, c]], queries[live[r]])
        all_sims, all_ids = np.concatenate((sims[live], value), 1), np.concatenate((ids[live], near), 1)
        all_open = np.concatenate((open_[live], near >= 0), 1)
        order = np.argsort(-all_sims, 1, kind="stable")[:, :beam]
        sims[live], ids[live] = np.take_along_axis(all_sims, order, 1), np.take_along_axis(all_ids, order, 1)
        open_[live] = np.take_along_axis(all_open, order, 1)
        live = live[open_[live].any(1)]
    return ids, sims


def unit_of(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _probes(unit: np.ndarray, threshold: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): random rows turned in random directions, to a cosine between the threshold and 1."""
    rows = rng.permutation(len(unit))[:PROBES]
    side = rng.normal(size=(len(rows), unit.shape[1])).astype(np.float32)
    side -= (side * unit[rows]).sum(1, keepdims=True) * unit[rows]
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-6)
    near = threshold + (1 - threshold) / 4
    turned = near * unit[rows] + np.sqrt(max(0.0, 1 - near * near)) * side
    return rows, (turned / np.linalg.norm(turned, axis=1, keepdims=True)).astype(np.float32)


def linked_pairs(graph: Graph, queries: np.ndarray, same: bool, threshold: float, exact: bool = False):
    """(pairs, left, report): (query row, indexed row) pairs that may reach the threshold, and query rows that are left
    to be compared with all; same: the queries are the indexed vectors.

    report: (audited queries, their true links, those of them that searches found, queries left).
    """
    n, q = len(graph.unit), len(queries)
    if exact:
        return np.zeros((0, 2), np.int64), np.arange(q), (0, 0, 0, q)
    limit = np.float32(threshold - SLACK)
    own = np.arange(q) if same else None
    rng = np.random.default_rng(7)
    audit = np.sort(rng.permutation(q)[:AUDIT])
    truth = queries[audit] @ graph.unit.T >= limit
    source, probes = _probes(graph.unit, threshold, rng)
    if same:
        truth[np.arange(len(audit)), audit] = False
    seen = np.zeros_like(truth)
    out, todo, beam, passed = [], np.arange(q), min(n, BEAM), False
    while len(todo) and beam <= max(WIDEST, BEAM):
        ids, sims = graph.query(queries[todo], beam, None if own is None else own[todo])
        hit = sims >= limit
        full = hit[:, -1] & (beam < n)
        place = np.minimum(np.searchsorted(todo, audit), len(todo) - 1)
        asked = np.flatnonzero(todo[place] == audit)
        a, b = np.nonzero(hit[place[asked]])
        seen[asked[a], ids[place[asked]][a, b]] = True
        if not passed:
            sure = asked[~full[place[asked]]]
            at = graph.query(probes, beam)[0]
            passed = not (truth[sure] & ~seen[sure]).any() and (at == source[:, None]).any(1).all()
        again = full if passed else np.ones(len(todo), dtype=bool)
        r, c = np.nonzero(hit & ~again[:, None])
        out.append(np.stack((todo[r], ids[r, c]), 1))
        todo = todo[again]
        if beam == n:
            break
        beam = min(n, 2 * beam)
    report = (len(audit), int(truth.sum()), int((truth & seen).sum()), len(todo))
    return (np.concatenate(out) if out else np.zeros((0, 2), np.int64)), todo, report


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of edges that join what label keeps apart and close no circle, the labels with these edges)."""
    keep, at = [], np.arange(len(a))
    while True:
        high, low = np.maximum(label[a[at]], label[b[at]]), np.minimum(label[a[at]], label[b[at]])
        apart = high != low
        at, high, low = at[apart], high[apart], low[apart]
        if not len(at):
            return np.concatenate(keep) if keep else at, label
        # each of the higher labels goes to the least one it meets
        by = np.lexsort((low, high))
        by = by[np.concatenate(([True], high[by][1:] != high[by][:-1]))]
        parent = np.arange(len(label))
        parent[high[by]] = low[by]
        keep.append(at[by])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def link_shards(graph: Graph, xa: np.ndarray, size_a: np.ndarray, other: tuple[np.ndarray, np.ndarray] | None, threshold: float, exact: bool = False):
    """(links of each vertex, edges of a spanning forest, report) of two shards, or of one with itself (other: None).

    Vertices are numbered through both shards. Links found from either end count once.
    """
    same, n = other is None, len(xa)
    xb, size_b = (xa, size_a) if same else other
    shift = 0 if same else n
    sizes = size_a if same else np.concatenate((size_a, size_b))
    queries = graph.unit if same else unit_of(xb)
    na, nb = np.sqrt((xa * xa).sum(1)), np.sqrt((xb * xb).sum(1))
    sure = lambda i, j: (xb[i] * xa[j]).sum(1) / (nb[i] * na[j]) >= threshold
    pairs, left, report = linked_pairs(graph, queries, same, threshold, exact)
    whole = np.zeros(len(xb), dtype=bool)
    whole[left] = True
    if same:
        # what the compared queries have is counted with them
        pairs = pairs[(pairs[:, 0] != pairs[:, 1]) & ~whole[pairs[:, 1]]]
        key = np.unique(pairs.min(1) * n + pairs.max(1))
        pairs = np.stack((key // n, key % n), 1)
    if len(pairs):
        pairs = pairs[np.concatenate([sure(p[:, 0], p[:, 1]) for p in np.array_split(pairs, len(pairs) // 100_000 + 1)])]
    i, j = pairs[:, 0] + shift, pairs[:, 1]
    links = np.zeros(len(sizes))
    links += np.bincount(i, weights=sizes[j], minlength=len(sizes)) + np.bincount(j, weights=sizes[i], minlength=len(sizes))
    kept, label = _forest(i, j, np.arange(len(sizes)))
    edges = [np.stack((i[kept], j[kept]), 1)]
    limit = np.float32(threshold - SLACK)
    for part in np.array_split(left, max(1, len(left) * n * 4 // MARKS + 1)):
        r, c = np.nonzero(queries[part] @ graph.unit.T >= limit)
        r = part[r]
        for lo in range(0, len(r), 100_000):
            i, j = r[lo : lo + 100_000], c[lo : lo + 100_000]
            ok = sure(i, j) & ((i != j) if same else True)
            i, j = i[ok], j[ok]
            links += np.bincount(i + shift, weights=sizes[j], minlength=len(sizes))
            back = ~whole[j] if same else np.ones(len(j), dtype=bool)
            links += np.bincount(j[back], weights=sizes[i[back] + shift], minlength=len(sizes))
            kept, label = _forest(i + shift, j, label)
            edges.append(np.stack((i[kept] + shift, j[kept]), 1))
    return links.astype(np.int64), np.concatenate(edges), report


def _valid(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = F.col("embedding")
    ok = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"), "label")
    return rows.where(F.coalesce(ok, F.lit(False))), rows.where(~F.coalesce(ok, F.lit(False)))


def _classes(good: DataFrame) -> DataFrame:
    """Equal vectors of a label as one row: their cosine is 1, above any threshold in use."""
    classes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    # written, and numbered in a second cut: a vec_id may be in several classes
    return cut(classes.withColumn("class", F.monotonically_increasing_id()))


def _links(classes: DataFrame, threshold: float, shard: int, exact: bool) -> DataFrame:
    """Rows (a, b, n, audited, truth, found, compared): links of class a (b null), edges of forests (n = 0), and an audit for
    each pair of shards (audited not null, a: a class of it)."""
    dim = F.size("embedding").alias("dim")
    sizes = classes.groupBy("label", dim).agg(F.count("*").alias("n"))
    sizes = sizes.select("label", "dim", F.ceil(F.greatest(F.col("n") / shard, F.col("n") * F.col("dim") * 8 / SHARD_BYTES)).alias("shards"))
    dealt = classes.withColumn("dim", dim).join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("class"), "shards").cast("int"))
    kind = dict(classes.dtypes)["label"]

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rep", "class"])
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        # powers of two change no digit, and keep squares in range
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
        side = io.BytesIO()
        np.savez(side, ids=rows["class"].to_numpy(), size=rows["size"].to_numpy(), x=x)
        graph = b"" if exact else Graph.build(unit_of(x)).dump()
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "shards": [rows["shards"].iloc[0]], "graph": [graph], "side": [side.getvalue()]})

    index = cut(dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"label {kind}, dim int, shard int, shards long, graph binary, side binary"))
    # shard a is queried with a, a + 1, ... up to half way round, so that each unordered pair comes once and all shards get
    # as many; graphs are sent once a piece of partners, vectors of the queries once a partner
    steps = F.sequence(F.lit(0), F.floor(F.col("shards") / 2).cast("int"))
    half = (F.col("step") * 2 == F.col("shards")) & (F.col("shard") * 2 >= F.col("shards"))
    right = index.select("label", "dim", "shards", F.col("shard").alias("b"), F.explode(steps).alias("step"), F.col("side").alias("side_b"))
    right = right.withColumn("shard", ((F.col("b") - F.col("step") + F.col("shards")) % F.col("shards")).cast("int")).where(~half)
    right = right.withColumn("piece", F.floor(F.col("step") / PARTNERS).cast("int")).withColumn("side_b", F.when(F.col("step") > 0, F.col("side_b")))
    pieces = F.sequence(F.lit(0), F.floor(F.floor(F.col("shards") / 2) / PARTNERS).cast("int"))
    left = index.select("label", "dim", "shard", F.explode(pieces).alias("piece"), F.col("graph").alias("graph_a"), F.col("side").alias("side_a"))

    def link(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ga, sa, sb = (batch.column(c)[k].as_buffer() for c in range(3))
                own = np.load(io.BytesIO(sa))
                xa, ids, size = own["x"], own["ids"], own["size"]
                unit = unit_of(xa)
                graph = Graph(unit, []) if exact else Graph.load(ga, unit)
                other = None
                if sb is not None:
                    more = np.load(io.BytesIO(sb))
                    other, ids = (more["x"], more["size"]), np.concatenate((ids, more["ids"]))
                links, edges, report = link_shards(graph, xa, size, other, threshold, exact)
                some = np.flatnonzero(links)
                none = lambda n: pa.nulls(n, pa.int64())
                columns = [
                    pa.array(np.concatenate((ids[some], ids[edges[:, 0]], ids[:1])), pa.int64()),
                    pa.concat_arrays([none(len(some)), pa.array(ids[edges[:, 1]], pa.int64()), none(1)]),
                    pa.array(np.concatenate((links[some], np.zeros(len(edges) + 1, np.int64))), pa.int64()),
                    *[pa.concat_arrays([none(len(some) + len(edges)), pa.array([v], pa.int64())]) for v in report],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "audited", "truth", "found", "compared"])

    met = left.join(right, ["label", "dim", "shard", "piece"]).select("graph_a", "side_a", "side_b")
    return cut(met.mapInArrow(tidy(link), "a long, b long, n long, audited long, truth long, found long, compared long"))


def recall(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """(label, audited, true_links, found_links, recall, compared) for each label: queries that audits compared with all
    vectors of a shard, their links, those of them that searches of the graphs alone found (recall: their share, null
    without any link), and queries that no beam settled, which near_duplicates compares with all."""
    classes = _classes(_valid(vectors)[0])
    audits = _links(classes, threshold, shard, False).where("audited is not null").join(classes.select("class", "label"), F.col("a") == F.col("class"))
    out = audits.groupBy("label").agg(F.sum("audited").alias("audited"), F.sum("truth").alias("true_links"), F.sum("found").alias("found_links"), F.sum("compared").alias("compared"))
    return out.withColumn("recall", F.try_divide("found_links", "true_links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding array, label).

    Rows link if their labels are equal and not null, their vectors have the same length, and their cosine reaches the
    threshold; equal vectors are found exactly, others through the graphs (see `recall`), or with exact=True by products of
    whole shards. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. A null vec_id
    links with nothing and has a null component_id and kept. Repeated rows count as vectors of their own, also those of one
    vec_id with other vectors or labels. Magnitudes do not matter, however large or small. Other columns are ignored.
    """
    good, rest = _valid(vectors)
    classes = _classes(good)
    found = _links(classes, threshold, shard, exact)
    united = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null and audited is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    placed = cut(united.select(F.col("node").alias("class"), "component").join(classes.select("class", "rep"), "class"))
    names = cut(placed.groupBy("component").agg(F.min("rep").alias("name")))
    known = classes.join(counts, "class", "left").join(placed.join(names, "component").select("class", "name"), "class", "left")
    known = known.select((F.xxhash64("label", "embedding") + 0).alias("k"), F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("name", "rep").alias("component_id"))
    members = good.withColumn("h", F.xxhash64("label", "embedding"))
    out = members.join(known, F.col("h") == F.col("k")).where((F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

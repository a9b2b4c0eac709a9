"""Near-duplicate vectors by hierarchical navigable small-world graphs per shard.

Rows whose unit vectors are equal form one class, so copies never meet again below. Classes
are dealt by hash into shards, each of which gets a graph: every vector has a random top
layer, and on each of its layers links to diverse near vectors. Every class then queries
every shard: a greedy descent, and a beam search on the lowest layer. A query whose beam
holds nothing but hits gets a beam twice as wide, until the last one is no hit; once that
beam is an eighth of the shard, the query is compared with all of it. From each hit on,
links of hits are followed for as long as new ones turn up. In each task a hashed part of
the queries is first compared with the whole shard; until the graph finds what that audit
finds, for queries with few links as for those with many, all beams are doubled, and once
they span the shard the search is exhaustive. Every hit is verified by the cosine in
double precision.

Counts are summed over shards; of the links of a task only a spanning forest is passed on,
and components are united by a distributed reduction. Queries
are dealt in blocks, so that a task is of bounded size.

Graphs are built and searched in step for whole batches, as matrix operations.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and form components of their own; vectors of different lengths never link
(each length has shards of its own); rows are vectors of their own even if ids repeat, each
with the links of its own vector; a row with a null id counts where others link with it; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_frequent, stage
from .graph import connected_components
from .vectors import ints, matrix, usable

#: Links of a vector on upper layers (twice as many on the lowest), beam while building.
LINKS, BUILD_BEAM = 16, 48
#: Shards at least; rows and components of a shard and queries of a task at most.
SHARDS, SHARD_ROWS, SHARD_VALUES, TASK_QUERIES = 8, 65_536, 16_000_000, 16_384
#: First beam, queries audited in a task at least, recall that passes.
BEAM, AUDIT, PASS = 64, 256, 0.9995
BATCH = 256


def diverse(near: np.ndarray, pairs: np.ndarray, links: int) -> np.ndarray:
    """Which candidates to link: (b, c) similarities in falling order, (b, c, c) among candidates.

    A candidate is kept if it is nearer to the vector than to every one kept before; half
    the places left free go to the nearest of the others.
    """
    b, c = near.shape
    kept = np.zeros((b, c), bool)
    cover = np.full((b, c), -np.inf)
    for j in range(c):
        ok = np.isfinite(near[:, j]) & (near[:, j] > cover[:, j]) & (kept.sum(axis=1) < links)
        kept[:, j] = ok
        cover[ok] = np.maximum(cover[ok], pairs[ok, j])
    free = (links - kept.sum(axis=1) + 1) // 2
    spare = np.isfinite(near) & ~kept
    return kept | (spare & (np.cumsum(spare, axis=1) <= free[:, None]))


class Layer:
    """Links among the vectors (numbers into a shared matrix) of one layer."""

    def __init__(self, x: np.ndarray, links: int):
        self.x, self.links = x, links
        self.to = np.full((len(x), links), -1, np.int32)
        self.members = np.empty(0, np.int64)

    def beam(self, q: np.ndarray, entry: np.ndarray, width: int, spread: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each query the numbers and similarities of up to width near members, nearest first."""
        b, rows = len(q), np.arange(len(q))
        ids = np.full((b, width), -1, np.int64)
        sims = np.full((b, width), -np.inf, np.float32)
        done = np.ones((b, width), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("bd,bd->b", q, self.x[entry]), False
        seen = np.zeros((b, len(self.x)), bool)
        seen[rows, entry] = True
        alive = rows
        spread = min(spread, width)
        while len(alive):
            todo = np.where(done[alive], -np.inf, sims[alive])
            pick = np.argpartition(-todo, spread - 1, axis=1)[:, :spread]
            valid = np.isfinite(np.take_along_axis(todo, pick, 1))
            going = valid.any(axis=1)
            alive, pick, valid = alive[going], pick[going], valid[going]
            if not len(alive):
                break
            nodes = ids[alive[:, None], pick]
            done[alive[:, None], pick] = True
            new = np.where(valid[:, :, None], self.to[nodes], -1).reshape(len(alive), -1)
            new.sort(axis=1)
            ok = new >= 0
            ok[:, 1:] &= new[:, 1:] != new[:, :-1]
            ok &= ~seen[alive[:, None], new]
            seen[alive[:, None], np.where(ok, new, nodes[:, :1])] = True
            s = np.where(ok, np.einsum("bd,bkd->bk", q[alive], self.x[new]), -np.inf)
            all_ids = np.concatenate([ids[alive], new], axis=1)
            all_sims = np.concatenate([sims[alive], s.astype(np.float32)], axis=1)
            all_done = np.concatenate([done[alive], ~ok], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[alive], sims[alive], done[alive] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def insert(self, new: np.ndarray, entry: np.ndarray | None, width: int) -> np.ndarray:
        """Link new members; returns the nearest older member of each (itself if there is none)."""
        q = self.x[new]
        own = q @ q.T
        own[np.triu_indices(len(new))] = -np.inf  # to those before it in the batch
        ids, sims = np.broadcast_to(new, own.shape), own
        first = new
        if len(self.members):
            old_ids, old_sims = self.beam(q, entry, width)
            first = old_ids[:, 0]
            ids, sims = np.concatenate([old_ids, ids], axis=1), np.concatenate([old_sims, sims], axis=1)
        top = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        chosen = self._choose(ids, sims)
        self.to[new] = chosen
        at, slot = np.nonzero(chosen >= 0)
        self._link_back(chosen[at, slot], new[at])
        self.members = np.concatenate([self.members, new])
        return first

    def _choose(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        v = self.x[ids]
        keep = diverse(sims, np.einsum("bid,bjd->bij", v, v), self.links)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : self.links]
        got = np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(ids, order, 1), -1)
        return np.pad(got, ((0, 0), (0, self.links - got.shape[1])), constant_values=-1)

    def _link_back(self, to: np.ndarray, source: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
        step = 64  # new links of a node that are weighed at once
        for lo in range(0, int(counts.max(initial=0)), step):
            some = counts > lo
            n, size = nodes[some], np.minimum(counts[some] - lo, step)
            extra = np.full((len(n), size.max()), -1, np.int64)
            for k in range(extra.shape[1]):
                has = size > k
                extra[has, k] = source[starts[some][has] + lo + k]
            for part in range(0, len(n), BATCH):
                p = slice(part, part + BATCH)
                ids = np.concatenate([self.to[n[p]], extra[p]], axis=1)
                sims = np.where(ids >= 0, np.einsum("bd,bkd->bk", self.x[n[p]], self.x[ids]), -np.inf)
                top = np.argsort(-sims, axis=1, kind="stable")
                self.to[n[p]] = self._choose(np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1))


    def reconnect(self, least: int = 3) -> None:
        """Places for links to members that fewer than ``least`` others kept a link to, at their own nearest links."""
        m = self.members
        came = np.bincount(self.to[m][self.to[m] >= 0], minlength=len(self.x))
        extra: dict[int, list[int]] = {}
        for i in m[came[m] < least].tolist():
            near = self.to[i][self.to[i] >= 0]
            near = [t for t in near[np.argsort(-(self.x[near] @ self.x[i]), kind="stable")].tolist() if i not in self.to[t]]
            for t in sorted(near, key=lambda t: len(extra.get(t, ())))[: least - int(came[i])]:
                extra.setdefault(t, []).append(i)
        if extra:
            more = np.full((len(self.x), max(map(len, extra.values()))), -1, np.int32)
            for t, new in extra.items():
                more[t, : len(new)] = new
            self.to = np.concatenate([self.to, more], axis=1)


class Graph:
    """The layers over one shard's unit vectors."""

    def __init__(self, x: np.ndarray, level: np.ndarray):
        self.unit, self.level = x, level
        self.x = x.astype(np.float32)
        self.layers = [Layer(self.x, LINKS * (2 if k == 0 else 1)) for k in range(int(level.max(initial=0)) + 1)]

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 1) -> Graph:
        rng = np.random.default_rng(seed)
        level = np.floor(rng.exponential(1 / np.log(LINKS), len(x))).astype(np.int8)
        graph, at = cls(x, level), 0
        order = np.arange(len(x))
        while at < len(x):
            batch = order[at : at + max(16, min(BATCH, at))]
            entry: np.ndarray | None = None
            for k in range(len(graph.layers) - 1, -1, -1):
                layer = graph.layers[k]
                rise = level[batch] >= k
                if len(layer.members):
                    start = np.full(len(batch), layer.members[0]) if entry is None else entry
                    entry = np.array(start)
                    if (~rise).any():
                        entry[~rise] = layer.beam(graph.x[batch[~rise]], start[~rise], 4)[0][:, 0]
                    if rise.any():
                        entry[rise] = layer.insert(batch[rise], start[rise], BUILD_BEAM)
                elif rise.any():
                    layer.insert(batch[rise], None, BUILD_BEAM)
            at += len(batch)
        for layer in graph.layers:
            layer.reconnect()
        return graph

    def range_search(self, q: np.ndarray, width: int, least: float) -> list[np.ndarray]:
        """For each unit query the numbers of all vectors found with cosine >= least, verified in double."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        q32, entry = q.astype(np.float32), None
        if width < len(self.x):
            for layer in self.layers[:0:-1]:
                if len(layer.members):
                    start = np.full(len(q), layer.members[0]) if entry is None else entry
                    entry = layer.beam(q32, start, 4)[0][:, 0]
            entry = np.full(len(q), self.layers[0].members[0]) if entry is None else entry
        near = least - 0.02  # single precision, and a step of slack to cross between hits
        todo = np.arange(len(q))
        while len(todo):
            if 8 * width >= len(self.x):  # a wider beam would cost as much as the whole shard
                for lo in range(0, len(todo), BATCH):
                    at = todo[lo : lo + BATCH]
                    row, hit = np.nonzero(q[at] @ self.unit.T >= least)
                    for k, found in zip(at, np.split(hit, np.searchsorted(row, np.arange(1, len(at))))):
                        out[k] = found
                break
            ids, sims = self.layers[0].beam(q32[todo], entry[todo], width)
            full = sims[:, -1] >= near
            for k in np.flatnonzero((sims[:, 0] >= near) & ~full):
                out[todo[k]] = self._spread(q[todo[k]], q32[todo[k]], ids[k], sims[k], near, least)
            todo, width = todo[full], 2 * width
        return out

    def _spread(self, q: np.ndarray, q32: np.ndarray, ids: np.ndarray, sims: np.ndarray, near: float, least: float) -> np.ndarray:
        """The hits of a beam and those that links of hits lead to."""
        base, front = self.layers[0], ids[sims >= near]
        seen, hits = set(ids.tolist()), [front]
        while len(front):
            nb = [i for i in set(base.to[front].ravel().tolist()) - seen if i >= 0]
            seen.update(nb)
            nb = np.array(nb, np.int64)
            front = nb[self.x[nb] @ q32 >= near] if len(nb) else nb
            hits.append(front)
        found = np.concatenate(hits)
        return found[self.unit[found] @ q >= least]


def _shard_rows(ids: np.ndarray, graph: Graph) -> pa.Table:
    upper = [[layer.to[i].tolist() for layer in graph.layers[1 : lv + 1]] for i, lv in enumerate(graph.level)]
    return pa.table({
        "id": pa.array(ids, pa.int64()), "pos": pa.array(np.arange(len(ids)), pa.int64()), "vector": pa.array(list(graph.unit), pa.list_(pa.float64())), "level": pa.array(graph.level.astype(np.int32)),
        "base": pa.array(list(graph.layers[0].to), pa.list_(pa.int32())), "upper": pa.array(upper, pa.list_(pa.list_(pa.int32()))),
    })


def _load(table: pa.Table) -> tuple[np.ndarray, Graph]:
    table = table.sort_by("pos")
    graph = Graph(matrix(table["vector"]), ints(table["level"]).astype(np.int8))
    graph.layers[0].to = matrix(table["base"]).astype(np.int32)
    for i, (lv, links) in enumerate(zip(graph.level, table["upper"])):
        for k in range(lv):
            to = links[k].as_py()
            layer = graph.layers[k + 1]
            if len(to) > layer.to.shape[1]:
                layer.to = np.pad(layer.to, ((0, 0), (0, len(to) - layer.to.shape[1])), constant_values=-1)
            layer.to[i, : len(to)] = to
    for k, layer in enumerate(graph.layers):
        layer.members = np.flatnonzero(graph.level >= k)
    return ints(table["id"]), graph


def audited_search(graph: Graph, q: np.ndarray, audit: np.ndarray, least: float) -> list[np.ndarray]:
    """range_search with the first beam whose recall on the audited queries passes.

    Queries are weighed by the size of their true answer (by powers of two), and each size
    has to pass, so that a hot group's many links don't stand in for small groups' few.
    """
    truth = [np.flatnonzero(s >= least) for s in (q[audit] @ graph.unit.T)]
    size = np.array([len(t).bit_length() for t in truth], np.int64)
    wanted, width = np.bincount(size, [len(t) for t in truth]), BEAM
    while 8 * width < len(graph.x):
        found = np.bincount(size, [len(np.intersect1d(a, b)) for a, b in zip(truth, graph.range_search(q[audit], width, least))])
        if (found >= PASS * wanted).all():
            break
        width *= 2
    return [hits for lo in range(0, len(q), BATCH) for hits in graph.range_search(q[lo : lo + BATCH], width, least)]


def _query_block(ids: np.ndarray, mult: np.ndarray, graph: Graph, queries: pa.Table, least: float) -> pa.Table:
    """(id, n): rows that each query links with in this shard; (id, other): a spanning forest of the links."""
    qids, q = ints(queries["id"]), matrix(queries["vector"])
    order = np.argsort((qids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), kind="stable")
    hits = audited_search(graph, q, order[: max(AUDIT, len(q) // 32)], least)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    count = np.zeros(len(q), np.int64)
    edges: list[tuple[int, int]] = []
    for i, (qid, found) in enumerate(zip(qids.tolist(), hits)):
        found = found[ids[found] != qid]
        count[i] = mult[found].sum()
        for o in ids[found].tolist():
            a, b = root(qid), root(o)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((qid, o))
    e = np.array(edges, np.int64).reshape(-1, 2)
    blank = pa.nulls(len(qids), pa.int64())
    return pa.table({"id": pa.array(np.concatenate([qids, e[:, 0]]), pa.int64()), "n": pa.array(np.concatenate([count, np.zeros(len(e), np.int64)])), "other": pa.concat_arrays([blank, pa.array(e[:, 1], pa.int64())])})


def near_duplicates(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shards: int = SHARDS) -> DataFrame:
    """id_col, n_links, component_id, kept for every row: links have a cosine of at least ``least``."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    peak = F.array_max(F.transform("vector", F.abs))  # scaled first, so that no square over- or underflows
    given = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(usable(given), given).alias("vector")).withColumn("peak", peak)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x / F.col("peak"))).withColumn("norm", norm)
    rows = stage(rows.select("id", F.transform("vector", lambda x: x / F.col("norm") + 0.0).alias("vector")).withColumn("cls", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), "unit-vectors")
    # classes of equal vectors, named by hash
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    classes = stage(rows.where("cls is not null").groupBy("cls").agg(F.first("vector").alias("vector"), F.count("*").alias("mult"), first.alias("best")).withColumn("size", F.size("vector")), "vector-classes")
    sizes = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    parts = {d: max(shards, -(-n // min(SHARD_ROWS, max(1024, SHARD_VALUES // d)))) for d, n in sizes.items()}
    blocks = max([1, *(-(-n // TASK_QUERIES) for n in sizes.values())])
    of = F.coalesce(*(F.when(F.col("size") == d, F.lit(p)) for d, p in parts.items()), F.lit(1))

    def build(table):
        table = table.sort_by("id")
        out = _shard_rows(ints(table["id"]), Graph.build(matrix(table["vector"])))
        return out.append_column("mult", table["mult"]).append_column("size", table["size"]).append_column("shard", table["shard"])

    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    points = classes.select(F.col("cls").alias("id"), "vector", "mult", "size")
    graphs = points.withColumn("shard", place(of, 3)).groupBy("size", "shard").applyInArrow(build, "id long, pos long, vector array<double>, level int, base array<int>, upper array<array<int>>, mult long, size int, shard int")
    graphs = stage(graphs, "graphs")
    asked = points.select("id", "vector", "size").withColumn("block", place(F.lit(blocks), 5)).withColumn("shard", F.explode(F.sequence(F.lit(0), of - 1)))
    shape = "id long, n long, other long"

    def run(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("id", "n", "other")})
        a = a.sort_by("pos")
        ids, graph = _load(a)
        return _query_block(ids, ints(a["mult"]), graph, b, least)

    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = stage(left.groupBy("size", "shard", "block").cogroup(asked.groupBy("size", "shard", "block")).applyInArrow(run, shape), "vector-links")
    discard(graphs)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    part = connected_components(found.where("other is not null"), "id", "other")
    tied = stage(classes.select("cls", "mult", "best").join(links.withColumnRenamed("id", "cls"), "cls", "left").join(part.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "mult", "best", "n", F.coalesce("component", "cls").alias("component")), "vector-components")
    several = tied.groupBy("component").agg(F.min("best").alias("first"), F.count("*").alias("k")).where("k > 1")
    tied = join_frequent(tied, several.select("component", "first"), "component", "cls", several.select("component", F.col("k").alias("n")), "left")
    tied = tied.select("cls", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("first", "best").alias("best"))
    out = join_frequent(rows.select("id", "cls"), tied, "cls", "id", how="left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

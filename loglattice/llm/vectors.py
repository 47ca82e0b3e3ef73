"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Distinct vectors are dealt to shards by a hash of their id; each shard builds one graph and keeps it as a file of the
shared folder, and every distinct vector queries every shard: a task holds a block of queries of bounded size and loads
one graph after the other, so a vector is shuffled twice, however many shards and blocks there are.  A query's beam widens while all of it lies above the threshold; a block of queries is audited
against brute force on some of its own and its beam doubled until the audit passes, at last to the whole shard.  Found
neighbours are verified by cosine in double precision; counts leave a shard, and a spanning set of its links, never all
pairs of a group of copies.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm._graph import components
from loglattice.llm._store import drop, get, join_classes, new_path, put, shuffle_partitions, stored

SHARD_ROWS = 65_536
LEAST_SHARDS = 12
QUERY_BYTES = 64 << 20  # of the vectors of a block of queries, in double precision
QUERY_ROWS = 128  # a block is smaller only if it then holds all
DEGREE = 12  # links of a node in upper layers; twice as many in the lowest
BUILD_BEAM = 48
BEAM = 32
AUDITED = 96
RECALL = 0.995


class Graph:
    """Layers of fixed-degree neighbour lists over unit vectors; -1 fills a list up."""

    def __init__(self, unit: np.ndarray, seed: int = 7):
        self.unit = unit
        n = len(unit)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / math.log(DEGREE)).astype(int), 8)
        self.lists = [np.full((n, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.entry, self.size, self.top = 0, 0, -1

    def _choose(self, node: int, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours nearer to the node than to each other first, then the nearest of the others."""
        order = np.argsort(-sims, kind="stable")[: 4 * most]
        found, sims = found[order], sims[order]
        between = self.unit[found] @ self.unit[found].T
        kept: list[int] = []
        for i in range(len(found)):
            if len(kept) == most:
                break
            if not kept or (between[i, kept] < sims[i]).all():
                kept.append(i)
        if len(kept) < most:
            others = np.setdiff1d(np.arange(len(found)), kept)[: most - len(kept)]
            kept += others.tolist()
        return found[kept]

    def _link(self, layer: int, node: int, found: np.ndarray, sims: np.ndarray) -> None:
        lists = self.lists[layer]
        most = lists.shape[1]
        chosen = self._choose(node, found, sims, max(1, most // 2))
        lists[node, : len(chosen)] = chosen
        for other in chosen:
            free = np.flatnonzero(lists[other] < 0)
            if len(free):
                lists[other, free[0]] = node
            else:
                every = np.append(lists[other], node)
                lists[other] = self._choose(int(other), every, self.unit[every] @ self.unit[other], most)

    def build(self, batch: int = 64) -> Graph:
        n = len(self.unit)
        at = 0
        while at < n:
            end = min(n, at + max(1, min(batch, at)))
            queries = self.unit[at:end]
            starts = np.full((end - at, 1), self.entry, np.int64)
            inner = queries @ queries.T
            for layer in range(max(self.top, int(self.level[at:end].max())), -1, -1):
                found = sims = None
                if self.size and layer <= self.top:
                    active = self.level[at:end] >= layer
                    found, sims = self._layer(queries, starts, BUILD_BEAM if active.any() else 4, layer)
                    starts = found[:, :4]
                for i in range(at, end):
                    if self.level[i] < layer:
                        continue
                    mates = np.arange(at, i)[self.level[at:i] >= layer]
                    near, own = mates, inner[i - at, mates - at]
                    if found is not None:
                        good = found[i - at] >= 0
                        near, own = np.append(near, found[i - at][good]), np.append(own, sims[i - at][good])
                    if len(near):
                        self._link(layer, i, near, own)
            peak = at + int(self.level[at:end].argmax())
            if self.level[peak] > self.top:
                self.top, self.entry = int(self.level[peak]), peak
            self.size = at = end
        return self

    def _layer(self, queries: np.ndarray, starts: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries in step; (ids, similarities) by falling similarity, -1 where a beam is not full."""
        lists, rows = self.lists[layer], len(queries)
        ids = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -2.0, np.float32)
        seen = np.zeros((rows, len(self.unit)), bool)
        k = min(beam, starts.shape[1])
        starts = starts[:, :k]
        ids[:, :k] = starts
        sims[:, :k] = np.where(starts >= 0, np.einsum("bkd,bd->bk", self.unit[starts], queries), -2.0)
        line = np.arange(rows)
        seen[line[:, None], np.maximum(starts, 0)] = True
        done = np.zeros((rows, beam), bool)
        done[ids < 0] = True
        live = line
        while len(live):
            open_sims = np.where(done[live], -3.0, sims[live])
            pick = open_sims.argmax(1)
            going = open_sims[np.arange(len(live)), pick] > -2.0
            live, pick = live[going], pick[going]
            if not len(live):
                break
            done[live, pick] = True
            near = lists[ids[live, pick]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(fresh, near, ids[live, pick][:, None])] = True
            found = np.where(fresh, np.einsum("bkd,bd->bk", self.unit[near], queries[live]), -2.0).astype(np.float32)
            every = np.concatenate([sims[live], found], 1)
            keep = np.argpartition(-every, beam - 1, 1)[:, :beam]
            sims[live] = np.take_along_axis(every, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), keep, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), keep, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.full((len(queries), 1), self.entry, np.int64)
        for layer in range(self.top, 0, -1):
            found, _ = self._layer(queries, starts, 4, layer)
            starts = found
        return self._layer(queries, np.where(starts < 0, starts[:, :1], starts), min(beam, len(self.unit)), 0)

    def within(self, queries: np.ndarray, least: float, beam: int, at_once: int = 256):
        """For each query, the ids found at ``least`` or more; a beam that is full of them widens."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        todo = np.arange(len(queries))
        while len(todo):
            wider = []
            step = max(8, min(at_once, 8_192 // beam * 8))
            for a in range(0, len(todo), step):
                rows = todo[a : a + step]
                ids, sims = self.search(queries[rows], beam)
                good = (sims >= least) & (ids >= 0)
                full = good.all(1) & (ids.shape[1] < len(self.unit))
                for i, row in enumerate(rows):
                    if full[i]:
                        wider.append(row)
                    else:
                        out[row] = np.unique(ids[i][good[i]])
            todo, beam = np.array(wider, np.int64), beam * 4
        return out


def _unit(raw: np.ndarray) -> np.ndarray:
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _build(folder: str):
    """One shard: its graph as a file, and where that is."""

    def run(table: pa.Table) -> pa.Table:
        raw, ids = _matrix(table.column("vector")), table.column("vec_id").to_numpy().astype("<i8")
        order = np.argsort(ids, kind="stable")
        raw, ids, copies = raw[order], ids[order], table.column("copies").to_numpy().astype("<i8")[order]
        graph, shard, out = Graph(_unit(raw)).build(), table.column("shard")[0].as_py(), io.BytesIO()
        single = bool((raw == raw.astype(np.float32)).all())
        np.savez(out, ids=ids, copies=copies, raw=raw.astype("<f4" if single else "<f8"), head=np.array([graph.entry, graph.top]), **{f"layer{k}": x for k, x in enumerate(graph.lists)})
        path = f"{folder}/shard-{shard}.npz"
        put(path, out.getvalue())
        return pa.table({"dim": pa.array([raw.shape[1]], pa.int32()), "path": pa.array([path])})

    return run


def _load(path: str) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    data = np.load(io.BytesIO(get(path)))
    raw = data["raw"].astype(np.float64)
    graph = Graph.__new__(Graph)
    (graph.entry, graph.top), graph.unit, graph.size = data["head"].tolist(), _unit(raw), len(raw)
    graph.lists = [data[f"layer{k}"] for k in range(sum(name.startswith("layer") for name in data.files))]
    return graph, data["ids"], data["copies"], raw


def _answers(own: np.ndarray, vectors: np.ndarray, path: str, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A block of queries against one shard: how many vectors each finds, copies counted, and links that span what it finds."""
    graph, ids, copies, raw = _load(path)
    units, beam = _unit(vectors), BEAM
    audited = np.argsort(own * np.int64(0x9E3779B97F4A7C15 - (1 << 64)), kind="stable")[:AUDITED]
    truth = units[audited] @ graph.unit.T >= least - 1e-4
    while True:
        found = graph.within(units, least - 1e-4, beam)
        hit = sum(int(truth[k, found[q]].sum()) for k, q in enumerate(audited))
        if hit >= RECALL * truth.sum() or beam >= len(ids):
            break
        beam = min(2 * beam, len(ids))
    norms, own_norms = np.linalg.norm(raw, axis=1), np.linalg.norm(vectors, axis=1)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    counts, links = np.zeros(len(own), np.int64), []
    for q, near in enumerate(found):
        near = near[ids[near] != own[q]]
        near = near[raw[near] @ vectors[q] / (norms[near] * own_norms[q]) >= least]
        counts[q] = copies[near].sum()
        for other in ids[near].tolist():
            x, y = root(int(own[q])), root(other)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(own[q]), other))
    return counts, links


def _query(least: float, shards: dict[int, list[str]]):
    """One block of queries against all shards of its vectors' length, one after the other."""

    def run(table: pa.Table) -> pa.Table:
        own, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("vector"))
        total, a, b = np.zeros(len(own), np.int64), [], []
        for path in shards[vectors.shape[1]]:
            counts, links = _answers(own, vectors, path, least)
            total += counts
            a += [x for x, _ in links]
            b += [y for _, y in links]
        rows = np.flatnonzero(total)
        none = [None] * len(a)
        columns = {"vec_id": [*own[rows].tolist(), *none], "found": [*total[rows].tolist(), *none], "a": [None] * len(rows) + a, "b": [None] * len(rows) + b}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    return run


def near_vectors(table: DataFrame, least: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    table(vec_id, embedding, ...): vectors link at cosine ``least`` or more, in double precision, whatever their labels.
    Vectors that are null, empty or zero, or hold a null, NaN or infinite component, link with nothing, and vectors of
    different lengths do not link.  Equal vectors are one graph node and count as links of each other; repeated rows give
    a row each.  A null vec_id links with nothing.  Other columns are ignored; an empty table gives no rows.
    """
    spark = table.sparkSession
    table = table.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    fit = F.size("vector") > 0
    fit = fit & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    fit = F.coalesce(fit, F.lit(False))
    nodes = table.where(fit).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = stored(nodes, "vectors")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row a length
    total = sum(sizes.values())
    shards = max(LEAST_SHARDS, math.ceil(total / SHARD_ROWS))
    dealt = nodes.select(F.col("rep").alias("vec_id"), "copies", "vector", F.size("vector").alias("dim"))
    # one shard key per hash and vector length
    sharded = dealt.withColumn("shard", F.col("dim") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    folder = new_path(spark, "graphs")
    built = stored(sharded.groupBy("shard").applyInArrow(_build(folder), "dim int, path string"), "shards")
    paths: dict[int, list[str]] = {}
    for row in built.collect():  # a row a shard of SHARD_ROWS vectors
        paths.setdefault(row["dim"], []).append(row["path"])
    paths = {dim: sorted(found) for dim, found in paths.items()}
    size = sum(8 * dim * n for dim, n in sizes.items())
    parts = max(1, math.ceil(size / QUERY_BYTES), min(shuffle_partitions(spark), math.ceil(total / QUERY_ROWS)))
    asked = dealt.select("vec_id", "vector", "dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).alias("part")).repartition(parts, "dim", "part")
    answers = stored(asked.groupBy("dim", "part").applyInArrow(_query(least, paths), "vec_id long, found long, a long, b long"), "answers")
    drop(built)
    counts = answers.where("vec_id is not null").select(F.col("vec_id").alias("rep"), "found")
    labels = components(answers.where("a is not null").select("a", "b"))
    # rows meet their vector's class by a 128-bit hash of the vector
    classes = nodes.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(_key(F.col("vector")).alias("key"), "copies", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    joined = join_classes(table.select("vec_id", F.when(fit, _key(F.col("vector"))).alias("key")), classes, "key", "copies", total)
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _key(vector) -> F.Column:
    return F.concat(F.hex(F.xxhash64(vector)), F.hex(F.xxhash64(F.lit(1), vector)))

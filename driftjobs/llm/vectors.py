"""Embedding near-duplicates: a navigable small-world graph per shard; each vector asks its own and half of the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import attach, discard, written
from driftjobs.llm.components import connected_components

DEGREE, BUILD_BEAM, FIRST_BEAM = 12, 32, 48
#: Components of a shard's vectors, on average; components of the vectors that stream past one copy of a graph.
SHARD_VALUES, QUERY_VALUES = 4 << 20, 2 << 20
#: Smaller tables have up to so many shards and ranges, of so many vectors at least.
LEAST_SHARDS, LEAST_RANGES, LEAST_ROWS = 4, 8, 2048
AUDIT_ROWS, AUDIT_RECALL = 256, 0.999
#: A shard whose audit no beam up to this one passes is answered by exact products, which cost less than wider beams.
WIDEST_BEAM = 4096
_STEP = 512
#: Bytes that tell which vectors the queries of one search have seen.
SEEN = 64 << 20


class SmallWorld:
    """Layers of neighbour lists over unit vectors; searches take many queries at once."""

    def __init__(self, unit: np.ndarray, seed: int = 1):
        self.unit = unit.astype(np.float32)
        n = len(unit)
        draw = np.random.default_rng(seed).random(max(n, 1))[:n]
        self.level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)).astype(int), 6)
        if n:
            self.level[0] = max(self.level.max(), 0)
        self.layers = [np.full((n, DEGREE * 2 if k == 0 else DEGREE), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        for start in range(0, n, _STEP):
            self._insert(np.arange(start, min(n, start + _STEP)))

    def _insert(self, new: np.ndarray) -> None:
        """Link a batch: to what a search of the graph finds, and to each other."""
        among = self.unit[new] @ self.unit[new].T
        entry = np.zeros(len(new), np.int32)
        for k in range(len(self.layers) - 1, -1, -1):
            here = self.level[new] >= k
            if new[0] > 0:
                beam = BUILD_BEAM if here.any() else 1
                ids, sims = self._beam(self.unit[new], k, entry, beam)
                entry = np.where(ids[:, 0] >= 0, ids[:, 0], 0).astype(np.int32)
            else:
                ids, sims = np.full((len(new), 1), -1, np.int32), np.full((len(new), 1), -np.inf, np.float32)
            own = np.flatnonzero(here)
            if not len(own):
                continue
            peers = np.where((new[own][:, None] != new[own][None, :]), among[np.ix_(own, own)], -np.inf)
            near = np.argsort(-peers, axis=1, kind="stable")[:, :BUILD_BEAM]
            pids = np.where(np.take_along_axis(peers, near, 1) > -np.inf, new[own][near], -1)
            found = self._diverse(new[own], np.concatenate((ids[own], pids), 1), DEGREE)
            self.layers[k][new[own], :DEGREE] = found
            src, dst = np.repeat(new[own], found.shape[1]), found.ravel()
            self._add_back(k, src[dst >= 0], dst[dst >= 0])

    def _add_back(self, k: int, src: np.ndarray, dst: np.ndarray) -> None:
        layer = self.layers[k]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        for a in range(0, len(nodes), _STEP):
            part = slice(a, a + _STEP)
            wide = int(count[part].max())
            more = np.full((len(nodes[part]), wide), -1, np.int32)
            rank = np.arange(len(dst)) - np.repeat(first, count)
            rows = np.repeat(np.arange(len(nodes)), count)
            own = (rows >= a) & (rows < a + _STEP)
            more[rows[own] - a, rank[own]] = src[own]
            every = np.concatenate((layer[nodes[part]], more), 1)
            keep = min(every.shape[1], 4 * layer.shape[1])
            if every.shape[1] > keep:  # the nearest of very many
                sims = np.where(every >= 0, np.einsum("ijk,ik->ij", self.unit[every], self.unit[nodes[part]]), -np.inf)
                every = np.take_along_axis(every, np.argsort(-sims, 1, kind="stable")[:, :keep], 1)
            layer[nodes[part]] = self._diverse(nodes[part], every, layer.shape[1])

    def _diverse(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours each: nearer to the node than to those chosen before; what room is left goes to the nearest of the rest."""
        sims = np.where(candidates >= 0, np.einsum("ijk,ik->ij", self.unit[candidates], self.unit[nodes]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        again = np.zeros(ids.shape, bool)
        by_id = np.argsort(ids, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(ids, by_id, 1)
        np.put_along_axis(again, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
        ok = (ids >= 0) & ~again & (ids != nodes[:, None])
        vectors = self.unit[ids]
        chosen = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -np.inf, np.float32)  # to any chosen
        room = max(2, most * 2 // 3)
        for j in range(ids.shape[1]):
            take = ok[:, j] & (sims[:, j] > closest[:, j]) & (chosen.sum(1) < room)
            rows = np.flatnonzero(take)
            if len(rows):
                chosen[rows, j] = True
                closest[rows] = np.maximum(closest[rows], np.einsum("ijk,ik->ij", vectors[rows], vectors[rows, j]))
        rank = np.where(chosen, 0, np.where(ok, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(ok, pick, 1), np.take_along_axis(ids, pick, 1), -1)
        if out.shape[1] < most:
            out = np.concatenate((out, np.full((len(out), most - out.shape[1]), -1, np.int32)), 1)
        return out.astype(np.int32)

    def _beam(self, queries: np.ndarray, k: int, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of a layer: the ``beam`` nearest found of each query, nearest first. What queries have seen takes SEEN bytes at most."""
        layer, n = self.layers[k], len(self.unit)
        most = max(1, SEEN // max(n, 1))
        if len(queries) > most:
            parts = [self._beam(queries[a : a + most], k, entry[a : a + most], beam) for a in range(0, len(queries), most)]
            return np.concatenate([i for i, _ in parts]), np.concatenate([s for _, s in parts])
        ids = np.full((len(queries), beam), -1, np.int32)
        sims = np.full((len(queries), beam), -np.inf, np.float32)
        opened = np.ones((len(queries), beam), bool)
        seen = np.zeros((len(queries), n), bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = entry, np.einsum("ij,ij->i", self.unit[entry], queries), False
        seen[np.arange(len(queries)), entry] = True
        at_once = max(1, min(4, beam // 4), beam // 16)
        while True:
            live = np.flatnonzero(~opened.all(1))
            if not len(live):
                return ids, sims
            waiting = np.where(opened[live], 1, 0)
            pick = np.argsort(waiting, axis=1, kind="stable")[:, :at_once]
            fresh = ~np.take_along_axis(opened[live], pick, 1)
            front = np.where(fresh, np.take_along_axis(ids[live], pick, 1), -1)
            opened[live[:, None], pick] = True
            around = np.where(front[:, :, None] >= 0, layer[front], -1).reshape(len(live), -1)
            around = np.where((around >= 0) & ~seen[live[:, None], around], around, -1)
            around.sort(1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            useful = (around >= 0).any(0)
            around = around[:, useful]
            if not around.shape[1]:
                continue
            rows, cols = np.nonzero(around >= 0)
            seen[live[rows], around[rows, cols]] = True
            near = np.full(around.shape, -np.inf, np.float32)
            near[rows, cols] = np.einsum("ij,ij->i", self.unit[around[rows, cols]], queries[live[rows]])
            every_id = np.concatenate((ids[live], around), 1)
            every = np.concatenate((sims[live], near), 1)
            open_ = np.concatenate((opened[live], around < 0), 1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(every_id, order, 1), np.take_along_axis(every, order, 1)
            opened[live] = np.take_along_axis(open_, order, 1) | (ids[live] < 0)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros(len(queries), np.int32)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._beam(queries, k, entry, 1)[0][:, 0]
        return self._beam(queries, 0, entry, min(beam, len(self.unit)))

    def within(self, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, vector) of at least this similarity; a query's beam doubles until it holds something below, or all.

        A beam of 0 stands for exact products with every vector.
        """
        slack = np.float32(least - 1e-4)
        if beam == 0:
            step = max(1, (1 << 22) // max(1, len(self.unit)))
            for a in range(0, len(queries), step):
                q, c = np.nonzero(queries[a : a + step] @ self.unit.T >= slack)
                yield q + a, c
            return
        for start in range(0, len(queries), _STEP):
            todo = np.arange(start, min(len(queries), start + _STEP))
            width = min(beam, len(self.unit))
            while len(todo):
                again = []
                step = max(1, min(_STEP, (1 << 22) // max(width * 8, len(self.unit))))
                for a in range(0, len(todo), step):
                    part = todo[a : a + step]
                    ids, sims = self.search(queries[part], width)
                    full = (sims[:, -1] >= slack) & (width < len(self.unit))
                    again.append(part[full])
                    q, c = np.nonzero((sims >= slack) & ~full[:, None])
                    yield part[q], ids[q, c]
                todo, width = np.concatenate(again), min(2 * width, len(self.unit))

    def audited_beam(self, least: float, beam: int = FIRST_BEAM) -> tuple[int, float]:
        """The first doubled beam that passes the audit and its recall, or 0 (exact products) if none does.

        Truth is brute force near vectors moved to the limit of a link. A query's recall counts once,
        however many links it has, and must average AUDIT_RECALL among the queries of each power of two
        of links: a large group's links don't make up for those of small ones.
        """
        n, dim = self.unit.shape
        draw = np.random.default_rng(7)
        moved = self.unit[draw.integers(0, n, AUDIT_ROWS)].astype(np.float64)
        noise = draw.standard_normal((AUDIT_ROWS, dim))
        noise -= (noise * moved).sum(1, keepdims=True) * moved
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        moved = (moved * (least + 0.002) + noise * np.sqrt(1 - (least + 0.002) ** 2)).astype(np.float32)
        truth = np.bincount(_pairs(self.within(moved, least, 0))[0], minlength=AUDIT_ROWS)
        linked = truth > 0
        stratum = np.log2(np.maximum(truth, 1)).astype(int)
        while True:
            found = np.bincount(_pairs(self.within(moved, least, min(beam, n)))[0], minlength=AUDIT_ROWS)
            recall = np.minimum(found, truth)[linked] / truth[linked]
            worst = min((float(recall[stratum[linked] == k].mean()) for k in np.unique(stratum[linked])), default=1.0)
            if worst >= AUDIT_RECALL:
                return min(beam, n), worst
            if beam >= min(n, WIDEST_BEAM):
                return 0, 1.0
            beam *= 2

    def dump(self) -> bytes:
        """The links; the vectors are kept beside them."""
        return np.int64(len(self.layers)).tobytes() + b"".join(x.tobytes() for x in self.layers)

    @classmethod
    def load(cls, unit: np.ndarray, data: bytes) -> SmallWorld:
        self = cls.__new__(cls)
        self.unit, self.layers, at = unit.astype(np.float32), [], 8
        for k in range(int(np.frombuffer(data, np.int64, 1)[0])):
            wide = DEGREE * 2 if k == 0 else DEGREE
            self.layers.append(np.frombuffer(data, np.int32, len(unit) * wide, at).reshape(len(unit), wide))
            at += 4 * len(unit) * wide
        return self


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    every = list(found)
    return np.concatenate([q for q, _ in every]), np.concatenate([c for _, c in every])


def _units(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


GRAPHS = "dim int, shard int, beam int, recall double, nodes binary, sizes binary, vectors binary, graph binary"
ANSWERS = "node bigint, n bigint, root bigint"


def _build(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    raw = np.stack(pdf["vector"].to_numpy())
    graph = SmallWorld(_units(raw.astype(np.float64)))
    beam, recall = graph.audited_beam(least)
    row = {"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "beam": beam, "recall": recall, "nodes": pdf["node"].to_numpy(np.int64).tobytes()}
    return pd.DataFrame([row | {"sizes": pdf["size"].to_numpy(np.int64).tobytes(), "vectors": raw.tobytes(), "graph": graph.dump()}])


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each place's least place, flat) with the places a and b joined pair by pair."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


class _Shard:
    """A shard's graph, and which of its vectors queries have joined so far."""

    def __init__(self, row: dict, dtype: type, least: float):
        self.nodes, self.sizes = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.raw = np.frombuffer(row["vectors"], dtype).reshape(len(self.nodes), -1).astype(np.float64)
        self.norms = np.sqrt((self.raw * self.raw).sum(1))
        self.graph, self.beam, self.recall, self.least = SmallWorld.load(self.raw / self.norms[:, None], row["graph"]), row["beam"], row["recall"], least
        self.parent, self.counts = np.arange(len(self.nodes)), np.zeros(len(self.nodes), np.int64)

    def ask(self, asked: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        """Of each query that has links here: to how many vectors, without its own, and one that it is joined with.

        Queries of other shards are counted for the vectors here too, whose own queries don't go to those shards.
        """
        n = len(self.nodes)
        norms = np.sqrt((own * own).sum(1))
        place = np.minimum(np.searchsorted(self.nodes, asked), n - 1)
        here = np.flatnonzero(self.nodes[place] == asked)
        counts, foreign = np.zeros(len(asked), np.int64), self.nodes[place] != asked
        parent = _joined(np.r_[self.parent, np.arange(n, n + len(asked))], here + n, place[here])
        for q, c in self.graph.within((own / norms[:, None]).astype(np.float32), self.least, self.beam):
            ok = (asked[q] != self.nodes[c]) & (np.einsum("ij,ij->i", own[q], self.raw[c]) / (norms[q] * self.norms[c]) >= self.least)
            q, c = q[ok], c[ok]
            np.add.at(counts, q, self.sizes[c])
            np.add.at(self.counts, c[foreign[q]], sizes[q[foreign[q]]])
            parent = _joined(parent, q + n, c)
        self.parent = parent[:n]
        linked = np.flatnonzero(counts)
        return _answers(asked[linked], counts[linked], np.r_[self.nodes, asked][parent[n:][linked]])

    def joins(self) -> pa.RecordBatch:
        """Links that hold together what queries have joined, and how many vectors of other shards the ones here have met."""
        told = np.flatnonzero((self.parent != np.arange(len(self.nodes))) | (self.counts > 0))
        return _answers(self.nodes[told], self.counts[told], self.nodes[self.parent[told]])


def _answers(nodes: np.ndarray, counts: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, counts, roots)], ["node", "n", "root"])


def _ask(least: float, dtype: type):
    """Of rows sorted by shard and range: each graph is loaded once, and the queries that follow it stream past it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shard = None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "range")], 1)
            first = np.asarray(batch.column("graph").is_valid())
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1) | first[1:] | first[:-1], True]) if len(key) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if group != tuple(key[a]):
                    if shard is not None:
                        yield shard.joins()
                    group, shard = tuple(key[a]), None
                if first[a]:
                    shard = _Shard(batch.slice(a, 1).to_pylist()[0], dtype, least)
                elif shard is not None:
                    own = batch.column("vector").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                    nodes, sizes = (batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("node", "size"))
                    yield shard.ask(nodes, sizes, own.astype(np.float64))
        if shard is not None:
            yield shard.joins()

    return ask


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """Rows ``(id, n_links, component_id, kept, recall)``, one for each row: how many other rows have cosine >= ``least``, and the least id that links reach.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors
    of different lengths don't either. Equal vectors are one node with a count, so copies cost nothing. A row
    whose id is null is counted, but never a least id. Repeated rows are rows. An empty table stays empty. Other
    columns don't enter, whatever their names. ``recall`` is the least that an audit of the graphs asked has found.

    Each shard (SHARD_VALUES components, whatever the length of vectors) has a graph, built in one task and
    written. The vectors are cut into ranges of QUERY_VALUES components; a task loads one shard's graph once
    and streams one range of vectors past it, so a graph moves once for each range. Of two shards one's vectors ask the other (which,
    goes by whether their numbers differ evenly), and an answer counts for both ends: a vector asks its own and half of the others.
    Beams widen until an audit against brute force passes (exact products answer if none does) and until a
    query's beam holds something that is no link, so a large group is found whole. Cosine is verified in double precision.
    """
    small = dict(vectors.dtypes)[vector_col] == "array<float>"
    value = F.col(vector_col) if small else F.col(vector_col).cast("array<double>")
    dtype = np.float32 if small else np.float64
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(fine & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), value.alias("v")).withColumn("fine", fine)
    rows = written(rows.withColumns({"k1": F.when(F.col("fine"), F.xxhash64("v")), "k2": F.when(F.col("fine"), F.xxhash64(F.reverse("v"), F.lit(1)))}))
    nodes = rows.where("fine").groupBy("k1", "k2").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("size"), F.min_by("v", "id").alias("v1"), F.first("v").alias("v2"))
    nodes = nodes.withColumn("vector", F.coalesce("v1", "v2")).drop("v1", "v2")
    nodes = written(nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")}))
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    values = F.col("n") * F.col("dim")
    least_shards = F.least(F.lit(LEAST_SHARDS), F.ceil(F.col("n") / LEAST_ROWS))
    shards = F.greatest(F.ceil(values / SHARD_VALUES), least_shards).cast("int")
    ranges = F.greatest(F.ceil(values / QUERY_VALUES), F.least(F.lit(LEAST_RANGES), F.ceil(F.col("n") / LEAST_ROWS))).cast("long")
    sizes = written(sizes.select("dim", shards.alias("shards"), ranges.alias("ranges")))
    sized = attach(nodes.select("node", "k1", "size", "vector", "dim"), sizes, "dim", 3)
    placed = sized.withColumn("shard", F.pmod("k1", "shards").cast("int"))
    graphs = written(placed.select("dim", "shard", "node", "size", "vector").groupBy("dim", "shard").applyInPandas(lambda pdf: _build(pdf, least), GRAPHS))
    copies = attach(graphs, sizes, "dim", 3).withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)))
    asked = placed.withColumn("range", F.pmod(F.xxhash64("k1"), F.col("ranges"))).withColumn("own", F.col("shard"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    apart = F.abs(F.col("shard") - F.col("own")) % 2
    asked = asked.where(F.when(F.col("shard") < F.col("own"), apart == 1).otherwise(apart == 0))
    asked = asked.select("dim", "shard", "ranges", "range", "node", "size", "vector")
    every = copies.drop("shards").unionByName(asked, allowMissingColumns=True)
    slot = F.col("dim") + F.col("shard").cast("long") * F.col("ranges") + F.col("range")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = every.withColumn("slot", F.pmod(slot, F.lit(partitions)).cast("int")).repartitionById(partitions, "slot").sortWithinPartitions("dim", "shard", "range", F.col("graph").isNull())
    answers = written(laid.mapInArrow(_ask(least, dtype), ANSWERS))
    groups = connected_components(answers.where("node <> root"), "node", "root")
    counts = answers.groupBy(F.col("node").alias("counted")).agg(F.sum("n").alias("n"))
    recalls = written(graphs.groupBy("dim").agg(F.min("recall").alias("recall")))
    labelled = nodes.join(groups.withColumnRenamed("node", "grouped"), F.col("node") == F.col("grouped"), "left").withColumn("component", F.coalesce("component", "node"))
    heads = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = attach(labelled.join(heads, "component").join(counts, F.col("node") == F.col("counted"), "left"), recalls, "dim", 2)
    links = F.col("size") - 1 + F.coalesce("n", F.lit(0))  # equal vectors, and those that the graphs found
    known = written(known.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), links.alias("links"), "component_id", "recall"))
    discard(answers, graphs, nodes, sizes)
    out = rows.join(known, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")), "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    found = out.select("id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), "recall")
    return found.select("id", "n_links", "component_id", kept, "recall")

"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, merged results.

Rows are laid out in cells, each row in that of the nearest of a few centres; a cell has about ``SHARD_ROWS`` rows, and one
with more is spread over several shards by a digest of the id, so a shard's size is fixed by a task's memory. Each
shard is one row: ids, vectors and, for each layer, a flat array of neighbours (``M`` a node, twice that on layer 0, -1
where empty). Equal vectors of a shard are one node with many ids, so that copies can't crowd a neighbourhood. As a
shard is bounded, a layer's candidates are found exactly, by matrix products, not by a search of the half-built graph;
neighbours are chosen by the pruning rule (a candidate nearer to a chosen neighbour than to the node is passed over, and
fills up if room is left), and links back that overflow a list are chosen anew from all of them.

A query goes to all shards of its nearest cells. How many cells is measured, not guessed: the exact neighbours of
``CHECKED`` queries among all rows are found by brute force (work in proportion to the rows), and so many cells are probed
that ``REACHED`` of these neighbours lie in them: few where vectors cluster, all where they have no structure. In a shard all
queries of a block walk at once, and the found rows' cosines are computed exactly in double precision on the original
vectors; the best ``k`` of all shards remain. Centres are learned from a sample of about ``SAMPLE`` rows; every row is indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
with a null id; vectors of different length are never compared; repeated ids with equal vectors count once (with
different vectors the nearer one counts); with fewer candidates than ``k`` all found are returned; other columns, whatever
their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import discard, picked, ranges, stored

K, M, BUILD, SEARCH, ENTRIES = 5, 16, 48, 256, 16
SHARD_ROWS, BLOCK_QUERIES = 16_384, 65_536
SEED = 20
#: Cells at most, rows that their centres are learned from, queries by which the number of probed cells is found, and the
#: share of these queries' exact neighbours that must lie in the probed cells.
MOST_CELLS, SAMPLE, CHECKED, REACHED = 16_384, 16_384, 256, 0.99


class Graph:
    """HNSW over unit vectors, with flat neighbour arrays; distance is 1 - cosine."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], level: np.ndarray) -> None:
        self.unit, self.layers, self.level = unit, layers, level

    @classmethod
    def build(cls, unit: np.ndarray, m: int = M, width: int = BUILD) -> Graph:
        n = len(unit)
        rng = np.random.default_rng(SEED)
        level = (-np.log(1 - rng.random(n)) / np.log(m)).astype(np.int64)
        level[0] = level.max()  # node 0 is on every layer and is the entry
        layers = [np.full((n, (2 if lay == 0 else 1) * m), -1, np.int32) for lay in range(int(level[0]) + 1)]
        self = cls(unit, layers, level)
        for lay in range(len(layers)):
            self._link(lay, m, width)
        return self

    def _link(self, lay: int, m: int, width: int) -> None:
        """Links a layer: candidates are the nearest of all its nodes, and of those that reach the layer above, so that a
        tight cluster has ways in and out."""
        nodes = np.flatnonzero(self.level >= lay)
        above = np.flatnonzero(self.level > lay)
        chosen = np.full((len(nodes), m), -1, np.int64)
        for at in range(0, len(nodes), 512):
            own = nodes[at : at + 512]
            found, far = [], []
            for pool, most in ((nodes, width), (above, m)):
                if not len(pool):
                    continue
                gap = 1 - self.unit[own] @ self.unit[pool].T
                gap[own[:, None] == pool[None, :]] = np.inf
                most = min(most, len(pool))
                near = np.argpartition(gap, most - 1, axis=1)[:, :most]
                found.append(pool[near])
                far.append(np.take_along_axis(gap, near, 1))
            if len(found) > 1:
                known = (found[1][:, :, None] == found[0][:, None, :]).any(2)
                far[1] = np.where(known, np.inf, far[1])
            found, far = np.concatenate(found, 1), np.concatenate(far, 1)
            order = np.argsort(far, axis=1, kind="stable")
            own_chosen = self._choose(np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1), m)
            chosen[at : at + 512, : own_chosen.shape[1]] = own_chosen
        self.layers[lay][nodes, :m] = chosen
        self._back(nodes, chosen, lay)

    def _choose(self, found: np.ndarray, far: np.ndarray, m: int) -> np.ndarray:
        """Up to ``m`` neighbours a row from candidates in ascending distance."""
        rows, width = found.shape
        vectors = self.unit[found]
        among = vectors @ vectors.transpose(0, 2, 1) if width <= 256 else None
        nearest = np.full((rows, width), np.inf, np.float32)  # to a neighbour chosen so far
        state = np.where((found >= 0) & np.isfinite(far), 0, 2).astype(np.int8)  # 0 open, 1 chosen, 2 closed, 3 passed over
        for _ in range(m):
            state[(state == 0) & (nearest < far)] = 3
            open_ = state == 0
            pick = np.where(open_.any(1), open_.argmax(1), -1)
            live = np.flatnonzero(pick >= 0)
            if not len(live):
                break
            state[live, pick[live]] = 1
            if among is not None:
                gap = 1 - among[live, pick[live]]
            else:
                gap = 1 - np.einsum("rwd,rd->rw", vectors[live], vectors[live, pick[live]])
            nearest[live] = np.minimum(nearest[live], gap)
        rank = np.where(state == 1, 0, np.where((state == 3) | (state == 0), 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :m]
        out = np.take_along_axis(found, order, 1)
        return np.where(np.take_along_axis(state, order, 1) == 2, -1, out)

    def _back(self, nodes: np.ndarray, chosen: np.ndarray, lay: int) -> None:
        """Adds the links back; a list that overflows is chosen anew from all that it has and gets."""
        links, room = self.layers[lay], self.layers[lay].shape[1]
        real = chosen >= 0
        a, b = np.repeat(nodes, real.sum(1)), chosen[real]
        pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
        target, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        order = np.argsort(count, kind="stable")
        at = 0
        while at < len(order):
            most = max(room, int(count[order[at]]))
            end = int(np.searchsorted(count[order], 2 * most, side="left"))
            end = max(at + 1, min(end, at + (1 << 15) // most))
            own = order[at:end]
            width = max(room, int(count[own].max()))
            lists = np.full((len(own), width), -1, np.int64)
            place = np.arange(width)[None, :] < count[own][:, None]
            lists[place] = pairs[ranges(first[own], count[own]), 1]
            if width > room:
                far = np.where(place, 1 - np.einsum("rwd,rd->rw", self.unit[lists], self.unit[target[own]]), np.inf)
                by = np.argsort(far, axis=1, kind="stable")
                lists = self._choose(np.take_along_axis(lists, by, 1), np.take_along_axis(far, by, 1), room)
            links[target[own]] = lists
            at = end

    def _walk(self, queries: np.ndarray, entry: np.ndarray, lay: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found from several ``entry`` nodes a query (-1: none), ascending, of all queries at once: (nodes, distances)."""
        q, n, e = len(queries), len(self.unit), entry.shape[1]
        links = self.layers[lay]
        width = max(width, e)
        nodes = np.full((q, width), -1, np.int64)
        far = np.full((q, width), np.inf, np.float32)
        seen = np.zeros((q, n), bool)
        nodes[:, :e] = entry
        far[:, :e] = np.where(entry >= 0, 1 - np.einsum("qd,qed->qe", queries, self.unit[entry]), np.inf)
        open_ = nodes >= 0
        row, place = np.nonzero(entry >= 0)
        seen[row, entry[row, place]] = True
        live = np.arange(q)
        while len(live):
            pick = np.where(open_[live], far[live], np.inf).argmin(1)
            going = open_[live, pick]
            live, pick = live[going], pick[going]
            if not len(live):
                break
            open_[live, pick] = False
            next_ = links[nodes[live, pick]].astype(np.int64)
            valid = (next_ >= 0) & ~seen[live[:, None], next_]
            row, place = np.nonzero(valid)
            seen[live[row], next_[row, place]] = True
            gap = np.where(valid, 1 - np.einsum("qmd,qd->qm", self.unit[next_], queries[live]), np.inf)
            all_nodes = np.concatenate([nodes[live], next_], 1)
            all_far = np.concatenate([far[live], gap], 1)
            all_open = np.concatenate([open_[live], valid], 1)
            best = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            nodes[live] = np.take_along_axis(all_nodes, best, 1)
            far[live] = np.take_along_axis(all_far, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1) & np.isfinite(far[live])
        order = np.argsort(far, axis=1, kind="stable")
        nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
        return np.where(np.isfinite(far), nodes, -1), far

    def search(self, queries: np.ndarray, width: int = SEARCH) -> np.ndarray:
        """Nodes near each unit query, -1 where fewer were found."""
        at = np.zeros((len(queries), 1), np.int64)
        for lay in range(len(self.layers) - 1, 0, -1):
            at = self._walk(queries, at, lay, ENTRIES)[0]
        return self._walk(queries, at, 0, width)[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    scale = np.abs(wide).max(1, keepdims=True)  # so that no square overflows or vanishes
    wide = wide / scale
    return (wide / np.sqrt((wide * wide).sum(1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; equal rows give equal results wherever they stand."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


INDEX = "dim int, shard int, ids binary, first binary, vectors binary, level binary, links binary"


def build_index(placed: DataFrame) -> DataFrame:
    """One row a shard from (dim, shard, vec_id, vector): arrays as bytes. ``first``: where a node's ids start."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.stack(frame["vector"].to_numpy()).astype(np.float32)
        ids = frame["vec_id"].to_numpy().astype(np.int64)
        distinct, node = np.unique(own, axis=0, return_inverse=True)
        mixed = np.random.default_rng(SEED).permutation(len(distinct))
        place = np.empty(len(mixed), np.int64)
        place[mixed] = np.arange(len(mixed))
        distinct, node = distinct[mixed], place[node.ravel()]
        order = np.lexsort((ids, node))
        first = np.searchsorted(node[order], np.arange(len(distinct) + 1))
        g = Graph.build(unit(distinct))
        links = b"".join(x.tobytes() for x in g.layers)
        row = (int(frame["dim"].iloc[0]), int(frame["shard"].iloc[0]), ids[order].tobytes(), first.astype(np.int32).tobytes(), distinct.tobytes(), g.level.astype(np.int8).tobytes(), links)
        return pd.DataFrame([row], columns=["dim", "shard", "ids", "first", "vectors", "level", "links"])

    return placed.groupBy("dim", "shard").applyInPandas(build, INDEX)


def load(row: pd.Series, m: int = M) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, ids, first, vectors) of an index row."""
    own = np.frombuffer(row["vectors"], np.float32).reshape(-1, int(row["dim"]))
    n = len(own)
    flat = np.frombuffer(row["links"], np.int32)
    layers, at = [], 0
    while at < len(flat):
        width = 2 * m if at == 0 else m
        layers.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    graph = Graph(unit(own), layers, np.frombuffer(row["level"], np.int8))
    return graph, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int32), own


FOUND = "query_id long, vec_id long, score double"


def search_index(index: DataFrame, asked: DataFrame, n_queries: int, k: int = K, width: int = SEARCH) -> DataFrame:
    """Each query's ``k`` nearest in every shard that it is sent to; ``asked``: (dim, shard, query_id, vector)."""
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            graph, ids, first, own = load(left.iloc[0])
            per = max(1, min(256, (1 << 24) // max(1, len(own))))
            for at in range(0, len(right), per):
                q = np.stack(right["vector"].to_numpy()[at : at + per]).astype(np.float32)
                names = right["query_id"].to_numpy()[at : at + per].astype(np.int64)
                nodes = graph.search(unit(q), max(width, 2 * k + 2))
                score = np.where(nodes >= 0, cosines(own[nodes], q[:, None, :]), -np.inf)
                order = np.argsort(-score, axis=1, kind="stable")
                for i, name in enumerate(names.tolist()):
                    mine: list[tuple[float, int]] = []
                    for j in order[i].tolist():
                        s = float(score[i, j])
                        if s == -np.inf or (len(mine) >= k and s < mine[k - 1][0]):
                            break
                        node = nodes[i, j]
                        copies = ids[first[node] : first[node + 1]]  # ascending
                        mine += [(s, v) for v in copies[: k + 1].tolist() if v != name][:k]
                        mine.sort(key=lambda x: (-x[0], x[1]))
                    out += [(name, v, s) for s, v in mine[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)).cast("int"))
    served = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grouped = served.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block"))
    return grouped.applyInPandas(search, FOUND)


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def centres(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` unit centres of a sample of unit vectors, by a few rounds of spherical k-means."""
    out = sample[np.random.default_rng(SEED).choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(4):
        home = np.concatenate([(sample[a : a + 1024] @ out.T).argmax(1) for a in range(0, len(sample), 1024)])
        for c in np.unique(home):
            mean = sample[home == c].sum(0)
            norm = np.sqrt((mean * mean).sum())
            if norm > 0:
                out[c] = mean / norm
    return out


def _learned(rows: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """Centres of the cells of each dimension that needs more than one shard."""
    out = {}
    for dim, n in counts.items():
        cells = min(MOST_CELLS, -(-n // SHARD_ROWS))
        if cells > 1:
            wanted = max(SAMPLE, 4 * cells)
            draw = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, wanted / n) * (1 << 30))
            drawn = rows.where((F.col("dim") == dim) & draw).select("vector").limit(2 * wanted).toArrow()
            out[dim] = centres(_vectors(drawn["vector"].combine_chunks(), dim), cells)
    return out


def _in_cells(rows: DataFrame, learned: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (dim, vec_id, vector) with the cell of each."""

    def run(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for dim in set(dims.tolist()) & learned.keys():
                own = np.flatnonzero(dims == dim)
                cell[own] = (_vectors(batch.column(2).take(pa.array(own)), dim) @ learned[dim].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["dim", "vec_id", "vector", "cell"])

    return rows.mapInArrow(run, "dim int, vec_id long, vector array<float>, cell int")


def _probes(rows: DataFrame, asked: DataFrame, learned: dict[int, np.ndarray], k: int) -> dict[int, int]:
    """How many of the nearest cells a query must be sent to, by the exact neighbours of ``CHECKED`` queries among all rows."""
    out = {}
    for dim, middle in learned.items():
        some = asked.where(F.col("dim") == dim).orderBy(F.xxhash64("query_id", F.lit("checked"))).limit(CHECKED).toArrow()
        names, q = some["query_id"].to_numpy(), _vectors(some["vector"].combine_chunks(), dim)
        if not len(names):
            out[dim] = 1
            continue

        def best(batches, names=names, q=q, dim=dim):
            score, cell = np.full((len(names), k), -2.0, np.float32), np.zeros((len(names), k), np.int32)
            for batch in batches:
                if not batch.num_rows:
                    continue
                s = q @ _vectors(batch.column(2), dim).T
                s[names[:, None] == batch.column(1).to_numpy()[None, :]] = -2.0
                s, c = np.concatenate([score, s], 1), np.concatenate([cell, np.broadcast_to(batch.column(3).to_numpy(), s.shape)], 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                score, cell = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
            i, j = np.nonzero(score > -2.0)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(score[i, j]), pa.array(cell[i, j])], names=["q", "s", "cell"])

        found = rows.where(F.col("dim") == dim).mapInArrow(best, "q int, s float, cell int")
        top = Window.partitionBy("q").orderBy(F.desc("s"))
        near = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("q", "cell").toArrow()
        rank = (-(q @ middle.T)).argsort(1).argsort(1)[near["q"].to_numpy(), near["cell"].to_numpy()]
        out[dim] = 1 + int(np.quantile(rank, REACHED, method="higher")) if len(rank) else 1
    return out


def _sent(asked: DataFrame, learned: dict[int, np.ndarray], probes: dict[int, int]) -> DataFrame:
    """``asked`` (dim, query_id, vector) with each cell that a query is sent to."""

    def run(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            row, cell = [np.flatnonzero(~np.isin(dims, list(learned)))], []
            cell.append(np.zeros(len(row[0]), np.int64))
            for dim in set(dims.tolist()) & learned.keys():
                own, p = np.flatnonzero(dims == dim), probes[dim]
                near = np.argpartition(-(_vectors(batch.column(2).take(pa.array(own)), dim) @ learned[dim].T), p - 1, axis=1)[:, :p]
                row.append(np.repeat(own, p))
                cell.append(near.ravel())
            out = batch.take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell).astype(np.int32))], names=["dim", "query_id", "vector", "cell"])

    return asked.mapInArrow(run, "dim int, query_id long, vector array<float>, cell int")


def nearest(df: DataFrame, is_query: Column, k: int = K, width: int = SEARCH, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` holds (a test of vec_id)."""
    rows = picked(df, vec_id=(vec_id, T.LongType()), vector=(embedding, T.ArrayType(T.FloatType())))
    rows = rows.where(F.col("vec_id").isNotNull() & valid(F.col("vector"))).dropDuplicates(["vec_id", "vector"])
    rows = stored(rows.select(F.size("vector").alias("dim"), "vec_id", "vector"))
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    learned = _learned(rows, counts)
    celled = stored(_in_cells(rows, learned))
    asked = celled.where(is_query).select("dim", F.col("vec_id").alias("query_id"), "vector")
    probes = _probes(celled, asked, learned, k)
    salts = stored(celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("salts"))).toArrow().to_pylist()
    shards, at = [], 0
    for r in sorted(salts, key=lambda r: (r["dim"], r["cell"])):
        shards.append((r["dim"], r["cell"], at, r["salts"]))
        at += r["salts"]
    table = F.broadcast(df.sparkSession.createDataFrame(shards, "dim int, cell int, at int, salts int"))  # a row a cell
    shard = F.col("at") + F.pmod(F.xxhash64("vec_id", F.lit("salt")), F.col("salts")).cast("int")
    placed = celled.join(table, ["dim", "cell"]).select("dim", shard.alias("shard"), "vec_id", "vector")
    index = stored(build_index(placed))
    every = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("salts") - 1)).alias("shard")
    sent = _sent(asked, learned, probes).join(table, ["dim", "cell"]).select("dim", every, "query_id", "vector")
    found = search_index(index, sent, asked.count(), k, width).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("i", "b"))
    out = stored(ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score")))
    discard(rows, celled, index)
    return out

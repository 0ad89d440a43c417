"""Training: levels of all trees by distributed histograms, then small nodes finished in memory."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.impurity import impurity_of, predict_of, weight
from coppice.operators import bagging, binning, splits
from coppice.operators.metadata import Metadata, build
from coppice.operators.search import Found, best_split, feature_split
from coppice.plans import local
from coppice.plans.schedule import PYTHON_MEMORY, Task, TimePrediction, by_rows, local_rows, node_bytes, pack, python_bytes
from coppice.plans.tree import Tree
from coppice.sources.folders import delete, write_aside

#: Features whose histograms one reducer holds at a time.
FEATURE_BLOCK = 16
#: Rows are merged by their bins if that leaves one in so many at most, and takes no more sums than these.
MERGE_SHARE, MERGE_SUMS = 4, 128


@dataclass
class Strategy:
    """All settings of a training run."""

    classify: bool = True
    impurity: str = "gini"
    max_depth: int = 10
    num_classes: int = 2
    max_bins: int = 32
    categorical: dict[int, int] = field(default_factory=dict)
    min_instances: float = 1
    min_gain: float = 0.0
    num_trees: int = 1
    features: str = "auto"
    subsampling: float = 1.0
    seed: int = 17
    max_memory_mb: int = 256
    cache_node_ids: bool = True
    checkpoint_interval: int = 10
    max_memory_multiplier: float = 4.0
    max_tasks_per_bin: int = 1 << 31
    custom_splits: Sequence[Sequence[float]] | None = None
    local_trainer: local.LocalTrainer = local.fit
    time_prediction: TimePrediction = by_rows
    local_max_rows: int | None = None
    exact_splits: bool = False
    zero_gain: bool = False
    zero_gain_locally: bool = False
    prune: bool = True

    def validate(self) -> None:
        checks = [
            (self.max_depth >= 0, "maxDepth must not be negative"),
            (self.max_bins >= 2, "maxBins must be at least 2"),
            (not self.classify or self.num_classes >= 2, "classification needs at least 2 classes"),
            (self.min_instances >= 1, "minInstancesPerNode must be at least 1"),
            (self.max_memory_mb >= 0, "maxMemoryInMB must not be negative"),
            (0 < self.subsampling <= 1, "subsamplingRate must be in (0, 1]"),
            (self.num_trees >= 1, "numTrees must be at least 1"),
            (self.max_memory_multiplier > 0, "maxMemoryMultiplier must be positive"),
            (self.max_tasks_per_bin >= 1, "maxTasksPerBin must be at least 1"),
            (self.checkpoint_interval >= 1 or self.checkpoint_interval == -1, "checkpointInterval must be -1 or positive"),
            (all(k >= 1 for k in self.categorical.values()), "categorical features need categories"),
        ]
        for ok, message in checks:
            if not ok:
                raise ValueError(message)


@dataclass
class Result:
    trees: list[Tree]
    meta: Metadata
    thresholds: list[list[float]]
    #: phase -> seconds
    seconds: dict[str, float]
    #: (tree, node, rows, impurity, seconds) of each locally finished node
    nodes: list[tuple[int, int, float, float, float]]


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def _labels(column: pa.Array) -> np.ndarray:
    """A label a row, or of merged rows the sums of each tree."""
    return _matrix(column, np.float64) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)


def _of_tree(labels: np.ndarray, tree: int) -> np.ndarray:
    return labels if labels.ndim == 1 else labels[:, 2 * tree : 2 * tree + 2]


def _block(features: int) -> int:
    return -(-features // FEATURE_BLOCK)


class _State:
    """Binned rows with the node that each row has reached in each tree, or without, if nodes are found by walking."""

    def __init__(self, rows: DataFrame, strategy: Strategy) -> None:
        self.strategy = strategy
        self.rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.cached = strategy.cache_node_ids
        self.now = self.rows.withColumn("nodes", F.array_repeat(F.lit(0), strategy.num_trees)) if self.cached else self.rows
        self.updates = 0
        self.held: DataFrame | None = None
        self.aside: str | None = None

    def advance(self, trees: list[Tree]) -> None:
        """Sends rows on to the leaves of the grown trees."""
        if not self.cached:
            return
        flats = [t.flat() for t in trees]
        schema = self.now.schema

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, nodes = _matrix(batch.column(0)), _matrix(batch.column(schema.names.index("nodes")))
                for t, flat in enumerate(flats):
                    nodes[:, t] = flat.leaves(bins, True, nodes[:, t])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * nodes.shape[1], pa.int32()), pa.array(nodes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=schema.names)

        after = self.now.mapInArrow(run, schema)
        self.updates += 1
        every = self.strategy.checkpoint_interval
        path = None
        if every > 0 and self.updates % every == 0:
            after, path = write_aside(after)  # cuts the lineage
        else:
            after = after.persist(StorageLevel.MEMORY_AND_DISK)
        old, self.held, self.now = self.held, after, after
        if old is not None:
            self.now.count()
            old.unpersist()
        if path is not None:
            if self.aside is not None:
                delete(after.sparkSession, self.aside)
            self.aside = path

    def close(self) -> None:
        for df in (self.rows, self.held):
            if df is not None:
                df.unpersist()
        if self.aside is not None:
            delete(self.rows.sparkSession, self.aside)


def _nodes_of(batch: pa.RecordBatch, bins: np.ndarray, flats) -> np.ndarray:
    """Nodes of a batch's rows: as kept, and with ``flats`` walked on from there or from the roots."""
    at = batch.schema.get_field_index("nodes")
    kept = _matrix(batch.column(at)) if at >= 0 else None
    if flats is None:
        return kept
    return np.stack([f.leaves(bins, True, None if kept is None else kept[:, t]) for t, f in enumerate(flats)], 1)


def find_best_splits(state: _State, trees: list[Tree], group: list[tuple[int, int]], meta: Metadata, features: list[list[int]]) -> dict[tuple[int, int], Found]:
    """Best split of each (tree, node) of a group.

    Every task adds its rows into one histogram (bounded by the group's memory), so the shuffle carries one row per task,
    node and block of features. Reducers add them up one by one and send a candidate per block to the driver.
    """
    k, cells = meta.stats, max(meta.bins(f) for f in range(meta.num_features))
    width = max(len(f) for f in features)
    chosen = np.full((len(group), width), -1, np.int64)
    for i, f in enumerate(features):
        chosen[i, : len(f)] = f
    slots = [np.full(len(t), -1, np.int64) for t in trees]
    for i, (t, node) in enumerate(group):
        slots[t][node] = i
    flats = None if state.cached else [t.flat() for t in trees]

    def partial(batches):
        sums = np.zeros((len(group), width, cells * k))
        seen = np.zeros(len(group), bool)
        flat = sums.reshape(len(group), -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, bag = _matrix(batch.column(0)), _matrix(batch.column(3), np.float64)
            labels, weights = _labels(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            nodes = _nodes_of(batch, bins, flats)
            for t, slot_of in enumerate(slots):
                slot = slot_of[nodes[:, t]]
                rows = np.flatnonzero((slot >= 0) & (bag[:, t] != 0))
                if not len(rows):
                    continue
                slot, w = slot[rows], bag[rows, t] * weights[rows]
                own, y = bins[rows], _of_tree(labels, t)[rows]
                local_slots, at = np.unique(slot, return_inverse=True)
                seen[local_slots] = True
                cells_k = cells * k
                for j in range(width):
                    f = chosen[slot, j]
                    has = f >= 0
                    cell = at * cells_k + own[np.arange(len(rows)), np.maximum(f, 0)] * k
                    size = len(local_slots) * cells_k
                    if meta.classify:
                        add = np.bincount((cell + y.astype(np.int64))[has], w[has], minlength=size)
                    else:
                        add = sum(np.bincount((cell + i)[has], v[has], minlength=size) for i, v in enumerate(local.moments(y, w)))
                    sums[local_slots, j] += add.reshape(len(local_slots), cells_k)
        for b in range(_block(width)):
            for own in np.array_split(np.flatnonzero(seen), 1 + int(seen.sum()) // 256):
                if len(own):
                    parts = [flat[i].reshape(width, -1)[b * FEATURE_BLOCK : (b + 1) * FEATURE_BLOCK].tobytes() for i in own]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([b] * len(own), pa.int32()), pa.array(parts, pa.binary())], names=["slot", "block", "cells"])

    def choose(slot: int, block: int, total: np.ndarray):
        own = total.reshape(-1, cells, k)
        first = block * FEATURE_BLOCK
        best, place = None, -1
        for j in range(len(own)):
            f = int(chosen[slot, first + j])
            found = None if f < 0 else feature_split(own[j][: meta.bins(f)], f, meta)
            if found is not None and (best is None or found.gain > best.gain):
                best, place = found, first + j
        parent = own[0].sum(0)
        if best is None or not best.valid:
            return slot, -1, -1.0, -1, None, parent.tolist(), None, None
        return slot, place, best.gain, best.split.bin, None if best.split.left is None else list(best.split.left), parent.tolist(), best.left.tolist(), best.right.tolist()

    schema = "slot int, place int, gain double, bin int, categories array<int>, stats array<double>, lhs array<double>, rhs array<double>"
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 3]
    names = [c.split()[0] for c in schema.split(", ")]

    def reduce(batches):
        key, total, out = None, None, []
        for batch in batches:
            slot, block = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                part = np.frombuffer(batch.column(2)[i].as_buffer(), np.float64)
                if (slot[i], block[i]) == key:
                    total += part
                    continue
                if key is not None:
                    out.append(choose(*key, total))
                key, total = (slot[i], block[i]), part.copy()
        if key is not None:
            out.append(choose(*key, total))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    summed = state.now.mapInArrow(partial, "slot int, block int, cells binary").repartition("slot", "block").sortWithinPartitions("slot", "block")
    rows = summed.mapInArrow(reduce, schema).collect()
    best: dict[int, tuple] = {}
    parents: dict[int, np.ndarray] = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        parents.setdefault(r["slot"], np.array(r["stats"]))
        if r["place"] >= 0 and (r["slot"] not in best or r["gain"] > best[r["slot"]]["gain"]):
            best[r["slot"]] = r
    out = {}
    for i, key in enumerate(group):
        r = best.get(i)
        if r is None:
            out[key] = best_split([parents.get(i, np.zeros(k))[None, :]], [], meta)
            continue
        f = features[i][r["place"]]
        split = local.Split(f, r["bin"], None if r["categories"] is None else tuple(r["categories"]))
        out[key] = Found(split, r["gain"], np.array(r["stats"]), np.array(r["lhs"]), np.array(r["rhs"]))
    return out


def groups_of(pending: list[tuple[int, int]], meta: Metadata, max_bytes: int) -> list[list[tuple[int, int]]]:
    """Nodes whose histograms fit the memory together; one node at least."""
    most = max(1, max_bytes // max(1, node_bytes(meta, meta.features_per_node)))
    return [pending[i : i + most] for i in range(0, len(pending), most)]


def train(df: DataFrame, strategy: Strategy, num_features: int) -> Result:
    """``df``: label and weight (double), features (array<double>), row_id (a stable key, needed if rows are drawn)."""
    strategy.validate()
    began, seconds = time.perf_counter(), {}

    def lap(name: str) -> None:
        nonlocal began
        seconds[name] = seconds.get(name, 0.0) + time.perf_counter() - began
        began = time.perf_counter()

    spark = df.sparkSession
    if strategy.classify:
        wrong = F.concat(F.lit(f"labels must be whole numbers in [0, {strategy.num_classes}), but a row has "), F.coalesce(F.col("label").cast("string"), F.lit("null")))
        fits = (F.col("label") >= 0) & (F.col("label") < strategy.num_classes) & (F.col("label") == F.floor("label"))
        df = df.withColumn("label", F.when(fits, F.col("label")).otherwise(F.raise_error(wrong).cast("double")))
    num_rows, lightest = df.agg(F.count("*"), F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()
    meta = build(
        num_features,
        num_rows,
        strategy.num_classes,
        strategy.categorical,
        strategy.impurity,
        strategy.classify,
        strategy.max_bins,
        strategy.features,
        strategy.num_trees,
        min_instances=strategy.min_instances,
        min_gain=strategy.min_gain,
        max_depth=strategy.max_depth,
        zero_gain=strategy.zero_gain,
        zero_gain_locally=strategy.zero_gain_locally,
    )
    lap("metadata")
    thresholds = splits.find_thresholds(df, meta, strategy.seed, strategy.custom_splits, strategy.exact_splits)
    meta = replace(meta, num_splits=tuple(len(t) for t in thresholds))
    lap("splits")
    bagged = bagging.bag(binning.bin_rows(df, meta, thresholds), strategy.num_trees, strategy.subsampling, strategy.seed)
    rows = bagged.select("bins", "label", "weight", "bag")
    most = num_rows
    if _merges(strategy, meta):
        rows, most = binning.merge_rows(rows, meta, strategy.num_trees), binning.cells_of(meta)
    state = _State(rows, strategy)
    try:
        return _grow(state, strategy, meta, thresholds, seconds, lap, _local_limit(spark, strategy, meta, most, lightest))
    finally:
        state.close()


def _merges(strategy: Strategy, meta: Metadata) -> bool:
    """Whether few rows differ in their bins. A trainer of the user's own gets rows as they are."""
    sums = strategy.num_trees * (1 if meta.classify else 3)
    return strategy.local_trainer is local.fit and sums <= MERGE_SUMS and binning.cells_of(meta) * MERGE_SHARE <= meta.num_rows


def _grow(state: _State, strategy: Strategy, meta: Metadata, thresholds, seconds: dict, lap, limit: float) -> Result:
    trees = [Tree() for _ in range(strategy.num_trees)]
    for t in trees:
        t.add(0.0, 0.0)
    level = [(t, 0) for t in range(strategy.num_trees)]
    tasks: list[Task] = []
    depth = 0
    while level:
        after: list[tuple[int, int]] = []
        for group in groups_of(level, meta, strategy.max_memory_mb << 20):
            features = [local.node_features(meta, strategy.seed, t, n) for t, n in group]
            for (t, n), found in find_best_splits(state, trees, group, meta, features).items():
                tree = trees[t]
                if n == 0:
                    tree.prediction[0] = float(predict_of(found.stats, meta.impurity))
                    tree.impurity[0] = float(impurity_of(found.stats, meta.impurity)) if found.valid else -1.0
                if not local.usable(found, meta) or depth >= strategy.max_depth:
                    continue
                kids = local.apply_split(tree, n, found, meta, thresholds)
                for kid, stats in zip(kids, (found.left, found.right)):
                    rows, impure = float(weight(stats, meta.impurity)), tree.impurity[kid]
                    if impure == 0 or depth + 1 >= strategy.max_depth:
                        continue
                    if rows < limit:
                        tasks.append(Task(t, kid, rows, impure, depth + 1))
                    else:
                        after.append((t, kid))
        depth += 1
        level = after
        if level:
            state.advance(trees)
        lap("distributed")
    nodes = _finish_locally(state, trees, tasks, strategy, meta, thresholds, limit) if tasks else []
    lap("local")
    done = [t.pruned() if strategy.prune else t.copy() for t in trees]
    lap("stitch")
    return Result(done, meta, thresholds, seconds, nodes)


def _local_limit(spark, strategy: Strategy, meta: Metadata, most: int, lightest: float | None) -> float:
    """Weight below which a node is finished in memory: ``local_max_rows``, but no more than a task holds of ``most`` rows."""
    fits = _default_local_rows(spark, strategy, meta)
    own = fits if strategy.local_max_rows is None else strategy.local_max_rows
    return own if most <= fits else min(own, fits * min(1.0, lightest or 1.0))


def _default_local_rows(spark, strategy: Strategy, meta: Metadata) -> int:
    """From what an executor's Python workers may use and its cores, as configured; where nothing is, from maxMemoryInMB."""
    conf = spark.sparkContext.getConf()
    cores = int(conf.get("spark.executor.cores", "1"))
    total = python_bytes({k: conf.get(k, None) for k in PYTHON_MEMORY}, strategy.max_memory_mb << 20)
    return local_rows(total, cores, meta, strategy.max_memory_multiplier)


def _finish_locally(state: _State, trees: list[Tree], tasks: list[Task], strategy: Strategy, meta: Metadata, thresholds, limit: float) -> list[tuple]:
    """Ships the rows of each task to one core, bins of tasks in parallel, and grafts the subtrees that come back."""
    bins = pack(tasks, limit, strategy.max_tasks_per_bin, strategy.time_prediction)
    ordered = [t for b in bins for t in b.tasks]
    bin_of = np.array([i for i, b in enumerate(bins) for _ in b.tasks], np.int64)
    slots = [np.full(len(t), -1, np.int64) for t in trees]
    for i, task in enumerate(ordered):
        slots[task.tree][task.node] = i
    flats = [t.flat() for t in trees]
    narrow = np.uint8 if max(meta.bins(f) for f in range(meta.num_features)) <= 256 else np.int32
    sent = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, bag = _matrix(batch.column(0)), _matrix(batch.column(3), np.float64)
            labels, weights = _labels(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            nodes = _nodes_of(batch, own, flats)
            small = own.astype(narrow)
            for t, slot_of in enumerate(slots):
                slot = slot_of[nodes[:, t]]
                rows = np.flatnonzero((slot >= 0) & (bag[:, t] != 0))
                if not len(rows):
                    continue
                rows = rows[np.argsort(slot[rows], kind="stable")]
                names, first = np.unique(slot[rows], return_index=True)
                parts = [rows[a:z] for a, z in zip(first, np.append(first[1:], len(rows)))]
                columns = [bin_of[names].tolist(), names.tolist(), [small[r].tobytes() for r in parts], [_of_tree(labels, t)[r].tobytes() for r in parts], [(bag[r, t] * weights[r]).tobytes() for r in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, sent)], names=["bin", "task", "bins", "label", "w"])

    trainer, seed, max_depth = strategy.local_trainer, strategy.seed, strategy.max_depth

    def fit(table: pa.Table) -> pa.Table:
        began = time.perf_counter()
        i = table.column("task")[0].as_py()
        task = ordered[i]
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        own = joined("bins", narrow).reshape(-1, meta.num_features).astype(np.int64)
        labels, weights = joined("label", np.float64), joined("w", np.float64)
        if len(labels) > len(weights):
            labels = labels.reshape(-1, 2)
        key = (task.tree, task.node + (1 << 32))
        sub = trainer(own, labels, weights, meta, thresholds, max_depth - task.depth, seed, key)
        spent = time.perf_counter() - began
        columns = [[i] * len(sub), list(range(len(sub))), sub.feature, sub.threshold, sub.bin, sub.categories, sub.left, sub.right, sub.prediction, sub.impurity, sub.gain, [spent] * len(sub)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "task int, id int, feature int, threshold double, bin int, categories array<int>, lhs int, rhs int, prediction double, impurity double, gain double, seconds double"
    names = [c.split()[0] for c in schema.split(", ")]
    kind = {"int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
    kinds = [kind[c.split()[1]] for c in schema.split(", ")]
    shipped = state.now.mapInArrow(spread, "bin int, task int, bins binary, label binary, w binary")
    placed = shipped.repartitionById(len(bins), F.col("bin")) if hasattr(shipped, "repartitionById") else shipped.repartition(len(bins), "bin")
    rows = placed.groupBy("bin", "task").applyInArrow(fit, schema).collect()
    subtrees: dict[int, list] = {}
    for r in rows:
        subtrees.setdefault(r["task"], []).append(r)
    out = []
    for i, own in subtrees.items():
        own.sort(key=lambda r: r["id"])
        sub = Tree()
        for r in own:
            n = sub.add(r["prediction"], r["impurity"], r["gain"])
            sub.feature[n], sub.threshold[n], sub.bin[n], sub.left[n], sub.right[n] = r["feature"], r["threshold"], r["bin"], r["lhs"], r["rhs"]
            if r["categories"] is not None:
                sub.categories[n], sub.arity[n] = tuple(r["categories"]), meta.arity[r["feature"]]
        task = ordered[i]
        trees[task.tree].graft(task.node, sub)
        out.append((task.tree, task.node, task.rows, task.impurity, own[0]["seconds"]))
    return out

"""Packing of local training tasks into balanced bins, and the memory rule for what is trained locally."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from coppice.operators.metadata import Metadata

#: (rows, impurity) -> predicted time
TimePrediction = Callable[[float, float], float]


def by_rows(rows: float, impurity: float) -> float:
    return rows


@dataclass(frozen=True)
class Task:
    """A node to finish in memory."""

    tree: int
    node: int
    rows: float
    impurity: float
    depth: int = 0


@dataclass
class Bin:
    capacity: float
    most_tasks: int
    tasks: list[Task] = field(default_factory=list)
    rows: float = 0

    def fit(self, task: Task) -> bool:
        if self.rows + task.rows > self.capacity or len(self.tasks) >= self.most_tasks:
            return False
        self.tasks.append(task)
        self.rows += task.rows
        return True


def pack(tasks: Iterable[Task], capacity: float, most_tasks: int = 1 << 31, time: TimePrediction = by_rows) -> list[Bin]:
    """First fit by falling rows; the bins by falling predicted time. A task larger than a bin is an error.

    A tree of the largest room below each of its nodes leads to the first bin that fits.
    """
    ordered = sorted(tasks, key=lambda t: -t.rows)
    leaves = 1
    while leaves < len(ordered):
        leaves *= 2
    room = [float(capacity)] * (2 * leaves)
    bins: list[Bin] = []
    for task in ordered:
        if task.rows > capacity or most_tasks < 1:
            raise ValueError(f"a task of {task.rows} rows doesn't fit a bin of {capacity} rows and {most_tasks} tasks")
        at = 1
        while at < leaves:
            at = 2 * at + (room[2 * at] < task.rows)
        if at - leaves == len(bins):
            bins.append(Bin(capacity, most_tasks))
        own = bins[at - leaves]
        own.fit(task)
        room[at] = own.capacity - own.rows if len(own.tasks) < most_tasks else -1.0
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return sorted(bins, key=lambda b: -sum(time(t.rows, t.impurity) for t in b.tasks))


def node_bytes(meta: Metadata, features: int | None = None) -> int:
    """Size of one node's histogram."""
    return 8 * meta.stats * sum(sorted((meta.bins(f) for f in range(meta.num_features)), reverse=True)[: features or meta.num_features])


def local_rows(executor_bytes: int, cores: int, meta: Metadata, multiplier: float = 4) -> int:
    """Rows below which a node is finished in memory: what a core's share of memory holds beside one histogram."""
    each = multiplier * 8 * (meta.num_features + meta.num_trees + 1)
    return max(0, int((executor_bytes / cores - node_bytes(meta)) / each))


def memory_bytes(text: str) -> int:
    """Spark's sizes: 512m, 4g, ..."""
    t = str(text).strip().lower().removesuffix("b")
    scale = {"k": 10, "m": 20, "g": 30, "t": 40}
    return int(float(t[:-1]) * (1 << scale[t[-1]])) if t and t[-1] in scale else int(t)


#: The settings that say what lies outside an executor's heap, where Python workers hold a local task's rows.
PYTHON_MEMORY = ("spark.executor.pyspark.memory", "spark.executor.memoryOverhead", "spark.executor.memoryOverheadFactor", "spark.executor.memory")


def python_bytes(conf: dict[str, str | None], otherwise: int) -> int:
    """Bytes that an executor's Python workers share: their own setting, else the overhead beside the heap (by its default rule,
    where only the heap is set), else ``otherwise``. Plain numbers are MiB, as in these settings."""
    own, overhead, factor, heap = (conf.get(k) for k in PYTHON_MEMORY)
    sized = lambda v: int(v) << 20 if str(v).isdigit() else memory_bytes(v)
    if own or overhead:
        return sized(own or overhead)
    if heap:
        return max(384 << 20, int(memory_bytes(heap) * float(factor or 0.1)))
    return otherwise


@dataclass
class Bins:
    """``times`` bins in a row that are alike; in ``places``, (rows of a task, first rank, tasks a bin) of the tasks they hold."""

    times: int
    rows: int = 0
    tasks: int = 0
    places: list[tuple[int, int, int]] = field(default_factory=list)

    def cut(self, at: int) -> tuple[Bins, Bins]:
        """The first ``at`` bins and the others."""
        later = [(n, first + at * each, each) for n, first, each in self.places]
        return Bins(at, self.rows, self.tasks, list(self.places)), Bins(self.times - at, self.rows, self.tasks, later)

    def add(self, n: int, first: int, each: int) -> None:
        self.places.append((n, first, each))
        self.rows += n * each
        self.tasks += each


def pack_counts(counts: dict[int, int], capacity: int, most_tasks: int = 1 << 31) -> list[tuple[int, int, int, int, int]]:
    """``pack`` of ``counts[n]`` tasks of n rows each, without a row a task: (n, first rank, end rank, tasks a bin, first bin).

    A task of n rows and of a rank among its equals is in bin ``first bin + (rank - first rank) // tasks a bin``.
    """
    bins: list[Bins] = []
    opened = 0  # all before are full
    for n in sorted(counts, reverse=True):
        if n > capacity or most_tasks < 1:
            raise ValueError(f"a task of {n} rows doesn't fit a bin of {capacity} rows and {most_tasks} tasks")
        left, first, at = counts[n], 0, opened
        while left:
            if at == len(bins):
                fit = min(capacity // n, most_tasks) if n else most_tasks
                bins.append(Bins(-(-left // fit)))
            b = bins[at]
            fit = min((capacity - b.rows) // n if n else most_tasks, most_tasks - b.tasks)
            if fit:
                whole = min(left // fit, b.times)
                parts = [x for x in b.cut(whole) if x.times]
                if whole:
                    parts[0].add(n, first, fit)
                elif len(parts) and parts[-1].times > 1:
                    parts = [*parts[-1].cut(1)]
                if whole and whole < b.times and left > whole * fit:
                    parts[1:] = [x for x in parts[1].cut(1) if x.times]
                first, left = first + whole * fit, left - whole * fit
                if left and whole < b.times:  # the rest goes into one more bin
                    parts[1 if whole else 0].add(n, first, left)
                    left = 0
                bins[at : at + 1] = parts
                at += len(parts) - 1
            at += 1
        while opened < len(bins) and bins[opened].tasks == most_tasks:
            opened += 1
    out, number = [], 0
    for b in sorted(bins, key=lambda b: -b.rows):
        out += [(n, first, first + each * b.times, each, number) for n, first, each in b.places]
        number += b.times
    return out

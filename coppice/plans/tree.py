"""A decision tree as flat arrays, grown on the driver and walked by array operations on the executors."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Node 0 is the root. ``feature`` is -1 at a leaf; ``bin`` is the last bin that goes left, for training rows."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    categories: list[tuple[int, ...] | None] = field(default_factory=list)
    arity: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    prediction: list[float] = field(default_factory=list)
    impurity: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, prediction: float, impurity: float, gain: float = 0.0) -> int:
        """Appends a leaf."""
        for values, value in zip(self._columns(), (-1, 0.0, -1, None, 0, -1, -1, prediction, impurity, gain)):
            values.append(value)
        return len(self.feature) - 1

    def _columns(self) -> tuple[list, ...]:
        return (self.feature, self.threshold, self.bin, self.categories, self.arity, self.left, self.right, self.prediction, self.impurity, self.gain)

    def __len__(self) -> int:
        return len(self.feature)

    def is_leaf(self, node: int) -> bool:
        return self.feature[node] < 0

    def children(self, node: int) -> tuple[int, ...]:
        return () if self.is_leaf(node) else (self.left[node], self.right[node])

    def preorder(self, node: int = 0) -> list[int]:
        out, stack = [], [node]
        while stack:
            at = stack.pop()
            out.append(at)
            stack.extend(reversed(self.children(at)))
        return out

    def depth(self, node: int = 0) -> int:
        deepest, stack = 0, [(node, 0)]
        while stack:
            at, level = stack.pop()
            deepest = max(deepest, level)
            stack.extend((c, level + 1) for c in self.children(at))
        return deepest

    def num_descendants(self, node: int = 0) -> int:
        return len(self.preorder(node)) - 1

    def max_feature(self) -> int:
        """Largest feature index in use, -1 without a split."""
        return max(self.feature, default=-1)

    def graft(self, node: int, other: Tree) -> None:
        """Puts another tree in a leaf's place."""
        base = len(self) - 1  # other's root becomes the leaf itself
        move = lambda i: node if i == 0 else base + i
        for own, new in zip(self._columns(), other._columns()):
            own.extend(new[1:])
            own[node] = new[0]
        for i in (node, *range(base + 1, len(self))):
            if self.feature[i] >= 0:
                self.left[i], self.right[i] = move(self.left[i]), move(self.right[i])

    def pruned(self) -> Tree:
        """Sibling leaves of equal prediction become one leaf (with the parent's impurity), from the bottom up; the
        result is numbered in pre-order."""
        joined: dict[int, float] = {}
        for node in reversed(self.preorder()):
            kids = self.children(node)
            if kids and all(self.is_leaf(k) or k in joined for k in kids):
                a, b = (joined.get(k, self.prediction[k]) for k in kids)
                if a == b:
                    joined[node] = a
        return self._copied(joined)

    def _copied(self, leaves: dict[int, float]) -> Tree:
        out = Tree()
        stack = [(0, -1, False)]
        while stack:
            node, parent, is_right = stack.pop()
            new = out.add(leaves.get(node, self.prediction[node]), self.impurity[node], self.gain[node])
            if parent >= 0:
                (out.right if is_right else out.left)[parent] = new
            if self.is_leaf(node) or node in leaves:
                out.gain[new] = 0.0
                continue
            out.feature[new], out.threshold[new], out.bin[new] = self.feature[node], self.threshold[node], self.bin[node]
            out.categories[new], out.arity[new] = self.categories[node], self.arity[node]
            stack += [(self.right[node], new, True), (self.left[node], new, False)]
        return out

    def copy(self) -> Tree:
        """Numbered in pre-order."""
        return self._copied({})

    def flat(self) -> Flat:
        return Flat(self)

    def same(self, other: Tree) -> bool:
        """Equal predictions, impurities and splits, node by node."""
        a, b = self.copy(), other.copy()
        return (
            a.feature == b.feature
            and a.left == b.left
            and a.right == b.right
            and [sorted(c) if c is not None else None for c in a.categories] == [sorted(c) if c is not None else None for c in b.categories]
            and all(np.allclose(x, y, rtol=1e-9, atol=1e-12) for x, y in ((a.threshold, b.threshold), (a.prediction, b.prediction), (a.impurity, b.impurity)))
        )

    def describe(self, node: int = 0) -> str:
        """The tree as indented conditions."""
        lines, stack = [], [(node, 0, "")]
        while stack:
            at, indent, text = stack.pop()
            pad = " " * indent
            if text:
                lines.append(pad[:-1] + text)
            if self.is_leaf(at):
                lines.append(f"{pad}Predict: {self.prediction[at]}")
                continue
            f = self.feature[at]
            if self.categories[at] is None:
                yes, no = f"If (feature {f} <= {self.threshold[at]})", f"Else (feature {f} > {self.threshold[at]})"
            else:
                own = ",".join(map(str, sorted(self.categories[at])))
                yes, no = f"If (feature {f} in {{{own}}})", f"Else (feature {f} not in {{{own}}})"
            stack += [(self.right[at], indent + 1, no), (self.left[at], indent + 1, yes)]
        return "\n".join(lines)


class Flat:
    """Arrays of a tree for walking many rows at once, however deep it is."""

    def __init__(self, tree: Tree) -> None:
        self.feature = np.array(tree.feature, np.int64)
        self.threshold = np.array(tree.threshold, np.float64)
        self.bin = np.array(tree.bin, np.int64)
        self.left, self.right = np.array(tree.left, np.int64), np.array(tree.right, np.int64)
        self.prediction = np.array(tree.prediction, np.float64)
        self.table = np.full(len(tree), -1, np.int64)
        held = [i for i, c in enumerate(tree.categories) if c is not None]
        self.table[held] = np.arange(len(held))
        width = max([tree.arity[i] for i in held], default=1)
        self.goes_left = np.zeros((len(held), width), bool)
        for k, i in enumerate(held):
            self.goes_left[k, list(tree.categories[i])] = True

    def leaves(self, rows: np.ndarray, binned: bool = False, start: np.ndarray | None = None) -> np.ndarray:
        """Leaf of each row (rows x features), from ``start`` or the root."""
        node = np.zeros(len(rows), np.int64) if start is None else start.astype(np.int64).copy()
        going = np.flatnonzero(self.feature[node] >= 0)
        bound = self.bin if binned else self.threshold
        while len(going):
            at = node[going]
            value = rows[going, self.feature[at]]
            table = self.table[at]
            left = value <= bound[at]
            by_set = table >= 0
            if by_set.any():
                left[by_set] = self.goes_left[table[by_set], value[by_set].astype(np.int64)]
            node[going] = np.where(left, self.left[at], self.right[at])
            going = going[self.feature[node[going]] >= 0]
        return node

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return self.prediction[self.leaves(rows)]

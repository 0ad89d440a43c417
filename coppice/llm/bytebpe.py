"""Byte-level BPE ids of many texts at once.

Texts are cut into pre-tokens with array operations over code points, each pre-token is looked up in a hash table of
those seen before, and only new ones are merged. A hit is taken only if the code points agree as well, so two pre-tokens
of one hash are told apart. The result is that of the tokenizer file itself, special strings inside texts included;
tests compare the two.

Memory is bounded whatever the texts: the table holds ``KEPT`` pre-tokens of ``KEPT_POINTS`` code points in all (longer
ones than ``LONG`` are merged where they stand and never kept), and a long text goes through in parts of ``PART`` code
points, cut where a blank follows another sign, which no pre-token spans.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
import tiktoken

from coppice.llm.common import caches, mix64, ranges

OTHER, LETTER, NUMBER, SPACE, END = 0, 1, 2, 3, 4
_END = 0x110000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Pre-tokens kept by a worker, and their code points and ids in all; beyond that, the table starts anew.
KEPT, KEPT_POINTS = 1 << 18, 1 << 22
#: Code points of the longest pre-token that is kept, and of the parts of long texts.
LONG, PART = 256, 1 << 20
_BREAK = regex.compile(r"(?<=\S)\s")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    out = np.zeros(_END + 1, np.uint8)
    every = np.append(np.arange(0xD800), np.arange(0xE000, _END)).astype("<u4").tobytes().decode("utf-32-le")  # a string a sign would be 100 MB
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            out[ord(every[a]) : ord(every[b - 1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[_END] = END
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = 0x5851F42D4C957F2D
    inverse = pow(r, -1, 1 << 64)
    up, down = np.full(n, r, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def boundaries(points: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the byte-level pattern; texts in ``points`` end with the mark 0x110000."""
    kind = classes()[points]
    n = len(points)
    cut = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    space = kind == SPACE
    blank = points == 32
    follows = np.zeros(n, bool)  # last white space before something of the same text
    follows[:-1] = space[:-1] & ~space[1:] & (kind[1:] != END)
    cut |= follows
    cut[1:] &= ~(follows[:-1] & blank[:-1])
    quote = np.flatnonzero(points[:-1] == 39)
    if len(quote):
        quote = quote[cut[quote]]  # first of its run and not after a blank
        pad = np.concatenate([points, np.full(3, _END, points.dtype)])
        b, c = pad[quote + 1], pad[quote + 2]
        one = (b == 115) | (b == 116) | (b == 109) | (b == 100)
        two = ((b == 114) & (c == 101)) | ((b == 118) & (c == 101)) | ((b == 108) & (c == 108))
        cut[quote[one | two] + 1] = False
        ends = np.concatenate([quote[one] + 2, quote[two] + 3])
        cut[ends[ends < n]] = True
    return np.flatnonzero(cut)


class ByteBpe:
    """One per worker process; ``path`` is the tokenizer's .json file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.special = special
        self.cutter = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        coder = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.piece = coder._core_bpe.encode_single_piece
        self.up, self.down = _powers(1 << 16)
        self._reset()

    def _reset(self) -> None:
        self.slots = 2 * KEPT
        self.keys = np.zeros(self.slots, np.uint64)
        self.where = np.zeros(self.slots, np.int32)
        self.used = 0
        self.first = np.zeros(KEPT + 1, np.int64)  # ids of entry i: first[i] : first[i + 1]
        self.ids = np.zeros(1 << 16, np.uint32)
        self.spelt = np.zeros(KEPT + 1, np.int64)  # code points of entry i: spelt[i] : spelt[i + 1]
        self.points = np.zeros(1 << 16, np.uint32)

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        mask = np.uint64(self.slots - 1)
        at = (keys & mask).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == keys, self.where[at], -1)
        todo = np.flatnonzero((found != keys) & (found != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(mask)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.where[at[todo[hit]]]
            todo = todo[~hit & (found != 0)]
        return out

    def _insert(self, keys: np.ndarray, own: list[list[int]], points: np.ndarray, sizes: np.ndarray) -> None:
        """New and different keys with their ids and code points."""
        n, mask = len(keys), self.slots - 1
        at, todo = (keys & np.uint64(mask)).astype(np.int64), np.arange(n)
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.where[at[won]] = self.used + won
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & mask
        flat = np.fromiter(chain.from_iterable(own), np.uint32)
        self.ids = self._append(self.ids, self.first, flat, np.array([len(x) for x in own]))
        self.points = self._append(self.points, self.spelt, points, sizes)
        self.used += n

    def _append(self, store: np.ndarray, bounds: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        a = int(bounds[self.used])
        if a + len(flat) > len(store):
            store = np.concatenate([store, np.zeros(max(len(flat), len(store)), np.uint32)])
        store[a : a + len(flat)] = flat
        bounds[self.used + 1 : self.used + len(sizes) + 1] = a + np.cumsum(sizes)
        return store

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        pieces, owner, marks = [], [], []
        for i, t in enumerate(texts):
            if self.special and any(s in t for s in self.special):
                for part in self.cutter.split(t):
                    if part in self.special:
                        pieces.append("")
                        marks.append(self.special[part])
                        owner.append(i)
                    else:
                        for own in parts(part):
                            pieces.append(own)
                            marks.append(-1)
                            owner.append(i)
            else:
                for own in parts(t):
                    pieces.append(own)
                    marks.append(-1)
                    owner.append(i)
        ids, counts = self._in_turn(pieces)
        marks = np.array(marks, np.int64)
        owner = np.array(owner, np.int64)
        if (marks >= 0).any():
            at = np.cumsum(counts)[marks >= 0]
            ids = np.insert(ids, at, marks[marks >= 0].astype(np.uint32))
            counts = counts + (marks >= 0)
        return ids, np.bincount(owner, counts, minlength=len(texts)).astype(np.int64)

    def _in_turn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ordinary``, of at most about 2 PART code points at a time."""
        ids, counts, a, size = [], [], 0, 0
        for z, piece in enumerate(pieces, 1):
            size += len(piece)
            if size >= PART or z == len(pieces):
                own = self._ordinary(pieces[a:z])
                ids.append(own[0])
                counts.append(own[1])
                a, size = z, 0
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return (ids[0], counts[0]) if len(ids) == 1 else (np.concatenate(ids), np.concatenate(counts))

    def _known(self, keys: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each pre-token or -1, which have another's hash): a hit must be spelt alike."""
        entry = self._probe(keys)
        other = np.zeros(len(keys), bool)
        hit = np.flatnonzero(entry >= 0)
        kept = self.spelt[entry[hit] + 1] - self.spelt[entry[hit]]
        other[hit[kept != size[hit]]] = True
        hit = hit[kept == size[hit]]
        if len(hit):
            n = size[hit]
            unlike = points[ranges(start[hit], n)] != self.points[ranges(self.spelt[entry[hit]], n)]
            if unlike.any():
                other[hit[np.logical_or.reduceat(unlike, np.cumsum(n) - n)]] = True
        entry[other] = -1
        return entry, other

    def _ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1)
        points = np.full(int(ends[-1]) if len(ends) else 0, _END, np.uint32)
        inside = np.ones(len(points), bool)
        inside[ends - 1] = False
        points[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = boundaries(points)
        stop = np.append(start[1:], len(points))
        real = points[start] != _END
        start, stop = start[real], stop[real]
        size = stop - start
        if len(self.up) <= len(points):
            self.up, self.down = _powers(2 * len(points))
        value = (points.astype(np.uint64) + np.uint64(1)) * _STEP
        value ^= value >> np.uint64(29)
        value *= self.up[: len(points)]
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        keys = mix64((sums[stop] - sums[start]) * self.down[start] + size.astype(np.uint64) * _STEP)
        keys[keys == 0] = 1
        entry, other = self._known(keys, points, start, size)
        missing = np.flatnonzero((entry < 0) & ~other & (size <= LONG))
        if len(missing):
            _, one = np.unique(keys[missing], return_index=True)
            new = missing[one]
            if self.used + len(new) > KEPT or self.spelt[self.used] + size[new].sum() > KEPT_POINTS:
                self._reset()
                entry[:], other[:] = -1, False
                short = np.flatnonzero(size <= LONG)
                _, one = np.unique(keys[short], return_index=True)
                new = short[one]
                fits = (np.arange(1, len(new) + 1) <= KEPT) & (np.cumsum(size[new]) <= KEPT_POINTS)  # the rest is merged where it stands
                new = new[fits]
            spelt = points[ranges(start[new], size[new])]
            self._insert(keys[new], self._merged(spelt, size[new]), spelt, size[new])
            entry, _ = self._known(keys, points, start, size)
        alone = np.flatnonzero(entry < 0)
        first, length = self.first[np.maximum(entry, 0)], self.first[np.maximum(entry, 0) + 1] - self.first[np.maximum(entry, 0)]
        if len(alone):
            merged = self._merged(points[ranges(start[alone], size[alone])], size[alone])
            length[alone] = [len(x) for x in merged]
            ids = np.empty(int(length.sum()), np.uint32)
            at = np.cumsum(length) - length
            ids[ranges(at[alone], length[alone])] = np.fromiter(chain.from_iterable(merged), np.uint32)
            kept = np.flatnonzero(entry >= 0)
            ids[ranges(at[kept], length[kept])] = self.ids[ranges(first[kept], length[kept])]
        else:
            ids = self.ids[ranges(first, length)]
        owner = np.searchsorted(ends, start, side="right")
        return ids, np.bincount(owner, length, minlength=len(texts)).astype(np.int64)

    def _merged(self, points: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """Ids of pre-tokens, each merged on its own."""
        whole = points.tobytes().decode("utf-32-le", "surrogatepass")
        at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        piece = self.piece
        return [piece(whole[a:b].encode()) for a, b in zip(at, at[1:])]


def parts(text: str):
    """A text in parts of PART code points or more, each of which starts at a blank after another sign."""
    at = 0
    while len(text) - at > PART:
        found = _BREAK.search(text, at + PART)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


_loaded: dict[str, ByteBpe] = {}
caches.append(_loaded.clear)


def coder(path: str) -> ByteBpe:
    """The worker's own coder for this file, until a task of another operator runs there."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]

"""Removal of repeated byte strings with longest-previous-factor arrays.

A byte goes if it lies in a string of ``length`` (100) bytes that also starts earlier: in a document of smaller id, or
earlier in the same one. Every such window belongs to the anchor that is the least hash of its ``length // 3``-byte
substrings, so equal windows have equal anchors wherever they stand. The work runs over groups of documents (by digest
of the key, a few MB each) and over shards of anchors:

1. each group lists its anchors; 2. shards of anchors find those that occur twice or more; 3. each group sends the
segments (runs of windows of one anchor) of these anchors to the anchor's shard, equal segments once, and reports its
own later copies; 4. a shard sorts the windows of its different segments into suffix order, finds for each the nearest
ones before and after it in that order which stand earlier in the text (previous and next smaller positions), and so the
length of its longest previous factor, counted up to ``length``; windows whose factor has the whole ``length`` go back
to their groups as matches; 5. each group removes what its intervals cover.

Where copies are dropped before that, in 3 and 4, their bytes have been compared: hashes only choose what to compare.
The texts are shuffled once; steps 1, 3 and 5 read the same exchange. There are eight times as many shards as
partitions, so that a shard's bytes stay a small part of a task's.

Of an anchor of more than ``HOT`` segments (the edges of a passage that a third of the documents share), windows go to
all shards by their digests (BLAKE2b, 128 bits) instead of the bytes around them, one row a group and window: there the
digest stands for the window, and the factors are found over digests in the same way. This is the one place where 128
bits are taken for 100 bytes; it bounds every shard, and an error is as likely as a collision of BLAKE2b.

Defined cases: a null text is the empty text; texts of any length are taken whole (one at a time in a task); rows of one
id are ordered by a digest of the text, and equal rows are one document of which each row gets the result; null ids come
last, behind the largest id; other columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import LAST_ID, mix64, partitions, ranges, release, text_buffers

LENGTH, HOT = 100, 50_000
BLOCK = 1 << 17
#: Bits of a position within a block.
PLACE = 18
#: Shards of segments are 2^SPREAD times the partitions.
SPREAD = 3
#: Bytes compared together; rounds of pointer jumping before a plain walk takes over.
COMPARED, ROUNDS = 1 << 20, 64
#: Bytes are hashed as these random odd numbers.
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_R = 0x5851F42D4C957F2D
_RINV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP, _DOWN = _powers(_R, 2 * BLOCK + (1 << 16)), _powers(_RINV, 2 * BLOCK + (1 << 16))


@dataclass
class Runs:
    """Runs of consecutive windows of one anchor: positions in the concatenated texts; ``times``: 2 if the anchor occurs
    again within the run, else 1."""

    anchor: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    times: np.ndarray


def sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _UP[: len(raw)], out=out[1:])
    return out


def spans(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of raw[start:stop] from the running sums."""
    return mix64((total[stop] - total[start]) * _DOWN[start] + (stop - start).astype(np.uint64))


def runs(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> Runs:
    """All windows' runs of the texts at offsets ``at``; blocks bound the memory, and a run may end at a block's end."""
    k = max(1, length // 3)
    width = length - k + 1
    out: list[tuple[np.ndarray, ...]] = []
    low = np.uint64((1 << PLACE) - 1)
    for b in range(0, len(raw), BLOCK):
        part = raw[b : b + BLOCK + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        total = sums(part)
        grams = len(part) - k + 1
        h = mix64((total[k:] - total[:grams]) * _DOWN[:grams])
        m = (h & ~low) | np.arange(grams, dtype=np.uint64)  # the leftmost of the least
        reach = 1
        while 2 * reach <= width:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if reach < width:
            m = np.minimum(m[:n], m[width - reach : width - reach + n])
        place = (m & low).astype(np.int64)
        m = h[place]
        edge = np.zeros(n + 1, np.int32)
        a = int(np.searchsorted(at, b, side="right")) - 1
        z = min(int(np.searchsorted(at, b + n)), len(at) - 1)
        begins, ends = at[a:z], at[a + 1 : z + 1]
        np.add.at(edge, np.clip(np.maximum(ends - length + 1, begins) - b, 0, n), 1)
        np.add.at(edge, np.clip(ends - b, 0, n), -1)
        valid = np.cumsum(edge[:n]) == 0
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (m[1:n] != m[: n - 1])
        stop = first.copy()
        stop[1:] |= ~valid[1:] & valid[:-1]
        marks = np.append(np.flatnonzero(stop), n)
        is_start = first[marks[:-1]]
        start = marks[:-1][is_start]
        windows = (marks[1:] - marks[:-1])[is_start]
        moved = np.zeros(n + 1, np.int64)
        np.cumsum(place[1:] != place[:-1], out=moved[2:])
        times = 1 + (moved[start + windows] > moved[start + 1])
        out.append((mix64(m[start]), start + b, windows, times))  # least hashes are small; mixed, they spread evenly
    if not out:
        empty = np.zeros(0, np.int64)
        return Runs(empty.astype(np.uint64), empty, empty, empty)
    return Runs(*(np.concatenate(x) for x in zip(*out)))


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as a number that sorts like them."""
    pad = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.zeros(len(raw), np.uint64)
    for j in range(8):
        out |= pad[j : j + len(raw)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _equal_bytes(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Leading equal bytes of different numbers of ``width`` bytes."""
    differ = x ^ y
    out = np.full(len(x), width - 1, np.int32)
    for j in range(1, width):
        out -= differ >= np.uint64(1 << 8 * j)
    return out


def suffix_order(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order of ``starts`` as far as ``length`` bytes, ties in the given order; common bytes of each with the one before it there)."""
    word = _words(raw)
    width = min(8, length)
    shift = np.uint64(64 - 8 * width)
    order = np.argsort(word[starts] >> shift, kind="stable")
    key = word[starts[order]] >> shift
    common = np.full(len(starts), length, np.int32)
    common[:1] = 0
    at = np.flatnonzero(key[1:] != key[:-1]) + 1
    common[at] = _equal_bytes(key[at], key[at - 1], width)
    for depth in range(8, length, 8):
        whole = common == length
        whole[:1] = False
        tied = np.flatnonzero(whole | np.append(whole[1:], False))
        if not len(tied):
            break
        width = min(8, length - depth)
        own = order[tied]
        key = word[starts[own] + depth] >> np.uint64(64 - 8 * width)
        group = np.cumsum(~whole[tied])
        by = np.lexsort((key, group))
        order[tied] = own[by]
        key = key[by]
        fresh = np.flatnonzero((key[1:] != key[:-1]) & (group[1:] == group[:-1])) + 1
        common[tied[fresh]] = depth + _equal_bytes(key[fresh], key[fresh - 1], width)
    return order, common


def nearest_smaller(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest earlier entry with a smaller ``place``, or -1; the least of ``common`` on the way to it).

    All entries jump at once over what is known to be larger; should a few have very far to go, a plain walk with a stack
    takes over.
    """
    n = len(place)
    to, least = np.arange(-1, n - 1), common.copy()
    going = np.arange(n)
    for _ in range(ROUNDS):
        going = going[to[going] >= 0]
        going = going[place[to[going]] > place[going]]
        if not len(going):
            return to, np.where(to >= 0, least, 0)
        via = to[going]
        nearer = np.minimum(least[going], least[via])  # read before any of them moves
        to[going], least[going] = to[via], nearer
    stack: list[int] = []
    values, shared = place.tolist(), common.tolist()
    for i in range(n):
        m = shared[i]
        while stack and values[stack[-1]] > values[i]:
            m = min(m, int(least[stack.pop()]))
        to[i], least[i] = (stack[-1], m) if stack else (-1, 0)
        stack.append(i)
    return to, least


def longest_previous(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The longest-previous-factor array of the windows at ``starts`` (in text order), counted up to ``length``: how many of a
    window's first bytes also stand at an earlier one.

    In a class of equal windows every one but the first has its predecessor as previous smaller position, at the whole
    length; the first ones find theirs, and the next smaller positions, among each other.
    """
    order, common = suffix_order(raw, starts, length)
    out = np.full(len(starts), length, np.int32)
    first = np.flatnonzero(common < length)
    place, shared = order[first], common[first]
    _, before = nearest_smaller(place, shared)
    behind = np.append(shared[1:], 0)[::-1]
    _, after = nearest_smaller(place[::-1], behind)
    out[place] = np.maximum(before, after[::-1])
    return out


def copies(raw: np.ndarray, start: np.ndarray, size: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether each slice equals, byte by byte, the first one of its digest."""
    _, first, inverse = np.unique(digest, return_index=True, return_inverse=True)
    model = first[inverse.ravel()]
    out = np.zeros(len(start), bool)
    alike = np.flatnonzero((model != np.arange(len(start))) & (size[model] == size))
    ends = np.cumsum(size[alike])
    low = 0
    while low < len(alike):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COMPARED)))
        own = alike[low:high]
        n = size[own]
        same = raw[ranges(start[own], n)] == raw[ranges(start[model[own]], n)]
        out[own] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        low = high
    return out


def intervals(starts: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges windows at consecutive starts of an owner: (owner, from, to)."""
    if not len(starts):
        return owner, starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return owner[first], starts[first], starts[last] + length


@dataclass
class Group:
    """The different documents of a group in order, concatenated; ``row`` gives the document of each row."""

    k: np.ndarray
    h: np.ndarray
    raw: np.ndarray
    at: np.ndarray
    row: np.ndarray


def gathered(table: pa.Table) -> Group:
    k, h = (table.column(c).to_numpy().astype(np.int64) for c in ("k", "h"))
    order = np.lexsort((h, k))
    new = np.ones(len(k), bool)
    new[1:] = (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])
    row = np.empty(len(k), np.int64)
    row[order] = np.cumsum(new) - 1
    first = order[new]
    text = table.column("text").combine_chunks()
    raw, at = text_buffers(text)
    sizes = np.diff(at)[first]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.concatenate([raw[at[i] : at[i + 1]] for i in first.tolist()]) if len(first) else raw
    return Group(k[first], h[first], joined, ends, row)


ANCHORS = "shard int, p int, anchors binary, counts binary"
KNOWN = "p int, anchors binary, hot binary"
SENT = "kind int, idx int, p int, docs binary, parts binary, data binary"
FOUND = "p int, parts binary"


def _blob(array: np.ndarray, kind=np.int64) -> bytes:
    return np.ascontiguousarray(array, dtype=kind).tobytes()


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _list_anchors(bits: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        group = gathered(table)
        p = table.column("p")[0].as_py()
        found = runs(group.raw, group.at, length)
        anchor, inverse = np.unique(found.anchor, return_inverse=True)
        count = np.bincount(inverse, found.times, minlength=len(anchor)).astype(np.int64)
        cut = np.searchsorted(anchor >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(anchor)])
        count = np.minimum(count, 0xFFFF)
        return _table([(s, p, _blob(anchor[a:z], np.uint64), _blob(count[a:z], np.uint16)) for s, (a, z) in enumerate(zip(cut, cut[1:])) if z > a], ANCHORS)

    return run


def _known_anchors(hot: int):
    def run(table: pa.Table) -> pa.Table:
        p = table.column("p").to_numpy()
        anchors = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("anchors")]
        anchor = np.concatenate(anchors)
        count = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("counts")]).astype(np.int64)
        owner = np.repeat(np.arange(len(p)), [len(x) for x in anchors])
        order = np.argsort(anchor, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = anchor[order][1:] != anchor[order][:-1]
        total = np.empty(len(order), np.int64)
        total[order] = np.add.reduceat(count[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        rows = []
        for i in range(len(p)):
            own = (owner == i) if len(p) < 8 else slice(*np.searchsorted(owner, [i, i + 1]))
            a, t = anchor[own], total[own]
            if (t > 1).any():
                rows.append((int(p[i]), _blob(a[t > 1], np.uint64), _blob(t[t > 1] > hot, np.uint8)))
        return _table(rows, KNOWN)

    return run


def _send_segments(bits: int, length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], SENT)
        p = left.column("p")[0].as_py()
        group = gathered(left)
        known = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in right.column("anchors")])
        hot = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in right.column("hot")]).astype(bool)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        r = runs(group.raw, group.at, length)
        place = np.minimum(np.searchsorted(known, r.anchor), len(known) - 1)
        chosen = known[place] == r.anchor
        anchor, start, windows, is_hot = r.anchor[chosen], r.start[chosen], r.windows[chosen], hot[place[chosen]]
        doc = np.searchsorted(group.at, start, side="right") - 1
        rows = []
        plain = np.flatnonzero(~is_hot)
        size = windows[plain] + length - 1
        copy = copies(group.raw, start[plain], size, _digests(group.raw, start[plain], size))
        later = plain[copy]
        echo = [(doc[later], start[later] - group.at[doc[later]], start[later] - group.at[doc[later]] + size[copy])]
        sent = plain[~copy]
        shard = (anchor[sent] >> np.uint64(8)).astype(np.int64) & ((1 << bits) - 1)
        for s in np.unique(shard).tolist():
            own = sent[shard == s]
            rows.append(_segments(0, s, p, group, start[own], windows[own] + length - 1, doc[own]))
        if is_hot.any():
            chosen = np.flatnonzero(is_hot)
            at = ranges(start[chosen], windows[chosen])
            d = np.repeat(doc[chosen], windows[chosen])
            digests = np.array([hashlib.blake2b(group.raw[a : a + length].tobytes(), digest_size=16).digest() for a in at.tolist()], "S16").view(np.uint64).reshape(-1, 2) if len(at) else np.zeros((0, 2), np.uint64)
            _, first, inverse = np.unique(digests, axis=0, return_index=True, return_inverse=True)
            copy = first[inverse.ravel()] != np.arange(len(at))
            owner, a, z = intervals((at - group.at[d])[copy], d[copy], length)
            echo.append((owner, a, z))
            at, d, digests = at[~copy], d[~copy], digests[~copy]
            shard = (digests[:, 0] >> np.uint64(8)).astype(np.int64) & ((1 << bits) - 1)
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                names, local = np.unique(d[own], return_inverse=True)
                docs = np.stack([names, group.k[names], group.h[names]], 1)
                parts = np.stack([local, at[own] - group.at[d[own]]], 1)
                rows.append((2, s, p, _blob(docs), _blob(parts), _blob(digests[own], np.uint64)))
        own = [np.concatenate(x) for x in zip(*echo)]
        if len(own[0]):
            rows.append((1, p, p, b"", _blob(np.stack(own, 1)), b""))
        return _table(rows, SENT)

    return run


def _digests(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices, block by block."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        base = int(start[low])
        high = max(low + 1, int(np.searchsorted(start, base + BLOCK)))
        stop = int((start[low:high] + size[low:high]).max())
        total = sums(raw[base:stop])
        out[low:high] = spans(total, start[low:high] - base, start[low:high] - base + size[low:high])
        low = high
    return out


def _segments(kind: int, idx: int, p: int, group: Group, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple:
    names, local = np.unique(doc, return_inverse=True)
    docs = np.stack([names, group.k[names], group.h[names]], 1)
    parts = np.stack([local, start - group.at[doc], size], 1)
    return kind, idx, p, _blob(docs), _blob(parts), group.raw[ranges(start, size)].tobytes()


def _match(length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        if kind == 1:
            return table.select(["p", "parts"])
        width = 3 if kind == 0 else 2
        p, doc, k, h, parts, data = [], [], [], [], [], []
        for i in range(table.num_rows):
            docs = np.frombuffer(table.column("docs")[i].as_py(), np.int64).reshape(-1, 3)
            own = np.frombuffer(table.column("parts")[i].as_py(), np.int64).reshape(-1, width)
            p.append(np.full(len(own), table.column("p")[i].as_py()))
            for to, c in ((doc, 0), (k, 1), (h, 2)):
                to.append(docs[own[:, 0], c])
            parts.append(own[:, 1:])
            data.append(np.frombuffer(table.column("data")[i].as_py(), np.uint8 if kind == 0 else np.uint64))
        p, doc, k, h, parts, data = (np.concatenate(x) for x in (p, doc, k, h, parts, data))
        order = np.lexsort((parts[:, 0], h, k))
        if kind == 2:
            digests = np.ascontiguousarray(data.reshape(-1, 2)[order]).view(np.uint8).ravel()
            p, doc, start = p[order], doc[order], parts[order, 0]
            again = np.flatnonzero(longest_previous(digests, np.arange(0, len(digests), 16), 16) == 16)
            return _replies(p[again], doc[again], start[again], start[again] + length)
        size = parts[:, 1]
        at = np.cumsum(size) - size
        copy = copies(data, at[order], size[order], _digests(data, at, size)[order])
        whole, rest = order[copy], order[~copy]
        lengths = size[rest]
        raw = data[ranges(at[rest], lengths)]
        base = np.cumsum(lengths) - lengths
        windows = lengths - length + 1
        starts = ranges(base, windows)
        segment = np.repeat(np.arange(len(rest)), windows)
        again = np.flatnonzero(longest_previous(raw, starts, length) == length)
        owner, a, z = intervals(starts[again], segment[again], length)
        shift = parts[rest, 0] - base
        return _replies(
            np.concatenate([p[whole], p[rest][owner]]),
            np.concatenate([doc[whole], doc[rest][owner]]),
            np.concatenate([parts[whole, 0], a + shift[owner]]),
            np.concatenate([parts[whole, 0] + size[whole], z + shift[owner]]),
        )

    return run


def _replies(p: np.ndarray, doc: np.ndarray, a: np.ndarray, z: np.ndarray) -> pa.Table:
    order = np.argsort(p, kind="stable")
    rows = np.stack([doc, a, z], 1)[order]
    names, first = np.unique(p[order], return_index=True)
    cut = np.append(first, len(order))
    return _table([(int(n), _blob(rows[s:e])) for n, s, e in zip(names, cut, cut[1:])], FOUND)


def counted(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set in each slice at[i]:at[i + 1]; no slice is widened to eight bytes a flag."""
    cut = at.tolist()
    return np.array([np.count_nonzero(flags[a:z]) for a, z in zip(cut, cut[1:])], np.int64)


def _finish(kept_columns: list[str], schema: T.StructType, as_text: bool):
    names = [f.name for f in schema]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = gathered(left)
        edge = np.zeros(len(group.raw) + 1, np.int32)
        for x in right.column("parts"):
            rows = np.frombuffer(x.as_py(), np.int64).reshape(-1, 3)
            np.add.at(edge, group.at[rows[:, 0]] + rows[:, 1], 1)
            np.add.at(edge, group.at[rows[:, 0]] + rows[:, 2], -1)
        np.cumsum(edge, dtype=np.int32, out=edge)
        gone = edge[:-1] > 0
        del edge
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        inner = group.at[:-1][np.diff(group.at) > 0]
        rises[inner] = gone[inner]
        removed, n_spans = counted(gone, group.at), counted(rises, group.at)
        del rises
        left_at = np.concatenate([[0], np.cumsum(np.diff(group.at) - removed)])
        left_raw = memoryview(group.raw[~gone])
        sizes, r = np.diff(group.at), group.row
        del gone, group
        cut = left_at.tolist()
        each = (left_raw[cut[i] : cut[i + 1]] for i in r.tolist())
        if as_text:
            kept = (str(x, "utf-8", "ignore") for x in each)
        else:
            kept = (hashlib.sha256(x).hexdigest() for x in each)
        columns = [left.column(c) for c in kept_columns]
        columns += [pa.array(sizes[r]), pa.array(removed[r]), pa.array(n_spans[r]), pa.array(kept, pa.string(), size=len(r))]
        return pa.table(columns, names=names)

    return run


def _freeing_keyed(run):
    """``run``, after which the worker gives its memory back; Spark tells functions apart by their arguments."""

    def outer(key, table):
        try:
            return run(key, table)
        finally:
            release()

    return outer


def _freeing_pair(run):
    def outer(left, right):
        try:
            return run(left, right)
        finally:
            release()

    return outer


def _freeing_one(run):
    def outer(table):
        try:
            return run(table)
        finally:
            release()

    return outer


def remove_repeats(df: DataFrame, length: int = LENGTH, hot: int = HOT, as_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df``'s other columns with n_bytes, n_removed, n_spans and kept: the remaining text (a character that lost a byte
    goes whole), or with ``as_text`` off the SHA-256 of the remaining bytes."""
    if not 3 <= length <= 1 << 16:
        raise ValueError("length must be between 3 and 65536")
    others = [f for f in df.schema if f.name != text]
    n = partitions(df)
    groups = 2 * n
    bits = max(0, (n - 1).bit_length())
    safe = [f"c{i}" for i in range(len(others))]
    own = df.select(
        F.col(f"`{doc_id}`").cast("long").isNull().alias("none"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID)).alias("k"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        *(F.col(f"`{f.name}`").alias(s) for f, s in zip(others, safe)),
    )
    digest = F.shiftrightunsigned(F.xxhash64("text"), 1)  # a null id comes behind the largest one
    own = own.withColumn("h", F.when(F.col("none"), digest).otherwise(digest + F.lit(-(1 << 63)))).drop("none").withColumn("p", F.pmod(F.xxhash64("k", "h"), F.lit(groups)).cast("int"))
    texts = own.repartition(n, "p")
    grouped = texts.groupBy("p")
    known = grouped.applyInArrow(_freeing_one(_list_anchors(bits, length)), ANCHORS).groupBy("shard").applyInArrow(_known_anchors(hot), KNOWN)
    sent = grouped.cogroup(known.groupBy("p")).applyInArrow(_freeing_pair(_send_segments(bits + SPREAD, length)), SENT)
    found = sent.groupBy("kind", "idx").applyInArrow(_freeing_keyed(_match(length)), FOUND)
    kept = T.StructType(
        [
            *(T.StructField(s, f.dataType) for s, f in zip(safe, others)),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    done = grouped.cogroup(found.groupBy("p")).applyInArrow(_freeing_pair(_finish(safe, kept, as_text)), kept)
    return done.select(*(F.col(s).alias(f.name) for s, f in zip(safe, others)), "n_bytes", "n_removed", "n_spans", "kept")


def repeat_report(df: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, hot, as_text=False)
    return out.withColumnRenamed("kept", "kept_sha256")

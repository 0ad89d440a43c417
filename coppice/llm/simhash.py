"""SimHash near-duplicates with pivot distance tables.

Rows with equal fingerprints (or equal sets of shingles) collapse to one first, however many documents share one. The
others are laid out in blocks, without which the table would have to be scanned for every row; a pair counts if it
meets in a block. Within a block, each fingerprint has a table row of its Hamming distances to the rows of a Hadamard
code as reference fingerprints; a pair whose coordinates differ by more than the radius anywhere can't be a link
(triangle inequality) and is discarded; survivors are verified.

* ``near_duplicates`` links fingerprints within a small radius and loses no link: 64 bits are cut into parts, and two
  fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` parts, so every link lies in a block of
  equal part values. A survivor is verified bit by bit, and a block gives a spanning forest of its links, never its pairs.
* ``similar_rows`` links sets of word shingles by their Jaccard similarity. Its blocks are bands of a longer print (the
  majority bits of the set's hashes under many mixings): at similarity ``least`` two sets agree in each bit with a known
  probability, and there are as many bands as it takes to meet in one with probability ``RECALL``; more similar pairs meet
  all but surely. Survivors of the table are verified by the exact similarity of the whole sets, first each row against
  the first of its block only, then all pairs that aren't connected yet, so that a large family of near copies isn't
  compared pair by pair.

Blocks of more than ``TILE`` rows are cut into tiles that are compared two by two in tasks of their own. Components come
from alternating large-star and small-star steps on the executors, stored each round.

Defined cases: a text without words has fingerprint zero (an empty set) and links like any other; null text as empty;
texts of any length are read whole; repeated rows are documents of one fingerprint; a null doc_id takes part and counts
as larger than any other; other columns, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import discard, join_with_hot_keys, mix64, partitions, picked, release, stored, text_buffers

SHINGLE, RADIUS = 4, 4
#: Of similar_rows: words of a shingle, least similarity, probability to meet a pair at just that similarity, and the radius on
#: the first 64 bits (such a pair differs there in 9.7 bits, +- 2.9).
WORDS, LEAST, RECALL, WIDE = 5, (4, 5), 0.95, 18
#: 64-bit parts of the longer print by which survivors are looked at before whole sets are sent, and the deviations allowed there.
PARTS, DEVIATIONS = 5, 4.5
#: Bits of a band: so many at least, or so many fewer than the rows' number has.
BAND_BITS, BAND_SHORT = 16, 2
TILE = 4096
#: Pairs looked at together.
STEP = 1 << 18
BUCKETS = 1 << 22
#: Crowded blocks whose keys are sent to all executors.
MOST_CROWDED = 1 << 18


def _pivots() -> np.ndarray:
    """The 64 rows of the Hadamard code of length 64 as reference fingerprints."""
    i, j = np.arange(64)[:, None], np.arange(64)[None, :]
    bit = np.bitwise_count((i & j).astype(np.uint64)) & 1
    return (bit.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


PIVOTS = _pivots()
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of all word shingles of a text in order, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 : shingle + n - 2].tolist(), len(line)] if n > 1 else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends)), np.uint64, n)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all word shingles, repeats included; 0 without words."""
    h = _hashes(text, shingle)
    total = np.zeros((8, 256), np.int64)
    for a in range(0, len(h), 1 << 16):
        cells = h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
        total += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
    ones = ((total @ _BITS).ravel() * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    return int(ones.sum(dtype=np.uint64))


def long_print(own: np.ndarray, words: int) -> np.ndarray:
    """64 x ``words`` majority bits of a set of hashes, each 64 of them under another mixing; ties fall to the first hash."""
    mixings = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total, first = np.zeros(64 * words, np.int64), np.zeros(64 * words, np.uint8)
    for a in range(0, len(own), 4096):
        h = mix64(own[a : a + 4096, None] ^ mixings[None, :])
        bits = np.unpackbits(h.view(np.uint8), axis=1)
        total += bits.sum(0, dtype=np.int64)
        first = bits[0] if a == 0 else first
    return 2 * total + first > len(own)


def fingerprinted(df: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (64 bits as long), stored."""
    docs = picked(df, doc_id=(doc_id, T.LongType()), text=(text, T.StringType()))

    def run(batches):
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            whole, at = raw.tobytes(), at.tolist()
            fps = np.array([simhash(whole[a:b], shingle) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])
        release()

    return stored(docs.mapInArrow(run, "doc_id long, fp long"))


def blocking(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(parts, parts that agree): the fewest copies of a row for which a block of random fingerprints stays small."""
    for extra in range(1, 5):
        parts = radius + extra
        if n <= 8 << (64 * extra // parts) or extra == 4:
            return parts, extra
    raise AssertionError


def _cuts(parts: int) -> list[int]:
    return [64 * i // parts for i in range(parts + 1)]


def masks(parts: int, agree: int) -> list[int]:
    """Bits of each choice of ``agree`` parts."""
    cuts = _cuts(parts)
    own = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(parts)]
    return [sum(own[i] for i in chosen) for chosen in combinations(range(parts), agree)]


def linked(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, fp: np.ndarray, radius: int, of_a: np.ndarray | None = None, of_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of table rows that link; ``x``, ``y``: distance tables; ``of_a``, ``of_b``: where their rows stand in ``fp``, if elsewhere."""
    for step in range(0, 64, 16):  # most pairs go at the first coordinates
        near = np.abs(x[a, step : step + 16] - y[b, step : step + 16]).max(1, initial=0) <= radius
        a, b = a[near], b[near]
    p, q = (fp[a], fp[b]) if of_a is None else (fp[of_a[a]], fp[of_b[b]])
    sure = np.bitwise_count(p ^ q) <= radius
    return a[sure], b[sure]


def forest(fp: np.ndarray, root: np.ndarray, first: np.ndarray, size: np.ndarray, other: np.ndarray, radius: int, tree: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of each block within the radius and of different roots: a block is rows first..first+size of ``fp``.

    With ``tree``, only as many as span what they connect. ``other`` is 0 for a whole block, else the number of rows of
    its first tile: only pairs across tiles count then.
    """
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    parent = np.arange(len(fp))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out_a, out_b = [], []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        apart = root[a] != root[b]
        a, b = linked(a[apart], b[apart], table, table, fp, radius)
        if not tree:
            out_a.append(a)
            out_b.append(b)
            return
        for p, q in zip(a.tolist(), b.tolist()):
            r, s = top(p), top(q)
            if r != s:
                parent[max(r, s)] = min(r, s)
                out_a.append([p])
                out_b.append([q])

    small = np.flatnonzero((size <= 64) & (other == 0))
    for n in np.unique(size[small]).tolist():
        i, j = np.triu_indices(n, 1)
        per = max(1, STEP // max(1, len(i)))
        heads = first[small[size[small] == n]]
        for at in range(0, len(heads), per):
            h = heads[at : at + per, None]
            take((h + i).ravel(), (h + j).ravel())
    for k in np.flatnonzero((size > 64) | (other > 0)).tolist():
        head, n, left = int(first[k]), int(size[k]), int(other[k])
        rows = range(head, head + (left or n))
        per = max(1, STEP // n)
        for at in range(rows.start, rows.stop, per):
            a = np.arange(at, min(at + per, rows.stop))
            b = np.arange(head + left, head + n)
            p, q = np.repeat(a, len(b)), np.tile(b, len(a))
            keep = p < q
            take(p[keep], q[keep])
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (out_a, out_b))


def in_blocks(rows: DataFrame, m: int, radius: int, tree: bool) -> DataFrame:
    """Pairs (a, b) of nodes that meet in a block and survive: ``rows`` has choice, key (the block), node, fp, root.

    ``m``: partitions. Blocks of one root give nothing and are left out before their rows are sent.
    """
    crowded = rows.groupBy("choice", "key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    rows = rows.join(crowded.select("choice", "key", "n"), ["choice", "key"])
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    lower = lambda t: F.struct(F.least(t, F.col("own")).alias("ti"), F.greatest(t, F.col("own")).alias("tj"))
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lower)).alias("t")
    rows = rows.withColumn("tiles", tiles).withColumn("own", own).select("choice", "key", spread, "own", "node", "fp", "root")
    group = ["choice", "key", "ti", "tj"]
    rows = rows.select("choice", "key", "t.ti", "t.tj", "own", "node", "fp", "root")
    return _meeting(rows, group, m, radius, tree)


def _meeting(rows: DataFrame, group: list[str], m: int, radius: int, tree: bool) -> DataFrame:
    """Pairs (a, b) that survive in each block: ``rows`` has the columns of ``group`` (its last two: tiles), own (tile), node, fp, root."""

    def run(batches):
        held = None
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if frame.empty:
                continue
            last = (frame[group] == frame[group].iloc[-1]).all(axis=1).to_numpy()
            cut = len(frame) - int(last.sum())
            held = frame.iloc[cut:]
            if cut:
                yield from found(frame.iloc[:cut])
        if held is not None and len(held):
            yield from found(held)
        release()

    def found(frame):
        values = [frame[c].to_numpy() for c in group]
        new = np.ones(len(frame), bool)
        new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(frame)))
        across = values[-2][first] != values[-1][first]
        left = np.add.reduceat((frame["own"].to_numpy() == values[-2]).astype(np.int64), first)
        fp, root, node = frame["fp"].to_numpy().view(np.uint64), frame["root"].to_numpy(), frame["node"].to_numpy()
        keep = ~across | ((left > 0) & (left < size))
        a, b = forest(fp, root, first[keep], size[keep], np.where(across, left, 0)[keep], radius, tree)
        lo, hi = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        for at in range(0, len(lo), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(lo[at : at + (1 << 16)]), pa.array(hi[at : at + (1 << 16)])], names=["a", "b"])

    ordered = rows.repartition(m, *group).sortWithinPartitions(*group, "own")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect every two of the ``n`` distinct fingerprints (``fp``) within the radius, perhaps through others."""
    parts, agree = blocking(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(parts, agree)]
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("choice", "key")
    rows = distinct.select("fp", keys).select("choice", "key", F.col("fp").alias("node"), "fp", F.col("fp").alias("root"))
    return in_blocks(rows, partitions(distinct), radius, tree=True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge (a, b) but the roots themselves, stored: root is a component's smallest node.

    Nodes are longs whose order decides which is smallest. Each round joins every node's larger neighbours and then its
    smaller ones to the least neighbour; it ends when no edge moves.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct().select("u", "v", F.lit(True).alias("moved")))
    for _ in range(rounds):
        if now.where("moved").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
        large = large.groupBy("u", "v").agg(F.max("moved").alias("moved"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.max("moved").alias("moved"))
        small = large.select("u", "v").join(small_least.select("u", "m"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        after = small.unionByName(small_least.select("u", F.col("m").alias("v"), "moved"))
        after = stored(after.groupBy("u", "v").agg(F.max("moved").alias("moved")))
        discard(now)
        now = after
    raise RuntimeError("components didn't settle")


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable; null if only null ids are)."""
    prints = fingerprinted(df, shingle, doc_id, text)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    distinct = stored(prints.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("_n")))
    edges = stored(links(distinct.select("fp"), distinct.count(), radius))
    roots = components(edges)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "_n", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("first"))
    labels = stored(named.drop("first").join(smallest, "root").select("fp", F.col("first.doc_id").alias("component_id"), "_n"))
    discard(distinct, edges)
    out = join_with_hot_keys(prints, labels, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def agreement(least: tuple[int, int]) -> float:
    """With which probability two sets of a similarity t agree in a majority bit: their cosine is 2 t / (1 + t), and it is 1 - angle / pi."""
    t = least[0] / least[1]
    return 1 - math.acos(min(1.0, 2 * t / (1 + t))) / math.pi


def most_bits(parts: int, least: tuple[int, int]) -> float:
    """Bits of so many parts in which sets that similar differ at most, but for DEVIATIONS."""
    n, p = 64 * parts, agreement(least)
    return n * (1 - p) + DEVIATIONS * math.sqrt(n * p * (1 - p))


def bands(n: int, least: tuple[int, int] = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, bands) for ``n`` rows: two sets of similarity ``least`` share a band with probability ``recall``."""
    agree = agreement(least)
    bits = min(48, max(BAND_BITS, math.ceil(math.log2(max(2, n))) - BAND_SHORT))
    return bits, 1 if agree == 1 else math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def _texts(batch: pa.RecordBatch, rows: np.ndarray | None = None):
    raw, at = text_buffers(batch.column(batch.schema.get_field_index("text")))
    whole, at = raw.tobytes(), at.tolist()
    for i in range(batch.num_rows) if rows is None else rows.tolist():
        yield whole[at[i] : at[i + 1]]


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def described(docs: DataFrame, shingle: int, bits: int, count: int) -> DataFrame:
    """none, k, h (the row), d1, d2 (a 128-bit digest of its set of shingles), n (the set's size), fp, wide (parts of the print) and keys (its bands), stored."""
    words = -(-bits * count // 64)
    number = np.arange(count, dtype=np.uint64) << np.uint64(48)  # bands have 48 bits at most

    def run(batches):
        for batch in batches:
            digests, sizes, fps, wide, keys = [], [], [], [], []
            for text in _texts(batch):
                own = np.unique(_hashes(text, shingle))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sizes.append(len(own))
                long = long_print(own, words)
                fps.append(np.packbits(long[:64]).view(np.uint64))
                wide.append(np.packbits(long[: 64 * PARTS]).view(np.uint64))
                each = np.zeros((count, 64), bool)
                each[:, 64 - bits :] = long[: bits * count].reshape(count, bits)
                keys.append(np.packbits(each, axis=1).view(">u8").ravel().astype(np.uint64) | number)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            fp = np.concatenate([np.zeros(0, np.uint64), *fps]).view(np.int64)
            columns = [batch.column(i) for i in range(3)]
            columns += [pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(sizes, pa.int64()), pa.array(fp), _lists(wide), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["none", "k", "h", "d1", "d2", "n", "fp", "wide", "keys"])
        release()

    return stored(docs.select("none", "k", "h", "text").mapInArrow(run, "none boolean, k long, h long, d1 long, d2 long, n long, fp long, wide array<long>, keys array<long>"))


def against_the_first(rows: DataFrame, m: int, radius: int) -> DataFrame:
    """Pairs (a, b) of each block's smallest node and its others that survive, and as (key, -1) the blocks of more than ``TILE`` rows.

    ``rows`` has key (the block), node, fp. Blocks are streamed, however large.
    """

    def run(batches):
        last, size = None, 0  # key, node, fp of the first row of the block that goes on, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.array([c.to_numpy() for c in batch.columns])
            if last is not None:
                cells = np.concatenate([last, cells], 1)
            new = np.ones(cells.shape[1], bool)
            new[1:] = cells[0, 1:] != cells[0, :-1]
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(new)))
            sizes[0] += max(0, size - 1)  # the block's first row is there again
            crowded = sizes > TILE
            head = heads[np.cumsum(new) - 1]
            rest = np.flatnonzero(~new)
            last, size = cells[:, heads[-1:]], int(sizes[-1])
            fp = cells[2].view(np.uint64)
            own, a_row = np.unique(head[rest], return_inverse=True)
            x, y = (np.bitwise_count(fp[i][:, None] ^ PIVOTS[None, :]).astype(np.int8) for i in (own, rest))
            i, j = linked(a_row, np.arange(len(rest)), x, y, fp, radius, own, rest)
            a, b = cells[1][own[i]], cells[1][rest[j]]
            keys = cells[0][heads[crowded]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, keys])), pa.array(np.concatenate([b, np.full(len(keys), -1)]))], names=["a", "b"])
        release()

    ordered = rows.select("key", "node", "fp").repartition(m, "key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def in_bands(rows: DataFrame, crowded: DataFrame, m: int, radius: int) -> DataFrame:
    """All pairs (a, b) of nodes of different roots that meet in a block and survive: ``rows`` has key, node, fp, root.

    ``crowded`` (key): blocks of more than ``TILE`` rows; their rows are spread over about TILE a part, and parts meet two
    by two in tasks of their own.
    """
    few = crowded.count() <= MOST_CROWDED
    known = F.broadcast(crowded) if few else crowded
    n = stored(rows.select("key").join(known, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")))
    tiles = F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("int")
    rows = rows.join(F.broadcast(n) if few else n, "key", "left").withColumn("tiles", tiles)
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    lower = lambda t: F.struct(F.least(t, F.col("own")).alias("ti"), F.greatest(t, F.col("own")).alias("tj"))
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lower)).alias("t")
    rows = rows.withColumn("own", own).select("key", spread, "own", "node", "fp", "root")
    rows = rows.select("key", "t.ti", "t.tj", "own", "node", "fp", "root")
    return _meeting(rows, ["key", "ti", "tj"], m, radius, tree=False)


def bucket():
    """The bucket of a row (none, k, h)."""
    return F.pmod(F.xxhash64("none", "k", "h"), F.lit(BUCKETS))


def bucket_bits(rows: DataFrame) -> DataFrame:
    """(w, bits): the buckets of ``rows``, 64 to a row: ``BUCKETS`` / 64 rows at most."""
    return rows.select(bucket().alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("bits"))


def without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose (none, k, h) aren't in ``gone`` (stored). Those whose bucket no row of ``gone`` has stay where they are, unshuffled."""
    placed = keyed.withColumn("b", bucket()).withColumn("w", F.expr("b div 64")).join(F.broadcast(bucket_bits(gone)), "w", "left")
    placed = placed.withColumn("met", F.coalesce(F.expr("shiftrightunsigned(bits, CAST(b % 64 AS INT)) & 1L = 1L"), F.lit(False)))
    met, clear = (placed.where(c).select(*keyed.columns) for c in (F.col("met"), ~F.col("met")))
    return clear.unionByName(met.join(gone, ["none", "k", "h"], "left_anti").select(*keyed.columns))


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, own) of the sets of the rows ``wanted`` (none, k, h, node), stored. Other texts are passed over by a table of bits, not shuffled."""
    words = np.zeros(BUCKETS // 64, np.int64)  # at most that many rows come to the driver
    found = bucket_bits(wanted).toArrow()
    words[found["w"].to_numpy()] = found["bits"].to_numpy()
    bits = words.view(np.uint64)

    def run(batches):
        for batch in batches:
            b = batch.column(3).to_numpy()
            rows = np.flatnonzero(bits[b // 64] >> (b % 64).astype(np.uint64) & np.uint64(1))
            own = [np.unique(_hashes(text, shingle)) for text in _texts(batch, rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(3)), _lists(own)], names=["none", "k", "h", "own"])
        release()

    sets = docs.select("none", "k", "h", bucket().alias("b"), "text").mapInArrow(run, "none boolean, k long, h long, own array<long>")
    return stored(sets.dropDuplicates(["none", "k", "h"]).join(wanted, ["none", "k", "h"]).select("node", "own"))  # one exchange serves both


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, stored; ``nodes``: node, none, k, h, n (size), wide.

    Sizes rule some out, and so do the bits of several parts of the print, before whole sets are sent.
    """
    up, down = least
    known = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))
    met = pairs.join(known("a"), "a").join(known("b"), "b")
    bits = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (F.least("na", "nb") * down >= F.greatest("na", "nb") * up) & (bits <= F.get(F.lit([most_bits(i, least) for i in range(PARTS + 1)]), F.size("wa")))
    pairs = stored(met.where(near).select("a", "b"))
    wanted = stored(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node").join(nodes, "node").select("none", "k", "h", "node"))
    sets = whole_sets(docs, wanted, shingle)
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    out = stored(met.where(common * (up + down) >= (F.size("x") + F.size("y")) * up).select("a", "b"))
    discard(pairs, wanted, sets)
    return out


def similar_rows(df: DataFrame, shingle: int = WORDS, least: tuple[int, int] = LEAST, recall: float = RECALL, radius: int = WIDE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(none, k, h) of the rows that aren't the first of their component: whether the id is null, the id (or 0), a digest of the text.

    Documents link from a Jaccard similarity of ``least`` (a fraction) in their sets of word shingles; the first of a
    component is the row of the smallest id (null last), then digest.
    """
    docs = picked(df, doc_id=(doc_id, T.LongType()), text=(text, T.StringType()))
    docs = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")
    bits, count = bands(docs.count(), least, recall)
    rows = described(docs, shingle, bits, count)
    m = partitions(rows)
    equal = stored(rows.groupBy("d1", "d2").agg(F.min(F.struct("none", "k", "h")).alias("first"), F.count("*").alias("_n")))
    firsts = equal.select("d1", "d2", "first.none", "first.k", "first.h")
    nodes = rows.join(firsts, ["d1", "d2", "none", "k", "h"]).dropDuplicates(["d1", "d2"])
    nodes = stored(stored(nodes).withColumn("node", F.monotonically_increasing_id()))  # as written, rows keep their numbers
    met = stored(against_the_first(nodes.select(F.explode("keys").alias("key"), "node", "fp"), m, radius))
    near = verified(docs, met.where("b >= 0"), nodes, shingle, least)
    roots = components(near)
    rooted = nodes.select("keys", "node", "fp").join(roots, "node", "left").select(F.explode("keys").alias("key"), "node", "fp", F.coalesce("root", "node").alias("root"))
    crowded = met.where("b < 0").select(F.col("a").alias("key"))
    more = verified(docs, in_bands(rooted, crowded, m, radius), nodes, shingle, least)
    roots = components(near.union(more))
    named = nodes.select("node", "d1", "d2", "none", "k", "h").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min(F.struct("none", "k", "h")).alias("first"))
    labels = stored(named.select("root", "d1", "d2").join(smallest, "root").select("d1", "d2", "first").join(equal.select("d1", "d2", "_n"), ["d1", "d2"]).select(F.struct("d1", "d2").alias("d"), "first", "_n"))
    found = join_with_hot_keys(rows.select("none", "k", "h", F.struct("d1", "d2").alias("d")), labels, "d")
    gone = stored(found.where(F.struct("none", "k", "h") != F.col("first")).select("none", "k", "h").distinct())
    discard(rows, equal, nodes, met, near, more, labels)
    return gone


def row_key(doc_id, text) -> tuple:
    """none, k, h of a row."""
    return doc_id.isNull().alias("none"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("k"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("h")

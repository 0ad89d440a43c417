"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Only longer documents are cut: into pieces of full capacity, the first of which may be shorter. The packing is planned
on the histogram of piece lengths, which has at most ``capacity`` rows whatever the corpus: a bin is filled greedily
with the longest length that fits, then its smallest piece gives way to the two unpacked pieces that fill the enlarged
gap best, and the bin is repeated as often as the counts allow. Pieces find their places by their rank among those of
their length, so no task ever holds more than a batch of rows.

Pieces of full capacity are a sequence each, numbered downwards from -1, and are never shuffled. Ranks of the others are
counted by (length, salt), the number of salts following that of the pieces.

Defined cases: a null text is the empty text (its one piece is the closing id); texts of any length are tokenised whole
and cut; repeated rows are packed each; an empty table gives no rows; null ids stay null; other columns, whatever their
names, play no part.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.bytebpe import coder
from coppice.llm.common import partitions, picked, release, stored

CAPACITY = 2048
#: Salts of a length: one for so many pieces, within bounds (the driver gets capacity x salts counts at most).
A_SALT, LEAST_SALTS, MOST_SALTS = 1_000_000, 64, 1024

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
PLACED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


@dataclass
class Bin:
    """``times`` sequences that each hold pieces of these lengths, longest first."""

    lengths: list[int]
    times: int


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bin]:
    """Packs ``counts[length]`` pieces of each length; equal bins are made at once."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece must have between 1 and capacity tokens")
    sizes = sorted(left)
    bins: list[Bin] = []
    while sizes:
        used: Counter[int] = Counter()
        gap = capacity
        at = len(sizes) - 1
        while True:
            at = min(at, bisect.bisect_right(sizes, gap) - 1)
            if at < 0:
                break
            n = sizes[at]
            fits = min(gap // n, left[n] - used[n])
            if fits:
                used[n] += fits
                gap -= fits * n
            at -= 1
        smallest = min(used)
        if gap:
            pair = _best_pair(sizes, left, used, gap + smallest)
            if pair and sum(pair) > smallest:
                used[smallest] -= 1
                used.update(pair)
                used = +used
        times = min(left[n] // u for n, u in used.items())
        bins.append(Bin(sorted(used.elements(), reverse=True), times))
        for n, u in used.items():
            left[n] -= u * times
            if not left[n]:
                del left[n]
                sizes.remove(n)
    return bins


def _best_pair(sizes: list[int], left: dict[int, int], used: Counter, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths of the largest sum within ``room``."""
    low, high, best = 0, len(sizes) - 1, None
    free = [left[n] - used[n] for n in sizes]
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or not free[high]:
            high -= 1
        elif not free[low]:
            low += 1
        else:
            if (low < high or free[low] > 1) and (best is None or total > sum(best)):
                best = sizes[low], sizes[high]
                if total == room:
                    return best
            low += 1
    return best


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its place in the document, its length and the CRC-32 of its ids."""
    docs = picked(df, doc_id=(doc_id, T.LongType()), text=(text, T.StringType()))
    schema = T.StructType([*PIECES.fields, IDS] if with_ids else PIECES.fields)

    def run(batches):
        bpe = coder(tokenizer)
        for batch in batches:
            texts, names = batch.column(1), batch.column(0)
            row = 0
            while row < batch.num_rows:
                own, size, first = [], 0, row
                while row < batch.num_rows and size < 1 << 18:
                    own.append(texts[row].as_py() or "")
                    size += len(own[-1])
                    row += 1
                ids, counts = bpe.encode(own)
                yield cut(ids, counts, names.slice(first, row - first))
        release(keep=True)  # the next task of this operator needs the same table

    def cut(ids, counts, names):
        total = counts + 1
        closed = np.insert(ids, np.cumsum(counts), np.uint32(end)).astype("<u4")
        head = np.where(total <= capacity, total, (total - 1) % capacity + 1)
        pieces = 1 + (total - head) // capacity
        doc = np.repeat(np.arange(len(total)), pieces)
        number = np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]
        start = np.where(number == 0, 0, head[doc] + (number - 1) * capacity)
        length = np.where(number == 0, head[doc], capacity)
        a = (np.cumsum(total) - total)[doc] + start
        view = memoryview(closed).cast("B")
        crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(a.tolist(), (a + length).tolist())]
        columns = [names.take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(closed)), pa.int32()), pa.array(closed.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (columns of PIECES, perhaps more)."""
    whole = pieces.where(F.col("length") == capacity)
    numbered = whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shorter = pieces.where(F.col("length") < capacity)
    salts = int(min(MOST_SALTS, max(LEAST_SALTS, shorter.count() // A_SALT)))
    salted = shorter.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counted = np.zeros((capacity + 1, salts), np.int64)
    counts = salted.groupBy("length", "_salt").count().toArrow()
    counted[counts["length"].to_numpy(), counts["_salt"].to_numpy()] = counts["count"].to_numpy()
    bins = best_two_fit({n: int(c) for n, c in enumerate(counted.sum(1)) if c}, capacity)
    rank = np.cumsum(counted, 1) - counted
    slots, sequence = [], 0
    filled: Counter[int] = Counter()
    for b in bins:
        at = 0
        for n, uses in sorted(Counter(b.lengths).items(), reverse=True):
            slots.append((n, filled[n], uses, sequence, at))
            filled[n] += uses * b.times
            at += n * uses
        sequence += b.times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    schema = T.StructType([*pieces.schema.fields, *PLACED.fields[-2:]])
    names = pieces.columns

    def assign(batches):
        last, seen = (-1, -1), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
            s = batch.column(batch.schema.get_field_index("_salt")).to_numpy().astype(np.int64)
            new = np.ones(len(n), bool)
            new[1:] = (n[1:] != n[:-1]) | (s[1:] != s[:-1])
            carried = seen if (n[0], s[0]) == last else 0
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            within = np.arange(len(n)) - heads[group]
            within[group == 0] += carried
            last, seen = (n[-1], s[-1]), int(within[-1]) + 1
            r = rank[n, s] + within
            slot = table[_slot(n, r)]
            k = r - slot[:, 1]
            sequence_id = slot[:, 3] + k // slot[:, 2]
            offset = slot[:, 4] + k % slot[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence_id), pa.array(offset)], names=schema.names)

    first = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def _slot(n, r):
        """Last slot of this length that starts at or before the rank: a binary search of all rows at once."""
        low, high = first[n], first[n + 1]
        while (high - low > 1).any():
            middle = (low + high) // 2
            up = (table[np.minimum(middle, len(table) - 1), 1] <= r) & (high - low > 1)
            low, high = np.where(up, middle, low), np.where(up | (high - low <= 1), high, middle)
        return low

    n = partitions(pieces)
    placed = salted.repartition(n, "length", "_salt").sortWithinPartitions("length", "_salt", "doc_id", "piece").mapInArrow(assign, schema)
    return placed.union(numbered)


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; the tokenised pieces are stored once. No text is shuffled."""
    return place(stored(token_pieces(df, tokenizer, capacity, end, doc_id, text, with_ids)), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces placed ``with_ids``: sequence_id, ids, doc_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))

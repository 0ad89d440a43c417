"""Document fingerprints by improbable features.

Every 64-byte window of a text gets a precedence rank from the rarity of its entropy; windows that are the leftmost
lowest-ranked one in many runs of 64 neighbouring windows are the text's features. Features go into a chain of
2,048-bit Bloom filters (5 bits a feature, 160 features a filter). Two digests are compared by the overlap of their
filters' bits beyond what chance gives, over the most it could be.

Short texts have finer features as well, or a change of their last quarter would touch every window: those of under 512,
128 and 32 bytes also take windows of 16, 8 and 4 bytes, chosen by the same rule at a span of one window and a fourth of it
in votes. Of the features at hand the smaller digest's share counts, so texts on either side of a limit stay comparable.

The rarity of an entropy is a fixed table (a bell around that of prose), not a corpus statistic: a fingerprint
depends on its text alone, so equal texts have equal fingerprints in every corpus.

Defined cases: a null text is the empty text; a text without bytes has the fingerprint "" (likeness 1 to another
empty text, 0 to any other); one of under 4 bytes is one feature; a text of 64 bytes or more in which no window is popular
enough gives its most popular window; texts of any length are read whole. Rows are ordered by (doc_id, text), null ids last,
behind the largest id; repeated rows are rows of their own; other columns, whatever their names, play no part; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import LAST_ID, mix64, partitions, picked, release, search_sorted

WINDOW, SPAN, POPULAR = 64, 64, 16
FILTER_BITS, FEATURE_BITS, FILTER_FEATURES = 2048, 5, 160
#: Entropies are thousandths of 6 bits. Windows of prose lie around 650; below LEAST a window is a mere repetition.
USUAL, SPREAD, LEAST, NOTHING = 650, 60, 150, 1023
#: (texts of fewer bytes, bytes of a window, usual entropy in thousandths of the most a window can have).
FINER = ((512, 16, 900), (128, 8, 960), (32, 4, 1000))
BLOCK = 1 << 17
FIXED = 1 << 16
#: Ranges of ids at most: their bounds go into the plan. More rows make ranges longer, and they are streamed.
MOST_RANGES = 32_768

_c = np.arange(WINDOW + 2)
_G = np.round(_c * np.log2(np.maximum(_c, 1)) * FIXED).astype(np.int32)
_GAIN = np.diff(_G)  # from c to c + 1
_e = np.arange(1001)
_RANK = np.where(_e < LEAST, 1001, np.round(1000 * np.exp(-(((_e - USUAL) / SPREAD) ** 2) / 2))).astype(np.uint32)


def window_ranks(raw: np.ndarray) -> np.ndarray:
    """Precedence rank of each 64-byte window of ``raw`` (low: rare)."""
    n = len(raw) - WINDOW + 1
    out = np.empty(max(n, 0), np.uint32)
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        a = raw[at : at + size + WINDOW - 1]
        ahead, behind = np.zeros(len(a), np.uint8), np.zeros(len(a), np.uint8)
        for k in range(1, WINDOW):
            same = (a[:-k] == a[k:]).view(np.uint8)
            ahead[:-k] += same
            behind[k:] += same
        first = _G[np.bincount(a[:WINDOW], minlength=256)].sum()
        change = _GAIN[behind[WINDOW:]] - _GAIN[ahead[: size - 1]]
        total = np.empty(size, np.int64)
        total[0] = first
        np.cumsum(change, out=total[1:])
        total[1:] += first
        entropy = 1000 - (total * 1000 + WINDOW * 3 * FIXED) // (WINDOW * 6 * FIXED)
        out[at : at + size] = _RANK[np.clip(entropy, 0, 1000)]
    return out


def popularity(ranks: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """In how many runs of 64 windows (fewer at a text's end) each window is the leftmost lowest-ranked one.

    ``inside``: which windows lie in one text; the others rank NOTHING, and no run starts at them.
    """
    n = len(ranks)
    votes = np.zeros(n + SPAN + BLOCK, np.uint16)
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        keys = np.full(size + SPAN - 1, NOTHING << 20, np.uint32)
        part = ranks[at : at + size + SPAN - 1]
        keys[: len(part)] = part << 20
        keys += np.arange(len(keys), dtype=np.uint32)
        width = 1
        while width < SPAN:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        keys = keys[:size] if inside is None else keys[:size][inside[at : at + size]]
        votes[at : at + size + SPAN] += np.bincount(keys & 0xFFFFF, minlength=size + SPAN).astype(np.uint16)
    return votes[:n]


def finer_features(text: bytes) -> list[tuple[int, bytes]]:
    """(start, window) of the chosen small windows of a short text."""
    out = []
    for below, width, usual in FINER:
        n = len(text) - width + 1
        if len(text) >= below or n < 1:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), width)
        counts = (windows[:, :, None] == windows[:, None, :]).sum(2)
        logs = np.round(np.log2(np.arange(1, width + 1)) * FIXED).astype(np.int64)
        entropy = 1000 - logs[counts - 1].sum(1) * 1000 // int(width * np.log2(width) * FIXED)
        rank = np.round(1000 * np.exp(-(((entropy - usual) / SPREAD) ** 2) / 2)).astype(np.int64)
        rank = np.where(entropy < LEAST, 1001, rank) * n + np.arange(n)  # leftmost of the lowest
        rank = np.append(rank, np.full(width - 1, 1 << 40))
        winner = np.lib.stride_tricks.sliding_window_view(rank, width).argmin(1) + np.arange(n)
        out += [(int(i), text[i : i + width]) for i in np.flatnonzero(np.bincount(winner, minlength=n) >= max(1, width // 4))]
    return out


def digests(raw: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The chained filters of each text in ``raw``; ``at`` are the texts' offsets."""
    docs, lengths = len(at) - 1, np.diff(at)
    ranks = window_ranks(raw)
    windows = np.maximum(lengths - WINDOW + 1, 0)
    valid = np.zeros(len(raw) + 1, np.int8)
    np.add.at(valid, at[:-1], (windows > 0).astype(np.int8))
    np.add.at(valid, at[:-1] + windows, -(windows > 0).astype(np.int8))
    inside = np.cumsum(valid[: len(ranks)]).astype(bool)
    ranks[~inside] = NOTHING
    votes = popularity(ranks, inside)
    chosen = np.flatnonzero(votes >= POPULAR)
    doc = np.searchsorted(at, chosen, side="right") - 1
    has = np.zeros(docs, bool)
    has[doc] = True
    rest = np.flatnonzero(~has & (windows > 0))
    if len(rest):
        more = np.array([at[d] + int(np.argmax(votes[at[d] : at[d] + windows[d]])) for d in rest], np.int64)
        chosen, doc = np.concatenate([chosen, more]), np.concatenate([doc, rest])
    cells = raw[chosen[:, None] + np.arange(WINDOW)].reshape(-1).view(np.uint64).reshape(-1, 8)
    h = np.full(len(chosen), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(8):
        h = mix64(h ^ cells[:, k])
    more, owner, fine = [], [], []
    for d in np.flatnonzero((lengths > 0) & (lengths < FINER[0][0])).tolist():
        text = raw[at[d] : at[d + 1]].tobytes()
        for i, window in finer_features(text) or ([(0, text)] if windows[d] == 0 else []):
            more.append(int(at[d]) + i)
            owner.append(d)
            fine.append(int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little"))
    if more:
        chosen, doc = np.concatenate([chosen, np.array(more)]), np.concatenate([doc, np.array(owner)])
        h = np.concatenate([h, np.array(fine, np.uint64)])
    order = np.lexsort((chosen, h, doc))
    chosen, doc, h = chosen[order], doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    chosen, doc, h = chosen[first], doc[first], h[first]
    order = np.argsort(chosen, kind="stable")
    doc, h = doc[order], h[order]
    count = np.bincount(doc, minlength=docs)
    link = (np.arange(len(h)) - (np.cumsum(count) - count)[doc]) // FILTER_FEATURES
    chain = -(-count // FILTER_FEATURES)
    base = np.cumsum(chain) - chain
    bits = np.zeros((int(chain.sum()), FILTER_BITS), bool)
    row = base[doc] + link
    for k in range(FEATURE_BITS):
        bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + c].tobytes() for b, c in zip(base.tolist(), chain.tolist())]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: for each filter of the shorter chain the best filter of the other, weighed by its bits; symmetric."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    size = FILTER_BITS // 8
    x = [int.from_bytes(a[i : i + size], "little") for i in range(0, len(a), size)]
    y = [int.from_bytes(b[i : i + size], "little") for i in range(0, len(b), size)]

    def towards(x: list[int], y: list[int]) -> float:
        score = weight = 0.0
        for p in x:
            own, best = p.bit_count(), 0.0
            for q in y:
                other = q.bit_count()
                chance, most = own * other / FILTER_BITS, min(own, other)
                common = (p & q).bit_count()
                if most > chance:
                    best = max(best, (common - chance) / (most - chance))
            score, weight = score + own * best, weight + own
        return score / weight

    if len(x) != len(y):
        return towards(*((x, y) if len(x) < len(y) else (y, x)))
    return (towards(x, y) + towards(y, x)) / 2


def encoded(digest: bytes) -> str:
    return base64.b64encode(digest).decode()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def fingerprints(df: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """``df`` with the digest of ``text`` as base64 in ``column`` (an existing one is replaced). No shuffle."""

    @F.pandas_udf(T.StringType())
    def digest(texts: pd.Series) -> pd.Series:
        raw, at = joined([(t or "").encode() for t in texts])
        return pd.Series([encoded(d) for d in digests(raw, at)])

    return df.withColumn(column, digest(F.col(text)))


NEAR_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _rows(batches):
    """(bucket, wrap, guard, doc_id, text) of each sorted row, a few at a time."""
    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        texts = batch.column(4)
        for i in range(batch.num_rows):
            yield (*(c[i].as_py() for c in columns), texts[i].as_py() or "")


def _compare(batches, limit: int = 1 << 19):
    """Walks rows in order; a chunk is worked on once the text after its last one is known."""

    def flush(rows: list, following):
        texts = [r[4] for r in rows] + [following[4]]
        edited = []
        for mine, after in zip(texts, texts[1:]):
            cut = len(mine) // 4
            edited.append((mine[: len(mine) - cut] + after[:cut]).encode())
        own = digests(*joined([t.encode() for t in texts]))
        new = digests(*joined(edited))
        keep = [i for i, r in enumerate(rows) if not r[2]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][3] for i in keep], pa.int64()),
                pa.array([len(texts[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(edited[i]).hexdigest() for i in keep], pa.string()),
                pa.array([encoded(own[i]) for i in keep], pa.string()),
                pa.array([encoded(new[i]) for i in keep], pa.string()),
                pa.array([likeness(own[i], new[i]) for i in keep], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in keep], pa.float64()),
            ],
            names=[f.name for f in NEAR_SCHEMA],
        )

    held: list = []
    size = 0
    for row in _rows(batches):
        if held and held[-1][0] != row[0]:  # the bucket before ended in its guard
            held, size = [], 0
        elif held and held[-1][2]:  # only the first guard counts
            continue
        elif held and (size >= limit or row[2]):
            yield flush(held, row)
            held, size = [], 0
        held.append(row)
        size += len(row[4])
    release()


def compare_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints every whole text and its edited text (last quarter replaced from the next document).

    The texts are shuffled once, into ranges of ids found by a pass over the ids alone; the first row of each range
    goes to the range before as well, so that no range waits for another.
    """
    docs = picked(df, doc_id=(doc_id, T.LongType()), text=(text, T.StringType()))
    n = partitions(docs)
    key = F.coalesce(F.col("doc_id"), F.lit(LAST_ID))
    wanted = min(4 * n, MOST_RANGES)
    cuts = docs.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 10 * wanted).alias("q")).first()["q"] or []
    bucket = search_sorted(key, sorted(set(cuts)))
    firsts = {r["b"]: r["k"] for r in docs.select(bucket.alias("b"), key.alias("k")).groupBy("b").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    earlier = {b: a for a, b in zip(order, order[1:])}
    low, high = (order[0], order[-1]) if order else (0, 0)
    table = [-1] * (high + 2)
    for b, a in earlier.items():
        table[b] = a
    starts = [firsts.get(b, LAST_ID) for b in range(high + 2)]
    home = docs.select(bucket.alias("b"), key.alias("k"), "doc_id", "text")
    is_first = F.col("k") == F.get(F.lit(starts), F.col("b"))
    place = lambda b, wrap, guard: F.struct(b.cast("int").alias("bucket"), F.lit(wrap).alias("wrap"), F.lit(guard).alias("guard"))
    places = F.array_compact(
        F.array(
            place(F.col("b"), 0, 0),
            F.when(is_first & (F.col("b") > low), place(F.get(F.lit(table), F.col("b")), 0, 1)),
            F.when(is_first & (F.col("b") == low), place(F.lit(high), 1, 1)),
        )
    )
    spread = home.select(F.explode(places).alias("p"), "k", "doc_id", "text").select("p.bucket", "p.wrap", "p.guard", "k", "doc_id", "text")
    last = F.col("doc_id").isNull()
    sorted_rows = spread.repartition(n, "bucket").sortWithinPartitions("bucket", "wrap", "guard", "k", last, "text")
    return sorted_rows.select("bucket", "wrap", "guard", "doc_id", "text").mapInArrow(_compare, NEAR_SCHEMA)

"""SimHash links and components, repeated strings, against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm import simhash, suffixes


def plain_simhash(text: str | None, k: int = 4) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps: dict[int, int], radius: int = 4) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_and_components(docs, corpus, spark):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_simhash(t) for i, t, *_ in corpus}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(fps)
    own = spark.createDataFrame([("alpha beta gamma delta",)], "t string").select(F.xxhash64("t")).first()[0]
    assert own % (1 << 64) == plain_simhash("Alpha  beta\tgamma delta")


def family(seed: int, n: int) -> list[int]:
    """Fingerprints around a few centres at 0 to 6 bits, and lone ones."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n // 3)]
    for centre in out[:8]:
        out += [centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))) for _ in range(n // 12)]
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("size", [10, 1 << 19, 1 << 28, 1 << 33])
def test_no_link_is_lost_under_any_blocking(spark, monkeypatch, size):
    fps = family(size % 97, 240)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(df, size).collect()
    as_unsigned = lambda v: v % (1 << 64)
    assert all(0 < (as_unsigned(r["a"]) ^ as_unsigned(r["b"])).bit_count() <= 4 for r in edges)
    joined = {i: i for i in fps}

    def find(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for r in edges:
        a, b = find(as_unsigned(r["a"])), find(as_unsigned(r["b"]))
        joined[max(a, b)] = min(a, b)
    assert {i: find(i) for i in fps} == plain_components({f: f for f in fps})


def test_tiles_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    rnd = random.Random(3)
    centre = rnd.getrandbits(62)
    fps = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)} | {centre})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 10)
    roots = {r["root"] for r in simhash.components(edges).collect()}
    assert roots == {min(fps)} and simhash.components(edges).count() == len(fps) - 1


def test_distance_table_discards_only_far_pairs():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp[150:] = fp[:150] ^ np.uint64(0b1011)
    table = np.bitwise_count(fp[:, None] ^ simhash.PIVOTS[None, :]).astype(np.int8)
    a, b = np.triu_indices(300, 1)
    got = set(zip(*(x.tolist() for x in simhash.linked(a, b, table, table, fp, 4))))
    assert got == {(i, j) for i, j in zip(a.tolist(), b.tolist()) if int(fp[i] ^ fp[j]).bit_count() <= 4}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 300), rnd.randrange(100, 300)) for _ in range(150)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    touched = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: find(i) for i in touched if find(i) != i}


def test_simhash_odd(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 5
    assert len({r["component_id"] for r in rows if r["doc_id"] == 1}) == 1
    assert simhash.near_duplicates(empty).count() == 0
    last = 2**63 - 1
    rows = simhash.near_duplicates(odd.sparkSession.createDataFrame([(last, "a b c d e"), (None, "a b c d e"), (None, "f g h i j")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(last, last), (None, last), (None, None)}


def plain_repeats(rows: list[tuple[int, bytes]], length: int) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, b in sorted(rows):
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
@pytest.mark.parametrize("length", [100, 20])
def test_repeats(docs, corpus, length, hot):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.repeat_report(docs, length, hot).collect()}
    assert got == plain_repeats([(i, (t or "").encode()) for i, t, *_ in corpus], length)
    assert sum(g[1] for g in got.values()) > 1000


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_few_letters(spark, seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("ab") for _ in range(30))
    rows = [(rnd.randrange(10_000), "".join(rnd.choice([base[: rnd.randrange(30)], "".join(rnd.choice("abc") for _ in range(rnd.randrange(9)))]) for _ in range(rnd.randrange(12)))) for _ in range(60)]
    rows = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (8, 13, 16):
        got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.repeat_report(df, length).collect()}
        assert got == plain_repeats([(i, t.encode()) for i, t in rows], length)


def plain_previous(text: bytes, starts: list[int], length: int) -> list[int]:
    """For each start, the most bytes that it shares with an earlier one."""
    out = []
    for n, i in enumerate(starts):
        shared = [next((d for d in range(length) if text[i + d] != text[j + d]), length) for j in starts[:n]]
        out.append(max(shared, default=0))
    return out


@pytest.mark.parametrize("rounds", [64, 1])
def test_suffix_order_and_previous_factors(monkeypatch, rounds):
    monkeypatch.setattr(suffixes, "ROUNDS", rounds)
    rnd = random.Random(5)
    for letters, n in (("ab", 300), ("a", 60), ("abcdefgh", 300)):
        raw = np.frombuffer("".join(rnd.choice(letters) for _ in range(n)).encode(), np.uint8)
        text = raw.tobytes()
        for length in (3, 5, 8, 11, 16, 29):
            starts = np.array(sorted(rnd.sample(range(len(raw) - length + 1), min(150, len(raw) - length))))
            order, common = suffixes.suffix_order(raw, starts, length)
            spelt = [text[i : i + length] for i in starts.tolist()]
            assert order.tolist() == sorted(range(len(starts)), key=lambda i: (spelt[i], i))
            assert common.tolist()[1:] == [next((d for d in range(length) if spelt[a][d] != spelt[b][d]), length) for a, b in zip(order, order[1:])]
            assert suffixes.longest_previous(raw, starts, length).tolist() == plain_previous(text, starts.tolist(), length)
    assert suffixes.longest_previous(np.zeros(0, np.uint8), np.zeros(0, np.int64)).tolist() == []


def test_nearest_smaller():
    rnd = random.Random(4)
    for n in (0, 1, 2, 50, 400):
        for values in (rnd.sample(range(1000), n), list(range(n)), list(range(n))[::-1], [*range(1, n), 0][:n]):
            common = [0, *(rnd.randrange(9) for _ in range(n - 1))][:n]
            to, least = suffixes.nearest_smaller(np.array(values, np.int64), np.array(common, np.int32))
            for i in range(n):
                j = next((j for j in range(i - 1, -1, -1) if values[j] < values[i]), -1)
                assert to[i] == j and least[i] == (min(common[j + 1 : i + 1]) if j >= 0 else 0)


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_equal_hashes_are_no_repeats(spark, hot):
    """Blocks in the order of a Thue-Morse word and in that of its complement share every polynomial hash modulo 2^64."""
    word = "a"
    for _ in range(9):
        word += word.translate(str.maketrans("ab", "ba"))
    rnd = random.Random(1)
    block = "".join(rnd.choice("cdefghij") for _ in range(67))
    texts = ["".join(block + x for x in w) for w in (word, word.translate(str.maketrans("ab", "ba")))]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.repeat_report(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert got == plain_repeats([(i, t.encode()) for i, t in rows], 100)
    lone = [(0, texts[0][:68]), (1, texts[1][:68] * 2)]
    assert sum(r["n_removed"] for r in suffixes.repeat_report(spark.createDataFrame(lone, "doc_id long, text string"), hot=hot).collect()) == 0


def test_slices_are_copies_only_by_their_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "COMPARED", 7)
    raw = np.frombuffer(b"abcdabcdabceabcd", np.uint8)
    start, size = np.array([0, 4, 8, 12, 0]), np.array([4, 4, 4, 4, 3])
    assert suffixes.copies(raw, start, size, np.zeros(5, np.uint64)).tolist() == [False, True, False, True, False]


def test_null_id_comes_behind_the_largest(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh") for _ in range(150))
    rows = spark.createDataFrame([(None, text), (2**63 - 1, text)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in suffixes.repeat_report(rows).collect()} == {(None, 150), (2**63 - 1, 0)}


def test_one_long_text(spark):
    rnd = random.Random(3)
    once = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(1_500_000))
    rows = spark.createDataFrame([(1, once + once), (2, once[:200])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.repeat_report(rows).collect()}
    assert got == {1: (1_500_000, 1), 2: (200, 1)}


def test_blocks_split_runs_but_lose_nothing(monkeypatch):
    rnd = random.Random(6)
    raw = np.frombuffer("".join(rnd.choice("abcdef") for _ in range(3000)).encode(), np.uint8)
    at = np.array([0, 700, 700, 730, 1900, 3000])
    covered = lambda r: {(int(a), int(s) + j) for a, s, w in zip(r.anchor, r.start, r.windows) for j in range(w)}
    whole = covered(suffixes.runs(raw, at, 40))
    assert {p for _, p in whole} == {p for a, z in zip(at, at[1:]) for p in range(a, z - 39)}
    monkeypatch.setattr(suffixes, "BLOCK", 128)
    assert covered(suffixes.runs(raw, at, 40)) == whole


def test_kept_text_and_odd_rows(odd, empty, spark):
    assert suffixes.remove_repeats(odd).count() == 5 and suffixes.remove_repeats(empty).count() == 0
    p = "é" * 60  # 120 bytes
    df = spark.createDataFrame([(2, p + "!", 7), (1, "x" + p, 8)], "doc_id long, text string, kept int")
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(df.withColumnRenamed("kept", "other")).collect()}
    assert got[1]["n_removed"] > 0 and got[1]["kept"].startswith("x") and got[2]["kept"] == "!" and got[2]["other"] == 7


def test_last_step_holds_few_bytes_a_byte_of_text():
    texts = ["é" + "x" * 9_999] * 400
    left = pa.table({"k": np.arange(400), "h": np.zeros(400, np.int64), "text": pa.array(texts, pa.string()), "c0": np.arange(400)})
    found = np.array([(d, 1, 101) for d in range(0, 400, 2)] + [(d, 51, 200) for d in range(0, 400, 2)], np.int64)
    right = pa.table({"parts": pa.array([found.tobytes()], pa.binary())})
    fields = [T.StructField(n, T.LongType()) for n in ("c0", "n_bytes", "n_removed", "n_spans")]
    run = suffixes._finish(["c0"], T.StructType([*fields, T.StructField("kept", T.StringType())]), True)
    tracemalloc.start()
    out = run(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * sum(len(t.encode()) for t in texts)
    assert out.column("n_removed").to_pylist() == [199, 0] * 200
    assert out.column("n_spans").to_pylist() == [1, 0] * 200
    assert out.column("kept").to_pylist() == ["x" * 9_801, texts[0]] * 200  # the é lost a byte

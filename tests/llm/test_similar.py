"""Near-duplicates of the pipeline against brute force: exact Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from coppice.llm import simhash


def plain_set(text: str | None, k: int = 5) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain_first(rows: list[tuple[int, str]]) -> set[int]:
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if j < i and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def near_copies(seed: int) -> list[tuple[int, str]]:
    """Texts of 1 to 300 words under a common notice, with copies of none to many changed words: similarities all around 0.8."""
    rnd = random.Random(seed)
    notice = " ".join(f"n{i}" for i in range(12))
    out = []
    for _ in range(50):
        words = [f"w{rnd.randrange(900)}" for _ in range(rnd.choice([1, 3, 6, 20, 80, 300]))]
        for changes in (0, *(rnd.randrange(0, 1 + max(1, len(words) // 20)) for _ in range(rnd.randrange(5)))):
            own = list(words)
            for _ in range(changes):
                own[rnd.randrange(len(own))] = f"c{rnd.randrange(900)}"
            out.append(notice + " " + " ".join(own) if rnd.random() < 0.5 else " ".join(own).upper())
    return list(enumerate(rnd.sample(out, len(out))))


def test_stage_against_all_pairs(spark):
    """No two texts link that brute force doesn't connect; of those that it drops, nine in ten go at least."""
    gone = missed = 0
    for seed in range(2):
        rows = near_copies(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, df, "").collect()}
        want = plain_first(rows)
        assert want <= kept
        gone, missed = gone + len(rows) - len(want), missed + len(kept - want)
    assert gone > 60 and missed <= 0.1 * gone


def pairs_at(similarity: float, n: int, seed: int) -> list[tuple[int, str]]:
    """Pairs of texts of about 150 words, ids 2i and 2i + 1, of just about this similarity."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(154)]
        other, have = list(words), plain_set(" ".join(words))
        for at in rnd.sample(range(5, 149), 144):
            trial = [*other[:at], f"c{at}", *other[at + 1 :]]
            own = plain_set(" ".join(trial))
            if len(own & have) / len(own | have) >= similarity:
                other = trial
        out += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    return out


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity just over 0.8, the hardest, are met with the stated probability; of 0.9, all but surely."""
    for similarity, share in ((0.8, 0.9), (0.9, 0.99)):
        rows = pairs_at(similarity, 150, 3)
        gone = simhash.similar_rows(spark.createDataFrame(rows, "doc_id long, text string"))
        found = {r["k"] for r in gone.collect()}
        assert all(i % 2 for i in found) and len(found) >= share * 150


def test_threshold_is_exact(spark):
    """Of ten shingles in the union, eight or nine are common: 0.8 links, a shingle fewer doesn't."""
    base = [f"w{i}" for i in range(13)]  # nine shingles
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "x"])), (3, " ".join([*base[:-2], "y", "z"]))]
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {1, 3} == plain_first(rows)


def test_bands():
    assert simhash.bands(10) == (16, 40) and simhash.bands(1 << 18)[0] == 16 and simhash.bands(1 << 24)[0] == 22
    bits, count = simhash.bands(1 << 24)
    assert 1 - (1 - 0.8485**bits) ** count >= 0.94


def test_bits_allow_what_similar_sets_need():
    """Sets of similarity 0.8 hardly ever differ in more bits than allowed, sets of 0.4 nearly always do."""
    rng = np.random.default_rng(9)
    most = simhash.most_bits(simhash.PARTS, simhash.LEAST)
    for common, lone, few in ((80, 10, True), (80, 60, False), (4, 0, True)):
        over = 0
        for _ in range(200):
            shared, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (common, lone, max(lone, 1)))
            a, b = (simhash.long_print(np.sort(np.append(shared, z)), simhash.PARTS) for z in (x, y))
            over += np.sum(a != b) > most
        assert over <= 1 if few else over >= 190


def test_long_prints_agree_as_told():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(60):
        common, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
        agree.append(np.mean(simhash.long_print(np.sort(np.append(common, x)), 10) == simhash.long_print(np.sort(np.append(common, y)), 10)))
    assert abs(np.mean(agree) - 0.8485) < 0.01


def test_hot_blocks(spark, monkeypatch):
    """A family larger than a tile, over many batches: all of it is one component."""
    monkeypatch.setattr(simhash, "TILE", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rnd = random.Random(5)
        base = [f"w{i}" for i in range(200)]
        rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(40)] + [(100 + i, " ".join(rnd.sample(base, 60))) for i in range(5)]
        gone = simhash.similar_rows(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["k"] for r in gone.collect()) == list(range(1, 40))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def exchanged(plan) -> int:
    """Rows that the exchanges of a plan that ran have written."""
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(exchanged(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_that_stay_are_not_shuffled(spark):
    """However many rows go, only they (and the few that share their buckets) meet the list of what goes."""
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(12))) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(None, rows[0][1]), (None, "only here, without an id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        kept = pipeline.near_duplicates(spark, df, "")
        got = [(r["doc_id"], r["text"]) for r in kept.where("doc_id IS NULL OR doc_id < 1000").collect()]
        assert sorted(got, key=str) == sorted([*rows[:400], (None, "only here, without an id"), (None, None)], key=str) and kept.count() == 402
        plain = df.where("doc_id IS NOT NULL")
        kept = pipeline.near_duplicates(spark, plain, "")
        assert len(kept.collect()) == 400
        assert exchanged(kept._jdf.queryExecution().executedPlan()) < 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

"""Packing by the histogram of sizes equals packing task by task, for every task."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from coppice import queries
from coppice.plans.schedule import Task, pack, pack_counts


def plain(sizes: dict, capacity: int, most: int) -> dict:
    bins = pack([Task(0, k, n, 0.0) for k, n in sorted(sizes.items())], capacity, most)
    return {t.node: i for i, b in enumerate(bins) for t in b.tasks}


@pytest.mark.parametrize("seed", range(30))
def test_packing_is_first_fit(seed):
    rnd = random.Random(seed)
    most, tasks = rnd.randrange(1, 6), [Task(0, k, rnd.choice([0, 1, 2.5, 7, 30]), 0.0) for k in range(rnd.randrange(0, 80))]
    bins: list[list[Task]] = []
    for t in sorted(tasks, key=lambda t: -t.rows):
        home = next((b for b in bins if sum(x.rows for x in b) + t.rows <= 31 and len(b) < most), None)
        if home is None:
            bins.append([t])
        else:
            home.append(t)
    assert [b.tasks for b in pack(tasks, 31, most)] == sorted(bins, key=lambda b: -sum(t.rows for t in b))


@pytest.mark.parametrize("seed", range(60))
def test_histogram_packs_like_tasks(seed):
    rnd = random.Random(seed)
    most, top = rnd.randrange(1, 8), rnd.choice([1, 5, 30, 200])
    sizes = {k: rnd.randrange(1, top + 1) for k in range(rnd.randrange(1, 300))}
    capacity = rnd.randrange(max(sizes.values()), 5 * top + 1)
    places = pack_counts(Counter(sizes.values()), capacity, most)
    got, seen = {}, Counter()
    for k, n in sorted(sizes.items()):
        rank = seen[n]
        seen[n] += 1
        [own] = [p for p in places if p[0] == n and p[1] <= rank < p[2]]
        got[k] = own[4] + (rank - own[1]) // own[3]
    assert got == plain(sizes, capacity, most)


@pytest.mark.parametrize("a_part", [1_000_000, 60])
def test_all_suppliers_are_placed(spark, a_part):
    rnd = random.Random(2)
    sizes = {k: rnd.randrange(1, 40) for k in range(-200, 700)}
    rows = spark.createDataFrame(list(sizes.items()), "l_suppkey long, n long")
    got = {r["l_suppkey"]: r["bin"] for r in queries.place_tasks(rows, a_part).collect()}
    assert got == plain(sizes, 4 * max(sizes.values()), 5)


def test_more_suppliers_than_100_000(spark, tmp_path):
    spark.range(100_050).selectExpr("id AS l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries.ffd_packing(spark, str(tmp_path))
    assert got.select("l_suppkey").distinct().count() == got.count() == 100_050
    assert got.groupBy("bin").sum("n").where("`sum(n)` > 4").isEmpty()

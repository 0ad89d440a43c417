"""Neighbours, mixes, url verdicts and licences against brute force."""

from __future__ import annotations

import random
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import hnsw, licenses, mixing, urls


def brute(ids, x, k=5):
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = hnsw.cosines(x, x[q][None, :])
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 500)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:140] = x[50]  # copies, more than a neighbourhood holds
    ids = rng.permutation(5000)[:1500]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    rows += [(50_000, None), (50_050, [0.0] * 16), (50_100, [float("nan")] * 16), (50_150, []), (None, [1.0] * 16), (50_200, [1.0, None] + [0.0] * 14), (50_250, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("clash"))
    got: dict[int, list] = {}
    for r in hnsw.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(ids, x)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    copies = sorted([*ids[100:140], ids[50]])
    for q in set(copies) & set(want):
        assert [i for i, _ in got[q]] == [int(i) for i in copies if i != q][:5]


def test_few_and_mixed_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0, 0.0]), (50, [3.0, 0.0]), (50, [3.0, 0.0]), (100, [5.0])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(0, 1, 50, 1.0), (0, 2, 1, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 0.0)}
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_hubs_keep_their_links():
    """All nodes are nearest to one hub: links back that overflow are chosen anew, none of them by a cap on how many are seen."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24))
    x = hnsw.unit(np.concatenate([[np.ones(24) * 3], x + 2.0]))
    g = hnsw.Graph.build(x)
    want = np.argsort(-(x @ x.T), axis=1)[:, :5]
    got = g.search(x)
    assert np.mean([len(set(a[:5].tolist()) & set(b.tolist())) / 5 for a, b in zip(got, want)]) > 0.98
    assert all((layer[g.level >= lay] >= 0).any(1).all() for lay, layer in enumerate(g.layers) if (g.level >= lay).sum() > 1)


def test_cells_are_probed_as_far_as_neighbours_lie(spark, monkeypatch):
    """Tight clusters over many shards: few cells are probed, and the neighbours found all the same."""
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 100)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(20, 16))
    x = (middle[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 0.1).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    seen = []
    found = hnsw._probes
    monkeypatch.setattr(hnsw, "_probes", lambda *a: seen.append(found(*a)) or seen[-1])
    got: dict[int, set] = {}
    for r in hnsw.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(np.arange(2000), x)
    assert np.mean([len(got[q] & {i for i, _ in v}) / 5 for q, v in want.items()]) > 0.95
    assert 1 <= seen[0][16] < 15


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(600)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert got.groupBy("query_id").count().where("count = 5").count() == 12


def plain_targets(sizes, weights, repeats=3):
    """Resharing step by step, as the rule is told."""
    target, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > repeats * sizes[i] + 1e-9]
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / w
            break
        for i in over:
            target[i] = float(repeats * sizes[i])
        rest -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return target


def test_targets():
    rnd = random.Random(7)
    for _ in range(200):
        sizes = [rnd.choice([0, 1, 5, 100, 10_000]) * rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert np.allclose([float(t) for t in mixing.targets(sizes, weights)], plain_targets(sizes, weights))


def test_min_cost_flow():
    # two ways from 0 to 3: cheap of 4, dear of 10; then a residual detour
    edges = [(0, 1, 4, 1), (1, 3, 10, 0), (0, 2, 10, 5), (2, 3, 3, 0), (2, 1, 10, 0)]
    flow = mixing.min_cost_flow(4, edges, 0, 3)
    assert flow[0] == 4 and flow[2] == 9 and flow[3] + flow[4] == 9
    given = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 1}, {"a": 12, "b": 15})
    assert sum(given.values()) == 27 and given[("a",)] == 10 and given[("b",)] <= 3


def test_overlapping_sources(spark):
    rows = [(i, 10, [["a"], ["b"], ["a", "b"]][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, size long, members array<string>")
    out = mixing.mix(df, (1, 1)).toPandas()
    assert abs(out.taken.sum() - 3000) <= 1 and (out.taken <= 30).all() and len(out) == 300
    assert (out.taken == 10).all()  # quotas that can be met without repeats are


@pytest.mark.parametrize("seed", range(40))
def test_routes_repeat_least(seed):
    """Against all ways to fill the quotas: the largest flow first, then the least cost."""
    rnd = random.Random(seed)
    patterns = rnd.sample([("a",), ("b",), ("a", "b")], rnd.randrange(1, 4))
    capacity = {p: rnd.randrange(0, 5) for p in patterns}
    quota = {s: rnd.randrange(0, 8) for s in "ab"}
    cost = lambda given: sum(min(max(g - k * c, 0), c) * (2**k - 1) for g, c in given for k in range(3))
    best = None
    for gives in product(*(range(3 * capacity[p] + 1) for p in patterns)):
        for to_a in range(sum(gives) + 1):  # tokens of overlapping documents that go to a
            both = sum(g for p, g in zip(patterns, gives) if len(p) == 2)
            if to_a > both:
                break
            a = to_a + sum(g for p, g in zip(patterns, gives) if p == ("a",))
            b = both - to_a + sum(g for p, g in zip(patterns, gives) if p == ("b",))
            if a <= quota["a"] and b <= quota["b"]:
                found = (-(a + b), cost([(g, capacity[p]) for p, g in zip(patterns, gives)]))
                best = found if best is None else min(best, found)
    given = mixing.route(capacity, quota)
    assert (-sum(given.values()), cost([(given[p], capacity[p]) for p in patterns])) == best


def test_many_sources(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "CAST(1 + id % 7 AS LONG) AS size", "array(CAST(id % 15000 AS STRING)) AS members")
    out = mixing.mix(df).agg(F.sum("taken").alias("t"), F.sum("size").alias("s"), F.max(F.col("taken") / F.col("size")).alias("m"), F.count("*").alias("n")).first()
    assert out["n"] == 30_000 and out["m"] <= 3 and abs(out["t"] - out["s"]) < 8_000


def test_mix_equals_sql(spark, docs, odd, empty):
    for df in (docs, docs.withColumn("source", F.lit("one")), odd, empty):
        got = mixing.mix_documents(df).orderBy("doc_id", "size", "taken").collect()
        pandas = df.select("doc_id", "text", "source").toPandas()
        con = duckdb.connect()
        con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        if len(pandas):
            con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [tuple(None if v is None or v != v else v for v in r) for r in pandas.itertuples(index=False)])
        want = con.sql(mixing.ORACLE).fetchall()
        key = lambda r: tuple((v is None, v) for v in r)
        assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_mix_comes_near_and_repeats(spark, docs):
    a, b = (sorted(map(tuple, mixing.mix_documents(d).collect())) for d in (docs, docs.repartition(3)))
    assert a == b
    rows = mixing.mix_documents(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 1 for r in rows)
    copies = mixing.materialise(docs, mixing.mix_documents(docs))
    assert copies.columns == docs.columns and copies.groupBy("doc_id").count().where("count > 3").isEmpty()


def test_word_count(spark):
    cases = ["", " ", "a", " a b ", "a\tb\nc\x0bd\x0ce\rf", "a\xa0b c", "  ", "é  日本 "]
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "text string")
    import re

    got = [r["n"] for r in df.select(mixing.word_count(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", c)) for c in cases] + [0]


def test_urls_equal_sql(spark):
    rnd = random.Random(1)
    hosts = ["WWW.Example.com", "example.com", "a.b.example.net", "bad.co.uk", "good.co.uk", "spam.org", "x.spam.org", "notexample.com", "", "a.co.kr", "b.co.kr:8080", "user@x.spam.org", "10.0.0.1", "10.0.0.2:80", "me.github.io", "co.uk", "x.me"]
    pages = [(i, f"{rnd.choice(['http', 'https'])}://{rnd.choice(hosts)}{rnd.choice(['/en/', '/es/x', '/fr/', '', '/', '?q=/en/', '#/es/', '/EN/'])}") for i in range(400)]
    pages += [(900, None), (901, "no scheme"), (902, "://"), (903, "a://b://c/d"), (904, "http://ex\nample.com/en/\n"), (905, "http://example.com:80/en/"), (904, "http://spam.org/")]
    labels = [(i, int("spam" not in u and rnd.random() < 0.9), int("bad" in u)) for i, u in pages[:400:2]] + [(900, None, None), (7, 1, None), (7, 1, 0)]
    p, q = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.sql("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in urls.judge(p, urls.page_outcomes(q)).collect()), key=key)
    assert got == sorted(con.sql(urls.ORACLE).fetchall(), key=key)
    verdicts = {r[1]: r[4] for r in got if r[3] is None}
    assert verdicts["x.spam.org"] == "block" and verdicts["a.b.example.net"] == "allow" and verdicts["good.co.uk"] == "allow"
    nobody = urls.judge(p, urls.page_outcomes(q.limit(0)))
    assert {r["verdict"] for r in nobody.where("rule is null").collect()} == {"allow"}
    assert urls.judge(p.limit(0), urls.page_outcomes(q)).count() == 0


def test_url_parts(spark):
    df = spark.createDataFrame([("HTTP://A.b/C?d#e",), ("x://y",), ("x://y#/z",), ("x",), (None,)], "u string")
    got = [tuple(r) for r in df.select(urls.host_of(F.col("u")), urls.path_of(F.col("u"))).collect()]
    assert got == [("a.b", "/C"), ("y", ""), ("y", ""), ("", ""), ("", "")]


def test_hosts_and_their_levels(spark):
    cases = {"a.b.co.kr": ("b.co.kr", "co.kr"), "www.x.com:8080": ("x.com", "com"), "u:p@w.github.io": ("w.github.io", "github.io"), "10.1.2.3:5": ("10.1.2.3", "ip"), "com": ("com", "com"), "": ("", ""), "x.co": ("x.co", "co"), "co": ("co", "co")}
    df = spark.createDataFrame([(h,) for h in cases], "h string").withColumn("name", urls.name_of(F.col("h")))
    assert {r[0]: (r[1], r[2]) for r in df.select("h", *urls._levels(F.col("name"))).collect()} == cases


def test_no_python_in_native_plans(spark, docs):
    for df in (licenses.scan(docs), urls.judge(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), urls.page_outcomes(docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("templates", [None, {"short": "two words", "long": licenses.LICENSES["mit-grant"]}])
def test_licenses_equal_brute_force(spark, odd, empty, templates):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    filler = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = []
    for i, (name, text) in enumerate(list(licenses.LICENSES.items()) * 6):
        own = text.split()
        if i % 3 == 1:
            own[rnd.randrange(len(own))] = "changed"
        if i % 3 == 2:
            own = own[: max(1, int(len(own) * rnd.random()))]
        rows.append((i, f"{filler(rnd.randrange(200))} {' '.join(own).upper() if i % 2 else ' '.join(own)}\n{filler(rnd.randrange(200))}"))
    rows += [(900, None), (901, ""), (902, "two, WORDS"), (903, "MIT")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(df, templates).collect())
    library = {n: licenses.template_shingles(t) for n, t in (templates or licenses.LICENSES).items()}
    import re

    want = []
    for i, t in rows:
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        for n, own in library.items():
            k = len(own[0].split(" "))
            grams = {" ".join(w[j : j + k]) for j in range(len(w) - k + 1)}
            hit = len(grams & set(own))
            if hit / len(own) >= 0.8:
                want.append((i, n, len(own), hit, hit / len(own)))
    assert got == sorted(want) and got
    if templates is None:
        con = duckdb.connect()
        con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        assert sorted(con.sql(licenses.oracle()).fetchall()) == got
    assert licenses.scan(odd, templates).count() == 0 and licenses.scan(empty, templates).count() == 0


def test_bands_miss_as_seldom_as_told(spark):
    """Windows that hold just 0.8 of a template of 40 shingles; few bands, so that misses show."""
    rnd = random.Random(3)
    template = " ".join(f"t{i}" for i in range(44))
    rows = []
    for i in range(300):
        own = template.split()
        own = own[:36] if i % 2 else own[8:]  # 32 of 40 shingles
        filler = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30, 120))]
        at = rnd.randrange(len(filler))
        rows.append((i, " ".join([*filler[:at], *own, *filler[at:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert licenses.miss(40, 0.8) < 2e-4 and licenses.miss(40, 1.0) < 2e-8 and licenses.miss(1, 1.0) == 0
    assert licenses.scan(df, {"t": template}).count() == 300
    for bands, rows_ in ((8, 2), (4, 1)):
        found = licenses.scan(df, {"t": template}, bands=bands, rows=rows_).count()
        assert 300 * (1 - 1.3 * licenses.miss(40, 0.8, bands, rows_)) <= found < 300


def test_hundreds_of_full_templates(spark, monkeypatch):
    rnd = random.Random(4)
    templates = {f"t{i}": " ".join(f"v{rnd.randrange(4000)}" for _ in range(rnd.randrange(1, 1200))) for i in range(500)}
    rows = [(i, " ".join(f"v{rnd.randrange(4000)}" for _ in range(50)) + " " + templates[f"t{i}"] + " more words after it") for i in range(0, 500, 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (licenses.TEMPLATES, 200):
        monkeypatch.setattr(licenses, "TEMPLATES", most)
        got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(df, templates).collect()}
        assert all(got[i, f"t{i}"] == 1.0 for i, _ in rows)


def test_license_in_a_long_text(spark):
    text = "word and other words " * 200_000 + licenses.LICENSES["mit-grant"]
    got = licenses.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [r["license"] for r in got] == ["mit-grant"] * 2

"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network carries token
capacity from patterns to source quotas: each pattern offers its tokens once, twice, up to ``repeats`` times, every
further repetition at a higher cost, so the flow of least cost repeats as little as the quotas allow. Then seeded
documents are selected: a pattern's full rounds take every document; of the last round, documents are taken in the
order of a seeded digest until its tokens are used up, the marginal document in part.

The network has one node per pattern and per source and is solved on the driver; ``MOST_PATTERNS`` bounds it. Where every
document has one source, each pattern gives its source's quota and no network is needed: then ``MOST_SOURCES`` bounds the
sources (beyond either bound an error says so). Per-document state never leaves the executors, and a source with most of
the rows is cut by buckets of a digest of (doc_id, size), not sorted in one task.

Defined cases: null and empty texts have size 0 and are never taken; texts of any length are counted whole; a null source
is a source of its own, last in order; repeated rows are separate documents (ties in the order fall to doc_id, then size;
equal rows share alike but for the marginal one); other columns, whatever their names, play no part; an empty table
gives no rows; if no words exist, every target is 0.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import LAST_ID, picked, stored

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, "mix-1"
MOST_PATTERNS, MOST_SOURCES = 10_000, 200_000
BUCKETS = 4096


def targets(sizes: Sequence[int], weights: Sequence[int], repeats: int = REPEATS) -> list[Fraction]:
    """Shares of the sum of ``sizes`` by weight, each at most ``repeats`` times its size, the excess reshared."""
    out = [Fraction(0)] * len(sizes)
    free, rest = sorted(range(len(sizes)), key=lambda i: Fraction(repeats * sizes[i], weights[i])), Fraction(sum(sizes))
    weight, at = sum(weights), 0
    while at < len(free):
        i = free[at]
        if repeats * sizes[i] * weight > rest * weights[i]:
            break
        out[i] = Fraction(repeats * sizes[i])
        rest -= out[i]
        weight -= weights[i]
        at += 1
    for i in free[at:]:
        out[i] = rest * weights[i] / weight
    return out


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow of least cost among the largest: successive shortest paths; ``edges`` are (from, to, capacity, cost)."""
    to, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in edges:
        out[a].append(len(to))
        to.append(b), room.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), room.append(0), cost.append(-w)
    while True:
        far, via, queued = {source: 0}, {}, {source}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                b = to[e]
                if room[e] and far[a] + cost[e] < far.get(b, 1 << 62):
                    far[b], via[b] = far[a] + cost[e], e
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if sink not in via:
            return [room[2 * i + 1] for i in range(len(edges))]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def route(capacity: dict[tuple, int], quota: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Tokens that each pattern gives (repeats counted) towards the quotas of the sources in it, at least repetition."""
    patterns, sources = list(capacity), list(quota)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(patterns) + len(sources)
    edges = [(0, 1 + i, capacity[p], 2**k - 1) for i, p in enumerate(patterns) for k in range(repeats)]
    edges += [(1 + i, node[s], repeats * capacity[p], 0) for i, p in enumerate(patterns) for s in p]
    edges += [(node[s], sink, quota[s], 0) for s in sources]
    flow = min_cost_flow(sink + 1, edges, 0, sink)
    return {p: sum(flow[i * repeats : (i + 1) * repeats]) for i, p in enumerate(patterns)}


def ordered_sources(names: list[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(names, key=lambda s: (s is None, s or ""))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """``docs``: doc_id, size, members (array of sources). Adds source_size and target (of the first member) and taken.

    ``docs`` is read several times and should be stored.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy("members").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).toArrow().to_pylist()
    capacity = {tuple(r["members"]): int(r["n"]) for r in sizes}
    apart = all(len(p) == 1 for p in capacity)
    if len(capacity) > (MOST_SOURCES if apart else MOST_PATTERNS):
        raise ValueError("too many membership patterns; group sources first")
    names = ordered_sources(list({s for p in capacity for s in p}))
    size = dict.fromkeys(names, 0)
    for p, c in capacity.items():
        for s in set(p):
            size[s] += c
    share = dict(zip(names, targets([size[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], repeats)))
    if len(names) and sum(size.values()) != sum(capacity.values()):  # overlaps: shares of the documents, not of memberships
        total = Fraction(sum(capacity.values()), max(1, sum(size.values())))
        share = {s: t * total for s, t in share.items()}
    quota = {s: int(t + Fraction(1, 2)) for s, t in share.items()}
    given = {p: quota[p[0]] for p in capacity} if apart else route(capacity, quota, repeats)
    rows = []
    for p, c in capacity.items():
        rounds, rest = divmod(given[p], c) if c else (0, 0)
        first = p[0] if p else None
        rows.append((list(p), rounds, rest, size.get(first, 0), float(share.get(first, 0))))
    plan = spark.createDataFrame(rows, "p array<string>, rounds long, rest long, source_size long, target double")
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string")))
    bucket = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    planned = docs.withColumn("digest", digest).withColumn("bucket", bucket).join(F.broadcast(plan), F.expr("members <=> p")).drop("p")
    by_bucket = planned.groupBy("members", "bucket", "rest").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("members").orderBy("bucket")) - F.col("n")
    cuts = by_bucket.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    cut = {tuple(r["members"]): (r["bucket"], int(r["before"])) for r in cuts.collect()}
    cut_rows = [(list(p), *cut.get(p, (-1, 0))) for p in capacity]
    cut_plan = spark.createDataFrame(cut_rows, "p array<string>, cut int, before long")
    marked = planned.join(F.broadcast(cut_plan), F.expr("members <=> p")).drop("p")
    full = F.col("rounds") * F.col("size")
    whole = marked.where("bucket != cut").withColumn("taken", full + F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0))
    running = F.sum("size").over(Window.partitionBy("members").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = marked.where("bucket = cut").withColumn("run", running + F.col("before"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - (F.col("run") - F.col("size"))))
    kept = ["doc_id", "size", "members", "source_size", "target", "taken"]
    return whole.select(*kept).unionByName(edge.withColumn("taken", full + part).select(*kept))


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a whole text; 0 for null. Words are counted where they start: a word sign after a blank."""
    blanked = F.translate(F.concat(F.lit(" "), text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.split(F.rtrim(blanked), " +")) - 1, F.lit(0)).cast("long")


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size (words of the whole text) and members of each document, stored: the texts are read once."""
    docs = picked(df, doc_id=(doc_id, T.LongType()), text=(text, T.StringType()), source=(source, T.StringType()))
    return stored(docs.select("doc_id", word_count(F.col("text")).alias("size"), F.array("source").alias("members")))


def mix_documents(df: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The mix of single-source documents: doc_id, size, source_size, target, taken."""
    return mix(sized(df), weights, repeats, seed).select("doc_id", "size", "source_size", "target", "taken")


def materialise(df: DataFrame, taken: DataFrame, source: str = "source") -> DataFrame:
    """``df``'s rows in the mix: each document as many times as it is taken, to the nearest whole number.

    ``taken`` has one row per document with doc_id, size and taken. A row of ``df`` is met by id and size; of rows alike in both,
    those of smaller text digests get the smaller numbers, so reruns agree.
    """
    key = ["_none", "_id", "_n"]
    named = lambda c: (c.isNull().alias("_none"), F.coalesce(c.cast("long"), F.lit(0)).alias("_id"))
    left = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *named(F.col("doc_id")), word_count(F.col("text")).alias("_n"))
    left = left.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_row.text"))))
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    right = taken.select(*named(F.col("doc_id")), F.col("size").alias("_n"), copies.alias("_copies"))
    right = right.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy("_copies"))).where("_copies > 0")
    met = left.join(right, [*key, "_i"])
    return met.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


#: The query in DuckDB SQL. A capped source is one of the first in order of size over weight.
ORACLE = f"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM docs GROUP BY source),
weighed AS (SELECT *, CASE i % 3 WHEN 1 THEN {WEIGHTS[0]} WHEN 2 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w FROM sources),
ranked AS (SELECT *, row_number() OVER (ORDER BY n * 1.0::DOUBLE / w, i) AS r, sum(n) OVER () AS total, sum(w) OVER () AS all_w FROM weighed),
run AS (SELECT *, total - {REPEATS} * coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  all_w - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM ranked),
stop AS (SELECT min(r) AS r FROM run WHERE {REPEATS} * n * rest_w > rest * w),
base AS (SELECT run.rest, run.rest_w, run.r FROM run JOIN stop USING (r)),
shares AS (SELECT run.source, run.n, CASE WHEN base.r IS NULL OR run.r < base.r THEN CAST({REPEATS} * run.n AS DOUBLE) ELSE CAST(base.rest * run.w AS DOUBLE) / CAST(base.rest_w AS DOUBLE) END AS target
  FROM run LEFT JOIN base ON true),
quotas AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM shares),
placed AS (SELECT d.doc_id, d.size, q.n AS source_size, q.target, q.quota,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(d.size AS VARCHAR)), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size + least(size, greatest(0, quota % source_size - before)) END AS BIGINT) AS taken FROM placed"""

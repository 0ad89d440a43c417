"""Language identification by cross-parsing entropy.

For each language, a suffix automaton is built over a bounded sample of labelled text: ``sample_docs`` (64) documents at
most, chosen by the least digests of (doc_id, text) in as many bins, so that copies of a document count once and every
language with a text of its own is learned; ``sample_bytes`` (24,000) bytes in all, each document giving an equal share
from a place chosen by its digest. Both bounds are parameters. A text is parsed from left to right into the longest
phrases that occur in a language's sample; with c phrases over n bytes and a sample of m bytes, c log2(m) / n estimates
the bits a byte needs given that language. The language of the fewest normalised phrases wins.

Automata of all languages form one transition table in which a failed step already restarts at the root and carries a
phrase mark, so that thousands of texts are parsed side by side with a few array operations a byte. Every text is
parsed whole, from its first byte to its last; when only a few long ones remain, each goes on by itself.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled text every text is
``und``; ties go to the first language in code-point order; a null doc_id counts as the text "null" in the fold;
repeated rows are judged alike; texts of any length are parsed whole; other columns, whatever their names, play no part
(with ``keep`` they pass through); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import picked, ranges, release, text_chunks

FOLDS, HELD_OUT = 5, 0
SAMPLE_BYTES, SAMPLE_DOCS = 24_000, 64
#: Bytes for which texts are laid side by side at once; below so many automata in step, each text goes on by itself.
STRIDE, FEW = 256, 64
UNKNOWN = "und"
#: Languages learned at most; more are an error, not dropped.
MOST_LANGUAGES = 400


class SuffixAutomaton:
    """The minimal automaton of all factors of a byte string, over symbols 0..."""

    def __init__(self, symbols: Iterable[int]) -> None:
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.step = step


def _folded() -> np.ndarray:
    """Bytes as parsed: A-Z as a-z, digits alike, other ASCII signs alike, white space and controls as a blank."""
    out = np.arange(256)
    out[:33] = 32
    out[33:128] = 33
    out[48:58] = 48
    for c in range(26):
        out[65 + c] = out[97 + c] = 97 + c
    return out


FOLD = _folded()


@dataclass
class Model:
    """Languages with one joint transition table (next row << 1 | a phrase begins)."""

    languages: list[str]
    symbol: np.ndarray
    table: np.ndarray
    width: int
    roots: np.ndarray
    bits: np.ndarray


def learn(texts: dict[str, bytes]) -> Model:
    languages = sorted(texts)
    folded = {k: FOLD[np.frombuffer(texts[k], np.uint8)] for k in languages}
    seen = np.unique(np.concatenate([*folded.values(), [32]]))
    number = np.full(256, len(seen))  # the last symbol is any byte never learned
    number[seen] = np.arange(len(seen))
    symbol, width = number[FOLD].astype(np.uint8), len(seen) + 1
    blocks, roots, base = [], [], 0
    for k in languages:
        steps = SuffixAutomaton(number[folded[k]].tolist()).step
        state = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
        c = np.fromiter((x for s in steps for x in s), np.int64, len(state))
        to = np.fromiter((x for s in steps for x in s.values()), np.int64, len(state))
        start = np.zeros(width, np.int64)  # where the phrase that a byte begins leads; the root for a byte never seen
        own = state == 0
        start[c[own]] = to[own]
        block = np.empty((len(steps), width), np.int64)
        block[:] = ((base + start) * width << 1 | 1)[None, :]
        block[state[~own], c[~own]] = (base + to[~own]) * width << 1
        blocks.append(block)
        roots.append(base * width)
        base += len(steps)
    if base * width >= 1 << 30:
        raise ValueError("samples too large for one table; lower the bytes a language")
    table = np.concatenate(blocks).astype(np.int32).ravel() if blocks else np.zeros(0, np.int32)
    sizes = np.array([max(2, len(texts[k])) for k in languages])
    return Model(languages, symbol, table, width, np.array(roots, np.int32), np.log2(sizes))


def phrases(model: Model, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Phrases of each text (row) under each language (column)."""
    langs = len(model.languages)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    out = np.zeros((len(size), langs), np.int64)
    symbols = model.symbol[raw]
    for lane in range(0, len(order), 4096):
        doc = order[lane : lane + 4096]
        start, n = at[:-1][doc], size[doc]
        state = np.repeat(model.roots[:, None], len(doc), 1)
        count = np.zeros((langs, len(doc)), np.int64)
        done = 0
        while True:
            k = int(np.searchsorted(-n, -done))  # texts longer than what is done
            if k * langs < FEW:
                break
            width = min(STRIDE, int(n[0]) - done)
            own = np.minimum(n[:k] - done, width)
            grid = np.zeros((k, width), np.uint8)
            grid.ravel()[ranges(np.arange(k) * width, own)] = symbols[ranges(start[:k] + done, own)]
            grid = np.ascontiguousarray(grid.T)
            active = np.searchsorted(-own, -np.arange(1, width + 1), side="right").tolist()
            for i, j in enumerate(active):
                taken = model.table.take(state[:, :j] + grid[i, :j])
                count[:, :j] += taken & 1
                state[:, :j] = taken >> 1
            done += width
        table = memoryview(model.table)
        for j in range(k):
            rest = symbols[start[j] + done : start[j] + n[j]].tobytes()
            for lang in range(langs):
                s, c = int(state[lang, j]), 0
                for x in rest:
                    s = table[s + x]
                    c += s & 1
                    s >>= 1
                count[lang, j] += c
        out[doc] = count.T
    return out


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))), F.lit(folds))


def samples(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """At most ``sample_bytes`` of labelled text a language from at most ``sample_docs`` documents outside the held-out fold."""
    docs = picked(df, doc_id=(doc_id, T.LongType()), text=(text, T.StringType()), lang=(lang, T.StringType()))
    learnable = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    drawn = learnable.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw")).withColumn("bin", F.pmod("draw", F.lit(sample_docs)).cast("int"))
    least = drawn.select("lang", "bin", "draw").groupBy("lang", "bin").agg(F.min("draw").alias("draw"))
    chosen = least.limit(MOST_LANGUAGES * sample_docs + 1).toArrow().to_pylist()
    of: dict[str, list[int]] = {}
    for r in chosen:
        of.setdefault(r["lang"], []).append(r["draw"])
    if len(of) > MOST_LANGUAGES or len(chosen) > MOST_LANGUAGES * sample_docs:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not of:
        return {}
    rows = [(k, d, max(1, sample_bytes // len(own))) for k, own in of.items() for d in own]
    wanted = df.sparkSession.createDataFrame(rows, "lang string, draw long, each int")
    met = drawn.join(F.broadcast(wanted), ["lang", "draw"])  # bounded: languages x sample_docs
    place = F.pmod(F.xxhash64("draw", F.lit("place")), F.greatest(F.lit(1), F.length("text") - F.col("each") + 1))
    parts = met.select("lang", "draw", "each", F.substring("text", (place + 1).cast("int"), F.col("each")).alias("part"))
    parts = parts.groupBy("lang", "draw").agg(F.min("part").alias("part"), F.min("each").alias("each"))  # copies of a row count once
    out: dict[str, list[bytes]] = {}
    for r in sorted(parts.toArrow().to_pylist(), key=lambda r: (r["lang"], r["draw"])):
        out.setdefault(r["lang"], []).append(r["part"].encode()[: r["each"]])
    joined = {k: b"\n".join(own)[:sample_bytes] for k, own in out.items()}
    return {k: t for k, t in joined.items() if t.strip()}


def identify(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred and score; with ``keep``, ``df``'s own columns with ``_lang_pred`` and ``_score`` (no shuffle either way)."""
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by languages x sample bytes
    own = df.columns if keep else [doc_id]
    names = ("_lang_pred", "_score") if keep else ("lang_pred", "score")
    chosen = df.select(*(F.col(f"`{c}`") for c in own), F.col(text).cast("string").alias("_text"), letters.alias("_letters"))
    fields = [chosen.schema[c] for c in own] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]

    def run(batches):
        release()
        m = shared.value
        languages = pa.array([*m.languages, UNKNOWN], pa.string())
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, len(m.languages)), np.zeros(n)
            known = batch.column(len(own) + 1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, raw, at in text_chunks(batch.column(len(own)), 1 << 21):
                if not m.languages or not known[a:b].any():
                    continue
                size = np.maximum(np.diff(at), 1)
                entropy = phrases(m, raw, at) * m.bits / size[:, None]
                first = entropy.argmin(1)
                low = entropy[np.arange(b - a), first]
                rest = entropy.copy()
                rest[np.arange(b - a), first] = np.inf
                other = rest.min(1) if entropy.shape[1] > 1 else np.full(b - a, m.bits.max())
                sure = 1 - low / np.maximum(low + other, 1e-300)
                best[a:b] = np.where(known[a:b], first, len(m.languages))
                score[a:b] = np.where(known[a:b], np.clip(sure, 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), languages.take(pa.array(best)), pa.array(score)], names=[f.name for f in fields])
        release()

    return chosen.mapInArrow(run, T.StructType(fields))


def predict_languages(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the folds that aren't held out."""
    docs = picked(df, doc_id=("doc_id", T.LongType()), text=("text", T.StringType()))
    out = identify(docs, learn(samples(df)))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")

"""The pipeline's stages, one after the other, on a small corpus."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_similar import plain_first
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from coppice.llm import mixing
from coppice.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, now = {}, docs
    for name, stage in pipeline.STAGES:
        now = stored(stage(spark, now, ""))
        out[name] = now
    return out


def test_columns(stages, docs):
    for name, _ in pipeline.STAGES[:-1]:
        assert stages[name].columns == docs.columns


def test_language_id_keeps_all_with_letters(stages, corpus):
    kept = {r["doc_id"] for r in stages["language_id"].collect()}
    assert kept == {i for i, t, *_ in corpus if t and any(c.isalpha() for c in t)}


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["language_id"].collect()]
    kept = {r["doc_id"] for r in stages["near_duplicates"].collect()}
    assert kept == plain_first(rows) and len(kept) < len(rows)


def plain_cuts(rows: list[tuple[int, str]], length: int = 100) -> dict[int, str]:
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return {i: t for i, t in out.items() if t.strip(" ")}


def test_repeats_go(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["near_duplicates"].collect()]
    after = {r["doc_id"]: r["text"] for r in stages["suffix_dedup"].collect()}
    assert after == plain_cuts(before)
    assert sum(len(t) for _, t in before) - sum(map(len, after.values())) > 500
    assert all(r["n_chars"] == len(r["text"]) for r in stages["suffix_dedup"].collect())


def test_mix_comes_near_its_targets(stages):
    before = stages["suffix_dedup"].collect()
    sources = mixing.ordered_sources(list({r["source"] for r in before}))
    size = lambda rows, s: sum(len(r["text"].split()) for r in rows if r["source"] == s)
    wanted = mixing.targets([size(before, s) for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))])
    after = stages["mixing"].collect()
    for s, want in zip(sources, wanted):
        largest = max(len(r["text"].split()) for r in before if r["source"] == s)
        assert abs(size(after, s) - float(want)) <= largest / 2 + 1


def test_mix_repeats_whole_documents(stages):
    before = {r["doc_id"]: r["text"] for r in stages["suffix_dedup"].collect()}
    rows = stages["mixing"].collect()
    assert rows and all(before[r["doc_id"]] == r["text"] for r in rows)
    assert stages["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_packed(stages):
    rows = stages["packing"].collect()
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in stages["mixing"].collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        head = len(ids) if len(ids) <= 2048 else (len(ids) - 1) % 2048 + 1
        for k, a in enumerate([0, *range(head, len(ids), 2048)]):
            part = ids[a : head if k == 0 else a + 2048]
            want[r["doc_id"], k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == want
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1
    assert sum(1 for r in rows if r["piece"] == 0) == stages["mixing"].count()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_odd_tables(spark, odd, empty):
    for df in (odd, empty):
        now = df
        for _, stage in pipeline.STAGES:
            now = stored(stage(spark, now, ""))
        assert now.count() <= 5


def test_repeated_ids(spark, odd):
    kept = pipeline.near_duplicates(spark, odd, "")
    assert kept.where("doc_id = 1").count() == 2 and kept.columns == odd.columns

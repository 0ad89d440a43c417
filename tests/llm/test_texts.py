"""Fingerprints, token counts, packing and languages against plain versions."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coppice.llm import fingerprints as fp
from coppice.llm import bytebpe, langid, packing, tokens
from coppice.llm.bytebpe import ByteBpe
from coppice.llm.common import release

BPE = public_tokenizers.path("byte_bpe_50k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")


def entropy_rank(window: bytes) -> int:
    total = int(sum(fp._G[window.count(b)] for b in set(window)))
    e = 1000 - (total * 1000 + 64 * 3 * fp.FIXED) // (64 * 6 * fp.FIXED)
    return int(fp._RANK[min(max(e, 0), 1000)])


def plain_features(text: bytes) -> list[int]:
    ranks = [entropy_rank(text[i : i + 64]) for i in range(len(text) - 63)]
    votes = [0] * len(ranks)
    for j in range(len(ranks)):
        span = ranks[j : j + 64]
        votes[j + span.index(min(span))] += 1
    chosen = [i for i, v in enumerate(votes) if v >= 16]
    return chosen or ([votes.index(max(votes))] if votes else [])


def test_features_are_the_improbable_windows(corpus):
    for text in [t.encode() for _, t, *_ in corpus if t and 64 <= len(t) < 900][:25]:
        ranks = fp.window_ranks(np.frombuffer(text, np.uint8))
        assert ranks.tolist() == [entropy_rank(text[i : i + 64]) for i in range(len(text) - 63)]
        votes = fp.popularity(ranks)
        chosen = np.flatnonzero(votes >= 16).tolist() or [int(votes.argmax())]
        assert chosen == plain_features(text)


def test_blocks_do_not_show(monkeypatch):
    raw = np.frombuffer(random.Random(1).randbytes(3000), np.uint8) % 40 + 60
    ranks, votes = fp.window_ranks(raw), fp.popularity(fp.window_ranks(raw))
    monkeypatch.setattr(fp, "BLOCK", 256)
    assert (fp.window_ranks(raw) == ranks).all() and (fp.popularity(ranks) == votes).all()


def test_likeness():
    text = " ".join(random.Random(2).choices([str(i) * 3 for i in range(900)], k=900)).encode()
    a, b, c = fp.digests(*fp.joined([text, text[:-900] + text[:900], text[::-1]]))
    assert fp.likeness(a, a) == 1.0 and fp.likeness(b"", b"") == 1.0 and fp.likeness(a, b"") == 0.0
    assert fp.likeness(a, b) > 0.6 > 0.2 > fp.likeness(a, c)
    assert fp.likeness(a, b) == fp.likeness(b, a)


def plain_digest(text: bytes) -> bytes:
    """Features in text order, 160 a filter, five bits a feature."""
    mask = (1 << 64) - 1

    def mixed(x: int) -> int:
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask
        x = (x ^ x >> 29) * 0xA3B195354A39B70D & mask
        return x ^ x >> 32

    own = []
    for i in plain_features(text) if len(text) >= 64 else []:
        h = 0x9E3779B97F4A7C15
        for k in range(8):
            h = mixed(h ^ int.from_bytes(text[i + 8 * k : i + 8 * k + 8], "little"))
        own.append((i, h))
    own += [(i, int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")) for i, w in plain_finer(text)]
    first: dict[int, int] = {}
    for i, h in own:
        first[h] = min(i, first.get(h, i))
    ordered = [h for h, _ in sorted(first.items(), key=lambda x: (x[1], x[0]))]
    out = b""
    for a in range(0, len(ordered), 160):
        bits = {h >> 11 * k & 2047 for h in ordered[a : a + 160] for k in range(5)}
        out += bytes(sum(1 << 7 - j for j in range(8) if 8 * b + j in bits) for b in range(256))
    return out


def plain_finer(text: bytes) -> list[tuple[int, bytes]]:
    import math

    out = []
    for below, width, usual in fp.FINER:
        if len(text) >= below or len(text) < width:
            continue
        ranks = []
        for i in range(len(text) - width + 1):
            w = text[i : i + width]
            total = sum(round(math.log2(w.count(b)) * fp.FIXED) for b in w)
            e = 1000 - total * 1000 // int(width * math.log2(width) * fp.FIXED)
            ranks.append(1001 if e < fp.LEAST else round(1000 * math.exp(-(((e - usual) / fp.SPREAD) ** 2) / 2)))
        votes = [0] * len(ranks)
        for j in range(len(ranks)):
            span = ranks[j : j + width]
            votes[j + span.index(min(span))] += 1
        out += [(i, text[i : i + width]) for i, v in enumerate(votes) if v >= max(1, width // 4)]
    return out or ([(0, text)] if 0 < len(text) < 4 else [])


def plain_likeness(a: bytes, b: bytes) -> float:
    if a == b or not a or not b:
        return float(a == b)
    sets = lambda d: [{i for i in range(2048) if d[256 * f + i // 8] >> 7 - i % 8 & 1} for f in range(len(d) // 256)]
    x, y = sets(a), sets(b)

    def towards(x, y):
        score = sum(len(p) * max(0.0, *((len(p & q) - len(p) * len(q) / 2048) / (min(len(p), len(q)) - len(p) * len(q) / 2048) for q in y)) for p in x)
        return score / sum(map(len, x))

    if len(x) == len(y):
        return (towards(x, y) + towards(y, x)) / 2
    return towards(x, y) if len(x) < len(y) else towards(y, x)


def test_digests_and_likeness_equal_a_plain_version(corpus):
    texts = [t.encode() for _, t, *_ in corpus if t and len(t) < 1500][:40] + [b"a", b"abc", b"abcd", b"ab" * 40]
    got = fp.digests(*fp.joined(texts))
    assert got == [plain_digest(t) for t in texts]
    for a, b in zip(got, [*got[1:], got[0]]):
        assert abs(fp.likeness(a, b) - plain_likeness(a, b)) < 1e-9


def test_short_texts_keep_their_likeness():
    """Texts of 40 to 600 bytes that are three quarters equal are seen as near, others aren't."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9)))
    for size in (40, 60, 90, 105, 130, 250, 520, 600):
        near, far = [], []
        for _ in range(40):
            a, b = (" ".join(word() for _ in range(150))[:size] for _ in range(2))
            cut = size // 4
            x, y, z = fp.digests(*fp.joined([a.encode(), (a[: size - cut] + b[:cut]).encode(), b.encode()]))
            near.append(fp.likeness(x, y))
            far.append(fp.likeness(x, z))
        assert np.mean(near) > 0.45 and np.mean(near) > np.mean(far) + 0.35, size


def test_one_long_text_among_short_ones(spark):
    rnd = random.Random(8)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300_000))
    rows = spark.createDataFrame([(1, "short one"), (2, long), (3, "short two")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fp.compare_edited(rows).collect()}
    assert got[2]["n_chars"] == len(long) and got[2]["near_edited"] > 0.9 and got[2]["near_next"] < 0.6


def test_edited_texts(spark, docs, corpus):
    got = {r["doc_id"]: r for r in fp.compare_edited(docs).collect()}
    order = sorted(corpus)
    assert len(got) == len(order)
    for mine, after in zip(order, order[1:] + order[:1]):
        t, n = mine[1] or "", after[1] or ""
        cut = len(t) // 4
        edited = (t[: len(t) - cut] + n[:cut]).encode()
        r = got[mine[0]]
        own, new, follow = fp.digests(*fp.joined([t.encode(), edited, n.encode()]))
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.encoded(own), fp.encoded(new))
        assert r["near_edited"] == fp.likeness(own, new) and r["near_next"] == fp.likeness(own, follow)


def test_edited_texts_odd(odd, empty, spark):
    rows = fp.compare_edited(odd).collect()
    assert len(rows) == 5 and {r["n_chars"] for r in rows if r["doc_id"] is None} == {0, 12}
    assert fp.compare_edited(empty).count() == 0
    one = fp.compare_edited(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fp.fingerprints(odd).select("fingerprint").count() == 5


ALPHABET = " \n\t'sabltedmrv1²é_!  日😀\r▁<|>"


def random_texts(n: int) -> list[str]:
    rnd = random.Random(5)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_byte_bpe_equals_the_library(corpus):
    texts = [t or "" for _, t, *_ in corpus] + random_texts(1500) + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "'s 've'll !'s\n's"]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    own = ByteBpe(BPE)
    for _ in range(2):  # new and known pre-tokens
        ids, counts = own.encode(texts)
        at = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_byte_bpe_table_starts_anew(monkeypatch, corpus):
    monkeypatch.setattr("coppice.llm.bytebpe.KEPT", 64)
    texts = [t or "" for _, t, *_ in corpus]
    ids, counts = ByteBpe(BPE).encode(texts)
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))


def thue_morse(n: int) -> str:
    """A word of 2^n letters; it and its complement have one value under every polynomial hash modulo 2^64."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_equal_hashes_are_told_apart(monkeypatch):
    library = Tokenizer.from_file(BPE)
    for longest in (256, 1 << 14):
        monkeypatch.setattr("coppice.llm.bytebpe.LONG", longest)
        own = ByteBpe(BPE)
        for n in (10, 11, 12, 13):
            word = thue_morse(n)
            other = word.translate(str.maketrans("ab", "ba"))
            for texts in ([word, other], [other + " " + word, word], [other]):
                ids, _ = own.encode(texts)
                assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_long_pretokens_take_no_memory():
    own = ByteBpe(BPE)
    rnd = random.Random(9)
    for _ in range(100):
        own.encode([" ".join("".join(rnd.choices("abcdefgh", k=10)) * 1000 for _ in range(10))])
    assert own.used < 50 and own.ids.nbytes + own.points.nbytes < 1 << 20
    whole = tokens.WholeTokens(SP)
    before = len(whole.kept)
    for _ in range(50):
        assert whole.tokens("".join(rnd.choices("abcdefgh", k=1000))) > 1
    assert len(whole.kept) == before


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr("coppice.llm.bytebpe.PART", 50)
    library, own, rnd = Tokenizer.from_file(BPE), ByteBpe(BPE), random.Random(10)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(900))) for _ in range(100)] + ["x" * 400, "a<|endoftext|>b " * 40]
    ids, counts = own.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))


def test_token_counts_equal_the_library(spark, docs, corpus, odd, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=SP)
    whole = tokens.WholeTokens(SP)
    for t in random_texts(3000):
        assert whole.tokens(t) == len(model.encode(t)), repr(t)
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, SP, limit=100).collect()}
    for i, t, *_ in corpus:
        n = len(model.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert tokens.count_tokens(odd, SP).count() == 5 and tokens.count_tokens(empty, SP).count() == 0


def test_whole_tokens_are_proven():
    whole = tokens.WholeTokens(SP)
    assert len(whole.whole) > 10_000
    some = random.Random(3).sample(sorted(whole.whole), 300)
    assert all(len(ids) == 1 for ids in whole.model.encode(some))


def test_kept_counts_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 5)
    whole = tokens.WholeTokens(SP)
    for t in random_texts(300):
        assert whole.tokens(t) == len(whole.model.encode(t))


def check_bins(counts, capacity):
    bins = packing.best_two_fit(counts, capacity)
    placed: dict[int, int] = {}
    for b in bins:
        assert sum(b.lengths) <= capacity and b.times > 0
        for n in b.lengths:
            placed[n] = placed.get(n, 0) + b.times
    assert placed == {n: c for n, c in counts.items() if c}
    return sum(b.times for b in bins)


def test_best_two_fit():
    assert check_bins({6: 1, 5: 2, 4: 1}, 10) == 2
    assert check_bins({7: 1, 2: 1, 1: 1, 5: 1, 4: 1, 3: 1}, 11) == 2
    assert check_bins({}, 5) == 0
    rnd = random.Random(4)
    for _ in range(200):
        capacity = rnd.randrange(5, 60)
        counts = {rnd.randrange(1, capacity + 1): rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 12))}
        used = check_bins(counts, capacity)
        total = sum(n * c for n, c in counts.items())
        assert used <= max(1, -(-total * 3 // (2 * capacity))) + 1


def test_the_smallest_gives_way_to_two():
    bins = packing.best_two_fit({60: 1, 30: 1, 22: 1, 17: 1}, 100)  # 60 + 30, then 30 for 22 + 17
    assert sorted(bins[0].lengths) == [17, 22, 60]


def test_packing(spark, docs, corpus):
    got = packing.pack(docs, BPE, with_ids=True).orderBy("sequence_id", "offset").collect()
    tokenizer = Tokenizer.from_file(BPE)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in corpus}
    by_doc: dict[int, list] = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert sum(r["length"] for r in pieces) == len(ids[i])
        assert all(r["length"] == 2048 for r in pieces[1:]) and (len(pieces) == 1) == (len(ids[i]) <= 2048)
    assert set(by_doc) == set(ids)
    end: dict[int, int] = {}
    for r in got:
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(end.values()) <= 2048 and len(end) <= -(-sum(map(len, ids.values())) // 2048) + 1
    whole = packing.sequences(spark.createDataFrame(got, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"))
    assert {r["sequence_id"]: len(r["ids"]) for r in whole.collect()} == end


def test_packing_odd(odd, empty):
    rows = packing.pack(odd, BPE).collect()
    assert len(rows) == 5 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5
    assert packing.pack(empty, BPE).count() == 0


def test_phrases(monkeypatch):
    rnd = random.Random(8)
    texts = {k: "".join(rnd.choice(s) for _ in range(700)).encode() for k, s in (("a", "abcé "), ("b", "abdx "))}
    model = langid.learn(texts)
    queries = ["".join(rnd.choice("abcdéxyz ") for _ in range(rnd.randrange(1, 1500))).encode() for _ in range(20)]
    got = langid.phrases(model, *fp.joined(queries))
    for row, q in zip(got, queries):
        joint = [plain(model, texts[k], q) for k in ("a", "b")]
        assert row.tolist() == joint
    for stride, few in ((7, 1), (16, 11), (512, 10**6)):
        monkeypatch.setattr(langid, "STRIDE", stride)
        monkeypatch.setattr(langid, "FEW", few)
        assert (langid.phrases(model, *fp.joined(queries)) == got).all()
    long = "".join(rnd.choice("abcdé ") for _ in range(400_000)).encode()
    assert langid.phrases(model, *fp.joined([long]))[0].tolist() == [plain(model, texts[k], long) for k in ("a", "b")]


def plain(model, sample: bytes, text: bytes) -> int:
    own, t = model.symbol[np.frombuffer(sample, np.uint8)].tobytes(), model.symbol[np.frombuffer(text, np.uint8)].tobytes()
    total = at = 0
    while at < len(t):
        end = at + 1
        while end <= len(t) and t[at:end] in own:
            end += 1
        total, at = total + 1, max(at + 1, end - 1)
    return total


def test_sparse_languages_are_learned(spark):
    """One language of 40,000 rows of which ten have text; another under one null id; a third once, in a long text."""
    rows = [(i, None if i % 4000 else "der hund und die katze gehen zum fluss", "de") for i in range(40_000)]
    rows += [(None, "the dog and the cat walk to the river", "en")] * 50 + [(50_001, "le chien et le chat vont à la rivière " * 3000, "fr"), (50_003, "?!", "zz")]
    got = langid.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"de", "en", "fr"} and all(0 < len(t) <= langid.SAMPLE_BYTES for t in got.values())
    assert b"hund" in got["de"] and got["en"].count(b"dog") == 1 and len(got["fr"]) > 20_000
    few = langid.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=100, sample_docs=2)
    assert all(len(t) <= 100 for t in few.values())


def test_suffix_automaton_accepts_exactly_the_factors():
    text = [0, 1, 0, 0, 1, 1, 0, 2, 0, 1]
    step = langid.SuffixAutomaton(text).step
    factors = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    rnd = random.Random(1)
    for _ in range(500):
        word = tuple(rnd.randrange(3) for _ in range(rnd.randrange(6)))
        at = 0
        for c in word:
            at = step[at].get(c, -1) if at >= 0 else -1
        assert (at >= 0) == (word in factors)


def test_languages(spark, odd, empty):
    rnd = random.Random(6)
    speech = {"en": "the and of that this with from house river walked", "de": "der und die das mit von haus fluss ging über", "fr": "le et la les avec de maison rivière était à"}
    rows = [(i, " ".join(rnd.choice(speech[k].split()) for _ in range(40)), k) for i in range(300) for k in [("en", "de", "fr")[i % 3]]]
    rows += [(1000, None, "en"), (1001, "12345 !!", "en"), (1002, "", None), (1003, "the house and the river " * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict_languages(df).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in got.items() if r["held_out"]) == sorted(held)
    right = [got[i]["lang_pred"] == k for i, _, k in rows[:300] if i in held]
    assert len(right) > 30 and np.mean(right) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict_languages(odd).count() == 5 and langid.predict_languages(empty).count() == 0


def test_held_out_labels_change_nothing(spark):
    rows = [(i, "der hund und die katze " * 3 if i % 2 else "the dog and the cat " * 3, "de" if i % 2 else "en") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = df.withColumn("lang", F.when(langid.fold(F.col("doc_id")) == 0, "zz").otherwise(F.col("lang")))
    key = lambda r: r["doc_id"]
    assert sorted(langid.predict_languages(df).collect(), key=key) == sorted(langid.predict_languages(wrong).collect(), key=key)


def test_a_worker_keeps_one_operators_table():
    own = bytebpe.coder(BPE)
    release(keep=True)
    assert bytebpe.coder(BPE) is own
    release()
    assert bytebpe.coder(BPE) is not own


def test_a_coder_is_small_however_many_words_it_saw():
    rnd = random.Random(4)
    texts = [" ".join(f"{rnd.getrandbits(32):x}" for _ in range(1000)) for _ in range(700)]
    bytebpe.classes.cache_clear()
    tracemalloc.start()
    own = ByteBpe(BPE)
    bytebpe.classes()
    built = tracemalloc.get_traced_memory()[1]
    counts = [own.encode(texts[at : at + 20])[1].tolist() for at in range(0, 700, 20)]
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert built < 80 << 20 and held < 40 << 20
    library = Tokenizer.from_file(BPE)
    assert sum(counts, [])[-20:] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts[-20:]]

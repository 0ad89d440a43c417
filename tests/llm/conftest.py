from __future__ import annotations

import random

import pytest

WORDS = ["the", "river", "house", "of", "and", "walked", "Green", "stone", "über", "naïve", "日本", "won't", "3.14", "light", "a", "to"]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, empty, null, long and odd texts."""
    rnd = random.Random(11)
    sentence = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))
    passage = sentence(45)
    texts: list[str | None] = [sentence(rnd.randrange(3, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7] + " end", texts[9].replace("river", "rivers", 1), "", None, "   \n\t ", "word", "was " * 90, "x" * 500, "x" * 500]
    texts += [sentence(20) + " " + passage + " " + sentence(20) for _ in range(6)] + [passage, sentence(3000), "\x0b\x0c café it's ﻿<s> <|endoftext|> 日本語 " * 3]
    ids = list(range(0, 3 * len(texts), 3))
    rnd.shuffle(ids)
    sources = ["b", "a", None, "c", "é"]
    return [(i, t, rnd.choice(["en", "de", None]), rnd.choice(sources[: 1 + i % 5]), None if t is None else len(t)) for i, t in zip(ids, texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, ids repeated with other texts, and columns with names that operators use inside."""
    rows = [(1, "same words here again and again", None, None, 1), (1, "same words here again and again", None, None, 1), (1, "other words under the same id", "en", "s", 2), (None, "no id at all", "en", "s", 3), (None, None, None, None, None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("k", "h", "p", "kept", "fps", "size", "taken", "bucket", "_lang_pred", "_id", "_copies", "members", "lang_pred", "ids", "hits"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

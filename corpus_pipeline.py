"""A corpus pipeline of five stages: each takes the documents that the one before kept.

1. ``language_id``: documents without a recognisable language (no text, no letter) go.
2. ``near_duplicates``: documents of a Jaccard similarity of 0.8 or more in five-word shingles link (found by SimHash, verified);
   of each group the document of the smallest id stays.
3. ``suffix_dedup``: strings of 100 bytes that occur earlier are cut out; documents left without text go.
4. ``mixing``: documents are repeated or left out so that sources come near their target weights.
5. ``packing``: the mix is tokenised and packed into sequences of 2,048 tokens; the rows are the placed pieces.

Stages 1 to 4 return the columns of documents. Null ids count as larger than any other.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.llm import langid, mixing, packing, simhash, suffixes
from coppice.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def over_plain_names(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Columns beyond those of documents pass through a stage under plain names, so that none can clash with its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in COLUMNS else f"x{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(docs.columns, plain))), sf_dir)
        return out.select(*(F.col(p).alias(c) for c, p in zip(docs.columns, plain)))

    return run


@over_plain_names
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(langid.samples(docs))
    judged = langid.identify(docs, model, keep=True)
    kept = judged.where(F.col("_lang_pred") != langid.UNKNOWN) if model.languages else judged
    return kept.select(*docs.columns)


@over_plain_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles; documents link from a Jaccard similarity of 0.8. Of rows of one id with equal text one stays."""
    gone = simhash.similar_rows(docs)
    keyed = docs.select("*", *simhash.row_key(F.col("doc_id"), F.col("text")))
    kept = simhash.without(keyed, gone)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept.select(*docs.columns)
    twin = Window.partitionBy("none", "k", "h").orderBy("h")
    return kept.withColumn("i", F.row_number().over(twin)).where("i = 1").select(*docs.columns)


@over_plain_names
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(docs).where(F.length(F.trim("kept")) > 0)
    out = out.withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@over_plain_names
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialise(docs, mixing.mix_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("suffix_dedup", suffix_dedup), ("mixing", mixed), ("packing", packed)]

#: The stages train a model, merge tokens and sort suffixes, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. ``language``: documents of which the language model tells no language (no letters at all) go; a null lang is filled in.
2. ``exact_dedup``: of equal texts, the one with the largest doc_id stays.
3. ``near_dedup``: of documents linked by 5-word shingles at a similarity of 0.75 or more, directly or over
   others, the one with the smallest doc_id stays.
4. ``mixture``: sources take their target shares of words; a document is left out, stays once or stands twice. Documents are not
   cut: a copy is in if at least half of its words are. Shards of the splitting tree are partitions, shuffled.
5. ``packing``: sequences of 4096 tokens; one row a piece, with its ids.

Stages 1 to 4 return the columns of documents, extra ones with any name included.

Defined results, for every stage: empty input gives empty output. A null text counts as empty: it goes in stage 1, is one group of equal texts in stage 2,
is linked with nothing in stage 3, has no words and is not drawn in stage 4, and is its end id alone in stage 5. A null doc_id ranks lowest in stage 2 and
last in stage 3; rows without ids are rows of their own, told apart by their text. Rows that repeat a doc_id with other
texts are documents of their own; rows that repeat both are one document in stage 2 and 3, and each drawn and packed in stage 4 and 5. A null source is a source of its
own. Ties (equal ids) go by the text's digest in stage 3. Very long texts are read whole by every stage; one is cut into many pieces in stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import language_id, mixing, ngram_join, packing, stream_dedup
from riskloom.llm.common import shared_dir, small_batches, written
from riskloom.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cols = docs.columns
    with small_batches(spark):
        model = language_id.learn(docs)
    told = language_id.predict(docs, model, carry=cols, prefix="_in_").where("lang_pred <> 'und'")
    return told.select(*[F.coalesce("_in_lang", "lang_pred").alias(c) if c == "lang" else F.col(f"_in_{c}").alias(c) for c in cols])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stream_dedup.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.kept_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096)


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("packing", pack)]

#: The language model, hashing orders and the tokenizer are beyond SQL; tests/llm/test_edges.py and test_mixture.py hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

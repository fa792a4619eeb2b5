"""A training corpus from documents: five stages, each by one of the operators, written between stages.

    toxicity              documents that score as toxic go; the model learns from labelled rows of the stage's input
    near_dedup            one document of each near-duplicate class stays (five-word shingles, similarity about 0.8)
    decontamination       documents that hold a benchmark item go
    mixing                documents as often as the mix of sources takes them
    tokens                token ids of the mix in sorted-string-table shards, read back: one row a document

Every stage works on all rows that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesmill.llm import decontaminate, mixing, simhash, tokens
from seriesmill.llm import toxicity as tox
from seriesmill.llm.common import drop, materialise, table
from seriesmill.llm.queries import quality_weight, tokenizer_file

#: Words that a worker's cache of the last stage may hold: less than tokens alone has, since workers and executors
#: come with the memory of the stages before.
WORDS = 200_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the compression-distance model scores as toxic."""
    return tox.drop_toxic(docs, tox.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id."""
    return simhash.keep_one(docs, simhash.similar_documents(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them: whole epochs, then those that the fractional epoch reaches."""
    rows = materialise(quality_weight(mixing.narrow(docs), table(spark, sf_dir, "labels")), "mix-rows")
    return mixing.take(docs, mixing.mix(rows, weight="__sm_weight", size="words"))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the mix, from shards that were written and read back."""
    return tokens.token_table(docs, tokenizer_file("word_bpe_49k.json"), words=WORDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("tokens", token_shards),
]
#: Compression, tokenizing and linking aren't SQL: the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(last)  # a consumed stage; documents itself isn't one
    return STAGES[-1][1](spark, docs, sf_dir)

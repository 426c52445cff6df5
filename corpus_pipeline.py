"""A training corpus in five stages, each written as Parquet and read again as the next one's documents.

language_id: a model of the labelled documents names every document's language, which becomes its `lang`; documents that it
can't place go: those without a letter, and those of which the likeliest language has a probability under SURE.
line_dedup: of lines that are alike across the corpus one stays.
ngram_join: of documents that five-word shingles link (similarity 0.8) one stays. mixing: sources by weight, repeated or
cut to their targets. bpe: token ids (`ids`), from which the texts can be had again as the vocabulary allows.

Nulls: a null text goes in the first stage; a null lang is a label that is missing, and gets one; a null source is a source
of its own; rows without a doc_id, or that share one, are documents of their own in every stage (`mixing` repeats ids, once
for each epoch). Empty texts, and texts that line_dedup empties, go in `mixing`, which takes words. Of equal documents the
one of the smallest doc_id stays. An empty table gives an empty table. Columns beyond COLUMNS are left out by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.llm import bpe, language_id, line_dedup, mixing, ngram_join
from reliefgrid.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this probability no language is likelier than all others together.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = docs.select(*COLUMNS)
    return language_id.relabel(d, language_id.train(d), SURE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs.select(*COLUMNS))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.dedup_documents(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("ngram_join", dedup_documents), ("mixing", mix), ("bpe", encode)]

#: The first stages' decisions come from a trained classifier and from MinHash, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs

"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.llm import bpe, fingerprints, language_id, line_dedup, lm_scoring, mixing, ngram_join, periodic_runs, simhash, source_divergence, substring_dedup, token_counts, topk


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    found = language_id.identify(d, language_id.train(d.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(v, v.where("vec_id % 20 = 0"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(_documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix_sources(_documents(spark, sf_dir))
    return m.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), byte_fallback=True)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(_documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_runs(_documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_language_id, op3_exact_topk, op4_fingerprints, op5_substring_dedup, op6_bpe, op7_ngram_join, op8_mixing, op9_line_dedup, op10_token_counts, op11_simhash, op12_periodic_runs, op13_source_divergence, pipeline)
}

ORACLES: dict[str, str] = {
    "op1_lm_scoring": lm_scoring.SQL,
    "op3_exact_topk": topk.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op8_mixing": mixing.SQL,
    "op13_source_divergence": source_divergence.SQL,
}

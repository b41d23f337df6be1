"""The operators of this folder over the tables, as the driver calls them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm import bisectors, decontaminate, line_dedup, packing, pii, quality, revisits, sentencepiece_bpe, simhash, substring_dedup, token_files, toxicity, whitening
from meshwork.llm.rows import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digest(sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), decoded=True))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.digest(revisits.resolve(revisits.records_of(table(spark, sf_dir, "pages"))))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(token_files.round_trip(spark, table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(quality.statistics(docs), rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op11_bisector_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisectors.digest(bisectors.cluster(table(spark, sf_dir, "embeddings")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


QUERIES = (
    op1_sentencepiece, op2_warc_revisits, op3_decontamination, op4_simhash, op5_token_files, op6_toxicity, op7_quality_rules,
    op8_line_dedup, op9_suffix_dedup, op10_pii, op11_bisector_clustering, op12_whitening, op13_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": revisits.ORACLE_SQL, "op3_decontamination": decontaminate.ORACLE_SQL, "op11_bisector_clustering": bisectors.oracle()}

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import license_digest, line_spread, merkle, ngram_join, ordinal_quality, page_diff, pivot_topk, source_mix, spaced_seeds, spelling, token_counts, toxicity, warc
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_quality.rate_quality(docs, ordinal_quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens_of(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.drop_shared_lines(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan_licenses(table(spark, sf_dir, "documents"))


def op9_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract_pages(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ordinal_quality, op2_warc_chain, op3_token_counts, op4_line_spread, op5_source_mix, op6_spaced_seeds, op7_pivot_topk, op8_license_digest, op9_page_diff, op10_ngram_join, op11_spelling_variants,
        op12_toxicity, op13_merkle_manifest,
    )
}
SQL: dict[str, str] = {
    "op2_warc_chain": warc.SQL, "op4_line_spread": line_spread.SQL, "op5_source_mix": source_mix.SQL, "op7_pivot_topk": pivot_topk.SQL, "op8_license_digest": license_digest.sql(), "op11_spelling_variants": spelling.SQL,
    "op13_merkle_manifest": merkle.SQL,
}

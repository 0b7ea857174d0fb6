"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .common import table
from .completion import pack_best
from .langid import identify
from .licenses import scan_licenses
from .nbest import segment
from .packing import pack
from .quality import classify_quality
from .secrets import scan_secrets
from .simhash import simhash_components
from .spelling import ORACLE as SPELLING_ORACLE
from .spelling import spelling_variants
from .token_count import count_tokens
from .vector_dedup import vector_components
from .whitening import whiten

#: Where the tokenizers' vocabulary files are; never copied.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORD_BPE).drop("ids")


def op4_cross_polytope_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(table(spark, sf_dir, "documents"), PIECE_BPE)


def op8_posting_list_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best(table(spark, sf_dir, "documents"), BYTE_BPE).drop("ids")


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_site_quality, op2_language_mixture, op3_hilbert_packing, op4_cross_polytope_components, op5_secret_scan,
        op6_simhash_components, op7_nbest_pieces, op8_posting_list_neighbours, op9_license_scan, op10_token_count, op11_bin_completion, op12_tsqr_whitening, op13_anagram_variants,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op13_anagram_variants": SPELLING_ORACLE}

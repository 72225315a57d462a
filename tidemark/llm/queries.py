"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, divergence, fingerprints, line_dedup, merkle, mixing, search, secret_scan, sentence_pieces, simhash, token_files, toxicity, warc
from tidemark.llm.common import scratch, table, texts_of

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.documents_and_sources(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.site_lines(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), folder)
    read = token_files.read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.resolve_revisits(warc.read_archives(spark, folder, with_payload=False))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return bpe.bpe_digests(bpe.encode_and_decode(texts_of(table(spark, sf_dir, "documents")), path))


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.bm25_top_k(docs, docs.where("doc_id % 20 = 0"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.tampered(docs))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_BPE)
    return sentence_pieces.piece_digests(sentence_pieces.encode_and_decode(texts_of(table(spark, sf_dir, "documents")), path))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_fingerprints": op3_fingerprints,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_bpe_encode_decode": op9_bpe_encode_decode,
    "op10_top_k_search": op10_top_k_search,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE: dict[str, str] = {
    "op5_line_dedup": line_dedup.SQL,
    "op7_warc": warc.SQL,
    "op8_mixing": mixing.SQL,
    "op10_top_k_search": search.top_k_sql(),
    "op11_merkle_manifest": merkle.manifest_sql(),
    "op13_source_divergence": divergence.SQL,
}

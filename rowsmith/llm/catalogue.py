"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rowsmith.llm import decontam, langid, licences, pieces, quality, simhash, substring, suffix, tokenfile, warc
from rowsmith.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


QUERIES["op10_quality_rules"] = op10_quality_rules


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return langid.identify(documents(spark, sf_dir), fold == 0)


QUERIES |= {"op9_simhash": op9_simhash, "op2_language_id": op2_language_id}


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.crawl(documents(spark, sf_dir, "pages")))
    page = F.expr("record_id div 2").alias("page_id")
    return found.select(page, "url_key", "refers_to", "status", warc.header_text(F.col("headers")).alias("headers"))


def op6_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_back(tokenfile.encode(documents(spark, sf_dir), "word_bpe_49k.json", end=2))


QUERIES |= {
    "op1_license_scan": op1_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_bitplane_tokens": op6_bitplane_tokens,
}
SQL |= {"op1_license_scan": licences.sql(), "op5_warc_revisits": warc.SQL}


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(documents(spark, sf_dir), length=400)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir), width=20)


QUERIES |= {"op3_suffix_dedup": op3_suffix_dedup, "op7_substring_dedup": op7_substring_dedup}


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), k=2, model="piece_bpe_32k.model", seed=0)


QUERIES["op8_sentencepiece_sampling"] = op8_sentencepiece_sampling


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

"""The corpus queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; a parameter of the operators, only looked up here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffixes import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality_rules import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.wavelet import read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WARC_SQL = """
with own as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), firsts as (
  select payload_digest, min(page_id) as first_id from own where payload_bytes >= 100 group by payload_digest
)
select own.page_id, own.payload_bytes, own.payload_digest,
  case when first_id is not null and first_id <> own.page_id then 'revisit' else 'response' end as record_type,
  case when first_id <> own.page_id then first_id end as refers_to
from own left join firsts using (payload_digest)
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name) and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": _WARC_SQL}

"""Queries of the text problems over whole tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.llm import pii
from stratamesh.llm.mixing import draw, mix_plan, mix_shares
from stratamesh.llm.tokens import encode
from stratamesh.session import cut, table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents").select("doc_id", "text"), "text", "ids").select("doc_id", "ids")


def p7_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same ids with every text over 32 characters cut into parts of at most 8, so that all rows go through cutting and
    tree concatenation; on texts as short as these it is a proof of exactness, not a gain."""
    return encode(table(spark, d, "documents").select("doc_id", "text"), "text", "ids", long_chars=32, segment_chars=8).select("doc_id", "ids")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return cut(encode(docs, "text", "n_tokens", count_only=True).select("doc_id", "source", "n_tokens"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixes: every drawn segment with its text, in random order."""
    plan = mix_plan(_counted(spark, d), table(spark, d, "mix_targets"), source="source", tokens="n_tokens")
    return draw(table(spark, d, "documents").select("doc_id", "source", "lang", "text"), plan, key="doc_id", source="source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    counted = _counted(spark, d)
    plan = cut(mix_plan(counted, table(spark, d, "mix_targets"), source="source", tokens="n_tokens"))
    return mix_shares(counted, plan, key="doc_id", source="source", tokens="n_tokens")


#: A reference list longer than this is an error: it is sent to every Python worker.
MAX_GIVEN_NAMES = 100_000


@lru_cache(maxsize=2)
def _trained(names: tuple[str, ...]) -> pii.Detector:
    return pii.train(names)


def _detector(spark: SparkSession, d: str) -> pii.Detector:
    rows = table(spark, d, "given_names").select("given_name").where("given_name IS NOT NULL").distinct().limit(MAX_GIVEN_NAMES + 1).collect()
    if len(rows) > MAX_GIVEN_NAMES:
        raise ValueError(f"over {MAX_GIVEN_NAMES} given names")
    return _trained(tuple(sorted(r[0] for r in rows)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_mentions(table(spark, d, "documents"), _detector(spark, d), key="doc_id", text="text").select("doc_id", "pii_kind", "start_at")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents").select("doc_id", "text"), _detector(spark, d), text="text", out="clean").select("doc_id", F.col("clean").alias("redacted_text"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_joined, p8_mix, p8_shares, p9_found, p9_redacted)}
SQL: dict[str, str] = {}

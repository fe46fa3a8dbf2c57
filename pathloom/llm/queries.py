"""Queries of the problems on texts, each over all documents and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.mixture import mix
from pathloom.llm.repetition import repetition
from pathloom.llm.tokenizer import encode_corpus


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(_table(spark, sf_dir, "documents"), at_least=0.3).select("doc_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_ids, p9_mix, p9_shares, p10_found, p10_shares)}
# the share of letters and digits that lie in a stretch of 40 which also starts earlier
_SHARES = r"""
WITH r AS (SELECT doc_id, coalesce(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), '') AS s FROM documents),
g AS (SELECT doc_id, s, unnest(generate_series(1, length(s) - 39)) AS i FROM r WHERE length(s) > 40),
f AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, substr(s, i, 40)) AS m FROM g),
again AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -40) AS p FROM f WHERE i > m),
covered AS (SELECT doc_id, sum(least(40, i - p)) AS n FROM again GROUP BY doc_id),
shares AS (SELECT doc_id, length(s) AS n_chars, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE n::DOUBLE / length(s) END AS share FROM r LEFT JOIN covered USING (doc_id))
"""
ORACLES: dict[str, str] = {
    "p10_found": _SHARES + "SELECT doc_id FROM shares WHERE share >= 0.3",
    "p10_shares": _SHARES + "SELECT doc_id, n_chars, share FROM shares",
}

"""op1: exact dedup of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_dedup


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), normalise="none", keep="largest")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)"""
}

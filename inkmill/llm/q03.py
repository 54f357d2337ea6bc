"""op3: suffix-array dedup of documents by 50-byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .suffix_dedup import suffix_dedup


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), window=50)


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE: dict[str, str] = {}

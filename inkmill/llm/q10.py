"""op10: license scan of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .license_scan import license_scan


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE: dict[str, str] = {}

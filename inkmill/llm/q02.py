"""op2: toxicity of documents by weak supervision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .toxicity import toxicity


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1, threshold=0.7)


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}

"""op4: packing the tokens of documents into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end=0, piece_bytes=8 << 20, words=600_000)


QUERIES = {"op4_packing": op4_packing}
ORACLE: dict[str, str] = {}

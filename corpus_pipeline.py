"""A training-corpus pipeline of five stages, each on all that the stage before has kept.

Each stage takes (spark, docs, sf_dir); docs has the columns of documents, and all stages but the last return these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.common import settle, table
from inkmill.llm.exact_dedup import drop_copies
from inkmill.llm.jaccard_join import jaccard_components
from inkmill.llm.mixing import mix
from inkmill.llm.packing import pack
from inkmill.llm.q04 import tokenizer_path
from inkmill.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go. The classifier learns from labels outside the held-out third."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return drop_copies(docs, keep="largest")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with five-word shingle similarity of 0.8 or more, the smallest doc_id stays."""
    found = jaccard_components(docs, size=5, share=80)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the schedule passes their first word: sources near weights 1, 2, 3, at most three times each.

    Documents that the schedule doesn't reach go; rows that repeat a doc_id share the largest number of passes.
    """
    times = mix(docs).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").cast("int").alias("times")).where("times > 0")
    # The document stands in one column, so that no name of its own can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    chosen = whole.join(times, whole["doc"]["doc_id"].eqNullSafe(times["id"])).select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return chosen.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    return pack(docs, tokenizer_path(), capacity=2048, end=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact dedup by content sort, in DataFrame operations alone.

Sampled splitters range-partition the rows on (first bytes, SHA-256, salt) of the normalised text, Spark's external sort
places equal texts next to each other, and each row is compared in full with its neighbour. The splitters are of bounded
size however long the texts are. Texts that occur more than `hot` times are salted by id; the one row that each salted
run keeps is then compared in full with the runs' other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, partitions

NORMALISE = {
    "none": lambda t: t,
    "case": lower_ascii,
    "space": lambda t: F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " ")),
}


def _runs(rows: DataFrame, keep: str, *salt: str) -> DataFrame:
    """Range partitions and sorts; leader: the id that each run of equal texts keeps, copies: the run's rows.

    The windows' keys are those of the range partitioning (which a constant would spoil), so they need no other shuffle.
    """
    key = ["_head", "text_sha256", *salt]
    order = F.col("_id").asc_nulls_first() if keep == "largest" else F.col("_id").desc_nulls_first()
    near = Window.partitionBy(*key).orderBy(F.col("_text"), order, F.col("_tie"))
    last = ~F.coalesce(F.lead("_text").over(near) == F.col("_text"), F.lit(False))
    new = F.when(F.coalesce(F.lag("_text").over(near) == F.col("_text"), F.lit(False)), 0).otherwise(1)
    run = Window.partitionBy(*key, "_run")
    return (
        rows.repartitionByRange(*key)
        .withColumns({"_last": last, "_new": new})
        .withColumn("_run", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({"_leader": F.max(F.when(F.col("_last"), F.col("_id"))).over(run), "_copies": F.count(F.lit(1)).over(run)})
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: str | Column = "none", keep: str = "largest", hot: int | None = None, carry: Column | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text), and carried, if carry is given.

    A null text counts as empty. A null id counts as smaller than any other and gives keep_id null only where all ids of
    the group are null. Of rows that repeat an id, one is kept. An empty table gives an empty result. Other columns of
    docs aren't read. hot: copies from which a text is salted; by default an eighth of a mean partition, 32 at least, so
    that at most eight texts for each partition are hot, which bounds what is broadcast.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(keep)
    n = partitions(docs.sparkSession)
    hot = hot or max(32, docs.count() // (8 * n))
    text = NORMALISE[normalise](F.coalesce(F.col(text_col), F.lit(""))) if isinstance(normalise, str) else normalise
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), (F.lit(0) if carry is None else carry).alias("_rest")).withColumns(
        {"text_sha256": F.sha2(F.col("_text"), 256), "_head": F.substring("_text", 1, 64), "_tie": F.lit(0)}
    )
    many = F.broadcast(rows.groupBy("text_sha256").count().where(F.col("count") > hot).select("text_sha256", F.ceil(F.col("count") / hot).cast("int").alias("_salts")))
    rare = _runs(rows.join(many, "text_sha256", "left_anti"), keep)
    salted = _runs(rows.join(many, "text_sha256").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int")), keep, "_salt")

    better = F.max if keep == "largest" else F.min
    heads = salted.where("_last").select("text_sha256", "_text", "_salt", "_run", "_leader", "_copies")
    whole = heads.groupBy("text_sha256", "_text").agg(better("_leader").alias("keep_id"), F.sum("_copies").alias("group_size"))
    # Texts are compared in full by a shuffle of one row for each salted run; what is broadcast holds no text.
    found = F.broadcast(heads.join(whole, ["text_sha256", "_text"]).select("text_sha256", "_salt", "_run", "keep_id", "group_size"))
    merged = salted.join(found, ["text_sha256", "_salt", "_run"])

    out = ["_id", "keep_id", "group_size", "_first", "text_sha256", "_rest"]
    a = rare.select("_id", F.col("_leader").alias("keep_id"), F.col("_copies").alias("group_size"), F.col("_last").alias("_first"), "text_sha256", "_rest")
    b = merged.select("_id", "keep_id", "group_size", (F.col("_last") & F.col("_id").eqNullSafe(F.col("keep_id"))).alias("_first"), "text_sha256", "_rest")
    found = a.select(*out).unionAll(b.select(*out))
    told = [F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_first").alias("kept"), "text_sha256"]
    return found.select(*told, *([] if carry is None else [F.col("_rest").alias("carried")]))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps; texts are compared as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = exact_dedup(docs, id_col, text_col, keep=keep, carry=whole).where("kept")
    return kept.select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])

"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

Each source's documents stand in a shuffled order (a hash of the id) and are cut into blocks of equal numbers of words.
Slot i of the schedule holds the golden-ratio point frac((i + 1/2) * phi); the source whose share of the cumulative
targets holds that point fills the slot with its next block, going round its blocks again when they are used up. Ranks
and positions are prefix sums in two levels (chunks, then rows of a chunk), so that no source lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle

PHI = 0.6180339887498949
CELLS = 4096


def source_targets(sized: DataFrame, weights: tuple[int, ...], limit: float) -> DataFrame:
    """One row per source: source_size, target (shares of all sizes by weight, at most limit times the source's size).

    Filling in order of limit * size / weight gives what repeated resharing of the excess ends at.
    """
    whole = Window.orderBy("_none", "_source")
    fill = Window.orderBy("_ratio", "_none", "_source")
    everything = Window.partitionBy()
    rank = F.row_number().over(whole)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    return (
        sized.groupBy("_none", "_source").agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", weight)
        .withColumns({"_cap": F.col("source_size") * F.lit(float(limit)), "_total": F.sum("source_size").over(everything).cast("double")})
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after))
        .withColumn("_full", F.col("_level") >= F.col("_ratio"))
        .withColumn("_level", F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything))
        .withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_level") * F.col("_weight"), F.col("_cap"))))
        .select("_none", "_source", "source_size", "target")
    )


def _prefixed(rows: DataFrame, keys: list[str], chunk: str, what: str, order: list[str], name: str) -> DataFrame:
    """Adds the sum of `what` over the rows of the same keys before this one, by chunk and then by order.

    The sums of chunks grow with the input, so they are merged, never broadcast; the windows have dealt and sorted both sides so already.
    """
    parts = rows.groupBy(*keys, chunk).agg(F.sum(what).alias("_part"))
    lead = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_part", F.coalesce(F.sum("_part").over(lead), F.lit(0)))
    own = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn(name, F.coalesce(F.sum(what).over(own), F.lit(0)))
    return local.join(parts.hint("merge"), [*keys, chunk]).withColumn(name, F.col(name) + F.col("_part")).drop("_part")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, block: int = 256, chunk_rows: int = 2_000, seed: int = 7) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken, copies.

    size: words of the text; a null text has none. A null source is a source of its own, the last. taken: words that the
    mix takes of the document, repeats counted, at most limit times its size; a source's taken words add up to its target
    (rounded down) but for what the schedule's discrepancy leaves, of a few blocks. copies: passes that the schedule makes over
    the document's first word (a mix of whole documents takes it so often). Rows that repeat an id are documents of their own, in an
    order that is the same up to exchange of equal rows. An empty table, or one without words, takes nothing.
    """
    if limit != int(limit) or limit < 1:
        raise ValueError("limit must be a whole number")
    sized = settle(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .withColumns({"_none": F.col("_source").isNull(), "_source": F.coalesce("_source", F.lit(""))})
        .withColumn("_order", F.shiftrightunsigned(F.xxhash64(F.col("_id"), F.lit(seed)), 24)),
        "sized",
    )
    src = ["_none", "_source"]
    sources = settle(source_targets(sized, weights, limit).withColumn("_goal", F.floor("target").cast("long")), "targets")

    # Documents in shuffled order.
    chunks = max(1, -(-sized.count() // chunk_rows))
    spread = sized.withColumn("_chunk", F.floor(F.col("_order") * F.lit(chunks) / F.lit(float(1 << 40))).cast("long"))
    placed = _prefixed(spread, src, "_chunk", "size", ["_order", "_id", "size"], "_pos")

    # The schedule: each cell of [0, 1) knows the sources whose share reaches into it.
    along = Window.orderBy(*src).rowsBetween(Window.unboundedPreceding, 0)
    shares = (
        sources.where(F.col("_goal") > 0)
        .withColumn("_to", F.sum("target").over(along) / F.sum("target").over(Window.partitionBy()))
        .withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy(*src)), F.lit(0.0)))
        .withColumn("_to", F.when(F.lead("_to").over(Window.orderBy(*src)).isNull(), F.lit(2.0)).otherwise(F.col("_to")))
        .withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * CELLS).cast("int"), F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS - 1)).cast("int"))))
        .select(*src, "_from", "_to", "_cell")
    )
    words, number, least = sources.agg(F.sum("source_size"), F.count(F.lit(1)), F.min(F.when(F.col("_goal") > 0, F.col("target")))).first()
    slots = -(-(words or 0) // block)
    # More slots than blocks, so that small sources, too, find their points; those past a source's target are dropped.
    slots += slots // 50 + 8 * number + min(10 * slots + 100_000, int(8 * words / least)) if least else 0
    point = docs.sparkSession.range(slots).withColumn("_x", (F.col("id") + 0.5) * F.lit(PHI)).withColumn("_x", F.col("_x") - F.floor("_x"))
    dealt = (
        point.withColumn("_cell", F.floor(F.col("_x") * CELLS).cast("int"))
        .join(shares, "_cell")
        .where((F.col("_x") >= F.col("_from")) & (F.col("_x") < F.col("_to")))
        .withColumns({"_chunk": F.floor(F.col("id") / 2048), "_one": F.lit(1).cast("long")})
    )
    ranked = _prefixed(dealt, src, "_chunk", "_one", ["id"], "_rank")
    rest = F.col("_goal") % F.col("source_size")
    blocks_of = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    last = (F.floor(F.col("_goal") / F.col("source_size")) * blocks_of + F.ceil(rest / F.lit(block))).cast("long")
    # However few points a source finds, it gets all its slots: those that the schedule lacks stand after it.
    met = dealt.groupBy(*src).agg(F.sum("_one").alias("_met"))
    missing = sources.where("_goal > 0").withColumn("_last", last).join(met, src, "left").withColumn("_met", F.coalesce("_met", F.lit(0).cast("long"))).where("_met < _last")
    missing = missing.select(*src, F.explode(F.sequence("_met", F.col("_last") - 1)).alias("_rank"))
    filled = (
        ranked.select(*src, "_rank").unionAll(missing).join(sources, src)
        .withColumns({"_blocks": blocks_of, "_last": last})
        .where(F.col("_rank") < F.col("_last"))
        # The last slot takes only the words that the target still lacks.
        .withColumn("_part", F.when((F.col("_rank") == F.col("_last") - 1) & (rest > 0), (rest - 1) % F.lit(block) + 1).otherwise(F.lit(0)))
        .groupBy(*src, (F.col("_rank") % F.col("_blocks")).alias("_block"))
        .agg(F.count_if(F.col("_part") == 0).alias("_times"), F.sum("_part").alias("_clip"))
    )

    # What is taken before a position is a function of its block: two look-ups give a document's share.
    groups = F.floor(F.col("_blocks") / F.lit(2048)).cast("long")
    every = (
        sources.where(F.col("source_size") > 0).withColumn("_blocks", blocks_of)
        .withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), groups)))
        .withColumn("_block", F.explode(F.sequence(F.col("_group") * 2048, F.least(F.col("_group") * 2048 + 2047, F.col("_blocks")))))
        .select(*src, "_block", F.col("_group").alias("_chunk"), F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("_block") * block).alias("_words"))
        .join(filled.hint("merge"), [*src, "_block"], "left")
        .na.fill(0, ["_times", "_clip"])
        .withColumn("_used", F.col("_times") * F.col("_words") + F.least("_clip", "_words"))
    )
    table = _prefixed(every, src, "_chunk", "_used", ["_block"], "_before").select(*src, "_block", "_times", "_clip", "_before")

    def taken_to(at: str, end: str) -> tuple[DataFrame, F.Column]:
        side = table.select(*src, F.col("_block").alias(f"_b{end}"), F.col("_times").alias(f"_t{end}"), F.col("_clip").alias(f"_c{end}"), F.col("_before").alias(f"_s{end}"))
        inside = F.col(at) % F.lit(block)
        return side, F.col(f"_s{end}") + F.col(f"_t{end}") * inside + F.least(inside, F.col(f"_c{end}"))

    first, to_first = taken_to("_pos", "0")
    past, to_past = taken_to("_stop", "1")
    return (
        placed.withColumn("_stop", F.col("_pos") + F.col("size"))
        .withColumns({"_b0": F.floor(F.col("_pos") / F.lit(block)), "_b1": F.floor(F.col("_stop") / F.lit(block))})
        .join(first.hint("merge"), [*src, "_b0"], "left")
        .join(past.hint("merge"), [*src, "_b1"], "left")
        .join(sources.select(*src, "source_size", "target"), src)
        .withColumns({"taken": F.when(F.col("size") > 0, to_past - to_first).otherwise(F.lit(0)).cast("long"), "copies": F.when(F.col("size") > 0, F.col("_t0") + (F.col("_c0") > F.col("_pos") % F.lit(block)).cast("int")).otherwise(F.lit(0)).cast("long")})
        .select(F.col("_id").alias(id_col), F.when(~F.col("_none"), F.col("_source")).alias(source_col), "size", "source_size", "target", "taken", "copies")
    )

"""Chunks (C1 to C5, X16, X24)."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx


def tokens_of(n_words: Column) -> Column:
    """Words times 1.3, rounded down, in whole numbers."""
    return F.floor(n_words * 13 / 10).cast("int")


def marks(text: Column) -> Column:
    """X24."""
    return F.length(text) - F.length(F.translate(text, ".?!", ""))


def spans(sizes, most: int, overlap: int, tails: bool) -> list[tuple[int, int]]:
    """First and last sentence of each chunk: as many as fit (one at least); the next starts at the smallest suffix of `overlap` tokens.

    Each start depends on the chunk before, so this is a walk over prefix sums. tails: goes on with suffixes after the end is reached.
    """
    sums = [0, *accumulate(int(x) for x in sizes)]
    out, start, n = [], 0, len(sums) - 1
    while start < n:
        end = max(start + 1, bisect_right(sums, sums[start] + most) - 1)
        out.append((start, end - 1))
        if end == n and not tails:
            break
        back = bisect_right(sums, sums[end] - overlap) - 1
        start = max(back if back >= start else start, start + 1)
    return out


def _walked(most: int, overlap: int, tails: bool):
    def walk(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else [{"a": a, "b": b} for a, b in spans(x, most, overlap, tails)])

    return walk


def sentence_spans(sizes: Column, most: int = 300, overlap: int = 30, tails: bool = True) -> Column:
    # Marked as not deterministic so that the optimiser neither repeats it nor moves it into the explosion.
    return F.pandas_udf(_walked(most, overlap, tails), "array<struct<a:int,b:int>>").asNondeterministic()(sizes)


def sentence_chunks(docs: DataFrame, text: str, most: int = 300, overlap: int = 30, tails: bool = True) -> DataFrame:
    """docs' other columns with chunk_id, text, n_tokens, n_sents, word_count, method. Only the walk over sizes is Python."""
    staged = docs.withColumn("_s", tx.sentences(F.col(text))).withColumn("_n", F.transform("_s", tx.n_words))
    staged = staged.withColumn("_spans", sentence_spans(F.transform("_n", tokens_of), most, overlap, tails))
    # The outer form: else the optimiser repeats the walk in a filter below the explosion.
    rows = staged.select(*[c for c in docs.columns if c != text], "_s", "_n", F.posexplode_outer("_spans").alias("chunk_id", "_span")).where("chunk_id IS NOT NULL")
    first, size = F.col("_span.a") + 1, F.col("_span.b") - F.col("_span.a") + 1
    own = F.slice("_n", first, size)
    return rows.select(
        *[c for c in docs.columns if c != text], "chunk_id", F.array_join(F.slice("_s", first, size), " ").alias("text"),
        F.aggregate(F.transform(own, tokens_of), F.lit(0), lambda a, x: a + x).alias("n_tokens"), size.alias("n_sents"),
        F.aggregate(own, F.lit(0), lambda a, x: a + x).alias("word_count"), F.lit("sentence_aware").alias("method"),
    )


def split_large(text: Column, most: int = 120) -> Column:
    """Sentences packed up to `most` words; a longer sentence stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, sent: Column) -> Column:
        n = tx.n_words(sent)
        full = s["cur"].isNotNull() & (s["n"] + n > most)
        out = F.when(full, F.array_append(s["out"], s["cur"])).otherwise(s["out"])
        return F.struct(out.alias("out"), F.when(full | s["cur"].isNull(), sent).otherwise(F.concat_ws(" ", s["cur"], sent)).alias("cur"), F.when(full, n).otherwise(s["n"] + n).alias("n"))

    return F.aggregate(tx.sentences(text), empty, step, lambda s: F.when(s["cur"].isNull(), F.array(text)).otherwise(F.array_append(s["out"], s["cur"])))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic_breaks(rows: DataFrame, doc: str, order: str, vector: str, percentile: float = 0.5) -> DataFrame:
    """Distance to the row before, and the number of the segment; a new one starts where the distance is over the document's percentile."""
    by = Window.partitionBy(doc).orderBy(order)
    far = rows.withColumn("distance", 1 - cosine(F.lag(vector).over(by), F.col(vector)))
    far = far.withColumn("_limit", F.percentile("distance", F.lit(percentile)).over(Window.partitionBy(doc)))
    return far.withColumn("segment", F.sum(F.when(F.col("distance") > F.col("_limit"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_limit")


def semantic_chunks(nodes: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """C4's semantic branch: nodes of 10 words or more, those over 120 words split at 100, parts of 10 words or more, numbered."""
    kept = nodes.withColumn("_body", tx.strip(F.col(text))).where(tx.n_words(F.col("_body")) >= 10)
    parts = kept.withColumn("_parts", F.when(tx.n_words(F.col("_body")) > 120, split_large(F.col("_body"), 100)).otherwise(F.array("_body")))
    parts = parts.select(doc, order, F.posexplode("_parts").alias("_part", "text")).where(tx.n_words(F.col("text")) >= 10)
    count = tx.n_words(F.col("text"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy(order, "_part")) - 1
    return parts.select(doc, number.alias("chunk_id"), "text", tokens_of(count).alias("n_tokens"), marks(F.col("text")).alias("n_sents"), count.alias("word_count"), F.lit("semantic").alias("method"))


def section_context(chunks: DataFrame, doc: str, most: int = lx.PREFIX_WORDS) -> DataFrame:
    """Chunks that look like headings name the section of those after them; counts stay those of the bare chunk."""
    c = F.col("text")
    by = Window.partitionBy(doc).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = chunks.withColumn("_head", tx.at_most(c, most) & ~tx.matches(tx.strip(c), lx.COMPLETE))
    marked = marked.withColumn("_section", F.coalesce(F.last(F.when(F.col("_head"), tx.strip(c)), ignorenulls=True).over(by), F.lit("")))
    short = tx.first_words(F.col("_section"), most)
    prefixed = F.when((F.col("_section") != "") & ~c.startswith(F.substring(short, 1, 15)), F.concat(short, F.lit(". "), c)).otherwise(c)
    return marked.withColumns({"text": F.when(F.col("_head"), c).otherwise(prefixed), "section": F.when(~F.col("_head"), F.col("_section"))}).drop("_head", "_section")

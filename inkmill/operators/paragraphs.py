"""Paragraphs: splitting, classes, merging, task blocks and list reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx

from .filters import is_educational


def paragraphs(text: Column) -> Column:
    """P1."""
    return F.filter(F.transform(F.split(text, "\n{2,}"), tx.strip), lambda p: p != "")


def info(text: Column) -> Column:
    """Struct of type, has_bullet, has_numbered, word_count, lines."""
    return tx.let(tx.lines(text), lambda rows: F.struct(*_class(rows), tx.n_words(text).alias("word_count"), rows.alias("lines")))


def _class(rows: Column) -> tuple[Column, Column, Column]:
    total = F.greatest(F.size(rows), F.lit(1))
    bullets = F.size(F.filter(rows, lambda x: tx.matches(x, lx.BULLET)))
    numbers = F.size(F.filter(rows, lambda x: tx.matches(x, lx.NUMBER)))
    complete = F.size(F.filter(rows, lambda x: tx.matches(x, lx.COMPLETE)))
    kind = (
        F.when(bullets / total > 0.5, "bullet").when(numbers / total > 0.4, "numbered_list").when(complete / total > 0.6, "structured")
        .when(F.size(rows) <= 2, "heading").otherwise("mixed")
    )
    return kind.alias("type"), (bullets > 0).alias("has_bullet"), (numbers > 0).alias("has_numbered")


def merge_short(paras: Column, least: int = lx.MERGE_WORDS) -> Column:
    """A paragraph takes the next ones in until it has `least` words; a short last one joins the one before."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(state: Column, para: Column) -> Column:
        cur, n = state["cur"], state["n"]
        short = cur.isNotNull() & (n < least)
        out = F.when(cur.isNull() | short, state["out"]).otherwise(F.array_append(state["out"], cur))
        return F.struct(out.alias("out"), F.when(short, F.concat_ws(" ", cur, para["text"])).otherwise(para["text"]).alias("cur"), F.when(short, n + para["n"]).otherwise(para["n"]).alias("n"))

    def finish(state: Column) -> Column:
        out, cur = state["out"], state["cur"]
        joined = F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.concat_ws(" ", F.element_at(out, -1), cur))
        return F.when(cur.isNull(), out).when((F.size(out) > 0) & (state["n"] < least), joined).otherwise(F.array_append(out, cur))

    # Each paragraph's words are counted once; those of joined ones add up.
    counted = F.transform(paras, lambda p: F.struct(p.alias("text"), tx.n_words(p).alias("n")))
    return F.aggregate(counted, empty, step, finish)


def drop_task_blocks(rows: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """F5 at paragraph grain: what isn't educational goes, and list items that follow it, up to the next prose."""
    c = F.col(text)
    listed = tx.matches(c, r"^[•\-*]") | tx.matches(c, r"^\d\.")
    label = F.when(~is_educational(c), "N").when(listed, "L").otherwise("P")
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_label", label).withColumn("_block", F.last(F.when(F.col("_label") != "L", F.col("_label")), ignorenulls=True).over(before))
    return marked.where((F.col("_label") != "N") & ~((F.col("_label") == "L") & F.coalesce(F.col("_block") == "N", F.lit(False)))).drop("_label", "_block")


def educational_paragraphs(paras: Column) -> Column:
    """F5 on an array: the same rule as a fold of (kept, in block)."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("block"))

    def step(state: Column, p: Column) -> Column:
        gone = ~p["good"] | (state["block"] & p["item"])
        return F.struct(F.when(gone, state["out"]).otherwise(F.array_append(state["out"], p["text"])).alias("out"), gone.alias("block"))

    # Each paragraph is judged once, before the fold.
    item = lambda p: tx.matches(p, r"^[•\-*]") | tx.matches(p, r"^\d\.")
    judged = F.transform(paras, lambda p: F.struct(p.alias("text"), is_educational(p).alias("good"), item(p).alias("item")))
    return F.aggregate(judged, empty, step, lambda s: s["out"])


def heading_sentence(text: Column) -> Column:
    """X11."""
    bare = tx.strip(text)
    name = tx.strip(tx.replaced(bare, lx.STRIP_NUMBER, ""))
    stays = tx.matches(bare, lx.COMPLETE) | (tx.n_words(bare) > 8) | (name == "")
    return F.when(stays, text).otherwise(F.concat(F.lit(lx.HEADING_FRAME), tx.title_case(name), F.lit(".")))


def numbered(text: Column) -> Column:
    """An item per numbered line with the lines after it; an item of dots alone is null-safe and gives no text."""
    ordinals = F.create_map(*[F.lit(x) for kv in lx.ORDINALS.items() for x in kv])

    def said(num: Column, item: Column) -> Column:
        content = tx.replaced(tx.strip(item), r"\.+$", "")
        return F.concat(F.coalesce(F.try_element_at(ordinals, num), F.concat(F.lit("Poin "), num)), F.lit(", "), tx.lower_first(content), F.lit("."))

    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("num"), F.lit("").alias("item"))

    def step(s: Column, line: Column) -> Column:
        new = tx.matches(line, lx.NUMBER_ITEM)
        out = F.when(new & (s["item"] != ""), F.array_append(s["out"], said(s["num"], s["item"]))).otherwise(s["out"])
        num = F.when(new, F.regexp_extract(line, tx.FLAGS + lx.NUMBER_ITEM, 1)).otherwise(s["num"])
        item = F.when(new, tx.strip(F.regexp_extract(line, tx.FLAGS + lx.NUMBER_ITEM, 2))).when(s["item"] == "", line).otherwise(F.concat_ws(" ", s["item"], line))
        return F.struct(out.alias("out"), num.alias("num"), item.alias("item"))

    return F.aggregate(tx.lines(text), empty, step, lambda s: F.array_join(F.when(s["item"] != "", F.array_append(s["out"], said(s["num"], s["item"]))).otherwise(s["out"]), " "))


def bulleted(text: Column) -> Column:
    """Bullets become an enumeration after the other lines."""
    rows = tx.lines(text)
    items = F.transform(F.filter(rows, lambda x: tx.matches(x, lx.BULLET)), lambda x: tx.replaced(tx.strip(tx.replaced(x, lx.BULLET, "")), r"\.+$", ""))
    prefix = F.array_join(F.filter(rows, lambda x: ~tx.matches(x, lx.BULLET)), " ")
    n = F.size(items)
    joined = F.when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.array_join(items, " dan ")).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", dan "), F.coalesce(F.get(items, n - 1), F.lit("")))
    )
    framed = F.when(prefix != "", F.concat(prefix, F.lit(lx.BULLETS_AFTER_PREFIX), joined)).otherwise(F.concat(F.lit(lx.BULLETS_ALONE), joined))
    return F.when(n == 0, text).otherwise(F.concat(framed, F.lit(".")))


def reconstructed(text: Column) -> Column:
    """By the class of P2."""
    return tx.let(tx.let(tx.lines(text), lambda rows: F.struct(*_class(rows))), lambda kind: _by_class(text, kind))


def _by_class(text: Column, kind: Column) -> Column:
    t = kind["type"]
    return (
        F.when(t == "heading", heading_sentence(text)).when(t == "numbered_list", numbered(text)).when(t == "bullet", bulleted(text))
        .when((t == "mixed") & kind["has_numbered"], numbered(text)).when((t == "mixed") & kind["has_bullet"], bulleted(text)).otherwise(text)
    )

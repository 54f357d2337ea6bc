"""Distractors and choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx

from .answers import definition
from .filters import cut_words, is_clean_option


def _distinct_first(items: Column, n: int) -> Column:
    return F.slice(F.array_distinct(items), 1, n)


def by_definition(correct: Column, text: Column) -> Column:
    """Strategies 1 to 3 in order: another explanation, another subject, half an explanation with another's end."""
    others = F.filter(F.transform(F.filter(tx.sentences(text), lambda s: F.lower(s) != F.lower(correct)), definition), lambda d: d.isNotNull())
    none = F.array().cast("array<string>")
    # Without a definition as the answer, the other ones aren't looked for.
    found = tx.let(definition(correct), lambda own: F.when(own.isNotNull(), tx.let(others, lambda rest: F.concat(*_swapped(correct, own, rest)))))
    return F.coalesce(found, none)


def _swapped(correct: Column, own: Column, others: Column) -> tuple[Column, Column, Column]:
    good = lambda d: (F.lower(d) != F.lower(correct)) & (tx.n_words(d) >= 5)
    kets = F.array_distinct(F.transform(F.filter(others, lambda o: F.lower(o["ket"]) != F.lower(own["ket"])), lambda o: o["ket"]))
    one = F.transform(kets, lambda k: F.concat_ws(" ", own["subj"], own["pred"], k))
    two = F.transform(F.filter(others, lambda o: F.lower(o["subj"]) != F.lower(own["subj"])), lambda o: F.concat_ws(" ", o["subj"], own["pred"], own["ket"]))
    words = tx.words(own["ket"])
    half = F.array_join(F.slice(words, F.lit(1), F.greatest(F.floor(F.size(words) / 2).cast("int"), F.lit(0))), " ")
    long = F.filter(others, lambda o: tx.n_words(o["ket"]) >= 3)
    three = F.transform(long, lambda o: F.concat_ws(" ", own["subj"], own["pred"], half, F.array_join(F.slice(tx.words(o["ket"]), -3, 3), " ")))
    return F.filter(one, good), F.filter(two, good), F.when(F.size(words) >= 6, F.filter(three, good)).otherwise(F.array().cast("array<string>"))


def by_overlap(correct: Column, text: Column) -> Column:
    """Strategy 4: other clean sentences that don't hold the answer's start; those that share most words first, longer ones first, then in order."""
    return tx.let(F.lower(correct), lambda low: tx.let(F.array_distinct(tx.words(low)), lambda own: _by_overlap(low, own, text)))


def _by_overlap(low: Column, own: Column, text: Column) -> Column:
    rows = tx.let(F.substring(low, 1, 30), lambda start: F.filter(tx.sentences(text), lambda s: tx.let(F.lower(s), lambda x: (x != low) & ~x.contains(start))))
    cut = F.filter(F.transform(rows, lambda s: cut_words(s, 35, 25)), is_clean_option)
    ranked = F.transform(cut, lambda s, i: F.struct((-F.size(F.array_intersect(tx.words(F.lower(s)), own))).alias("o"), (-tx.n_words(s)).alias("n"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(ranked), lambda x: x["s"])


def misleading(correct: Column, text: Column, n: int = 3) -> Column:
    """Q4: the first n distinct ones of the four strategies, in this order."""
    return tx.let(correct, lambda c: _distinct_first(F.concat(by_definition(c, text), by_overlap(c, text)), n))


def options(answer: Column, found: Column, pool: Column, key: Column) -> Column:
    """Q6 by rules: struct of 4 options and correct_idx. The pool and the options are put in order by md5 of the key, in place of a random shuffle."""

    def shuffled(items: Column) -> Column:
        return F.transform(F.array_sort(F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws("|", key, x)).alias("h"), i.alias("i"), x.alias("x")))), lambda s: s["x"])

    return tx.let(found, lambda f: _options(answer, f, pool, shuffled))


def _options(answer: Column, found: Column, pool: Column, shuffled) -> Column:
    rest = shuffled(F.filter(F.coalesce(pool, F.array().cast("array<string>")), lambda p: (F.lower(p) != F.lower(answer)) & ~F.array_contains(found, p)))
    three = F.slice(F.concat(found, rest, tx.listed(lx.FALLBACK_OPTIONS)), 1, 3)
    all_four = shuffled(F.concat(F.transform(three, lambda d: cut_words(d, 28, 28)), F.array(answer)))
    return tx.let(all_four, lambda four: F.struct(four.alias("options"), (F.array_position(four, answer) - 1).cast("int").alias("correct_idx")))

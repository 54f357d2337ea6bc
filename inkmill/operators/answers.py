"""Answers: scores, choice, definitions and context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx


def is_kind(sentence: Column, kind: str, low: Column | None = None) -> Column:
    """Whether a sentence defines, describes or tells how; only those that hold one of the pattern's words are matched. low: the sentence in lower case."""
    pattern, needed = lx.KINDS[kind]
    return tx.may_hold(F.lower(sentence) if low is None else low, *needed) & tx.matches(sentence, pattern)


def score(sentence: Column) -> Column:
    """Q1."""
    return tx.let(tx.words(sentence), lambda tokens: _points(sentence, tokens))


def _points(sentence: Column, tokens: Column) -> Column:
    n = F.size(tokens)
    formula = sentence.rlike("[=→←≤≥≠+*/-]") & tx.matches(sentence, lx.FORMULA)
    emoji = (F.octet_length(sentence) != F.length(sentence)) & tx.matches(sentence, lx.EMOJI_TWICE)
    out = tx.matches(sentence, lx.BAD_START) | tx.matches(sentence, r"^\d+") | formula | emoji
    kind = tx.let(F.lower(sentence), lambda low: (
        F.when(is_kind(sentence, "definition", low), 10.0).when(is_kind(sentence, "function", low), 5.0).when(is_kind(sentence, "process", low), 3.0)
        .when(F.arrays_overlap(tokens, tx.listed(lx.BARE_DEFINERS)), 1.5).otherwise(0.0)
    ))
    length = F.when((n >= 10) & (n <= 35), 2.0).when((n >= 6) & (n < 10), 0.5).when(n > 45, -1.5).otherwise(0.0)
    bracket = F.when(sentence.contains("(") & sentence.rlike(r"\([A-Z]{2,}\)"), 1.5).otherwise(0.0)
    end = F.when(tx.last_char(F.get(tokens, n - 1)).isin(".", "!", "?"), 0.5).otherwise(0.0)
    return F.when((n < 6) | out, -1.0).otherwise(kind + length + bracket + end)


def scored(text: Column) -> Column:
    return F.transform(tx.sentences(text), lambda s: tx.let(tx.words(s), lambda tokens: F.struct(s.alias("sentence"), _points(s, tokens).alias("score"), F.size(tokens).alias("n"))))


def pick(text: Column) -> Column:
    """Q2: the shortest full definition, else the best sentence of 3 points or more, else the best above 0; the earliest of equals."""

    def best(items: Column, less) -> Column:
        empty = F.lit(None).cast("struct<sentence:string,score:double,n:int>")
        return F.aggregate(items, empty, lambda a, x: F.when(a.isNull() | less(x, a), x).otherwise(a))["sentence"]

    return tx.let(
        scored(text),
        lambda rows: F.coalesce(
            best(F.filter(rows, lambda x: x["score"] >= 10), lambda x, a: x["n"] < a["n"]),
            best(F.filter(rows, lambda x: x["score"] >= 3), lambda x, a: x["score"] > a["score"]),
            best(F.filter(rows, lambda x: x["score"] > 0), lambda x, a: x["score"] > a["score"]),
        ),
    )


def definition(sentence: Column) -> Column:
    """Subject, predicate and explanation at the first predicate that fits; null if none does."""
    found = []
    for name in lx.DEFINERS:
        pattern = rf"(?i){tx.FLAGS}^(.{{3,80}})\s+({name})\s+(.{{10,}})"
        part = [tx.strip(F.regexp_extract(sentence, pattern, i)) for i in (1, 2, 3)]
        found.append(F.when(tx.may_hold(F.lower(sentence), name.split(r"\s")[0].split(" ")[0]) & sentence.rlike(pattern), F.struct(part[0].alias("subj"), part[1].alias("pred"), part[2].alias("ket"))))
    return F.coalesce(*found)


def focused(text: Column, answer: Column, around: int = 3) -> Column:
    """Q3: the first sentence that holds the answer's first 50 characters (else the first one), with `around` on each side."""
    low = F.substring(tx.strip(F.lower(answer)), 1, 50)

    def around_hit(rows: Column, low: Column) -> Column:
        hit = F.array_position(F.transform(rows, lambda s: F.lower(s).contains(low)), True).cast("int")
        part = tx.let(F.greatest(hit, F.lit(1)), lambda at: F.slice(rows, F.greatest(at - around, F.lit(1)), at + around - F.greatest(at - around, F.lit(1)) + 1))
        return F.when(F.size(rows) == 0, text).otherwise(F.array_join(part, " "))

    return tx.let(low, lambda start: tx.let(tx.sentences(text), lambda rows: around_hit(rows, start)))


def answer_gate(text: Column) -> Column:
    """F11 but for duplicates: the picked answer, cut from over 35 to 25 words, if it still scores 1.5 and is a clean option."""
    from .filters import cut_words, is_clean_option

    cut = tx.let(pick(text), lambda a: cut_words(a, 35, 25))
    return tx.let(cut, lambda a: F.when((tx.strip(a) != "") & (score(a) >= 1.5) & is_clean_option(a), a))

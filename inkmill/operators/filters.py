"""Predicates on units, blocks, paragraphs, chunks and distractors."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx


def is_toc_line(c: Column) -> Column:
    """Every form ends in a number; only such lines are looked at in full, as the forms go back over a line's blanks."""
    return tx.matches(tx.last_char(tx.strip(c)), r"[\divxIVX]") & tx.matches(c, lx.TOC_LINE)


def is_header(c: Column) -> Column:
    return tx.matches(F.lower(c), lx.HEADER)


def is_publication(c: Column) -> Column:
    return tx.let(F.lower(c), lambda low: tx.may_hold(low, "isbn", "cipta", "copyright", "©", "diterbitkan", "penerbit", "cetakan", "reserved") & tx.matches(low, lx.PUBLICATION))


def is_noise_unit(text: Column) -> Column:
    """blank, under 15 words, front matter, contents, thanks, cover or imprint."""
    text = F.coalesce(text, F.lit(""))
    return tx.let(tx.strip(F.lower(text)), lambda low: _noise(text, low))


def _noise(text: Column, low: Column) -> Column:
    start = tx.first_words(low, 50)
    toc = F.coalesce(tx.share(tx.lines(text), is_toc_line), F.lit(0.0))
    return (
        tx.at_most(low, 14) | (tx.found(start, lx.NOISE_START) > 0) | (toc > lx.NOISE_TOC)
        | (tx.found(low, lx.GRATITUDE) >= 2) | (tx.found(low, lx.COVER) >= 3) | is_publication(low)
    )


def is_toc_block(text: Column) -> Column:
    """the first line is a structural header, or over two fifths of the lines look like contents."""
    return tx.let(tx.lines(text), lambda rows: F.coalesce(is_header(F.get(rows, F.lit(0))), F.lit(False)) | F.coalesce(tx.share(rows, is_toc_line) > lx.BLOCK_TOC, F.lit(False)))


def is_educational(text: Column) -> Column:
    """none of task, header, colophon, imprint or contents."""
    text = F.coalesce(text, F.lit(""))
    return tx.let(tx.strip(text), lambda bare: tx.let(F.lower(bare), lambda low: _educational(text, bare, low)))


def _educational(text: Column, bare: Column, low: Column) -> Column:
    task = tx.listed(lx.TASK_WORDS)
    # The text holds no task word in most cases, so its words are rarely looked at.
    few = F.size(F.filter(task, lambda w: low.contains(w))) == 0
    asks = tx.let(tx.words(low), lambda tokens: F.coalesce(F.array_contains(task, F.get(tokens, F.lit(0))), F.lit(False)) | (F.size(F.array_intersect(tokens, task)) >= 3))
    bad = (
        (bare == "") | (~few & asks)
        | is_header(bare) | tx.matches(bare, lx.COLOPHON) | is_publication(low) | is_toc_line(bare) | is_toc_block(text)
        | (tx.may_hold(low, "pengantar", "daftar") & tx.matches(text, lx.TOC_INLINE))
    )
    return ~bad


def is_content_unit(text: Column) -> Column:
    """F4, which no pipeline uses: 20 words at least, not two imprint keywords, no contents, no imprint."""
    low = F.lower(text)
    return ~((tx.n_words(text) < 20) | (tx.found(low, lx.CONTENT_SKIP) >= 2) | is_toc_block(text) | is_publication(low))


def is_noise_line(line: Column) -> Column:
    """F6, for stripped lines that aren't empty."""
    bare, titled = lx.LINE_NOISE[:2], lx.LINE_NOISE[2:]
    some = lambda patterns: reduce(or_, [tx.matches(line, p) for p in patterns])
    return some(bare) | (tx.may_hold(F.lower(line), "bahan") & some(titled))


def keep_sentences(text: Column, least: int = lx.KEEP_WORDS) -> Column:
    """sentences of enough words, joined by a space; the text as it is if none has."""
    kept = F.filter(tx.sentences(text), lambda s: ~tx.at_most(s, least - 1))
    return tx.let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(text))


def is_clean_chunk(text: Column) -> Column:
    """F8: not blank, no block of contents (F2), under three tenths of lines of contents, no short front matter."""
    bare = tx.strip(text)
    toc = tx.let(tx.lines(text), lambda rows: F.coalesce(is_header(F.get(rows, F.lit(0))), F.lit(False)) | F.coalesce(tx.share(rows, is_toc_line) > min(lx.BLOCK_TOC, lx.CHUNK_TOC), F.lit(False)))
    short = tx.at_most(text, 14) & (tx.matches(bare, lx.COLOPHON) | is_header(bare) | is_publication(text))
    return ~((bare == "") | toc | short)


def is_clean_option(text: Column) -> Column:
    """3 to 35 words, nothing structural."""
    return tx.let(tx.strip(text), _clean_bare)


def _clean_bare(bare: Column) -> Column:
    return tx.n_words(bare).between(3, 35) & ~is_toc_line(bare) & ~tx.matches(bare, lx.COLOPHON) & ~is_publication(bare) & (tx.found(F.lower(bare), lx.STRUCTURAL) == 0)


def cut_words(text: Column, over: int, to: int) -> Column:
    """The first `to` words of a text of more than `over`."""
    return F.when(~tx.at_most(text, over), tx.first_words(text, to)).otherwise(text)

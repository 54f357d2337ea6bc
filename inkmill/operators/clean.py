"""Cleaning and line joining."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx

from .filters import is_noise_line


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def prepared(text: Column) -> Column:
    """X2 to X4, without normalisation of Unicode: control characters and dot leaders become spaces, hyphenated line ends join."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    out = F.regexp_replace(out, r"\.{3,}", " ")
    return tx.replaced(out, r"(\w)-\n(\w)", "$1$2")


def normalised(text: Column, python: bool = True) -> Column:
    """NFKC, for which Spark has no function. Only texts beyond ASCII go to Python; for others a null does."""
    if not python:
        return text
    beyond = F.octet_length(text) != F.length(text)
    return F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(beyond, text)), text)


def _gap(before: Column, line: Column) -> Column:
    """What stands between a line and the one before; it depends on these two alone."""
    end, start = tx.last_char(before), tx.first_char(line)
    closed = end.isin(".", "!", "?")
    new = closed & (start.rlike(r"(?U)[\p{Lu}\d]") | start.isin("•", "-", "*"))
    goes_on = ~closed & (end != ":") & (start.rlike(r"\p{Ll}") | F.array_contains(tx.listed(lx.CONJUNCTIONS), F.lower(F.get(tx.words(line), F.lit(0)))))
    return F.when(new, "\n\n").when(goes_on, " ").otherwise("\n")


def join_lines(text: Column) -> Column:
    kept = F.filter(tx.lines(text), lambda x: ~is_noise_line(x))
    # Pairs of neighbours: the array against itself moved by one.
    pairs = F.zip_with(F.concat(F.array(F.lit("")), kept), kept, lambda a, b: F.when(b.isNull(), "").when(a == "", b).otherwise(F.concat(_gap(a, b), b)))
    return F.array_join(pairs, "")


def clean_text(text: Column, python: bool = True) -> Column:
    joined = join_lines(prepared(normalised(text, python)))
    return tx.strip(F.regexp_replace(joined, " {2,}", " "))

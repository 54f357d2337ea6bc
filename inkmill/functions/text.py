"""Column helpers for text. White space and digits are Unicode's, dots don't match line feeds alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?U)(?d)"
# The characters of Unicode's white space, spelled out, which is faster than asking for each one's property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = "[\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
# Letters that equal ASCII ones without regard to case, though lower() doesn't make them so.
FOLDED = "[ıİſ\u212a]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it: Spark shares no work inside lambdas and branches."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """value as a generator's only row: columns and filters above read it, none of them computes it again."""
    return F.explode_outer(F.array(value))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(FLAGS + pattern)


def replaced(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, FLAGS + pattern, by)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    """Tokens between white space; an empty array for a blank text."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def _first(c: Column, n: int) -> Column:
    """The first n words and perhaps the rest: the text isn't split beyond the blank before the first word and these n."""
    return F.filter(F.split(c, SPACES, n + 2), lambda w: w != "")


def at_most(c: Column, n: int) -> Column:
    """Whether the text has n words at most, as n_words(c) <= n."""
    return F.coalesce(F.size(_first(c, n)), F.lit(0)) <= n


def lines(c: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Stripped pieces between white space that follows a full stop, an exclamation or a question mark."""
    # A split takes all white space between two pieces, so that only the text's ends need stripping.
    return F.filter(F.split(strip(c), f"(?<=[.!?]){SPACES}"), lambda x: x != "")


def last_char(c: Column) -> Column:
    return F.substring(c, -1, 1)


def first_char(c: Column) -> Column:
    return F.substring(c, 1, 1)


def may_hold(low: Column, *words: str) -> Column:
    """Whether a lower-cased text may match, without regard to case, a pattern that needs one of these words: a cheap look before it."""
    out = (F.octet_length(low) != F.length(low)) & low.rlike(FOLDED)
    for w in words:
        out = low.contains(w) | out
    return out


def found(c: Column, keywords: list[str]) -> Column:
    """How many of the distinct keywords the text contains."""
    return let(c, lambda bound: F.size(F.filter(listed(keywords), lambda k: bound.contains(k))))


def share(items: Column, test) -> Column:
    """Share of the array's items that pass; null for an empty array."""
    return let(items, lambda bound: F.when(F.size(bound) > 0, F.size(F.filter(bound, test)) / F.size(bound)))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(_first(c, n), 1, n), " ")


def listed(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(first_char(c)), F.substring(c, 2, 1 << 30))


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(first_char(c)), F.substring(c, 2, 1 << 30))


def title_case(c: Column) -> Column:
    """Upper-cases the first letter of every run of letters and lower-cases the rest."""
    pieces = F.split(F.lower(c), FLAGS + r"(?<![\p{L}])(?=[\p{L}])")
    return F.array_join(F.transform(pieces, upper_first), "")

"""Rewriting: informal abbreviations, acronyms and punctuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx


def expand_slang(text: Column) -> Column:
    """Whole words in any case, each by its expansion in lower case. No expansion holds a key, so one split does for all.

    The split keeps word runs and what lies between them apart; each run is looked up in a literal map. Only texts that may hold a key are split.
    """
    some = text.rlike(rf"(?U)(?i)(?<!\w)(?:{'|'.join(lx.SLANG)})(?!\w)") | text.rlike(tx.FOLDED)
    table = F.create_map(*[F.lit(x) for kv in lx.SLANG.items() for x in kv])
    pieces = F.split(text, r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)")
    return F.when(some, F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, F.lower(p)), p)), "")).otherwise(text)


def acronyms(text: Column, pattern: str = "(?U)" + lx.ACRONYM) -> Column:
    """Distinct candidates of X9, in the order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def accepted_title(titles: Column, acronym: Column) -> Column:
    """The first title of two words or more whose capitals hold three quarters of the acronym's letters."""
    letters = F.filter(F.split(acronym, ""), lambda ch: ch.rlike(r"\p{L}"))
    good = F.filter(titles, lambda t: (F.size(letters) > 0) & (F.size(F.filter(letters, lambda ch: F.upper(t).contains(ch))) >= 0.75 * F.size(letters)) & (tx.n_words(t) >= 2))
    return F.when(F.size(good) > 0, F.concat(F.get(good, F.lit(0)), F.lit(" ("), acronym, F.lit(")")))


def inline_definition(text: Column, name: Column) -> Column:
    """Capitalised words before '(ACRONYM)', else in brackets after it, two words at least; null if there are none."""
    before = tx.strip(F.call_function("regexp_extract", text, F.concat(F.lit(r"((?:[A-Z][a-z]+\s+){1,5})\("), name, F.lit(r"\)")), F.lit(1)))
    after = tx.strip(F.call_function("regexp_extract", text, F.concat(name, F.lit(r"\s*\(((?:[A-Z][a-z]+\s*){1,5})\)")), F.lit(1)))
    said = F.when(tx.n_words(before) >= 2, before).when(tx.n_words(after) >= 2, after)
    return F.concat(said, F.lit(" ("), name, F.lit(")"))


def expanded(text: Column, names: Column, titles: Column) -> Column:
    """Each acronym's first occurrence is replaced, one after another: a later one sees what an earlier one has put in.

    Acronyms are letters and slashes, so they need no escaping in a pattern. Of those without an inline definition, only the first 20 are looked up.
    """
    start = F.struct(text.alias("t"), F.lit(0).alias("asked"))

    def step(s: Column, name: Column) -> Column:
        inline = inline_definition(s["t"], name)
        found = F.coalesce(inline, F.when(s["asked"] < lx.MAX_LOOKUPS, F.try_element_at(titles, name)))
        at = F.regexp_instr(s["t"], F.concat(F.lit(r"(?U)\b"), name, F.lit(r"\b")))
        new = F.concat(F.substring(s["t"], F.lit(1), at - 1), found, F.substring(s["t"], at + F.length(name), F.length(s["t"])))
        return F.struct(F.when(found.isNotNull() & (at > 0), new).otherwise(s["t"]).alias("t"), (s["asked"] + inline.isNull().cast("int")).alias("asked"))

    return F.aggregate(names, start, step, lambda s: s["t"])


def expand_acronyms(docs: DataFrame, text: str, titles: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Text with acronyms spelled out by the text itself, else by the dimension titles(abbr, titles), joined on distinct acronyms."""
    rows = docs.withColumn("_names", acronyms(F.col(text)))
    if titles is None:
        rows = rows.withColumn("_titles", F.create_map().cast("map<string,string>"))
    else:
        pairs = rows.select(F.col(key).alias("_key"), F.explode(F.array_distinct("_names")).alias("abbr")).join(titles, "abbr")
        pairs = pairs.withColumn("_said", accepted_title(F.col("titles"), F.col("abbr"))).where("_said IS NOT NULL")
        known = pairs.groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("abbr", "_said"))).alias("_titles"))
        rows = rows.join(known, rows[key].eqNullSafe(known["_key"]), "left").drop("_key")
        rows = rows.withColumn("_titles", F.coalesce("_titles", F.create_map().cast("map<string,string>")))
    return rows.withColumn(text, F.when(F.size("_names") > 0, expanded(F.col(text), F.col("_names"), F.col("_titles"))).otherwise(F.col(text))).drop("_names", "_titles")


def merge_lines(text: Column) -> Column:
    """X15(c): a fresh line takes following ones that go on in lower case or with a conjunction; the first that doesn't ends up closed."""
    closed = ("." , "!", "?", ":")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"))

    def step(s: Column, line: Column) -> Column:
        cur = s["cur"]  # null unless a line is open
        takes = cur.isNotNull() & ~tx.last_char(cur).isin(*closed) & (line != "") & ~tx.matches(line, lx.LIST_START)
        more = takes & (tx.first_char(line).rlike(r"\p{Ll}") | F.array_contains(tx.listed(lx.CONJUNCTIONS), F.lower(F.get(tx.words(line), F.lit(0)))))
        shut = F.when(cur.isNull(), s["out"]).otherwise(F.array_append(s["out"], cur))
        out = F.when(more, s["out"]).when(takes | (line == ""), F.array_append(shut, line)).otherwise(shut)
        return F.struct(out.alias("out"), F.when(more, F.concat_ws(" ", cur, line)).when(takes | (line == ""), F.lit(None)).otherwise(line).alias("cur"))

    rows = F.transform(F.split(text, "\n"), tx.strip)
    return F.aggregate(rows, empty, step, lambda s: F.array_join(F.when(s["cur"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["cur"])), "\n"))


def restore_punctuation(text: Column) -> Column:
    """Spaces around punctuation, lines, full stops of paragraphs, capitals of sentences."""
    out = tx.replaced(text, r"([.,;:!?])([^\s\"'])", "$1 $2")
    out = merge_lines(tx.replaced(out, r"\s+([.,;:!?])", "$1"))
    ends = F.transform(F.transform(F.split(out, "\n\n"), tx.strip), lambda p: F.when((p != "") & ~tx.last_char(p).isin(".", "!", "?") & (tx.n_words(p) > 5), F.concat(p, F.lit("."))).otherwise(p))
    pieces = F.split(F.array_join(ends, "\n\n"), tx.FLAGS + r"(?<=[.!?])(?=\s+[a-z])")
    raised = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.regexp_extract(p, r"(?U)^(\s+)", 1), tx.upper_first(tx.replaced(p, r"^\s+", "")))))
    done = tx.strip(F.regexp_replace(F.array_join(raised, ""), " {2,}", " "))
    return F.when(tx.strip(text) == "", text).otherwise(done)

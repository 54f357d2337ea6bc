"""License scans: an Aho-Corasick automaton for identifier tags and notice phrases, and a parser of licence expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases and their labels.
NOTICES = {
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"

GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_CLEAN = bytes(0x20 if GAP[b] else b for b in ts.LOWER.tolist())
_EXPRESSION = re.compile(r"spdx-license-identifier\s*:?[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def _read(expression: str, leaf: Callable, joined: Callable):
    """The value of a licence expression by shunting-yard: leaf(licence), joined(operator, left, right); None without a licence.

    `with` binds an exception to its licence, `and` joins, `or` separates. Reading stops at what can't go on; what
    was read up to there counts.
    """
    output: list = []
    stack: list[str] = []

    def apply(op: str) -> None:
        if len(output) < 2:
            return
        right, left = output.pop(), output.pop()
        output.append(joined(op, left, right))

    operand = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK and not operand:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                apply(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(" and operand:
            stack.append(token)
        elif token == ")" and not operand:
            while stack and stack[-1] != "(":
                apply(stack.pop())
            if not stack:
                break
            stack.pop()
        elif low not in _RANK and token not in "()" and operand:
            output.append(leaf(low))
            operand = False
        else:
            break
    while stack:
        if (op := stack.pop()) != "(":
            apply(op)
    return output[0] if output else None


def licences(expression: str) -> list[frozenset[str]]:
    """The alternatives of a licence expression, each the set of licences that hold together; none without a licence.

    Their number can double with each `and` of two `or`s; `families` needs none of them.
    """

    def joined(op: str, left: list[frozenset[str]], right: list[frozenset[str]]) -> list[frozenset[str]]:
        if op == "or":
            return left + right
        if op == "and":
            return [a | b for a in left for b in right]
        return [frozenset(f"{x} with {y}" for x in a for y in b) for a in left for b in right]

    return _read(expression, lambda low: [frozenset([low])], joined) or []


def families(expression: str) -> set[str]:
    """The families of all licences of an expression, whatever alternative they stand in; exceptions have none."""

    def joined(op: str, left: set[str], right: set[str]) -> set[str]:
        if op == "with":
            return left
        small, large = sorted((left, right), key=len)
        large |= small
        return large

    return _read(expression, lambda low: {label(low)}, joined) or set()


def label(licence: str) -> str:
    """A licence identifier's family: its letters up to a version, as 'gpl' for 'gpl-2.0-or-later with ...'."""
    return re.split(r"-?\d|\+| with |-only|-or-later", licence)[0].rstrip("-.") or licence


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, name in phrases.items():
            out.add_word(f" {phrase} ", (kind, name, len(phrase) + 2))
    out.make_automaton()
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        for part in ts.slices(batch, "_text"):
            data, offsets = ts.utf8(part.column("_text"))
            _, _, bounds = ts.words(ts.LOWER[data], offsets, GAP)
            raw, cuts = data.tobytes(), offsets.tolist()
            columns: list[list] = [[] for _ in range(6)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                text = " " + b" ".join(raw[a:b].translate(_CLEAN).split()).decode() + " "
                base, names, more, at = 0, set(), set(), []
                tags = notices = 0
                for end, (kind, name, size) in automaton.iter(text):
                    if kind == "base":
                        base += 1
                        names.add(name)
                        at.append(end - size + 1)
                    elif kind == "notice":
                        notices += 1
                        more.add(name)
                    else:
                        tags += 1
                if tags:
                    for found in _EXPRESSION.findall(raw[a:b].decode()):
                        more |= families(found)
                first, last = (text.count(" ", 0, at[0]), text.count(" ", 0, at[-1])) if at else (None, None)
                if len(at) > 1:
                    first, last = text.count(" ", 0, min(at)), text.count(" ", 0, max(at))
                # Each piece of evidence halves the doubt; a tag counts for two.
                score = 1.0 - 0.5 ** (base + notices + 2 * tags)
                for column, value in zip(columns, (base, first, last, ",".join(sorted(names)), ",".join(sorted(names | more)), score), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(np.diff(bounds)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are put in lower case. n_base counts the places where a base phrase's words
    stand consecutively; first_word and last_word are the smallest and largest start, null without any. labels are the base labels,
    those of further notices, and the families of all licences in tagged expressions. A null text is empty; null and repeated ids are
    kept as they are; an empty table gives no rows; other columns aren't read. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = rows.mapInArrow(_scan, "_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return found.withColumnRenamed("_id", id_col)

"""Toxicity by weak supervision.

Voters are proposed by one half of a bounded sample of labelled documents, its development half: a word (lexicon), or a word beginning
(pattern), that occurs at least m times. A generative label model estimates from the votes in both halves how often each voter speaks up in toxic
and in clean documents and how far voters repeat each other, which lowers their weight; labels are no votes, and those of the other half are never used.
A linear classifier on the counts of the voters' patterns is then trained on the posterior labels. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import forget, settle

_LETTERS = re.compile(r"[^\W\d_]+")
_BEGINNINGS = range(3, 8)
_LEAST = (1, 2, 4)


def patterns(word: str) -> list[str]:
    """The letter runs of a lower-cased word, and their beginnings marked by a star."""
    out = []
    for run in _LETTERS.findall(word.lower()):
        out.append(run)
        out.extend(run[:k] + "*" for k in _BEGINNINGS if len(run) > k)
    return out


def _counts(text: str | None, only: set[str] | None = None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter((text or "").split()).items():
        for p in patterns(word):
            if only is None or p in only:
                out[p] += n
    return out


class Model:
    """Patterns with the weights of their log counts, and a bias."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias
        self.number = {p: i for i, p in enumerate(names)}

    def scores(self, counts: np.ndarray) -> np.ndarray:
        z = self.bias + np.log1p(counts) @ self.weights if len(self.names) else np.full(len(counts), self.bias)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def voters(texts: Sequence, toxic: np.ndarray, most: int = 160, support: int = 4) -> list[tuple[str, int]]:
    """(pattern, least count) voters that speak for toxicity, the most telling first, none that repeats a former one: `most` at the most, out of eight times as many.

    Counts of all patterns are held for one text at a time. texts may be an Arrow array.
    """

    def each(of: bool | None = None) -> Iterator[str | None]:
        return (getattr(x, "as_py", lambda x=x: x)() for x, t in zip(texts, toxic.tolist(), strict=True) if of is None or t == of)

    total = {1: int(toxic.sum()), 0: int((~toxic).sum())}
    seen = {True: Counter(), False: Counter()}
    often: Counter = Counter()
    for text in each(True):
        often.update(_counts(text).keys())
    names = {p for p, n in often.items() if n >= support}
    del often
    for text in each(True):
        seen[True].update((p, m) for p, n in _counts(text, names).items() for m in _LEAST if n >= m)
    likely = {v for v, n in seen[True].items() if n >= support}
    for text in each(False):
        c = _counts(text, names)
        seen[False].update(v for p in c for m in _LEAST if c[p] >= m and (v := (p, m)) in likely)

    def gain(v: tuple[str, int]) -> float:
        a, b = seen[True][v], seen[False][v]
        p, q, r = (a + 0.5) / (total[1] + 1), (b + 0.5) / (total[0] + 1), (a + b + 0.5) / (len(toxic) + 1)
        if p < 4 * q:
            return 0.0
        return a * math.log(p / r) + b * math.log(q / r) + (total[1] - a) * math.log((1 - p) / (1 - r)) + (total[0] - b) * math.log((1 - q) / (1 - r))

    ranked = sorted(((g, v) for v in likely if (g := gain(v)) > 2.0), key=lambda x: (-x[0], x[1]))
    chosen: list[tuple[str, int]] = []
    sets: list[frozenset] = []
    where: dict[tuple[str, int], set] = {v: set() for _, v in ranked[: 8 * most]}
    names = {p for p, _ in where}
    of = {}
    for v in where:
        of.setdefault(v[0], []).append(v)
    for i, text in enumerate(each()):
        c = _counts(text, names)
        for p in c.keys() & of.keys():
            for v in of[p]:
                if c[p] >= v[1]:
                    where[v].add(i)
    for v, rows in where.items():
        if len(chosen) < most and not any(len(rows & s) >= 0.95 * len(rows | s) for s in sets):
            chosen.append(v)
            sets.append(frozenset(rows))
    return chosen


def posterior(votes: np.ndarray, development: np.ndarray, toxic: np.ndarray, trust: float = 1.0, rounds: int = 10) -> np.ndarray:
    """P(toxic) of each document by the label model, from the votes alone (documents x voters).

    The labels `toxic` of the development documents give the estimates' start, their prior (each counts `trust` documents) and, after each
    round, slope and offset of the log odds, as voters depend on each other beyond what damping removes. No label is a vote.
    """
    every = votes.astype(float)
    told = every[development]
    hits, known = np.stack([told[toxic == k].sum(0) for k in (False, True)]) * trust, np.array([(~toxic).sum(), toxic.sum()]) * trust
    false, hit = (hits + 0.5) / (known[:, None] + 1)
    weight = np.ones(every.shape[1])
    for _ in range(rounds):
        z = every @ (weight * np.log(hit / false)) + (1 - every) @ (weight * np.log((1 - hit) / (1 - false)))
        slope, offset = train(z[development][:, None], toxic.astype(float), ridge=0.01, rounds=60)
        y = 1 / (1 + np.exp(-np.clip(max(slope[0], 0.0) * z + offset, -30, 30)))
        hit = (y @ every + hits[1] + 0.5) / (y.sum() + known[1] + 1)
        false = ((1 - y) @ every + hits[0] + 0.5) / ((1 - y).sum() + known[0] + 1)
        # Voters that go together beyond what the class explains count for less.
        rest = every - np.outer(y, hit) - np.outer(1 - y, false)
        scale = np.sqrt((rest**2).mean(0)) + 1e-9
        alike = (rest.T @ rest) / len(rest) / np.outer(scale, scale)
        np.fill_diagonal(alike, 0)
        weight = 1 / (1 + np.maximum(alike, 0).sum(1))
    return y


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(texts: Sequence, toxic: np.ndarray, development: np.ndarray) -> Model:
    """Voters come from the development rows; the label model and the classifier learn from the votes in all rows, without their labels.

    Without development documents of both kinds there is nothing to learn: the score is then the share of toxic ones (0 without any).
    """
    if not development.any() or toxic[development].all() or not toxic[development].any():
        development = np.ones(len(toxic), bool)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Model([], np.zeros(0), -30.0 if share == 0 else 30.0)
    at = np.flatnonzero(development)
    chosen = voters(texts.take(pa.array(at)) if hasattr(texts, "take") else [texts[i] for i in at], toxic[at])
    names = list(dict.fromkeys(p for p, _ in chosen))
    only = set(names)
    counts = [_counts(getattr(x, "as_py", lambda x=x: x)(), only) for x in texts]
    votes = np.array([[c[p] >= m for p, m in chosen] for c in counts], bool).reshape(len(counts), len(chosen))
    x = np.log1p(np.array([[c[p] for p in names] for c in counts], float).reshape(len(counts), len(names)))
    return Model(names, *train(x, posterior(votes, at, toxic[at]), ridge=0.1))


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    pairs = [(i, k) for i, word in enumerate(coded.dictionary.to_pylist()) for p in patterns(word) if (k := model.number.get(p)) is not None]
    table = np.zeros((len(texts), len(model.names)))
    if pairs:
        word, kind = np.array(pairs).T
        index = coded.indices.to_numpy()
        used = np.zeros(len(coded.dictionary), bool)
        used[word] = True
        at = np.flatnonzero(used[index])
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        doc = np.searchsorted(bounds, at, "right") - 1
        first = np.searchsorted(word, index[at], "left")
        many = np.searchsorted(word, index[at], "right") - first
        row = np.repeat(doc, many)
        which = np.repeat(first, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        np.add.at(table, (row, kind[which]), 1)
    return model.scores(table)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ts.slices(batch, "_text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(_scores(part.column("_text"), model))], names=["_id", "score"])


def _clean(batches: Iterator[pa.RecordBatch], model: Model, text_col: str, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ts.slices(batch, text_col, 1 << 20):
            yield part.filter(pa.array(_scores(part.column(text_col), model) < threshold))


def _fold(c: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, most: int, most_bytes: int) -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (_fold(F.col("_id"), folds) != held))
    known = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(known), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    rows = settle(rows.where(F.octet_length("_text") <= most_bytes // 16).withColumn("_hash", F.xxhash64("_id")), "labelled")
    # At most `most` lengths, then texts of `most_bytes` at most, come to the driver.
    sizes = rows.select("_hash", F.octet_length("_text").alias("n")).toArrow().sort_by("_hash")
    fits = np.cumsum(sizes.column("n").to_numpy()) <= most_bytes
    last = int(sizes.column("_hash").to_numpy()[fits].max(initial=-(2**63)))
    found = rows.where(F.col("_hash") <= last).toArrow().sort_by([("_hash", "ascending"), ("_id", "ascending")])
    forget(rows)
    return learn(found.column("_text"), found.column("_label").to_numpy().astype(bool), found.column("_hash").to_numpy() % 2 == 0)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7, most: int = 6000, most_bytes: int = 96 << 20) -> DataFrame:
    """The rows of docs, all columns, whose score stays under the threshold; see toxicity(). Nothing is shuffled."""
    model = fit(docs, labels, id_col, text_col, label_col, folds, held, most, most_bytes)
    return docs.mapInArrow(lambda b: _clean(b, model, text_col, threshold), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7, most: int = 6000, most_bytes: int = 96 << 20) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Learns from at most `most` labelled documents (by a hash of the id) whose crc32(id as text) mod folds is not `held`, with texts of at most
    `most_bytes` together, a sixteenth of that each; null labels and ids aren't learnt from, of rows that repeat an id one is, a null text is empty. Every whole text is scored, empty ones too; score is P(label 1) and predicted is 1 from
    `threshold` on. Language, source and id are no inputs of a score. A null id counts as empty text for held_out. An empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, label_col, folds, held, most, most_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    scored = rows.mapInArrow(lambda b: _score(b, model), "_id long, score double")
    return scored.select(F.col("_id").alias(id_col), (_fold(F.col("_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Substring dedup with automata of repeated phrases.

Round 1 finds candidates: each window of `window` words picks its minimal `gram`-word gram, and shards say which picks stand in two
documents. Every recurring window has a recurring pick, so none is missed. Round 2 sends, for each recurring pick, the words around it that its
windows can reach (the passage), each distinct passage once a block, to the shard of the pick. There, phrases (windows) that
recur among the passages of different documents are compiled into Aho-Corasick automata, sharded by pick, and the passages of all documents are streamed
through them to locate every occurrence; a phrase's smallest document is the smallest one in which it is located.

The words of a passage go as 48-bit codes. A pick that occurs over `hot` times in the corpus would make a shard too large: its windows are
compared by 128 bits of hash instead, each distinct one once a block, in shards of their own.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .exchange import NO_ID, Asked, Held, grid, marked, member, received, recurring, smaller, split, starts_of

_OUT = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


class _Words:
    """The words of a block: documents one after another."""

    def __init__(self, docs: pa.Table, window: int, gram: int):
        self.ids = docs.column("_id").to_numpy()
        self.data, self.offsets = ts.utf8(docs.column("_text"))
        self.starts, self.ends, self.bounds = ts.words(self.data, self.offsets)
        n = len(self.starts)
        codes = np.empty(n, np.uint64)
        step = np.append(np.arange(0, n, 1 << 16), n)
        for a, b in zip(step, step[1:], strict=False):  # bounds the hashing's working arrays
            lo, hi = self.starts[a], self.ends[b - 1]
            codes[a:b] = ts.span_hashes(ts.byte_codes()[self.data[lo:hi]], self.starts[a:b] - lo, self.ends[a:b] - lo)
        self.codes = codes
        grams = ts.gram_sums(codes, gram)
        self.at, self.pick = ts.minimisers(grams, self.bounds, gram, window)
        self.grams = ts.mixed(grams) & ~np.uint64(1)
        self.doc = ts.owners(self.bounds)
        self.window, self.gram = window, gram

    def picks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct picked places, and the sorted keys of their grams, marked and counted."""
        picked = np.unique(self.pick)
        return picked, *marked(self.grams[picked], self.ids[self.doc[picked]])

    def candidates(self, told: list[bytes]) -> None:
        """Passages around recurring picks, and windows of hot ones, with the smallest id of the block for each distinct one."""
        picked, keys, _ = self.picks()
        again, hot = received(told, "?", 2).T
        keys = (keys >> np.uint64(1)) << np.uint64(1)
        place = picked[member(self.grams[picked], keys[again & ~hot])]
        doc = self.doc[place]
        self.lo = np.maximum(self.bounds[doc], place - (self.window - self.gram))
        self.hi = np.minimum(self.bounds[doc + 1], place + self.window)
        around = ts.span_hashes(self.codes, self.lo, self.hi) ^ ts.mixed((place - self.lo).astype(np.uint64))
        self.passages = Held(self.grams[place], around, self.ids[doc])
        self.at = self.at[member(self.grams[self.pick], keys[hot])]
        one = ts.span_hashes(self.codes, self.at, self.at + self.window)
        two = ts.span_hashes(ts.mixed(self.codes ^ np.uint64(0x5851F42D4C957F2D)), self.at, self.at + self.window)
        self.windows = Held(one, two, self.ids[self.doc[self.at]])

    def sent(self) -> np.ndarray:
        """The words of the distinct passages as 48-bit codes, a row for each, filled up with zeros."""
        lo, hi = self.lo[self.passages.sample], self.hi[self.passages.sample]
        reach = np.arange(2 * self.window - self.gram)
        inside = reach < (hi - lo)[:, None]
        rows = np.zeros(inside.shape, np.uint64)
        rows[inside] = self.codes[(lo[:, None] + reach)[inside]] | np.uint64(1 << 16)
        return np.ascontiguousarray(rows.view(np.uint8).reshape(*inside.shape, 8)[:, :, 2:]).reshape(len(lo), 6 * len(reach)).view(f"V{6 * len(reach)}").ravel()


def _picks(docs: pa.Table, window: int, gram: int) -> list[tuple]:
    return [(1, *_Words(docs, window, gram).picks()[1:])]


def _passages(docs: pa.Table, heard: dict, window: int, gram: int) -> list[tuple]:
    w = _Words(docs, window, gram)
    w.candidates(heard.get(1, []))
    return [(2, w.passages.one, w.passages.owner, w.sent()), (3, w.windows.one, w.windows.two, w.windows.owner)]


def _located(parts: list, window: int, most: int = 20_000) -> list[np.ndarray]:
    """For each passage: bit j is set where the window from its word j on also stands in a passage of a smaller id.

    Passages that share a window share its pick, so an automaton is for whole picks, of about `most` passages.
    """
    key, owner, packed = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(starts_of(key[order]))
    cuts = first[np.append(True, np.diff(first // most) > 0)]
    mask = np.zeros(len(key), np.uint16)
    for rows in np.split(order, cuts[1:]):
        mask[rows] = _streamed(packed[rows], owner[rows], window)
    return split(mask, parts)


def _streamed(packed: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    distinct, number = np.unique(packed, return_inverse=True)
    n, width = len(distinct), packed.dtype.itemsize // 6
    codes = np.zeros((n, width + 1, 8), np.uint8)  # a gap after each passage
    codes[:, :width, 2:] = distinct.view(np.uint8).reshape(n, width, 6)
    codes = codes.view(np.uint64).reshape(n, width + 1)
    least, largest = np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, number, owner)
    np.maximum.at(largest, number, owner)

    # Recurring windows: those of passages of different documents.
    row, j = np.nonzero(codes[:, window - 1 : width] > 0)
    start = row * (width + 1) + j
    hashes = ts.span_hashes(codes.ravel(), start, start + window)
    order = np.argsort(hashes)
    at = np.flatnonzero(starts_of(hashes[order]))
    several = np.minimum.reduceat(least[row[order]], at) < np.maximum.reduceat(largest[row[order]], at)
    phrases = start[order[at[several]]]
    if not len(phrases):
        return np.zeros(len(owner), np.uint16)

    # A word is written in two symbols, each of an alphabet of its own, so that no node has many children and no match
    # begins inside a word; the gap is a word that no phrase holds.
    kinds = np.unique(codes[codes > 0])
    numbers = np.where(codes > 0, np.searchsorted(kinds, codes) + 1, 0).ravel()
    base = int(np.ceil((len(kinds) + 1) ** 0.5))
    symbols = np.stack([numbers // base, base + numbers % base], 1).astype("<u4") + 0x100
    symbols += np.where(symbols >= 0xD800, 0x800, 0).astype("<u4")  # past the code points that stand for no character
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for value, p in enumerate(phrases.tolist()):
        automaton.add_word(symbols[p : p + window].tobytes().decode("utf-32-le"), value)
    automaton.make_automaton()
    ends, values = np.array(list(automaton.iter(symbols.tobytes().decode("utf-32-le")))).T
    place = ends // 2 - window + 1
    row, j = place // (width + 1), place % (width + 1)
    smallest = np.full(len(phrases), NO_ID)
    np.minimum.at(smallest, values, least[row])
    of = np.full((n, width - window + 1), NO_ID)
    of[row, j] = smallest[values]
    return ((of[number] < owner[:, None]) << np.arange(width - window + 1)).sum(1).astype(np.uint16)


def _removed(w: _Words, heard: dict) -> np.ndarray:
    """Which words go."""
    cover = np.zeros(len(w.starts) + 1, np.int64)

    def add(lo: np.ndarray, hi: np.ndarray) -> None:
        np.add.at(cover, lo, 1)
        np.add.at(cover, hi, -1)

    # A passage that a smaller document of the block holds goes whole.
    later = w.passages.later
    add(w.lo[later], w.hi[later])
    masks = received(heard.get(2, []), "u2")[w.passages.number[~later]]
    for j in range(w.window - w.gram + 1):
        on = w.lo[~later][(masks >> j) & 1 > 0] + j
        add(on, on + w.window)
    on = w.at[w.windows.later | received(heard.get(3, []), "?")[w.windows.number]]
    add(on, on + w.window)
    return np.cumsum(cover[:-1]) > 0


def _result(docs: pa.Table, heard: dict, window: int, gram: int) -> pa.Table:
    w = _Words(docs, window, gram)
    w.candidates(heard.get(1, []))
    gone = _removed(w, heard)
    # Kept words with the one gap byte after each, as a space.
    edge = np.zeros(len(w.data) + 2, np.int32)
    edge[w.starts[~gone]] += 1
    edge[w.ends[~gone] + 1] -= 1
    inside = np.cumsum(edge[: len(w.data)]) > 0
    stop = w.offsets[1:][w.offsets[1:] > w.offsets[:-1]]
    text = np.where(ts.SPACE[w.data], np.uint8(32), w.data)
    # A word at its text's end has no gap byte, and must not take the next text's first byte with it.
    joined = np.zeros(len(w.data) + 1, bool)
    joined[stop] = True
    lone = inside & joined[:-1]
    lone[w.starts[~gone]] = False
    inside &= ~lone
    at = np.concatenate([[0], np.cumsum(inside)])[w.offsets]
    kept = text[inside]
    whole, cuts = kept.tobytes(), at.tolist()
    sha = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        sha.append(hashlib.sha256(whole[a : b - 1 if b > a and whole[b - 1] == 32 else b]).hexdigest())
    removed = np.concatenate([[0], np.cumsum(gone)])[w.bounds]
    return pa.table([pa.array(w.ids), pa.array(np.diff(w.bounds)), pa.array(np.diff(removed)), pa.array(sha)], schema=_OUT)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, hot: int = 20_000, **size: int) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller id; windows are judged
    on the input. A null text has no words. Null ids count as one document with the largest id; rows that repeat an id
    are one document, too, so that they take nothing from each other. Other columns aren't read. size: see grid().
    """
    if not 0 <= window - gram < 16:
        raise ValueError("a passage may hold at most 16 windows")
    g = grid(docs, id_col, text_col, **size)
    first = {1: Asked(("u8", "u4"), lambda parts: recurring(parts, hot), "?", 2)}
    second = {2: Asked(("u8", "i8", f"V{6 * (2 * window - gram)}"), lambda parts: _located(parts, window), "u2"), 3: Asked(("u8", "u8", "i8"), smaller, "?")}
    heard = g.reply(g.ask(lambda d: _picks(d, window, gram)), first)
    heard = heard.unionAll(g.reply(g.ask(lambda d, h: _passages(d, h, window, gram), heard), second))
    out = g.tell(lambda d, h: _result(d, h, window, gram), heard, "_id long, n_words long, n_removed long, kept_sha256 string", _OUT)
    return out.select(F.nullif("_id", F.lit(int(NO_ID))).alias(id_col), "n_words", "n_removed", "kept_sha256")

"""Suffix-array dedup of long byte matches with run-length compressed indexes.

1. Each window of `window` bytes picks its minimal `gram`-byte gram (the anchor); shards say which anchors stand in two documents.
2. The context of an anchor is all bytes that a window with this anchor can reach. Contexts are compared by hash: one that
   stands whole in a smaller document is removed whole. Of an anchor with several contexts, each context's first
   document sends its bytes, once.
3. Each shard builds a run-compressed Burrows-Wheeler transform of the contexts sent to it, with sampled run ends, streams
   the matching statistics of every context over it, and marks the windows whose match of full length also stands in a context of a smaller document.

A window that a smaller document also holds has the same anchor in both, so it lies in contexts that meet in one shard:
the result is that of comparing all windows, though only the edges of matches are ever compared byte by byte.
An anchor that occurs over `hot` times in the corpus (a run of blanks, a common tag) would make one index too large: the windows around it are
compared by 128 bits of hash instead, each distinct one once a block, in shards of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .exchange import NO_ID, Asked, Held, grid, marked, member, received, recurring, smaller, split, starts_of
from .runindex import END, RunIndex

_OUT = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


class _Bytes:
    """The anchors of a block's documents: position, hash, and the hash and bounds of the context."""

    def __init__(self, docs: pa.Table, window: int, gram: int, piece: int = 1 << 18):
        self.ids = docs.column("_id").to_numpy()
        self.data, self.offsets = ts.utf8(docs.column("_text"))
        step = self.offsets[:-1] // piece
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(self.ids)]
        found = [self._anchors(a, b, window, gram) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        self.key, self.lo, self.hi, self.context, self.doc = (np.concatenate(x) for x in zip(*found, strict=True))
        self.window = window

    def _anchors(self, a: int, b: int, window: int, gram: int) -> tuple:
        base = self.offsets[a]
        data, offsets = self.data[base : self.offsets[b]], self.offsets[a : b + 1] - base
        codes = ts.byte_codes()[data]
        grams = ts.gram_sums(codes, gram)
        picked = np.zeros(len(data), bool)
        picked[ts.minimisers(grams, offsets, gram, window)[1]] = True
        pos = np.flatnonzero(picked)
        doc = np.searchsorted(offsets, pos, "right") - 1
        lo, hi = np.maximum(offsets[doc], pos - (window - gram)), np.minimum(offsets[doc + 1], pos + window)
        # The anchor's place in its context matters where a text's end cuts the context.
        context = ts.span_hashes(codes, lo, hi) ^ ts.mixed((pos - lo).astype(np.uint64))
        return ts.mixed(grams[pos]) & ~np.uint64(1), lo + base, hi + base, context, doc + a

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        return marked(self.key, self.ids[self.doc])

    def pairs(self, told: list[bytes]) -> None:
        """Keeps anchors that recur, as distinct (anchor, context) pairs with the block's smallest id for each, and the windows around hot ones."""
        keys, _ = self.anchors()
        keys = (keys >> np.uint64(1)) << np.uint64(1)
        again, hot = received(told, "?", 2).T
        around = member(self.key, keys[hot])
        # All windows that hold a hot anchor; those that picked another one do no harm.
        reach = np.arange(self.window)
        at = (self.lo[around][:, None] + reach)[reach <= (self.hi - self.lo)[around][:, None] - self.window] if around.any() else np.zeros(0, np.int64)
        self.at = np.unique(at)
        self.windows = Held(*self._hashes(self.at), self.ids[np.searchsorted(self.offsets, self.at, "right") - 1])
        keep = member(self.key, keys[again & ~hot])
        self.key, self.lo, self.hi, self.context, self.doc = (x[keep] for x in (self.key, self.lo, self.hi, self.context, self.doc))
        self.held = Held(self.key, self.context, self.ids[self.doc])

    def _hashes(self, at: np.ndarray, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows at sorted places."""
        one, two = np.zeros((2, len(at)), np.uint64)
        edges = [0, *(np.flatnonzero(np.diff(at // piece)) + 1).tolist(), len(at)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                codes = ts.byte_codes()[self.data[at[a] : at[b - 1] + self.window]]
                start = at[a:b] - at[a]
                one[a:b] = ts.span_hashes(codes, start, start + self.window)
                two[a:b] = ts.span_hashes(ts.mixed(codes), start, start + self.window)
        return one, two


def _anchor_keys(docs: pa.Table, window: int, gram: int) -> list[tuple]:
    return [(1, *_Bytes(docs, window, gram).anchors())]


def _contexts(docs: pa.Table, heard: dict, window: int, gram: int) -> list[tuple]:
    b = _Bytes(docs, window, gram)
    b.pairs(heard.get(1, []))
    return [(2, b.held.one, b.held.two, b.held.owner), (4, b.windows.one, b.windows.two, b.windows.owner)]


def _judge(parts: list) -> list[np.ndarray]:
    """Two bits for each (anchor, context, id): a smaller id elsewhere; this is the context's first, and the anchor has others."""
    key, context, owner = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((owner, context, key))
    first = starts_of(key[order], context[order])
    least = owner[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    group = np.cumsum(starts_of(key[order])) - 1
    several = np.bincount(group, first)[group] > 1
    found = np.empty((len(key), 2), bool)
    found[order, 0] = least < owner[order]
    found[order, 1] = several & (least == owner[order])
    return split(found, parts)


def _send(docs: pa.Table, heard: dict, window: int, gram: int) -> list[tuple]:
    """The bytes of the contexts that are wanted, after the id and the length."""
    b = _Bytes(docs, window, gram)
    b.pairs(heard.get(1, []))
    at = b.held.sample[received(heard.get(2, []), "?", 2)[:, 1]]
    lo, size = b.lo[at], b.hi[at] - b.lo[at]
    width = 2 * window - gram
    reach = np.arange(width)
    text = np.where(reach < size[:, None], b.data[np.minimum(lo[:, None] + reach, len(b.data) - 1)], 0) if len(at) else np.zeros((0, width))
    return [(3, b.key[at], b.ids[b.doc[at]], size, np.ascontiguousarray(text.astype(np.uint8)).view(f"V{width}").ravel())]


def _long_matches(parts: list, window: int, most: int = 4096) -> list[np.ndarray]:
    """For each context: bit j is set where the window from j on also stands in a context of a smaller id.

    Contexts that share a window share an anchor, so an index holds whole anchors, of about `most` contexts.
    """
    key, owner, size, text = (np.concatenate([p[i] for p in parts]) for i in range(4))
    text = text.view(np.uint8).reshape(len(key), -1)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(starts_of(key[order]))
    cuts = first[np.append(True, np.diff(first // most) > 0)]
    mask = np.zeros(len(key), np.uint64)
    for rows in np.split(order, cuts[1:]):
        mask[rows] = _index_matches(text[rows], owner[rows], size[rows], window)
    return split(mask, parts)


def _index_matches(text: np.ndarray, owner: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    n = len(owner)
    length = size + 1
    start = np.cumsum(length) - length
    codes = np.full(int(length.sum()), END, np.int16)
    reach = np.arange(text.shape[1])
    inside = reach < size[:, None]
    codes[(start[:, None] + reach)[inside]] = text[inside]
    index = RunIndex(codes, window)
    longest, place = index.stream(start, start + size)
    holder = np.repeat(np.arange(n), length)
    # The smallest id among the documents that hold the same window.
    order = np.argsort(index.same)
    new = np.ones(len(codes), bool)
    new[1:] = index.same[order][1:] != index.same[order][:-1]
    least = np.empty(len(codes), np.int64)
    least[order] = np.minimum.reduceat(owner[holder[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    long = np.flatnonzero(longest >= window)
    long = long[least[place[long]] < owner[holder[long]]]
    mask = np.zeros(n, np.uint64)
    np.bitwise_or.at(mask, holder[long], np.uint64(1) << (long - start[holder[long]]).astype(np.uint64))
    return mask


def _result(docs: pa.Table, heard: dict, window: int, gram: int) -> pa.Table:
    b = _Bytes(docs, window, gram)
    b.pairs(heard.get(1, []))
    told = received(heard.get(2, []), "?", 2)
    masks = np.zeros(len(b.held.sample), np.uint64)
    masks[told[:, 1]] = received(heard.get(3, []), "u8")
    cover = np.zeros(len(b.data) + 1, np.int32)

    def add(lo: np.ndarray, hi: np.ndarray) -> None:
        np.add.at(cover, lo, 1)
        np.add.at(cover, hi, -1)

    number, later = b.held.number, b.held.later
    whole = (told[number, 0] | later) & (b.hi - b.lo >= window)
    add(b.lo[whole], b.hi[whole])
    part = np.flatnonzero(~whole & ~later & (masks[number] > 0))
    row, j = np.nonzero((masks[number[part]][:, None] >> np.arange(window - gram + 1, dtype=np.uint64)) & np.uint64(1))
    at = b.lo[part[row]] + j
    add(at, at + window)
    at = b.at[b.windows.later | received(heard.get(4, []), "?")[b.windows.number]]
    add(at, at + window)
    gone = np.cumsum(cover[:-1]) > 0
    kept = b.data[~gone].tobytes()
    removed = np.concatenate([[0], np.cumsum(gone)])[b.offsets]
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    inner = b.offsets[:-1][b.offsets[:-1] < len(gone)]
    starts[inner] = gone[inner]  # a run never goes on from one text to the next
    spans = np.concatenate([[0], np.cumsum(starts)])[b.offsets]
    cuts = (b.offsets - removed).tolist()
    sha = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(cuts, cuts[1:], strict=False)]
    return pa.table([pa.array(b.ids), pa.array(np.diff(b.offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.array(sha)], schema=_OUT)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 20, hot: int = 20_000, **size: int) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay).

    A byte of a text in UTF-8 goes if a string of `window` bytes that covers it also starts in a document with a smaller id; strings
    are judged on the input and never cross documents. A null text is empty. Null ids count as one document with the
    largest id; rows that repeat an id are one document, too, and take nothing from each other. Other columns aren't read. size: see grid().
    """
    if not 0 <= window - gram < 64:
        raise ValueError("a context may hold at most 64 windows")
    g = grid(docs, id_col, text_col, **size)
    first = {1: Asked(("u8", "u4"), lambda parts: recurring(parts, hot), "?", 2)}
    second = {2: Asked(("u8", "u8", "i8"), _judge, "?", 2), 4: Asked(("u8", "u8", "i8"), smaller, "?")}
    third = {3: Asked(("u8", "i8", "i8", f"V{2 * window - gram}"), lambda parts: _long_matches(parts, window), "u8")}
    heard = g.reply(g.ask(lambda d: _anchor_keys(d, window, gram)), first)
    heard = heard.unionAll(g.reply(g.ask(lambda d, h: _contexts(d, h, window, gram), heard), second))
    heard = heard.unionAll(g.reply(g.ask(lambda d, h: _send(d, h, window, gram), heard), third))
    out = g.tell(lambda d, h: _result(d, h, window, gram), heard, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _OUT)
    return out.select(F.nullif("_id", F.lit(int(NO_ID))).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")

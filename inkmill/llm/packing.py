"""Hierarchical residual best-fit packing of tokenised documents into sequences.

Each partition tokenises its documents, cuts the long ones, and packs the pieces best-fit, longest first. Bins that are nearly full
leave; the underfull ones become items of their own size, which groups of bounded size pack best-fit again, round
after round, with fewer groups each time, until one group is left or a round hardly helps.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import settle

_PIECES = pa.schema([("_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_bin", pa.int64()), ("_offset", pa.int64())])
_tokenizers: dict[tuple, _Tokenizer] = {}


class _Tokenizer:
    """Token ids by distinct words; words are apart for this kind of tokenizer, which drops white space.

    Ids of the `most` first words are kept for later batches; any other word is encoded again.
    """

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}

    @classmethod
    def of(cls, path: str, most: int) -> _Tokenizer:
        if (path, most) not in _tokenizers:
            _tokenizers[path, most] = cls(path, most)
        return _tokenizers[path, most]

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text followed by the id `end`, and n + 1 offsets."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = [self.known.get(w) for w in words]
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self.tokenizer.encode_batch_fast([words[i] for i in new], add_special_tokens=False), strict=True):
            ids[i] = x.ids
            if len(self.known) < self.most:
                self.known[words[i]] = ids[i]
        ids.append([end])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, at = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), np.cumsum(size) - size
        # Each text's words, then the end as one more word.
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        n = len(bounds) - 1
        stop = bounds[1:] + np.arange(n)
        order = np.full(bounds[-1] + n, len(ids) - 1)
        is_word = np.ones(len(order), bool)
        is_word[stop] = False
        order[is_word] = coded.indices.to_numpy()
        length = size[order]
        ends = np.cumsum(length)
        gather = np.arange(ends[-1] if n else 0) + np.repeat(at[order] - (ends - length), length)
        return flat[gather], np.concatenate([[0], ends[stop]]) if n else np.zeros(1, np.int64)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, the largest items first, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, used = 0, 0  # some: bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            chosen = by_room[room].pop()
            if not by_room[room]:
                some ^= 1 << room
        else:
            chosen, room = used, capacity
            used += 1
        bins[i], offsets[i] = chosen, capacity - room
        by_room[room - size].append(chosen)
        some |= 1 << (room - size)
    return bins, offsets


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, most: int, piece_bytes: int, words: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, base = _Tokenizer.of(path, words), TaskContext.get().partitionId() << 33
    kept: list[list[np.ndarray]] = []
    count = 0

    def packed() -> pa.RecordBatch:
        nonlocal base
        doc, null, piece, start, length, crc = (np.concatenate(x) for x in zip(*kept, strict=True))
        bins, offsets = best_fit(length, capacity)
        bins += base
        base = int(bins.max()) + 1
        return pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(bins), pa.array(offsets)], schema=_PIECES)

    for batch in batches:
        for part in ts.slices(batch, "_text", piece_bytes):
            ids, bounds = encode(part.column("_text"), end)
            size = np.diff(bounds)
            pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            at = bounds[doc] + start
            data = memoryview(ids.astype("<u4")).cast("B")
            crc = np.array([zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)], np.int64)
            names = part.column("_id")
            kept.append([pc.fill_null(names, 0).to_numpy()[doc], names.is_null().to_numpy(zero_copy_only=False)[doc], piece, start, length, crc])
            count += len(doc)
            if count >= most:
                yield packed()
                kept, count = [], 0
    if kept:
        yield packed()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0, slack: int = 4, group: int = 50_000, most: int = 200_000, piece_bytes: int = 2 << 20, words: int = 300_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's token ids (a null text: none) and then the id `end`; only one longer than capacity is cut, into pieces of
    that length and a rest. tokenizer: path of a file for the library tokenizers whose pre-tokenizer drops white space. Rows that repeat an
    id are packed each for itself, and null ids stay null. Bins with at most `slack` free places leave at
    once; a group packs about `group` underfull bins again. An empty table gives no rows; other columns aren't read.
    A worker tokenises piece_bytes of text at a time and keeps the ids of `words` words: more of both takes memory and saves time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    pieces = settle(rows.mapInArrow(lambda b: _pack(b, tokenizer, capacity, end, most, piece_bytes, words), "_id long, piece int, start long, length long, ids_crc32 long, _bin long, _offset long"), "pieces")
    # root: a bin of the first round; bin and shift: where its items stand now.
    open_ = settle(pieces.groupBy("_bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity - slack).select(F.col("_bin").alias("root"), "_bin", F.lit(0).cast("long").alias("shift"), "fill"), "open")
    moved = None
    left = open_.count()
    while left > 1:
        groups = max(1, -(-left // group))
        merged = (
            open_.groupBy("_bin").agg(F.max("fill").alias("fill"))
            .withColumn("_group", F.pmod(F.xxhash64("_bin", F.lit(groups)), F.lit(groups)))
            .groupBy("_group").applyInArrow(lambda t: _merge(t, capacity), "_bin long, _to long, _by long, _fill long")
        )
        now = settle(open_.join(merged, "_bin").select("root", F.col("_to").alias("_bin"), (F.col("shift") + F.col("_by")).alias("shift"), F.col("_fill").alias("fill")), "merged")
        done = now if groups == 1 else now.where(F.col("fill") >= capacity - slack)
        moved = done if moved is None else moved.unionAll(done)
        if groups == 1:
            break
        before, open_ = left, settle(now.where(F.col("fill") < capacity - slack), "open")
        left = open_.select("_bin").distinct().count()
        if left > 0.98 * before:
            moved = moved.unionAll(open_)
            break
    out = pieces.withColumns({"sequence_id": F.col("_bin"), "offset": F.col("_offset")})
    if moved is not None:
        to = moved.select(F.col("root").alias("_bin"), F.col("_bin").alias("_to"), "shift")
        out = pieces.join(to, "_bin", "left").withColumns({"sequence_id": F.coalesce("_to", "_bin"), "offset": F.col("_offset") + F.coalesce("shift", F.lit(0))})
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _merge(table: pa.Table, capacity: int) -> pa.Table:
    """Packs underfull bins as items; a merged bin takes the number of its first one."""
    order = np.lexsort((table.column("_bin").to_numpy(), -table.column("fill").to_numpy()))
    names, fill = table.column("_bin").to_numpy()[order], table.column("fill").to_numpy()[order]
    bins, offsets = best_fit(fill, capacity)
    total = np.bincount(bins, fill).astype(np.int64)
    first = names[np.unique(bins, return_index=True)[1]]
    return pa.table({"_bin": names, "_to": first[bins], "_by": offsets, "_fill": total[bins]})

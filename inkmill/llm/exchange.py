"""Blocks of documents that ask shards of keys which of their keys other blocks hold, too.

Documents are dealt into blocks by a hash of id and text. A block sends each of its distinct keys once, sorted, one packet for each range of
64-bit hashes; shards answer each packet in the packet's own order, often with a bit a key. So a key that
a third of all documents hold reaches its shard once per block, nothing is broadcast, and no list of the corpus's keys
ever stands in one place. Blocks are recomputed from the same shuffle in every round, so a lost executor costs a retry.

Blocks and shards grow with the corpus, the packets that a block sends don't: there are at most `fan` ranges. With more shards than that, a range
holds several, and routers, one for each range and `fan` blocks, merge the blocks' packets, cut them by shard, and deal the answers
back. Packets thus grow in proportion to the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

PACKET = "_block int, _shard int, _round int, _data binary"
_PACKET = pa.schema([("_block", pa.int32()), ("_shard", pa.int32()), ("_round", pa.int32()), ("_data", pa.binary())])
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Asked:
    """What a round's packets hold and how they are answered."""

    kinds: tuple[str, ...]  # NumPy types of the columns, sorted keys first; 'runs' stands for squeezed keys
    decide: Callable  # packets as lists of columns -> for each an array with a row of answers for each key
    answer: str  # NumPy type of an answer; '?' is sent as bits
    width: int = 1  # answers to a key


@dataclass(frozen=True)
class Grid:
    rows: DataFrame  # _block, _id, _text
    blocks: int
    ranges: int  # that blocks send to
    each: int  # shards of a range
    fan: int

    @property
    def shards(self) -> int:
        return self.ranges * self.each

    def ask(self, make: Callable, replies: DataFrame | None = None) -> DataFrame:
        """Packets that make(block table[, replies]) gives as a list of (round, sorted uint64 keys, further columns...)."""
        ranges = self.ranges

        def block(docs: pa.Table, heard: pa.Table | None = None) -> pa.Table:
            if not docs.num_rows:
                return _PACKET.empty_table()
            number = docs.column("_block")[0].as_py()
            return packets(number, 0, ranges, ranges, make(docs) if heard is None else make(docs, answers(heard)))

        if replies is None:
            return self.rows.groupBy("_block").applyInArrow(lambda docs: block(docs), PACKET)
        return self.rows.groupBy("_block").cogroup(replies.groupBy("_block")).applyInArrow(lambda docs, heard: block(docs, heard), PACKET)

    def tell(self, make: Callable, replies: DataFrame, schema: str, out: pa.Schema) -> DataFrame:
        """Rows that make(block table, replies by round) gives as a table."""

        def block(docs: pa.Table, heard: pa.Table) -> pa.Table:
            return make(docs, answers(heard)) if docs.num_rows else out.empty_table()

        return self.rows.groupBy("_block").cogroup(replies.groupBy("_block")).applyInArrow(lambda docs, heard: block(docs, heard), schema)

    def route(self, sent: DataFrame, asked: dict[int, Asked]) -> DataFrame:
        """Packets by shard: the blocks' own, or those of routers (whose `_block` is the number of a group of blocks)."""
        if self.each == 1:
            return sent
        each, shards, fan = self.each, self.shards, self.fan
        return self._grouped(sent).applyInArrow(lambda t: _down(t, each, shards, fan, asked), PACKET)

    def _grouped(self, sent: DataFrame):
        return sent.groupBy("_shard", F.floor(F.col("_block") / F.lit(self.fan)).alias("_group"))

    def reply(self, sent: DataFrame, asked: dict[int, Asked]) -> DataFrame:
        """The answers to the blocks' packets, by block.

        They are dealt by block here, so that each later round reads this shuffle again instead of asking the shards anew.
        """
        told = self.route(sent, asked).groupBy("_shard").applyInArrow(lambda t: _decided(t, asked), PACKET)
        if self.each > 1:
            back = told.groupBy(F.floor(F.col("_shard") / F.lit(self.each)).alias("_range"), F.col("_block").cast("long").alias("_group"))
            told = self._grouped(sent).cogroup(back).applyInArrow(lambda a, b: _up(a, b, asked), PACKET)
        return told.repartition(partitions(sent.sparkSession), "_block")

    def total(self, sent: DataFrame, asked: dict[int, Asked], sums: Callable, names: tuple[str, ...]) -> DataFrame:
        """One reply of round 0 to each block: the sums over all shards of what sums(packets as lists of columns) gives, as big-endian longs."""
        kinds = next(iter(asked.values())).kinds

        def shard(t: pa.Table) -> pa.Table:
            found = sums([unpack(x, kinds) for x in t.column("_data").to_pylist()])
            return pa.table([pa.array([int(x)], pa.int64()) for x in found], names=list(names))

        parts = self.route(sent, asked).groupBy("_shard").applyInArrow(lambda t: shard(t), ", ".join(f"{n} long" for n in names))
        whole = parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        data = F.unhex(F.concat(*[F.lpad(F.hex(n), 16, "0") for n in names]))
        told = whole.select(F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("_block"), F.lit(-1).alias("_shard"), F.lit(0).alias("_round"), data.alias("_data"))
        # Dealt like the other replies: else their union would deal all of them again.
        return told.repartition(partitions(sent.sparkSession), "_block")


def grid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, fan: int = 4096) -> Grid:
    """Deals docs into blocks of about block_bytes of text and into half as many shards, each as many as shuffle partitions at least.

    A null id becomes the largest."""
    n = partitions(docs.sparkSession)
    size = docs.select(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    blocks, shards = max(n, size // block_bytes), max(n, size // (2 * block_bytes))
    each = -(-shards // fan)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("int").alias("_block"), "_id", "_text")
    return Grid(rows, int(blocks), int(-(-shards // each)), int(each), fan)


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as the number of distinct ones, these, and how often each stands."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return np.uint64(len(at)).tobytes() + keys[at].tobytes() + np.diff(at, append=len(keys)).astype(np.uint32).tobytes()


def packets(block: int, first: int, last: int, shards: int, sent: list[tuple]) -> pa.Table:
    """One row for each shard from first to last (of so many in all) that has any of the sorted keys; the data are the columns one after another.

    Keys given as ('runs', keys) are squeezed."""
    edges = np.array([(i << 64) // shards for i in range(first + 1, last)], np.uint64)
    out: list[tuple] = []
    for round_, keys, *columns in sent:
        put, keys = (squeezed, keys[1]) if isinstance(keys, tuple) else (np.ndarray.tobytes, keys)
        cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        out += [(first + s, round_, put(keys[a:b]) + b"".join(c[a:b].tobytes() for c in columns)) for s in np.flatnonzero(np.diff(cuts)).tolist() for a, b in [cuts[s : s + 2]]]
    shard, rounds, data = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array([block] * len(out), pa.int32()), pa.array(shard, pa.int32()), pa.array(rounds, pa.int32()), pa.array(data, pa.binary())], schema=_PACKET)


def unpack(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """A packet's columns, of the given NumPy types; 'runs' at first stands for squeezed keys."""
    out, at = [], 0
    if kinds[0] == "runs":
        n = int(np.frombuffer(data, np.uint64, 1)[0])
        out, kinds, at = [np.repeat(np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n))], kinds[1:], 8 + 12 * n
    n = (len(data) - at) // sum(np.dtype(k).itemsize for k in kinds)
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def answers(heard: pa.Table) -> dict[int, list[bytes]]:
    """Replies by round, in the order of the shards: that of the sorted keys."""
    out: dict[int, list] = {}
    for _, round_, _, data in _packets(heard):
        out.setdefault(round_, []).append(data)
    return out


def _packets(table: pa.Table) -> list[tuple[int, int, int, bytes]]:
    """(shard, round, block, data), in order."""
    return sorted(zip(*(table.column(c).to_pylist() for c in ("_shard", "_round", "_block", "_data")), strict=True), key=lambda x: x[:3])


def _rows(rows: list[tuple]) -> pa.Table:
    """A table of (block, shard, round, data)."""
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PACKET.types)], schema=_PACKET)


def _by_round(table: pa.Table) -> dict[int, list[tuple[int, int, int, bytes]]]:
    out: dict[int, list] = {}
    for packet in _packets(table):
        out.setdefault(packet[1], []).append(packet)
    return out


def _decided(table: pa.Table, asked: dict[int, Asked]) -> pa.Table:
    out = []
    for round_, got in _by_round(table).items():
        told = asked[round_].decide([unpack(x[3], asked[round_].kinds) for x in got])
        out += [(x[2], x[0], round_, said(t)) for x, t in zip(got, told, strict=True)]
    return _rows(out)


def _merged(got: list[tuple], asked: Asked) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """The packets' sizes, their columns one after another, and the order that sorts the keys."""
    parts = [unpack(x[3], asked.kinds) for x in got]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return [len(p[0]) for p in parts], columns, np.argsort(columns[0], kind="stable")


def _down(table: pa.Table, each: int, shards: int, fan: int, asked: dict[int, Asked]) -> pa.Table:
    """A router's way out: the packets of its blocks as one packet for each shard of its range."""
    shard, group, sent = table.column("_shard")[0].as_py(), table.column("_block")[0].as_py() // fan, []
    for round_, got in _by_round(table).items():
        _, (keys, *columns), order = _merged(got, asked[round_])
        keys = keys[order]
        sent.append((round_, ("runs", keys) if asked[round_].kinds[0] == "runs" else keys, *(c[order] for c in columns)))
    return packets(group, shard * each, (shard + 1) * each, shards, sent)


def _up(table: pa.Table, back: pa.Table, asked: dict[int, Asked]) -> pa.Table:
    """A router's way back: the shards' answers, dealt to the blocks' packets."""
    out, told = [], _by_round(back)
    for round_, got in _by_round(table).items():
        a = asked[round_]
        sizes, _, order = _merged(got, a)
        answer = received([x[3] for x in told[round_]], a.answer, a.width)
        dealt = np.empty_like(answer)
        dealt[order] = answer
        out += [(x[2], x[0], round_, said(t)) for x, t in zip(got, np.split(dealt, np.cumsum(sizes)[:-1]), strict=True)]
    return _rows(out)


def said(answer: np.ndarray) -> bytes:
    """An array of answers as the bytes of a reply. Of two numbers to a key the second, often that of the key before, is sent where it changes."""
    if answer.dtype != bool and answer.ndim == 2:
        new = starts_of(answer[:, 1])
        data = answer[:, 0].tobytes() + np.packbits(new).tobytes() + answer[new, 1].tobytes()
        return len(answer).to_bytes(4, "little") + zlib.compress(data, 1)
    return answer.size.to_bytes(4, "little") + np.packbits(answer).tobytes() if answer.dtype == bool else answer.tobytes()


def received(parts: list[bytes], kind: str, width: int = 1) -> np.ndarray:
    """Answers one after another; a row for each key where there are several to a key."""
    if kind == "?":
        bits = [np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=int.from_bytes(x[:4], "little")).astype(bool) for x in parts]
        out = np.concatenate([np.zeros(0, bool), *bits])
    elif width == 2:
        return np.concatenate([np.zeros((0, 2), kind), *(_two(x, np.dtype(kind)) for x in parts)])
    else:
        out = np.frombuffer(b"".join(parts), kind)
    return out.reshape(-1, width) if width > 1 else out


def _two(reply: bytes, kind: np.dtype) -> np.ndarray:
    """The two numbers to each key of a reply."""
    n, data = int.from_bytes(reply[:4], "little"), zlib.decompress(reply[4:])
    first, bits = n * kind.itemsize, -(-n // 8)
    new = np.unpackbits(np.frombuffer(data, np.uint8, bits, first), count=n).astype(bool)
    return np.stack([np.frombuffer(data, kind, n), np.frombuffer(data, kind, -1, first + bits)[np.cumsum(new) - 1]], 1)


def split(found: np.ndarray, parts: list) -> list[np.ndarray]:
    """Rows for the keys of all packets as an array for each packet."""
    return np.split(found, np.cumsum([len(p[0]) for p in parts])[:-1])


def recurring(parts: list[list[np.ndarray]], hot: int) -> list[np.ndarray]:
    """For packets of (key, how often the block holds it), where a key's lowest bit says that two documents of the block hold it:
    whether two documents hold the key, and whether it occurs over `hot` times."""
    keys = np.concatenate([p[0] for p in parts])
    kinds, number = np.unique(keys >> np.uint64(1), return_inverse=True)
    many = np.bincount(number) + np.bincount(number, keys & np.uint64(1)) > 1
    often = np.bincount(number, np.concatenate([p[1] for p in parts])) > hot
    return split(np.stack([many, often & many], 1)[number], parts)


def marked(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (of 63 bits, shifted left), sorted, and how often each stands; the lowest bit is set where two documents hold the key."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order] >> np.uint64(1), docs[order]
    at = np.flatnonzero(starts_of(keys))
    many = np.diff(at, append=len(keys))
    return (keys[at] << np.uint64(1)) | (docs[at] != docs[at + many - 1]).astype(np.uint64), many.astype(np.uint32)


def starts_of(*sorted_: np.ndarray) -> np.ndarray:
    """Where sorted columns take another value than in the row before."""
    new = np.ones(len(sorted_[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_])
    return new


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each key stands among sorted ones."""
    at = np.searchsorted(among, keys)
    return (at < len(among)) & (among[np.minimum(at, len(among) - 1)] == keys) if len(among) else np.zeros(len(keys), bool)


def smaller(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For (hash, hash, id): whether another packet has the same hashes with a smaller id."""
    one, two, owner = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((owner, two, one))
    first = starts_of(one[order], two[order])
    found = np.empty(len(one), bool)
    found[order] = owner[order][np.flatnonzero(first)][np.cumsum(first) - 1] < owner[order]
    return split(found, parts)


class Held:
    """Distinct (hash, hash) pairs of a block's items, with the smallest id of each, sorted."""

    def __init__(self, one: np.ndarray, two: np.ndarray, owner: np.ndarray):
        order = np.lexsort((owner, two, one))
        first = starts_of(one[order], two[order])
        self.number = np.empty(len(one), np.int64)  # of each item among the distinct ones
        self.number[order] = np.cumsum(first) - 1
        self.sample = order[first]
        self.one, self.two, self.owner = one[self.sample], two[self.sample], owner[self.sample]
        self.later = owner > self.owner[self.number]  # a smaller document of the block holds the item

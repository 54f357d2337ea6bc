"""N-gram Jaccard join by rare-first prefix filtering, down to connected components.

A document's distinct shingles stand in one global order, rarest first: by a count sketch of fixed size over all documents, then by
hash. Documents that are similar enough share a shingle of their prefixes. Per shingle, candidates pass the length
and the positional filter, then once per pair the suffix filter and the comparison of the whole sets.

Pairs within a large group aren't spelled out. First, each document of a shingle's list is compared with the list's head alone,
the document for which the shingle stands first in order (of near copies, the one with the fewest shingles of its own).
Only documents of different components after that are paired within a list, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import forget, settle
from .components import components

_SLOTS, _PARTS = 1 << 20, 16


def _shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle of each text and n + 1 bounds; a text of fewer words has one, of all its words."""
    data, offsets = ts.utf8(texts)
    data = ts.LOWER[data]
    starts, ends, bounds = ts.words(data, offsets)
    codes = ts.span_hashes(ts.byte_codes()[data], starts, ends)
    count = np.diff(bounds)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(number)])
    doc = np.repeat(np.arange(len(count)), number)
    at = np.arange(out[-1]) - out[doc] + bounds[doc]
    return ts.span_hashes(codes, at, np.minimum(at + size, bounds[doc + 1])), out


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    sums = np.zeros(_SLOTS, np.uint32)
    for batch in batches:
        for part in ts.slices(batch, "_text"):
            hashes, _ = _shingles(part.column("_text"), size)
            sums += np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=_SLOTS).astype(np.uint32)
    task = TaskContext.get().partitionId()
    for k, piece in enumerate(np.split(sums, _PARTS)):
        yield pa.RecordBatch.from_pydict({"_part": pa.array([k], pa.int32()), "_task": pa.array([task % 64], pa.int32()), "_sum": pa.array([piece.tobytes()], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in table.column("_sum").to_pylist())
    total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pa.table({"_part": table.column("_part").slice(0, 1), "_task": pa.array([0], pa.int32()), "_sum": pa.array([total.tobytes()], pa.binary())})


def rank_table(docs: DataFrame, size: int) -> np.ndarray:
    """For each slot of the hashes, a rank from 0 (rare) to 255: eighths of powers of two of the slot's count."""
    schema = "_part int, _task int, _sum binary"
    sums = docs.select("_text").mapInArrow(lambda b: _sketches(b, size), schema)
    sums = sums.groupBy("_part", "_task").applyInArrow(_added, schema).groupBy("_part").applyInArrow(_added, schema)
    rows = {r["_part"]: np.frombuffer(r["_sum"], np.uint32) for r in sums.collect()}
    counts = np.concatenate([rows.get(k, np.zeros(_SLOTS // _PARTS, np.uint32)) for k in range(_PARTS)])
    return np.minimum(np.log2(np.maximum(counts, 1)) * 8, 255).astype(np.uint8)


def _ordered(texts: pa.Array, size: int, rank: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles in the global order: the rank in the top 8 bits, then 56 bits of the hash."""
    hashes, bounds = _shingles(texts, size)
    keys = rank[(hashes >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | ts.mixed(hashes) >> np.uint64(8)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.sort(keys[a:b])
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own)
    return out


def _entries(batches: Iterator[pa.RecordBatch], size: int, share: int, rank) -> Iterator[pa.RecordBatch]:
    """Prefix entries, and one row with no shingle for each row of the input, which bears its set's size."""
    for batch in batches:
        for part in ts.slices(batch, "_text"):
            sets = _ordered(part.column("_text"), size, rank.value)
            n = np.array([len(s) for s in sets], np.int64)
            prefix = np.where(n > 0, n - -(-share * n // 100) + 1, 0)
            doc = np.repeat(np.arange(len(n)), prefix)
            key = np.concatenate([s[:p] for s, p in zip(sets, prefix.tolist(), strict=True)] or [np.zeros(0, np.uint64)])
            ids = part.column("_id").take(pa.array(doc))
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids, pa.array(n[doc].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["key", "id", "n", "pos"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), part.column("_id"), pa.array(n.astype(np.int32)), pa.nulls(len(n), pa.int32())], names=["key", "id", "n", "pos"])


def _alike(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """100 * intersection >= share * union, after a suffix filter: halves around a pivot can't differ by more than the bound in size."""
    both = len(a) + len(b)
    least = -(-share * both // (100 + share))
    if len(a) > 8 and len(b) > 8:
        pivot = b[len(b) // 2]
        left = int(np.searchsorted(a, pivot))
        if abs(left - len(b) // 2) + abs((len(a) - left) - (len(b) - len(b) // 2)) > both - 2 * least:
            return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= share * (both - same)


def _verified(batches: Iterator[pa.RecordBatch], size: int, share: int, rank) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ts.slices(batch, "ta"):
            texts = pc.dictionary_encode(part.column("ta"), null_encoding="encode")  # one copy of a text that stands in many pairs
            own = _ordered(texts.dictionary, size, rank.value)
            other = _ordered(part.column("tb"), size, rank.value)
            good = [_alike(own[k], s, share) for k, s in zip(texts.indices.to_pylist(), other, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(good, pa.bool_())), part.column("b").filter(pa.array(good, pa.bool_()))], names=["a", "b"])


def _may_link(share: int) -> F.Column:
    """Length and positional filter of two prefix entries x and y of the same shingle."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    least = F.ceil(F.lit(share) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + share) - F.lit(1e-9))
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return (F.col("x.id") != F.col("y.id")) & (100 * small >= share * large) & (rest >= least)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, share: int = 85) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id that links reach, itself included).

    Two documents link when 100 * intersection >= share * union of their sets of `size`-word shingles (words are runs of bytes that
    aren't white space, A-Z in lower case; fewer words are one shingle). A text without words, or null, has the empty set
    and links with nothing. A row with a null id links with nothing and has a null component. Rows that repeat an id share
    its component, and each of their texts can link it. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rank = spark.sparkContext.broadcast(rank_table(rows, size))  # always _SLOTS bytes
    found = settle(rows.mapInArrow(lambda b: _entries(b, size, share, rank), "key long, id long, n int, pos int"), "entries")
    entries = found.where("key IS NOT NULL AND id IS NOT NULL")

    # The head of each list; only lists of several documents go on.
    order = F.shiftleft(F.col("pos").cast("long"), 40).bitwiseOR(F.shiftrightunsigned(F.xxhash64("id"), 24))
    heads = entries.withColumn("o", order).groupBy("key").agg(F.min_by("id", "o").alias("id"), F.min_by("n", "o").alias("n"), F.min_by("pos", "o").alias("pos"), F.count(F.lit(1)).alias("_many")).where("_many > 1").drop("_many")
    lists = settle(entries.alias("x").join(heads.alias("y"), F.col("x.key") == F.col("y.key")).select("x.*", F.struct("y.id", "y.n", "y.pos").alias("y")), "lists")
    sizes = settle(found.where("key IS NULL").select("id", "n"), "sizes")
    forget(found)
    texts = rows.where("_id IS NOT NULL")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        with_a = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("ta")), "a")
        with_b = with_a.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("tb")), "b")
        return settle(with_b.select("a", "b", "ta", "tb").mapInArrow(lambda b: _verified(b, size, share, rank), "a long, b long"), "links")

    links = verified(lists.alias("x").where(_may_link(share)).select(F.col("x.id").alias("x"), F.col("y.id").alias("y")))
    near = components(links, "a", "b")
    marked = settle(lists.select("key", "id", "n", "pos").join(near, "id", "left").select("key", "id", "n", "pos", F.coalesce("component", "id").alias("c")), "marked")
    forget(lists)
    open_ = marked.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    open_ = marked.join(open_, "key")
    more = open_.alias("x").join(open_.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & _may_link(share))
    more = more.select(F.col("x.id").alias("x"), F.col("y.id").alias("y")).distinct()
    links = links.unionAll(verified(more))
    forget(marked)
    near = components(links, "a", "b")
    return sizes.join(near, "id", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))

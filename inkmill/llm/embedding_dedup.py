"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction made of one random code word for each block of the rotated vector; a vector passes the filters whose
directions it meets most closely, found by list-decoding block by block, so that none is without filters. Several independent rotations have filters
of their own. Vectors that share a filter are compared in double precision.
Copies of a vector are one class. Of the pairs found, each vector's number and links enough to hold its group together are kept, not the pairs. A filter that many vectors pass is dealt into blocks of bounded size, and pairs
of blocks are compared in different tasks, so no pair of a filter is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settle
from .components import components


class Codes:
    """Product codes for vectors of a dimension: `blocks` blocks of `words` unit vectors each, after a random rotation."""

    def __init__(self, dimension: int, blocks: int, words: int, passed: int, seed: int | list[int]):
        random = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(random.standard_normal((dimension, dimension)))[0]
        self.cuts = np.linspace(0, dimension, blocks + 1).astype(int)
        self.words, self.passed = words, passed
        self.tables = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            table = random.standard_normal((words, b - a))
            self.tables.append(table / np.linalg.norm(table, axis=1, keepdims=True))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Each row's `passed` filters of the largest scores. What isn't among the best of the blocks so far can't be among the best in the end."""
        turned = unit @ self.rotation
        name, total = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for a, b, t in zip(self.cuts, self.cuts[1:], self.tables, strict=False):
            s = turned[:, a:b] @ t.T
            word = np.argpartition(-s, min(self.passed, self.words) - 1, axis=1)[:, : self.passed]
            total = (total[:, :, None] + np.take_along_axis(s, word, 1)[:, None, :]).reshape(len(unit), -1)
            name = (name[:, :, None] * self.words + word[:, None, :]).reshape(len(unit), -1)
            best = np.argsort(-total, axis=1, kind="stable")[:, : self.passed]
            name, total = np.take_along_axis(name, best, 1), np.take_along_axis(total, best, 1)
        return name


def rotations_of(dimension: int, count: int, load: int, passed: float, rotations: int, seed: int) -> list[tuple]:
    """What the codes for `count` vectors are made of, a tuple for each rotation."""
    directions = max(16.0, count * passed / load)
    blocks = min(dimension, 2 if directions < 4e6 else 3)
    words = max(4, math.ceil(directions ** (1 / blocks)))
    return [(dimension, blocks, words, math.ceil(min(passed, words**blocks / 2)), [seed, k]) for k in range(rotations)]


def _filters(batches: Iterator[pa.RecordBatch], make: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
    """A row for each filter of each vector, with the names of all its filters."""
    codes = {}
    for batch in batches:
        sizes = pc.binary_length(batch.column("data")).to_numpy() // 8
        for dim in np.unique(sizes).tolist():
            if dim not in codes:
                codes[dim] = [Codes(*m) for m in make.get(dim, [])]
            rows = np.flatnonzero(sizes == dim)
            for start in range(0, len(rows) if codes[dim] else 0, 2048):
                part = batch.take(pa.array(rows[start : start + 2048]))
                x = _units(part.column("data"))
                names = np.sort(np.concatenate([c.decode(x) * len(codes[dim]) + k for k, c in enumerate(codes[dim])], axis=1), axis=1)
                at = pa.array(np.repeat(np.arange(len(x)), names.shape[1]))
                every = pa.array([n.tobytes() for n in names], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(names.ravel()), *(part.column(c).take(at) for c in ("id", "copies", "data")), every.take(at)], names=["dim", "filter", "id", "copies", "data", "names"])


def _units(data: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in data.to_pylist()])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as doubles in bytes; those that can't be compared go. Very large and very small ones are scaled by their largest component."""
    for batch in batches:
        keep, data = [], []
        for i, v in enumerate(batch.column("vector").to_pylist()):
            if v and None not in v:
                x = np.array(v, np.float64)
                most = np.abs(x).max()
                if 0 < most < np.inf:  # false for NaN
                    keep.append(i)
                    data.append(((x if 1e-100 < most < 1e100 else x / most) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array(data, pa.binary())], names=["id", "data"])


def _near(table: pa.Table, least: float) -> pa.Table:
    """What a slot's tasks find: for each vector how many others it links with, copies counted, and a smaller vector of its group.

    A task is a filter's pair of blocks (side 0 and 1), or one block with itself (side 2). A pair counts where the filter is the first one that
    both vectors pass, so once; of a task's links, as many go out as join its vectors into their groups.
    """
    dims, ids, copies, side = (table.column(c).to_numpy() for c in ("dim", "id", "copies", "side"))
    filters, data, every = table.column("filter").to_numpy(), table.column("data"), table.column("names").to_pylist()
    tasks: dict[tuple, list[int]] = {}
    for i, name in enumerate(zip(dims.tolist(), filters.tolist(), table.column("b0").to_pylist(), table.column("b1").to_pylist(), strict=True)):
        tasks.setdefault(name, []).append(i)
    found: list[tuple] = []
    for (_, name, _, _), rows in tasks.items():
        at = np.array(rows)
        x = _units(data.take(pa.array(at)))
        if side[at[0]] == 2:
            i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
        else:
            a, b = np.flatnonzero(side[at] == 0), np.flatnonzero(side[at] == 1)
            i, j = np.nonzero(x[a] @ x[b].T >= least)
            i, j = a[i], b[j]
        if not len(i):
            continue
        names = np.stack([np.frombuffer(every[r], np.int64) for r in rows])
        first = np.empty(len(i), bool)
        for k in range(0, len(i), 1 << 15):
            p, q = names[i[k : k + (1 << 15)]], names[j[k : k + (1 << 15)]]
            earlier = (p[:, :, None] == q[:, None, :]) & (p < name)[:, :, None]
            first[k : k + (1 << 15)] = ~earlier.any((1, 2))
        count = np.bincount(i, copies[at[j]] * first, len(at)) + np.bincount(j, copies[at[i]] * first, len(at))
        group = ids[at].copy()
        while True:
            before = group.copy()
            np.minimum.at(group, i, before[j])
            np.minimum.at(group, j, before[i])
            if (group == before).all():
                break
        linked = np.union1d(i, j)
        found.append((ids[at[linked]], count[linked].astype(np.int64), group[linked]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("id", "n", "other"), columns, strict=True)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, load: int = 32, passed: float = 10.0, rotations: int = 2, block: int = 512, seed: int = 11) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors of the same length link whose cosine in double precision is at least `least` and that share a filter (a vector passes `passed` filters of each
    rotation, of so many that about `load` vectors pass one). n_links counts the other vectors linked directly, copies included; component_id is
    the smallest id reachable; kept where it is the row's own. Null or zero vectors and such with null or non-finite components
    link with nothing, as do rows with a null id (null component, not kept). An empty table gives no rows. Other columns aren't read.
    """
    n = partitions(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    packed = settle(rows.where("id IS NOT NULL").mapInArrow(_packed, "id long, data binary"), "packed")
    classes = settle(packed.groupBy("data").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    lengths = classes.groupBy((F.octet_length("data") / 8).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("count"), F.sum("copies").alias("rows")).collect()
    make = {r["dim"]: rotations_of(r["dim"], r["count"], load, passed, rotations, seed) for r in lengths if r["count"] > 1}
    hot = max(1000, sum(r["rows"] for r in lengths) // (8 * n))
    schema = "dim int, filter long, id long, copies long, data binary, names binary"
    passing = settle(classes.select(F.col("rep").alias("id"), "copies", "data").mapInArrow(lambda b: _filters(b, make), schema), "passing")
    sizes = passing.groupBy("dim", "filter").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # So many slots that one holds about 8,192 rows, whatever the input's size.
    slots = max(8 * n, (sizes.agg(F.sum(F.col("_n") * F.col("parts"))).first()[0] or 0) // 8192)
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    tasks = (
        passing.join(sizes.drop("_n"), ["dim", "filter"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"b0": F.least("own", "other"), "b1": F.greatest("own", "other")})
        .withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") == F.col("b0"), 0).otherwise(1))
        .withColumn("slot", F.pmod(F.xxhash64("dim", "filter", "b0", "b1"), F.lit(slots)).cast("int"))
        .select("slot", "dim", "filter", "b0", "b1", "side", "id", "copies", "data", "names")
    )
    found = settle(tasks.groupBy("slot").applyInArrow(lambda t: _near(t, least), "id long, n long, other long"), "found")
    near = components(found.select("id", "other"), "id", "other")
    linked = found.groupBy(F.col("id").alias("a")).agg(F.sum("n").alias("more"))
    of_class = (
        classes.join(near, F.col("rep") == F.col("id"), "left").drop("id")
        .join(linked, F.col("rep") == F.col("a"), "left")
        .select("data", "copies", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    # Vectors of over `hot` copies, at most eight for each partition, are looked up without dealing their copies by vector.
    many = F.broadcast(of_class.where(F.col("copies") > hot))
    few = packed.join(F.broadcast(classes.where(F.col("copies") > hot).select("data")), "data", "left_anti").join(of_class.where(F.col("copies") <= hot), "data")
    told = packed.join(many, "data").select("id", "n_links", "component_id").unionAll(few.select("id", "n_links", "component_id"))
    # Rows that repeat an id with another vector keep their own counts, and the smallest component.
    alone = rows.where("id IS NULL").select("id").unionAll(rows.where("id IS NOT NULL").select("id").exceptAll(packed.select("id")))
    alone = alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return told.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


import importlib.util
import math

import numpy as np
import pytest

from inkmill.llm.embedding_dedup import Codes, near_vectors, rotations_of
from inkmill.llm.exchange import Asked, grid, recurring
from inkmill.llm.license_scan import families, label, licences, license_scan
from inkmill.llm.mixing import mix
from inkmill.llm.substring_dedup import _picks


def close_pairs(n, dimension, cosine, seed=5):
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("count", [100, 2_000, 20_000, 1_000_000, 10_000_000, 100_000_000])
def test_filters_of_close_vectors(count):
    codes = [Codes(*m) for m in rotations_of(64, count, 32, 10.0, 2, 11)]
    for cosine in (0.95, 0.995):
        x, y = close_pairs(600, 64, cosine)
        met = np.zeros(600, bool)
        for c in codes:
            met |= (c.decode(x)[:, :, None] == c.decode(y)[:, None, :]).any((1, 2))
        assert met.mean() > 0.95


@pytest.mark.parametrize("pairs", [1_000, 10_000])
def test_pairs_near_the_threshold_link(spark, pairs):
    x, y = close_pairs(pairs, 64, 0.9501)
    rows = [(i, v) for i, v in enumerate(np.concatenate([x, y]).tolist())]
    rows += [(2 * pairs + i, (3.7 * v).tolist()) for i, v in enumerate(x[:200])]  # scaled copies, of cosine 1
    got = {r["vec_id"]: r["component_id"] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[pairs + i] == i for i in range(pairs)) > 0.95 * pairs
    assert all(got[2 * pairs + i] == i for i in range(200))


def test_vectors_of_all_lengths_and_sizes(spark):
    x = [0.5, -1.0, 2.0, 0.0, 1.0, 3.0, -2.0, 1.0]
    rows = [(1, x), (2, x), (3, [*x, 1.0]), (4, [*x, 1.0]), (5, [1e200 * v for v in x]), (6, [1e-200 * v for v in x]), (7, [1e308] * 3), (8, [1.0] * 3), (9, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 5: (3, 1), 6: (3, 1), 3: (1, 3), 4: (1, 3), 7: (1, 7), 8: (1, 7), 9: (0, 9)}


def test_counts_of_a_large_group(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(16) + 0.05 * rng.standard_normal((300, 16))
    rows = [(i, v) for i, v in enumerate([*x.tolist(), *x[:40].tolist()])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=32).collect()
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    mine = np.array([r["n_links"] for r in sorted(got, key=lambda r: r["vec_id"])])
    assert (mine <= want).all() and mine.sum() >= 0.9 * want.sum() and {r["component_id"] for r in got} == {0}


@pytest.mark.parametrize("n", [150, 600])
def test_packets_in_proportion_to_blocks(spark, n):
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40), k -> md5(concat(id, '-', k)))) AS text")
    g = grid(docs, block_bytes=4_000, fan=16)
    asked = {1: Asked(("u8", "u4"), lambda parts: recurring(parts, 100), "?", 2)}
    out = g.ask(lambda d: _picks(d, 13, 5))
    assert g.blocks > n // 4 and g.each == -(-max(4, n * 1319 // 8_000) // 16)
    assert out.count() <= 16 * g.blocks and g.route(out, asked).count() <= 16 * g.blocks


def test_mixing_stage_with_clashing_names(spark):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no corpus_pipeline.py")
    import corpus_pipeline as cp

    rows = [(1, "a b c", "s", 7, 8, 9), (2, None, "s", 1, 2, 3), (None, "d e", None, 4, 5, 6), (2, "", "t", 1, 2, 3), (5, "f " * 500, "t", 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _times int, id int, doc int")
    empty = cp.settle(docs.limit(0), "empty")
    for name, stage in cp.STAGES[1:4]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.count() > 0 and stage(spark, empty, "").count() == 0, name


def test_all_licences_of_long_expressions(spark):
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "xy"]  # 20 pairs: 2^20 alternatives
    paired = " AND ".join(f"({a}-1.0 OR {b}-2.0)" for a, b in zip(names[::2], names[1::2], strict=True))
    nine = "({}) and ({})".format(*(" or ".join(f"{s}{c}" for c in "abcdefghi") for s in "pq"))
    df = spark.createDataFrame([(1, "SPDX-License-Identifier: " + paired), (2, "SPDX-License-Identifier: " + nine)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan(df).collect()}
    assert got[1] == ",".join(sorted(names)) and got[2] == ",".join(sorted(s + c for s in "pq" for c in "abcdefghi"))
    for e in ("A OR B AND C-1.0 WITH D", "(GPL-2.0 OR MIT) WITH (X OR Y)", "(A AND B) WITH C OR", "A AND (B", ")", ""):
        assert families(e) == {label(x) for choice in licences(e) for x in choice}
    assert len(licences("(A OR B)" + " AND (A OR B)" * 6)) == 128


def test_tiny_sources_get_their_targets(spark):
    rows = [(1, "a b c", "s"), (2, "a", "t"), (3, "a b c d e f g h i j", "u"), *((i, "w " * 500_000, "v") for i in range(4, 12))]
    got = {r["doc_id"]: r for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [(got[i]["taken"], got[i]["copies"]) for i in (1, 2, 3)] == [(9, 3), (3, 3), (30, 3)]

"""Each operator against brute force on small tables, with nulls, empty texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import importlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from inkmill.llm import queries
from inkmill.llm.common import table
from inkmill.llm.eliasfano import EliasFano, Levels, Trie, encode, restore
from inkmill.llm.embedding_dedup import near_vectors
from inkmill.llm.exact_dedup import exact_dedup
from inkmill.llm.jaccard_join import jaccard_components
from inkmill.llm.license_scan import BASE, license_scan, licences
from inkmill.llm.lm_scoring import score_texts
from inkmill.llm.mixing import mix
from inkmill.llm.packing import best_fit, pack
from inkmill.llm.q04 import tokenizer_path
from inkmill.llm.runindex import END, RunIndex
from inkmill.llm.substring_dedup import substring_dedup
from inkmill.llm.suffix_dedup import suffix_dedup
from inkmill.llm.toxicity import toxicity

LONG = "kata panjang " * 3000
ODD = [(1, " a b\tc d A", "s"), (2, None, "s"), (None, "a b c d e f", None), (4, "", "t"), (5, "x a b c y", "t"), (5, "x a b c y", "t"), (7, "b c d e", None), (8, LONG, "u"), (9, LONG, "u"), (10, "é ß 漢字", "u")]
WORD = r"[^\x20\x09-\x0D]+"
INF = 2**63 - 1


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, r[0], 1, "x", 2.0) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, keep_id long, n_words int, labels string, score double")


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data, "documents")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_oracles(spark, data):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        want = con.sql(sql)
        assert rows(queries.QUERIES[name](spark, data), *want.columns) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("hot", [1, 100])
def test_exact(odd, hot):
    got = exact_dedup(odd, hot=hot).collect()
    groups = collections.defaultdict(list)
    for i, t in pairs(odd):
        groups[t or ""].append(i)
    want = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert len(got) == len(ODD) and all((r["keep_id"], r["group_size"]) == want[r["text_sha256"]] for r in got)
    assert collections.Counter(r["text_sha256"] for r in got if r["kept"]) == dict.fromkeys(want, 1)


def brute_words(rows_, size):
    first, texts = {}, [(INF if i is None else i, re.findall(WORD, t or "")) for i, t in rows_]
    for i, w in sorted(texts):
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < i:
                gone[j : j + size] = [True] * size
        out.append((None if i == INF else i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram", "size"), [(3, 2, {}), (13, 5, {}), (13, 5, {"hot": 1}), (13, 5, {"hot": 3, "block_bytes": 20_000, "fan": 3})])
def test_substring(odd, docs, window, gram, size):
    for df in (odd, docs):
        assert rows(substring_dedup(df, window=window, gram=gram, **size), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(pairs(df), window)


def brute_bytes(rows_, size):
    first, texts = {}, [(INF if i is None else i, (t or "").encode()) for i, t in rows_]
    for i, b in sorted(texts):
        for j in range(len(b) - size + 1):
            first.setdefault(b[j : j + size], i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if first[b[j : j + size]] < i:
                gone[j : j + size] = b"\1" * size
        out.append((None if i == INF else i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram", "size"), [(7, 3, {}), (50, 20, {}), (50, 20, {"hot": 1}), (50, 20, {"hot": 3, "block_bytes": 10_000, "fan": 3})])
def test_suffix(odd, docs, window, gram, size):
    for df in (odd, docs.limit(60)):
        df = df.select("doc_id", "text")
        assert rows(suffix_dedup(df, window=window, gram=gram, **size), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(pairs(df), window)


def test_run_index_matches():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 2, n) for n in (40, 25, 60, 1, 33)]
    codes = np.concatenate([np.append(t, END) for t in texts]).astype(np.int16)
    stops = np.flatnonzero(codes == END)
    index = RunIndex(codes, 9)
    length, place = index.stream(np.append(0, stops[:-1] + 1), stops)
    for i in np.flatnonzero(codes != END):
        assert length[i] == min(9, stops[stops > i][0] - i)
        assert (codes[i : i + length[i]] == codes[place[i] : place[i] + length[i]]).all()


def brute_links(rows_, size, share):
    sets = {}
    for i, t in rows_:
        w = re.findall(WORD, low(t))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
    of = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
                    of[a] = of[b] = min(of[a], of[b])
    return sorted((i, len(sets[i]), of[i]) for i in ids)


@pytest.mark.parametrize(("size", "share"), [(4, 85), (5, 80)])
def test_jaccard(spark, size, share):
    base = [f"w{i}" for i in range(60)]
    texts = [(k, " ".join(w if (k * 7 + j * 13) % 41 else f"x{k}" for j, w in enumerate(base))) for k in range(14)] + [(20, None), (21, "A b"), (22, "a B"), (23, "")]
    df = spark.createDataFrame([(*r, 0) for r in texts], "doc_id long, text string, n_shingles int")
    assert rows(jaccard_components(df, size=size, share=share), "doc_id", "n_shingles", "component_id") == sorted(brute_links(texts, size, share), key=str)


def test_jaccard_odd(spark, odd):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(odd).collect()}
    # 5 stands twice; of 8 and 9, equal long texts, the smaller id; null ids and texts link with nothing.
    assert got == {(1, 2, 1), (2, 0, 2), (None, 3, None), (4, 0, 4), (5, 2, 5), (7, 1, 7), (8, 2, 8), (9, 2, 8), (10, 1, 10)}


def test_jaccard_repeated_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, b), (1, None), (2, b + " end"), (3, a + " end"), (4, "a0 a1 a2 a3 a9")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_components(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_mixing(odd, docs):
    for df in (odd, docs):
        got = mix(df).collect()
        by = collections.defaultdict(list)
        for r in got:
            by[r["source"]].append(r)
        names = sorted(by, key=lambda s: (s is None, s or ""))
        cap = {s: 3 * sum(r["size"] for r in by[s]) for s in names}
        weight, free, left, want = {s: i % 3 + 1 for i, s in enumerate(names)}, set(names), sum(r["size"] for r in got), {}
        while over := [s for s in free if left / sum(weight[x] for x in free) * weight[s] > cap[s]]:
            s = min(over, key=lambda x: cap[x] / weight[x])
            want[s], left = cap[s], left - cap[s]
            free.discard(s)
        want |= {s: left / sum(weight[x] for x in free) * weight[s] for s in free}
        for s in names:
            assert by[s][0]["target"] == pytest.approx(want[s]) and abs(sum(r["taken"] for r in by[s]) - want[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        assert sorted(map(str, mix(df).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("group", [5, 50_000])
def test_packing(odd, docs, group):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for df, cap in ((odd, 64), (docs, 2048)):
        got = pack(df, tokenizer_path(), capacity=cap, group=group).collect()
        want, total = collections.Counter(), 0
        for i, text in pairs(df):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            total += len(ids)
            want.update((i, k, s, len(ids[s : s + cap]), zlib.crc32(np.array(ids[s : s + cap], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), cap)))
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        seqs = collections.defaultdict(list)
        for r in got:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= cap
        assert len(seqs) <= 1.02 * total / cap + 2


def test_best_fit():
    bins, offsets = best_fit(np.array([5, 3, 6, 4, 2]), 10)
    assert len(set(bins.tolist())) == 2 and sorted(zip(bins.tolist(), offsets.tolist(), strict=True))[0][1] == 0


def test_language_model(odd, docs):
    for df in (odd, docs):
        tokens = [(i, [*re.findall(WORD, low(t)), "\0"]) for i, t in pairs(df)]
        fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
        c = collections.Counter(w for i, ws in tokens if fold(i) != 1 for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted(((i, fold(i) == 1, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens), key=str)
        got = sorted(score_texts(df, min_count=2).collect(), key=lambda r: str(tuple(r)))
        assert [tuple(r)[:5] for r in got] == [w[:5] for w in sorted(want, key=str)] or sorted(str(tuple(r)[:5]) for r in got) == sorted(str(w[:5]) for w in want)
        assert sorted(r["base_score"] for r in got) == pytest.approx(sorted(w[5] for w in want))
        assert all(r["score"] <= 0 for r in got)


def test_trie():
    context = np.array([3, 3, 9, 9, 9], np.uint64)
    word, count = np.array([1, 5, 2, 4, 7], np.uint64), np.array([2, 1, 1, 1, 8])
    p, rest, often = Trie(context, word, count, 0.75).find(np.array([3, 9, 9, 4], np.uint64), np.array([5, 7, 3, 1], np.uint64))
    assert restore(p) == pytest.approx([0.25 / 3, 7.25 / 10, 0, 0], rel=1e-3) and restore(rest) == pytest.approx([1.5 / 3, 2.25 / 10, 2.25 / 10, 0], rel=1e-3)
    assert often.tolist() == [0, 1, 0, 0]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 0), (500, 2**64 - 1), (5000, 900)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        levels = Levels()
        encode(levels, "v", v)
        e = EliasFano(levels.open(), "v")
        asked = rng.integers(0, top, 99, dtype=np.uint64, endpoint=True)
        assert (e[np.arange(n)] == v).all() and (e.successor(asked) == np.searchsorted(v, asked)).all()


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((6, 16))
    x = [(centre[i % 6] + 0.12 * rng.standard_normal(16)).tolist() for i in range(90)] + [[0.0] * 16, None, [1.0] * 15 + [float("nan")], [None] * 16, [1.0]]
    table_ = [(i, v, 0) for i, v in enumerate(x)] + [(None, x[0], 0), (200, x[3], 0)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(table_, "vec_id long, embedding array<double>, n_links int"), block=8).collect()}
    ids, m = [*range(90), 200], np.array([*x[:90], x[3]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = (m @ m.T >= 0.95).sum(1) - 1
    mine = np.array([got[i]["n_links"] for i in ids])
    assert (mine <= want).all() and mine.sum() >= 0.9 * want.sum() and len(got) == len(table_)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(90, 95)) and got[200]["component_id"] == got[3]["component_id"]
    assert got[None]["component_id"] is None


def test_licences(odd, docs):
    for df in (odd, docs):
        for i, n, b, first, last, names in rows(license_scan(df), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"):
            texts = [t for j, t in pairs(df) if j == i]
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(texts[0]))
            at = [(k, x) for p, x in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            assert (n, b, first, last, names) == (len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_licence_expressions(spark):
    assert licences("MIT AND (Apache-2.0 OR GPL-2.0-only)") == [frozenset({"mit", "apache-2.0"}), frozenset({"mit", "gpl-2.0-only"})]
    assert licences("A OR B AND C WITH D") == [frozenset({"a"}), frozenset({"b", "c with d"})]
    assert licences("") == licences(")(") == [] and licences("MIT OR") == [frozenset({"mit"})]
    df = spark.createDataFrame([(1, "// SPDX-License-Identifier: BSD-3-Clause\nMIT License")], "doc_id long, text string")
    r = license_scan(df).first()
    assert (r["base_labels"], r["labels"]) == ("mit", "bsd,mit") and 0 < r["score"] < 1


def test_toxicity(spark, data, odd):
    docs_, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = {r["doc_id"]: r for r in toxicity(docs_, labels).collect()}
    pairs_ = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    pos, neg = [g["score"] for g, t in pairs_ if t], [g["score"] for g, t in pairs_ if not t]
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg) > 0.9
    assert all(g["predicted"] == (g["score"] >= 0.7) and g["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, g in got.items())
    assert toxicity(odd, labels).count() == len(ODD)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert all(r["score"] < 1e-6 for r in toxicity(odd, none).collect())


def test_empty(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for f in (exact_dedup, substring_dedup, suffix_dedup, jaccard_components, mix, score_texts, license_scan, lambda d: pack(d, tokenizer_path()), lambda d: toxicity(d, labels)):
        assert f(none).count() == 0
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, data):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no corpus_pipeline.py")
    import corpus_pipeline as cp

    docs_ = table(spark, data, "documents")
    seen = {}
    for name, stage in cp.STAGES:
        before, docs_ = docs_, cp.settle(stage(spark, docs_, data), name)
        seen[name] = (before, docs_)
    kept = {r["doc_id"] for r in seen["toxicity"][1].collect()}
    scored = {r["doc_id"]: r["predicted"] for r in toxicity(seen["toxicity"][0], table(spark, data, "labels")).collect()}
    assert kept == {i for i, p in scored.items() if not p}
    best = {}
    for i, t in pairs(seen["exact_dedup"][0]):
        best[t] = max(best.get(t, -1), i)
    assert sorted(i for i, _ in pairs(seen["exact_dedup"][1])) == sorted(best.values())
    texts = pairs(seen["ngram_jaccard_join"][0])
    assert sorted(i for i, _ in pairs(seen["ngram_jaccard_join"][1])) == sorted(i for i, _, c in brute_links_once(texts) if i == c)
    times = {r["doc_id"]: r["copies"] for r in mix(seen["mixing"][0]).collect()}
    assert collections.Counter(i for i, _ in pairs(seen["mixing"][1])) == {i: n for i, n in times.items() if n}
    assert collections.Counter(r["doc_id"] for r in seen["packing"][1].where("piece = 0").collect()) == {i: n for i, n in times.items() if n}
    for name in ("toxicity", "exact_dedup", "ngram_jaccard_join", "mixing"):
        assert seen[name][1].columns == seen[name][0].columns
    assert cp.run(spark, data).count() == seen["packing"][1].count()


def brute_links_once(rows_):
    sets = {}
    for i, t in rows_:
        w = re.findall(WORD, low(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), root(i)) for i in ids]


@pytest.mark.parametrize("size", [{}, {"block_bytes": 20_000, "fan": 8}])
def test_bigram_scores(spark, odd, docs, data, size):
    """Every bigram of training counts, also of words that occur once; blocks of any size give the same scores."""
    for df in (odd, docs):
        tokens = [(i, [*re.findall(WORD, low(t)), "\0"]) for i, t in pairs(df)]
        train = [ws for i, ws in tokens if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
        c = collections.Counter(w for ws in train for w in ws)
        n, v = sum(c.values()), len(c)
        two = collections.Counter(x for ws in train for x in zip(ws, ws[1:], strict=False))
        kinds, total = collections.Counter(h for h, _ in two), collections.Counter()
        for (h, _), k in two.items():
            total[h] += k

        def p(h, w):
            one = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            return (max(two[h, w] - 0.75, 0) + 0.75 * kinds[h] * one) / total[h] if total.get(h) else one

        want = sorted((len(ws), sum(math.log10(p(h, w)) for h, w in zip([None, *ws], ws, strict=False))) for _, ws in tokens)
        got = sorted((r["n_tokens"], r["score"]) for r in score_texts(df, order=2, **size).collect())
        # Codes are exact to half a step of 9 / 32766 in log10.
        assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) <= 3e-4 * w[0] for g, w in zip(got, want, strict=True))
    if not size:
        assert sorted((r["n_tokens"], r["score"]) for r in queries.QUERIES["op8_lm_scoring"](spark, data).collect()) == got

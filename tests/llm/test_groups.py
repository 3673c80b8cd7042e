"""Exact dedup, centroid clustering and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import CLASHING, documents
from pyspark.sql import functions as F
from rows import DATA, same_rows

from vigilrow.llm import centroids, exact_dedup, periodic_runs, queries

# exact dedup


def brute_exact(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, k, doc_id))
    out = []
    for own in groups.values():
        own.sort(key=lambda r: r[:4])
        out += [(r[4], own[0][4], len(own), k == 0) for k, r in enumerate(own)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_dedup(spark, seed, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS", 1 << 8)  # keys share bits, which must change nothing
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abé\U0001f600\x00 ") for _ in range(rng.choice([2, 3, 70, 90]))) for _ in range(60)]
    texts += [t[:64] + t[64:][::-1] for t in texts] + [re.sub(" ", "\t \n\x0b\x0c\r", t) for t in texts] + [" ".join(t) for t in texts]
    rows = [(rng.randrange(300), t) for t in texts] + [(301, None), (302, ""), (303, " \t\n"), (None, "ab"), (None, "a b"), (None, "a b"), (None, None)]
    rows += rows[:5] + [(304, " "), (305, " "), (306, "\x1c")]
    found = exact_dedup.dedup(documents(spark, rows, clash=True))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_exact(rows)


def test_exact_dedup_edges(spark):
    assert exact_dedup.dedup(documents(spark, [])).count() == 0
    long = "word " * 300_000
    found = exact_dedup.dedup(documents(spark, [(2, long), (1, long.replace(" ", "")), (3, long + "x")]), size=F.length("text"))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 2, False, 1_200_000), (2, 2, 2, True, 1_500_000), (3, 3, 1, True, 1_500_001)]
    # one hot group beside others
    rows = [(k, "the same") for k in range(3000)] + [(k, f"text {k}") for k in range(3000, 4000)]
    kept = exact_dedup.dedup(documents(spark, rows)).filter("kept")
    assert kept.count() == 1001 and kept.filter("doc_id = 0 and group_size = 3000").count() == 1


def test_exact_dedup_sql(spark, duck):
    same_rows(queries.QUERIES["op11_exact_dedup"](spark, DATA), duck, queries.ORACLE_SQL["op11_exact_dedup"])


# centroid clustering


def brute_clusters(rows, k, rounds):
    """Python integers, every dimension of every distance."""
    vectors = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    means = [v for _, v in sorted(vectors, key=key)[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    near = lambda v: min((far(v, m), c) for c, m in enumerate(means))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in vectors]
        means = [[sum(x) // len(x) for x in zip(*g)] if (g := [v for (_, v), o in zip(vectors, own) if o == c]) else m for c, m in enumerate(means)]
    found = [(i, near(v)) for i, v in vectors]
    inertia = [sum(d for _, (d, o) in found if o == c) for c in range(len(means))]
    return sorted([(i, o, d, inertia[o], sum(inertia), hashlib.sha256(",".join(map(str, means[o])).encode()).hexdigest()) for i, (d, o) in found], key=str)


def vectors(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return df.withColumns({c: F.lit("x") for c in (*CLASHING, "cluster", "vector", "at")} if clash else {})


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((5, 64)) * np.linspace(0.1, 2, 64)
    rows = [(k, (middles[rng.integers(5)] + 0.3 * rng.standard_normal(64)).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + rows[:4] + [(2000, [0.0] * 64), (None, [1.5] * 64), (2001, [-1000.25] * 64)]
    bad = [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 63 + [None]), (3004, [1.0] * 63 + [float("nan")]), (3005, [float("-inf")] + [1.0] * 63), (3006, [1.0] * 65)]
    found = centroids.report(centroids.cluster(vectors(spark, rows + bad, clash=True)))
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(rows, 16, 3)


def test_cluster_edges(spark):
    assert centroids.report(centroids.cluster(vectors(spark, []))).count() == 0
    few = [(7, [0.5] * 64), (8, [0.5] * 64), (9, [-0.5] * 64)]
    assert sorted(map(tuple, centroids.report(centroids.cluster(vectors(spark, few))).collect()), key=str) == brute_clusters(few, 16, 3)
    assert centroids.report(centroids.cluster(vectors(spark, [(1, [3e9] * 64), *few]))).count() == 3


def test_partial_distances():
    """Abandoning changes nothing, ties go to the smaller number, and no product overflows."""
    rng = np.random.default_rng(0)
    x, m = rng.integers(-9, 9, (400, 64)), rng.integers(-9, 9, (16, 64))
    m[5] = m[2]
    far = ((x[:, None] - m[None]) ** 2).sum(axis=2)
    c, d = centroids.nearest(x, m, rng.permutation(64))
    assert (c == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
    edge = np.full((1, 64), centroids.LARGEST), np.full((1, 64), -centroids.LARGEST)
    assert centroids.nearest(*edge, np.arange(64))[1][0] == 64 * (2 * centroids.LARGEST) ** 2


def test_clusters_sql(spark, duck):
    same_rows(queries.QUERIES["op12_centroids"](spark, DATA), duck, queries.ORACLE_SQL["op12_centroids"])


# periodic runs


def brute_runs(w, shortest=24, times=3):
    """Every period: maximal stretches in which words that far apart are equal; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            if w[i] == w[i + q]:
                j = i
                while j < len(w) - q and w[j] == w[j + q]:
                    j += 1
                if j - i + q >= max(shortest, times * q):
                    found.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def repeating(rng):
    """Words with stretches that repeat, often inside each other."""
    w = []
    while len(w) < rng.choice([0, 30, 100, 400]):
        part = [rng.choice("abcdefgh"[: rng.choice([2, 3, 8])]) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 20]))]
        w += (part * rng.choice([1, 1, 3, 4, 9]))[: rng.randrange(1, 120)]
        if rng.random() < 0.3:
            w += w[-rng.randrange(1, 40) :] * rng.choice([1, 3])
    return w


@pytest.mark.parametrize("shortest, times", [(24, 3), (24, 2), (6, 3), (4, 2)])
def test_runs_of(shortest, times):
    rng = random.Random(shortest + times)
    for _ in range(150):
        w = repeating(rng)
        ids = [ord(x) for x in w]
        expected = brute_runs(w, shortest, times)
        assert periodic_runs.runs_of(ids, shortest, times) == expected
        runs, collapsed = periodic_runs._judge([" ".join(w).encode(), b"x " * 5, b" ".join(x.encode() for x in w)], shortest, times)
        assert [(r["start"], r["length"], r["period"]) for r in runs[0]] == [(r["start"], r["length"], r["period"]) for r in runs[2]] == expected
        assert collapsed[0].decode() == brute_collapsed(w, expected)


def brute_digest(doc_id, text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *strongest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(brute_collapsed(w, runs)))


def test_runs_digest(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.choice([" ", "\n", " \t\x0b"]).join(repeating(rng))) for k in range(150)]
    rows += [(151, None), (152, ""), (153, " \n"), (None, "a b c " * 20), (154, "a " * 24), (154, "a " * 24), (155, "a " * 23), (156, "é x " * 40), (157, "a b c d e f g h i " * 3)]
    documents(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((brute_digest(*r) for r in rows), key=str)


def test_runs_edges(spark):
    kept = periodic_runs.find(documents(spark, [(1, "x y " * 30), (2, None)], clash=True)).filter("doc_id = 1").first()
    assert kept.collapsed == "x y" and kept.h == "x" and [tuple(r) for r in kept.runs] == [(0, 60, 2)]
    assert periodic_runs.find(documents(spark, [])).count() == 0
    assert periodic_runs.digest(periodic_runs.find(documents(spark, [(1, None)]))).first().start is None
    long = "a b c " * 60_000 + " ".join(map(str, range(100_000)))
    runs = periodic_runs.find(documents(spark, [(1, long)])).first().runs
    assert [tuple(r) for r in runs] == [(0, 180_000, 3)]


def test_runs_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    short = {d.doc_id: d.text for d in docs if len((d.text or "").split()) < 1500}
    found = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    assert len(found) == len(docs) and len(short) > 0.9 * len(docs)
    for doc_id, text in short.items():
        assert found[doc_id] == brute_digest(doc_id, text)

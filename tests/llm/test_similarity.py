"""Embedding dedup, suffix dedup, line dedup, n-gram join and components against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest
from helpers import documents, near_copies, sentence
from pyspark.sql import functions as F

from vigilrow.llm import embedding_dedup, line_dedup, ngram_join, suffix_dedup
from vigilrow.llm.common import materialize
from vigilrow.llm.components import connected_components
from vigilrow.llm.suffix_dedup import LoserTree, decoded, front_coded


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        x, y = sorted((self.find(a), self.find(b)))
        self[y] = x


# n-gram join


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = near_copies(seed)
    found = ngram_join.join(documents(spark, rows, clash=True)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(found) == sorted(ngram_join.brute_force(rows), key=str)


def test_ngram_join_passages(spark):
    """Documents that share one long passage but no more than it are compared and stay apart."""
    rng = random.Random(3)
    passage = sentence(rng, 60)
    rows = [(k, f"{passage} {sentence(rng, 12)}" if k % 3 else f"{passage} {sentence(rng, 60)}") for k in range(60)]
    rows += [(100 + k, f"{text} again") for k, (_, text) in enumerate(rows[:20])]
    found = ngram_join.join(documents(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(found) == sorted(ngram_join.brute_force(rows), key=str)


def test_ngram_join_edges(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None)]
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(documents(spark, rows)).collect()}
    assert found == {(None, 2, 7), (7, 2, 7), (8, 0, 8)}
    assert ngram_join.join(documents(spark, [])).count() == 0


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 2**64, 80, np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([x[:60], y[:20]]))
        apart = sum(int(v).bit_count() for v in (ngram_join.sketch(x) ^ ngram_join.sketch(y)).view(np.uint64))
        assert apart <= len(np.setxor1d(x, y))


# suffix dedup


def repeats(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(45, 140))) for _ in range(6)]
    rows = []
    for k in rng.sample(range(1000), 50):
        parts = [rng.choice(shared) if rng.random() < 0.5 else sentence(rng, rng.randrange(20)) for _ in range(4)]
        rows.append((k, "".join(parts)))
    return [*rows, (2000, "a" * 500), (2001, "a" * 400), (2002, "a" * 49), (2003, ""), (2004, None), (2005, rows[0][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup(spark, seed):
    rows = repeats(seed)
    found = suffix_dedup.digest(suffix_dedup.dedup(documents(spark, rows, clash=True)))
    assert rows_of(found) == sorted(suffix_dedup.brute_force(rows), key=str)


def test_suffix_dedup_edges(spark):
    text = "x" * 30 + "y" * 30
    rows = [(None, text), (4, text), (4, text), (5, text)]
    found = {(r.doc_id, r.n_removed) for r in suffix_dedup.digest(suffix_dedup.dedup(documents(spark, rows))).collect()}
    assert found == {(None, 0), (4, 0), (5, 60)}
    assert suffix_dedup.dedup(documents(spark, [])).count() == 0


def test_suffix_dedup_long(spark):
    rng = random.Random(5)
    text = sentence(rng, 60_000, 10**6)
    rows = [(1, text), (2, f"new {text[1000:200_000]} end")]
    found = {r.doc_id: r for r in suffix_dedup.dedup(documents(spark, rows)).collect()}
    assert found[1].removed == [] and bytes(found[1].kept) == text.encode()
    assert [tuple(x) for x in found[2].removed] in ([(4, 199_004)], [(3, 199_004)], [(4, 199_005)], [(3, 199_005)])


def test_front_coding_and_merge():
    rng = random.Random(0)
    runs = [sorted((bytes(rng.choices(b"ab", k=rng.randrange(1, 9))), 0, [(r, k, 1)]) for k in range(30)) for r in range(5)]
    coded = [front_coded(r) for r in runs]
    assert [[(k, left, [tuple(p) for p in places]) for _, k, left, places in decoded(*c)] for c in coded] == runs
    assert [x[1] for x in LoserTree([decoded(*c) for c in coded])] == sorted(k for r in runs for k, _, _ in r)


def test_suffix_windows_joined():
    """Windows in succession come as one span, also where entries of one key come apart or differ around the anchor."""
    x = bytes(range(65, 65 + 60))
    near = x[:55] + b"....."
    key = lambda t: t[20:] + t[:20][::-1]
    # the 55 bytes that they share are 6 windows of 50
    found = list(suffix_dedup.covered([(key(x), 20, [(7, 1, 20)]), (key(near), 20, [(8, 2, 120)])], 50))
    assert found == [(8, 100, 155)]
    entries = [(key(x), 20, [(7, 3, 20)]), (key(near), 20, [(9, 1, 20)]), (key(x), 20, [(8, 2, 20)])]
    spans = sorted(suffix_dedup.covered(entries, 50))
    assert spans == [(7, 0, 60), (8, 0, 55)]
    # of two places of one document none goes
    assert list(suffix_dedup.covered([(key(x), 20, [(7, 1, 20), (7, 1, 220)])], 50)) == []


# line dedup


def line_sets(rows):
    """The 5-character substrings of each line that is not blank, computed apart from Spark."""
    out = []
    for doc, text in rows:
        for i, raw in enumerate([] if text is None else text.split("\n")):
            norm = raw.strip(" ").lower()
            if norm:
                out.append((doc, i, norm, {norm[k : k + 5] for k in range(max(len(norm) - 4, 1))}))
    return out


def brute_lines(rows, percent=80):
    lines, u = line_sets(rows), Union()
    for i, (_, _, x, s) in enumerate(lines):
        for _, _, y, t in lines[:i]:
            if x == y or 100 * len(s & t) >= percent * len(s | t):
                u.join(x, y)
    first: dict = {}
    for doc, i, x, _ in sorted(lines, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1])):
        first.setdefault(u.find(x), (doc, i))
    gone: dict = {}
    for doc, i, x, _ in lines:
        if first[u.find(x)] != (doc, i):
            gone.setdefault(doc, set()).add(i)
    return {d: sorted(v) for d, v in gone.items()}


def line_rows(seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    pool = [sentence(rng, rng.choice([1, 2, 6, 25, 40]), 5000) for _ in range(30)] + ["z" * 60 + "abc" * 10]
    for k in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(pool) if rng.random() < 0.5 else sentence(rng, 20, 5000)
            if rng.random() < 0.3 and line.count(" ") > 20:
                line = line.rsplit(" ", 1)[0] + f" n{rng.randrange(99)}"
            lines.append(f"  {line.upper()}" if rng.random() < 0.2 else line)
        rows.append((k, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (None, pool[3])]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = line_rows(seed)
    want = brute_lines(rows)
    found = line_dedup.report(documents(spark, rows, clash=True)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.removed for r in found if r.removed} == want


def test_line_dedup_texts(spark):
    rows = [(1, "first line here\nsecond line here"), (2, "other\nfirst line here\n\nFIRST LINE HERE "), (3, None), (4, ""), (2, "other\nfirst line here\n\nFIRST LINE HERE ")]
    found = line_dedup.dedup(documents(spark, rows, clash=True))
    assert found.columns == documents(spark, rows, clash=True).columns
    assert sorted((r.doc_id, r.text) for r in found.collect() if r.doc_id != 3) == [(1, rows[0][1]), (2, "other\n"), (2, "other\n"), (4, "")]
    assert line_dedup.dedup(documents(spark, [])).count() == 0


def test_line_dedup_tails(spark):
    """A line counts up to its last character: those that differ only behind the start of their last word stay."""
    rows = [(1, "price is 12345\ntoken abc123\none two"), (2, "price is 12399\ntoken abc987\none twofold"), (3, "price is 12345")]
    found = {r.doc_id: r.removed for r in line_dedup.report(documents(spark, rows)).collect()}
    assert found == {1: [], 2: [], 3: [0]}


def test_line_dedup_characters(spark):
    """Against brute force over the 5-character substrings of lines: one changed character or word of prose."""
    rng, rows = random.Random(11), []
    for k in range(12):
        line = sentence(rng, rng.choice([12, 16, 24]), 10**6)
        at = rng.randrange(len(line) - 9)
        rows += [(10 * k, line), (10 * k + 1, f"{line[:at]}#{line[at + 1:]}"), (10 * k + 2, f"{line[:at]}#{line[at + 1:-4]}tail"), (10 * k + 3, line[len(line) // 2 :])]
    sets = {doc: {x[i : i + 5] for i in range(max(len(x) - 4, 1))} for doc, x in rows}
    u = Union()
    near = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b]
    for a, b, similar in near:
        if similar >= 0.8:
            u.join(a, b)
    want = {doc for doc in sets if u.find(doc) != doc}
    assert len(want) > 12
    assert {r.doc_id for r in line_dedup.report(documents(spark, rows)).collect() if r.removed} == want


# embeddings


def brute_embeddings(rows, least=0.98):
    u, links, units = Union(), {}, []
    for i, label, e in rows:
        u.find(i)
        links[i] = 0
        if e is not None and label is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            units.append((i, label, np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64))))
    for k, (i, label, x) in enumerate(units):
        for j, other, y in units[:k]:
            if label == other and len(x) == len(y) and x @ y >= least:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    return sorted((i, links[i], u.find(i), u.find(i) == i) for i, _, _ in rows)


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.standard_normal((12, 16))
    for i in range(150):
        v = base[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0, 0.01, 0.05, 0.12])
        rows.append((i, int(rng.integers(3)), [float(np.float32(x)) for x in v]))
    rows += [(200, 1, None), (201, None, rows[0][2]), (202, 1, [0.0] * 16), (203, 1, [float("nan")] * 16), (204, 1, [float("inf")] * 16), (205, 1, [None] * 16), (206, 1, []), (207, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "weight", "vector", "a", "n")})
    assert rows_of(embedding_dedup.dedup(df, block=16)) == sorted(brute_embeddings(rows), key=str)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_embedding_dedup_follows_chains(spark):
    """Rings of vectors that each link with the next alone; before, of what a vector was joined to in a block only the least on either side was kept, and rings fell apart."""
    rows = [(100 * label + k, label, [np.cos(k * np.pi / 18), np.sin(k * np.pi / 18), 0.0]) for label in range(12) for k in range(36)]
    df = spark.createDataFrame([(i, label, list(map(float, v))) for i, label, v in rows], "vec_id long, label int, embedding array<double>")
    for bits, block in ((None, 1024), (2, 5)):
        assert rows_of(embedding_dedup.dedup(df, bits=bits, block=block)) == sorted(brute_embeddings(rows), key=str)


def test_embedding_dedup_leaves_out_no_link(spark):
    """Pairs just at the limit, of which tables met by chance left some out; and components whose squares no double holds."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((1000, 16))
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = 0.9801
    rows = [(k, 1, list(map(float, v))) for k, v in enumerate(np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * side]))]
    rows += [(9000, 2, [1e200, 1e200]), (9001, 2, [1e-200, 1e-200]), (9002, 2, [3.0, 3.1])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute_embeddings(rows[:-3]) + [(9000, 2, 9000, True), (9001, 2, 9000, False), (9002, 2, 9000, False)]
    for bits, block in ((None, 1024), (7, 30)):
        assert rows_of(embedding_dedup.dedup(df, bits=bits, block=block)) == sorted(want, key=str)


# components


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    found = connected_components(spark.createDataFrame([*edges, *edges[:9], (None, 3)], "a long, b long"))
    assert {r.id: r.component for r in found.collect()} == {x: u.find(x) for x in list(u)}


def test_digest_is_of_kept_bytes(spark):
    r = suffix_dedup.digest(suffix_dedup.dedup(documents(spark, [(1, "é")]))).first()
    assert (r.n_bytes, r.kept_sha256) == (2, hashlib.sha256("é".encode()).hexdigest())


def test_lines_carry_cells_and_keys_are_made_from_them(spark):
    """Before, each line carried 24 keys of eight bytes."""
    words = sentence(random.Random(5), 30)
    df = documents(spark, [(1, words), (2, words + " a"), (3, "b " + words), (4, words[20:] + " c"), (5, "short"), (6, "x")])
    classes = materialize(line_dedup._classes(df), "classes")
    assert not [c for c in classes.columns if c[0] == "k"]
    cells = {r.id: b"".join(r[f"s{w}"].to_bytes(8, "little", signed=True) for w in range(line_dedup.CELLS // 8)) for r in classes.collect()}
    found = {}
    for r in line_dedup._keys(classes).collect():
        found.setdefault(r.key, set()).add(r.id)
    want = {}
    for i, x in cells.items():
        for b, band in enumerate(line_dedup.BANDS):
            want.setdefault((b, *(x[k] for k in sorted(band))), set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_shuffle_files_go_with_the_write(spark):
    """Before, they stayed until the driver collected garbage."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")
    before = files()
    materialize(spark.range(1000).repartition(3), "numbers")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

"""Ranks, running digests, journals and words against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from vigilrow.functions import scalar
from vigilrow.operators import digests, evaluation, structural


def test_nearest_rank(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, rng.randrange(5), rng.random()]) if g != "none" else None) for g in ("a", "b", "hot", "one", "none") for _ in range({"one": 1, "hot": 4000}.get(g, 50))]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    for p in (0.0, 0.5, 0.9, 1.0):
        want = {}
        for g in {g for g, _ in rows}:
            own = sorted(float(v) for h, v in rows if h == g and v is not None)
            if own:
                want[g] = own[int((len(own) - 1) * p)]
        assert {r.g: r.value for r in evaluation.nearest_rank(df, "g", "v", p).collect()} == want


def test_tree_hash(spark):
    rng = random.Random(2)
    rows = [(a, f"{rng.choice('abé')}/{k}", hashlib.sha256(bytes([k % 256])).hexdigest()) for a in ("x", "y", None) for k in range(60)]
    want = {}
    for a in ("x", "y", None):
        h = hashlib.sha256()
        for _, p, s in sorted((r for r in rows if r[0] == a), key=lambda r: r[1]):
            h.update(p.encode() + b"\0" + bytes.fromhex(s))
        want[a] = h.hexdigest()
    got = digests.tree_hash(spark.createDataFrame(rows, "artifact string, path string, sha256 string"))
    assert {r.artifact: r.hash for r in got.collect()} == want
    assert digests.tree_hash(got.limit(0).select("artifact", F.lit("p").alias("path"), F.col("hash").alias("sha256"))).count() == 0


def test_chains(spark):
    link = lambda x: hashlib.sha256(x.encode()).hexdigest()
    journals = {
        "good": [("a", "genesis"), ("b", link("a"))],
        "late": [("a", ""), ("b", link("a")), ("c", "")],
        "corrupt": [("a", ""), ("b", None), ("c", ""), ("d", "x")],
        "forged": [("a", "genesis"), ("b", "x"), ("c", "y"), ("d", "")],
    }
    df = spark.createDataFrame([(j, k, r, p) for j, rows in journals.items() for k, (r, p) in enumerate(rows, 1)], "journal string, line_no int, raw string, prev string")
    got = {r.journal: (r.n_lines, r.unchained, r.first_break, r.corrupt) for r in digests.chain_breaks(df).collect()}
    assert got == {"good": (2, 0, None, False), "late": (3, 2, None, False), "corrupt": (4, 1, 2, True), "forged": (4, 0, 2, False)}


def test_journal_order(spark):
    """The last batch of the journal is not the one with the greatest name."""
    rows = [(1, "b9", "i", "intended"), (2, "b9", "i", "done"), (3, "b1", "j", "intended"), (4, "b1", "j", "done"), (5, "b1", "k", "intended"), (6, "b9", "l", "done"), (7, "b5", "m", "done"), (8, "b5", "m", "undone")]
    pending, restorable = digests.journal_state(spark.createDataFrame(rows, "place int, batch string, item string, state string"))
    assert [tuple(r) for r in pending.collect()] == [("b1", "k")] and [tuple(r) for r in restorable.collect()] == [("b1", "j")]


def test_redirects(spark):
    text = "registry $A\nA=https://one.example\nregistry ${A}\nA=https://pypi.org\nregistry $A\nregistry https://two.example/x\nA=https://three.example registry $A"
    df = spark.createDataFrame([("a", 1, "script", "f", text)], "artifact string, unit int, role string, file string, text string")
    assert sorted((r.line, r.host) for r in structural.registry_redirects(structural.physical_lines(df)).collect()) == [(3, "one.example"), (6, "two.example"), (7, "three.example")]


def test_shell_words(spark):
    cases = {r"a 'b c' d": ["a", "b c", "d"], r"'a\b' a\ b": [r"a\b", "a b"], r'''x"y z"'w' "q\"r"''': ["xy zw", r"q\"r"], "": [], "  ": [], r"'it'\''s'": ["it's"]}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", scalar.shell_words("c").alias("w"))
    assert {r.c: r.w for r in df.collect()} == cases

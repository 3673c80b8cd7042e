"""Ledgers are written whole or not at all; evidence windows against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vigilrow.operators import evidence
from vigilrow.sources.ledgers import LedgerSource


@pytest.fixture()
def write(spark, tmp_path):
    spark.dataSource.register(LedgerSource)

    def run(df, mode="overwrite", kind="baseline"):
        df.write.format("ledger").option("path", f"{tmp_path}/ledger").option("kind", kind).mode(mode).save()

    return run


def read(spark, tmp_path, kind="baseline", schema=None):
    reader = spark.read.format("ledger").option("path", f"{tmp_path}/ledger").option("kind", kind)
    return sorted(map(tuple, (reader.schema(schema) if schema else reader).load().collect()), key=str)


def test_round_trip(spark, tmp_path, write):
    rows = [("SUP-003", ""), ("FS-001", "a b/*"), ("*", "**/x.txt"), ("FS-001", "a b/*")]
    df = spark.createDataFrame(rows, "rule string, glob string").repartition(3)
    write(df)
    assert set(read(spark, tmp_path)) == set(rows)
    write(df.limit(1))
    assert len(read(spark, tmp_path)) == 1 and os.listdir(tmp_path) == ["ledger"]
    with pytest.raises(Exception, match="FileExistsError|exists"):
        write(df, mode="append")
    assert len(read(spark, tmp_path)) == 1


def test_fold_round_trip(spark, tmp_path, write):
    schema = "sample string, k int, rules array<string>, votes map<string, int>"
    df = spark.createDataFrame([("a", 1, ["x", "é"], {"q": 2}), ("b", None, None, {}), ("c\n", 3, [], None)], schema).repartition(2)
    write(df, kind="fold")
    assert read(spark, tmp_path, "fold", schema) == sorted(map(tuple, df.collect()), key=str)


def test_failed_task_leaves_what_was(spark, tmp_path, write):
    write(spark.createDataFrame([("A-1", "")], "rule string, glob string"))
    good = spark.range(40).select(F.concat(F.lit("R-"), "id").alias("rule"), F.lit("x").alias("glob")).repartition(4)
    with pytest.raises(Exception, match="no baseline entry"):
        write(good.union(spark.createDataFrame([("not a rule", "")], "rule string, glob string")))
    assert os.listdir(tmp_path) == ["ledger"] and read(spark, tmp_path) == [("A-1", "")]


def windows(hits, lines, around, budget):
    """By unit: the windows shown, in order, and how many were left out."""
    out = {}
    for unit in {u for u, *_ in hits}:
        near = sorted({n for u, n, _ in hits if u == unit})
        merged = []
        for n in near:
            if merged and n - around <= merged[-1][-1] + around + 1:
                merged[-1].append(n)
            else:
                merged.append([n])
        texts = dict((n, r) for u, n, r in lines if u == unit)
        all_ = []
        for group in merged:
            own = [n for n in range(max(group[0] - around, 1), group[-1] + around + 1) if n in texts]
            rank = max(r for u, n, r in hits if u == unit and n in group)
            all_.append((-rank, own[0], own[-1], sum(u == unit and n in group for u, n, _ in hits), "\n".join(texts[n] for n in own)))
        shown, spent = [], 0
        for w in sorted(all_):
            spent += len(w[4]) + 1
            if spent > budget:
                break
            shown.append((w[1], w[2], -w[0], w[3], w[4]))
        if shown:
            out[unit] = (shown, len(all_) - len(shown))
    return out


@pytest.mark.parametrize("around, budget", [(0, 50), (2, 60), (2, 10**6), (5, 5)])
def test_evidence(spark, around, budget):
    rng = random.Random(around + budget)
    lines = [(u, n, "x" * rng.randrange(9)) for u in range(8) for n in range(1, rng.randrange(2, 60))]
    hits = [(u, n, rng.randrange(4)) for u, n, _ in lines if rng.random() < 0.15]
    hits += hits[:5]
    got = evidence.evidence(spark.createDataFrame(hits, "unit int, line int, rank int"), spark.createDataFrame(lines, "unit int, line int, raw string"), around, budget)
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.place):
        found.setdefault(r.unit, ([], r.omitted))[0].append((r.first, r.last, r["rank"], r.n_hits, r.text))
    assert found == windows(hits, lines, around, budget)

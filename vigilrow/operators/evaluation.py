"""Measures of detection: ledgers, surfaces, rates with intervals, percentiles and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilrow.sources.shared import cut

from vigilrow.functions.scalar import wilson


def partition(ledger: DataFrame, work: DataFrame) -> DataFrame:
    """One row: scored, no-verdict and error counts, the work list's size, and whether they add up."""
    counts = ledger.select("outcome", F.lit(0).alias("w")).union(work.select(F.lit(None).cast("string"), F.lit(1)))
    out = counts.agg(*(F.count_if(F.col("outcome") == o).alias(n) for o, n in (("scored", "scored"), ("no-verdict", "no_verdict"), ("error", "errors"))), F.sum("w").cast("long").alias("listed"))
    return out.withColumn("complete", F.col("scored") + F.col("no_verdict") + F.col("errors") == F.col("listed"))


def reconcile(ledger: DataFrame, work: DataFrame) -> DataFrame:
    """Samples that are missing from the ledger, not in the work list, or repeated."""
    rows = ledger.groupBy("sample").agg(F.count("*").alias("n"))
    both = rows.join(work.select("sample").distinct().withColumn("listed", F.lit(True)), "sample", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("n") > 1, "repeated")
    return both.select("sample", problem.alias("problem")).filter("problem is not null")


def surfaces(samples: DataFrame, flagged: DataFrame, least: int = 22) -> DataFrame:
    """Per surface: samples, flagged ones and a status; under `least` samples it is too small to tell."""
    each = samples.select("sample", F.explode("surface").alias("surface"))
    joined = each.join(flagged.select("sample").distinct().withColumn("hit", F.lit(True)), "sample", "left")
    out = joined.groupBy("surface").agg(F.count("*").alias("n"), F.count_if("hit").alias("flagged"))
    return out.withColumn("status", F.when(F.col("n") < least, "too few").when(F.col("flagged") == 0, "silent").otherwise("ok"))


def rates(samples: DataFrame, votes: DataFrame) -> DataFrame:
    """Per (kind, rule): hits among malicious and benign samples, with the samples of the kind as denominators."""
    asked = samples.groupBy("kind").agg(F.count_if("malicious").alias("n_malicious"), F.count_if(~F.col("malicious")).alias("n_benign"))
    hits = votes.select("sample", "rule").distinct().join(samples, "sample").groupBy("kind", "rule").agg(F.count_if("malicious").alias("caught"), F.count_if(~F.col("malicious")).alias("false_alarms"))
    return hits.join(asked, "kind")


def with_interval(df: DataFrame, k: str, n: str, widest: float = 0.15) -> DataFrame:
    """Adds low, high and cell: `k / n (p %)` where half the 95 % interval is at most `widest`, else `k / n`."""
    low, high = wilson(k, n)
    out = df.withColumn("low", low).withColumn("high", high)
    plain = F.concat_ws(" / ", k, n)
    share = F.floor(F.col(k) * 100.0 / F.col(n) + 0.5).cast("int").cast("string")
    return out.withColumn("cell", F.when((F.col("high") - F.col("low")) / 2 <= widest, F.concat(plain, F.lit(" ("), share, F.lit(" %)"))).otherwise(plain))


def delta_recall(samples: DataFrame, static: DataFrame, voted: DataFrame) -> DataFrame:
    """Per kind: malicious samples, those that static rules caught, and those that only votes caught."""
    mark = lambda df, n: df.select("sample").distinct().withColumn(n, F.lit(True))
    all_ = samples.filter("malicious").join(mark(static, "s"), "sample", "left").join(mark(voted, "v"), "sample", "left")
    return all_.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("s").alias("static_caught"), F.count_if(F.col("v") & F.col("s").isNull()).alias("votes_only"))


def nearest_rank(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """Per group the value at floor((n - 1) * p) in order: the lower nearest rank, exact.

    Equal values are counted first; the counts are dealt out by ranges of value, so that a range's place in its group is known from the
    sums of the ranges before it and no task sorts a whole group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    ranges = cut(counts.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy(group, "part").agg(F.sum("k").alias("own"))
    w = Window.partitionBy(group).orderBy("part")
    # as many rows as there are ranges and groups
    sums = sums.select(group, "part", (F.sum("own").over(w) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy(group)).alias("n"))
    placed = ranges.join(sums, [group, "part"]).withColumn("upto", F.col("before") + F.sum("k").over(Window.partitionBy(group, "part").orderBy(value)))
    rank = F.floor((F.col("n") - 1) * p) + 1
    return placed.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("k") < rank)).select(group, F.col(value).alias("value"))

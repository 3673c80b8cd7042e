"""Scores: penalties per dimension, units of parents and children, bands, ceilings and reports.

findings have artifact, rule, dimension, severity, source, escalates, file and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilrow.functions.scalar import band, penalty, severity_rank
from vigilrow.sources.shared import cut


def deterministic() -> Column:
    return (F.col("source") != "llm") & (F.col("dimension") != 0)


def escalating() -> Column:
    return (F.col("dimension") != 0) & ((F.col("source") != "llm") | F.col("escalates"))


def artifact_scores(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """artifact, score, effective_score (never above score) and band; 100 without findings."""
    by_dimension = findings.groupBy("artifact", "dimension").agg(*(F.coalesce(F.max(F.when(p, penalty("severity"))), F.lit(0)).alias(n) for n, p in (("d", deterministic()), ("e", escalating()))))
    total = by_dimension.groupBy("artifact").agg(F.sum("d").alias("d"), F.sum("e").alias("e"))
    out = artifacts.select("artifact").distinct().join(total, "artifact", "left")
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce(c, F.lit(0)))).cast("long")
    out = out.select("artifact", clamp("d").alias("score"), clamp("e").alias("effective_score"))
    return out.withColumn("effective_score", F.least("score", "effective_score")).withColumn("band", band("score"))


def fold_children(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with each child's artifact replaced by its parent; artifacts have artifact and parent."""
    return findings.join(artifacts.select("artifact", "parent"), "artifact", "left").withColumn("artifact", F.coalesce("parent", "artifact")).drop("parent")


def environment_score(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: units, mean (truncated), ceiling by the worst severity (49 critical, 69 high) and score; 100 without units.

    Findings are read once: their penalties and worst severities are taken together.
    """
    rank, d = severity_rank("severity"), deterministic()
    by_dimension = findings.groupBy("artifact", "dimension").agg(F.coalesce(F.max(F.when(d, penalty("severity"))), F.lit(0)).alias("d"), F.max(F.when(d, rank)).alias("worst"))
    total = by_dimension.groupBy("artifact").agg(F.sum("d").alias("d"), F.max("worst").alias("worst"))
    every = artifacts.select("artifact").distinct().withColumn("unit", F.lit(True)).join(total, "artifact", "full")
    score = F.when(F.col("unit"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("d", F.lit(0)))).cast("long"))
    out = every.agg(F.count("unit").alias("units"), F.floor(F.coalesce(F.avg(score), F.lit(100.0))).cast("long").alias("mean"), F.coalesce(F.max("worst"), F.lit(0)).alias("worst"))
    ceiling = F.when(F.col("worst") == 4, 49).when(F.col("worst") == 3, 69).otherwise(100).cast("long")
    return out.select("units", "mean", ceiling.alias("ceiling"), F.least("mean", ceiling).alias("score"))


def report(findings: DataFrame) -> DataFrame:
    """Per (artifact, rule): findings, distinct files, worst severity and the first three places.

    Findings are written once; the places come from a rank that Spark limits before it shuffles, so that no group is sorted whole.
    """
    found = cut(findings.select("artifact", "rule", "file", "line", "severity"))
    counts = found.groupBy("artifact", "rule").agg(F.count("*").alias("n_findings"), F.countDistinct("file").alias("n_files"), F.max(severity_rank("severity")).cast("long").alias("severity_rank"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("artifact", "rule").orderBy("file", "line"))).filter("n <= 3")
    places = first.groupBy("artifact", "rule").agg(F.array_sort(F.collect_list(F.struct("file", "line"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: F.concat_ws(":", p["file"], p["line"])), ",")
    return counts.join(places, ["artifact", "rule"]).select("artifact", "rule", "n_findings", "n_files", "severity_rank", text.alias("places"))


def top(findings: DataFrame, n: int = 5) -> DataFrame:
    """The n worst findings of each artifact in a stable order, with the number left out.

    Findings are counted apart from their rank, which Spark then limits before it shuffles.
    """
    found = cut(findings)
    order = Window.partitionBy("artifact").orderBy(F.desc(severity_rank("severity")), "rule", "file", "line")
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    counts = found.groupBy("artifact").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("omitted"))
    return ranked.join(counts, "artifact")


def fails(findings: DataFrame, level: str) -> DataFrame:
    """Per artifact whether a finding reaches a level, by deterministic and by escalating findings."""
    reach = severity_rank("severity") >= severity_rank(F.lit(level))
    return findings.groupBy("artifact").agg(F.bool_or(reach & deterministic()).alias("static_fail"), F.bool_or(reach & escalating()).alias("effective_fail"))

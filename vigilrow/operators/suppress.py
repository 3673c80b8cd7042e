"""Reputation lists and suppression of known findings, always with what was suppressed disclosed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.regex import glob_to_re2, re2_to_java
from vigilrow.functions.scalar import severity_rank


def reputation(artifacts: DataFrame, known: DataFrame) -> DataFrame:
    """artifacts (artifact, parent, hash) with verdict: the one of its hash, or GOOD from a parent that has it. An empty hash never matches."""
    verdicts = known.filter("hash <> ''").groupBy("hash").agg(F.min("verdict").alias("own"))
    own = artifacts.join(verdicts, "hash", "left")
    parents = own.filter("own = 'GOOD'").select(F.col("artifact").alias("parent"), F.lit("GOOD").alias("inherited")).distinct()
    return own.join(parents, "parent", "left").withColumn("verdict", F.coalesce("own", "inherited")).drop("own", "inherited")


def suppress(findings: DataFrame, suppressions: list[tuple[str, str]]) -> DataFrame:
    """findings with `suppressed`, by (rule or `*`, glob) of a baseline file; an empty glob is any file. A row by itself decides: nothing is shuffled."""
    hits = [((F.col("rule") == r) if r != "*" else F.lit(True)) & (F.col("file").rlike(re2_to_java(glob_to_re2(g))) if g else F.lit(True)) for r, g in suppressions]
    return findings.withColumn("suppressed", F.coalesce(reduce(Column.__or__, hits, F.lit(False)), F.lit(False)))


def tally(suppressed: DataFrame) -> DataFrame:
    """One row: how many findings went, and the highest severity rank among them."""
    return suppressed.agg(F.count_if("suppressed").alias("n_suppressed"), F.coalesce(F.max(F.when(F.col("suppressed"), severity_rank("severity"))), F.lit(0)).cast("long").alias("highest"))

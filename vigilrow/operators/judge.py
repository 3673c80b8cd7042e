"""Votes of models on findings: the plan of calls, consensus, ballots, grounding and accounts. No call is made here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilrow.functions.scalar import severity_rank

#: Passes that a kind of artifact is asked, in order. Fixed values.
PASSES = {
    "skill": ("LLM-001", "LLM-003", "LLM-011"),
    "instruction": ("LLM-003",),
    "connector": ("LLM-003",),
    "server": ("LLM-010",),
    "hook": ("LLM-003", "LLM-008"),
    "mcp": ("LLM-009",),
}


def plan(artifacts: DataFrame, samples: int, max_calls: int | None = None) -> DataFrame:
    """artifacts (ordinal, artifact, kind) to calls (call, artifact, pass, sample); beyond max_calls they are not sent."""
    passes = F.coalesce(*(F.when(F.col("kind") == k, F.array(*map(F.lit, p))) for k, p in PASSES.items()))
    calls = artifacts.filter(passes.isNotNull()).select("ordinal", "artifact", F.posexplode(passes).alias("at", "pass"))
    calls = calls.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    if max_calls is None:
        return calls.select("ordinal", "artifact", "pass", "sample", F.lit(True).alias("sent"))
    # the first max_calls in order are few; the rest is told from the last of them
    ordered = calls.withColumn("order", F.struct("ordinal", "at", "sample"))
    last = ordered.orderBy("order").limit(max_calls).agg(F.max("order").alias("last")).first()["last"]
    sent = F.lit(False) if last is None else F.col("order") <= F.struct(F.lit(last[0]).alias("ordinal"), F.lit(last[1]).alias("at"), F.lit(last[2]).alias("sample"))
    return ordered.select("ordinal", "artifact", "pass", "sample", sent.alias("sent"))


def consensus(votes: DataFrame) -> DataFrame:
    """votes (item, sample, answered, flagged, severity, category, text) to one row per item.

    It escalates with floor(n / 2) + 1 votes or more of n answered samples; the severity is that of the
    category that most voters name, if more than half of them do, else the lowest named; text is of the
    first voter.
    """
    cast = votes.filter("answered and flagged")
    per = cast.groupBy("item", "category").agg(F.count("*").alias("c"), F.min(severity_rank("severity")).alias("r"))
    most = per.groupBy("item").agg(F.max(F.struct("c", (-F.col("r")).alias("m"), "category")).alias("b"))
    base = votes.groupBy("item").agg(F.count_if("answered").alias("n"), F.count_if(F.col("answered") & F.col("flagged")).alias("k"))
    voters = cast.groupBy("item").agg(F.min(severity_rank("severity")).alias("lowest"), F.min_by("text", "sample").alias("text"))
    out = base.join(most, "item", "left").join(voters, "item", "left")
    clear = F.col("b.c") * 2 > F.col("k")
    return out.select("item", "n", "k", ((F.col("n") > 0) & (F.col("k") >= F.floor(F.col("n") / 2) + 1)).alias("escalates"), F.when(clear, -F.col("b.m")).otherwise(F.col("lowest")).cast("long").alias("severity_rank"), "text")


def ballot(votes: DataFrame) -> DataFrame:
    """Per item: asked, answered, flagged and ungrounded samples; only answered ones are a denominator."""
    return votes.groupBy("item").agg(F.count("*").alias("asked"), F.count_if("answered").alias("answered"), F.count_if(F.col("answered") & F.col("flagged")).alias("flagged"), F.count_if(F.col("answered") & ~F.col("grounded")).alias("ungrounded"))


def statistics(calls: DataFrame) -> DataFrame:
    """calls (pass, status, retries, tokens) by pass; retries are unknown where one is, tokens that are missing are counted."""
    return calls.groupBy("pass").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.when(F.bool_or(F.col("retries").isNull()), None).otherwise(F.sum("retries")).alias("retries"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("tokens").isNull()).alias("without_tokens"),
    )


def first_complete(attempts: DataFrame) -> DataFrame:
    """Per sample its first complete attempt, else its first (sample, attempt, incomplete)."""
    w = Window.partitionBy("sample").orderBy(F.col("incomplete").isNotNull(), "attempt")
    return attempts.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")

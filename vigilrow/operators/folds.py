"""Folding findings of labelled samples: what each sample is called, rates by source, rules by class, ledger checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.scalar import severity_rank
from vigilrow.operators.score import deterministic


def reaches(level: str) -> Column:
    return severity_rank("severity") >= severity_rank(F.lit(level))


def qualifies(level: str, any_vote: bool = False) -> Column:
    """Whether a vote counts: escalated (or any) and severe enough."""
    return reaches(level) if any_vote else F.col("escalates") & reaches(level)


def _rules(condition: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("rule")))), ",")


def sample_fold(findings: DataFrame, level: str = "high") -> DataFrame:
    """Per sample whether rules, escalating judge findings or any judge findings reach level, and the rules that escalated."""
    judged = (F.col("source") == "llm") & (F.col("dimension") != 0)
    flag = lambda c: F.bool_or(c & reaches(level))
    return findings.groupBy("sample").agg(flag(deterministic()).alias("static"), flag(judged & F.col("escalates")).alias("judge"), flag(judged).alias("judge_any"), _rules(judged & F.col("escalates")).alias("escalated"))


def static_verdicts(findings: DataFrame, level: str = "high") -> DataFrame:
    """Per sample malicious or benign by deterministic findings, and the rules that flag it."""
    hit = deterministic() & reaches(level)
    return findings.groupBy("sample").agg(F.when(F.bool_or(hit), "malicious").otherwise("benign").alias("verdict"), _rules(hit).alias("rules"))


def triage_count(findings: DataFrame) -> DataFrame:
    """One row: artifacts with deterministic findings."""
    return findings.agg(F.countDistinct(F.when(deterministic(), F.col("artifact"))).alias("n"))


def rates_by(answers: DataFrame, *keys: str) -> DataFrame:
    """Flagged and all answers per keys."""
    return answers.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"))


def rules_by_class(flags: DataFrame) -> DataFrame:
    """Per rule on how many malicious and benign samples it flags."""
    of = lambda c: F.countDistinct(F.when(F.col("class") == c, F.col("sample")))
    return flags.groupBy("rule").agg(of("malicious").alias("malicious"), of("benign").alias("benign"))


def ledger_violations(rows: DataFrame) -> DataFrame:
    """sample and what is wrong with its ledger row (outcome, verdict, reason, attempted), a row for each fault."""
    o = F.col("outcome")
    faults = (
        ("unknown outcome", ~F.coalesce(o.isin("scored", "no-verdict", "error"), F.lit(False))),
        ("scored without verdict", (o == "scored") & F.col("verdict").isNull()),
        ("verdict without score", (o != "scored") & F.col("verdict").isNotNull()),
        ("no reason", (o != "scored") & (F.coalesce("reason", F.lit("")) == "")),
        ("scored but not attempted", (o == "scored") & ~F.col("attempted")),
    )
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in faults)))
    return rows.select("sample", F.explode(found).alias("fault"))


def suppressed_items(items: DataFrame, known: DataFrame) -> DataFrame:
    """One row: items that stay and items that a baseline holds by id."""
    both = items.join(known.select("item").distinct().withColumn("known", F.lit(True)), "item", "left")
    return both.agg(F.count_if(F.col("known").isNull()).alias("kept"), F.count("known").alias("suppressed"))

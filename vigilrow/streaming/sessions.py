"""What a session is told when it starts: what was never accepted and has findings that count, the worst first. It informs and blocks nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The version of a store that is understood, the sources of a start that are told, and how many artifacts are shown. Fixed values.
VERSION, STARTS, SHOWN = 1, ("startup", "clear"), 10

STORE = "version int, approvals map<string, struct<hash: string, name: string, kind: string, score: int, verdict: string, approved_at: bigint>>, _corrupt_record string"


def approvals(stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """stores (root, json) to (root, hash, name, kind, score, verdict, approved_at) and notes (root, reason).

    A store that does not parse or has another version is an empty one with a note: what cannot be read approves nothing. Entries whose key
    is not their own hash were not written by the gate and do not count. A null store is one that is not there.
    """
    parsed = stores.filter("json is not null").withColumn("s", F.from_json("json", STORE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    reason = F.when(F.col("s").isNull() | F.col("s._corrupt_record").isNotNull(), "approvals do not parse").when(~F.col("s.version").eqNullSafe(VERSION), "approvals have another version")
    judged = parsed.withColumn("reason", reason)
    each = judged.filter("reason is null").select("root", F.explode("s.approvals").alias("key", "a")).filter("key = a.hash and key <> ''")
    return each.select("root", "a.*"), judged.filter("reason is not null").select("root", "reason")


def session_start(starts: DataFrame, artifacts: DataFrame, findings: DataFrame, approved: DataFrame, threshold: int = 3) -> DataFrame:
    """session, place, artifact, score, rules and more of what a start is told: SHOWN artifacts at most, by score, then by name; more says how many others there are.

    starts: session, root, source (null counts as a start); artifacts: root, artifact, hash, score, child (whether another one shows it); findings: root, artifact, rule,
    rank, deterministic; approved: root, hash. rules: of all deterministic findings, sorted.
    """
    known = artifacts.filter("not child").join(approved.select("root", "hash").distinct(), ["root", "hash"], "left_anti")
    own = findings.filter("deterministic").groupBy("root", "artifact").agg(F.max("rank").alias("worst"), F.array_sort(F.collect_set("rule")).alias("rules")).filter(F.col("worst") >= threshold)
    order = Window.partitionBy("root").orderBy("score", "artifact")
    listed = known.join(own, ["root", "artifact"]).withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("root"))).filter(F.col("place") <= SHOWN)
    told = starts.filter(F.col("source").isNull() | F.col("source").isin("", *STARTS)).select("session", "root")
    return told.join(listed, "root").select("session", "place", "artifact", "score", F.array_join("rules", ",").alias("rules"), F.greatest(F.col("n") - SHOWN, F.lit(0)).alias("more"))

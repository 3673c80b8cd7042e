"""Artifacts and what belongs to them: parents and children, notes, counts, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilrow.functions.scalar import inside, severity_rank
from vigilrow.operators.score import deterministic


def parents(children: DataFrame, plugins: DataFrame) -> DataFrame:
    """child and parent: of the plugins (name, path, parent, place) of a child's name, one that holds its path before others, then the first."""
    first = F.min(F.struct("place", "parent")).alias("f")
    # a folder holds a path that is the folder, or that has a slash after it: as many keys a child as its path has slashes
    ends = F.filter(F.sequence(F.lit(1), F.length("path") + 1), lambda i: F.substring(F.col("path"), i, F.lit(1)) == "/")
    own = F.array(F.struct(F.lit(True).alias("whole"), F.col("path").alias("key")))
    above = F.transform(ends, lambda i: F.struct(F.lit(False).alias("whole"), F.substring(F.col("path"), F.lit(1), i - 1).alias("key")))
    held = children.filter("path is not null").select("child", "plugin", F.explode(F.concat(own, above)).alias("k")).select("child", "plugin", "k.*")
    keys = F.array(F.struct(F.lit(True).alias("whole"), F.col("path").alias("key")), F.struct(F.lit(False).alias("whole"), F.regexp_replace("path", "/+\\z", "").alias("key")))
    folders = plugins.filter("path is not null").select(F.col("name").alias("plugin"), "parent", "place", F.explode(keys).alias("k")).groupBy("plugin", "k.whole", "k.key").agg(first)
    named = plugins.groupBy(F.col("name").alias("plugin")).agg(first)
    # one plugin a key on the right, so that no join makes pairs of all children and plugins of a name
    found = held.join(folders, ["plugin", "whole", "key"]).select("child", F.lit(False).alias("apart"), "f")
    found = found.union(children.select("child", "plugin").join(named, "plugin").select("child", F.lit(True).alias("apart"), "f"))
    return found.groupBy("child").agg(F.min(F.struct("apart", "f")).alias("m")).select("child", "m.f.parent")


def shown_by_parent(findings: DataFrame, family: DataFrame) -> DataFrame:
    """Deterministic findings of children that their parent has too, by rule, file and line."""
    own = findings.filter(deterministic())
    upper = own.select(F.col("artifact").alias("parent"), "rule", "file", "line")
    return own.join(family.withColumnRenamed("child", "artifact"), "artifact").join(upper, ["parent", "rule", "file", "line"], "left_semi")


def coalesced_notes(notes: DataFrame, most: int = 10) -> DataFrame:
    """Per title: how many notes, the first `most` evidences and how many more, and reasons, commonest first.

    Evidence is ranked in parts first, so that no task sorts all notes of a title.
    """
    part = F.pmod(F.xxhash64("evidence"), F.lit(64))
    local = notes.select("title", "evidence", part.alias("part")).withColumn("n", F.row_number().over(Window.partitionBy("title", "part").orderBy("evidence"))).filter(F.col("n") <= most)
    ranked = local.withColumn("n", F.row_number().over(Window.partitionBy("title").orderBy("evidence"))).filter(F.col("n") <= most)
    lists = ranked.groupBy("title").agg(F.array_join(F.array_sort(F.collect_list("evidence")), ",").alias("evidence"))
    reasons = notes.groupBy("title", "reason").agg(F.count("*").alias("k"))
    counts = reasons.groupBy("title").agg(F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "reason"))).alias("r"))
    said = F.array_join(F.transform("r", lambda x: F.concat(x["reason"], F.lit(" x "), -x["k"])), ", ")
    more = F.when(F.col("n") > most, F.concat(F.lit(" … "), F.col("n") - most, F.lit(" more"))).otherwise("")
    return counts.join(lists, "title").select("title", "n", F.concat("evidence", more).alias("evidence"), said.alias("reasons"))


def environment_counts(artifacts: DataFrame) -> DataFrame:
    """Per kind how many artifacts there are, those that come with a plugin apart."""
    return artifacts.groupBy("kind").agg(F.count_if(~F.col("bundled")).alias("own"), F.count_if("bundled").alias("bundled"))


def gate_summary(scores: DataFrame, findings: DataFrame, level: str = "high", most: int = 5) -> DataFrame:
    """One row: the artifact that scores worst (scores: artifact, child, score), its worst findings, how many more, and whether one blocks."""
    worst = scores.filter("not child").agg(F.min(F.struct("score", "artifact")).alias("w")).select("w.artifact", "w.score")
    own = findings.join(F.broadcast(worst), "artifact")  # one row
    order = F.struct((-severity_rank("severity")).alias("r"), "rule", "file", "line")
    top = own.select(order.alias("o")).orderBy("o").limit(most).agg(F.array_join(F.array_sort(F.collect_list("o")).getField("rule"), ",").alias("top"))
    block = own.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(severity_rank("severity") >= severity_rank(F.lit(level))), F.lit(False)).alias("blocking"))
    return worst.crossJoin(block).crossJoin(top).select("artifact", "score", "blocking", "top", F.greatest(F.col("n") - most, F.lit(0)).alias("omitted"))


def short_ids(items: DataFrame, start: int = 4, step: int = 4, levels: int = 4) -> DataFrame:
    """item and id: the shortest prefix of its hash that no earlier item has, by `start` and then `step` more hex digits; last the whole hash."""
    left, out = items.select("item", "place", "hash"), None
    for k in range(levels):
        head = F.substring("hash", 1, start + k * step)
        n = F.row_number().over(Window.partitionBy(head).orderBy("place"))
        ranked = left.withColumn("n", n)
        taken = ranked.filter("n = 1").select("item", head.alias("id"))
        out = taken if out is None else out.union(taken)
        left = ranked.filter("n > 1").drop("n")
    return out.union(left.select("item", F.col("hash").alias("id")))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """The first of each (finding, file, line), by place."""
    return evidence.groupBy("finding", "file", "line").agg(F.min("place").alias("place"))


def lowest(scores: DataFrame, most: int = 10) -> DataFrame:
    """The artifacts with the lowest scores, and how many more there are."""
    total = scores.agg(F.count("*").alias("n"))
    return scores.orderBy("score", "artifact").limit(most).crossJoin(F.broadcast(total)).select("artifact", "score", F.greatest(F.col("n") - most, F.lit(0)).alias("rest"))

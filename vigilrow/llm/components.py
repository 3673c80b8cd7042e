"""Connected components of a graph given as an edge table, by alternating star contractions.

Each round replaces edges by edges to the smallest neighbour, first for larger neighbours, then for
smaller ones, until nothing changes; every step is an aggregate with map-side combining or a join whose
skew Spark can split. Rounds are written to the shared folder, so that lost executors cost little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import discard, materialize


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): each id that occurs in the columns a, b of edges, with the smallest id it reaches.

    Edges with a null end count for nothing; an edge from an id to itself makes the id occur; repeated and
    reversed edges are the same edge; an empty table gives no rows.
    """
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u is not null and v is not null")
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    ids = now
    now = now.filter("u <> v")
    mark, rounds = _mark(now), []
    while mark[0]:
        # larger neighbours of a node are joined to its smallest one
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # then a node and its smaller neighbours to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        changed = _mark(after)
        if rounds:
            discard(rounds.pop())
        rounds.append(after)
        now = after
        if changed == mark:
            break
        mark = changed
    every = ids.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return every.join(now.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def joined_components(label: DataFrame, more: DataFrame) -> DataFrame:
    """label (id, component), as connected_components() gives it, after the further edges more (a, b): only
    components that these touch are looked at again.
    """
    ends = more.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").distinct()
    label = label.unionByName(ends.join(label, "id", "left_anti").select("id", F.col("id").alias("component")))
    of = lambda end: label.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    between = more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    over = connected_components(between).select(F.col("id").alias("component"), F.col("component").alias("least"))
    return label.join(over, "component", "left").select("id", F.coalesce("least", "component").alias("component"))

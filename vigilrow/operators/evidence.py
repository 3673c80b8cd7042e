"""What of a text is shown: windows of lines around its hits, merged where they touch, and admitted by rank until a budget is spent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_windows(hits: DataFrame, around: int) -> DataFrame:
    """unit, first, last, rank (the greatest) and n_hits of the windows of hits (unit, line, rank): `around` lines on both sides, merged where they overlap or touch."""
    w = hits.groupBy("unit", "line").agg(F.max("rank").alias("rank"), F.count("*").alias("k"))
    w = w.select("unit", F.greatest(F.col("line") - around, F.lit(1)).alias("first"), (F.col("line") + around).alias("last"), "rank", "k")
    before = Window.partitionBy("unit").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    # a window starts an island if all before it end more than a line above it
    starts = w.withColumn("starts", F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True)).cast("int"))
    island = F.sum("starts").over(Window.partitionBy("unit").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0))
    each = starts.withColumn("island", island).groupBy("unit", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("rank").alias("rank"), F.sum("k").alias("n_hits"))
    return each.drop("island")


def evidence(hits: DataFrame, lines: DataFrame, around: int = 3, budget: int = 6000) -> DataFrame:
    """unit, place, first, last, rank, n_hits, text and omitted: the windows that fit the budget of characters of their unit, by rank, then by line.

    hits: unit, line, rank; lines: unit, line, raw. A window counts with its line ends. The first that does not fit ends the list, so that what is
    shown never jumps over something graver; omitted says how many windows of the unit were left out. Windows end with the text.
    """
    windows = merged_windows(hits, around)
    # each line belongs to one window of its unit at most; windows are dealt out line by line, so that a long unit is no group
    shown = windows.withColumn("line", F.explode(F.sequence("first", "last"))).join(lines.select("unit", "line", "raw"), ["unit", "line"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")
    whole = shown.groupBy("unit", "first", "rank", "n_hits").agg(F.max("line").alias("last"), text.alias("text"))
    order = Window.partitionBy("unit").orderBy(F.desc("rank"), "first")
    ranked = whole.withColumn("place", F.row_number().over(order)).withColumn("spent", F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = ranked.withColumn("all", F.count("*").over(Window.partitionBy("unit"))).filter(F.col("spent") <= budget)
    return fits.withColumn("omitted", F.col("all") - F.max("place").over(Window.partitionBy("unit"))).select("unit", "place", "first", "last", "rank", "n_hits", "text", "omitted")

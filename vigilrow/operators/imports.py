"""The import graph of instruction files: what `@path` references pull in, hop by hop.

References are taken from the prose of each file once and kept as an edge table of small rows; the search over it is breadth-first,
a join of the frontier with the edges and an anti join with what was seen, cut after each hop. Texts take part in the first step
alone. The number of hops is bounded by the rules of the format, so a cycle ends by what was seen and a chain by the bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.paths import credential, resolved
from vigilrow.functions.regex import re2_to_java
from vigilrow.functions.scalar import inside
from vigilrow.operators.comments import strip_code
from vigilrow.sources.shared import cut

#: Hops that imports are followed. A fixed value.
HOPS = 4
#: An `@path` behind a blank or a bracket; blanks, brackets and back quotes end it.
REFERENCE = r"(?:^|[\s(])@([^\s()`]+)"


def references(files: DataFrame) -> DataFrame:
    """root, home, src, at (order in the file), ref and dst of the references in the prose of files (root, home, path, text), each once a file."""
    found = F.regexp_extract_all(strip_code("text"), F.lit(re2_to_java(REFERENCE)), F.lit(1))
    each = files.filter(F.contains("text", F.lit("@"))).select("root", "home", F.col("path").alias("src"), F.posexplode(found).alias("at", "ref"))
    each = each.withColumn("ref", F.regexp_replace("ref", r"[.,;:]+\z", "")).filter("ref <> ''")
    each = each.groupBy("root", "home", "src", "ref").agg(F.min("at").alias("at"))
    return each.select("root", "home", "src", "at", "ref", resolved("ref", "src", "home").alias("dst"))


def expand(files: DataFrame, seeds: DataFrame, known: DataFrame, hops: int = HOPS) -> DataFrame:
    """root, path, depth, importer, ref, state and severity of every file that the seeds pull in, each once.

    files: root, home, path, text; seeds and known: root, path; what is known is neither followed nor returned. A reference to what is
    no file leads nowhere. state: `reached`, and followed further; `credential`, which is refused with a severity; `outside` of home; `too deep`.
    depth is the least; of several importers at that depth the first by path, then by place, counts.
    """
    stands = files.select("root", F.col("path").alias("dst")).distinct()
    edges = cut(references(files).join(stands, ["root", "dst"], "left_semi"))
    seen = seeds.select("root", "path").unionByName(known.select("root", "path")).distinct()
    frontier, found = seeds.select("root", F.col("path").alias("src")).distinct(), []
    state = F.when(F.col("depth") > hops, "too deep").when(credential("path").isNotNull(), "credential").when(~inside("path", "home"), "outside").otherwise("reached")
    for depth in range(1, hops + 2):
        new = edges.join(frontier, ["root", "src"]).groupBy("root", "home", F.col("dst").alias("path")).agg(F.min(F.struct("src", "at", "ref")).alias("by")).join(seen, ["root", "path"], "left_anti")
        new = new.withColumn("depth", F.lit(depth)).withColumn("state", state).withColumn("severity", F.when(F.col("state") == "credential", credential("path")))
        new = cut(new.select("root", "path", "depth", F.col("by.src").alias("importer"), F.col("by.ref").alias("ref"), "state", "severity"))
        found.append(new)
        if new.isEmpty():
            break
        seen = seen.unionByName(new.select("root", "path"))
        frontier = new.filter("state = 'reached'").select("root", F.col("path").alias("src"))
    return reduce(DataFrame.unionByName, found)


def findings(expanded: DataFrame) -> DataFrame:
    """root, rule, dimension, severity, file (the importer) and snippet of what expand() refused: a credential is a finding and a note, the others notes."""
    # as an instruction file wrote it
    rows = expanded.filter("state <> 'reached'").withColumn("snippet", F.concat(F.lit("@"), "ref"))
    note = rows.select("root", F.lit("COV-000").alias("rule"), F.lit(0).alias("dimension"), F.when(F.col("state") == "credential", "high").when(F.col("state") == "outside", "medium").otherwise("low").alias("severity"), F.col("importer").alias("file"), "snippet")
    scored = rows.filter("state = 'credential'").select("root", F.lit("EXFIL-005").alias("rule"), F.lit(3).alias("dimension"), "severity", F.col("importer").alias("file"), "snippet")
    return note.unionByName(scored)

"""Which part of an artifact a file is: roles by name and place, and documents that the instructions name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilrow.functions.regex import re2_to_java
from vigilrow.operators.comments import code_only, fence_lines

#: So many documents that a body names count. A fixed value.
NAMED_CAP = 8


def role_by_name(path: str) -> Column:
    base = F.regexp_extract(path, "[^/]*\\z", 0)
    return F.when(base.isin("SKILL.md", "CLAUDE.md"), "instruction").when(base.rlike(r"(?i)\.(?:md|txt)\z") | base.startswith("CHANGELOG"), "doc").otherwise("script")


def named_documents(files: DataFrame) -> DataFrame:
    """tree, place (from 1) and path of the documents that a tree's SKILL.md names, by path or else by bare name, in the order of
    their first mention, NAMED_CAP at most. files: tree, path (in the tree) and text.
    """
    body = files.filter("path = 'SKILL.md'").select("tree", F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_./-]+\.(?:md|txt)\b"), F.lit(0))).alias("at", "token"))
    body = body.select("tree", "at", F.regexp_replace("token", r"^\./", "").alias("token"))
    docs = files.filter((role_by_name("path") == "doc")).select("tree", "path", F.regexp_extract("path", "[^/]*\\z", 0).alias("base"))
    by_path = body.join(docs.select("tree", F.col("path").alias("token"), F.col("path").alias("exact")), ["tree", "token"], "left")
    first = docs.groupBy("tree", F.col("base").alias("token")).agg(F.min("path").alias("bare"))
    found = by_path.join(first, ["tree", "token"], "left").select("tree", "at", F.coalesce("exact", "bare").alias("path")).filter("path is not null")
    found = found.groupBy("tree", "path").agg(F.min("at").alias("at"))
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy("at")))
    return ranked.filter(F.col("place") <= NAMED_CAP).select("tree", "place", "path")


def file_roles(files: DataFrame) -> DataFrame:
    """files with role: by name, a command in its folder is an instruction, and a document that is named is `named`.

    Only documents meet the named ones; the texts of all other files stay where they are.
    """
    role = F.when(F.col("path").rlike(r"(?:^|/)commands/[^/]+\.md\z"), "instruction").otherwise(role_by_name("path"))
    known = files.withColumn("role", role)
    named = named_documents(files).select("tree", "path", F.lit(True).alias("is_named"))
    docs = known.filter("role = 'doc'").join(named, ["tree", "path"], "left").withColumn("role", F.when(F.col("is_named"), "named").otherwise("doc"))
    return known.filter("role <> 'doc'").unionByName(docs.drop("is_named"))


def scan_units(files: DataFrame) -> DataFrame:
    """files with the roles that rules know: a named document is scanned whole as a document and its fenced lines as code."""
    views = F.when(F.col("role") == "named", F.array(F.lit("doc"), F.lit("code"))).otherwise(F.array("role"))
    each = files.withColumn("role", F.explode(views))
    return each.withColumn("text", F.when(F.col("role") == "code", code_only("text")).otherwise(F.col("text")))


def fenced_lines(units: DataFrame) -> DataFrame:
    """unit, line and raw of the lines that stand in a fence tagged as shell; one that is not closed runs to the end."""
    both = F.arrays_zip(F.split("text", "\n").alias("raw"), fence_lines("text", shell_only=True).alias("inside"))
    lines = units.select("unit", F.posexplode(both).alias("at", "x"))
    return lines.filter("x.inside").select("unit", (F.col("at") + 1).alias("line"), "x.raw")


#: Marks that quote, with those that end the quote. Fixed values.
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("`", "`"), ("「", "」"), ("『", "』"))
#: Words by which a line says that what it quotes is not to be done, or is shown only; our own list.
CUES = r"\b(?:never|must not|should not|cannot|won't|refuses?|reject(?:s|ed)?|block(?:s|ed)?|flag(?:s|ged)?|beware|warn(?:s|ing)?|attacks?|malicious|suspicious|examples?|for instance|phrases? like|e\.g)\b"


def quoted_as_example(line: Column, pattern: str) -> Column:
    """Whether what pattern (java) finds first in a line stands between quotation marks and the line refuses it or shows it as an example."""
    before = F.regexp_extract(line, f"^([^\\n]*?)(?:{pattern})", 1)
    behind = F.regexp_extract(line, f"^[^\\n]*?(?:{pattern})([^\\n]*)", 1)
    inside = reduce(Column.__or__, (F.contains(before, F.lit(a)) & F.contains(behind, F.lit(b)) for a, b in QUOTES))
    return inside & line.rlike("(?i)" + re2_to_java(CUES))

"""Sinks: JSON, SARIF and Markdown of findings, with control characters taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.scalar import INVISIBLE, severity_rank

LEVELS = ("note", "note", "warning", "error", "error")


def sanitized(c: str):
    """Without terminal sequences, control and invisible characters."""
    return F.regexp_replace(F.regexp_replace(c, "\u001b\\[[0-9;?]*[A-Za-z]", ""), f"[\\u0000-\\u0008\\u000b-\\u001f\\u007f-\\u009f{INVISIBLE}]", "")


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result per finding, as JSON; its fingerprint has the rule, the file and the message but no line."""
    level = F.element_at(F.array(*map(F.lit, LEVELS)), severity_rank("severity") + 1)
    mark = F.sha2(F.concat_ws("\u0000", "rule", "file", "message"), 256)
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    row = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(sanitized("message").alias("text")).alias("message"), F.array(where).alias("locations"), F.struct(mark.alias("stable/v1")).alias("partialFingerprints"))
    return findings.select("artifact", F.to_json(row).alias("result"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """A folder of results, one JSON object on a line, a file per task."""
    sarif_results(findings).select("result").write.mode("overwrite").text(path)


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def markdown(report: DataFrame) -> DataFrame:
    """A Markdown table row per line of a report."""
    return report.select("artifact", F.concat(F.lit("| "), F.concat_ws(" | ", *(sanitized(c) for c in report.columns)), F.lit(" |")).alias("row"))

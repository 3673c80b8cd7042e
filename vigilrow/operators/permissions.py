"""Audit of permission grants such as `Bash(git *)`; the first class that fits decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERPRETERS = ("bash", "sh", "zsh", "python", "python3", "node", "ruby", "perl", "php")

#: Binaries that can start others; a pattern says which arguments do, none that any do. Our own choice.
LEVERS = {"find": r"-exec|-delete", "tar": r"--to-command|--checkpoint-action", "git": r"-c(?:\s|$)|--upload-pack", "ssh": "", "xargs": "", "env": "", "awk": "", "make": "", "docker": "run|exec", "sudo": ""}


def audit(settings: DataFrame) -> DataFrame:
    """settings (item, allow, deny) to findings (item, grant, rule, dimension, severity); PERM-004 once where allow has grants and deny none."""
    grants = settings.select("item", F.explode("allow").alias("grant"))
    inner = F.regexp_extract("grant", r"^Bash\((.*)\)$", 1)
    words = grants.withColumn("inner", inner).withColumn("binary", F.element_at(F.split(F.regexp_extract("inner", r"^(?:[A-Z_]+=\S+\s+)*([^\s:*]*)", 1), "/"), -1))
    words = words.withColumn("args", F.trim(F.regexp_replace(F.regexp_extract("inner", r"^(?:[A-Z_]+=\S+\s+)*[^\s:*]*[\s:]*(.*)$", 1), r"\*", "")))
    wild = F.col("grant").contains("*")
    lever = F.coalesce(*(F.when(F.col("binary") == b, F.lit(p)) for b, p in LEVERS.items()))
    escapes = wild & lever.isNotNull() & ((F.col("args") == "") | (lever == "") | F.when(lever != "", F.regexp_like("args", lever)).otherwise(False))
    kind = (
        F.when(F.col("grant").rlike(r"(?i)(?:password|token|secret|api[_-]?key)\s*[=:]\s*\S{8,}"), F.lit("PERM-001"))
        .when(F.col("grant").isin("Bash(*)", "Bash", "Bash(:*)"), "PERM-005")
        .when(wild & F.col("binary").isin(*INTERPRETERS), "PERM-002")
        .when(escapes, "PERM-006")
        .when(F.col("grant").rlike(r"^(?:Read|Write|Edit)\((?:/|~/|//)?\*\*?(?:/\*)?\)$"), "PERM-003")
    )
    per = words.withColumn("rule", kind).filter("rule is not null").select("item", "grant", "rule")
    none = settings.filter("size(allow) > 0 and (deny is null or size(deny) <= 0)").select("item", F.lit("").alias("grant"), F.lit("PERM-004").alias("rule"))
    weights = {"PERM-001": (3, "high"), "PERM-002": (2, "medium"), "PERM-003": (9, "low"), "PERM-004": (2, "low"), "PERM-005": (2, "high"), "PERM-006": (2, "medium")}
    pick = lambda k: F.coalesce(*(F.when(F.col("rule") == r, F.lit(w[k])) for r, w in weights.items()))
    return per.union(none).withColumn("dimension", pick(0)).withColumn("severity", pick(1))

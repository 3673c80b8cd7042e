"""Rules over several lines or files of an artifact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilrow.functions.regex import re2_to_java
from vigilrow.functions.scalar import service_tokens, small
from vigilrow.operators.rules import once

#: Our own patterns of the three legs of an outbound chain.
CREDENTIAL = r"(?i)(?:\.ssh/id_|\.aws/credentials|\.netrc|api_token|secret_key|access_key)"
NETWORK = r"(?i)(?:\bcurl\b.*\s(?:-d|-F|--data|-X\s*POST)\b|requests\.post\(|\bwget\b.*--post)"
ENCODE = r"(?i)\bbase64\b"
#: leg, pattern and words in small letters of which every match holds one.
LEGS = (
    ("credential", CREDENTIAL, (".ssh/id_", ".aws/credentials", ".netrc", "api_token", "secret_key", "access_key")),
    ("network", NETWORK, ("curl", "requests.post(", "wget")),
    ("encode", ENCODE, ("base64",)),
)

#: How many sightings of a leg count in a unit; None: all.
LEG_CAP = None


def physical_lines(units: DataFrame) -> DataFrame:
    """artifact, unit, role, file, line (from 1) and raw."""
    return units.select("artifact", "unit", "role", "file", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("line", F.col("at") + 1).drop("at")


def legs(lines: DataFrame) -> DataFrame:
    """unit, leg and line of every sighting of a leg; lines without a word of a leg meet no pattern."""
    near = lambda words: reduce(Column.__or__, (F.col("small").contains(x) for x in words))
    kinds = F.array_compact(F.array(*(F.when(near(words) & F.col("raw").rlike(re2_to_java(p)), k) for k, p, words in LEGS)))
    few = once(lines.select("artifact", "unit", "role", "line", "raw"), small=small("raw")).filter(near([x for _, _, words in LEGS for x in words]))
    return few.select("artifact", "unit", "role", "line", F.explode(kinds).alias("leg"))


def closest_pairs(seen: DataFrame) -> DataFrame:
    """Per unit with a credential and a network leg: the closest two, earliest on ties, whether it encodes, and the rule.

    No sighting of either leg is between the closest two, so at the lower one both are the last that were seen: one pass in order of lines,
    and no pairs of all sightings.
    """
    upto = Window.partitionBy("artifact", "unit").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("line"))).over(upto)
    near = seen.select("artifact", "unit", "leg", last("credential").alias("c"), last("network").alias("n"))
    pair = F.when(F.col("c").isNotNull() & F.col("n").isNotNull(), F.struct(F.abs(F.col("c") - F.col("n")).alias("d"), "c", "n"))
    best = near.groupBy("artifact", "unit").agg(F.min(pair).alias("b"), F.bool_or(F.col("leg") == "encode").alias("encodes")).filter("b is not null")
    out = best.select("artifact", "unit", F.col("b.c").alias("credential_line"), F.col("b.n").alias("network_line"), "encodes")
    return out.withColumn("rule", F.when(F.col("encodes"), "EXFIL-003").otherwise("EXFIL-001"))


def cross_file_chains(seen: DataFrame) -> DataFrame:
    """Artifacts whose credential and network legs are only in different units."""
    has = lambda k: F.max(F.col("leg") == k)
    per = seen.groupBy("artifact", "unit").agg(has("credential").alias("c"), has("network").alias("n"))
    return per.groupBy("artifact").agg(F.max("c").alias("c"), F.max("n").alias("n"), F.max(F.col("c") & F.col("n")).alias("whole")).filter("c and n and not whole").select("artifact")


def blank_runs(lines: DataFrame, least: int = 200) -> DataFrame:
    """Per unit the longest run of at least `least` blank lines before content: its length and the next line."""
    w = Window.partitionBy("unit").orderBy("line")
    blanks = lines.withColumn("blank", F.trim("raw") == "").withColumn("next", F.lead("line").over(w)).filter("blank")
    islands = blanks.withColumn("island", F.col("line") - F.row_number().over(w))
    runs = islands.groupBy("unit", "island").agg(F.count("*").alias("length"), F.max_by("next", "line").alias("next")).filter((F.col("length") >= least) & F.col("next").isNotNull())
    return runs.groupBy("unit").agg(F.max(F.struct("length", (-F.col("next")).alias("m"))).alias("b")).select("unit", F.col("b.length").alias("length"), (-F.col("b.m")).alias("content_line"))


def written_then_sourced(lines: DataFrame) -> DataFrame:
    """unit, path, and first lines where a temporary script is written and, on another line, sourced from a startup file."""
    written = lines.select("unit", F.col("line").alias("w"), F.regexp_extract("raw", r">\s*(/tmp/[A-Za-z0-9._/-]+)", 1).alias("path")).filter("path <> ''")
    sourced = lines.filter(F.col("raw").rlike(r">>\s*~/\.(?:bashrc|zshrc|profile)")).select("unit", F.col("line").alias("s"), F.regexp_extract("raw", r"(?:source|\.)\s+(/tmp/[A-Za-z0-9._/-]+)", 1).alias("path")).filter("path <> ''")
    return written.join(sourced, ["unit", "path"]).filter("w <> s").groupBy("unit", "path").agg(F.min("w").cast("long").alias("written"), F.min("s").cast("long").alias("sourced"))


def registry_redirects(lines: DataFrame, official: tuple[str, ...] = ("registry.npmjs.org", "pypi.org")) -> DataFrame:
    """unit, line and host where a package registry is set to a host off the list; `$NAME` is what NAME was last set to above or on that line."""
    nothing = F.lit(None).cast("string")
    target = F.regexp_extract("raw", r"registry\s+(\S+)", 1)
    uses = lines.select("unit", "line", target.alias("target")).filter("target <> ''")
    uses = uses.select("unit", "line", "target", F.regexp_extract("target", r"^\$\{?([A-Z_]+)", 1).alias("name"))
    assigned = lines.select("unit", "line", nothing.alias("target"), F.regexp_extract("raw", r"^([A-Z_]+)=(\S+)", 1).alias("name"), F.regexp_extract("raw", r"^([A-Z_]+)=(\S+)", 2).alias("value")).filter("name <> ''")
    # only assignments of names that are used meet uses; on one line the assignment comes first
    both = uses.filter("name <> ''").withColumn("value", nothing).unionByName(assigned)
    upto = Window.partitionBy("unit", "name").orderBy("line", F.col("target").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = both.withColumn("url", F.last("value", ignorenulls=True).over(upto)).filter("target is not null").select("unit", "line", "url")
    plain = uses.filter("name = ''").select("unit", "line", F.col("target").alias("url"))
    out = plain.unionByName(named).withColumn("host", F.lower(F.regexp_extract("url", r"(?i)^https?://([A-Za-z0-9.-]+)", 1)))
    return out.filter((F.col("host") != "") & ~F.col("host").isin(*official)).select("unit", F.col("line").cast("long").alias("line"), "host")


def skipped_references(lines: DataFrame, folders: DataFrame) -> DataFrame:
    """Per folder that was not scanned, the first line outside documents that points into it."""
    words = lines.filter("role <> 'doc'").select("artifact", "unit", "line", F.explode(F.regexp_extract_all("raw", F.lit(r"(?:\./)?([A-Za-z0-9_.-]+)/[A-Za-z0-9_.-]+"), F.lit(1))).alias("folder"))
    return words.join(folders, ["artifact", "folder"]).groupBy("artifact", "folder").agg(F.min(F.struct("unit", "line")).alias("b")).select("artifact", "folder", "b.unit", "b.line")


def magic_mismatch(files: DataFrame) -> DataFrame:
    """Files (path, content) with a text name that begin like an archive or a program."""
    magic = {"504B0304": "zip", "1F8B": "gzip", "7F454C46": "elf", "4D5A": "pe", "25504446": "pdf"}  # fixed values
    text = F.col("path").rlike(r"(?i)\.(?:md|txt|py|sh|js|json|ya?ml)\z")
    kind = F.coalesce(*(F.when(F.startswith(F.hex("content"), F.lit(h)), k) for h, k in magic.items()))
    return files.filter(text).select("path", kind.alias("kind")).filter("kind is not null")


def assigned_then_erased(lines: DataFrame) -> DataFrame:
    """unit, name, first line where a log or history path is bound to the name and the first line below it that erases what it names."""
    bound = lines.select("unit", F.col("line").alias("assigned"), F.regexp_extract("raw", r"^[ \t]*([A-Z_]+)=[\"']?(?:/var/log/|~?/?[^ ]*_history)", 1).alias("name")).filter("name <> ''")
    erased = lines.select("unit", F.col("line").alias("erased"), F.regexp_extract("raw", r"\b(?:rm|shred|truncate)\b[^$]{0,200}\$\{?([A-Z_]+)", 1).alias("name")).filter("name <> ''")
    bound = bound.groupBy("unit", "name").agg(F.min("assigned").alias("assigned"))
    return bound.join(erased, ["unit", "name"]).filter("erased > assigned").groupBy("unit", "name", "assigned").agg(F.min("erased").alias("erased"))


def named_then_written(lines: DataFrame) -> DataFrame:
    """Units that name a settings file on one line and write on another: the first line of each kind."""
    named, written = (F.when(F.col("raw").rlike(p), F.col("line")) for p in (r"settings(?:\.local)?\.json", r"\.write\(|json\.dump\(|open\([^)]*['\"]w['\"]"))
    ends = lines.select("unit", named.alias("n"), written.alias("w")).filter("n is not null or w is not null")
    ends = ends.groupBy("unit").agg(F.min("n").alias("named"), F.max("n").alias("n"), F.min("w").alias("written"), F.max("w").alias("w"))
    return ends.filter("named is not null and written is not null and not (named = n and written = w and n = w)").select("unit", "named", "written")


def destination_consistency(credentials: DataFrame, hosts: DataFrame) -> DataFrame:
    """unit and consistent: every host can be read and carries a service token of a credential of the unit, and there is a host and a token.

    credentials: unit, name; hosts: unit, host (one with a `$` cannot be read).
    """
    tokens = credentials.select("unit", F.explode(service_tokens("name")).alias("token")).distinct()
    seen = hosts.distinct().join(tokens, "unit", "left").groupBy("unit", "host").agg(F.coalesce(F.bool_or(F.contains("host", "token")), F.lit(False)).alias("match"))
    return seen.groupBy("unit").agg(F.bool_and(F.col("match") & ~F.col("host").contains("$")).alias("consistent"))

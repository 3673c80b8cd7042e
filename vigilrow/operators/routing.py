"""From the files of a target to artifacts and scan units: what kind of thing a target is, which artifact each file belongs to,
and the first copy of equal files of an artifact.

All of it works on rows (target, path, ...) of any number of targets, as the tree source gives them: marks of a folder are aggregates, and
membership is a join with the folders that hold a manifest, which only files below skills/ take part in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.paths import base, folder
from vigilrow.operators.layout import file_roles, scan_units

#: Names by which a layout is known. Fixed values.
MANIFEST, PLUGIN, INSTALLED, ROOT_NAME = "SKILL.md", ".claude-plugin/plugin.json", "plugins/installed_plugins.json", ".claude"
#: Folders of a root whose files are artifacts of their own, with their kind. Fixed values.
COLLECTED = {"agents": "subagent", "commands": "command", "rules": "rule", "workflows": "workflow", "output-styles": "output_style"}
INSTRUCTIONS, CONFIGS = ("CLAUDE.md", "CLAUDE.local.md"), ("settings.json", "settings.local.json")

#: A Python file that serves tools imports the kit and declares a server or a tool; our own patterns.
_KIT = r"(?m)^[ \t]*(?:import|from)[ \t]+(?:fast)?mcp\b"
_DECLARES = r"(?m)\b(?:FastMCP|Server)\s*\(|^[ \t]*@\w+(?:\.\w+)*\.(?:tool|call_tool|list_tools)\b|\.add_tool\s*\("
#: Bytes and levels in which that is looked for. Fixed values.
PROBE_BYTES, PROBE_DEPTH = 64 << 10, 3


def layouts(files: DataFrame) -> DataFrame:
    """target and layout: `file`, `skill`, `plugin`, `root`, `server` or `directory`, in this order. files: target, path, text; a file that is the target itself has an empty path."""
    head = F.left("text", F.lit(PROBE_BYTES))
    near = F.size(F.split("path", "/")) <= PROBE_DEPTH + 2
    serves = near & F.lower("path").endswith(".py") & head.rlike(_KIT) & head.rlike(_DECLARES)
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    root = (base("target") == ROOT_NAME) | has(F.col("path") == INSTALLED)
    marks = files.groupBy("target").agg(has(F.col("path") == "").alias("single"), has(F.col("path") == MANIFEST).alias("skill"), has(F.col("path") == PLUGIN).alias("plugin"), root.alias("root"), has(serves).alias("server"))
    return marks.select("target", F.when(F.col("single"), "file").when(F.col("skill"), "skill").when(F.col("plugin"), "plugin").when(F.col("root"), "root").when(F.col("server"), "server").otherwise("directory").alias("layout"))


def members(files: DataFrame) -> DataFrame:
    """files with kind, artifact and inner, the path in the artifact; a plugin's files are its own and its skills', commands' and agents'.

    Files of a root that belong to no artifact have kind `unowned` and the first part of their path as artifact.
    """
    known = files.join(layouts(files), "target")
    parts = F.split("path", "/")
    top, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    # the skills of a root or plugin: folders below skills/ that hold a manifest, those below skills/synced one or two levels deeper
    deep = (second == "synced") & (F.size(parts) > 3)
    near = F.concat_ws("/", top, second)
    held = known.filter((base("path") == MANIFEST) & (top == "skills")).select("target", folder("path").alias("at")).filter(F.col("at").rlike(r"^skills/(?:[^/]+|synced/[^/]+|synced/[^/]+/[^/]+)\z"))
    third, fourth = F.concat_ws("/", near, F.get(parts, F.lit(2))), F.concat_ws("/", near, F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))
    # only files below skills/ meet the manifests
    below = known.filter((top == "skills") & F.col("layout").isin("root", "plugin") & (F.size(parts) > 2)).select("target", "path")
    at = F.explode(F.when(deep, F.array_distinct(F.array(near, third, fourth))).otherwise(F.array(near)))
    owners = below.select("target", "path", at.alias("at")).join(held, ["target", "at"], "left_semi").groupBy("target", "path").agg(F.min_by("at", F.length("at")).alias("at"))
    nested = F.coalesce((top == "skills") & F.col("layout").isin("root", "plugin") & (F.size(parts) > 2), F.lit(False))
    rest = known.filter(~nested).withColumn("at", F.lit(None).cast("string")).unionByName(known.filter(nested).join(owners, ["target", "path"], "left"))
    name = base("target")
    skill = F.struct(F.lit("skill").alias("kind"), F.when(F.col("at").startswith("skills/synced/"), F.concat(F.lit("synced/"), base("at"))).otherwise(base("at")).alias("artifact"), F.expr("substring(path, length(at) + 2)").alias("inner"))
    loose = F.struct(F.lit("directory").alias("kind"), near.alias("artifact"), F.expr("substring_index(path, '/', -(size(split(path, '/')) - 2))").alias("inner"))
    single = lambda kind: F.struct(kind.alias("kind"), F.col("path").alias("artifact"), base("path").alias("inner"))
    kind = F.create_map(*(F.lit(x) for kv in COLLECTED.items() for x in kv))[top]
    collected = (F.size(parts) > 1) & kind.isNotNull() & ((top != "output-styles") | F.lower("path").endswith(".md"))
    nothing = F.lit(None).cast("struct<kind: string, artifact: string, inner: string>")
    in_skills = (top == "skills") & (F.size(parts) > 2)
    child = F.when(F.col("at").isNotNull(), skill).when(collected & top.isin("agents", "commands"), single(kind)).otherwise(nothing)
    of_root = (
        F.when(F.col("at").isNotNull(), skill)
        .when(in_skills & (second != "synced"), loose)
        .when(collected, single(kind))
        .when(F.col("path").isin(*INSTRUCTIONS), single(F.lit("instruction")))
        .when(F.col("path").isin(*CONFIGS), single(F.lit("settings")))
        .otherwise(F.struct(F.lit("unowned").alias("kind"), top.alias("artifact"), F.col("path").alias("inner")))
    )
    whole = F.struct(F.col("layout").alias("kind"), name.alias("artifact"), F.col("path").alias("inner"))
    command = (base(F.regexp_replace("target", "/[^/]*\\z", "")) == "commands") & F.lower("target").endswith(".md")
    lone = F.struct(F.when(command, "command").otherwise("instruction").alias("kind"), name.alias("artifact"), name.alias("inner"))
    # a lone archive is a directory of its members and has no entry with an empty path
    found = F.when(F.col("layout") == "root", F.array(of_root)).when(F.col("layout") == "plugin", F.array_compact(F.array(whole, child))).when(F.col("layout") == "file", F.array(lone)).otherwise(F.array(whole))
    return rest.select(*files.columns, "layout", F.inline(found))


def units(entries: DataFrame) -> DataFrame:
    """artifact, kind, target, path, role, text of what is scanned: the first path of equal files of an artifact and role.

    entries: the rows of the tree source; those with a note are left to notes(). A file of two artifacts is scanned in both.
    """
    own = members(entries.filter("note is null")).filter("kind <> 'unowned'")
    tree = F.struct("target", "kind", "artifact")
    roles = file_roles(own.select("target", "kind", "artifact", tree.alias("tree"), F.col("path").alias("full"), F.col("inner").alias("path"), "sha256", "text"))
    # a lone command is an instruction by its kind, wherever its name points
    roles = roles.withColumn("role", F.when(F.col("kind").isin("command", "instruction", "subagent", "output_style"), "instruction").otherwise(F.col("role")))
    first = roles.groupBy("target", "kind", "artifact", "role", "sha256").agg(F.min(F.struct("full", "path", "text")).alias("f"))
    each = first.select("target", "kind", "artifact", F.col("f.full").alias("full"), F.col("f.path").alias("path"), "role", F.col("f.text").alias("text"))
    return scan_units(each).select("target", "kind", "artifact", F.col("full").alias("path"), "role", "text")


def notes(entries: DataFrame) -> DataFrame:
    """target, path and note of what was not read, and one note for each entry of a root that belongs to nothing."""
    refused = entries.filter("note is not null").select("target", "path", "note")
    stray = members(entries.filter("note is null")).filter("kind = 'unowned'").select("target", F.col("artifact").alias("path"), F.lit("belongs to no artifact").alias("note")).distinct()
    return refused.unionByName(stray)

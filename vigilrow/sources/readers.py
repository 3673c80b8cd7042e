"""Sources: trees of files, settings, server lists, connector sessions, transcripts and result logs.

Every reader gives (rows, notes): what it could not read is a note, never silence.
"""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 1 << 20
#: Folders that are not scanned. Fixed values.
SKIPPED = ("node_modules", ".git", "dist", "build", "vendor", "__pycache__", ".venv")

HOOKS = "map<string, array<struct<matcher: string, hooks: array<struct<type: string, command: string, url: string>>>>>"
SETTINGS = f"struct<permissions: struct<allow: array<string>, deny: array<string>>, env: map<string, string>, hooks: {HOOKS}, _corrupt_record: string>"
SERVERS = "struct<mcpServers: map<string, struct<command: string, args: array<string>, env: map<string, string>, url: string>>>"
SESSION = "struct<lastActivityAt: bigint, remoteMcpServersConfig: array<struct<name: string, uuid: string, tools: array<struct<name: string, description: string>>>>>"


def tree(spark: SparkSession, root: str) -> DataFrame:
    """The files under root in any store that Spark reads, as rows of the tree source: target, path, size, sha256, text, note.

    Names and sizes are judged before contents: the scan of what is refused reads no content, and the one of what is read leaves
    files over the bound out where it lists them. Empty files, which Spark does not list, have no row. Which copies of equal files are scanned is for routing.units() to say.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    target = F.lit(root.rstrip("/"))
    # paths come with the scheme of their store
    at = urlparse(root).path.rstrip("/")
    inner = F.expr("substring(path, instr(path, :at) + length(:at) + 1)".replace(":at", "'" + at.replace("\\", "\\\\").replace("'", "\\'") + "'"))
    skipped = F.exists(F.split(inner, "/"), lambda s: s.isin(*SKIPPED))
    refused = files.withColumn("note", F.when(skipped, "excluded folder").when(F.col("length") > MAX_BYTES, "too large")).filter("note is not null")
    nothing = F.lit(None).cast("string")
    refused = refused.select(target.alias("target"), inner.alias("path"), F.col("length").alias("size"), nothing.alias("sha256"), nothing.alias("text"), "note")
    read = files.filter(F.col("length") <= MAX_BYTES).filter(~skipped)
    text = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.col("content"), F.lit(b"\0"))
    held = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    rows = read.select(target.alias("target"), inner.alias("path"), F.col("length").alias("size"), F.when(text, F.sha2("content", 256)).alias("sha256"), F.when(text, held).alias("text"), F.when(~text, "not text").alias("note"))
    return rows.unionByName(refused)


def frontmatter(files: DataFrame) -> DataFrame:
    """Adds name, description, body and the body's first line of texts with a `---` header."""
    header = F.regexp_extract("text", r"\A---\n((?s:.*?))\n---\n", 1)
    field = lambda k: F.regexp_extract(header, rf"(?m)^{k}:\s*['\"]?(.*?)['\"]?\s*$", 1)
    body = F.regexp_replace("text", r"\A---\n(?s:.*?)\n---\n", "")
    lines = F.when(header != "", F.size(F.split(header, "\n")) + 3).otherwise(1)
    return files.withColumn("name", field("name")).withColumn("description", field("description")).withColumn("body", body).withColumn("body_line", lines)


def settings(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """texts (item, json) to (grants: item, allow, deny), (env: item, line), (hooks: item, event, matcher, type, command, url) and notes (item, reason)."""
    parsed = texts.withColumn("s", F.from_json("json", SETTINGS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = parsed.filter("s is not null and s._corrupt_record is null")
    grants = good.filter("s.permissions is not null").select("item", F.coalesce("s.permissions.allow", F.array().cast("array<string>")).alias("allow"), F.coalesce("s.permissions.deny", F.array().cast("array<string>")).alias("deny"))
    env = good.select("item", F.explode("s.env").alias("k", "v")).select("item", F.concat_ws("=", "k", "v").alias("line"))
    hooks = good.select("item", F.explode("s.hooks").alias("event", "groups")).select("item", "event", F.explode("groups").alias("g"))
    hooks = hooks.select("item", "event", "g.matcher", F.explode("g.hooks").alias("h")).select("item", "event", "matcher", "h.type", "h.command", "h.url")
    notes = parsed.filter("s is null or s._corrupt_record is not null").select("item", F.lit("settings cannot be parsed").alias("reason"))
    return grants, env, hooks, notes


def servers(texts: DataFrame) -> DataFrame:
    """texts (item, json) to one row per configured server: item, name, command line, env lines and url."""
    each = texts.select("item", F.explode(F.from_json("json", SERVERS)["mcpServers"]).alias("name", "v"))
    env = F.array_join(F.array_sort(F.transform(F.map_entries("v.env"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "\n")
    return each.select("item", "name", F.concat_ws(" ", "v.command", F.array_join("v.args", " ")).alias("command"), F.coalesce(env, F.lit("")).alias("env"), "v.url")


def connectors(sessions: DataFrame) -> DataFrame:
    """sessions (file, json) to the tools of each connector name in its newest session, the first file on ties."""
    each = sessions.select("file", F.from_json("json", SESSION).alias("s")).select("file", F.col("s.lastActivityAt").alias("at"), F.explode("s.remoteMcpServersConfig").alias("c"))
    newest = each.select("file", "at", "c.name", "c.tools").withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("at"), "file"))).filter("n = 1")
    return newest.select("name", F.explode(F.array_sort("tools")).alias("t")).select("name", F.col("t.name").alias("tool"), F.concat_ws(": ", F.concat_ws("/", "name", "t.name"), "t.description").alias("text"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Uses (skill) in JSON-lines transcripts: rosters are loose evidence, tool calls strict."""
    shape = "type string, attachment struct<type: string, names: array<string>>, message struct<content: array<struct<type: string, name: string, input: struct<skill: string>>>>"
    lines = spark.read.schema(shape).json(path)
    loose = lines.filter("attachment.type = 'skill_listing'").select(F.explode("attachment.names").alias("item"), F.lit(False).alias("strict"))
    strict = lines.select(F.explode("message.content").alias("c")).filter("c.type = 'tool_use' and c.input.skill is not null").select(F.col("c.input.skill").alias("item"), F.lit(True).alias("strict"))
    return loose.union(strict)


def sarif(spark: SparkSession, path: str) -> DataFrame:
    """Results of SARIF logs: rule, level, file, line, message."""
    shape = T.StructType.fromDDL("runs array<struct<results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>")
    r = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("runs").alias("r")).select(F.explode("r.results").alias("x"))
    where = F.get("x.locations", F.lit(0))["physicalLocation"]
    return r.select(F.col("x.ruleId").alias("rule"), F.coalesce("x.level", F.lit("warning")).alias("level"), where["artifactLocation"]["uri"].alias("file"), where["region"]["startLine"].alias("line"), F.col("x.message.text").alias("message"))

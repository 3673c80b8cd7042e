"""Identity of configuration entries: a digest of what an entry does, whatever the order of its members and whatever its secrets.

An entry is known by its leaves, sorted by path, so that members have no order and elements of arrays have one. Values that are announced as
secrets are blanked: by the name of their member, by the flag before them, or in `name=value`, `user:password@` and `Bearer` forms. A
value that holds what its reader gives a meaning to (a shell's `$` or `;`, a URL's `#`) is no plain secret and stays, so that a changed
command never hides in a blanked span. The kind of the entry is part of what is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.json_tree import leaves

BLANK = "<REDACTED>"
#: Names that announce a secret, at the end of a name of a member, flag or variable; our own list.
SECRET = r"(?:secret|token|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization)"
#: What a value may not hold if it is to be blanked: characters that a URL, or a shell, gives a meaning to. Fixed values.
LITERAL, SHELL = "#?\\", "$`();|&<>\\*?#[]{}"
#: How members are read: what is run by a shell, and patterns of commands; all else is data.
MODES = {"hook": r"^\$\.(?:command|args)\b", "server": r"^\$\.(?:command|args)\b", "permissions": r"^\$\.(?:allow|deny|ask)\b", "env": r"^\z"}


def _set(chars: str) -> str:
    """A class of all characters but these and blanks."""
    return "[^\\s" + "".join("\\" + c for c in chars) + "'\"]"


def viewed(leaf: Column, shell: Column) -> Column:
    """A leaf's value without its secrets."""
    value = leaf["value"]

    def blanked(chars: str) -> Column:
        bare = _set(chars)
        whole = value.rlike(f"^{bare}+$".replace("$", r"\z"))
        told = leaf["key"].rlike(f"(?i){SECRET}\\z") | leaf["before"].rlike(f"(?i)^--?[A-Za-z0-9_-]*{SECRET}\\z")
        inner = F.regexp_replace(value, f"(?i)({SECRET}=){bare}+", f"$1{BLANK}")
        inner = F.regexp_replace(inner, f"(://[A-Za-z0-9._-]*:){_set(chars + '@/')}+@", f"$1{BLANK}@")
        inner = F.regexp_replace(inner, f"(?i)\\b(bearer|basic) {bare}+", f"$1 {BLANK}")
        return F.when(F.coalesce(told, F.lit(False)) & whole, BLANK).otherwise(inner)

    return F.when(leaf["type"] == "string", F.when(shell, blanked(SHELL)).otherwise(blanked(LITERAL))).otherwise(value)


def content_hashes(entries: DataFrame) -> DataFrame:
    """entries (kind, json, scripts, ...) with hash, null where json is none.

    kind: a key of MODES. scripts: digests of the scripts that the entry names, in their order, or what says why one was not read.
    """
    known = entries.withColumn("_leaves", leaves("json"))
    pattern = F.element_at(F.create_map(*(F.lit(x) for mode in MODES.items() for x in mode)), F.col("kind"))
    line = lambda x: F.concat_ws("\x1f", x["path"], x["type"], F.coalesce(viewed(x, F.regexp_like(x["path"], pattern)), F.lit("")))
    lines = F.array_sort(F.transform("_leaves", line))
    scripts = F.transform(F.coalesce("scripts", F.array().cast("array<string>")), lambda s: F.concat(F.lit("script\x1f"), s))
    canon = F.array_join(F.concat(F.array("kind"), lines, scripts), "\n")
    return known.withColumn("hash", F.when(F.col("_leaves").isNotNull(), F.sha2(canon.cast("binary"), 256))).drop("_leaves")

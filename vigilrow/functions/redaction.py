"""Redaction where the place of a value tells that it is secret: argument lists, JSON members and endpoints.

What a flag or a member announces goes whole, blanks and quotes too, which patterns for a line of text would leave.
The rest of each value is read by scalar.redact().
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilrow.functions.scalar import redact

MARK = "[redacted]"
#: Names that announce a secret, of flags and members; our own list. A count, a limit or a file of them is none.
_SECRET = r"(?:[a-z0-9]+[_.-])*(?:password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|authorization)"
FLAG, USER_FLAG, MEMBER = rf"(?i)^--?{_SECRET}\z", r"^(?:-u|--user|--proxy-user)\z", rf"(?i)^{_SECRET}\z"
#: Words before a credential that are no part of it.
CARRIER = r"(?is)^\s*(bearer|basic|token)(\s+)\S.*\z"
#: Values that hold no secret of their own: references to variables and words of the language.
REFERENCE = r"(?i)^(?:\$\{?[A-Za-z_][A-Za-z0-9_]*\}?|true|false|null|none|)\z"


def _announced(value: Column) -> Column:
    """A value that its flag or member announces: all of it goes but a carrier word; references stay."""
    return F.when(value.isNull() | value.rlike(REFERENCE), value).when(value.rlike(CARRIER), F.regexp_replace(value, CARRIER, f"$1$2{MARK}")).otherwise(F.lit(MARK))


def _after(before: Column, value: Column) -> Column:
    """A value by the argument before it, which is null for the first."""
    user = before.rlike(USER_FLAG) & value.rlike("(?s)^[^:]+:.")
    told = F.when(before.rlike(FLAG), _announced(value)).when(user, F.concat(F.regexp_extract(value, "^[^:]+:", 0), F.lit(MARK)))
    return F.coalesce(told, redact(value))


def argv(c: str) -> Column:
    """An array of arguments without their secrets; a null argument stays."""
    args = F.col(c)
    return F.transform(args, lambda x, i: _after(F.when(i > 0, F.get(args, i - 1)), x))


def member(leaf: Column) -> Column:
    """The value of a leaf of json_tree.leaves() without secrets: by the name of its member, by the flag before it, or in itself."""
    value = leaf["value"]
    named = F.when(leaf["key"].rlike(MEMBER) & ~F.coalesce(leaf["before"].startswith("-"), F.lit(False)), _announced(value))
    return F.when(leaf["type"] == "string", F.coalesce(named, _after(leaf["before"], value))).otherwise(value)


def endpoint(c: str) -> Column:
    """An address without user, query values and fragment; scheme, host, port, path and the query's keys stay.

    The text is split at its delimiters, whether it is a valid URL or not; without a scheme it starts with its authority.
    """
    raw = F.col(c)
    near = F.regexp_extract(raw, r"^[^#?]*", 0)
    scheme = F.regexp_extract(near, r"^[A-Za-z][A-Za-z0-9+.-]*://", 0)
    rest = F.substring(near, F.length(scheme) + 1, F.length(near))
    authority = F.regexp_extract(rest, "^[^/]*", 0)
    host = F.regexp_replace(authority, "(?s)^.*@", MARK + "@")
    query = F.regexp_extract(raw, r"^[^#?]*(\?[^#]*)", 1)
    # of a part with a key its value, of one without all
    shown = F.regexp_replace(query, r"(?s)(?<=[?&])(?:([^=&]*=)[^&]+|[^=&]+)(?=&|\z)", f"$1{MARK}")
    fragment = F.regexp_replace(F.regexp_extract(raw, r"(?s)^[^#]*(#.*)", 1), "(?s)^#.+", "#" + MARK)
    return redact(F.concat(scheme, host, F.substring(rest, F.length(authority) + 1, F.length(rest)), shown, fragment))

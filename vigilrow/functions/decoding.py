"""Texts that hold other texts in an encoded form: base64, hex, percent and backslash escapes, also inside each other.

What is decoded is looked at again, up to DEPTH times and to a budget of bytes, so that work on a text is bounded whatever its author
nested in it; where the budget ends, a row says so. What does not decode to printable text is no payload.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of nesting and bytes of decoded text of one text.
DEPTH, BUDGET = 3, 1 << 20
#: The share of characters that are printable, and the least bytes, of a payload. Fixed values.
PRINTABLE, SHORTEST = 0.85, 6


def _base64(span: str) -> bytes:
    return base64.b64decode(span + "=" * (-len(span) % 4), validate=True)


def _escapes(span: str) -> bytes:
    return re.sub(r"\\x(..)|\\u00(..)", lambda m: chr(int(m[1] or m[2], 16)), span).encode("latin-1")


#: Kinds in the order in which they are tried, and their spans.
KINDS = (
    ("hex", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){24,}(?![0-9A-Za-z])"), bytes.fromhex),
    ("base64", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/_-])"), _base64),
    ("base64url", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9_-]{32,}={0,2}(?![A-Za-z0-9+/_-])"), lambda s: _base64(s.replace("-", "+").replace("_", "/"))),
    ("percent", re.compile(r"(?:%[0-9A-Fa-f]{2}){6,}"), lambda s: unquote_to_bytes(s)),
    ("escapes", re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}){6,}"), _escapes),
)


def _readable(content: bytes) -> str | None:
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if len(content) < SHORTEST or sum(c.isprintable() or c in "\n\t\r" for c in text) < PRINTABLE * len(text):
        return None
    return text


def payloads_of(text: str | None, depth: int = DEPTH, budget: int = BUDGET) -> Iterator[tuple[int, int, str, str | None]]:
    """(line, depth, kind, decoded text) of the payloads of a text, outer ones first, each text once; line is that of the outermost span.

    A last row of kind `stopped` says that there was more than the budget.
    """
    waiting, seen = deque([(text or "", None, 0)]), set()
    while waiting:
        held, outer, level = waiting.popleft()
        taken: list[tuple[int, int]] = []
        for kind, pattern, decode in KINDS:
            for m in pattern.finditer(held):
                if any(m.start() < b and a < m.end() for a, b in taken[-64:]):
                    continue
                try:
                    found = _readable(decode(m[0]))
                except (ValueError, binascii.Error):
                    continue
                if found is None:
                    continue
                taken.append(m.span())
                if found in seen:
                    continue
                seen.add(found)
                budget -= len(found.encode())
                line = outer or held.count("\n", 0, m.start()) + 1
                if budget < 0:
                    yield line, level + 1, "stopped", None
                    return
                yield line, level + 1, kind, found
                if level + 1 < depth:
                    waiting.append((found, line, level + 1))


FIELDS = [T.StructField("line", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType())]
#: What every payload holds at least: few texts need a look.
_ANY = r"[A-Za-z0-9+/_-]{32}|(?:%[0-9A-Fa-f]{2}){6}|(?:\\(?:x|u00)[0-9A-Fa-f]{2}){6}"


# row by row: a batch of Arrow holds up to 64 MB of texts, and several times that as Python's objects
_payloads = F.udf(lambda text: list(payloads_of(text)), T.ArrayType(T.StructType(FIELDS)), useArrow=False)


def payloads(texts: DataFrame) -> DataFrame:
    """The columns of texts but `text`, with line, depth, kind and payload, a row per payload."""
    keep = [c for c in texts.columns if c != "text"]
    near = texts.filter(F.col("text").rlike(_ANY))
    return near.select(*keep, F.inline(_payloads("text")))


def payload_units(units: DataFrame) -> DataFrame:
    """units (artifact, unit, role, file, text) for the rules: each payload as a script on the line of its span, which `outer` has."""
    found = payloads(units.filter("role <> 'doc'")).filter("kind <> 'stopped'")
    return found.withColumnsRenamed({"payload": "text", "line": "outer"}).withColumn("role", F.lit("script")).withColumn("file", F.concat("file", F.lit("#"), "depth"))

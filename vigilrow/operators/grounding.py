"""Quotes found again in the texts that they are said to come from, white space and invisible characters aside.

Every text is reduced to its visible characters and known by anchors: of each WINDOW strings of GRAM characters in a row the one of least hash. A
quote of LEAST characters or more holds such a window, so its own least string is an anchor of each text that holds the quote. Quotes and
texts are joined by artifact and anchor, never by artifact alone, and what meets is compared in full, one row a text with its quotes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.scalar import INVISIBLE

#: A quote shorter than this counts only if it is a whole text. A fixed value.
LEAST = 16
GRAM, WINDOW = 8, LEAST - 8 + 1
_BLANK = " \t\n\x0b\x0c\r"
_GONE = {ord(c): None for c in _BLANK} | {c: None for c in map(ord, INVISIBLE)}


def reduced(text: str | None) -> str:
    """The visible characters of a text."""
    return (text or "").translate(_GONE)


def _hashes(text: str) -> np.ndarray:
    """A hash of each string of GRAM characters."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x) - GRAM + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        h = (h ^ x[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.astype(np.int64)


def anchors(text: str) -> np.ndarray:
    """The anchors of a reduced text; one of fewer than LEAST characters has a single one of its own."""
    if len(text) < LEAST:
        return np.array([hash_of(text)], np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(_hashes(text), WINDOW).min(axis=1))


def hash_of(text: str) -> int:
    """The anchor of a quote."""
    if len(text) >= LEAST:
        return int(_hashes(text).min())
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _lines(text: str) -> np.ndarray:
    """The line, from 1, of each visible character."""
    parts = text.split("\n")
    return np.repeat(np.arange(1, len(parts) + 1), [len(reduced(p)) for p in parts])


def _needles_of(quote: str | None) -> list[tuple[int, str, int]]:
    parts = [quote or ""]
    parts += parts[0].split("\n") if "\n" in parts[0] else []
    return [(k, n, hash_of(n)) for k, n in enumerate(map(reduced, parts)) if n]


def _places_of(text: str | None, sought: list) -> list[tuple]:
    """(item, part, line) of the needles that a text holds."""
    hay, lines, out = reduced(text), None, []
    for n in sought:
        at = hay.find(n["needle"]) if len(n["needle"]) >= LEAST else 0 if hay == n["needle"] else -1
        if at >= 0:
            lines = _lines(text or "") if lines is None else lines
            out.append((n["item"], n["part"], int(lines[at])))
    return out


def _row_by_row(f: Callable, kind: str):
    """f as a function of rows: a batch of Arrow holds up to 64 MB of texts, and several times that as Python's objects."""
    return F.udf(f, kind, useArrow=False)


def needles(quotes: DataFrame) -> DataFrame:
    """item, artifact, part, needle (reduced) and anchor: a quote as a whole (part 0), then its lines."""
    found = _row_by_row(_needles_of, "array<struct<part: int, needle: string, anchor: bigint>>")
    return quotes.select("item", "artifact", F.inline(found("quote")))


def ground(quotes: DataFrame, units: DataFrame) -> DataFrame:
    """item, unit, line, part and grounded of quotes (item, artifact, quote): the first unit (artifact, unit, text) of the quote's artifact that holds it.

    The whole quote comes before its lines, and units come in their order. line: where the quote begins.
    """
    wanted = needles(quotes)
    own = units.join(quotes.select("artifact").distinct(), "artifact", "left_semi")
    index = _row_by_row(lambda text: anchors(reduced(text)).tolist(), "array<bigint>")
    indexed = own.select("artifact", "unit", F.explode(index("text")).alias("anchor"))
    met = indexed.join(wanted, ["artifact", "anchor"]).groupBy("artifact", "unit").agg(F.collect_set(F.struct("item", "part", "needle")).alias("needles"))
    item = quotes.schema["item"].dataType.simpleString()
    check = _row_by_row(_places_of, f"array<struct<item: {item}, part: int, line: int>>")
    checked = own.select("artifact", "unit", "text").join(met, ["artifact", "unit"]).select("unit", F.inline(check("text", "needles")))
    first = checked.groupBy("item").agg(F.min(F.struct("part", "unit", "line")).alias("f"))
    return quotes.join(first, "item", "left").select("item", "f.unit", "f.line", "f.part", F.col("f").isNotNull().alias("grounded"))


def barrier(replies: DataFrame, units: DataFrame) -> DataFrame:
    """artifact, unit, line, item and the rule of contents that addressed who examined them: one finding a place, of the first pass.

    replies: item, artifact, place (the order of passes), quote. A quote that is found nowhere makes no finding.
    """
    found = ground(replies, units).filter("grounded").join(replies.select("item", "artifact", "place"), "item")
    first = found.groupBy("artifact", "unit", "line").agg(F.min(F.struct("place", "item")).alias("f"))
    return first.select("artifact", "unit", "line", "f.item", F.lit("LLM-007").alias("rule"), F.lit(1).alias("dimension"), F.lit("high").alias("severity"), F.lit(True).alias("advisory"))

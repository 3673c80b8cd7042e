"""JSON as its leaves: one small struct for each value that holds no others, with the path to it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = ("path", "type", "value", "key", "before")


class _Number(str):
    """A number as it is written."""


def _step(path: str, key: str) -> str:
    plain = key.isascii() and key.replace("_", "a").isalnum()
    return f"{path}.{key}" if plain else f"{path}.{json.dumps(key, ensure_ascii=False)}"


def _walk(value, path: str, key: str | None, before: str | None, out: list) -> None:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            _walk(v, _step(path, k), k, None, out)
    elif isinstance(value, list) and value:
        last = None
        for i, v in enumerate(value):
            _walk(v, f"{path}[{i}]", key, last, out)
            last = v if type(v) is str else None
    else:
        kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "number" if isinstance(value, _Number) else "string" if isinstance(value, str) else "null" if value is None else "boolean"
        text = str(value).lower() if kind == "boolean" else str(value) if kind in ("string", "number") else None
        out.append((path, kind, text, key, before))


def leaves_of(text: str | None) -> list | None:
    """The leaves of a JSON text in its order; None if it is none. key: the name of the nearest member; before: the string that stands before it in its array."""
    if text is None:
        return None
    out: list = []
    try:
        _walk(json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number), "$", None, None, out)
    except (ValueError, RecursionError):
        return None
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in LEAF])))
def leaves(texts: pd.Series) -> pd.Series:
    return pd.Series([None if (found := leaves_of(t)) is None else [dict(zip(LEAF, x)) for x in found] for t in texts], dtype=object)

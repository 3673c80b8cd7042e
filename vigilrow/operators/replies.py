"""Replies of models read as votes, notes and labels. No call is made here.

A reply is free text around one JSON object. It is read as far as it gives one answer and no further: an object
that was closed before its members ended is mended when that leaves one object whose members are all named
once; text that could hold a second answer makes the reply unreadable, never half read. An unreadable reply is
a vote that was not cast, so that it is missing from a consensus and counted by notes().
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilrow.functions import scalar

#: Members of a verdict. Fixed names.
TEXTS = ("category", "severity", "summary", "evidence", "barrier_evidence")
FLAGS = ("flagged", "disclosed")
MEMBERS = {"status": T.StringType(), "mended": T.BooleanType(), **dict.fromkeys(FLAGS, T.BooleanType()), **dict.fromkeys(TEXTS, T.StringType())}
LABEL = ("rule_id", "label", "reason")

_BLANK = " \t\r\n"
_FENCE = "```"
#: Bytes of a reason that are kept.
REASON = 256


class _Members(list):
    """The (name, value) pairs of an object, in their order."""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_Members, parse_constant=_refuse)


def _outermost(text: str) -> _Members:
    """The object from the first opening brace to the last closing one."""
    at, end = text.find("{"), text.rfind("}")
    if not 0 <= at < end:
        raise ValueError("no object")
    found, stop = _DECODER.raw_decode(text[at : end + 1])
    if stop != end + 1 - at:
        raise ValueError("more than one object")
    return found


def _mended(text: str) -> _Members | None:
    """The object that a brace in its middle closed too early; None where none was, an error where it is not one object."""
    at = text.find("{")
    try:
        _, stop = _DECODER.raw_decode(text, at) if at >= 0 else (None, 0)
    except ValueError:
        return None
    if not text[stop:].lstrip(_BLANK).startswith(",") or at < 0:
        return None
    joined = text[at : stop - 1] + text[stop:]
    found, end = _DECODER.raw_decode(joined)
    names = [k.casefold() for k, _ in found]
    if joined[end:].strip(_BLANK) not in ("", _FENCE) or len(set(names)) < len(names):
        raise ValueError("more than one answer")
    return found


def _fields(found: _Members, names: dict[str, type]) -> dict:
    """The named members, whatever their case; of repeated ones the last. A null leaves a member unset."""
    out = {k: kind() for k, kind in names.items()}
    for k, v in found:
        kind = names.get(k.casefold())
        if kind is None or v is None:
            continue
        if type(v) is not kind:
            raise ValueError(f"{k} has another type")
        out[k.casefold()] = v
    return out


def verdict_of(text: str | None) -> dict:
    """status (read or unreadable), mended and the members; those of an unreadable reply are null."""
    names = {k: bool for k in FLAGS} | {k: str for k in TEXTS}
    try:
        found = _mended(text or "")
        mended = found is not None
        return {"status": "read", "mended": mended, **_fields(found if mended else _outermost(text or ""), names)}
    except (ValueError, RecursionError):
        return {"status": "unreadable", "mended": False, **dict.fromkeys(names)}


def labels_of(text: str | None) -> list[dict]:
    """The labels that a reply lists; none where it cannot be read."""
    try:
        rows = _fields(_outermost(text or ""), {"labels": list})["labels"]
        if not all(isinstance(x, _Members) for x in rows if x is not None):
            raise ValueError("a label is no object")
        return [_fields(x or _Members(), dict.fromkeys(LABEL, str)) for x in rows]
    except (ValueError, RecursionError):
        return []


# row by row: a batch of Arrow holds up to 64 MB of replies, and several times that as Python's objects
_verdicts = F.udf(verdict_of, T.StructType([T.StructField(k, v) for k, v in MEMBERS.items()]), useArrow=False)
_labels = F.udf(labels_of, T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in LABEL])), useArrow=False)


def votes(replies: DataFrame) -> DataFrame:
    """replies (item, pass, sample, reply; a null reply was not answered) to the votes of judge.consensus().

    Also returned: pass, status (read, unreadable, missing), mended and the barrier's quote.
    """
    v = replies.withColumn("v", _verdicts("reply"))
    status = F.when(F.col("reply").isNull(), "missing").otherwise(F.col("v.status"))
    return v.select(
        "item",
        "pass",
        "sample",
        status.alias("status"),
        F.col("v.mended").alias("mended"),
        (status == "read").alias("answered"),
        F.coalesce(F.col("v.flagged"), F.lit(False)).alias("flagged"),
        F.coalesce(F.col("v.disclosed"), F.lit(False)).alias("disclosed"),
        F.lower(F.trim("v.severity")).alias("severity"),
        F.col("v.category").alias("category"),
        F.col("v.evidence").alias("text"),
        F.col("v.barrier_evidence").alias("barrier_quote"),
    )


def notes(cast: DataFrame) -> DataFrame:
    """votes() with grounded to notes (rule, pass, n, of): calls that gave no answer, and flags whose quote was not found.

    Notes take nothing from a score; a pass with nothing to note has no row.
    """
    per = cast.groupBy("pass").agg(
        F.count("*").alias("all"),
        F.count_if(~F.col("answered")).alias("lost"),
        F.count_if(F.col("answered") & F.col("flagged")).alias("flags"),
        F.count_if(F.col("answered") & F.col("flagged") & ~F.coalesce("grounded", F.lit(False))).alias("loose"),
    )
    both = F.array(
        F.struct(F.lit("LLM-000").alias("rule"), F.col("lost").alias("n"), F.col("all").alias("of")),
        F.struct(F.lit("LLM-005").alias("rule"), F.col("loose").alias("n"), F.col("flags").alias("of")),
    )
    return per.select("pass", F.inline(both)).filter("n > 0").select("rule", "pass", "n", "of")


def label(said: Column) -> Column:
    """likely-benign where that is the first word and likely-real is none of the others; else likely-real, the safe side."""
    words = F.regexp_extract_all(F.lower(said), F.lit("[a-z0-9-]+"), F.lit(0))
    benign = (F.get(words, F.lit(0)) == "likely-benign") & ~F.array_contains(words, "likely-real")
    return F.when(F.coalesce(benign, F.lit(False)), "likely-benign").otherwise("likely-real")


def triage(replies: DataFrame, findings: DataFrame) -> DataFrame:
    """One label for each (artifact, rule) of findings that a reply to the artifact names, byte for byte.

    replies: artifact, reply. likely-real beats likely-benign where replies differ; the reason is the least of
    the label's, redacted and clipped. Labels are shown and change no finding.
    """
    said = replies.select("artifact", F.explode(_labels("reply")).alias("l")).select("artifact", F.col("l.rule_id").alias("rule"), label(F.col("l.label")).alias("label"), F.col("l.reason").alias("raw"))
    said = said.groupBy("artifact", "rule", "label").agg(F.min("raw").alias("raw"))
    said = said.groupBy("artifact", "rule").agg(F.max(F.struct("label", "raw")).alias("best")).select("artifact", "rule", "best.*")
    known = said.join(findings.select("artifact", "rule").distinct(), ["artifact", "rule"], "left_semi")
    return known.withColumn("shown", scalar.redact("raw")).select("artifact", "rule", "label", scalar.clip_bytes("shown", REASON).alias("reason"))

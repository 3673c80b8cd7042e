"""Redaction and entropy of whole documents."""

import math
import random
import re
from collections import Counter

import pytest
from rows import DATA, same_rows

from vigilrow.functions import scalar
from vigilrow.operators import digests
from vigilrow.plans import queries as engine

STEPS = (
    (r"(?i)\b([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", r"\1[redacted]@"),
    (r"(?<!\S)(-u|--user)([ =])([^\s:]+):\S+", r"\1\2\3:[redacted]"),
    (r"(?i)(--(?:password|token|secret|api-key))([ =])(?!\[redacted\])\S+", r"\1\2[redacted]"),
    (r"(?i)\b([a-z0-9_-]*(?:password|passwd|secret|token|api[_-]?key)[a-z0-9_-]*)(\s*[=:]\s*)(['\"]?)(?!\[redacted\]|true\b|false\b|null\b|none\b|bearer\b)[^\s'\",;]{4,}", r"\1\2\3[redacted]"),
    (r"\b(?:ghp_|gho_|sk-|xox[abp]-|AKIA)[A-Za-z0-9_-]{12,}", "[redacted]"),
)


def bits(text: str) -> float:
    return -sum(k / len(text) * math.log2(k / len(text)) for k in Counter(text).values())


def opaque(m: re.Match) -> str:
    token = m[0].rstrip("=")
    return "[redacted]" if re.search("[A-Za-z]", token) and re.search("[0-9]", token) and bits(token) >= 3.6 else m[0]


def brute_redact(text: str) -> str:
    for pattern, by in STEPS:
        text = re.sub(pattern, by, text, flags=re.ASCII)
    return re.sub("[A-Za-z0-9+/_-]{24,}={0,2}", opaque, text)


def test_redaction_of_documents(spark):
    """At sf0.01: the smallest tables hold no secrets."""
    sf = DATA.replace("0.001", "0.01")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = engine.QUERIES["document_redaction"](spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        d = docs[r.doc_id].asDict()
        assert r.asDict() == {**d, "text": d["text"] and brute_redact(d["text"])}
    assert any(r.text != docs[r.doc_id].text for r in found)


def test_redaction_with_secrets(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    found = dict(map(tuple, engine.QUERIES["redaction"](spark, DATA).collect()))
    assert found == {k: brute_redact(f"{t or ''}\n{engine.SECRETS[k % len(engine.SECRETS)]}") for k, t in docs.items()}
    assert sum("[redacted]" in t for t in found.values()) > len(docs) / 2


def test_redaction_entropy(spark):
    rng = random.Random(1)
    secret = "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789+/", k=40)) + "7a"
    texts = [f"x {secret}== y\n{secret},{secret[:20]}", "averylongidentifierwithoutdigits_at_all", "1" * 40 + "a", f"MY_THING={secret}=", "", None, "é" * 30 + f" {secret} é"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", scalar.redact("text").alias("text"))
    found = dict(map(tuple, df.collect()))
    assert found == {k: t and brute_redact(t) for k, t in enumerate(texts)}
    assert found[0] == f"x [redacted] y\n[redacted],{secret[:20]}" and found[3] == "MY_THING=[redacted]"


def test_entropy_of_whole_texts(spark, duck):
    same_rows(engine.QUERIES["document_entropy"](spark, DATA), duck, engine.ORACLE_SQL["document_entropy"])
    rows = [(1, "a" * 60 + "bcd" * 40), (2, "a" * 70), (3, ""), (4, None)]
    found = dict(map(tuple, digests.entropies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == {1: pytest.approx(bits(rows[0][1]), abs=1e-6), 2: 0.0}

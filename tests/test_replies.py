"""Replies as verdicts, votes, notes and labels."""

import json

import pytest

from vigilrow.operators import judge, replies

FULL = {"flagged": True, "disclosed": False, "category": "c1", "severity": "high", "summary": "s", "evidence": 'a "{b}" ```', "barrier_evidence": ""}
PLAIN = json.dumps(FULL)


@pytest.mark.parametrize("around", ["{}", "Sure:\n```json\n{}\n```", "  {}\n", "well {} done."])
def test_text_around_an_object(around):
    got = replies.verdict_of(around.replace("{}", PLAIN))
    assert got == {"status": "read", "mended": False, **FULL}


@pytest.mark.parametrize("tail", ["", "\n```", " \n"])
def test_an_object_closed_early_is_mended(tail):
    head, rest = PLAIN.split(', "barrier_evidence"')
    got = replies.verdict_of("Answer: " + head + '}, "barrier_evidence"' + rest + tail)
    assert got == {"status": "read", "mended": True, **FULL}


@pytest.mark.parametrize(
    "text",
    [
        None, "", "no object", "}{", "{", '{"flagged": true', '{"flagged": "yes"}', '{"flagged": NaN}', "[1]",
        '{"flagged": false}, "flagged": true}', '{"flagged": false}, "Flagged": true}', '{"flagged": false}, {"flagged": true}',
        '{"flagged": false}, "severity": "low"} and more', '{"flagged": false}, more', '{"flagged": false} {"flagged": true}',
        '{"flagged": false} or }', '{"evidence": ' + "[" * 100_000 + "}",
    ],
)
def test_what_could_be_two_answers_is_unreadable(text):
    got = replies.verdict_of(text)
    assert got["status"] == "unreadable" and got["flagged"] is None


def test_members_by_name():
    got = replies.verdict_of('{"FLAGGED": true, "flagged": false, "other": [1, {"flagged": true}], "severity": null}')
    assert (got["status"], got["flagged"], got["severity"]) == ("read", False, "")


def test_votes_and_notes(spark):
    rows = [
        (1, "LLM-001", 1, PLAIN), (1, "LLM-001", 2, PLAIN.replace("true", "false")), (1, "LLM-001", 3, PLAIN.replace('"high"', '" Low "')),
        (2, "LLM-001", 1, None), (2, "LLM-001", 2, "cannot say"), (3, "LLM-003", 1, PLAIN.replace("true", "false")),
    ]
    cast = replies.votes(spark.createDataFrame(rows, 'item int, pass string, sample int, reply string'))
    assert sorted((r.item, r.sample, r.status, r.answered, r.flagged) for r in cast.collect()) == [
        (1, 1, "read", True, True), (1, 2, "read", True, False), (1, 3, "read", True, True), (2, 1, "missing", False, False), (2, 2, "unreadable", False, False), (3, 1, "read", True, False),
    ]
    by = {r.item: r for r in judge.consensus(cast).collect()}
    assert (by[1].n, by[1].k, by[1].escalates, by[1].severity_rank) == (3, 2, True, 1) and by[2].n == 0 and not by[2].escalates
    noted = replies.notes(cast.selectExpr("*", "sample = 1 as grounded"))
    assert sorted(map(tuple, noted.collect())) == [("LLM-000", "LLM-001", 2, 5), ("LLM-005", "LLM-001", 1, 2)]


def test_labels(spark):
    said = [
        ("likely-benign", "likely-benign"), ("LIKELY-BENIGN (doc)", "likely-benign"), ("not likely-benign", "likely-real"), ("likely-benign or likely-real", "likely-real"),
        ("benign", "likely-real"), ("", "likely-real"), ("likely-benignant", "likely-real"),
    ]
    rows = [(f"a{k}", json.dumps({"labels": [{"rule_id": "R-1", "label": x, "reason": "password=hunter22 " + "é" * 200}, {"rule_id": "R-2"}, {"rule_id": "r-1", "label": x}, None]})) for k, (x, _) in enumerate(said)]
    rows += [("b", '{"labels": [{"rule_id": "R-1", "label": "likely-benign"}]}'), ("b", '{"labels": [{"rule_id": "R-1", "label": "likely-real"}]}'), ("c", '{"labels": [3]}'), ("c", None), ("c", "{}")]
    found = [(a, r) for a in {a for a, _ in rows} for r in ("R-1", "R-1", "R-3")]
    got = {(r.artifact, r.rule): r for r in replies.triage(spark.createDataFrame(rows, "artifact string, reply string"), spark.createDataFrame(found, "artifact string, rule string")).collect()}
    assert {k: r.label for k, r in got.items()} == {(f"a{k}", "R-1"): want for k, (_, want) in enumerate(said)} | {("b", "R-1"): "likely-real"}
    reason = got["a0", "R-1"].reason
    assert "hunter22" not in reason and len(reason.encode()) <= replies.REASON + 3 and reason.endswith("…")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "artifact string, reply string, item int, pass string, sample int, rule string")
    assert replies.triage(none, none).count() == 0 and replies.notes(replies.votes(none).selectExpr("*", "true as grounded")).count() == 0

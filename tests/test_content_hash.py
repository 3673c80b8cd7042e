"""Content hashes: what changes them and what must not; leaves of JSON."""

import json
import random

from vigilrow.functions.json_tree import leaves_of
from vigilrow.operators import content_hash


def hashes(spark, rows: list[tuple]) -> list:
    """rows: (kind, json or value, scripts)."""
    data = [(k, kind, v if isinstance(v, str) or v is None else json.dumps(v), list(s) if s else None) for k, (kind, v, *s) in enumerate(rows)]
    df = spark.createDataFrame(data, "n int, kind string, json string, scripts array<string>")
    return [r.hash for r in sorted(content_hash.content_hashes(df).collect(), key=lambda r: r.n)]


def test_same_and_different(spark):
    server = {"command": "node", "args": ["a.js", "--token", "one", "-v"], "env": {"X_TOKEN": "one", "MODE": "a"}, "url": "https://u:one@h/x"}
    turned = {k: server[k] for k in reversed(server)}
    secrets = json.loads(json.dumps(server).replace("one", "two"))
    same = [("server", server), ("server", turned), ("server", secrets)]
    change = lambda **more: ("server", {**server, **more})
    other = [
        change(command="deno"), change(args=["--token", "one", "a.js", "-v"]), change(args=["a.js", "--token", "$(curl x)", "-v"]), change(args=["a.js", "--token", "a;b", "-v"]),
        change(env={"X_TOKEN": "one", "MODE": "b"}), change(env={"X_TOKEN": "one"}), change(url="https://u:o#e@h/x"), change(url="https://u:one@g/x"), change(args="a.js --token one -v"), ("hook", server),
    ]
    got = hashes(spark, same + other)
    assert len(set(got[:3])) == 1 and None not in got
    assert len({got[0], *got[3:]}) == 1 + len(other)


def test_kinds(spark):
    grant = lambda p: ("permissions", {"allow": [p]})
    env = lambda **v: ("env", v)
    pairs = [  # entry, entry, whether they are the same
        (grant("Bash(x --password=a *)"), grant("Bash(x --password=b *)"), True),
        (grant("Bash(x --password=a *)"), grant("Bash(x --password=*)"), False),
        (grant("Bash(x)"), ("permissions", {"deny": ["Bash(x)"]}), False),
        (env(API_KEY="a$b"), env(API_KEY="c$d"), True),
        (env(API_KEY="a#b"), env(API_KEY="c#d"), False),
        (env(NAME="a"), env(NAME="b"), False),
        (env(H="Bearer abc"), env(H="Bearer def"), True),
        (env(A={}), env(A=[]), False),
        (env(A=None), env(A="null"), False),
        (env(A=1), ("env", '{"A": 1.0}'), False),
        (env(A="x", B="y"), ("env", '{ "B":"y",\n "A" : "x"}'), True),
        (env(**{"a.b": "x"}), env(a={"b": "x"}), False),
        (("hook", {"command": "x"}, "aa"), ("hook", {"command": "x"}, "bb"), False),
        (("hook", {"command": "x"}, "aa", "bb"), ("hook", {"command": "x"}, "bb", "aa"), False),
    ]
    got = hashes(spark, [e for a, b, _ in pairs for e in (a, b)])
    assert [got[2 * k] == got[2 * k + 1] for k in range(len(pairs))] == [same for *_, same in pairs]


def test_what_is_no_json(spark):
    got = hashes(spark, [("env", "{"), ("env", None), ("env", "[" * 100_000), ("env", '"x"'), ("env", "")])
    assert got[:3] == [None] * 3 and got[3] and got[4] is None


def rebuilt(found: list):
    """Values by path, as json.loads gives them but for numbers, which stay as they are written."""
    return {path: (kind, value) for path, kind, value, *_ in found}


def test_leaves():
    found = leaves_of('{"a": [1, 2.50, "x", ["y"]], "b c": {"d": true, "e": null}, "f": {}, "g": []}')
    assert found == [
        ("$.a[0]", "number", "1", "a", None), ("$.a[1]", "number", "2.50", "a", None), ("$.a[2]", "string", "x", "a", None), ("$.a[3][0]", "string", "y", "a", None),
        ('$."b c".d', "boolean", "true", "d", None), ('$."b c".e', "null", None, "e", None), ("$.f", "object", None, "f", None), ("$.g", "array", None, "g", None),
    ]
    assert leaves_of('["--token", "x"]')[1] == ("$[1]", "string", "x", None, "--token")
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        return [rng.choice("xyz"), rng.randrange(9), None, True][kind] if kind < 4 else [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else {rng.choice("ab. \"'[é"): value(depth - 1) for _ in range(rng.randrange(4))}

    seen = {}
    for _ in range(3000):
        v = json.dumps(value(3), sort_keys=True)
        leaves = leaves_of(v)
        assert len({x[0] for x in leaves}) == len(leaves)
        assert seen.setdefault(str(sorted(rebuilt(leaves).items())), v) == v

"""Payloads: nested encodings, budgets, what is none; table functions against the DataFrame versions."""

import base64
import random
from urllib.parse import quote

from pyspark.sql import functions as F

from vigilrow.functions import decoding, table_functions
from vigilrow.functions.decoding import payloads_of
from vigilrow.operators import structural

ENCODERS = {
    "base64": lambda b: base64.b64encode(b).decode(),
    "base64url": lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="),
    "hex": lambda b: b.hex(),
    "percent": lambda b: "".join(f"%{x:02X}" for x in b),
    "escapes": lambda b: "".join(f"\\x{x:02x}" for x in b),
}


def test_nested():
    rng = random.Random(1)
    for _ in range(300):
        plain = "".join(rng.choice("rm -rf ~é;|\n") for _ in range(rng.randrange(40, 90))) + "?>"
        kinds, held, steps = [rng.choice(list(ENCODERS)) for _ in range(rng.randrange(1, 4))], plain, []
        for kind in kinds:
            steps.append((kind, held))
            held = ENCODERS[kind](held.encode())
        text = "a\nb\n" + f"x = '{held}' # end\nlast"
        got = list(payloads_of(text))
        assert [(line, d) for line, d, *_ in got] == [(3, k + 1) for k in range(len(kinds))]
        assert [p for *_, p in got] == [p for _, p in reversed(steps)]


def test_bounds():
    inner = "rm -rf ~ " * 8
    four = inner
    for _ in range(4):
        four = ENCODERS["base64"](four.encode())
    assert [d for _, d, *_ in payloads_of(four)] == [1, 2, 3]
    many = "\n".join(ENCODERS["base64"](f"{k} a text that is long enough to count".encode()) for k in range(100))
    got = list(payloads_of(many, budget=1000))
    assert got[-1][2] == "stopped" and 10 < len(got) < 40 and sum(len(p) for *_, p in got[:-1]) <= 1000
    assert len(list(payloads_of(many))) == 100
    assert [p for *_, p in payloads_of(many.split("\n")[0] + " " + many.split("\n")[0])] == ["0 a text that is long enough to count"]


def test_what_is_none():
    for text in (None, "", "plain words " * 20, "a" * 31, bytes(range(200, 250)).hex(), quote("a b")[:5], "f" * 64, "\\x41" * 3, "A" * 33):
        assert [p for *_, p in payloads_of(text)] == [], text


def test_data_frames_and_sql(spark):
    hidden = ENCODERS["base64"](ENCODERS["hex"](b"rm -rf ~ and more than that").encode())
    df = spark.createDataFrame([(1, f"one\n'{hidden}'"), (2, "nothing"), (3, None)], "unit int, text string")
    got = sorted(map(tuple, decoding.payloads(df).collect()))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, 2, 1, "base64"), (1, 2, 2, "hex")]
    table_functions.register(spark)
    lateral = spark.sql("select d.unit, p.* from {d} d, lateral decoded_payloads(d.text) p", d=df)
    assert sorted(map(tuple, lateral.collect())) == got


def test_blank_runs(spark):
    texts = ["a" + "\n" * n + "b" + "\n \n" * m + "c" for n, m in [(0, 0), (200, 0), (201, 0), (250, 150), (202, 101), (300, 400)]] + ["\n" * 500, "\n" * 300 + "x"]
    units = spark.createDataFrame([("a", k, "script", "f", t) for k, t in enumerate(texts)], "artifact string, unit long, role string, file string, text string")
    lines = structural.physical_lines(units)
    want = sorted(map(tuple, structural.blank_runs(lines).collect()))
    table_functions.register(spark)
    got = spark.sql("select * from blank_runs(table({lines}) partition by unit order by line)", lines=lines.select("unit", "line", "raw"))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 5
    assert got.filter(F.col("length") < 200).count() == 0

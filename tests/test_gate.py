"""The gate on a stream of files, with late and repeated events, against the gate on the table of all events."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vigilrow.streaming import gate

FIELDS = "uid long, name string, tool string, id string, hash string, worst int, mode string, succeeded boolean, at timestamp"


def event(uid, name, call, hash, second, worst=3, mode="default", tool="Skill", succeeded=True):
    return {"uid": uid, "name": name, "tool": tool, "id": call, "hash": hash, "worst": worst, "mode": mode, "succeeded": succeeded, "at": f"2024-01-0{1 + second // 86400} {second % 86400 // 3600:02}:{second % 3600 // 60:02}:{second % 60:02}"}


def of_table(spark, events):
    rows = [json.dumps(e) for e in events]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", FIELDS, {"timestampFormat": "yyyy-MM-dd HH:mm:ss"}).alias("e")).select("e.*")
    return sorted((r.uid, r.hash, r.decision) for r in gate.gate(df).collect())


def of_stream(spark, tmp_path, batches):
    """One file a batch, in order, each a micro-batch; a last event far ahead moves the watermark behind all others."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    flush = [[event(10**6 + k, "PreToolUse", f"flush{k}", "flush", 86400 * 5 + 86400 * k)] for k in range(2)]
    for k, batch in enumerate([*batches, *flush]):
        (source / f"{k:03}.json").write_text("\n".join(map(json.dumps, batch)))
        import os

        os.utime(source / f"{k:03}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(str(source))
        q = gate.gate(events).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted((r.uid, r.hash, r.decision) for r in spark.read.parquet(str(out)).collect() if r.uid < 10**6)


CASES = [
    event(1, "PreToolUse", "a", "h1", 0),
    event(2, "PostToolUse", "a", "h1", 3600),  # just in time
    event(3, "PreToolUse", "b", "h1", 4000),  # accepted before
    event(4, "PreToolUse", "c", "h2", 100),
    event(5, "PostToolUse", "c", "h2", 3701),  # a second too late
    event(6, "PreToolUse", "d", "h3", 200),
    event(7, "PostToolUse", "d", "h4", 300),  # other bytes; the ask is used up
    event(8, "PostToolUse", "d", "h3", 400),
    event(9, "PreToolUse", "e", "h5", 500, worst=1),
    event(10, "PreToolUse", "f", "h5", 600, worst=1),
    event(11, "PreToolUse", "g", "h6", 700, worst=2),
    event(12, "PreToolUse", "h", "h6", 800, worst=2),
    event(13, "PreToolUse", "i", "h7", 900, mode="auto"),
    event(14, "PostToolUse", "i", "h7", 950),
    event(15, "PreToolUse", "j", "h8", 1000, tool="Bash"),
    event(16, "SessionStart", "k", "h8", 1000),
    event(17, "PreToolUse", "l", "h9", 1100),
    event(18, "PostToolUse", "l", "h9", 1200, succeeded=False),
    event(19, "PreToolUse", "m", None, 1300, worst=0),
    event(20, "PreToolUse", "n", None, 1400),
]
EXPECTED = {1: "ask", 2: "accepted", 3: "allow", 4: "ask", 6: "ask", 7: "changed", 9: "remembered", 10: "allow", 11: "noted", 12: "noted", 13: "deny", 17: "ask", 19: "noted", 20: "ask"}


def test_table(spark):
    got = of_table(spark, CASES + CASES[:6])
    assert {u: d for u, _, d in got} == EXPECTED and len(got) == len(EXPECTED)
    assert of_table(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_table(spark, tmp_path, seed):
    """Events come up to eight minutes late, and some again in a later batch."""
    rng, events = random.Random(seed), list(CASES)
    for k in range(40):
        at, h = rng.randrange(0, 9000), f"r{rng.randrange(6)}"
        events.append(event(100 + 2 * k, "PreToolUse", f"r{k % 30}", h, at, worst=rng.choice([0, 2, 3, 3, 3]), mode=rng.choice(["default", "default", "auto"])))
        events.append(event(101 + 2 * k, "PostToolUse", f"r{k % 30}", rng.choice([h, h, "x"]), at + rng.choice([10, 900, 3500, 3700])))
    late = sorted(events, key=lambda e: (e["at"], e["uid"]))
    second = lambda e: int(e["at"][11:13]) * 3600 + int(e["at"][14:16]) * 60 + int(e["at"][17:])
    late.sort(key=lambda e: second(e) + rng.randrange(480))
    size = -(-len(late) // 4)
    batches = [late[k : k + size] for k in range(0, len(late), size)]
    for k in range(len(batches) - 1):
        newest = max(map(second, batches[k]))
        batches[k + 1] = batches[k + 1] + [e for e in batches[k] if second(e) > newest - 500][:5]
    assert of_stream(spark, tmp_path, batches) == of_table(spark, events)

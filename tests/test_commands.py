"""Scripts that hooks and grants name: where they are found, what is scanned of them and what is not."""

import contextlib
import io

from pyspark.sql import functions as F

from vigilrow.operators import commands, rules

HOME, CONFIG, PLUG = "/home/u", "/home/u/.agent", "/home/u/.agent/plug"
FILES = {
    f"{HOME}/.agent/hooks/a.sh": "rm -rf ~", f"{CONFIG}/b.py": "eval(x)", f"{HOME}/b.py": "pass", f"{PLUG}/lib/run.js": "x", f"{PLUG}/run.js": "y", "/opt/o.sh": "rm -rf ~", f"{HOME}/.ssh/k.sh": "k", f"{HOME}/a (1).sh": "z",
}


def led(spark, command, owner=None, event="PreToolUse"):
    items = spark.createDataFrame([(1, 7, event, "command", command, None, HOME, CONFIG, owner)], "root int, item int, event string, type string, command string, url string, home string, config string, owner string")
    files = spark.createDataFrame([(1, p, t) for p, t in FILES.items()], "root int, path string, text string")
    return items, commands.follow(items, files), files


def states(spark, command, owner=None):
    return sorted((r.ref, r.path, r.state) for r in led(spark, command, owner)[1].collect())


def test_candidates(spark):
    assert states(spark, "sh hooks/a.sh | tee x.log") == [("hooks/a.sh", f"{CONFIG}/hooks/a.sh", "followed")]
    assert states(spark, "python b.py&&python b.py") == [("b.py", f"{HOME}/b.py", "followed")]  # home comes before the config folder
    assert states(spark, 'sh "~/a (1).sh" $HOME/.agent/hooks/a.sh') == [("$HOME/.agent/hooks/a.sh", f"{CONFIG}/hooks/a.sh", "followed"), ("~/a (1).sh", f"{HOME}/a (1).sh", "followed")]
    assert states(spark, "sh /opt/o.sh ../../opt/o.sh") == [("../../opt/o.sh", "/opt/o.sh", "outside"), ("/opt/o.sh", "/opt/o.sh", "outside")]
    assert states(spark, "Bash(./.ssh/k.sh *)") == [("./.ssh/k.sh", f"{HOME}/.ssh/k.sh", "credential")]
    assert states(spark, "sh *.sh gone.sh https://x/y.sh $X/hooks/a.sh") == [("$X/hooks/a.sh", None, "unknown"), ("*.sh", None, "unknown"), ("gone.sh", None, "missing")]
    assert states(spark, "ls") == states(spark, None) == states(spark, "") == []


def test_owner(spark):
    """The longest tail that is a file of the owner; a tail of one segment counts for such references alone."""
    assert states(spark, "node $P/lib/run.js $P/other/run.js run.js", PLUG) == [("$P/lib/run.js", f"{PLUG}/lib/run.js", "owned"), ("$P/other/run.js", None, "unknown"), ("run.js", f"{PLUG}/run.js", "owned")]
    assert states(spark, "node x/lib/run.js", PLUG) == [("x/lib/run.js", f"{PLUG}/lib/run.js", "owned")]
    assert states(spark, "node x/lib/run.js") == [("x/lib/run.js", None, "missing")]


def test_units_are_scanned(spark):
    items, followed, files = led(spark, "sh hooks/a.sh && sh /opt/o.sh")
    units = commands.entry_units(items, followed, files).select(F.lit("a").alias("artifact"), F.col("file").alias("unit"), "role", "file", "text")
    got = sorted((r.unit, r.rule) for r in rules.evaluate(rules.lines(units)).collect())
    assert got == [(f"{CONFIG}/hooks/a.sh", "FS-003"), ("settings", "HOOK-001")]


def test_units_shown_once_a_file(spark):
    """What is shown of a text is made below the join, so that it is not made anew for every item that runs the file."""
    items, followed, files = led(spark, "sh hooks/a.sh && sh /opt/o.sh")
    plain = commands.entry_units(items, followed, files)
    units = commands.entry_units(items, followed, files, lambda text: F.sha2(text, 256))
    assert sorted(map(tuple, units.collect())) == sorted(map(tuple, plain.withColumn("text", F.sha2("text", 256)).collect()))
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        units.select("text").explain()
    above = [line for line in shown.getvalue().split("Join", 1)[0].splitlines() if "sha2" in line and "trim" not in line]  # the command lines have no join
    assert "Join" in shown.getvalue() and not above


def test_units_come_file_by_file(spark):
    """Rows of one text are neighbours, as a columnar file then holds the text once; before, texts alternated with every row."""
    files = spark.createDataFrame([(1, f"{HOME}/b.py", f"text {k}") for k in range(20)] + [(1, f"{HOME}/c.py", None)], "root int, path string, text string")
    items = [(1, k, f"{HOME}/b.py", "followed") for k in range(60) for _ in range(1 + k % 2)] + [(1, 7, f"{HOME}/c.py", "followed"), (2, 8, f"{HOME}/b.py", "followed"), (1, 9, f"{HOME}/b.py", "outside")]
    followed = spark.createDataFrame(items, "root int, item int, path string, state string")
    hooks = spark.createDataFrame([], "root int, item int, type string, command string")
    rows = commands.entry_units(hooks, followed, files).collect()
    assert sorted((r.item, r.text) for r in rows if r.text) == sorted((k, f"text {n}") for k in range(60) for n in range(20))
    assert [(r.root, r.item, r.file, r.role) for r in rows if r.text is None] == [(1, 7, f"{HOME}/c.py", "script")]
    assert sum(a.text != b.text for a, b in zip(rows, rows[1:])) < 40


def test_findings(spark):
    def found(command=None, url=None, kind="command", event="PreToolUse"):
        items, followed, _ = led(spark, command, event=event)
        items = items.withColumn("url", F.lit(url)).withColumn("type", F.lit(kind))
        return sorted((r.rule, r.severity) for r in commands.entry_findings(items, followed).collect())

    assert found("sh /opt/o.sh") == [("COV-000", "low"), ("HOOK-002", "medium")]
    assert found("sh /opt/o.sh", event="PermissionRequest") == [("COV-000", "low"), ("HOOK-002", "high")]
    assert found("sh /opt/o.sh", event=None) == found("sh gone.sh") == [("COV-000", "low")]
    for url, event, severity in [("http://localhost:1/", "Stop", "low"), ("http://[::1]/", "Stop", "low"), ("http://127.0.0.1", "PermissionRequest", "high"), ("https://x.example", "Stop", "high"), ("http://localhost.x.example", "Stop", "high")]:
        assert found(url=url, kind="HTTP", event=event) == [("HOOK-003", severity)], url
    assert found(url=" ", kind="http") == []

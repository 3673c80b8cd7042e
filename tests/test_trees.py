"""The tree source: folders, files and archives with everything that must be refused, and what is scanned of them."""

import os
import stat
import zipfile

import pytest

from vigilrow.operators import routing
from vigilrow.sources import trees


@pytest.fixture()
def load(spark):
    spark.dataSource.register(trees.TreeSource)

    def read(path, **options):
        return spark.read.format("artifact_tree").options(path=str(path), **options).load()

    return read


def write(root, **files):
    for name, content in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())


def rows(df):
    return {r.path: r.note or r.text for r in df.collect()}


def test_tree(load, tmp_path):
    home = tmp_path / "home"
    root = home / "tree"
    write(root, **{"a.md": "one", "b/c.py": "﻿two", "b/d/e.sh": "three", "node_modules/x.js": "no", "b/vendor/y.js": "no", "bin": b"\x00\x01", "latin": b"\xe9", "empty": "", "big": b"x" * (trees.MAX_BYTES + 1), "full": b"x" * trees.MAX_BYTES})
    write(home, **{"beside.md": "beside"})
    write(tmp_path, **{"secret": "no"})
    os.mkfifo(root / "b/pipe")
    (root / "in").symlink_to(home / "beside.md")
    (root / "out").symlink_to(tmp_path / "secret")
    (root / "gone").symlink_to(root / "nothing")
    (root / "b/loop").symlink_to(root)
    got = rows(load(root, shards="3"))
    looped = {k: v for k, v in got.items() if k.startswith("b/loop")}
    got = {k: v for k, v in got.items() if k not in looped}
    assert got.pop("full") == "x" * trees.MAX_BYTES
    assert got == {
        "a.md": "one", "b/c.py": "two", "b/d/e.sh": "three", "node_modules": "excluded folder", "b/vendor": "excluded folder", "bin": "not text", "latin": "not text", "empty": "", "big": "too large",
        "b/pipe": "special file", "in": "beside", "out": "link leads out of the boundary", "gone": "cannot be read",
    }
    # a loop ends where it meets itself
    assert "too deep" in looped.values() and len(looped) < 60
    assert rows(load(root, boundary=str(root)))["in"] == "link leads out of the boundary"
    assert load(root, shards="3").rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="FileNotFoundError"):
        load(home / "typo").collect()


def test_single_file(load, tmp_path):
    write(tmp_path, **{"commands/do.md": "rm -rf ~", "x.sh": "ls"})
    (r,) = load(tmp_path / "commands/do.md").collect()
    assert (r.path, r.text, r.size) == ("", "rm -rf ~", 8)
    assert [(u.kind, u.artifact, u.role) for u in routing.units(load(tmp_path / "commands/do.md")).collect()] == [("command", "do.md", "instruction")]
    assert [(u.kind, u.role) for u in routing.units(load(tmp_path / "x.sh")).collect()] == [("instruction", "instruction")]


def test_archive(load, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("SKILL.md", "See notes.md")
        z.writestr("./d/run.sh", "ls")
        z.writestr("big", b"0" * (trees.MAX_BYTES + 1))
        z.writestr("../up.sh", "no")
        z.writestr("/abs.sh", "no")
        z.writestr("a/../../b.sh", "no")
        z.writestr("folder/", "")
        z.writestr("inner.zip", b"PK\x03\x04\x00")
        link = zipfile.ZipInfo("link")
        link.external_attr = (stat.S_IFLNK | 0o777) << 16
        z.writestr(link, "/etc/passwd")
    assert rows(load(path)) == {"SKILL.md": "See notes.md", "d/run.sh": "ls", "big": "too large", "../up.sh": "unsafe name", "/abs.sh": "unsafe name", "a/../../b.sh": "unsafe name", "inner.zip": "not text", "link": "special file"}
    assert [r.layout for r in routing.layouts(load(path).filter("note is null")).collect()] == ["skill"]
    write(tmp_path, **{"bad.zip": "no archive"})
    assert rows(load(tmp_path / "bad.zip")) == {"": "archive cannot be read"}


def test_archive_bounds(load, tmp_path, monkeypatch):
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:
        for k in range(trees.MAX_MEMBERS + 5):
            z.writestr(f"f{k}", "x")
    got = rows(load(many))
    assert len(got) == trees.MAX_MEMBERS + 1 and got[""] == f"more than {trees.MAX_MEMBERS} members"
    # a bomb: little in the index, much when it is opened; reading ends with the bound
    bomb = tmp_path / "bomb.zip"
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(70):
            z.writestr(f"f{k:02}", b"0" * trees.MAX_BYTES)
    assert bomb.stat().st_size < 200_000
    got = rows(load(bomb))
    assert got[""] == f"more than {trees.MAX_TOTAL} bytes" and len(got) == 65


def test_root(load, tmp_path):
    root = tmp_path / ".claude"
    write(
        root,
        **{"skills/a/SKILL.md": "See n.md", "skills/a/n.md": "```\nls\n```", "skills/a/copy.md": "```\nls\n```", "skills/a/x.sh": "same", "skills/a/y.sh": "same", "skills/b/x.sh": "same", "skills/synced/u/c/SKILL.md": "c", "commands/k.md": "k", "agents/d/r.md": "r"},
        **{"output-styles/s.md": "s", "output-styles/s.css": "t", "CLAUDE.md": "See rules/r.md", "rules/r.md": "r", "tools/evil.sh": "e", "loose.sh": "e"},
    )
    units = sorted((u.kind, u.artifact, u.path, u.role) for u in routing.units(load(root)).collect())
    assert units == [
        ("command", "commands/k.md", "commands/k.md", "instruction"),
        ("directory", "skills/b", "skills/b/x.sh", "script"),
        ("instruction", "CLAUDE.md", "CLAUDE.md", "instruction"),
        ("output_style", "output-styles/s.md", "output-styles/s.md", "instruction"),
        ("rule", "rules/r.md", "rules/r.md", "doc"),
        ("skill", "a", "skills/a/SKILL.md", "instruction"),
        ("skill", "a", "skills/a/copy.md", "doc"),
        ("skill", "a", "skills/a/n.md", "code"),
        ("skill", "a", "skills/a/n.md", "doc"),
        ("skill", "a", "skills/a/x.sh", "script"),
        ("skill", "synced/c", "skills/synced/u/c/SKILL.md", "instruction"),
        ("subagent", "agents/d/r.md", "agents/d/r.md", "instruction"),
    ]
    assert sorted((n.path, n.note) for n in routing.notes(load(root)).collect()) == [(p, "belongs to no artifact") for p in ("loose.sh", "output-styles", "tools")]


def test_plugin_and_server(load, tmp_path):
    write(tmp_path / "p", **{".claude-plugin/plugin.json": "{}", "skills/a/SKILL.md": "a", "lib/x.py": "x", "agents/r.md": "r"})
    got = sorted((u.kind, u.artifact, u.path) for u in routing.units(load(tmp_path / "p")).collect())
    assert got == [("plugin", "p", p) for p in (".claude-plugin/plugin.json", "agents/r.md", "lib/x.py", "skills/a/SKILL.md")] + [("skill", "a", "skills/a/SKILL.md"), ("subagent", "agents/r.md", "agents/r.md")]
    write(tmp_path / "s", **{"src/a.py": "from mcp.server import Server\nserver = Server('x')"})
    write(tmp_path / "c", **{"src/a.py": "import mcp\nprint(mcp)", "b.py": "app = Server('x')", "d.txt": "from mcp import x\nServer()"})
    layout = lambda n: [r.layout for r in routing.layouts(load(tmp_path / n).filter("note is null")).collect()]
    assert layout("s") == ["server"] and layout("c") == ["directory"]


def test_reader_of_any_store(spark, tmp_path):
    """The same rows of files, through Spark's own reader."""
    from vigilrow.sources import readers

    root = tmp_path / "a b's" / "tree"
    write(root, **{"a.md": "﻿one", "b/c.py": "two", "node_modules/x.js": "no", "bin": b"a\x00b", "latin": b"\xe9", "empty": "", "big": b"x" * (trees.MAX_BYTES + 1), "copy/a.md": "one"})
    got = readers.tree(spark, str(root))
    assert got.columns == [c.split()[0] for c in trees.SCHEMA.split(", ")]
    assert {r.path: r.note or r.text for r in got.collect()} == {"a.md": "one", "b/c.py": "two", "node_modules/x.js": "excluded folder", "bin": "not text", "latin": "not text", "big": "too large", "copy/a.md": "one"}  # Spark's reader leaves empty files out
    assert {r.layout for r in routing.layouts(got.filter("note is null")).collect()} == {"directory"}

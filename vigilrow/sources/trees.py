"""A data source of file trees: a folder, a single file or a zip archive, read in shards under bounds of bytes.

    spark.dataSource.register(TreeSource)
    spark.read.format("artifact_tree").option("path", "/mnt/share/home/.agent").load()

A row is a file that was read (path, size, sha256, text) or an entry that was not (path, note). Nothing is opened before its kind and
its size are known: links that lead out of the boundary, devices and pipes, and files over the bound are refused by name. Listing is
shared out by the entries of the two upper levels, and each shard walks its own part; a task holds one file at a time. Archives are read
member by member, and what counts is the bytes that come out, not what the index says.

The path must be on a mount that all executors have. For stores that only Spark reads, `readers.tree` gives the same rows of files.
"""

from __future__ import annotations

import hashlib
import os
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bounds, all fixed values: bytes of a file, members and bytes of an archive, levels of a tree.
MAX_BYTES, MAX_MEMBERS, MAX_TOTAL, MAX_DEPTH = 1 << 20, 2000, 64 << 20, 32
#: Folders that are named and not read. Fixed values.
SKIPPED = frozenset(("node_modules", ".git", "dist", "build", "vendor", "__pycache__", ".venv"))

SCHEMA = "target string, path string, size long, sha256 string, text string, note string"


@dataclass
class Shard(InputPartition):
    """Entries of a target, each (path from the target, whether to go into it)."""

    target: str
    entries: list


def _decoded(content: bytes) -> str | None:
    """Text, without a byte order mark; None if it is none."""
    if b"\0" in content:
        return None
    try:
        return content.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        return None


def _row(target: str, path: str, content: bytes) -> tuple:
    text = _decoded(content)
    if text is None:
        return (target, path, len(content), None, None, "not text")
    return (target, path, len(content), hashlib.sha256(content).hexdigest(), text, None)


def _refused(target: str, path: str, note: str, size: int | None = None) -> tuple:
    return (target, path, size, None, None, note)


def _inside(path: str, boundary: str) -> bool:
    return path == boundary or path.startswith(boundary.rstrip("/") + "/")


def _member_name(name: str) -> str | None:
    """A member's path in its archive, None if it is unsafe."""
    parts = name.replace("\\", "/").split("/")
    if name.startswith(("/", "\\")) or ".." in parts or "\0" in name or ":" in parts[0]:
        return None
    return "/".join(p for p in parts if p not in ("", ".")) or None


def archive(path: str, target: str) -> Iterator[tuple]:
    """The rows of a zip archive's members; archives inside are files that are not text."""
    try:
        opened = zipfile.ZipFile(path)
    except (zipfile.BadZipFile, OSError):
        yield _refused(target, "", "archive cannot be read")
        return
    total = 0
    with opened:
        for number, member in enumerate(opened.infolist()):
            if number >= MAX_MEMBERS:
                yield _refused(target, "", f"more than {MAX_MEMBERS} members")
                return
            name = _member_name(member.filename)
            if member.is_dir():
                continue
            if name is None:
                yield _refused(target, member.filename.replace("\0", "\\0"), "unsafe name")
            elif stat.S_IFMT(member.external_attr >> 16) not in (0, stat.S_IFREG):
                yield _refused(target, name, "special file")
            elif member.flag_bits & 1:
                yield _refused(target, name, "encrypted")
            else:
                try:
                    with opened.open(member) as f:
                        content = f.read(min(MAX_BYTES, MAX_TOTAL - total) + 1)
                except (zipfile.BadZipFile, OSError, NotImplementedError, EOFError, ValueError):
                    yield _refused(target, name, "member cannot be read")
                    continue
                total += len(content)
                if total > MAX_TOTAL:
                    yield _refused(target, "", f"more than {MAX_TOTAL} bytes")
                    return
                yield _refused(target, name, "too large") if len(content) > MAX_BYTES else _row(target, name, content)


class TreeReader(DataSourceReader):
    def __init__(self, path: str, boundary: str, shards: int):
        self.path, self.boundary, self.shards = path, boundary, shards

    def partitions(self) -> list[InputPartition]:
        if not os.path.lexists(self.path):
            raise FileNotFoundError(self.path)  # a wrong path is an error, not an empty tree
        if not os.path.isdir(self.path):
            return [Shard(self.path, [("", False)])]
        entries = []
        for name in sorted(os.listdir(self.path)):
            upper = os.path.join(self.path, name)
            if name in SKIPPED or not os.path.isdir(upper) or os.path.islink(upper):
                entries.append((name, True))
                continue
            try:
                entries += [(f"{name}/{below}", True) for below in sorted(os.listdir(upper))]
            except OSError:
                entries.append((name, True))
        n = max(1, min(self.shards, len(entries)))
        return [Shard(self.path, entries[k::n]) for k in range(n)]

    def read(self, shard: Shard) -> Iterator[tuple]:
        for path, _ in shard.entries:
            yield from self._entry(shard.target, path, path.count("/") + 1, frozenset())

    def _entry(self, target: str, path: str, depth: int, above: frozenset) -> Iterator[tuple]:
        full = os.path.join(target, path) if path else target
        try:
            real, s = os.path.realpath(full), os.stat(full)
        except OSError:
            yield _refused(target, path, "cannot be read")
            return
        if os.path.islink(full) and not _inside(real, self.boundary):
            yield _refused(target, path, "link leads out of the boundary")
        elif stat.S_ISDIR(s.st_mode):
            if os.path.basename(path) in SKIPPED:
                yield _refused(target, path, "excluded folder")
            elif depth > MAX_DEPTH or (s.st_dev, s.st_ino) in above:
                yield _refused(target, path, "too deep")
            else:
                try:
                    names = sorted(os.listdir(full))
                except OSError:
                    yield _refused(target, path, "cannot be read")
                    return
                for name in names:
                    yield from self._entry(target, f"{path}/{name}", depth + 1, above | {(s.st_dev, s.st_ino)})
        elif not stat.S_ISREG(s.st_mode):
            yield _refused(target, path, "special file")
        elif not path and full.lower().endswith(".zip"):
            yield from archive(full, target)
        elif s.st_size > MAX_BYTES:
            yield _refused(target, path, "too large", s.st_size)
        else:
            try:
                # what was a file a moment ago may be a pipe now
                with open(os.open(full, os.O_RDONLY | os.O_NONBLOCK), "rb") as f:
                    content = f.read(MAX_BYTES + 1)
            except OSError:
                yield _refused(target, path, "cannot be read")
                return
            yield _refused(target, path, "too large", len(content)) if len(content) > MAX_BYTES else _row(target, path, content)


class TreeSource(DataSource):
    """Options: path; boundary, what links may lead to (the folder that holds the path); shards, the most tasks (64)."""

    @classmethod
    def name(cls) -> str:
        return "artifact_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path = os.path.abspath(self.options["path"])
        boundary = os.path.realpath(self.options.get("boundary", os.path.dirname(path)))
        return TreeReader(path, boundary, int(self.options.get("shards", 64)))

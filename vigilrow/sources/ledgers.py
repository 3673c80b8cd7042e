"""A data source of suppression baselines and result ledgers that is written whole or not at all.

    spark.dataSource.register(LedgerSource)
    rows.write.format("ledger").option("path", "/mnt/share/baseline").option("kind", "baseline").mode("overwrite").save()

Tasks write their parts into a staging folder of the job beside the target; the driver puts the folder in the target's place with a
rename once all tasks are done, and takes it away if one fails, so that a reader sees the ledger of before or the one of after. Rows of a part
are sorted, so that the same rows in the same parts give the same bytes.

kind `baseline`: rows rule, glob; lines `RULE [glob]`. kind `fold`: rows of any columns, as JSON lines with sorted members. The path
must be on a mount that all executors have.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

KINDS = ("baseline", "fold")


@dataclass
class Part(WriterCommitMessage):
    rows: int


def _line(kind: str, row: dict) -> str:
    if kind == "baseline":
        rule, glob = row["rule"], row.get("glob") or ""
        if not rule or any(c.isspace() for c in rule) or "\n" in glob or rule.startswith("#"):
            raise ValueError(f"no baseline entry: {rule!r} {glob!r}")
        return f"{rule} {glob}".rstrip()
    return json.dumps(row, sort_keys=True, ensure_ascii=False, default=str)


class LedgerWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.staging = f"{path}.staging-{uuid.uuid4().hex}"
        if os.path.lexists(path) and not overwrite:
            raise FileExistsError(path)
        os.makedirs(self.staging)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        lines = sorted({_line(self.kind, row.asDict(recursive=True)) for row in iterator}) if self.kind == "baseline" else sorted(_line(self.kind, row.asDict(recursive=True)) for row in iterator)
        # a task that is tried again writes a file of its own, and only whole files get the name that counts
        own = os.path.join(self.staging, f".{context.partitionId():05}-{context.taskAttemptId()}")
        with open(own, "w", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in lines)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, os.path.join(self.staging, f"part-{context.partitionId():05}.{'txt' if self.kind == 'baseline' else 'jsonl'}"))
        return Part(len(lines))

    def commit(self, messages: list) -> None:
        for name in os.listdir(self.staging):
            if name.startswith("."):
                os.unlink(os.path.join(self.staging, name))
        old = f"{self.path}.old-{uuid.uuid4().hex}"
        if os.path.lexists(self.path):
            os.rename(self.path, old)
        try:
            os.rename(self.staging, self.path)
        except OSError:
            if os.path.lexists(old):
                os.rename(old, self.path)
            raise
        shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


@dataclass
class File(InputPartition):
    path: str


class LedgerReader(DataSourceReader):
    def __init__(self, path: str, kind: str, names: list[str]):
        self.path, self.kind, self.names = path, kind, names

    def partitions(self) -> list[InputPartition]:
        return [File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if not n.startswith(".")]

    def read(self, part: File) -> Iterator[tuple]:
        with open(part.path, encoding="utf-8") as f:
            for line in f:
                line = line.rstrip("\n")
                if self.kind == "fold":
                    row = json.loads(line)
                    yield tuple(row.get(n) for n in self.names)
                elif line.strip() and not line.startswith("#"):
                    rule, _, glob = line.partition(" ")
                    yield rule, glob.strip()


class LedgerSource(DataSource):
    """Options: path, kind (baseline or fold). A fold is read with the schema that the user gives."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def _kind(self) -> str:
        kind = self.options.get("kind", "baseline")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        if self._kind() != "baseline":
            raise ValueError("a fold is read with .schema(...)")
        return "rule string, glob string"

    def reader(self, schema) -> DataSourceReader:
        return LedgerReader(self.options["path"], self._kind(), schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LedgerWriter(os.path.abspath(self.options["path"]), self._kind(), overwrite)

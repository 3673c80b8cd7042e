"""Shared helpers: table reading, written intermediate tables, words and hashing."""

from __future__ import annotations

import uuid
import weakref
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on bytes; nothing else changes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table of an input folder, only the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/vigilrow-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Where the tables of materialize() are.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


#: Spark's setting for shuffle files that go with the query that wrote them, and not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's setting for the rows that Python gets at once, and how many these are at most in what is written here: a batch of
#: texts or of sets lies in memory several times, in the executor's JVM and in each of its Python workers.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The files go when discard() is called with what this returns, or else when the driver's JVM ends; the shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vigilrow/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = {k: spark.conf.get(k) for k in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, str(min(n for n in (int(before[_BATCH]), BATCH_ROWS) if n > 0)))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that materialize() returned, once all that reads them is written."""
    for df in frames:
        files, where = _file_system(df.sparkSession, _WRITTEN.pop(df))
        files.delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str, modulus: str) -> str:
    """SQL for crc32 of a document's id as text, modulo `modulus`; a null id counts as empty text."""
    return f"pmod(crc32(cast(coalesce(cast({doc_id} as string), '') as binary)), {modulus})"


def fold_of(doc_id) -> int:
    """crc32 of an id as text; what fold() computes before its modulus."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode())


class Hashes(dict):
    """64-bit hashes of words, kept while there are few enough of them."""

    def __init__(self, most: int = 400_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the key alone; all rows where there are fewer."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def packed_batches(documents: DataFrame, flag: Column | None = None, size: int = 8_000_000) -> DataFrame:
    """Batches of about `size` bytes of text, each a row (batch, ids, flags, lengths, data), in a table of the
    shared folder bucketed by batch, so that joins by batch don't shuffle texts. Null texts are empty.
    """
    spark = documents.sparkSession

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for b in batches:
            for doc_id, text, f in zip(b.doc_id, b.text, b.flag):
                held.append((None if pd.isna(doc_id) else int(doc_id), bool(f), (text or "").encode("utf-8", "surrogatepass")))
                total += len(held[-1][2])
                if total >= size:
                    yield row(held)
                    held, total = [], 0
        if held:
            yield row(held)

    def row(held: list) -> pd.DataFrame:
        ids, flags, texts = zip(*held)
        return pd.DataFrame({"ids": [list(ids)], "flags": [list(flags)], "lengths": [[len(t) for t in texts]], "data": [zstandard.compress(b"".join(texts), 3)]})

    flag = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    rows = documents.select("doc_id", "text", flag.alias("flag")).mapInPandas(pack, "ids array<long>, flags array<boolean>, lengths array<long>, data binary")
    name = f"vigilrow_batches_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/vigilrow/{name}"
    rows.withColumn("batch", F.monotonically_increasing_id()).write.bucketBy(partitions(spark), "batch").option("path", path).saveAsTable(name)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    return spark.table(name)


def texts_of(row) -> Iterator[tuple[int, int | None, bytes]]:
    """(place, doc_id, text) of the documents of a batch."""
    data, at = zstandard.decompress(row.data), 0
    for k, (doc_id, n) in enumerate(zip(row.ids, row.lengths)):
        yield k, None if pd.isna(doc_id) else int(doc_id), data[at : at + int(n)]
        at += int(n)

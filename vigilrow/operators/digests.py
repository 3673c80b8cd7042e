"""Digests over ordered rows, chained journals and what they say is pending."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tree_hash(files: DataFrame) -> DataFrame:
    """Per artifact sha256 over its files (path, sha256) in order of path: path, a zero byte and the 32 bytes of each.

    Files come to a task in order and go into a running digest, so that a task holds one batch of rows, however large an artifact is.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for b in batches:
            done = []
            for artifact, path, sha in zip(b["artifact"], b["path"], b["sha256"]):
                if h is None or artifact != now:
                    if h is not None:
                        done.append((now, h.hexdigest()))
                    now, h = artifact, hashlib.sha256()
                h.update(path.encode() + b"\0" + bytes.fromhex(sha))
            yield pd.DataFrame(done, columns=["artifact", "hash"])
        if h is not None:
            yield pd.DataFrame([(now, h.hexdigest())], columns=["artifact", "hash"])

    kind = files.schema["artifact"].dataType.simpleString()
    # bytes of UTF-8 have the order of code points, which is the one that counts
    rows = files.select("artifact", "path", "sha256").filter("path is not null and sha256 is not null").repartition("artifact").sortWithinPartitions("artifact", "path", "sha256")
    return rows.mapInPandas(digest, f"artifact {kind}, hash string")


def entropies(texts: DataFrame) -> DataFrame:
    """Per doc_id the bits per character of the whole text, to six places: sum(k log k) over the counts k of its characters."""
    chars = texts.filter("text <> ''").select("doc_id", F.explode(F.split("text", "")).alias("x")).groupBy("doc_id", "x").agg(F.count("*").alias("k"))
    sums = chars.groupBy("doc_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    return sums.select("doc_id", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("bits"))


def chain_breaks(journal: DataFrame) -> DataFrame:
    """Per journal (journal, line_no, raw, prev): lines, the line where its chain breaks, whether that line is corrupt, and the unchained lines (no prev) before it.

    A line breaks the chain if it is corrupt (prev is null) or its prev is not the digest of the line before; what is behind is not judged.
    """
    w = Window.partitionBy("journal")
    checked = journal.withColumn("want", F.coalesce(F.lag(F.sha2("raw", 256)).over(w.orderBy("line_no")), F.lit("genesis")))
    bad = F.col("prev").isNull() | ((F.col("prev") != "") & (F.col("prev") != F.col("want")))
    checked = checked.withColumn("first", F.min(F.when(bad, F.col("line_no"))).over(w))
    before = F.col("first").isNull() | (F.col("line_no") < F.col("first"))
    corrupt = F.bool_or((F.col("line_no") == F.col("first")) & F.col("prev").isNull())
    return checked.groupBy("journal").agg(F.count("*").alias("n_lines"), F.count_if((F.col("prev") == "") & before).alias("unchained"), F.max("first").alias("first_break"), F.coalesce(corrupt, F.lit(False)).alias("corrupt"))


def journal_state(journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending, restorable) of rows (place, batch, item, state): intended without an outcome; done and not undone, of the last such batch.

    The last batch is the one of which something to restore stands last for the first time in the journal.
    """
    per = journal.groupBy("batch", "item").agg(*(F.max(F.col("state") == s).alias(s) for s in ("intended", "done", "failed", "undone")), F.min(F.when(F.col("state") == "done", F.col("place"))).alias("place"))
    pending = per.filter("intended and not (done or failed or undone)").select("batch", "item")
    open_ = per.filter("done and not undone").select("batch", "item", "place")
    first = open_.groupBy("batch").agg(F.min("place").alias("place"))
    newest = first.agg(F.max_by("batch", "place").alias("batch"))
    return pending, open_.join(F.broadcast(newest), "batch").select("batch", "item")

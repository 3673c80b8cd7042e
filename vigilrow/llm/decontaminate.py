"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Texts are lower-cased (A-Z) and cut into words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. A pattern is a window
of `width` consecutive words of a benchmark item; an item with fewer words, but at least one, is one
shorter pattern. The search runs over words, not bytes: blocks are word pairs, the shift table says how
far the search may move when a block stands at its end, and a block with shift 0 leads to a bucket of
patterns with these last words, in which those with the same words before them are compared word by word.
Patterns of full width and shorter ones are searched apart, so that a short item does not shorten every shift.

The patterns of one search are bounded by `chunk_bytes` of item text. A larger benchmark is searched in
several passes, one after the other: what a pass finds is written before its broadcast is dropped and the
next share is read, so that neither the driver nor a task ever holds more than one share.

Edge cases: null and empty texts have no words; items without words never occur; repeated items each
count under their item_id; a null item_id is ignored; repeated doc_ids each give a row; extra columns are
ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import LOWER, discard, materialize

_WORDS = bytes(c if 0x30 <= (c := LOWER[b]) <= 0x39 or 0x61 <= c <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class WuManber:
    """Shift tables and buckets for patterns of words; least: the words of the shortest pattern."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.least = min(map(len, patterns))
        self.block = min(2, self.least)
        self.shift: dict[tuple[bytes, ...], int] = {}
        # by the words of the block at the end, then by those before it
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(self.block, self.least + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.least), self.least - end)
            self.bucket[p[self.least - self.block : self.least]][p[: self.least - self.block]].append((p, items))
        self.default = self.least - self.block + 1
        self.vocabulary = {w for b in self.shift for w in b}

    def search(self, words: list[bytes], hit: np.ndarray, found: set[int]) -> None:
        """Marks the words inside occurrences; adds the items that occur."""
        at, n, least, block, shift, default = self.least, len(words), self.least, self.block, self.shift, self.default
        if at > n:
            return
        # a last word of a block outside the patterns' vocabulary allows the longest jump that keeps it out
        known = self.vocabulary.__contains__
        while at <= n:
            if not known(words[at - 1]):
                at += least
                continue
            end = tuple(words[at - block : at])
            s = shift.get(end, default)
            if s:
                at += s
                continue
            start = at - least
            for p, items in self.bucket[end].get(tuple(words[start : at - block]), ()):
                if tuple(words[start : start + len(p)]) == p:
                    hit[start : start + len(p)] = True
                    found.update(items)
            at += 1


def patterns_of(items: list[tuple[int, str]], width: int) -> list[WuManber]:
    """One searcher for the windows of full width, one for each shorter length that items have."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            p = tuple(w[k : k + width])
            by_length[len(p)][p].append(item)
    return [WuManber(p) for p in by_length.values()]


def _shares(benchmark: DataFrame, chunk_bytes: int) -> list[DataFrame]:
    """The items (item_id, text) in shares of about chunk_bytes, dealt by hash; a single longer item still fits."""
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-int(total) // chunk_bytes))
    return [items] if chunks == 1 else [items.filter(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c) for c in range(chunks)]


def _broadcast(share: DataFrame):
    return share.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in share.collect()])


def _search(text: str | None, searchers: list[WuManber]) -> tuple[int, np.ndarray, set[int]]:
    """The number of words, which of them are hit, and the items that occur."""
    words, found = words_of(text), set()
    hit = np.zeros(len(words), bool)
    for s in searchers:
        s.search(words, hit, found)
    return len(words), hit, found


def _clean(documents: DataFrame, shared, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = patterns_of(shared.value, width)
        for b in batches:
            yield b.filter(pa.array([not _search(text, searchers)[1].any() for text in b.column("text").to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def keep_clean(documents: DataFrame, benchmark: DataFrame, width: int = 10, chunk_bytes: int = 4_000_000) -> DataFrame:
    """The rows of documents, all columns, in which no window of the benchmark occurs."""
    *shares, last = _shares(benchmark, chunk_bytes)
    written = None
    for share in shares:
        shared = _broadcast(share)
        documents, before = materialize(_clean(documents, shared, width), "clean"), written
        shared.destroy()
        if before is not None:
            discard(before)
        written = documents
    return _clean(documents, _broadcast(last), width)


def find(documents: DataFrame, benchmark: DataFrame, width: int = 10, chunk_bytes: int = 4_000_000) -> DataFrame:
    """Per document: doc_id, n_words, hit (positions of words inside occurrences), items (sorted ids)."""
    shares, docs = _shares(benchmark, chunk_bytes), documents.select("doc_id", "text")
    if len(shares) == 1:
        return _found(docs, _broadcast(shares[0]), width)
    docs, parts = docs.withColumn("_row", F.monotonically_increasing_id()), []
    for k, share in enumerate(shares):
        shared = _broadcast(share)
        part = _found(docs, shared, width)
        parts.append(materialize(part.filter("size(hit) > 0") if k else part, "hits"))  # the first has a row for every document
        shared.destroy()
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("_row", "doc_id")
        .agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .drop("_row")
    )


def _found(docs: DataFrame, shared, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searchers = patterns_of(shared.value, width)
        for b in batches:
            out = [_search(text, searchers) for text in b.text]
            yield b.drop(columns="text").assign(n_words=[x[0] for x in out], hit=[np.flatnonzero(x[1]).astype(np.int32) for x in out], items=[sorted(x[2]) for x in out])

    kept = ", ".join(f"{c} long" for c in docs.columns if c != "text")
    return docs.mapInPandas(run, f"{kept}, n_words long, hit array<int>, items array<long>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the digest of item ids, sorted as strings and comma-joined."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def brute_force(documents: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    """The same rows by comparing every window with every position; for tests."""
    out = []
    for doc_id, text in documents:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            w = words_of(t)
            for k in range(max(1, len(w) - width + 1) if w else 0):
                p = w[k : k + width]
                for q in range(len(words) - len(p) + 1):
                    if words[q : q + len(p)] == p:
                        hit |= set(range(q, q + len(p)))
                        found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out

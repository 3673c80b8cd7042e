"""N-gram Jaccard join: which documents share at least `percent` % of their word shingles.

Words are runs of non-white-space bytes, A-Z lower-cased; a document's set holds its distinct `n`-word
shingles, or its whole word sequence where it has fewer words. Sets are compared exactly; a shingle is
known by a 64-bit hash, and documents with equal sets form one class, known by a 64-bit hash of the set.

The join is size-aware. A light set is small enough that listing, for every size a partner may have, all
its subsets of the size that both must share costs less than scanning: two sets link just when they share
such a subset. A heavy set scans inverted lists: in a common order of shingles, frequent ones last, two
sets that link share one of the first |s| - ceil(0.8 |s|) + 1 of each. Where light sets end is chosen from
the measured length of lists. Sets near the border do both, so that no pair is lost between the two.

Everything large moves as packed numpy columns in binary cells, dealt to `buckets` by hash:
1. count, for every shingle, the documents that hold it, and broadcast a table of `cells` bytes with the
   magnitude of the count at the shingle's cell (the largest, where several share a cell). The table has
   that size whatever the input; where too many shingles repeat, those that repeat least are left out.
   It orders the shingles, rare ones first: it alters speed, never results;
2. deal out signatures and prefixes, without shingles that occur once, and keep the lists with two classes
   or more. A document that shares little with any other has no list at all;
3. verify, per class, the pair with the most ordinary class of its lists, and take components; then, per
   list, only what is still in different components, until every candidate pair is either verified or
   joined by other links. So a group of near copies costs its size, not its square. Before two sets of a
   list become a pair, their sketches are compared: of each of 512 cells the parity of the shingles in it.
   Sets differ in at least as many shingles as cells, so that what this rules out surely doesn't link;
   documents that share no more than a passage end here.

Edge cases: null and empty texts have the empty set, link with nothing and form their own component;
repeated rows of a doc_id each give a row; a null doc_id gets a row, but names no component unless
alone (then null); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import LOWER, Hashes, materialize, mix, partitions
from vigilrow.llm.components import connected_components, joined_components

_POWERS = np.array([pow(0x9FB21C651E98DF25, k, 1 << 64) for k in range(64)], np.uint64)


#: Up to so many pairs of ids, of 16 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: In lists of over LARGE classes, so many classes are compared with all others at first.
LARGE, LEADERS = 16, 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_set(text: str | None, hashes: Hashes, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    h = hashes.of(words_of(text))
    width = min(n, len(h))
    if not width:
        return np.empty(0, np.uint64)
    out = h[width - 1 :] + np.uint64(width)
    for k in range(width - 1):
        out += h[k : len(h) - width + 1 + k] * _POWERS[width - 1 - k]
    out = mix(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def shared(a: int, b: int, percent: int) -> int:
    """The least intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(a: int, percent: int) -> range:
    return range(-(-percent * a // 100), 100 * a // percent + 1)


def light_cost(a: int, percent: int) -> int:
    """Subsets that a light set of size a lists."""
    return sum(comb(a, shared(a, b, percent)) for b in partner_sizes(a, percent))


def prefix_length(a: int, percent: int) -> int:
    return a - -(-percent * a // 100) + 1


def light_limit(list_length: float, percent: int) -> int:
    """The largest size up to which listing subsets costs no more than scanning lists of that length."""
    a = 0
    while light_cost(a + 1, percent) <= prefix_length(a + 1, percent) * (1 + list_length):
        a += 1
    return a


def _signatures(s: np.ndarray, limit: int, percent: int) -> list[int]:
    """Hashes of the subsets that a set of size up to limit shares with its partners up to limit."""
    a, out = len(s), []
    for b in partner_sizes(a, percent):
        if b <= limit:
            tag = b"%d %d " % (min(a, b), max(a, b))
            out += [xxhash.xxh3_64_intdigest(tag + np.array(x, np.uint64).tobytes()) for x in combinations(s, shared(a, b, percent))]
    return out


def _split(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash and the 32 bits by which it is known there."""
    x = mix(h)
    return ((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), x.astype(np.uint32)


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column) for each bucket that has rows."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16 if bucket.max() < 65536 else np.uint64), kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    at = 0
    for end in np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)):
        yield int(bucket[at]), *(c[at:end].tobytes() for c in columns)
        at = end


def _class_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _cell(bucket, key: np.ndarray, own: int) -> np.ndarray:
    """The cell of a shingle, with `own` cells for each bucket."""
    return (np.asarray(bucket).astype(np.int64) * own) + ((key.astype(np.uint64) * np.uint64(own)) >> np.uint64(32)).astype(np.int64)


def _levels(documents: DataFrame, n: int, buckets: int, cells: int) -> tuple[np.ndarray, bool, float]:
    """The table of magnitudes (0: the shingle occurs once), whether it holds all that repeat, and the mean length of lists of rare shingles."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, total = Hashes(), [], 0
        for b in batches:
            for text in b.text:
                held.append(shingle_set(text, hashes, n))
                total += len(held[-1])
                if total > 1_500_000:
                    yield press(held)
                    held, total = [], 0
        if total:
            yield press(held)

    def press(held: list[np.ndarray]) -> pd.DataFrame:
        h = np.concatenate(held)
        h.sort()
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(start, len(h)))
        bucket, key = _split(h[start], buckets)
        # shingles held once, which most are, need no count
        rows = [(b, k, None) for b, k in _dealt(bucket[count == 1], key[count == 1])]
        rows += list(_dealt(bucket[count > 1], key[count > 1], count[count > 1].astype(np.uint32)))
        return pd.DataFrame(rows, columns=["bucket", "key", "n"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, np.uint32) for x in group.key])
        times = np.concatenate([np.ones(len(k) // 4, np.uint32) if c is None else np.frombuffer(c, np.uint32) for k, c in zip(group.key, group.n)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        df = np.add.reduceat(times[order].astype(np.int64), start)
        level = np.minimum(np.log2(df).astype(np.uint8), 31)
        rows = [(int(group.bucket.iloc[0]), e, *(int(x) for x in (at.sum(), df[at].sum(), (df[at] ** 2).sum())), key[start][at].tobytes() if e else None) for e in np.unique(level) for at in [level == e]]
        return pd.DataFrame(rows, columns=["bucket", "level", "shingles", "total", "squares", "at"])

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(own, np.uint8)
        for level, at in sorted(zip(group.level, group["at"])):
            out[_cell(0, np.frombuffer(at, np.uint32), own)] = level
        return pd.DataFrame({"bucket": group.bucket.iloc[:1], "cells": [zlib.compress(out.tobytes(), 1)]})

    dealt = documents.select("text").mapInPandas(deal, "bucket long, key binary, n binary")
    table = materialize(dealt.groupBy("bucket").applyInPandas(count, "bucket long, level int, shingles long, total long, squares long, at binary"), "levels")
    steps = table.groupBy("level").agg(*(F.sum(c).alias(c) for c in ("shingles", "total", "squares"))).collect()
    rare = [r for r in steps if r.level < 5]
    length = sum(r.squares for r in rare) / max(1, sum(r.total for r in rare)) - 1
    # a quarter of the cells at most is filled; few shingles need few cells
    cells = min(cells, 1 << max(14, 3 + sum(r.shingles for r in steps if r.level).bit_length()))
    own, room, least = -(-cells // buckets), cells // 4, 32
    for r in sorted(steps, key=lambda r: -r.level):
        if r.level == 0 or r.shingles > room:
            break
        room, least = room - r.shingles, r.level
    out = np.zeros(own * buckets, np.uint8)
    for r in table.filter(F.col("level") >= least).select("bucket", "level", "at").groupBy("bucket").applyInPandas(lay, "bucket long, cells binary").toLocalIterator():
        out[r.bucket * own : (r.bucket + 1) * own] = np.frombuffer(zlib.decompress(r.cells), np.uint8)
    return out, least == 1, max(0.0, length)


def _lists(documents: DataFrame, n: int, percent: int, buckets: int, levels: np.ndarray, exact: bool, limit: int) -> DataFrame:
    """Three kinds of rows: of documents (doc_id, cls, size), of lists with two classes or more (key, cls,
    size, and as `common` how many of its shingles other classes may hold) and of pairs (a, b): of a class with the most ordinary one of its list, with `size` the number of
    such lists, and, in long lists, with other classes, with size 0.
    exact: shingles of level 0 surely occur once.
    """
    known, own = documents.sparkSession.sparkContext.broadcast(zlib.compress(levels.tobytes(), 1)), len(levels) // buckets
    columns = ["bucket", "key", "own", "cls", "size", "rare", "docs"]

    def postings(held: list[np.ndarray], levels: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each set the hashes under which it is listed, and how many of its shingles are rare."""
        bucket, key = _split(np.concatenate(held), buckets)
        level, out, at = levels[_cell(bucket, key, own)], [], 0
        for s in held:
            mine = level[at : at + len(s)]
            at += len(s)
            p = prefix_length(len(s), percent)
            rare = int(np.count_nonzero(mine == 0))
            if exact and rare >= p:
                out.append((s[:0], rare))  # what it has for itself alone is too much for any link
                continue
            h = [np.array(_signatures(s, limit, percent), np.uint64)] if len(s) <= limit else []
            if partner_sizes(len(s), percent)[-1] > limit:
                first = np.argsort(mine, kind="stable")[:p]
                h.append(s[first[rare:] if exact else first])
            out.append((np.concatenate(h), rare))
        return out

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, docs, total = Hashes(), {}, [], 0
        levels = np.frombuffer(zlib.decompress(known.value), np.uint8)
        for b in batches:
            for doc_id, text in zip(b.doc_id, b.text):
                s = shingle_set(text, hashes, n)
                cls = _class_of(s) if len(s) else None
                docs.append((doc_id, cls, len(s)))
                if cls is not None and cls not in held:
                    held[cls] = s
                    total += len(s)
                if total > 1_500_000:
                    yield press(held, docs, levels)
                    held, docs, total = {}, [], 0
        if docs:
            yield press(held, docs, levels)

    def press(held: dict, docs: list, levels: np.ndarray) -> pd.DataFrame:
        ids = [pd.array([x[k] for x in docs], "Int64") for k in range(3)]
        empty = [ids[k].isna() for k in range(2)]
        packed = b"".join(np.asarray(x).tobytes() for x in (ids[0].fillna(0).to_numpy(np.int64), ids[1].fillna(0).to_numpy(np.int64), ids[2].to_numpy(np.int64), empty[0], empty[1]))
        rows = [(int(ids[1].fillna(0)[0] % buckets), b"", b"", b"", b"", b"", packed)]
        if held:
            listed = postings(list(held.values()), levels)
            bucket, key = _split(np.concatenate([x[0] for x in listed]), buckets)
            who = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[0]) for x in listed])
            cls, size, rare = np.array(list(held), np.int64), np.array([len(s) for s in held.values()], np.uint32), np.array([x[1] for x in listed], np.uint32)
            for b, k, o in _dealt(bucket, key, who):
                at, inverse = np.unique(np.frombuffer(o, np.uint32), return_inverse=True)
                rows.append((b, k, inverse.astype(np.uint32).tobytes(), cls[at].tobytes(), size[at].tobytes(), rare[at].tobytes(), None))
        return pd.DataFrame(rows, columns=columns)

    def opened(packed: bytes) -> pd.DataFrame:
        k = len(packed) // 26
        doc, cls, size = (pd.array(np.frombuffer(packed, np.int64, k, 8 * k * i), "Int64") for i in range(3))
        doc[np.frombuffer(packed, bool, k, 24 * k)] = pd.NA
        cls[np.frombuffer(packed, bool, k, 25 * k)] = pd.NA
        return pd.DataFrame({"doc_id": doc, "cls": cls, "size": size})

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        out = [opened(x) for x in group.docs if x is not None] + [pd.DataFrame({c: pd.array([], "Int64") for c in ("doc_id", "key", "cls", "size", "common", "a", "b")})]
        parts = [(np.frombuffer(k, np.uint32), *(np.frombuffer(x, kind)[np.frombuffer(o, np.uint32)] for x, kind in ((c, np.int64), (z, np.uint32), (r, np.uint32)))) for k, o, c, z, r in zip(group.key, group.own, group.cls, group["size"], group.rare)]
        key, cls, size, rare = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((cls, key))
        key, cls, size, rare = key[order], cls[order], size[order].astype(np.int64), rare[order]
        new = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])) if len(key) else np.empty(0, bool)
        key, cls, size, rare = key[new], cls[new], size[new], rare[new]
        if len(key):
            start = np.append(True, key[1:] != key[:-1])
            order = np.flatnonzero(~(start & np.append(start[1:], True)))
            order = order[np.lexsort((cls[order], rare[order], key[order]))]  # in each list the class with fewest rare shingles first
            key, cls, size, common = key[order], cls[order], size[order], size[order] - (rare[order] if exact else 0)
        if len(key):
            start = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(start)
            length = np.diff(np.append(begin, len(key)))
            first = np.repeat(begin, length)
            lead, member = [first], [np.arange(len(key))]
            # in long lists some other classes, chosen by hash, are compared with all too: what they join needs no pairs
            long = np.repeat(length, length) > LARGE
            order = np.lexsort((mix(cls.astype(np.uint64)), key))
            for k in range(LEADERS):
                lead.append(order[np.minimum(first + k, len(key) - 1)][long])
                member.append(np.flatnonzero(long))
            x, y, kind = np.concatenate(lead), np.concatenate(member), np.repeat([0, 1], [len(key), LEADERS * int(long.sum())])
            both = np.minimum(common[x], common[y])
            near = (both * 100 >= (size[x] + size[y] - both) * percent) & (cls[x] != cls[y])
            pairs, times = np.unique(np.stack([kind, cls[x], cls[y]])[:, near], axis=1, return_counts=True)
            # lists of the same classes are one list, known by its classes
            same = np.add.reduceat(mix(cls.astype(np.uint64) ^ np.uint64(0xA5A5)), begin)
            rows = np.unique(np.stack([np.repeat(same.astype(np.int64), length), cls, size, common]), axis=1)
            out.append(pd.DataFrame(dict(zip(("key", "cls", "size", "common"), rows))).astype("Int64"))
            out.append(pd.DataFrame({"a": pairs[1], "b": pairs[2], "size": np.where(pairs[0] == 0, times, 0)}).astype("Int64"))
        return pd.concat(out)[["doc_id", "key", "cls", "size", "common", "a", "b"]]

    dealt = documents.select("doc_id", "text").mapInPandas(deal, "bucket long, key binary, own binary, cls binary, size binary, rare binary, docs binary")
    return materialize(dealt.groupBy("bucket").applyInPandas(gather, "doc_id long, key long, cls long, size long, common long, a long, b long"), "lists")


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of 512 cells, as 8 words."""
    cells = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def _sets(documents: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(cls, hashes, sketch) of the classes in needed (cls, doc_id: one of its documents)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            sets = [shingle_set(t, hashes, n) for t in b.text]
            # rows repeated under one doc_id may differ in text: only the class asked for stays
            own = [len(s) > 0 and _class_of(s) == c for s, c in zip(sets, b.cls)]
            yield pd.DataFrame({"cls": b.cls, "hashes": [s.tobytes() for s in sets], "sketch": [sketch(s) for s in sets]})[own]

    text = documents.select("doc_id", "text").join(needed, "doc_id")
    return text.mapInPandas(run, "cls long, hashes binary, sketch array<long>").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b.x, b.y):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.loc[keep, ["a", "b"]]

    left = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def join(documents: DataFrame, n: int = 5, percent: int = 80, cells: int = 1 << 26) -> DataFrame:
    """doc_id, n_shingles, cls (the class of equal sets) and component_id of every row."""
    buckets = 2 * partitions(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    levels, exact, length = _levels(documents, n, buckets, cells)
    lists = _lists(documents, n, percent, buckets, levels, exact, light_limit(length, percent))
    own = lists.filter("key is null and a is null").select("doc_id", "cls", F.col("size").alias("n_shingles"))
    by_class = own.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    rows = lists.filter("key is not null").select("key", "cls", "size", "common").distinct()
    stars = lists.filter("a is not null").groupBy("a", "b").agg(F.sum("size").alias("times"), F.min("size").alias("least"))
    best = stars.filter("times > 0").groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a"))
    stars = best.select("a", "b").union(stars.filter("least = 0").select("a", "b"))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = materialize(stars, "stars")
    needed = materialize(by_class.join(rows.select("cls").distinct(), "cls", "left_semi"), "needed")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    sets = materialize(_sets(documents, needed, n), "sets")
    links = materialize(_verified(stars, sets, percent), "links")
    label = materialize(connected_components(links), "label")
    # lists whose classes are still apart: each two of them, unless they were compared before
    held = rows.join(label.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    apart = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    held = materialize(held.join(apart, "key", "left_semi").join(sets.select("cls", "sketch"), "cls"), "apart")
    x, y = (held.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("cls", "size", "common", "component", "sketch"))) for k in ("x", "y"))
    # shingles that one of them has for itself are in no intersection
    both = F.least("common_x", "common_y")
    near = both * 100 >= (F.col("size_x") + F.col("size_y") - both) * percent
    # cells of different parity, each of which holds a shingle of one set alone
    apart = sum((F.bit_count(F.col("sketch_x")[k].bitwiseXOR(F.col("sketch_y")[k])) for k in range(8)), F.lit(0))
    near &= apart * (100 + percent) <= (F.col("size_x") + F.col("size_y")) * (100 - percent)
    rest = x.join(y, "key").filter((F.col("component_x") < F.col("component_y")) & near)
    rest = rest.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = materialize(_verified(rest, sets, percent), "links")
    label = joined_components(label, more)
    known = by_class.join(label.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ids = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = known.join(ids, "component").select("cls", "component_id")
    return own.join(by_class, "cls", "left").select("doc_id", "n_shingles", "cls", F.coalesce("component_id", "doc_id").alias("component_id"))


def brute_force(documents: list[tuple], n: int = 5, percent: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs of true shingle sets; for tests."""
    sets = []
    for doc_id, text in documents:
        w = words_of(text)
        k = min(n, len(w))
        sets.append((doc_id, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, len(s), find(d)) for d, s in sets]

"""Cleanup candidates: long descriptions, near-duplicates, stale references and unused items."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.scalar import estimate_tokens, tokens
from vigilrow.operators.rules import once
from vigilrow.sources.shared import cut


def context_bloat(items: DataFrame, most: int = 200) -> DataFrame:
    """Items (item, description) of over `most` tokens; reclaim is the excess."""
    return items.select("item", estimate_tokens("description").alias("tokens")).filter(F.col("tokens") > most).withColumn("reclaim", F.col("tokens") - most)


def _levels(hashed: DataFrame, cells: int = 1 << 22) -> Broadcast[np.ndarray]:
    """How often tokens occur in hashed (hashes), as eight times the logarithm, by the last bits of their hash: a table of the same size for any input.

    0 is once. Tokens on one cell count together: their order is less apt for it, and still one order for all sets.
    """
    each = hashed.select(F.explode("hashes").alias("hash")).groupBy(F.col("hash").bitwiseAND(F.lit(cells - 1)).alias("cell"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            level = np.minimum(np.rint(8 * np.log2(b.n.to_numpy(np.float64))), 255).astype(np.uint8)
            yield pd.DataFrame({"cells": [b.cell.to_numpy(np.int32).tobytes()], "levels": [level.tobytes()]})

    levels = np.zeros(cells, np.uint8)
    for r in each.agg(F.count("*").alias("n")).mapInPandas(pack, "cells binary, levels binary").collect():
        levels[np.frombuffer(r.cells, np.int32)] = np.frombuffer(r.levels, np.uint8)
    return hashed.sparkSession.sparkContext.broadcast(levels)


def _by_rarity(levels: Broadcast[np.ndarray]) -> Callable:
    """Rows (key, hashes) as rows (key, hashes, df), hashes by rarity, df 1 for what occurs once."""

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                out = []
                for key, hashes in zip(batch.key[k : k + 1000], batch.hashes[k : k + 1000]):
                    h = np.asarray(hashes, np.int64)
                    level = levels.value[h & (len(levels.value) - 1)]
                    by = np.lexsort((h, level))
                    out.append((key, h[by], level[by].astype(np.int64) + 1))
                yield pd.DataFrame(out, columns=["key", "hashes", "df"])

    return order


def _marked(least: float, parts: int) -> Callable:
    """Rows (key, size, hashes, df), hashes by rarity, as rows (part, key, size, sketch, hashes, places): what of a prefix falls into a part."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, hashes, df in zip(batch.key, batch.hashes, batch.df):
                h, n = np.asarray(hashes, np.int64).view(np.uint64), len(hashes)
                bits = 64 << _tier(np.array([n]))[0]
                ones = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                sketch = np.packbits(ones.astype(np.uint8)).tobytes()
                at = np.flatnonzero(np.asarray(df)[: n - ceil(n * least - 1e-9) + 1] > 1)
                part = ((h[at] >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                for p in np.unique(part):
                    own = at[part == p]
                    # 32 bits do: two tokens on one number are one more pair to rule out
                    out.append((p, key, n, sketch, h[own].astype(np.uint32).tobytes(), (own + 1).astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["part", "key", "size", "sketch", "hashes", "places"])

    return mark


def _tier(sizes: np.ndarray) -> np.ndarray:
    """A sketch has 64 bits doubled so often that there are over 2.4 for each token."""
    return np.maximum(np.ceil(np.log2(np.maximum(sizes, 1) * 2.4 / 64)), 0).astype(np.int64)


def _loaded(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """Rows of _marked() as flat arrays; count is of tokens, words are those of a sketch."""
    n = rows["size"].to_numpy(np.int64)
    tokens, place, words = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("hashes", np.uint32), ("places", np.int32), ("sketch", np.uint64)))
    return {"key": rows.key.to_numpy(np.int64), "n": n, "count": rows.hashes.map(len).to_numpy(np.int64) // 4, "tokens": tokens, "place": place, "words": words}


def _from(rows: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The rows from the k-th on."""
    tokens, words = rows["count"][:k].sum(), (1 << _tier(rows["n"][:k])).sum()
    at = {"tokens": tokens, "place": tokens, "words": words}
    return {c: x[at.get(c, k) :].copy() for c, x in rows.items()}


def _apart(n: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """By how many tokens the sets left and right, which are no smaller, differ at least, as their sketches tell."""
    tier = _tier(n)
    at, apart = np.append(0, np.cumsum(1 << tier)), np.zeros(len(left), np.int64)
    for t in np.unique(tier[left]):
        for u in (t, t + 1):
            both = np.flatnonzero((tier[left] == t) & (tier[right] == u))
            step = max(1, (1 << 19) >> int(u))
            for k in range(0, len(both), step):
                some = both[k : k + step]
                x, y = words[at[left[some]][:, None] + np.arange(1 << t)], words[at[right[some]][:, None] + np.arange(1 << u)]
                y = y if u == t else y[:, : 1 << t] ^ y[:, 1 << t :]
                apart[some] = np.bitwise_count(x ^ y).sum(axis=1)
    return apart


def _near(rows: dict[str, np.ndarray], fresh: int, least: float, most: int) -> Iterator[np.ndarray]:
    """Pairs (a, b) of rows, which come by size, of which the second is the `fresh`-th or a later one, that share a token of both prefixes
    and may reach the limit by its places and by the sketches. `most` pairs are looked at at once."""
    key, n, share = rows["key"], rows["n"], least / (1 + least)
    if not len(rows["tokens"]):
        return
    order = np.argsort(rows["tokens"], kind="stable")
    tokens, doc = rows["tokens"][order], np.repeat(np.arange(len(n), dtype=np.int32), rows["count"])[order]
    begin = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(tokens))))
    del tokens
    size = n[doc]
    # as many tokens can be shared from this one on
    room = size - rows["place"][order] + 1
    # of the rows of a token those from `start` up to `end` are new, no smaller and no larger than this room allows
    wide = int(n.max()) + 1
    end = np.searchsorted(group * wide + size, group * wide + np.clip(np.floor((room + 1e-9) / share) - size, 0, wide - 1).astype(np.int64), "right")
    start = np.maximum(np.arange(len(doc)) + 1, (begin + np.add.reduceat((doc < fresh).astype(np.int64), begin))[group])
    count = np.maximum(end - start, 0)
    del group, end
    total = np.append(0, np.cumsum(count))
    found, held, lo = [], 0, 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        left = np.repeat(np.arange(lo, hi), count[lo:hi])
        right = np.arange(len(left)) + np.repeat(start[lo:hi] - total[lo:hi] + total[lo], count[lo:hi])
        fit = np.minimum(room[left], room[right]) >= np.ceil((size[left] + size[right]) * share - 1e-9)
        # one number a pair
        pair = np.unique(doc[left[fit]].astype(np.int64) * len(n) + doc[right[fit]])
        a, b = pair // len(n), pair % len(n)
        both = n[a] + n[b]
        found.append(pair[_apart(n, rows["words"], a, b) <= both - 2 * np.ceil(both * share - 1e-9)])
        held, lo = held + len(found[-1]), hi
        if held > most:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0])
        if held > most // 2 or lo == len(doc):
            pair, found, held = np.unique(np.concatenate(found)), [], 0
            for k in range(0, len(pair), 1 << 16):
                some = pair[k : k + (1 << 16)]
                yield np.sort(np.stack([key[some // len(n)], key[some % len(n)]], axis=1), axis=1)


def _met(least: float, most: int = 1 << 18) -> Callable:
    """The pairs (a, b) of a part that share a token of both prefixes and may reach the limit by its places and by the sketches."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = _near(_loaded(rows.sort_values("size", kind="stable")), 0, least, most)
        return pd.DataFrame(np.unique(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=0), columns=["a", "b"])

    return compare


def _met_by_size(least: float, tokens: int, most: int = 1 << 18) -> Callable:
    """_met() of rows sorted by part and size, of which `tokens` new ones are held at once and what of the ones before is not too small for them."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, new = None, None, []

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal held
            every = [held, *new] if held else new
            fresh = len(held["n"]) if held else 0
            rows = {c: np.concatenate([x[c] for x in every]) for c in every[0]}
            new.clear()
            held = None
            for pairs in _near(rows, fresh, least, most):
                yield pd.DataFrame(pairs, columns=["a", "b"])
            held = _from(rows, int(np.searchsorted(rows["n"], np.ceil(rows["n"][-1] * least - 1e-9))))

        for b in batches:
            of = b.part.to_numpy()
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(of))):
                if of[lo] != part:
                    if new:
                        yield from flush()
                    part, held = of[lo], None
                new.append(_loaded(b.iloc[lo:hi]))
                if sum(len(x["tokens"]) for x in new) >= tokens:
                    yield from flush()
        if new:
            yield from flush()

    return compare


def duplicate_pairs(items: DataFrame, least: float = 0.6, rows_a_part: int = 1 << 15) -> DataFrame:
    """Pairs a < b of items (item, description) whose token sets have at least this Jaccard similarity.

    Equal sets are one class, whose members are joined at the end. Classes meet by the rarest tokens of each: the prefix, of which a pair at
    the limit shares one; any one order of tokens is right, and a table of bounded size tells which are rare. Of the tokens that two sets
    share, behind the places of the first one must be enough to reach the limit. The parity of tokens by hashed bits then bounds from below
    how much two sets differ; both bounds are safe, and only what they leave is compared.
    A part of the tokens is one task, in which no pair is written before the bounds. The parts grow in number with the tokens of all prefixes, so that
    a part has about 64 times `rows_a_part` of them, and pass through their task by size: a set meets those before it that are not too small for it.
    """
    sets = once(items.select("item", "description"), t=tokens("description")).filter("size(t) > 0")
    # tokens have no comma; one string takes half of what an array of strings does
    sets = sets.select("item", F.size("t").alias("size"), F.array_join("t", ",").alias("t"))
    sets = cut(sets.withColumn("key", F.xxhash64(F.sha2(F.col("t").cast("binary"), 256))))
    classes = cut(sets.dropDuplicates(["key"]).select("key", "size", "t"))
    hashed = classes.select("key", F.transform(F.split("t", ","), lambda w: F.xxhash64(w)).alias("hashes"))
    levels, mark = _levels(hashed), "part long, key long, size int, sketch binary, hashes binary, places binary"
    prefixes = classes.agg(F.sum(F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)).first()[0] or 0
    parts = max(8, -(-int(prefixes) // (64 * rows_a_part)))
    marked = hashed.mapInPandas(lambda batches: _marked(least, parts)(_by_rarity(levels)(batches)), mark)
    dealt = marked.repartition(4 * parts, "part").sortWithinPartitions("part", "size")
    met = dealt.mapInPandas(_met_by_size(least, 16 * rows_a_part), "a long, b long").distinct()
    ta, tb = (classes.select(F.col("key").alias(k), F.col("t").alias(f"t{k}"), F.col("size").alias(f"n{k}")) for k in ("a", "b"))
    both = met.join(ta, "a").join(tb, "b").withColumn("shared", F.size(F.array_intersect(F.split("ta", ","), F.split("tb", ","))))
    both = both.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("all"))
    near = both.filter(F.col("shared") >= F.col("all") * least).select("a", "b", "shared", "all")
    near = near.union(classes.select("key", F.col("key").alias("b"), "size", F.col("size").alias("all")))
    ia, ib = (sets.select(F.col("key").alias(k), F.col("item").alias(f"i{k}")) for k in ("a", "b"))
    pairs = near.join(ia, "a").join(ib, "b").filter((F.col("a") != F.col("b")) & (F.col("ia") != F.col("ib")) | (F.col("ia") < F.col("ib")))
    return pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), F.col("shared").cast("long").alias("shared"), F.col("all").cast("long").alias("n_all"))


def stale_references(references: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("",)) -> DataFrame:
    """Per item the sorted targets (item, target) that lie under none of the roots in files (path)."""
    tried = references.select("item", "target", F.explode(F.array(*map(F.lit, roots))).alias("root")).withColumn("path", F.concat("root", "target"))
    found = tried.join(files.select("path").distinct(), "path", "left_semi").select("item", "target").distinct()
    missing = references.select("item", "target").distinct().join(found, ["item", "target"], "left_anti")
    return missing.groupBy("item").agg(F.count("*").alias("n_missing"), F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"))


def unused(items: DataFrame, usage: DataFrame) -> DataFrame:
    """Items without any use; if usage has `strict` rows at all, only those count as use."""
    calibrated = usage.agg(F.coalesce(F.max("strict"), F.lit(False))).first()[0]
    evidence = usage.filter("strict") if calibrated else usage
    return items.join(evidence.select("item").distinct(), "item", "left_anti")

"""Periodic runs of words: a suffix automaton whose ordered sets of end positions are merged small to large.

A run is a stretch of consecutive words with smallest period q and at least max(`shortest`, `times` * q) words that no neighbouring word
extends with that period. The sets of end positions of the automaton's states are merged up the suffix links, states of greater
length first, the smaller set into the greater. A position that comes in has two neighbours there; the words that end at both are
alike for exactly as many words as the state is long, since the state is where the two meet. So a distance d that is not above the
state's length seeds a square: a stretch of d + length words with period d, which no word on its left extends. It is a run if no word
on its right does either; else the pair of positions one further on seeds the same run. The ends of every run are neighbours where they
meet, as nothing between them can end the same words when q is the smallest period. Multiples of q seed the same stretch, of which the
smallest is kept.

An automaton is built only for stretches that can hold a run: every gram() words of a run, 8 here, occur twice in it, so words that belong
to no 8 words which occur twice in the stretch are cut out, until nothing more is. This is exact and done on arrays for a whole batch; a hash
that two such strings share only lets more through. A stretch is one document's or a part of it; its automaton takes about 100 bytes a word
and 150 more for each branch.

Rows don't depend on each other, so nothing is shuffled, and a lost executor costs its tasks.

Edge cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows are judged one by one; null ids are passed
on; extra columns stay, but for those named runs and collapsed; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose words are held at once.
CHUNK = 4_000_000
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class Automaton:
    """Suffix automaton of a sequence of ints. Most states have one transition, kept in two arrays; further ones are in `more`."""

    def __init__(self, words: list[int]):
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.word, self.next = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        #: the state of each prefix
        self.prefix = array("i")
        last = 0
        for w in words:
            last = self._add(last, w)
            self.prefix.append(last)

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1)
        self.next.append(-1)
        return len(self.length) - 1

    def _go(self, state: int, w: int) -> int:
        if self.word[state] == w:
            return self.next[state]
        branches = self.more.get(state)
        return -1 if branches is None else branches.get(w, -1)

    def _set(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (w, -1):
            self.word[state], self.next[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _add(self, last: int, w: int) -> int:
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and (q := self._go(p, w)) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p < 0:
            return new
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        split = self._state(self.length[p] + 1, self.link[q])
        self.word[split], self.next[split] = self.word[q], self.next[q]
        if q in self.more:
            self.more[split] = dict(self.more[q])
        while p >= 0 and self._go(p, w) == q:
            self._set(p, w, split)
            p = self.link[p]
        self.link[q] = self.link[new] = split
        return new


def runs_of(words: list[int], shortest: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    n, auto = len(words), Automaton(words)
    found: dict[tuple[int, int], int] = {}
    # sets hold the negative end positions in order: they come in from the back, so that most go to the end of a set
    ends: list[list[int] | None] = [None] * len(auto.length)
    for at, state in enumerate(auto.prefix):
        ends[state] = [-at]

    def seed(a: int, b: int, length: int) -> None:
        """The words that end at a < b are alike for `length` words."""
        d = b - a
        if d <= length and length + d >= max(shortest, times * d) and (b + 1 == n or words[a + 1] != words[b + 1]):
            stretch = (a - length + 1, b)
            if found.get(stretch, d + 1) > d:
                found[stretch] = d

    for state in np.argsort(-np.frombuffer(auto.length, np.int32), kind="stable").tolist():
        up, own = auto.link[state], ends[state]
        if up <= 0 or own is None:
            continue  # the root is the empty string
        ends[state] = None
        into = ends[up]
        if into is None:
            ends[up] = own
            continue
        if len(into) < len(own):
            into, own = own, into
        length = auto.length[up]
        # neighbours of the same set have met before, at a longer state
        for e in own:
            k = bisect_left(into, e)
            if k < len(into):
                seed(-into[k], -e, length)
            if k:
                seed(-e, -into[k - 1], length)
        if 16 * len(own) < len(into):
            for e in own:
                insort(into, e)
        else:
            into += own
            into.sort()  # two sorted parts are merged in one pass
        ends[up] = into
    return sorted((lo, hi - lo + 1, d) for (lo, hi), d in found.items())


def gram(shortest: int, times: int) -> int:
    """The most words g of which every string in a run occurs twice in it: a run is not shorter than 2 q + g - 1."""
    return max(1, min(8, shortest // 3)) if times >= 3 else 1


def _hashed(ids: np.ndarray, g: int) -> np.ndarray:
    """A hash of the g words from each place on, but for the last g - 1."""
    n = len(ids) - g + 1
    h = np.zeros(n, np.uint64)
    for k in range(g):
        h = (h + ids[k : n + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def stretches(ids: np.ndarray, starts: np.ndarray, shortest: int = 24, times: int = 3) -> list[tuple[int, int]]:
    """(from, to) of the stretches that can hold a run. ids: the words of many documents, a 0 behind each; starts: where
    each document starts.
    """
    g = gram(shortest, times)
    if len(ids) < max(g, shortest):
        return []
    hashes, first = _hashed(ids, g), np.zeros(len(ids), np.int64)
    first[starts] = 1
    part = first.cumsum()
    # strings that hold the end of a document are none
    alive = np.lib.stride_tricks.sliding_window_view(ids, g).min(axis=1) > 0
    part = part[: len(hashes)]
    while True:
        at = np.flatnonzero(alive)
        # strings of the same part: equal hashes are next to each other once sorted
        at = at[np.lexsort((hashes[at], part[at]))]
        same = (hashes[at[1:]] == hashes[at[:-1]]) & (part[at[1:]] == part[at[:-1]])
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        now = np.zeros(len(hashes) + 2, np.int8)
        now[at[twice] + 1] = 1
        step = np.diff(now)
        lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = hi - lo > shortest - g
        lo, hi = lo[long], hi[long]
        if (hi - lo).sum() == len(at):
            return list(zip(lo.tolist(), (hi + g - 1).tolist()))
        # what is left is looked at again, each stretch for itself
        edge = np.zeros(len(hashes) + 1, np.int64)
        edge[lo], edge[hi] = 1, -1
        alive, part = edge.cumsum()[:-1] > 0, (edge == 1).cumsum()[:-1]


def _judge(texts: list[bytes], shortest: int, times: int) -> tuple[list[list[dict]], list[bytes]]:
    """The runs and the collapsed text of each text of a batch."""
    split = [t.split() for t in texts]
    # one word that is no word stands behind each document
    starts = np.append(0, np.cumsum([len(w) + 1 for w in split]))
    known: dict[bytes, int] = {b"": 0}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in (*words, b"")), np.int32, int(starts[-1]))
    runs: list[list[dict]] = [[] for _ in texts]
    for lo, hi in stretches(ids, starts[:-1], shortest, times):
        doc = int(np.searchsorted(starts, lo, "right")) - 1
        at = lo - int(starts[doc])
        runs[doc] += [{"start": at + s, "length": n, "period": q} for s, n, q in runs_of(ids[lo:hi].tolist(), shortest, times)]
    collapsed = []
    for words, found in zip(split, runs):
        if found:
            found.sort(key=lambda r: (r["start"], r["period"]))
            gone = np.zeros(len(words) + 1, np.int64)
            for r in found:
                gone[r["start"] + r["period"]] += 1
                gone[r["start"] + r["length"]] -= 1
            words = [w for w, k in zip(words, gone.cumsum()) if not k]
        collapsed.append(b" ".join(words))
    return runs, collapsed


def find(documents: DataFrame, shortest: int = 24, times: int = 3) -> DataFrame:
    """The columns of documents with runs (RUN, by start, then period) and collapsed: the words that stay, joined by one space.

    A word goes if a run contains it behind the run's first period.
    """
    keep = [c for c in documents.columns if c not in ("text", "runs", "collapsed")]
    out = T.StructType([*documents.select(keep).schema.fields, T.StructField("runs", T.ArrayType(T._parse_datatype_string(RUN))), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            cuts = np.flatnonzero(np.diff(size // CHUNK, prepend=0)).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(size)]):
                if lo == hi:
                    continue
                runs, collapsed = _judge([t or b"" for t in texts[lo:hi].to_pylist()], shortest, times)
                own = [b.column(c)[lo:hi] for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(runs, kind), pa.array(collapsed, pa.binary()).view(pa.string())], [*keep, "runs", "collapsed"])

    return documents.select(*keep, "text").mapInArrow(run, out)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and the digests of what find() returns."""
    # the exact order of length / period by whole numbers: cross products, then the start, then the period
    def stronger(best: Column, r: Column) -> Column:
        mine, other = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best.isNull() | (mine > other) | ((mine == other) & (F.struct(r["start"], r["period"]) < F.struct(best["start"], best["period"]))), r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast(RUN), stronger)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    written = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(written.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

"""Suffix-array dedup: remove bytes that repeat from documents with a smaller doc_id.

A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller doc_id;
overlaps count, and all strings are judged on the input. Matches never cross documents.

Suffixes are sorted at anchors only. The anchor of a window of `width` bytes is the place in it of the
`gram`-byte string with the least hash, the leftmost one of equals. Equal windows have their anchors at
the same offset, so what repeats is found by comparing the surroundings of equal anchor strings:

1. anchors are dealt out by hash, and each batch of documents learns which of its anchor strings occur in
   another document; windows at other anchors cannot repeat;
2. the suffixes at the anchors that are left, followed by what comes before them in reverse, are sorted to
   runs, one per batch and bucket; equal ones become one entry with its places. Runs are exchanged in
   front-coded form: the length of the prefix shared with the entry before, and the rest;
3. every bucket merges its runs with a loser tree that carries the length of the prefix each head shares
   with the last winner: heads are told apart by these lengths, and where they are equal, comparison
   starts after the known prefix, so that no known prefix is compared again;
4. entries of one anchor string come out together. Of each of their windows the smallest doc_id is known
   then, and places in larger documents are covered. Covered bytes go back to the batches.

Batches lie in a table bucketed by batch, so that texts are not shuffled.

Edge cases: null and empty texts and texts under `width` bytes lose nothing; a row without a doc_id is
never removed from and removes from none; rows that repeat a doc_id do not remove from each other;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import materialize, mix, packed_batches, partitions, texts_of

#: Low bits of an anchor's key hold its place, so that of equal hashes the leftmost is the least.
_PLACE = 24
_CHUNK = (1 << _PLACE) - 1


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each place on; gram is a multiple of 8."""
    n = len(data) - gram + 1
    # eight bytes from each place on, read as they lie
    words = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,)).copy()
    out = mix(words[:n])
    for k in range(8, gram, 8):
        out = mix(out + words[k : k + n] * np.uint64(0x9FB21C651E98DF25))
    return out


def anchors(text: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of every anchor of a text, in order of place."""
    if len(text) < width:
        return tuple(np.empty(0, k) for k in (np.int64, np.uint64, np.int64, np.int64))
    parts = []
    # a chunk has the windows that start in it
    for base in range(0, len(text) - width + 1, _CHUNK - width):
        data = np.frombuffer(text, np.uint8)[base : base + _CHUNK]
        h = _gram_hashes(data, gram)
        key = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        span, have = width - gram + 1, 1
        while have < span:
            step = min(have, span - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        place = (key & np.uint64(_CHUNK)).astype(np.int64)
        place = place[: max(0, min(_CHUNK - width, len(text) - width + 1 - base))]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.empty(0, np.int64)
        last = np.append(first[1:], len(place)) - 1
        parts.append((place[first] + base, h[place[first]], first + base, last[: len(first)] + base))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _repeated(batches: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """Per batch the sorted hashes of its anchor strings that occur in two documents or more."""

    def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for r in b.itertuples():
                found = [np.unique(anchors(t, width, gram)[1]) for _, d, t in texts_of(r) if d is not None]
                h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
                bucket = _bucket(h, buckets)
                order = np.argsort(bucket, kind="stable")
                h, n = h[order], n[order]
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(k, r.batch, h[x:y].tobytes(), (n[x:y] > 1).tobytes()) for k, (x, y) in enumerate(zip(ends, ends[1:])) if y > x]
                yield pd.DataFrame(rows, columns=["bucket", "batch", "h", "several"])

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64) for x in g.h]
        h, several = np.concatenate(parts), np.concatenate([np.frombuffer(x, bool) for x in g.several])
        at, where, n = np.unique(h, return_inverse=True, return_counts=True)
        again = (n > 1)[where] | (np.bincount(where, several, len(at)) > 0)[where]
        ends = np.cumsum([len(p) for p in parts])
        return pd.DataFrame({"batch": g.batch, "again": [p[a].tobytes() for p, a in zip(parts, np.split(again, ends[:-1]))]})

    dealt = batches.mapInPandas(deal, "bucket long, batch long, h binary, several binary")
    answers = materialize(dealt.groupBy("bucket").applyInPandas(answer, "batch long, again binary").filter("length(again) > 0"), "answers")
    return answers.groupBy("batch").agg(F.collect_list("again").alias("again"))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) % np.uint64(buckets)).astype(np.int64)


def _key(text: bytes, place: int, first: int, last: int, width: int) -> bytes:
    """What follows an anchor within its windows, then what precedes it, reversed."""
    return text[place : last + width] + text[first:place][::-1]


def front_coded(entries: list[tuple[bytes, int, list[tuple]]]) -> tuple[bytes, bytes]:
    """(numbers, rest) of sorted entries (key, bytes before the anchor, places (document, id, anchor))."""
    rest, head, before = [], [], b""
    for key, left, places in entries:
        shared = _common(before, key, 0)
        rest.append(key[shared:])
        head += (shared, len(key) - shared, left, len(places))
        for p in places:
            head += p
        before = key
    return np.array(head, np.int64).tobytes(), b"".join(rest)


def _common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which `known` bytes are not looked at."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def decoded(numbers: bytes, rest: bytes, batch: int = 0) -> Iterator[tuple[int, bytes, int, list]]:
    """(prefix shared with the entry before, key, bytes before the anchor, places (batch << 32 | document, id, anchor)) of a run."""
    head, i, at, key, base = np.frombuffer(numbers, np.int64).tolist(), 0, 0, b"", batch << 32
    end = len(head)
    while i < end:
        shared, n, left, places = head[i : i + 4]
        key = key[:shared] + rest[at : at + n]
        at += n
        i += 4
        if places == 1:
            yield shared, key, left, [(base | head[i], head[i + 1], head[i + 2])]
        else:
            yield shared, key, left, [(base | head[k], head[k + 1], head[k + 2]) for k in range(i, i + 3 * places, 3)]
        i += 3 * places


class LoserTree:
    """Merges sorted runs of (shared prefix, key, ...); a head's prefix is the one it shares with the last winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, n = runs, 1
        while n < len(runs):
            n *= 2
        self.size = n
        self.heads: list = [next(r, None) for r in runs] + [None] * (n - len(runs))
        self.known = [0] * n  # with the last winner
        self.losers = [0] * n
        winners = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser then knows its prefix with the winner."""
        x, y, known = self.heads[a], self.heads[b], self.known
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        common = _common(x[1], y[1], known[a])
        if common == len(x[1]) or common < len(y[1]) and x[1][common] < y[1][common]:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    def __iter__(self) -> Iterator[tuple]:
        while (out := self.heads[self.winner]) is not None:
            yield out
            run = self.winner
            head = self.heads[run] = next(self.runs[run], None)
            self.known[run] = head[0] if head else 0
            node = (run + self.size) // 2
            while node:
                run, self.losers[node] = self._play(run, self.losers[node])
                node //= 2
            self.winner = run


def covered(entries: list[tuple[bytes, int, list]], width: int) -> Iterator[tuple[int, int, int, int]]:
    """(batch, document, start, end) of covered bytes, from all entries (key, left, places (batch << 32 | document, id, anchor)) of one anchor string.

    Entries of equal key and left may be several, if they come in succession.
    """
    whole: list[tuple[bytes, int, list]] = []
    for key, left, places in entries:
        if whole and whole[-1][1] == left and whole[-1][0] == key:
            whole[-1][2].extend(places)
        else:
            whole.append((key, left, list(places)))
    if len(whole) == 1:
        (key, left, places), = whole
        if len(places) > 1:
            least, n = min(p[1] for p in places), len(key) - left
            yield from ((p[0], p[2] - left, p[2] + n) for p in places if p[1] > least)
        return
    # windows are known by their bytes alone, which say where in them the anchor is
    owner: dict[bytes, int] = {}
    shared, listed = False, []
    for key, left, places in whole:
        right = len(key) - left
        text = key[right:][::-1] + key[:right]
        windows = [text[k : k + width] for k in range(len(text) - width + 1)]
        least = min(p[1] for p in places) if len(places) > 1 else places[0][1]
        for w in windows:
            known = owner.setdefault(w, least)
            if known != least:
                shared = True
                if least < known:
                    owner[w] = least
        listed.append((windows, least))
    for (key, left, places), (windows, least) in zip(whole, listed):
        if not shared and len(places) == 1:
            continue  # no other document has any of its windows
        own = [owner[w] for w in windows] if shared else [least] * len(windows)
        low, high = min(own), max(own)
        for where, doc_id, place in places:
            start = place - left
            if doc_id > high:
                yield where, start, start + len(key)
            elif doc_id > low:
                begin = None
                for k, o in enumerate(own):
                    if doc_id > o:
                        begin = k if begin is None else begin
                    elif begin is not None:
                        yield where, start + begin, start + k - 1 + width
                        begin = None
                if begin is not None:
                    yield where, start + begin, start + len(key)


def _coverage(batches: DataFrame, repeated: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """Per batch the covered spans of its documents: triples (document, start, end)."""

    def sort(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for r in b.itertuples():
                again = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in r.again]))
                runs: dict[int, dict] = defaultdict(dict)
                for k, doc_id, text in texts_of(r):
                    if doc_id is None:
                        continue
                    place, h, first, last = anchors(text, width, gram)
                    at = np.minimum(np.searchsorted(again, h), len(again) - 1)
                    mine = again[at] == h
                    for p, x, y, z in zip(*(v[mine].tolist() for v in (place, first, last)), _bucket(h[mine], buckets).tolist()):
                        run, entry = runs[z], (_key(text, p, x, y, width), p - x)
                        if entry in run:
                            run[entry].append((k, doc_id, p))
                        else:
                            run[entry] = [(k, doc_id, p)]
                rows = [(z, r.batch, *front_coded(sorted((key, left, places) for (key, left), places in run.items()))) for z, run in runs.items()]
                yield pd.DataFrame(rows, columns=["bucket", "batch", "numbers", "rest"])

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        spans: dict[int, list] = defaultdict(list)
        held: list = []

        def close() -> None:
            for where, start, end in covered(held, width):
                spans[where >> 32].append((where & 0xFFFFFFFF, start, end))
            held.clear()

        anchor = None
        for _, key, left, places in LoserTree([decoded(n, x, i) for i, (n, x) in enumerate(zip(g.numbers, g.rest))]):
            if anchor is None or not key.startswith(anchor):
                close()
                anchor = key[:gram]
            held.append((key, left, places))
        if held:
            close()
        rows = [(g.batch.iloc[i], zstandard.compress(np.array(_joined(x), np.int64).tobytes(), 1)) for i, x in spans.items()]
        return pd.DataFrame(rows, columns=["batch", "spans"])

    joined = batches.join(repeated, "batch").select("batch", "ids", "lengths", "data", "again")
    dealt = joined.mapInPandas(sort, "bucket long, batch long, numbers binary, rest binary")
    spans = materialize(dealt.groupBy("bucket").applyInPandas(merge, "batch long, spans binary"), "spans")
    return spans.groupBy("batch").agg(F.collect_list("spans").alias("spans"))


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same coverage with as few spans as can be."""
    out: list[tuple[int, int, int]] = []
    for doc, start, end in sorted(spans):
        if out and out[-1][0] == doc and start <= out[-1][2]:
            out[-1] = (doc, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((doc, start, end))
    return out


def dedup(documents: DataFrame, width: int = 50, gram: int = 16) -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes, [start, end)) and kept (the remaining bytes) of every row."""
    buckets = 2 * partitions(documents.sparkSession)
    batches = packed_batches(documents)
    spans = _coverage(batches, _repeated(batches, width, gram, buckets), width, gram, buckets)

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for r in b.itertuples():
                parts = [] if r.spans is None else [np.frombuffer(zstandard.decompress(x), np.int64).reshape(-1, 3) for x in r.spans]
                own: dict[int, list] = defaultdict(list)
                for doc, start, end in _joined([tuple(x) for p in parts for x in p.tolist()]):
                    own[doc].append((start, end))
                rows = []
                for k, doc_id, text in texts_of(r):
                    at, kept = 0, []
                    for start, end in own[k]:
                        kept.append(text[at:start])
                        at = end
                    kept.append(text[at:])
                    rows.append((doc_id, len(text), [{"start": s, "end": e} for s, e in own[k]], b"".join(kept)))
                    if len(rows) == 256:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "removed", "kept"]).astype({"doc_id": "Int64"})

    joined = batches.join(spans, "batch", "left").select("ids", "lengths", "data", "spans")
    return joined.mapInPandas(cut, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """Counts, and the digest of the remaining bytes."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(documents: list[tuple], width: int = 50) -> list[tuple]:
    """The rows of digest() by comparing all strings; for tests."""
    least: dict[bytes, int] = {}
    rows = [(d, (t or "").encode("utf-8", "surrogatepass")) for d, t in documents]
    for d, t in rows:
        for k in range(len(t) - width + 1):
            least[t[k : k + width]] = min(d, least.get(t[k : k + width], d))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if least[t[k : k + width]] < d:
                gone[k : k + width] = True
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0])), hashlib.sha256(kept).hexdigest()))
    return out

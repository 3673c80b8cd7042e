"""Language identification: a linear-chain conditional random field labels every word of a text.

Emission features of a word are hashed: its first and last one to three characters (affixes), its
two- and three-character n-grams with word ends, and for each language whether the word is among that
language's most frequent training words (lexicon). A run of over LONG characters, as in texts without spaces,
is several words in succession, so that all of it counts. Transitions and start scores are learned too, so that a
label holds on through words that could be of several languages and changes where a text switches. Labels
of words are marginals by forward-backward; a text's language is the one with the largest mean marginal,
and that mean is the score.

Training takes at most about `max_rows` labelled texts, chosen by a hash of doc_id; every word gets its
text's label. Shards of the sample make AdaGrad steps on the log-likelihood; their weights are averaged
after each round.

Edge cases: a text that is null or has no letter is `und` with score 0; texts with a null label are not
learned from; without training texts everything is `und`; repeated rows are predicted each; extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import LOWER, bounded_sample, materialize

_WORDS = bytes(LOWER[b] if chr(b).isascii() and chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))
#: Characters of a word; texts without spaces are runs of more.
LONG = 64
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    bits: int = 15
    rounds: int = 3
    shards: int = 6
    max_rows: int = 3000
    step: float = 0.3
    lexicon: int = 200
    cells: int = 200_000  # words of texts that run through the chain together


@dataclass
class Model:
    labels: list[str]
    emission: np.ndarray  # (2**bits, labels)
    transition: np.ndarray  # (labels, labels)
    start: np.ndarray
    lexicon: dict[bytes, tuple[int, ...]]


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    if max(map(len, words), default=0) > LONG:
        words = [piece for w in words for piece in pieces(w)]
    return words


def pieces(word: bytes) -> list[bytes]:
    """A run of over LONG characters in parts, each with the last two characters of the one before: no n-gram is lost."""
    w = word.decode("utf-8", "replace")
    return [word] if len(w) <= LONG else [w[k : k + LONG].encode() for k in range(0, len(w) - 2, LONG - 2)]


def features(word: bytes, lexicon: dict[bytes, tuple[int, ...]], bits: int) -> list[int]:
    w = word.decode("utf-8", "replace")
    names = [f"^{w[:k]}" for k in (1, 2, 3) if k <= len(w)] + [f"{w[-k:]}$" for k in (1, 2, 3) if k <= len(w)]
    w = f" {w} "
    names += [w[k : k + 2] for k in range(len(w) - 1)] + [w[k : k + 3] for k in range(len(w) - 2)]
    names += [f"#lexicon {k}" for k in lexicon.get(word, ())]
    return [zlib.crc32(x.encode()) >> (32 - bits) for x in names]


class _Words:
    """Numbers words as they come; per word its features and, for a model, its emission scores."""

    def __init__(self, m: Model, bits: int, most: int = 200_000):
        self.m, self.bits, self.most = m, bits, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.features: list[np.ndarray] = []
        self.scores = np.empty((0, len(self.m.labels)))

    def of(self, texts: list[list[bytes]], keep: bool) -> list[np.ndarray]:
        if len(self.number) > self.most:
            self.clear()
        new = []
        out = []
        for words in texts:
            for w in words:
                if w not in self.number:
                    self.number[w] = len(self.number)
                    new.append(w)
            out.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        if new:
            f = [features(w, self.m.lexicon, self.bits) for w in new]
            if keep:
                self.features += [np.array(x, np.int64) for x in f]
            flat = np.fromiter((y for x in f for y in x), np.int64)
            starts = np.cumsum([0, *map(len, f)])[:-1]
            self.scores = np.concatenate([self.scores, np.add.reduceat(self.m.emission[flat], starts, axis=0)])
        return out


def marginals(m: Model, scores: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text (emission scores of its words) the labels' marginals; the expected transitions of all."""
    k = len(m.labels)
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    steps = int(lengths[0])
    e = np.zeros((steps, len(order), k))
    for j, i in enumerate(order):
        e[: lengths[j], j] = scores[i]
    e = np.exp(e - e.max(axis=2, keepdims=True))
    trans = np.exp(m.transition - m.transition.max())
    alpha, beta, norm = np.empty_like(e), np.ones_like(e), np.ones((steps, len(order), 1))
    active = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)  # longest first
    a = np.exp(m.start - m.start.max()) * e[0]
    for t in range(steps):
        n = active[t]
        if t:
            a = (alpha[t - 1, :n] @ trans) * e[t, :n]
        c = a.sum(axis=1, keepdims=True)
        alpha[t, :n] = a / c
        norm[t, :n] = c
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        beta[t, :n] = ((e[t + 1, :n] * beta[t + 1, :n]) @ trans.T) / norm[t + 1, :n]
    moves = np.zeros((k, k))
    for t in range(1, steps):
        n = active[t]
        moves += alpha[t - 1, :n].T @ (e[t, :n] * beta[t, :n] / norm[t, :n])
    gamma = alpha * beta
    out: list = [None] * len(order)
    for j, i in enumerate(order):
        g = gamma[: lengths[j], j]
        out[i] = g / g.sum(axis=1, keepdims=True)
    return out, moves * trans


def _groups(lengths: list[int], cells: int) -> Iterator[list[int]]:
    """Texts with at least one word, of like length, so that a group has about `cells` places."""
    held: list[int] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i]):
        if held and (len(held) + 1) * lengths[held[0]] > cells:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def train(documents: DataFrame, usable: Column, s: Settings = Settings()) -> Model:
    """A model learned from text and lang of the documents for which `usable` (over doc_id) holds."""
    rows = documents.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(usable)
    data = materialize(bounded_sample(rows, "doc_id", s.max_rows).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(s.shards))), "language")
    labels = sorted(r.lang for r in data.select("lang").distinct().collect())
    if not labels:
        return Model([], np.empty((0, 0)), np.empty((0, 0)), np.empty(0), {})

    def frequent(group: pd.DataFrame) -> pd.DataFrame:
        counts = Counter(w for t in group.text for w in words_of(t))
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: s.lexicon]
        return pd.DataFrame({"lang": group.lang.iloc[0], "word": [w for w, _ in best]})

    lexicon: dict[bytes, tuple[int, ...]] = {}
    for r in data.groupBy("lang").applyInPandas(frequent, "lang string, word binary").collect():
        lexicon[bytes(r.word)] = (*lexicon.get(bytes(r.word), ()), labels.index(r.lang))
    k = len(labels)
    m = Model(labels, np.zeros((1 << s.bits, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    for number in range(s.rounds):
        now = m

        def learn(group: pd.DataFrame) -> pd.DataFrame:
            m = Model(labels, now.emission.copy(), now.transition.copy(), now.start.copy(), lexicon)
            group = group.sort_values("doc_id", kind="stable").reset_index(drop=True)
            _learn(m, group, s, number)
            return pd.DataFrame({"model": [np.concatenate([m.emission.ravel(), m.transition.ravel(), m.start]).astype(np.float32).tobytes()]})

        # as many rows as shards, each of the model's fixed size
        found = [np.frombuffer(r.model, np.float32) for r in data.groupBy("shard").applyInPandas(learn, "model binary").collect()]
        flat = np.mean(found, axis=0, dtype=np.float64)
        size = k << s.bits
        m = Model(labels, flat[:size].reshape(-1, k), flat[size : size + k * k].reshape(k, k), flat[size + k * k :], lexicon)
    return m


def _learn(m: Model, group: pd.DataFrame, s: Settings, number: int) -> None:
    k = len(m.labels)
    words = _Words(m, s.bits, most=10**9)
    texts = words.of([words_of(t) for t in group.text], keep=True)
    gold = [m.labels.index(x) for x in group.lang]
    counts = np.array([len(f) for f in words.features])
    flat = np.concatenate(words.features) if words.features else np.empty(0, np.int64)
    starts = np.cumsum(counts) - counts
    squares = [np.full(x.shape, 1e-6) for x in (m.emission, m.transition, m.start)]
    order = np.random.default_rng(number).permutation(len(texts))
    for at in range(0, len(order), 32):
        batch = [i for i in order[at : at + 32] if len(texts[i])]
        if not batch:
            continue
        used, where = np.unique(np.concatenate([texts[i] for i in batch]), return_inverse=True)
        own = np.concatenate([flat[starts[w] : starts[w] + counts[w]] for w in used])
        of = np.repeat(np.arange(len(used)), counts[used])
        scores = np.zeros((len(used), k))
        np.add.at(scores, of, m.emission[own])
        ends = np.cumsum([len(texts[i]) for i in batch])
        parts = np.split(where, ends[:-1])
        g, moves = marginals(m, [scores[p] for p in parts])
        wrong, start, total = np.zeros((len(used), k)), np.zeros(k), 0
        for i, p, x in zip(batch, parts, g):
            d = -x
            d[:, gold[i]] += 1
            np.add.at(wrong, p, d)
            start += d[0]
            moves[gold[i], gold[i]] -= len(p) - 1
            total += len(p)
        gradient = np.zeros_like(m.emission)
        np.add.at(gradient, own, wrong[of])
        for x, q, d in zip((m.emission, m.transition, m.start), squares, (gradient / total, -moves / total, start / len(batch))):
            q += d * d
            x += s.step * d / np.sqrt(q)


def predict(documents: DataFrame, m: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        words = _Words(m, s.bits)
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                texts = [words_of(t) if m.labels and t and _LETTER.search(t) else [] for t in part.text]
                numbers = words.of(texts, keep=False)
                lang, score = ["und"] * len(part), np.zeros(len(part))
                for group in _groups([len(t) for t in texts], s.cells):
                    g, _ = marginals(m, [words.scores[numbers[i]] for i in group])
                    for i, x in zip(group, g):
                        mean = x.mean(axis=0)
                        lang[i], score[i] = m.labels[int(mean.argmax())], min(1.0, float(mean.max()))
                yield pd.DataFrame({"doc_id": part.doc_id, "lang_pred": lang, "score": score})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")

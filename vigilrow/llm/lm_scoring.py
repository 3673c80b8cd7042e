"""LM scoring: a hashed maximum-entropy model of the next token with class-factored softmax.

Tokens are runs of non-white-space bytes, A-Z lower-cased; every text ends with one end token. The model
says p(token | history) = p(class | history) * p(token | class, history). The most frequent training tokens,
side * side of them, are dealt to `side` classes of like mass; all others are dealt by hash to `side` more
classes, whose members keep their smoothed unigram shares of the class. So every token's probability depends
on its history. Features of a history are the previous token, the token before it (a skip), both together,
and a bias; each kind has a third of the rows of weights, hashed where it has more values than rows, and a
token outside the list counts as one of `rare_rows` hashed ones. Weights start at zero, where the model is the
smoothed unigram distribution, which is its base measure; so the model is proper over the same events.

The model grows with the corpus: listed words with the square root of its tokens, as vocabularies do, and
weights in proportion to them up to `most_weights`, which bounds what is broadcast (Settings.of). Beyond that
more rows share weights; listed words and classes go on growing up to MOST_SIDE.

Counts cover every training document: tokens are counted per batch, dealt to buckets by hash, summed
there, and each bucket answers each batch, so that what moves grows with the corpus and no task or driver
holds a whole vocabulary. Weights are trained by distributed gradient updates: each round, tasks make
AdaGrad steps, with one rate for a row of weights, on their share of the training documents and return what changed, in 16-bit floats, which is averaged per
block of weights; over all rounds, every training document is used once. Scoring works in batches of
numpy rows.

Edge cases: null and empty texts have the end token alone; without training documents every score is that
of an unseen token; repeated rows count and are scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import LOWER, Hashes, materialize, mix, packed_batches, partitions, texts_of

#: The end token, which no text can contain.
END = b"\n"


#: The largest side: 262,144 listed words.
MOST_SIDE = 512

#: Tokens that are scored at a time; their scores fit a core's cache.
CHUNK = 2048

#: Unlisted tokens are counted in this many cells of their hashes, from which their classes follow.
CELLS = 4096


@dataclass(frozen=True)
class Settings:
    side: int = 16  # classes of listed words, members of each, and classes of the other tokens
    rare_rows: int = 256
    weights: int = 1 << 20
    rounds: int = 3
    least_shards: int = 12
    step: float = 0.15
    minibatch: int = 4096

    @staticmethod
    def of(tokens: int, least_weights: int = 1 << 20, most_weights: int = 1 << 24) -> Settings:
        """The settings for a number of training tokens."""
        side = min(max(16, round(tokens**0.25 / 3)), MOST_SIDE)
        return Settings(side, min(16 * side, CELLS), min(max(tokens // 8, least_weights), most_weights))

    @property
    def words(self) -> int:
        return self.side**2

    @property
    def kind_rows(self) -> int:
        """Rows of each of the three kinds of features; heads have a quarter of the weights at most."""
        return max(self.weights // (24 * self.side), 8)

    @property
    def rows(self) -> int:
        """Feature rows: bias, previous, skip, both."""
        return 1 + 3 * self.kind_rows

    @property
    def inner_rows(self) -> int:
        """Rows of weights for the members of a class after a feature; hashed if there are fewer than pairs of these."""
        return min(self.rows * self.side, max((self.weights - 2 * self.side * self.rows) // self.side, 8))


def tokens_of(text: bytes) -> list[bytes]:
    words = text.translate(LOWER).split()
    words.append(END)
    return words


def _cells(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(CELLS)).astype(np.int64)


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by bucket and hash, and where buckets end; a batch and its answers agree on it."""
    bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _vocabulary(batches: DataFrame, buckets: int) -> DataFrame:
    """Per batch and bucket the counts, over all training documents, of the batch's distinct tokens in order
    of their hashes; and, as batch -1, each bucket's totals, most frequent tokens and smoothed mass by cell, in halves.
    """

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for r in b.itertuples():
                own, other = Counter(), set()
                for k, _, text in texts_of(r):
                    if r.flags[k]:
                        own.update(tokens_of(text))
                    else:
                        other.update(tokens_of(text))
                words = list(own) + [w for w in other if w not in own]
                h = Hashes(most=10**9).of(words)
                n = np.zeros(len(h), np.uint32)
                n[: len(own)] = np.fromiter(own.values(), np.uint32, len(own))
                order, ends = _by_bucket(h, buckets)
                h, n = h[order], n[order]
                rows = [(k, r.batch, h[x:y].tobytes(), zlib.compress(n[x:y].tobytes(), 1)) for k, (x, y) in enumerate(zip(ends, ends[1:])) if y > x]
                yield pd.DataFrame(rows, columns=["bucket", "batch", "h", "n"])

    def total(g: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in g.h])
        n = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint32) for x in g.n]).astype(np.int64)
        at, where = np.unique(h, return_inverse=True)
        c = np.bincount(where, n, len(at)).astype(np.int64)
        each = np.split(c[where], np.cumsum([len(x) // 8 for x in g.h])[:-1])
        back = pd.DataFrame({"batch": g.batch, "bucket": g.bucket, "h": None, "c": [zlib.compress(x.tobytes(), 1) for x in each], "tokens": 0, "distinct": 0, "halves": None})
        often = np.argsort(-c, kind="stable")[:often_most]
        halves = np.bincount(_cells(at), np.where(c > 0, 2 * c + 1, 0), CELLS).astype(np.int64)
        top = pd.DataFrame({"batch": [-1], "bucket": g.bucket.iloc[:1].to_numpy(), "h": [at[often].tobytes()], "c": [c[often].tobytes()], "tokens": [int(c.sum())], "distinct": [int((c > 0).sum())], "halves": [halves]})
        return pd.concat([top, back])

    often_most = max(8192, 4 * MOST_SIDE**2 // buckets)  # hashes deal the most frequent tokens evenly
    dealt = batches.mapInPandas(count, "bucket long, batch long, h binary, n binary")
    return materialize(dealt.groupBy("bucket").applyInPandas(total, "batch long, bucket long, h binary, c binary, tokens long, distinct long, halves array<long>"), "vocabulary")


@dataclass
class Model:
    settings: Settings
    tokens: int
    distinct: int
    hashes: np.ndarray  # of the listed words, sorted
    place: np.ndarray  # class * members + member of each of them
    log_class: np.ndarray
    log_word: np.ndarray
    rest: np.ndarray  # smoothed mass of the other tokens by class
    weights: np.ndarray  # those of heads, then of members

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The place of each token or, above `words`, the hashed row of a token outside the list."""
        code = rare_codes(h, self.settings)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            code = np.where(self.hashes[at] == h, self.place[at], code)
        return code

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of all classes (rows, 2 * side) and of members (inner_rows, side)."""
        s = self.settings
        cut = s.rows * 2 * s.side
        return self.weights[:cut].reshape(s.rows, -1).copy(), self.weights[cut:].reshape(s.inner_rows, s.side).copy()


def rare_codes(h: np.ndarray, s: Settings) -> np.ndarray:
    """Codes of tokens outside the list, by their cells. Code `words` is left to tokens that training never
    saw, and the last code to the places before a text.
    """
    return s.words + 1 + _cells(h) % (s.rare_rows - 2)


class Codes(dict):
    """The codes of words, kept while there are few enough of them."""

    def __init__(self, m: Model, most: int = 400_000):
        super().__init__()
        self.known, self.most, self.s = dict(zip(m.hashes.tolist(), m.place.tolist())), most, m.settings

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word, 0)
        place = self.known.get(h)
        value = self[word] = self.s.words + 1 + (h >> 20) % CELLS % (self.s.rare_rows - 2) if place is None else place
        return value


def _base_model(vocabulary: DataFrame, settings: Settings | None) -> Model:
    """The model with zero weights, from the most frequent tokens of all buckets."""
    heads = vocabulary.filter("batch = -1").select("h", "c", "tokens", "distinct", "halves")
    tokens, distinct = (int(x or 0) for x in heads.agg(F.sum("tokens"), F.sum("distinct")).first())
    s = settings or Settings.of(tokens)

    def top(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, c = np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in it:
            h = np.concatenate([h, *(np.frombuffer(x, np.uint64) for x in b.h)])
            c = np.concatenate([c, *(np.frombuffer(x, np.int64) for x in b.c)])
            best = np.lexsort((h, -c))[: s.words]
            h, c = h[best], c[best]
        yield pd.DataFrame({"h": h.astype(np.int64), "c": c.astype(np.int64)})

    def add(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"halves": [sum((np.asarray(x) for b in it for x in b.halves), np.zeros(CELLS, np.int64))]})

    found = heads.select("h", "c").mapInPandas(top, "h long, c long").orderBy(F.desc("c"), "h").limit(s.words).toPandas()
    h, c = found.h.to_numpy(np.int64).astype(np.uint64), found.c.to_numpy(np.int64)
    h, c = h[c > 0], c[c > 0]
    halves = np.zeros(CELLS, np.int64)
    for r in heads.select("halves").coalesce(64).mapInPandas(add, "halves array<long>").collect():  # 64 rows of CELLS numbers at most
        halves += np.array(r.halves)
    np.subtract.at(halves, _cells(h), 2 * c + 1)
    return base(s, tokens, distinct, h, c, halves)


def base(s: Settings, tokens: int, distinct: int, h: np.ndarray, c: np.ndarray, halves: np.ndarray) -> Model:
    """The model with zero weights; h, c: hashes and counts of listed words by rank, halves: twice the
    smoothed mass of all other seen tokens by cell.
    """
    rank = np.arange(len(h))
    # dealt in turn by rank, so that classes have like mass
    place = (rank % s.side) * s.side + rank // s.side
    mass = np.zeros(s.words)
    mass[place] = c + 0.5
    by_class = mass.reshape(s.side, s.side).sum(axis=1)
    rest = np.bincount((1 + np.arange(CELLS) % (s.rare_rows - 2)) % s.side, halves / 2, s.side)
    rest[0] += 0.5  # the tokens that training never saw
    with np.errstate(divide="ignore"):
        log_class = np.log(np.append(by_class, rest) / (mass.sum() + rest.sum()))
        log_word = np.log(mass) - np.repeat(np.log(np.maximum(by_class, 1e-300)), s.side)
    order = np.argsort(h)
    finite = lambda x: np.where(np.isfinite(x), x, -1e9)
    zero = np.zeros(s.rows * 2 * s.side + s.inner_rows * s.side, np.float32)
    return Model(s, tokens, distinct, h[order], place[order], finite(log_class), finite(log_word), rest, zero)


def _history(code: np.ndarray, start: np.ndarray, s: Settings) -> np.ndarray:
    """Feature rows (previous, skip, both) of every token; start: where texts begin. The bias is row 0."""
    size, kind = s.words + s.rare_rows, s.kind_rows
    none = size - 1
    one = np.append(none, code[:-1])
    one[start] = none
    two = np.append(none, one[:-1])
    two[start] = none

    def hashed(x: np.ndarray) -> np.ndarray:
        return (mix(x.astype(np.uint64)) % np.uint64(kind)).astype(np.int64)

    both = hashed(one * (1 << 21) + two)
    if size > kind:
        one, two = hashed(one), hashed(two)
    return np.stack([1 + one, 1 + kind + two, 1 + 2 * kind + both])


def _class_of(code: np.ndarray, s: Settings) -> np.ndarray:
    return np.where(code < s.words, code // s.side, s.side + (code - s.words) % s.side)


def _inner(rows: np.ndarray, cls: np.ndarray, s: Settings) -> np.ndarray:
    """The rows of weights for the members of a class after each feature."""
    pair = rows * s.side + cls
    if s.rows * s.side > s.inner_rows:
        pair = (mix(pair.astype(np.uint64)) % np.uint64(s.inner_rows)).astype(np.int64)
    return pair


def _scores(m: Model, rows: np.ndarray, code: np.ndarray, heads: np.ndarray, inner: np.ndarray):
    """Scores of the classes of each token; which tokens are listed, the rows of their members, the scores of these."""
    s = m.settings
    x = np.take(heads, rows[0], axis=0)
    x += np.take(heads, rows[1], axis=0)
    x += np.take(heads, rows[2], axis=0)
    x += (heads[0] + m.log_class).astype(np.float32)
    listed = np.flatnonzero(code < s.words)
    cls = code[listed] // s.side
    r = _inner(np.concatenate([np.zeros((1, len(listed)), np.int64), rows[:, listed]]), cls, s)
    y = np.take(inner, r[0], axis=0)
    for k in r[1:]:
        y += np.take(inner, k, axis=0)
    y += np.take(m.log_word.astype(np.float32).reshape(s.side, s.side), cls, axis=0)
    return x, listed, r, y


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _sums(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in `of` and for each the sum of its rows of values."""
    if of.max() < 1 << 16:
        of = of.astype(np.uint16)  # sorted by digits, not by comparison
    order = np.argsort(of, kind="stable")
    of = of[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(first, len(of)))
    out = np.take(values, order[first], axis=0)
    # most numbers are rare: their first rows are added all at once, and only what is left of frequent ones by segments
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        out[more] += np.take(values, order[first[more] + k], axis=0)
    many = np.flatnonzero(sizes > 4)
    if len(many):
        left = sizes[many] - 4
        ends = np.cumsum(left)
        rest = np.arange(ends[-1]) + np.repeat(first[many] + 4 - (ends - left), left)
        out[many] += np.add.reduceat(np.take(values, order[rest], axis=0), ends - left, axis=0)
    return of[first].astype(np.int64), out


def _learn(m: Model, rows: np.ndarray, code: np.ndarray, weights: tuple, squares: tuple) -> None:
    """AdaGrad steps on minibatches of tokens, in place; weights as Model.parts() gives them, squares: one for each of their rows."""
    s = m.settings
    def step(w: np.ndarray, q: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
        q[at] = own = q[at] + np.einsum("ij,ij->i", g, g) / g.shape[1]
        g *= (s.step / np.sqrt(own + 1e-8))[:, None]
        w[at] = np.take(w, at, axis=0) - g

    for at in range(0, code.size, s.minibatch):
        r, c = rows[:, at : at + s.minibatch], code[at : at + s.minibatch]
        p, listed, inner, q = _scores(m, r, c, *weights)
        p, q = _softmax(p), _softmax(q)
        p[np.arange(len(c)), _class_of(c, s)] -= 1
        q[np.arange(len(listed)), c[listed] % s.side] -= 1
        p /= len(c)
        q /= len(c)
        for f, g in [(np.zeros(1, np.int64), p.sum(axis=0, keepdims=True)), *(_sums(x, p) for x in r)]:
            step(weights[0], squares[0], f, g)
        if len(listed):
            for f in inner:
                step(weights[1], squares[1], *_sums(f, q))


def train(batches: DataFrame, m: Model) -> Model:
    """The model with learned weights."""
    s, sc = m.settings, batches.sparkSession.sparkContext
    blocks = [slice(x, y) for x, y in pairwise(np.linspace(0, len(m.weights), 17).astype(int).tolist())]
    shards = max(s.least_shards, partitions(batches.sparkSession) // 4)
    slots = int(shards**0.5) if shards > 32 else 1  # the changes of many shards are averaged in two steps, so that none gathers all
    schema = "block int, slot int, seen long, change binary"
    for k in range(s.rounds):
        now = sc.broadcast(m)

        def learn(it: Iterator[pd.DataFrame], k=k, now=now) -> Iterator[pd.DataFrame]:
            m, seen = now.value, 0
            codes, weights = Codes(m), m.parts()
            squares = tuple(np.zeros(len(x), np.float32) for x in weights)
            for b in it:
                for r in b.itertuples():
                    own = [tokens_of(t) for i, _, t in texts_of(r) if r.flags[i] and (i + r.batch) % s.rounds == k]
                    for at in range(0, len(own), 64):
                        part = own[at : at + 64]
                        lengths = np.array([len(t) for t in part])
                        code = np.fromiter(map(codes.__getitem__, chain.from_iterable(part)), np.int64, lengths.sum())
                        _learn(m, _history(code, np.cumsum(lengths) - lengths, s), code, weights, squares)
                        seen += len(code)
            if seen:
                change = (np.concatenate([x.ravel() for x in weights]) - m.weights).astype(np.float16)
                slot = TaskContext.get().partitionId() % slots
                yield pd.DataFrame({"block": range(len(blocks)), "slot": slot, "seen": seen, "change": [change[x].tobytes() for x in blocks]})

        def average(g: pd.DataFrame) -> pd.DataFrame:
            total = reduce(np.add, (np.frombuffer(c, np.float16).astype(np.float64) * n for c, n in zip(g.change, g.seen)))
            return pd.DataFrame({"block": g.block.iloc[:1], "slot": g.slot.iloc[:1], "seen": [int(g.seen.sum())], "change": [(total / g.seen.sum()).astype(np.float16).tobytes()]})

        changed = batches.coalesce(shards).mapInPandas(learn, schema)
        changed = changed.groupBy("block", "slot").applyInPandas(average, schema)
        if slots > 1:
            changed = changed.groupBy("block").applyInPandas(average, schema)
        weights = m.weights.copy()
        for r in changed.collect():  # 16 rows, together the size of the weights
            weights[blocks[r.block]] += np.frombuffer(r.change, np.float16)
        now.unpersist()
        m = Model(s, m.tokens, m.distinct, m.hashes, m.place, m.log_class, m.log_word, m.rest, weights)
    return m


def score(batches: DataFrame, vocabulary: DataFrame, buckets: int, m: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    shared = batches.sparkSession.sparkContext.broadcast(m)
    answers = vocabulary.filter("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("bucket", "c")).alias("answers"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        whole, parts = m.tokens + 0.5 * (m.distinct + 1), m.parts()
        for b in it:
            for r in b.itertuples():
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                lengths, texts = [], []
                for _, _, t in texts_of(r):
                    words = tokens_of(t)
                    lengths.append(len(words))
                    texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                h = np.fromiter((xxhash.xxh3_64_intdigest(w, 0) for w in number), np.uint64, len(number))
                n = np.empty(len(h))
                n[_by_bucket(h, buckets)[0]] = np.concatenate([np.frombuffer(zlib.decompress(x["c"]), np.int64) for x in sorted(r.answers, key=lambda x: x["bucket"])])
                got, start = np.concatenate(texts), np.cumsum(lengths) - lengths
                code, base = np.where(n > 0, m.codes(h), m.settings.words), np.log10((n + 0.5) / whole)
                rare = np.log((n + 0.5) / m.rest[_class_of(code, m.settings) % m.settings.side])
                own = code[got]
                rows = _history(own, start, m.settings)
                model = np.concatenate([_log_model(m, rows[:, x : x + CHUNK], own[x : x + CHUNK], rare[got[x : x + CHUNK]], parts) for x in range(0, len(got), CHUNK)])
                known, base, model = (np.add.reduceat(v, start) for v in ((n > 0).astype(np.int64)[got], base[got], model))
                ids = pd.array([None if pd.isna(x) else int(x) for x in r.ids], "Int64")
                yield pd.DataFrame({"doc_id": ids, "n_tokens": lengths, "n_known": known, "train_tokens": m.tokens, "base_score": base, "score": model / np.log(10)})

    return batches.join(answers, "batch").select("ids", "lengths", "data", "answers").mapInPandas(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _log_model(m: Model, rows: np.ndarray, code: np.ndarray, rare: np.ndarray, parts: tuple) -> np.ndarray:
    """Natural log of each token's probability; rare: its smoothed share of its class if it is outside the list."""
    s = m.settings
    x, listed, cls, y = _scores(m, rows, code, *parts)

    def chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        x -= x.max(axis=1, keepdims=True)
        own = x[np.arange(len(x)), at].astype(np.float64)
        np.exp(x, out=x)
        return np.maximum(own, -69.0) - np.log(x.sum(axis=1))

    log = chosen(x, _class_of(code, s))
    log[listed] += chosen(y, code[listed] % s.side)
    other = code >= s.words
    log[other] += rare[other]
    return log


def fit_and_score(documents: DataFrame, train_rows: Column, s: Settings | None = None) -> DataFrame:
    """Learn from the documents for which train_rows holds, then score every document; settings follow their tokens."""
    batches, buckets = packed_batches(documents, train_rows), 2 * partitions(documents.sparkSession)
    vocabulary = _vocabulary(batches, buckets)
    m = train(batches, _base_model(vocabulary, s))
    return score(batches, vocabulary, buckets, m)

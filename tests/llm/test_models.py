"""LM scoring, language identification and toxicity: exact counts, proper models and held-out quality."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
from helpers import documents
from pyspark.sql import functions as F
from rows import DATA

from vigilrow.llm import language_id, lm_scoring, queries, toxicity
from vigilrow.llm.common import fold_of, materialize
from vigilrow.llm.lm_scoring import Model, Settings, _history, _log_model


def test_lm_scoring(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.QUERIES["op1_lm_scoring"](spark, DATA).collect()}
    words = {d.doc_id: lm_scoring.tokens_of((d.text or "").encode()) for d in docs}
    counts = Counter(w for d, ws in words.items() if fold_of(d) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(docs)
    base = model = 0.0
    for d, ws in words.items():
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold_of(d) % 5 == 1, len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def toy_model(s: Settings, unlisted: int = 40) -> tuple[Model, np.ndarray, np.ndarray]:
    """A model with random weights, and the hashes and counts of its unlisted tokens."""
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, s.words + unlisted).astype(np.uint64)
    counts = np.sort(rng.integers(1, 90, len(h)))[::-1]
    halves = np.bincount(lm_scoring._cells(h[s.words :]), 2 * counts[s.words :] + 1, lm_scoring.CELLS).astype(np.int64)
    m = lm_scoring.base(s, int(counts.sum()), len(h), h[: s.words], counts[: s.words], halves)
    m.weights[:] = rng.standard_normal(len(m.weights))
    return m, h[s.words :], counts[s.words :]


def test_lm_model_is_proper():
    """After any history the probabilities of all words and of an unseen one sum to one; unlisted ones follow it too."""
    for s in (Settings(side=3, rare_rows=9, weights=5000), Settings(side=3, rare_rows=9, weights=600)):
        m, h, counts = toy_model(s)
        every = np.concatenate([np.arange(s.words), lm_scoring.rare_codes(h, s), [s.words]])
        own = np.append(counts + 0.5, 0.5) / m.rest[lm_scoring._class_of(every[s.words :], s) - s.side]
        rare = np.log(np.append(np.ones(s.words), own))
        seen = []
        for history in ([1, 2], [s.words + 2, 4]):
            p = []
            for c, r in zip(every, rare):
                code = np.array([*history, c])
                p.append(math.exp(_log_model(m, _history(code, np.array([0]), s), code, np.array([0.0, 0.0, r]), m.parts())[-1]))
            assert math.isclose(sum(p), 1.0, rel_tol=1e-4)
            seen.append(p)
        assert all(not math.isclose(x, y, rel_tol=1e-3) for x, y in zip(*seen))


def test_lm_probabilities_are_brute_force():
    """Every token's probability by loops over features, classes and members; with rows enough, and with hashed ones."""
    for weights in (6000, 600):
        s = Settings(side=3, rare_rows=9, weights=weights)
        m, h, counts = toy_model(s)
        heads, inner = m.parts()
        rng = np.random.default_rng(1)
        code = np.where(rng.random(60) < 0.6, rng.integers(0, s.words, 60), s.words + rng.integers(0, s.rare_rows - 1, 60))
        starts = np.array([0, 1, 20])
        rows = _history(code, starts, s)
        got = _log_model(m, rows, code, np.zeros(60), m.parts())
        none = s.words + s.rare_rows - 1
        for i, c in enumerate(code.tolist()):
            text = code[max(x for x in starts if x <= i) : i].tolist()
            before = [none, none, *text][-1], [none, none, *text][-2]
            if s.kind_rows >= s.words + s.rare_rows:
                assert rows[:2, i].tolist() == [1 + before[0], 1 + s.kind_rows + before[1]]
            features = [0, *rows[:, i].tolist()]
            of = [m.log_class[k] + sum(float(heads[f, k]) for f in features) for k in range(2 * s.side)]
            k = c // s.side if c < s.words else s.side + (c - s.words) % s.side
            want = of[k] - math.log(sum(map(math.exp, of)))
            if c < s.words:
                at = [int(lm_scoring._inner(np.array([f]), np.array([k]), s)[0]) for f in features]
                of = [m.log_word[k * s.side + j] + sum(float(inner[x, j]) for x in at) for j in range(s.side)]
                want += of[c % s.side] - math.log(sum(map(math.exp, of)))
            assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-4)


def test_lm_without_training_is_the_base(spark):
    """With zero weights the masses of classes give every text, listed words or not, its base score."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = lm_scoring.fit_and_score(docs, F.expr("doc_id % 3 != 0"), Settings(side=4, rare_rows=64, weights=4000, rounds=0)).collect()
    assert any(r.n_known < r.n_tokens for r in found)
    for r in found:
        assert math.isclose(r.score, r.base_score, rel_tol=1e-5)


def test_lm_model_grows():
    """Listed words, classes and weights follow the tokens; the weights up to their bound."""
    made = [Settings.of(n) for n in (10**5, 10**8, 10**10, 10**13)]
    assert [s.words for s in made] == sorted({s.words for s in made}) and made[-1].words > 200_000
    assert all(s.rows * 2 * s.side + s.inner_rows * s.side <= s.weights * 1.01 <= 17_000_000 for s in made)


def test_lm_edges(spark):
    rows = [(1, "A b"), (1, "a B"), (2, None), (3, ""), (None, "c\x00d é")]
    found = sorted(map(tuple, lm_scoring.fit_and_score(documents(spark, rows, clash=True), F.lit(True)).select("doc_id", "n_tokens", "n_known", "train_tokens").collect()), key=str)
    assert found == [(1, 3, 3, 11), (1, 3, 3, 11), (2, 1, 1, 11), (3, 1, 1, 11), (None, 3, 3, 11)]
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in lm_scoring.fit_and_score(documents(spark, rows), F.lit(False)).collect())
    assert lm_scoring.fit_and_score(documents(spark, []), F.lit(True)).count() == 0


def test_language_id(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    found = queries.QUERIES["op6_language_id"](spark, DATA).collect()
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    assert len(found) == len(truth) and all(r.held_out == (fold_of(r.doc_id) % 4 == 2) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_marginals():
    """Forward-backward against the sum over all label sequences."""
    from itertools import product

    rng = np.random.default_rng(1)
    m = language_id.Model(["a", "b"], np.zeros((1, 2)), rng.standard_normal((2, 2)), rng.standard_normal(2), {})
    scores = [rng.standard_normal((n, 2)) for n in (4, 1, 3)]
    got, _ = language_id.marginals(m, scores)
    for s, g in zip(scores, got):
        want = np.zeros_like(s)
        for path in product(range(2), repeat=len(s)):
            p = math.exp(m.start[path[0]] + sum(s[i, k] for i, k in enumerate(path)) + sum(m.transition[x, y] for x, y in zip(path, path[1:])))
            want[np.arange(len(s)), path] += p
        assert np.allclose(g, want / want.sum(axis=1, keepdims=True))


def test_language_edges(spark):
    rows = [(k, "the cat and the dog" if k % 2 else "der Hund und die Katze", "en" if k % 2 else "de") for k in range(40)] + [(100, None, "en"), (101, "12 ...", "de"), (102, "the dog", None), (103, "die Katze " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("shard", "model", "word")})
    m = language_id.train(df, F.lit(True))
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, m).collect()}
    assert found[100] == ("und", 0.0) and found[101] == ("und", 0.0) and found[102][0] == "en" and found[103][0] == "de"
    assert all(0 <= s <= 1 for _, s in found.values())
    none = language_id.train(df, F.lit(False))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(df.limit(0), m).count() == 0


def test_language_unspaced(spark):
    """A text without spaces is judged by all of its characters, not by its first ones."""
    rng = random.Random(3)
    run = lambda letters, n: "".join(rng.choices(letters, k=n))
    rows = [(k, run("あいうえおかき" if k % 2 else "一二三四五六七", 50), "ja" if k % 2 else "zh") for k in range(60)]
    rows += [(100, run("あいうえおかき", 70) + run("一二三四五六七", 900) + "あいう", None), (101, run("一二三四五六七", 70) + run("あいうえおかき", 900) + "一二三", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.train(df, F.lit(True))).collect()}
    assert (found[100], found[101]) == ("zh", "ja")
    for n in (1, 63, 64, 65, 66, 67, 126, 127, 1000):
        word = run("abcdé", n)
        parts = [p.decode() for p in language_id.words_of(word)]
        assert parts[0] + "".join(p[2:] for p in parts[1:]) == word and max(map(len, parts)) <= 64
        assert {word[k : k + 3] for k in range(n - 2)} == {p[k : k + 3] for p in parts for k in range(len(p) - 2)}


def auc(pairs):
    good, bad = ([s for s, y in pairs if y == k] for k in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_toxicity(spark):
    sf = DATA.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.QUERIES["op7_toxicity"](spark, sf).collect()
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and labels.get(r.doc_id) is not None]
    assert auc(held) >= 0.85  # measured: 0.886, and 0.776 at a tenth of the rows
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (fold_of(r.doc_id) % 5 == 0) for r in found)


def test_toxicity_edges(spark):
    rng = random.Random(0)
    rows = [(k, " ".join(rng.choices(["fine", "good", "day", "tree"], k=8)) + (" awful" if k % 2 else "")) for k in range(200)] + [(900, None), (901, ""), (902, "awful"), (902, "awful")]
    labels = spark.createDataFrame([*((k, 1, k % 2) for k in range(200)), (0, 1, 0), (900, 1, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, text int, toxic int")
    docs = documents(spark, rows, clash=True)
    model = toxicity.train(docs, labels, F.lit(True))
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert found[902] == 1 and found[1] == 1 and found[2] == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, p in found.items() if not p}
    untaught = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs, untaught).collect()} == {0}
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_toxicity_keeps_row_by_row(spark):
    """Documents go to Python as texts alone and not as Arrow batches of whole rows; written steps get bounded batches."""
    docs = documents(spark, [(1, "good day"), (2, "awful"), (3, None)])
    kept = toxicity.keep_clean(docs, (np.array([], np.int64), np.array([])))
    assert "Arrow" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 3

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = materialize(spark.range(0, 2500, 1, 1).mapInPandas(sizes, "n long"), "sizes")
    assert sorted(r.n for r in got.collect()) == [500, 1000, 1000]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

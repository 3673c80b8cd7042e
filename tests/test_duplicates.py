"""Near-duplicates by brute force over all pairs, and how few pairs reach the comparison."""

import random

import pandas as pd

from vigilrow.operators import hygiene


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i:04d}" for i in range(600)]
    rows = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 8, 30, 90, 300]))) for _ in range(120)]
    for t in rows[:90]:
        w = t.split()
        for share in (0, 0.1, 0.25, 0.4):
            rows.append(" ".join(x if rng.random() >= share else rng.choice(words) for x in w[: max(1, int(len(w) * (1 - share / 2)))]))
    return [(i, t) for i, t in enumerate(rows)] + [(9000, None), (9001, ""), (9002, rows[5]), (9003, rows[5])]


def brute(rows, least):
    sets = [(i, set(t.split())) for i, t in rows if t]
    return sorted((a, b, len(x & y), len(x | y)) for a, x in sets for b, y in sets if a < b and len(x & y) >= len(x | y) * least)


def test_pairs(spark):
    for seed, least, part in ((1, 0.6, 1 << 15), (2, 0.75, 10)):
        rows = texts(seed)
        got = hygiene.duplicate_pairs(spark.createDataFrame(rows, "item long, description string"), least, part)
        assert sorted(map(tuple, got.collect())) == brute(rows, least)


def test_unlike_sets_of_one_rare_token_are_not_compared():
    """2,000 sets of 100 tokens that share one of their rarest: they were 1,999,000 pairs before."""
    rng = random.Random(3)
    rows = pd.DataFrame([(k, [7, *(rng.getrandbits(62) for _ in range(99))], [2] * 100) for k in range(2000)], columns=["key", "hashes", "df"])
    marked = pd.concat(hygiene._marked(0.6, 1)(iter([rows])))
    assert len(marked) == 2000 and len(hygiene._met(0.6, 1 << 18)(marked)) < 200


def test_a_part_passes_by_size():
    """Before, a part lay in its task whole, several times over; now what is too small for the rows at hand is gone, and no pair with it."""
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(1, 400), rng.choice([2, 5, 9, 20, 60, 150]))) for _ in range(150)]
    sets += [sorted(set(rng.sample(x, max(1, len(x) * 4 // 5)))) for x in sets]
    marked = pd.concat(hygiene._marked(0.6, 3)(iter([pd.DataFrame([(k, [x * 1_000_003 << 20 for x in s], [2] * len(s)) for k, s in enumerate(sets)], columns=["key", "hashes", "df"])])))
    whole = {tuple(map(int, x)) for _, g in marked.groupby("part") for x in hygiene._met(0.6)(g).to_numpy()}
    marked = marked.sort_values(["part", "size"], kind="stable")
    sizes, near = [], hygiene._near

    def seen(rows, *more):
        sizes.append(len(rows["n"]))
        return near(rows, *more)

    hygiene._near = seen
    try:
        passed = {tuple(map(int, x)) for b in hygiene._met_by_size(0.6, 40, 64)(marked[k : k + 20] for k in range(0, len(marked), 20)) for x in b.to_numpy()}
    finally:
        hygiene._near = near
    assert passed == whole and len(sizes) > 9 and max(sizes) < len(marked) // 3
    assert {(a, b) for a in range(300) for b in range(a + 1, 300) if len({*sets[a]} & {*sets[b]}) >= 0.6 * len({*sets[a]} | {*sets[b]})} <= passed


def test_any_order_of_tokens_is_right(spark, monkeypatch):
    """With eight cells for all tokens their order tells little of which are rare, and no pair is lost."""
    rows, levels = texts(4), hygiene._levels
    monkeypatch.setattr(hygiene, "_levels", lambda hashed: levels(hashed, 8))
    got = hygiene.duplicate_pairs(spark.createDataFrame(rows, "item long, description string"), 0.6)
    assert sorted(map(tuple, got.collect())) == brute(rows, 0.6)

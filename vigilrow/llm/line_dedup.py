r"""Line dedup: fuzzy lines by MinHash, in DataFrame and SQL functions alone.

A line is a part of a text between line feeds; it is compared lower-cased and without spaces at its ends,
and a line of spaces alone is never removed. Its set holds the shingles of 5 characters at every position, up
to its last character; a shorter line is one shingle. Two lines link when the Jaccard similarity of their sets
is at least `percent` %. Of each component of linked lines one stays: the one that comes first by (doc_id, line
number).

The signature of a line has 32 cells, by the hash of a shingle: the least hash of each, or that of the next
cell that has one. A band is six cells, and there are 24 of them. A pair at similarity 0.8 meets in at least one with a
chance of 0.980, at 0.85 of 0.996, at 0.9 of 0.9997 (simulated). Lines that meet become a pair
if at least 18 of their cells agree, which a pair at 0.8 fails with a chance of 0.001, and, beyond the first pairs of a
bucket, if their sketches allow it: for each of 1,024 cells, whether an odd number of the set's shingles falls in it; sets differ in at least as many
shingles as sketches in cells, so that what this rules out surely doesn't link. Pairs are compared exactly: first the
first line of each bucket with the others, then, per bucket, what is still in different components with a few lines
more, and last all that is still apart, so that a group of near copies costs its size, not its square. Sets are eight
times as large as their lines: they are made for each pair and never written.

Signatures are made from one row a shingle, in generated code. Exact copies are counted before anything is
compared; they are told from others by two 64-bit hashes, and then numbered.

Edge cases: null texts have no lines and stay null; an empty text has one blank line; rows that repeat a
doc_id count as one place, so a line at the same number of each is kept or removed in both; a null doc_id
orders first; extra columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import discard, materialize
from vigilrow.llm.components import connected_components, joined_components

#: Up to so many lines, of at most five numbers each, are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Characters of a shingle, cells of a signature, cells that agree in a pair at least, 64-bit words of a sketch.
WIDTH, CELLS, AGREE, WORDS = 5, 32, 18, 16

#: The cells of each band. Shorter bands would let unrelated lines meet by chance, which grows with the square of the lines.
BANDS = tuple(tuple(random.Random(b).sample(range(CELLS), 6)) for b in range(24))

#: Of what is apart in a bucket, the line whose number is next to such a number, bit by bit, is compared with all others.
LEADERS = tuple((k * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 40) for k in range(8))


def lines_of(documents: DataFrame) -> DataFrame:
    """doc_id (the least number in place of null), line (from 0) and norm of the lines that are not blank, with two hashes of norm."""
    lines = documents.select(_known_id().alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.filter("trim(raw) <> ''").select("doc_id", "line", F.lower(F.trim("raw")).alias("norm"))
    return lines.withColumns({"h": F.xxhash64("norm"), "g": F.xxhash64(F.lit(1), "norm")})


def _known_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def _shingles(lines: DataFrame, *keys: str) -> DataFrame:
    """The columns keys and the hash x of the shingle at each position of norm."""
    # four bytes a character, so that no position is searched for
    coded = lines.select(*keys, F.expr("encode(norm, 'UTF-32')").alias("codes"))
    # outer, or else the optimizer makes each sequence once more to see that it isn't empty
    at = coded.select(*keys, "codes", F.explode_outer(F.expr(f"sequence(0, greatest(cast(length(codes) div 4 as int) - {WIDTH}, 0))")).alias("i"))
    return at.select(*keys, F.expr(f"xxhash64(substring(codes, 4 * i + 1, {4 * WIDTH}))").alias("x"))


def with_set(lines: DataFrame) -> DataFrame:
    """Adds `set`: the distinct hashes of the shingles of norm."""
    # bound by a lambda, so that a line is encoded once
    shingles = F.expr(
        "transform(array(encode(norm, 'UTF-32')), codes -> transform(sequence(0, greatest(cast(length(codes) div 4 as int) - "
        f"{WIDTH}, 0)), i -> xxhash64(substring(codes, 4 * i + 1, {4 * WIDTH}))))[0]"
    )
    return lines.withColumn("set", F.array_distinct(shingles))


def _classes(documents: DataFrame) -> DataFrame:
    """id, h, g, n, the first place (doc_id, line) and the cells of every distinct line: a byte each, eight in each of s0, s1, ..."""
    texts = lines_of(documents).groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first"), F.min("norm").alias("norm"))
    # grouped by the two hashes alone: what else is known of a line costs less as an aggregate than in the key of each shingle
    keys, known = ["h", "g"], ["n", "doc_id", "line"]
    x = _shingles(texts.select("h", "g", "n", "first.doc_id", "first.line", "norm"), *keys, *known)
    x = x.select(*keys, *known, "x", F.expr(f"cast(x & {CELLS - 1} as int)").alias("cell"))
    cells = x.groupBy(*keys).agg(*(F.min(c).alias(c) for c in known), *(F.expr(f"min(x) filter (where cell = {k})").alias(f"m{k}") for k in range(CELLS)))
    keys += known
    # an empty cell has the value of the next one that is not
    full = cells.select(*keys, *(F.coalesce(*(F.col(f"m{(k + i) % CELLS}") for i in range(CELLS))).alias(f"m{k}") for k in range(CELLS)))
    packed = [F.expr(" | ".join(f"shiftleft(shiftright(m{8 * w + i}, 8) & 255, {8 * i})" for i in range(8))).alias(f"s{w}") for w in range(CELLS // 8)]
    return full.select(F.monotonically_increasing_id().alias("id"), *keys, *packed)


def _keys(classes: DataFrame) -> DataFrame:
    """id and key of each band of each line: a hash of its number and the bytes of its cells.

    Made from the cells where they are used, as keys are six times as large; bands are rows of masks, so that the compiled step stays small.
    """
    words = range(CELLS // 8)
    mask = lambda band, w: int.from_bytes(bytes(255 * (8 * w + i in band) for i in range(8)), "little", signed=True)
    masks = F.array(*(F.struct(F.lit(b).alias("band"), *(F.lit(mask(band, w)).cast("long").alias(f"m{w}") for w in words)) for b, band in enumerate(BANDS)))
    cells = classes.select("id", *(f"s{w}" for w in words)).select("*", F.inline(masks))
    return cells.select("id", F.xxhash64("band", *(F.col(f"s{w}").bitwiseAND(F.col(f"m{w}")) for w in words)).alias("key"))


def _agree() -> Column:
    """Whether enough cells of a and b agree."""
    other = []
    for w in range(CELLS // 8):
        x = F.col(f"s{w}a").bitwiseXOR(F.col(f"s{w}b"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        other.append(F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    return sum(other, F.lit(0)) <= CELLS - AGREE


def _near(percent: int) -> Column:
    """Whether, besides, the sketches of a and b leave it open that their sets are similar enough."""
    differ = sum((F.bit_count(F.col(f"p{k}a").bitwiseXOR(F.col(f"p{k}b"))) for k in range(WORDS)), F.lit(0))
    return _agree() & (differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def _sketches(texts: DataFrame) -> DataFrame:
    """id, the size n of its set and the words p0, p1, ... of its sketch."""
    x = with_set(texts).select("id", F.explode_outer("set").alias("x"))
    x = x.select("id", F.expr(f"cast(x & {WORDS - 1} as int)").alias("word"), F.expr("shiftleft(1L, cast(shiftright(x, 8) & 63 as int))").alias("bit"))
    return x.groupBy("id").agg(F.count("*").alias("n"), *(F.expr(f"coalesce(bit_xor(bit) filter (where word = {k}), 0L)").alias(f"p{k}") for k in range(WORDS)))


def _end(lines: DataFrame, end: str, *others: str) -> DataFrame:
    """The cells, set sizes and sketches of lines, as far as they are there, named for one end of a pair."""
    own = [c for c in lines.columns if c == "n" or c[0] in "sp"]
    return lines.select(*others, F.col("id").alias(end), *(F.col(c).alias(f"{c}{end}") for c in own))


def _texts(documents: DataFrame, places: DataFrame) -> DataFrame:
    """id and norm of the lines in places, each from the first document that has it."""
    place = materialize(places, "places")
    if place.count() <= BROADCAST_IDS:
        place = F.broadcast(place)
    own = documents.withColumn("doc_id", _known_id()).join(place.select("doc_id").distinct(), "doc_id", "left_semi")
    return lines_of(own).join(place, ["doc_id", "line", "h", "g"]).dropDuplicates(["id"]).select("id", "norm")


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines whose sets are similar enough."""
    x, y = (texts.select(F.col("id").alias(i), F.col("norm").alias(j)) for i, j in (("a", "x"), ("b", "y")))
    both = with_set(pairs.join(y, "b").join(x, "a").withColumnRenamed("x", "norm")).withColumnRenamed("set", "x")
    both = with_set(both.drop("norm").withColumnRenamed("y", "norm")).withColumnRenamed("set", "y").withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _leaders(leaders: tuple[int, ...]) -> Column:
    """Of the lines of a group, those next to the given numbers."""
    return F.array_distinct(F.array(*(F.min(F.col("id").bitwiseXOR(F.lit(k))).bitwiseXOR(F.lit(k)) for k in leaders)))


def components(documents: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the lines that link with others."""
    every = _keys(classes)
    # dealt by key once: the exchange serves the counts and the join. Nearly all keys are of one line, so those of several are the small side
    dealt = every.repartition("key")
    often = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("n > 1")
    shared = materialize(dealt.join(often.hint("shuffle_hash"), "key"), "shared")
    seen = materialize(shared.select("id").distinct().join(classes.select("id", "h", "g", "doc_id", "line", *(c for c in classes.columns if c[0] == "s")), "id"), "seen")

    # the first line of a bucket is compared with all others; in buckets of two no pair is left then
    stars = _ordered(shared.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")))
    stars = materialize(stars.join(_end(seen, "a"), "a").join(_end(seen, "b"), "b").filter(_agree()).select("a", "b"), "stars")
    wide = shared.filter("n > 2").select("key", "id")
    wanted = stars.select(F.explode(F.array("a", "b")).alias("id")).union(wide.select("id")).distinct()
    texts = materialize(_texts(documents, wanted.join(seen.select("id", "h", "g", "doc_id", "line"), "id")), "texts")
    label = materialize(connected_components(materialize(_linked(stars, texts, percent), "links")), "label")

    def apart(label: DataFrame) -> DataFrame:
        """The key, id and component of the lines of buckets with several components."""
        held = wide.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        several = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        return materialize(held.join(several.select("key"), "key", "left_semi"), "apart")

    # only what is apart gets sketches
    held = apart(label)
    cells = _sketches(texts.join(held.select("id").distinct(), "id", "left_semi"))
    cells = materialize(cells.join(seen.select("id", *(c for c in seen.columns if c[0] == "s")), "id"), "cells")
    # in buckets still apart, some other lines are compared with all of other components
    others = held.groupBy("key").agg(_leaders(LEADERS).alias("first")).select("key", F.explode("first").alias("id"))
    held = held.join(cells, "id")
    x, y = _end(held, "a", "key", F.col("component").alias("ca")), _end(held.join(others, ["key", "id"]), "b", "key", F.col("component").alias("cb"))
    more = materialize(_ordered(x.join(y, "key").filter((F.col("ca") != F.col("cb")) & _near(percent)).select("a", "b")).join(stars, ["a", "b"], "left_anti"), "pairs")
    label = materialize(joined_components(label, materialize(_linked(more, texts, percent), "links")), "label")
    # then all that is apart
    held = apart(label).join(cells, "id")
    x, y = (_end(held, end, "key", F.col("component").alias(f"c{end}")) for end in ("a", "b"))
    rest = _ordered(x.join(y, "key").filter((F.col("ca") < F.col("cb")) & _near(percent)).select("a", "b"))
    rest = materialize(rest.join(stars.union(more), ["a", "b"], "left_anti"), "pairs")
    label = materialize(joined_components(label, materialize(_linked(rest, texts, percent), "links")), "label")
    discard(shared, seen, texts, cells)
    return label


def decide(documents: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id and removed: the sorted numbers of the lines that go, for each document that has such lines."""
    documents = documents.select("doc_id", "text")
    classes = materialize(_classes(documents), "classes")
    label = components(documents, classes, percent)
    linked = classes.select("id", "h", "g", "n", F.struct("doc_id", "line").alias("first")).join(label, "id", "left")
    alone = linked.filter("component is null and n > 1").select("h", "g", "first")
    linked = linked.filter("component is not null")
    first = linked.groupBy("component").agg(F.min("first").alias("first"))
    owner = materialize(alone.union(linked.select("h", "g", "component").join(first, "component").select("h", "g", "first")), "owner")
    if owner.count() <= BROADCAST_IDS:
        owner = F.broadcast(owner)
    lines = lines_of(documents).select("doc_id", "line", "h", "g")
    gone = lines.join(owner, ["h", "g"]).filter(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line").distinct()
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def report(documents: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines (blank ones too), n_removed and removed of every row."""
    gone = materialize(decide(documents, percent), "removed").withColumnRenamed("doc_id", "_doc")
    sizes = documents.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    sizes = sizes.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    both = sizes.join(gone, _known_id() == F.col("_doc"), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return both.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup(documents: DataFrame, percent: int = 80) -> DataFrame:
    """All columns of documents, text without the lines that go."""
    gone = materialize(decide(documents, percent), "removed").select(F.col("doc_id").alias("id"), "removed")
    # a row's columns stay inside a struct, whatever their names
    rows = documents.select(F.struct("*").alias("row"), _known_id().alias("known"))
    both = rows.join(gone, F.col("known") == F.col("id"), "left").withColumn("lines", F.split("row.text", "\n"))
    # between the removed lines lie the slices that stay
    kept = F.expr("array_join(flatten(transform(concat(removed, array(size(lines))), (r, i) -> slice(lines, coalesce(get(removed, i - 1), -1) + 2, r - coalesce(get(removed, i - 1), -1) - 1))), '\n')")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    return both.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in documents.columns))

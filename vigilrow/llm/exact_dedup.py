"""Exact dedup by progressive refinement: rows are grouped by length, then by a hash of a prefix, then by a hash of the
whole text, and each step looks only at rows that the step before could not tell from all others.

Texts are equal when they are identical after the characters of BLANK are deleted. Of equal texts the row stays whose original
text has the most code points, then the one with the smallest doc_id; rows that agree in both are told apart by their place.

Each step is one scan that computes its key for the rows whose earlier keys are shared. Which keys are shared is known from a table
of bits of fixed size (`BITS`): a bit that two keys fall on costs a hash more and changes nothing, as groups are formed by the exact
keys in the end. So texts never leave the scan: only lengths, hashes and what the caller carries along are shuffled, and a row that
a step has told apart from all others is not shuffled at all. A group of copies is counted before its shuffle; its rows meet
only the one row of their group, in a join that Spark can split.

Edge cases: a null text counts as an empty one; texts of nothing but BLANK are equal to it; a null doc_id comes after all others;
repeated rows are rows of their own, of which at most one stays; an empty table gives no rows; columns that are not carried are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import discard, materialize

#: The characters that don't count: space and \x09 to \x0D.
BLANK = " \t\n\x0b\x0c\r"
#: Code points of a text that the second step hashes.
PREFIX = 64
#: Bits of the table of shared keys, a power of two: 2 MB of longs, whatever the number of rows.
BITS = 1 << 24


def normalised(text: str = "text") -> Column:
    """The text without the characters that don't count; null is empty."""
    return F.coalesce(F.translate(text, BLANK, ""), F.lit(""))


def _bit(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS))


def _shared(keys: DataFrame) -> DataFrame:
    """One row with the table of bits of the keys that occur more than once. keys: columns of the key and nothing else."""
    bit = _bit(*keys.columns)
    more = keys.groupBy(*keys.columns).count().filter("count > 1").select(bit.alias("bit"))
    words = more.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    words = materialize(words, "bits")
    every = keys.sparkSession.range(BITS // 64).select(F.col("id").alias("word"))
    dense = every.join(words, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
    return dense.agg(F.array_sort(F.collect_list("w"))["bits"].alias("bits"))


def _held(table: DataFrame, *key: str) -> Column:
    """Whether the key's bit is set."""
    bit = _bit(*key)
    return F.bit_get(F.get(table.scalar(), F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1


def dedup(documents: DataFrame, **carried: Column) -> DataFrame:
    """doc_id, keep_id, group_size and kept of every row, with the `carried` expressions over its columns."""
    own = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_chars")
    # `carried` is evaluated beside the texts, in the last scan
    texts = documents.select("doc_id", own, normalised().alias("_text"), *(c.alias(f"_own_{n}") for n, c in carried.items()))
    sized = texts.withColumn("_length", F.length("_text"))
    lengths = _shared(sized.select("_length"))
    headed = sized.withColumn("_head", F.when(_held(lengths, "_length"), F.xxhash64(F.left("_text", F.lit(PREFIX)))))
    heads = _shared(headed.filter("_head is not null").select("_length", "_head"))
    whole = F.when(F.col("_head").isNotNull() & _held(heads, "_length", "_head"), F.unhex(F.sha2("_text", 256)))
    hashed = headed.withColumn("_hash", whole).withColumn("_row", F.monotonically_increasing_id()).drop("_text")
    rows = materialize(hashed, "hashed")
    # the greatest of these is the row that stays; ~ turns the order round
    rank = F.struct("_chars", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("_row").alias("row"))
    groups = rows.filter("_hash is not null").groupBy("_length", "_hash").agg(F.count("*").alias("_size"), F.max(rank).alias("_best")).filter("_size > 1")
    groups = materialize(groups, "groups")
    out = rows.join(groups, ["_length", "_hash"], "left")
    alone = F.col("_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.bitwise_not("_best.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.bitwise_not("_best.row") == F.col("_row"))).alias("kept"),
        *(F.col(f"_own_{n}").alias(n) for n in carried),
    )

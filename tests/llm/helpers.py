"""Small inputs for the tests of this folder."""

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that operators use for columns of their own.
CLASHING = ("key", "h", "line", "component", "id", "batch", "bucket", "label", "cls", "size", "removed", "_doc", "_removed", "_lines", "_row", "flag", "n", "a", "b", "row", "doc")


def documents(spark, rows: list[tuple], clash: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in CLASHING if clash else ():
        df = df.withColumn(c, F.lit("x"))
    return df


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near_copies(seed: int = 1, n: int = 40) -> list[tuple]:
    """Texts, exact copies, near copies on both sides of the limit, empty, short and missing texts."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        words = sentence(rng, rng.choice([3, 5, 8, 30, 80, 200])).split()
        rows.append((10 * k, " ".join(words)))
        if k % 2:
            changed = list(words)
            for _ in range(rng.choice([0, 1, 2, 3])):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(99)}"
            rows.append((10 * k + 1, " ".join(changed)))
        if k % 5 == 0:
            rows += [(10 * k + 2, " ".join(words).upper()), (10 * k + 3, " ".join(words) + " and more")]
    return [*rows, (9001, ""), (9002, None), (9003, " \t\n"), (9004, "one"), (9005, "One"), (9006, "one two")]

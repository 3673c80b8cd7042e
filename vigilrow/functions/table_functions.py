"""Table functions for SQL: register(spark), then

    SELECT f.unit, p.* FROM files f, LATERAL decoded_payloads(f.text) p
    SELECT * FROM blank_runs(TABLE(lines) PARTITION BY unit ORDER BY line)
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vigilrow.functions.decoding import payloads_of


@udtf(returnType="line: int, depth: int, kind: string, payload: string")
class DecodedPayloads:
    """The payloads of a text, as decoding.payloads() has them."""

    def eval(self, text: str):
        yield from payloads_of(text)


@udtf(returnType="unit: bigint, length: bigint, content_line: int")
class BlankRuns:
    """structural.blank_runs(): per unit the longest run of at least 200 blank lines before content, and the line behind it.

    Rows come by unit and in order of line; one is held.
    """

    LEAST = 200

    def __init__(self):
        self.unit, self.run, self.best = None, 0, None

    def eval(self, row):
        self.unit = row["unit"]
        if row["raw"].strip(" ") == "":
            self.run += 1
        else:
            if self.run >= self.LEAST and (self.best is None or self.run > self.best[0]):
                self.best = (self.run, row["line"])
            self.run = 0

    def terminate(self):
        if self.best:
            yield self.unit, *self.best


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("decoded_payloads", DecodedPayloads)
    spark.udtf.register("blank_runs", BlankRuns)

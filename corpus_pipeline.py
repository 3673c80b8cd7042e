"""Corpus pipeline: toxic documents go, then fuzzy repeated lines, then near copies, then documents that
hold benchmark passages; what stays is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents. Documents that lose all their lines stay, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilrow.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from vigilrow.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled documents of docs, scores below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier line or nearly do; n_chars follows the text."""
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, which one without a doc_id never is beside others."""
    rows = docs.select(F.struct("*").alias("row"))
    # numbers in the order of doc_id tell apart the rows that share one
    rows = materialize(rows.sort(F.col("row.doc_id").asc_nulls_last()).withColumn("number", F.monotonically_increasing_id()), "rows")
    joined = ngram_join.join(rows.select(F.col("number").alias("doc_id"), "row.text"))
    copies = joined.filter("doc_id <> component_id").select(F.col("doc_id").alias("number"))
    return rows.join(copies, "number", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: FTRL, MinHash and byte-pair encoding have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # written, so that what a stage computes is not computed again for each scan of it
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

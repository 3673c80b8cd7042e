"""The stages of the pipeline on nulls, empty texts, repeated rows, clashing names and empty tables."""

import random

import pytest
from helpers import sentence
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, tmp_path, empty):
    rng = random.Random(3)
    item = sentence(rng, 14, 10**6)
    copy = sentence(rng, 40, 10**6)
    rows = [(k, sentence(rng, 30, 10**6) + "\nthe very same line of every text", "en", "web", 1) for k in range(6)]
    rows += [(10, copy, None, None, None), (11, copy.rsplit(" ", 1)[0] + " end", "en", "web", 2), (12, f"before {item} behind", "en", "web", 3)]
    rows += [(13, None, "en", "web", None), (14, "", "en", "web", 0), (None, sentence(rng, 9, 10**6), "en", "web", 9), (15, "twice", "en", "web", 5), (15, "twice", "en", "web", 5)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("row", "id", "removed", "number", "key")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(0, 1, 0), (1, 1, 0), (5000, 0, 1), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        kept.append(sorted((r.doc_id is None, r.doc_id or 0) for r in now.collect()))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert kept == [[]] * 4 and packed == []
        return
    assert len(kept[0]) == len(kept[1]) == len(rows)
    texts = {r.doc_id: r.text for r in now.collect()}
    assert 12 not in texts and texts[13] is None and texts[0].endswith("text") and "\n" not in texts[1]
    assert 10 in texts and {r.doc_id for r in packed} == set(texts)


def test_without_n_chars(spark):
    docs = spark.createDataFrame([(1, "one line\nother"), (2, "one line")], "doc_id long, text string")
    assert corpus_pipeline.drop_lines(spark, docs, "").columns == ["doc_id", "text"]

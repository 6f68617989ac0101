"""The pipeline's contract on a small corpus."""

import corpus_pipeline
from barloom.llm.common import materialize
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(1) for c in ("score", "_row", "n_lines", "gone")})
    extra = spark.createDataFrame([(900_001, "12345 !!!"), (900_002, None)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        counts[name] = after.count()
        docs = after
    assert counts["language"] == 200 and counts["lines"] == 200 and counts["near_duplicates"] < 200
    assert counts["personal_data"] == counts["near_duplicates"]
    assert docs.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts["personal_data"]


def test_stages_run_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0

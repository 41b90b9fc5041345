from pyspark.sql import functions as F

import corpus_pipeline
from concord.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_named_like_their_own(spark):
    rows = [(i, f"a line that many have in common\nand one of its own {i * 37}", i, i + 1, float(i), True) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n_removed long, _n_lines long, _score double, _rejected boolean")
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert all((r._n_removed, r._n_lines, r._score) == (i, i + 1, float(i)) for i, r in got.items()) and len(got) == 6
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter(~F.col("_rejected") | (F.col("_score") != F.col("doc_id"))).count() == 0

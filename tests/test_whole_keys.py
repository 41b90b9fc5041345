from concord.plans.registry import QUERIES


def test_d4_keeps_documents_with_the_same_opening(spark, tmp_path):
    rows = [(1, "The same opening, then this."), (2, "The same opening, then that."), (3, "The same opening, then this."), (4, "the same  opening, then THAT."), (5, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 28) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in QUERIES["d4_greedy_or"](spark, str(tmp_path)).collect()) == [1, 2, 5, 6]

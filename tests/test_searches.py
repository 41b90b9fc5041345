from pyspark.sql import functions as F

from concord.functions import times as T


def test_each_pattern_is_searched_for_once(spark):
    rows = [("报名截止：2026年2月31日 截止日期: 2026/3/05",), ("2026-1-9 截止",), ("x",), (None,), ("报名截止:2026年12/1",)]
    df = spark.createDataFrame(rows, "t string").select(T.labelled_date(F.col("t"), T.DEADLINES, "23:59:59").alias("v"))
    assert [r.v and r.v[:10] for r in df.collect()] == ["2026-03-05", "2026-01-09", None, None, "2026-12-01"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= len(T.DEADLINES)

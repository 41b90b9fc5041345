import math
import random

import numpy as np
from pyspark.sql import functions as F

from concord.llm import queries, sql, topk
from tests.llm.oracle import SF, rows_of, rows_of_sql


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if b != a)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def test_small_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "GROUP_ROWS", 50)
    monkeypatch.setattr(topk, "MOST_BOUNDS", 3)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.25, 0.125, 0.7]) for _ in range(4)]) for i in range(300)]
    rows += [(50, [1.0] * 4), (50, [1.0] * 4), (None, [1.0] * 4), (700, None), (701, [1.0, None, 0.0, 0.0]), (702, [float("nan")] * 4)]
    rows += [(703, [float("inf")] * 4), (750, []), (751, [9.0]), (800, [0.5] * 6), (-50, [-1.0] * 4), (850, [1e30, -1e30, 1.0, 0.0])]
    rows += [(900 + i, [0.3, 0.3, 0.3, 0.3]) for i in range(60)]
    small = [x for x in rows if x[0] != 850]
    df = spark.createDataFrame([(i, v, "z") for i, v in small], "vec_id long, embedding array<double>, row string")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == brute(small)
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert topk.top_k(wide, F.col("vec_id") == 850, 2).count() == 2
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") == 0).collect() == [(0, 1, 1, 256 * 512)]


def test_query_matches_sql(spark):
    assert rows_of(queries.op5_exact_top_k(spark, SF)) == rows_of_sql(sql.ORACLES["op5_exact_top_k"])


def test_tasks_hold_bounded_rows_and_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 20, raising=False)
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.25, 0.125, 0.7]) for _ in range(6)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.filter("query_id % 50 = 0").collect())) == brute(rows) and got.count() == 1000
    laid = topk.laid_out(topk.integer_vectors(df).withColumns({"row": F.col("vec_id"), "asked": F.col("vec_id") % 5 == 0}))
    found, asked = topk.other_groups(laid, topk.own_group(laid, 5), 5)
    for part, most in ((found.withColumnsRenamed({"to_g": "g", "to_q": "q"}), 300), (asked, 60)):
        sizes = part.groupBy("g", "q").count().collect()
        assert max(x["count"] for x in sizes) <= most


def clustered(seed=4, n=3000, dims=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dims)) * 2
    return np.floor(256 * (centres[r.integers(0, 30, n)] + r.normal(size=(n, dims)) * 0.05))


def test_blocks_and_groups_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 300)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rows = [(i, (x / 256).tolist()) for i, x in enumerate(clustered())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    laid = topk.laid_out(topk.integer_vectors(df).withColumns({"row": F.col("vec_id"), "asked": F.col("vec_id") % 50 == 0}))
    _, asked = topk.other_groups(laid, topk.own_group(laid, 5), 5)
    groups = laid.select("g").distinct().count()
    assert groups >= 8 and asked.count() < 60 * (groups - 1) / 2  # most groups are not asked
    whole = laid.toArrow()
    blocks = topk.blocks_of(whole)
    queries = whole.filter(whole.column("asked"))
    best = topk.Best(topk._vectors(queries), queries.column("row").to_numpy(), np.full(60, -(2**63)), 5)
    best.search(blocks)
    assert best.visited < 60 * len(blocks) / 2  # and most blocks are not visited
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == brute(rows)

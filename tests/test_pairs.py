"""Pairs of a stated query set with all rows: no broadcast, and work by kinds of profiles."""

from pyspark.sql import functions as F

from concord.operators import rank as R
from concord.operators.dedup import in_blocks
from concord.plans.registry import QUERIES
from tests.oracle import SF


def on():
    none = F.array().cast("array<string>")
    cols = {k: F.col(k) for k in ("major", "interests", "target_major", "category", "days", "level", "approved")}
    return cols | {"grade": F.lit(""), "target_grade": F.lit(""), "tags": none, "policy_tags": none, "followed": F.col("seq") == F.col("user_id")}


def tables(spark):
    users = spark.createDataFrame([(i, None if i == 4 else "ab"[i % 2], None if i == 5 else ["x"]) for i in range(8)], "user_id long, major string, interests array<string>")
    events = spark.createDataFrame([(i, "ab"[i % 3 == 0], "xy"[i % 2], i % 9, "省级", i % 5 == 0) for i in range(40)], "seq long, target_major string, category string, days int, level string, approved boolean")
    return users, events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_not_broadcast(spark):
    a, b = spark.range(50).select(F.col("id").alias("x")), spark.range(300).select(F.col("id").alias("y"))
    pairs = in_blocks(a, b, 7, 11)
    assert "Broadcast" not in plan(pairs)
    assert pairs.distinct().count() == pairs.count() == 50 * 300


def test_totals_of_profiles_need_no_pairs(spark):
    assert "ShuffledHashJoin" not in plan(got := QUERIES["j9_profile_pairs"](spark, SF)) and "Generate" not in plan(got)


def test_scores_of_kinds_are_those_of_pairs(spark):
    users, events = tables(spark)
    want = {(r[0], r[1]): r[2] for r in users.crossJoin(events).select("user_id", "seq", R.relevance_score(on())).collect()}
    got = R.score_each_pair(users, events, on()).collect()
    assert len(got) == len(want) == 320 and {(r.user_id, r.seq): r.score for r in got} == want
    best = {(r.user_id, r.rank): (r.seq, r.score) for r in R.score_pairs(users, events, on(), 3).collect()}
    for u in range(8):
        of = sorted(((s, e) for (v, e), s in want.items() if v == u), key=lambda x: (-(x[0] or 0), x[1]))[:3]
        if u != 5:  # without interests there is no score
            assert [best[u, i][0] for i in (1, 2, 3)] == [e for _, e in of]


def test_value_is_taken_once_for_a_kind(spark):
    users, events = tables(spark)
    users = users.crossJoin(spark.range(20).select(F.col("id").alias("n"))).select((F.col("user_id") * 20 + F.col("n")).alias("user_id"), "major", "interests")
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    pairs = R.each_pair(users, events, F.udf(look, "string")(F.concat("major", "target_major")))
    pairs.write.format("noop").mode("overwrite").save()
    assert 0 < seen.value <= 40 * 4 * 4 < pairs.count() == 40 * 160  # four kinds; dealing them may take a value again


def test_reasons_are_taken_for_kinds_of_customers(spark):
    got = plan(QUERIES["r3_reasons"](spark, SF))
    assert "explode(_users" in got and got.index("explode(_users") < got.index("array_compact" if "array_compact" in got else "array_join")  # reasons below the users


def test_tasks_follow_the_blocks_of_rows_joined_by_kind(spark):
    a = spark.range(50).select(F.col("id").alias("x"), (F.col("id") % 3).alias("k"))
    b = spark.range(300).select(F.col("id").alias("y"), (F.col("id") % 3).alias("k"))
    pairs = in_blocks(a, b, 7, 11, on=("k",))
    assert pairs.count() == pairs.select("x", "y").distinct().count() == sum(1 for x in range(50) for y in range(300) if x % 3 == y % 3)
    assert pairs.rdd.getNumPartitions() == 8 * 28  # and not the number set for shuffles

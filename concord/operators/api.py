"""What readers ask of the tables: lists, a record in detail, reminders, recommendations, accounts, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import text as X
from concord.functions import times as T
from concord.operators import rank as R
from concord.operators.merge import EVENT_COLUMNS

#: The states of open events, in the order in which they are asked for, and the days of events without any.
OPEN_STATES, NO_DAYS = ["报名中", "即将截止"], 9999
#: Most rows of a list.
MOST = 50


def detail(events: DataFrame, event_id: Column) -> DataFrame:
    """The one event with an id: all columns of a record that the table has, the original text as it is ('' if unknown)."""
    found = events.filter(F.col("event_id") == event_id)
    text = F.coalesce(F.col("original_text"), F.lit("")) if "original_text" in events.columns else F.lit("")
    return found.select(*[c for c in EVENT_COLUMNS if c in events.columns and c != "original_text"], text.alias("original_text"))


def reminders(events: DataFrame, now: Column, days: int = 7, most: int = MOST) -> DataFrame:
    """Events (event_id, status, deadline, ...) that close within days of now: of each of OPEN_STATES the most nearest ones,
    the first of an id, in the order of their days remaining, unknown last."""
    near = events.filter(F.col("status").isin(OPEN_STATES) & F.col("deadline").between(now, now + F.expr(f"INTERVAL {days} DAY")))
    order = F.array_position(F.array(*map(F.lit, OPEN_STATES)), F.col("status"))
    listed = near.withColumn("_n", F.row_number().over(Window.partitionBy("status").orderBy("deadline", "event_id"))).filter(F.col("_n") <= most)
    once = listed.withColumn("_k", F.row_number().over(Window.partitionBy("event_id").orderBy(order, "_n"))).filter("_k = 1")
    left = F.coalesce(T.days_remaining(F.col("deadline"), F.lit(0), now), F.lit(NO_DAYS))  # of 2 * most rows
    return once.withColumn("days_remaining", left.cast("int")).orderBy("days_remaining", order, "_n").drop("_n", "_k")


def recommendations(profiles: DataFrame, events: DataFrame, on: dict[str, Column], k: int = 5) -> DataFrame:
    """The k best open events for each profile, with rank, score and reasons, the number of candidates and a summary of the
    profile. profiles (user_id, major, grade, interests) are a stated set of asking users; events (seq, status, organizer,
    ...) without a state count as open. on names the columns of a pair, as for relevance_score and its reasons."""
    open_ = events.filter(F.col("status").isNull() | F.col("status").isin(OPEN_STATES))
    best = R.score_pairs(profiles, open_.drop("status"), on, k)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    summary = F.concat_ws(" / ", *[F.nullif(x, F.lit("")) for x in (known("major"), known("grade"), F.array_join("interests", ","))])
    pairs = open_.drop("status").join(best.join(profiles, "user_id").hint("shuffle_hash"), "seq")  # the k best are the smaller side
    total = open_.agg(F.count("*").alias("n_candidates"))  # one row
    reasons = R.recommendation_reasons(on)
    out = pairs.withColumn("reasons", reasons).withColumn("profile", summary).withColumn("_1", F.lit(1))
    return out.join(F.broadcast(total.withColumn("_1", F.lit(1))), "_1").select("user_id", "rank", "seq", "score", "reasons", "profile", "n_candidates")


def accounts(table: DataFrame, of: str = "account_class", name: str = "name", most: int = 500) -> DataFrame:
    """(class, n, total, names): accounts by class, with counts and the overall number; names holds the first most by name."""
    ranked = table.withColumn("_n", F.row_number().over(Window.partitionBy(of).orderBy(name)))
    total = table.agg(F.count("*").alias("total")).withColumn("_1", F.lit(1))
    by = ranked.groupBy(of).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.col(name)))).alias("names"))
    return by.withColumn("_1", F.lit(1)).join(F.broadcast(total), "_1").drop("_1")


def quality(table: DataFrame, key: str) -> DataFrame:
    """(column, n_rows, n_missing, n_repeated): for each column how many rows lack a meaningful value, and how many rows
    repeat a key; one pass over the table and one over its keys."""
    missing = [F.count_if(~X.is_meaningful(F.col(c).cast("string"))).alias(c) for c in table.columns]
    one = table.agg(F.count("*").alias("_rows"), *missing)
    keys = table.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated")).withColumn("_1", F.lit(1))
    long = one.unpivot(["_rows"], table.columns, "column", "n_missing").withColumn("_1", F.lit(1))
    return long.join(F.broadcast(keys), "_1").select("column", F.col("_rows").alias("n_rows"), "n_missing", "n_repeated")

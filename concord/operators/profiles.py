"""Profiles of users, made on first sight and changed in part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a new profile holds, and which of it a change may set.
DEFAULTS = {"nickname": "", "college": "", "major": "", "grade": "", "interest_tags": "[]", "focus_contests": "[]", "notify_preference": "daily"}
CHANGEABLE = ["nickname", "college", "major", "grade", "interest_tags", "notify_preference"]
TIMES = ["last_active_time", "create_time", "update_time"]


def user_key(c: Column) -> Column:
    """A user's id without white space around it; null, which no profile has, if nothing is left."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def upsert_profiles(profiles: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """profiles (user_id, DEFAULTS, TIMES; one row a user) after changes (user_id, seq, fields: a map of text).

    A user without a profile gets one with the defaults. Of CHANGEABLE fields the value of the last change that names the
    field counts, null included; other names are ignored. Only a change of some field moves the times of update and of
    activity. Changes of blank users are refused, and those without a map change nothing. Each field is one maximum, so
    that a user with many changes is combined before the shuffle."""
    rows = changes.withColumn("user_id", user_key(F.col("user_id"))).filter("user_id is not null and fields is not null")
    last = [F.max_by(F.struct(F.col("fields")[f].alias("v")), F.when(F.map_contains_key("fields", f), F.col("seq"))).alias(f"_{f}") for f in CHANGEABLE]
    both = profiles.withColumn("_has", F.lit(True)).join(rows.groupBy("user_id").agg(*last), "user_id", "full")
    new, touched = F.col("_has").isNull(), F.coalesce(*[F.col(f"_{f}") for f in CHANGEABLE]).isNotNull()
    at = now.cast("timestamp")

    def value(f: str) -> Column:
        old = F.when(new, DEFAULTS[f]).otherwise(F.col(f))
        return (F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["v"]).otherwise(old) if f in CHANGEABLE else old).alias(f)

    times = [F.when(new | (touched if t != "create_time" else F.lit(False)), at).otherwise(F.col(t)).alias(t) for t in TIMES]
    return both.select("user_id", *map(value, DEFAULTS), *times)

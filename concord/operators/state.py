"""Incremental work: cursors, processed ids, failures, acknowledgement; the same functions serve batches and micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions after which an item is done.
TERMINAL = ["added", "updated", "skipped_ad", "skipped_invalid"]


def route_by_time(items: DataFrame, at: str, cutoff: Column | None) -> DataFrame:
    """items with route: take, late (older than the cut-off) or undated; without a cut-off all are taken."""
    if cutoff is None:
        return items.withColumn("route", F.lit("take"))
    return items.withColumn("route", F.when(F.col(at).isNull(), "undated").when(F.col(at) < cutoff, "late").otherwise("take"))


def incremental_intake(items: DataFrame, cursors: DataFrame, at: str, account: str, now: Column, hours: int, overlap: int = 24) -> DataFrame:
    """The items since min(now - hours - overlap, the account's cursor - overlap); all of them if hours is 0."""
    if hours == 0:
        return items
    back = F.expr(f"INTERVAL {overlap} HOUR")
    start = now - F.expr(f"INTERVAL {hours + overlap} HOUR")
    both = items.join(cursors.select(F.col(account), F.col("last_at").alias("_last")), account, "left")
    return both.filter(F.col(at) >= F.least(start, F.coalesce(F.col("_last") - back, start))).drop("_last")


def drop_processed(items: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """New items, one a key, that are not in processed."""
    return items.dropDuplicates([key]).join(processed.select(key), key, "left_anti")


def upsert_failures(failures: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """failures (key, stage, attempts, first_seen_at, last_seen_at) with one attempt more for each (key, stage) of new."""
    fresh = new.select("key", "stage").distinct().withColumn("_new", F.lit(1))
    both = failures.join(fresh, ["key", "stage"], "full")
    hit = F.col("_new").isNotNull()
    return both.select(
        "key", "stage", (F.coalesce("attempts", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("attempts"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(hit, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def acknowledge(actions: DataFrame, processed: DataFrame, failures: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(processed, failures) after actions (key, action): keys with a terminal action are processed, and their failures go."""
    done = actions.filter(F.col("action").isin(TERMINAL)).select("key").distinct()
    rows = processed.unionByName(done.join(processed.select("key"), "key", "left_anti").withColumn("processed_at", now))
    return rows, failures.join(done, "key", "left_anti")


def advance_cursors(cursors: DataFrame, acked: DataFrame, account: str, at: str) -> DataFrame:
    """cursors (account, last_at) moved on to the newest acknowledged item; they never go back."""
    new = acked.groupBy(account).agg(F.max(at).alias("_at"))
    return cursors.join(new, account, "full").select(account, F.greatest("last_at", "_at").alias("last_at"))

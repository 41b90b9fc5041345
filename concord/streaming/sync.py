"""Micro-batch sync: a table in key buckets of which a batch rewrites those it changes, and keyed state that outlives a
batch. A replayed batch changes nothing."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concord.operators.dedup import shared_folder

#: How long a processed id stays known, and how many of the newest ones an account keeps.
PROCESSED_TTL, MOST_PROCESSED = timedelta(days=90), 5000
#: How far behind an account's newest row a row may lie.
OVERLAP = timedelta(hours=24)
#: How far clocks of machines that a stream runs on may differ: rows count as arrived late only beyond it, so none does.
CLOCK_SLACK = "1 day"


def dedup_within(stream: DataFrame, at: str, key: str, ttl: str = "90 days") -> DataFrame:
    """A stream's first row of each key within a time of event time. Rows that come later than ttl behind the stream's
    newest time are dropped by the watermark; route_stream() keeps them."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def route_stream(stream: DataFrame, account: str, key: str, at: str, ttl: timedelta = PROCESSED_TTL, most: int = MOST_PROCESSED, overlap: timedelta = OVERLAP, order: str | None = None, parts: int = 1) -> DataFrame:
    """The rows of a stream with route: 'late' if a row lies further than overlap behind the newest row of its account in
    earlier batches, 'known' if its key was taken before, else 'take'; 'undated' without a time. Rows of a batch count in
    the order of at and then of the column order (of key, if there is none).

    The state of an account is its newest time, which never goes back, and the keys taken with their times, all in
    microseconds, which pass between Spark and Python as they are: those within
    ttl of the newest time, and of them the newest most. An account that gets no rows for ttl (and CLOCK_SLACK) forgets
    its keys by a timer on the time of arrival and keeps its newest time. Rows without a key are never known. With parts over 1 an account's keys are dealt to so
    many states by a hash, each with a newest time and most keys of its own, so that a busy account is no single task's."""
    from pyspark.sql.types import StringType, StructField, StructType

    fields = [f for f in stream.schema.fields]
    out = StructType([*fields, StructField("route", StringType())])
    cols, (span, lag) = [f.name for f in fields], (x // timedelta(microseconds=1) for x in (ttl, overlap))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, keys, times = state.get if state.exists else (None, [], [])
        if state.hasTimedOut:
            state.update((newest, [], []))
            return
        frames = list(frames)  # of one account in one micro-batch
        rows = frames[0] if len(frames) == 1 else pd.concat(frames)
        micros = lambda c: c.to_numpy("datetime64[us]").astype("int64")
        place = rows[order or key]
        if place.dtype.kind in "iuf":
            by = np.lexsort((place.to_numpy(), micros(rows[at])))
        else:
            by = place.reset_index(drop=True).to_frame("o").assign(t=micros(rows[at])).sort_values(["t", "o"], kind="stable").index.to_numpy()
        known, last, routes = dict(zip(keys, times)), newest, [None] * len(rows)
        at_, no_time, key_, no_key = micros(rows[at]).tolist(), rows[at].isna().tolist(), rows[key].tolist(), rows[key].isna().tolist()
        for i in by.tolist():
            t, k = at_[i], key_[i]
            if no_time[i]:
                routes[i] = "undated"
                continue
            if newest is not None and t < newest - lag:
                routes[i] = "late"
                continue
            last = t if last is None else max(last, t)
            seen = None if no_key[i] else known.get(k)
            if seen is not None and t - seen <= span:
                routes[i] = "known"
                continue
            if not no_key[i]:
                known[k] = t
            routes[i] = "take"
        kept = sorted(((t, k) for k, t in known.items() if last - t <= span), reverse=True)[:most] if last is not None else []
        state.update((last, [k for _, k in kept], [t for t, _ in kept]))
        state.setTimeoutTimestamp((int(micros(rows["_arrived"]).max()) + span) // 1000)
        yield rows[cols].assign(route=routes)

    kind = stream.schema[key].dataType.simpleString()
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    dealt = stream.withColumn("_part", part).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", CLOCK_SLACK)
    return dealt.groupBy(account, "_part").applyInPandasWithState(
        step, out, f"newest long, keys array<{kind}>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


class BucketTable:
    """A Parquet table in folders bucket=k by a hash of its key, of which an upsert rewrites only those that it changes."""

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str, buckets: int = 64):
        self.spark, self.path, self.key, self.seq, self.buckets = spark, path, key, seq, buckets

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def upsert(self, batch: DataFrame) -> int:
        """Merge batch: of the rows of a key, those of the table among them, the one with the smallest seq stays. Returns
        the number of buckets written. The merge reads the touched buckets alone and writes those in which a row of the
        batch wins; the same rows again win nowhere. A job that fails between the buckets is mended by its repetition.

        Only bucket numbers (buckets at most) reach the driver."""
        shared_folder(self.spark)
        first = lambda rows: rows.groupBy("bucket", self.key).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in ("bucket", self.key)]), self.seq).alias("r"))
        new = first(batch.withColumn("bucket", self._bucket())).select("bucket", self.key, "r.*").withColumn("_new", F.lit(True)).checkpoint()
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        merged = new
        if self._exists():
            old = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).withColumn("_new", F.lit(False))
            merged = old.unionByName(new).groupBy("bucket", self.key).agg(F.min_by(F.struct(*[c for c in new.columns if c not in ("bucket", self.key)]), F.struct(self.seq, "_new")).alias("r")).select("bucket", self.key, "r.*")
        merged = merged.select(*new.columns).checkpoint()
        changed = [r.bucket for r in merged.filter("_new").select("bucket").distinct().collect()]
        if changed:
            rows = merged.filter(F.col("bucket").isin(changed)).drop("_new").repartition("bucket")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return len(changed)


def run_stream_sync(stream: DataFrame, table: BucketTable, checkpoint: str) -> None:
    """Upsert all available records of stream into table, one micro-batch after the other."""
    query = stream.writeStream.foreachBatch(lambda batch, _: table.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

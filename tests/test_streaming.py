import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from concord.streaming import sync as S

START = datetime(2026, 1, 1)


def micro(at):
    return (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def simulate(batches, ttl, most, overlap):
    """Routes by event id, one row after the other."""
    newest, known, out = {}, {}, {}
    for batch in batches:
        before = dict(newest)
        for i, account, key, at in sorted((r for r in batch if r[3] is not None), key=lambda r: (r[3], r[0])):
            if account in before and at < before[account] - overlap:
                out[i] = "late"
                continue
            newest[account] = max(newest.get(account, at), at)
            own = known.setdefault(account, {})
            out[i] = "known" if key in own and at - own[key] <= ttl else "take"
            if out[i] == "take":
                own[key] = at
        out.update({r[0]: "undated" for r in batch if r[3] is None})
        for account, own in known.items():
            kept = sorted(((t, k) for k, t in own.items() if newest[account] - t <= ttl), reverse=True)[:most]
            known[account] = {k: t for t, k in kept}
    return out


@pytest.mark.parametrize("most,days", [(5000, 90), (3, 4)])
def test_routes_over_restarts(spark, tmp_path, most, days):
    rng, n, batches = random.Random(most), 0, []
    for b in range(4):
        rows = []
        for _ in range(60):
            n += 1
            at = START + timedelta(hours=rng.randrange(30 * b * 24 // 10, (b + 2) * 72))
            rows.append((n, rng.choice("ab"), f"k{rng.randrange(12)}", at if rng.random() > 0.05 else None))
        batches.append(rows)
    path = f"file://{tmp_path}"
    for rows in batches:
        spark.createDataFrame(rows, "id long, account string, key string, at timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("id long, account string, key string, at timestamp").parquet(f"{path}/in")
        routed = S.route_stream(stream, "account", "key", "at", ttl=timedelta(days=days), most=most, order="id")
        routed.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r.route for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == simulate(batches, timedelta(days=days), most, timedelta(hours=24)) and set(got.values()) == {"take", "known", "late", "undated"}


def times(path):
    return {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, names in os.walk(path) for p in names if p.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = S.BucketTable(spark, f"file://{tmp_path}/t", "k", "seq", buckets=16)
    rows = lambda data: spark.createDataFrame(data, "k long, seq long, v string")
    assert table.upsert(rows([(i, 100 + i, "first") for i in range(200)])) == 16
    was = times(tmp_path / "t")
    assert table.upsert(rows([(7, 3, "earlier"), (7, 5, "between"), (8, 999, "too late"), (1000, 1, "new")])) in (1, 2)
    now = times(tmp_path / "t")
    assert sum(p in was and was[p] == at for p, at in now.items()) >= len(was) - 2
    got = {r.k: (r.seq, r.v) for r in table.read().collect()}
    assert len(got) == 201 and got[7] == (3, "earlier") and got[8] == (108, "first") and got[1000] == (1, "new")
    assert table.upsert(rows([(7, 3, "earlier"), (1000, 1, "new")])) == 0 and times(tmp_path / "t") == now
    assert table.upsert(rows([])) == 0


def test_stream_into_buckets_and_replay(spark, tmp_path):
    path = f"file://{tmp_path}"
    data = [(i % 17, i, f"v{i}") for i in range(300)]
    random.Random(1).shuffle(data)
    spark.createDataFrame(data, "k long, seq long, v string").repartition(6).write.parquet(f"{path}/in")
    table = S.BucketTable(spark, f"{path}/t", "k", "seq", buckets=8)
    for cp in ("cp", "cp", "again"):  # the last one replays all batches under a new checkpoint
        stream = spark.readStream.schema("k long, seq long, v string").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
        S.run_stream_sync(stream, table, f"{path}/{cp}")
    assert sorted((r.k, r.seq) for r in table.read().collect()) == [(k, k) for k in range(17)]


def test_dedup_within_time(spark, tmp_path):
    spark.createDataFrame([(1, "2026-01-01"), (1, "2026-01-05"), (2, "2026-01-02")], "k long, at string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k long, at string").parquet(f"file://{tmp_path}/in")
    out = S.dedup_within(stream, "at", "k").writeStream.format("memory").queryName("within").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp")
    out.trigger(availableNow=True).start().awaitTermination()
    assert spark.table("within").groupBy("k").count().filter(F.col("count") > 1).isEmpty() and spark.table("within").count() == 2


@pytest.mark.parametrize("order", ["id", None])
def test_state_passes_as_whole_numbers(spark, tmp_path, monkeypatch, order):
    """Times in the state are microseconds, so that an account's keys are not turned into times and back in every batch."""
    import pandas as pd
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    asked = []
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandasWithState", lambda self, f, out, schema, *_: asked.append((f, schema)))
    spark.createDataFrame([], "id long, account string, key string, at timestamp").write.parquet(f"file://{tmp_path}/in")
    S.route_stream(spark.readStream.schema("id long, account string, key string, at timestamp").parquet(f"file://{tmp_path}/in"), "account", "key", "at", order=order)
    (step, schema), kept = asked[0], []

    class State:
        exists, hasTimedOut = True, False
        get = (micro(START), ["k1"], [micro(START)])
        update = staticmethod(kept.append)
        setTimeoutTimestamp = staticmethod(kept.append)

    at = [START + timedelta(hours=1), None, START - timedelta(days=2), START + timedelta(days=91), START + timedelta(minutes=5)]
    rows = pd.DataFrame({"id": range(5), "account": "a", "key": ["k1", "k2", "k3", "k1", None], "at": pd.to_datetime(at), "_arrived": pd.to_datetime([START] * 5), "_part": 0})
    got = pd.concat(step(("a", 0), iter([rows]), State))
    assert list(got["route"]) == ["known", "undated", "late", "take", "take"] and list(got.columns) == ["id", "account", "key", "at", "route"]
    newest, times = micro(START + timedelta(days=91)), [micro(START + timedelta(days=91))]
    assert kept == [(newest, ["k1"], times), (micro(START) + 90 * 24 * 3600 * 1_000_000) // 1000] and all(type(x) is int for x in (kept[0][0], *kept[0][2]))
    assert "timestamp" not in schema

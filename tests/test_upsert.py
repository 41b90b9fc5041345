from pyspark.sql import functions as F

from concord.operators import upsert as U
from concord.sources.tables import TableStore

RAW = "seq long, title string, url string, organizer string, category string, contest_level string, authority_level string, source_name string, deadline timestamp, event_time timestamp, summary string"


def rows(spark, data):
    cols = ["seq", "title", "url", "organizer", "summary", "deadline"]
    full = [dict(zip(cols, d)) for d in data]
    return spark.createDataFrame([(d["seq"], d["title"], d["url"], d["organizer"], "其他", None, "中", "web", None, None, d["summary"]) for d in full], RAW).withColumn("deadline", F.lit("2026-08-01 00:00:00").cast("timestamp"))


def test_batches_are_merged_once_and_repeated_without_change(spark, tmp_path):
    store, now = TableStore(spark, f"file://{tmp_path}/store"), F.lit("2026-07-01 00:00:00").cast("timestamp")
    first = rows(spark, [(1, "2026年机器人大赛", "https://x/1", "", ""), (2, "2026年机器人大赛决赛", "https://x/2", "学会", "later"), (3, "作文大赛", "https://x/3", "a", "s"), (4, " ", "u", "", ""), (5, "考研培训", "u", "", "")])
    got = {r.seq: r.action for r in U.sync_events(store, first, now).collect()}
    assert got == {1: "added", 2: "updated", 3: "added", 4: "skipped_invalid", 5: "skipped_ad"}
    state = lambda: {n: sorted(map(tuple, store.read(n).collect()), key=repr) for n in ("catalog", "editions", "evidence")}
    was = state()
    assert len(was["catalog"]) == 2 and len(was["editions"]) == 2
    robot = next(r for r in store.read("editions").collect() if r.year == 2026)
    assert robot.title == "2026年机器人大赛决赛" and robot.summary == "later" and robot.status == "报名中" and robot.event_id.startswith("EVT-")
    again = {r.seq: r.action for r in U.sync_events(store, first, now).collect()}
    assert again == {**got, 1: "updated", 3: "updated"} and state() == was
    U.sync_events(store, rows(spark, [(9, "作文大赛", "https://x/3", "better", "other")]), now)
    story = next(r for r in store.read("editions").collect() if r.year is None)
    assert story.summary == "s"  # a later row fills gaps only
    assert store.read("evidence").filter("field_value = 'other'").count() == 1  # but leaves its evidence
    assert U.flat_events(store.read("catalog"), store.read("editions")).count() == 2


def test_rows_of_a_batch_find_each_other(spark):
    now = F.lit("2026-07-01 00:00:00").cast("timestamp")
    data = rows(spark, [(1, "杯赛", "https://x/1", "", ""), (2, "杯赛", "https://x/1", "", ""), (3, "杯赛", "", "", ""), (4, "2026年杯赛", "https://x/9", "", ""), (5, "杯赛", "https://x/9", "", "")])
    empty = [spark.createDataFrame([], s) for s in (U.CATALOG, U.EDITIONS, U.EVIDENCE)]
    got = {r.seq: r.event_id for r in U.merge_events(data, *empty, now)["actions"].collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] and len(set(got.values())) == 3


def test_blank_urls_and_approval(spark):
    now = F.lit("2026-07-01 00:00:00").cast("timestamp")
    empty = [spark.createDataFrame([], s) for s in (U.CATALOG, U.EDITIONS, U.EVIDENCE)]
    data = rows(spark, [(1, "2026年机器人大赛", "", "", ""), (2, "机器人大赛", "", "", ""), (3, "机器人大赛", None, "", "")])
    first = U.merge_events(data, *empty, now)
    editions = {(r.title, r.year) for r in first["editions"].collect()}
    assert editions == {("2026年机器人大赛", 2026), ("机器人大赛", None)}
    assert {r.seq: r.action for r in first["actions"].collect()} == {1: "added", 2: "added", 3: "updated"}
    later = data.filter("seq = 1").withColumn("source_name", F.lit(U.APPROVING_SOURCES[0])).withColumn("url", F.lit("https://x/1"))
    tables = [first[n].checkpoint() for n in ("catalog", "editions", "evidence")]
    for promote in (False, True):
        got = U.merge_events(later, *tables, now, promote)
        assert [r.is_ministry_approved for r in got["catalog"].collect()] == [promote]
        assert got["evidence"].filter("field_name = 'source_url' and field_value = 'https://x/1'").count() == 1
    assert U.merge_events(later, *empty, now)["catalog"].first().is_ministry_approved


def test_titles_are_judged_once_for_each_kind(spark, monkeypatch):
    now = F.lit("2026-07-01 00:00:00").cast("timestamp")
    empty = [spark.createDataFrame([], s) for s in (U.CATALOG, U.EDITIONS, U.EVIDENCE)]
    seen = spark.sparkContext.accumulator(0)
    key = U.X.catalog_key

    def look(x):
        seen.add(1)
        return x

    monkeypatch.setattr(U.X, "catalog_key", lambda c: F.udf(look, "string")(key(c)))
    data = rows(spark, [(i, f"{2020 + i % 3}年杯赛", f"https://x/{i % 2}", "", "s") for i in range(300)])
    got = U.merge_events(data, *empty, now)
    assert got["actions"].groupBy("action").count().count() == 2 and got["editions"].count() == 3 and got["catalog"].count() == 1
    assert 0 < seen.value <= 24  # six kinds, not 300 rows


def test_evidence_that_is_held_stays_as_it_is(spark):
    held = spark.createDataFrame([("e", "summary", "s", "u"), ("e", "summary", "s", "u"), ("f", "summary", None, "u")], U.EVIDENCE)
    new = rows(spark, [(1, "t", "u", "", "s"), (2, "t", "u", "", "other")]).withColumn("event_id", F.lit("e")).drop("deadline").withColumn("deadline", F.lit(None).cast("timestamp"))
    got = sorted(map(tuple, U.merge_evidence(held, new).filter("field_name = 'summary'").collect()), key=repr)
    assert got == [("e", "summary", "other", "u"), ("e", "summary", "s", "u"), ("e", "summary", "s", "u"), ("f", "summary", None, "u")]

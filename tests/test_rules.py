"""Cases of the rules on small inline rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from concord.functions import extract as E
from concord.functions import text as X
from concord.functions import times as T
from concord.operators import dedup as D
from concord.operators import match as M
from concord.operators import merge as G
from concord.operators import rank as R
from concord.sources.tables import TableStore


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_days_remaining(spark):
    now = F.lit("2026-07-16 12:00:00").cast("timestamp")
    f = lambda c: T.days_remaining(T.parse_event_ts(c)["ts"], T.parse_event_ts(c)["offset_sec"], now)
    cases = ["2026-07-16T23:59:59+00:00", "2026-07-23T12:00:00+00:00", "2026-08-15T12:00:00+00:00", "2026-07-16T11:59:59+00:00", None, "not-a-date"]
    assert values(spark, f, cases) == [0, 7, 30, -1, None, None]
    late = F.lit("2026-07-16 23:30:00").cast("timestamp")
    g = lambda c: T.days_remaining(T.parse_event_ts(c)["ts"], T.parse_event_ts(c)["offset_sec"], late)
    assert values(spark, g, ["2026-07-17T10:00:00+08:00"]) == [0]


def test_strict_timestamps(spark):
    got = values(spark, lambda c: T.parse_event_ts(c)["ts"].cast("string"), ["2026-08-01T10:00:00+08:00", "2026-08-01T10:00:00", "2026-02-31T10:00:00+08:00", "not-a-date"])
    assert got == ["2026-08-01 02:00:00", None, None, None]


def test_status(spark):
    now = dt.datetime(2026, 7, 1, 12)
    inputs = [None, now + dt.timedelta(days=10), now + dt.timedelta(days=3, hours=23), now + dt.timedelta(days=4), now - dt.timedelta(days=2)]
    assert values(spark, lambda c: T.status_of(c, F.lit(str(now)).cast("timestamp")), inputs, "timestamp") == ["none", "open", "closing", "open", "expired"]


def test_ranges(spark):
    got = values(spark, lambda c: F.concat_ws("/", T.range_dates(c, 2027)["start"], T.range_dates(c, 2027)["end"]), ["AUG 22 - 24", "Jun 29-Aug 3", "Aug 22 - 24, 2026", "x"])
    assert got == ["2027-08-22/2027-08-24", "2027-06-29/2027-08-03", "2026-08-22/2026-08-24", ""]


def test_labelled_dates(spark):
    f = lambda c: T.labelled_date(c, T.DEADLINES, "23:59:59")
    assert values(spark, f, ["报名截止：2026年2月30", "截止日期：2026-2-28", "x"]) == [None, "2026-02-28T23:59:59+08:00", None]


def test_urls(spark):
    assert values(spark, X.url_key, ["https://www.A.org/x/", "http://a.org:80/y", "https://a.org/"]) == ["a.org/x", "a.org:80/y", "a.org/"]
    assert values(spark, X.source_domain, ["https://news.example.com/a", "http://events.university.edu.cn", "http://localhost"]) == ["example.com", "university.edu.cn", ""]
    cases = ["https://a.org", "file:///x", "http://localhost/", "http://127.0.0.1/", "http://192.168.0.2", "http://10.1.1.1/", "https://[::1]/", None]
    assert values(spark, X.is_public_url, cases) == [True] + [False] * 7
    assert values(spark, X.is_listing_url, ["", "https://x.org/hackathons/slug", "https://x.org/hackathons/a/b"]) == [True, True, False]


def test_titles(spark):
    assert values(spark, X.catalog_key, ["2026年第十二届 全国 竞赛（2026）决赛", None]) == ["全国竞赛", None]
    assert values(spark, X.edition_year, ["2026年", "第1999届 2026", "none"]) == [2026, None, None]
    assert values(spark, X.catalog_name_key, ["创新(ab)大赛", "大赛", "abc竞赛"]) == ["创新大赛", "大赛", "abc"]
    assert values(spark, lambda c: X.is_promotion(c, 1), ["保研）定位", "GRE 冲刺", "数学竞赛"]) == [True, False, False]
    assert values(spark, lambda c: X.is_promotion(c, 2), ["保研）定位", "GRE 冲刺", "数学竞赛"]) == [True, True, False]


def test_topic_and_status_words(spark):
    f = lambda c: X.is_topic(c, F.lit(""))
    assert values(spark, f, ["Spring Hackathon", "校园黑客松", "hackathon recap", "training", "黑客松训练营"]) == [True, True, False, False, False]
    assert values(spark, E.registration_status, ["Registration has ended", "报名 已 截止", "Apply now", "x"]) == ["closed", "closed", "open", None]
    assert values(spark, E.organizer, ["主办单位：南京大学学生会，欢迎", "由 计算机学院 主办", "none"]) == ["南京大学学生会", "计算机学院", None]


def test_greedy_or_is_not_two_windows(spark):
    df = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t1"), (3, "u2", "t3"), (4, "u3", "t3")], "seq long, u string, t string")
    assert [r.seq for r in D.dedup_greedy_or(df, "u", "t").orderBy("seq").collect()] == [1, 3]
    assert D.dedup_greedy_or(df.limit(0), "u", "t").count() == 0


def test_round_robin(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(10)], "seq long, s string")
    assert [r.s for r in D.cap_round_robin(df, 4, "s").orderBy("place").collect()] == ["a", "b", "a", "b"]
    assert [r.seq for r in D.cap_round_robin(df, 20, "s").orderBy("place").collect()] == list(range(10))


def test_consensus(spark):
    rows = [(1, 1, "a.org", "level", "x"), (1, 2, "b.org", "level", "x"), (2, 1, "a.org", "level", "x"), (2, 2, "a.org", "level", "x"), (3, 1, "a.org", "level", "x"), (3, 2, "b.org", "level", "y")]
    got = G.consensus(spark.createDataFrame(rows, "entity_id int, seq int, domain string, field string, value string")).collect()
    assert [(r.entity_id, r.value, r.n_agree) for r in got] == [(1, "x", 2)]


def test_fold_is_field_by_field(spark):
    schema = "id int, seq int, organizer string, authority_level string, is_ministry_approved boolean"
    old = spark.createDataFrame([(1, 0, "a", "低", False)], schema)
    new = spark.createDataFrame([(1, 1, "b", "高", None), (1, 2, "c", "中", None), (2, 1, None, "低", True), (2, 2, "d", "高", False)], schema)
    got = {r.id: (r.organizer, r.authority_level, r.is_ministry_approved) for r in G.fold(old, new, "id", ["organizer", "authority_level"]).collect()}
    assert got == {1: ("b", "高", False), 2: ("d", "低", True)}


@pytest.mark.parametrize("least", [0.85, 0.7])
def test_fuzzy_match_loses_nothing(spark, least):
    import random

    r = random.Random(2)
    words = ["".join(r.choices("abc", k=r.randrange(1, 14))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(words)), "seq long, key string")
    got = {(x.l_seq, x.r_seq) for x in M.fuzzy_match(df, df.withColumn("seq", F.col("seq") + 1000), "key", least).collect()}

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for i, a in enumerate(words):
        best = max(((1 - dist(a, b) / max(len(a), len(b)), -j) for j, b in enumerate(words)), default=None)
        if best and best[0] >= least:
            want.add((i, 1000 - best[1]))
    assert got == want


def test_ordered_subsequence(spark):
    df = spark.createDataFrame([("abc", "xaybzc"), ("abc", "cba")], "a string, b string")
    assert [round(r.in_order, 2) for r in M.charset_match(df, "a", "b", "order").collect()] == [1.0, 0.33]


def test_store_keeps_old_table_until_the_end(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    assert not store.exists("t")
    store.overwrite("t", spark.range(3))
    store.overwrite("t", store.read("t").filter("id > 0"))
    assert store.read("t").count() == 2


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "a b\nc d e\nf\n" + "g " * 9)], "id int, text string")
    got = R.chunk_documents(df, "text", 5).orderBy("chunk").collect()
    assert [r.chunk_text for r in got] == ["a b\nc d e", "f", "g " * 9]

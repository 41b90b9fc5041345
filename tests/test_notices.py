from datetime import datetime

from pyspark.sql import functions as F

from concord.functions import notices as N
from concord.operators import api as A


def one(spark, c, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(c.alias("v")).first().v


def test_values_behind_labels(spark):
    text = "\n".join(["欢迎", "主办方：", "", "参赛对象：全体学生", "某某大学", "主办单位： 省  学会 ", "竞赛类别:" + "x" * 300, "类别： 理工", "报名截止：2026.3.4 前", "状态：\n", "", ""])
    got = one(spark, N.label_values(F.col("t")), t=text)
    assert got.asDict() == {"organizer": "某某大学", "category": None, "registration_time": "2026.3.4 前", "contest_time": None, "participant_scope": "全体学生", "fee_or_status": None}
    assert set(one(spark, N.label_values(F.col("t")), t=None).asDict().values()) == {None}
    df = spark.createDataFrame([("说明 报名日间：2026/5/6 至 5/9。完",)], "t string")
    assert N.detail_fields(df, "t").first().registration_time == "2026/5/6 至 5/9"


def test_article_urls_and_redirects(spark):
    url = "https://mp.weixin.qq.com/s?scene=1&sn=ab&idx=2&mid=77&__biz=Mz%3D&x=9#top"
    u = F.col("u")
    assert one(spark, N.article_url(u), u=url) == "https://mp.weixin.qq.com/s?__biz=Mz%3D&mid=77&idx=2&sn=ab"
    assert one(spark, N.article_url(u, {"mid": F.lit("5")}), u=url) == "https://mp.weixin.qq.com/s?__biz=Mz%3D&mid=5&idx=2&sn=ab"
    assert one(spark, N.article_url(u), u="https://mp.weixin.qq.com/s/abc?z=1") == "https://mp.weixin.qq.com/s/abc?z=1"
    assert [one(spark, N.article_url(u), u=x) for x in ("http://mp.weixin.qq.com/s", "https://evil.org/mp.weixin.qq.com", "", None)] == [""] * 4
    page = "var url='';url += 'https://mp.wei'; url += \"xin.qq.com/s?a=@1&amp;timestamp=2\";"
    assert one(spark, N.redirect_target(F.col("p")), p=page) == "https://mp.weixin.qq.com/s?a=1&timestamp=2"
    assert [one(spark, N.redirect_target(F.col("p")), p=x) for x in ("url += 'https://other.org';", "none", None)] == [None] * 3


def test_links_to_details(spark):
    page = """<a href="/c/1" class=x>First Open Cup<b>!</b></a><a href="https://m.site.org/c/1?x=1">Copy of it</a><A title="Long title here" HREF='/c/2'>go</A>
      <a href="/about">About the site</a><a href="/c/3">first open cup!</a><a href="ftp://x/c/4">Other protocol</a><a href="/c/5">ab</a><a name="n">none</a><a href="/c/6">考研培训 报名</a>"""
    got = one(spark, N.detail_links(F.col("p"), "https://www.site.org", r"/c/\d+", {"m.site.org": "www.site.org"}), p=page)
    assert [tuple(x) for x in got] == [("First Open Cup!", "https://www.site.org/c/1"), ("Long title here", "https://www.site.org/c/2")]


def test_read_api(spark):
    now = F.lit("2026-07-01 00:00:00").cast("timestamp")
    at = lambda d: datetime(2026, 7, d)
    rows = [("a", "报名中", at(5)), ("b", "即将截止", at(3)), ("c", "报名中", at(2)), ("d", "已截止", at(2)), ("e", "报名中", at(20)), ("b", "报名中", at(6)), ("f", "报名中", None)]
    events = spark.createDataFrame(rows, "event_id string, status string, deadline timestamp")
    assert [r.event_id for r in A.reminders(events, now).collect()] == ["c", "a", "b"]
    full = spark.createDataFrame([("a", "T", None), ("b", "U", "text")], "event_id string, title string, original_text string")
    assert [tuple(r) for r in A.detail(full, F.lit("a")).collect()] == [("a", "T", "")] and A.detail(full, F.lit("z")).count() == 0
    q = {r.column: (r.n_rows, r.n_missing, r.n_repeated) for r in A.quality(events, "event_id").collect()}
    assert q == {"event_id": (7, 0, 1), "status": (7, 0, 1), "deadline": (7, 1, 1)}
    acc = spark.createDataFrame([("n2", "x"), ("n1", "x"), ("n3", "y")], "name string, account_class string")
    assert sorted((r.account_class, r.n, r.total, r.names) for r in A.accounts(acc).collect()) == [("x", 2, 3, ["n1", "n2"]), ("y", 1, 3, ["n3"])]

import json
from datetime import datetime

from pyspark.sql import functions as F

from concord.functions import candidates as CF
from concord.functions import preview as V
from concord.operators import candidates as C
from concord.operators.profiles import CHANGEABLE, DEFAULTS, upsert_profiles
from concord.sources import tables as IO

LISTED = "url_key string, " + C.CANDIDATE.split(", ", 1)[1]
PAGES, PARSED = "url_key string, page_title string, text string", "url_key string, title string, mode string"


def one(spark, c, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(c.alias("v")).first().v


def test_separated_organizers(spark):
    t = F.col("t")
    got = [one(spark, V.separated_organizer(t), t=x) for x in ["主办单位： 甲大学 ，乙", "主办 x" + "y" * 60 + "：太远", "主办：甲\n承办是乙。丙", "主办：甲 承办：", "组织者为\n学会\n", "没有", ""]]
    assert got == ["甲大学 ", "", "乙", "", "学会", "", ""]


def test_notice_previews(spark):
    rows = spark.createDataFrame([(1, "  短\n 关于全国ACM竞赛团队报名 \n保研", "https://www.nju.edu.cn/1"), (2, None, None), (3, "x" * 5000, "")], "id int, t string, u string")
    got = {r.id: r.preview for r in V.parse_notices(rows, "t", "u").collect()}
    assert (got[1].title, got[1].scope_type, got[1].contest_level, got[1].category, got[1].authority_level) == ("关于全国ACM竞赛团队报名", "校外竞赛", "国家级", "程序设计竞赛", "高")
    assert json.loads(got[1].tags) == ["需要组队", "保研相关"] and json.loads(got[1].policy_tags) == ["保研可能相关"]
    assert None not in got[2] and (got[2].title, got[2].category, got[2].tags, got[2].source_name) == ("", "其他", "[]", "")
    assert [len(got[3][c]) for c in ("title", "summary", "original_text")] == [200, 100, 2000]


def test_sources_and_authority(spark):
    f, n, u = F.col("f"), F.col("n"), F.col("u")
    source = lambda *v: one(spark, CF.candidate_source(f, n, u), f=v[0], n=v[1], u=v[2])
    assert source("mlh_listing", "devpost", "https://x.org") == "mlh"
    assert source(None, "My Hackclub", None) == "hackclub"
    assert source(None, "mlh feed", "https://a.mlh.com/e") == "mlh"
    assert source(None, None, None) == "unknown" and source("", "", "https://x.org/devpost") == "general_search"
    assert one(spark, CF.authority(n, u), n=" LOW ", u="https://a.edu.cn") == "低"
    assert [one(spark, CF.authority(n, u), n=None, u=x) for x in ("https://a.edu.cn/x", "https://x.org/.edu", None)] == ["高", "中", "中"]
    assert one(spark, CF.source_label(n, u), n="unknown", u="https://" + "a" * 100) == "a" * 80


def test_lines_titles_links_and_missing_fields(spark):
    h = F.col("h")
    page = "<title> Big&amp;Best -Site</title>\x07<p>one  &lt;two&gt;\n\n <b>thr</b>ee</p><script>no\nno</script><!-- no -->\r\nfour five six"
    assert one(spark, CF.visible_lines(h), h=page) == ["Big&Best -Siteone <two>", "three", "four", "five six"]
    assert one(spark, CF.visible_lines(h), h=None) is None and one(spark, CF.visible_lines(h), h="") == []
    assert [one(spark, CF.platform_page_title(h, "[-_]?Site", "Site"), h=x) for x in (page, "<title>Site - all</title>", "", None)] == ["Big&Best", "", "", ""]
    links = '<a href="https://Own.org/1">a</a><a HREF="http://b.org">b</a><a href="http://b.org">c</a><a href="/d">d</a>'
    assert one(spark, CF.external_links(h, ["own.org"]), h=links) == ["http://b.org"]
    assert one(spark, CF.missing_fields({"a": h, "b": F.lit("[]"), "c": F.lit(0), "d": F.lit(None)}), h=" ") == ["a", "b", "d"]
    assert [one(spark, CF.is_event_url(h), h=x) for x in ("https://a.devpost.com/", "https://a.devpost.com/rules", None)] == [True, False, True]


def test_decisions_of_listings_details_and_duplicates(spark):
    row = lambda seq, **v: tuple({"seq": seq, "place": 0, "source": "devpost", "tags": [], **v}.get(c) for c in C.NAMES)
    rows = [
        row(1, title="A", url="https://x.org/hackathons", signup_deadline="2026-08-20", authority="high"),
        row(2, url="https://l.org/hackathons"), row(3, url="https://d.org/e/1"), row(4, url="https://d.org/e/1?x=1"), row(5, url="https://d.org/e/2"), row(6), row(7, url="https://e.org/e/7"),
    ]
    inner = lambda place, **v: ("l.org/hackathons", *row(0, place=place, **v)[1:])
    listed = [inner(1, title="a", signup_deadline="2026-08-20", authority="medium"), inner(2, title="B", platform_id="7", signup_deadline="2026-07-01", authority="medium"), inner(3, url="https://d.org/e/1"), inner(4, title="【A】", source="mlh", signup_deadline="2026-08-20", authority="medium")]
    pages = [("d.org/e/1", "Hackathon C", "A hackathon, register now. Deadline: 2026-08-15."), ("d.org/e/2", "Soup", "cooking")]
    make = spark.createDataFrame
    parts = make(rows, C.CANDIDATE), make(listed, LISTED), make(pages, PAGES), make([("d.org/e/1", "", "online")], PARSED)
    got = C.decide(*parts, F.lit("2026-08-01").cast("timestamp"), 2026, 100).collect()
    assert {(r.seq, r.place): r.reason for r in got} == {
        (1, 0): "accepted", (2, 1): "prefetch_duplicates", (2, 4): "postparse_duplicates", (2, 2): "expired_filtered", (2, 3): "prefetch_duplicates", (3, 0): "accepted", (4, 0): "prefetch_duplicates", (5, 0): "not_hackathon", (7, 0): "fetch_failed",
    }
    c = next(r for r in got if r.seq == 3)
    assert (c.title, c.mode, c.signup_deadline, c.kind) == ("Hackathon C", "online", "2026-08-15", "detail")
    e = C.to_events(make([c], C.CANDIDATE + ", kind string, reason string")).first()
    assert (json.loads(e.tags), e.status, e.authority_level, e.signup_deadline) == (["黑客松", "线上"], "报名中", "中", "2026-08-15T00:00:00+08:00")
    few = C.decide(*parts, F.lit("2026-08-01").cast("timestamp"), 2026, 1).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in few} == {"accepted": 1, "prefetch_duplicates": 1, "truncated_by_limit": 5}
    empty = [make([], s) for s in (C.CANDIDATE, LISTED, PAGES, PARSED)]
    assert C.decide(*empty, F.lit("2026-08-01").cast("timestamp"), 2026, 9).collect() == []


def test_profiles_are_changed_in_part(spark):
    schema = "user_id string, " + ", ".join(f"{c} string" for c in DEFAULTS) + ", last_active_time timestamp, create_time timestamp, update_time timestamp"
    then, now = datetime(2020, 1, 1), datetime(2026, 1, 1)
    old = spark.createDataFrame([("a", "n", "c", "m", "g", "[]", '["x"]', "never", then, then, then), ("b", "", "", "", "", "[]", "[]", "daily", then, then, then)], schema)
    ops = [(" a ", 1, {"major": "old"}), ("a", 3, {"major": "new", "focus_contests": "no"}), ("a", 2, {"grade": None}), ("b", 1, {"other": "x"}), ("c", 1, {}), ("d", 1, None), ("  ", 1, {"major": "x"}), (None, 1, {"major": "x"})]
    changes = spark.createDataFrame(ops, "user_id string, seq long, fields map<string,string>")
    got = {r.user_id: r for r in upsert_profiles(old, changes, F.lit(now)).collect()}
    assert got.keys() == {"a", "b", "c"}
    a = got["a"]
    assert (a.major, a.grade, a.nickname, a.focus_contests, a.notify_preference, a.create_time, a.update_time) == ("new", None, "n", '["x"]', "never", then, now)
    assert got["b"].update_time == then and got["c"].create_time == now and [got["c"][f] for f in CHANGEABLE] == [DEFAULTS[f] for f in CHANGEABLE]
    assert upsert_profiles(old.limit(0), changes.limit(0), F.lit(now)).collect() == []


def test_source_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"known_platforms": [{"name": "A", "domain": "A.org", "authority": "high"}, {"name": "B", "domain": "x.a.org", "authority": "medium"}, {"name": "C", "domain": "a.org"}], "exclusion_patterns": ["Recap"]}, indent=1))
    config = IO.read_source_config(spark, f"file://{tmp_path}/c.json")
    assert config.limits == {"max_future_days": 400, "max_page_bytes": 2097152} and config.exclusion_patterns == ["Recap"] and config.platforms.count() == 2
    rows = [(1, "https://u@www.a.org:80/x", "t"), (2, "https://y.x.A.org", None), (3, "https://ba.org/a.org", "t"), (4, "https://a.org", "the RECAP"), (5, None, "t")]
    pages = spark.createDataFrame(rows, "id int, url string, title string").withColumn("html", F.lit("x"))
    got = {r.id: (r.platform, r.platform_authority) for r in IO.apply_source_config(pages, config, "url", "title", "html").collect()}
    assert got == {1: ("A", "high"), 2: ("B", "medium"), 3: (None, "low"), 5: (None, "low")}


def test_account_classes(spark):
    core = spark.createDataFrame([("z", "d", "school_level"), ("a", "d", "college"), ("q", "d", "other")], "name string, descr string, category string")
    found = spark.createDataFrame([(1, "n", "first"), (2, "n", "second"), (3, "a", "x"), (4, "", "x"), (5, None, "x")], "seq long, name string, descr string")
    got = [(r.name, r.descr, r.category, r.is_core) for r in C.merge_account_lists(core, found).collect()]
    assert got == [("z", "d", "school_level", True), ("a", "d", "college", True), ("n", "first", "dynamic", False)]

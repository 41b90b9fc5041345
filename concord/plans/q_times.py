"""Queries of dates, deadlines and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import dates as D
from concord.functions import times as T
from concord.plans.q_text import EVENTS_SQL, NOW, as_events
from concord.plans.register import query, table



def AT():
    return F.lit(NOW).cast("timestamp")


#: orders' dates as text in several forms, alike in Spark and DuckDB.
_FORMS = """CASE o_orderkey % 6 WHEN 0 THEN {d} || 'T10:00:00+08:00' WHEN 1 THEN {d} || 'T10:00:00' WHEN 2 THEN {d} || 'T23:30:00Z'
  WHEN 3 THEN '1998-02-31T10:00:00+08:00' WHEN 4 THEN 'not-a-date' ELSE {d} || 'T01:15:00-05:30' END"""
_SPARK_FORMS = _FORMS.format(d="date_format(o_orderdate, 'yyyy-MM-dd')")
_DUCK_FORMS = _FORMS.format(d="strftime(o_orderdate, '%Y-%m-%d')")
#: The instant and offset that those forms stand for.
_PARSED = """(SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate::date + INTERVAL 2 HOUR WHEN 2 THEN o_orderdate::date + INTERVAL 1410 MINUTE
  WHEN 5 THEN o_orderdate::date + INTERVAL 405 MINUTE END AS ts, CASE o_orderkey % 6 WHEN 0 THEN 28800 WHEN 2 THEN 0 WHEN 5 THEN -19800 END AS off FROM orders)"""


def parsed(spark, sf):
    p = T.parse_event_ts(F.expr(_SPARK_FORMS))
    return table(spark, sf, "orders").select("o_orderkey", p["ts"].alias("ts"), p["offset_sec"].alias("off"))


@query(f"SELECT o_orderkey, CAST(epoch(ts) AS BIGINT) AS sec, off FROM {_PARSED}")
def t1_parse_event_ts(spark, sf):
    return parsed(spark, sf).select("o_orderkey", F.unix_timestamp("ts").alias("sec"), "off")


@query("""SELECT o_orderkey, CAST(epoch(o_orderdate::date) AS BIGINT) + 36000 AS utc, CAST(epoch(o_orderdate::date) AS BIGINT) + 7200 AS local,
  CAST(epoch(o_orderdate::date) AS BIGINT) + 86399 - 28800 AS day_end FROM orders""")
def t2_coerce_ts(spark, sf):
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    naive, slash = F.expr(f"{day} || 'T10:00:00'"), F.date_format("o_orderdate", "yyyy/MM/dd")
    sec = lambda c: F.unix_timestamp(c)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        sec(T.coerce_ts(naive)).alias("utc"),
        sec(T.coerce_ts(naive, "Asia/Shanghai")).alias("local"),
        sec(T.coerce_ts(slash, "Asia/Shanghai", True)).alias("day_end"),
    )


@query(f"""SELECT o_orderkey, CASE WHEN ts IS NULL THEN NULL WHEN ts < TIMESTAMP '{NOW}' THEN -1
  ELSE date_diff('day', CAST(TIMESTAMP '{NOW}' + to_seconds(off) AS DATE), CAST(ts + to_seconds(off) AS DATE)) END AS days FROM {_PARSED}""")
def t3_days_remaining(spark, sf):
    return parsed(spark, sf).select("o_orderkey", T.days_remaining(F.col("ts"), F.col("off"), AT()).cast("long").alias("days"))


@query(f"SELECT event_id, CASE WHEN s < deadline THEN NULL ELSE strftime(s, '%Y-%m-%d') END AS start FROM (SELECT event_id, deadline, CASE WHEN event_id % 2 = 0 THEN start - INTERVAL 60 DAY ELSE start END AS s FROM {EVENTS_SQL})")
def t4_timeline(spark, sf):
    e = as_events(spark, sf).withColumn("s", F.when(F.col("event_id") % 2 == 0, F.col("start") - F.expr("INTERVAL 60 DAY")).otherwise(F.col("start")))
    return e.select("event_id", F.date_format(T.timeline(F.col("deadline"), F.col("s")), "yyyy-MM-dd").alias("start"))


_STATUS_SQL = f"""CASE WHEN deadline IS NULL THEN '暂无本届信息' WHEN floor((epoch_us(deadline) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0) < 0 THEN '已截止'
  WHEN floor((epoch_us(deadline) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0) <= 3 THEN '即将截止' ELSE '报名中' END"""


@query(f"SELECT event_id, {_STATUS_SQL} AS state FROM {EVENTS_SQL}")
def t5_status(spark, sf):
    return as_events(spark, sf).select("event_id", T.state_name(T.status_of(F.col("deadline"), AT())).alias("state"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 7 THEN '暂无本届信息' WHEN ts IS NULL THEN '待确认' WHEN ts < TIMESTAMP '{NOW}' THEN '已截止'
  WHEN ts < TIMESTAMP '{NOW}' + INTERVAL 4 DAY THEN '即将截止' ELSE '报名中' END AS state FROM {_PARSED}""")
def t5_status_of_text(spark, sf):
    text = F.when(F.col("o_orderkey") % 12 != 7, F.expr(_SPARK_FORMS)).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", T.state_name(T.status_of_text(text, AT())).alias("state"))


@query(f"SELECT status AS old, {_STATUS_SQL} AS new, count(*) AS n FROM (SELECT deadline, CASE WHEN event_id % 3 = 0 THEN '报名中' ELSE '已截止' END AS status FROM {EVENTS_SQL}) WHERE status <> {_STATUS_SQL} GROUP BY ALL")
def t6_refresh_status(spark, sf):
    e = as_events(spark, sf).withColumn("status", F.when(F.col("event_id") % 3 == 0, T.STATES["open"]).otherwise(T.STATES["expired"]))
    _, changed = T.refresh_status(e, "deadline", "status", AT())
    return changed.groupBy(F.col("status").alias("old"), F.col("_new").alias("new")).agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(to_timestamp(event_id * 1000) AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%dT%H:%M:%S') AS v FROM events")
def t7_epoch_to_ts(spark, sf):
    return table(spark, sf, "events").select("event_id", T.epoch_to_iso(F.col("event_id") * 1000).alias("v"))


_REG = "CASE event_id % 7 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' WHEN 2 THEN 'upcoming' ELSE NULL END"
_DL = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE deadline END"
_ST = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE start END"


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN r = 'closed' THEN 'closed_filtered' WHEN d < t THEN 'expired_filtered'
  WHEN s < t AND NOT coalesce(r = 'open' AND e >= t, false) THEN 'event_passed_filtered'
  WHEN d > t + INTERVAL 400 DAY OR s > t + INTERVAL 400 DAY OR e > t + INTERVAL 400 DAY THEN 'too_far_future_filtered'
  WHEN s < d OR e < s THEN 'invalid_date_filtered' WHEN d IS NULL AND s IS NULL AND r IS NULL THEN 'unverified_skipped'
  WHEN d IS NULL AND r = 'open' AND e >= t THEN 'accepted' WHEN d IS NULL AND r IN ('open', 'upcoming') AND s >= t THEN 'accepted'
  WHEN d >= t THEN 'accepted' ELSE 'unverified_skipped' END AS reason
  FROM (SELECT {_REG} AS r, {_DL} AS d, {_ST} AS s, start + INTERVAL 5 DAY AS e, TIMESTAMP '1996-06-01' AS t FROM {EVENTS_SQL})) GROUP BY reason""")
def t8_accept_by_time(spark, sf):
    e, at = as_events(spark, sf), F.lit("1996-06-01 00:00:00").cast("timestamp")
    reason = T.accept_by_time(F.expr(_DL), F.expr(_ST), F.col("start") + F.expr("INTERVAL 5 DAY"), F.expr(_REG), at)
    return e.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_NOTICE = "CASE o_orderkey % 3 WHEN 0 THEN '报名截止：' || {d} || '。比赛时间: 1998-13-01' WHEN 1 THEN '截止日期: 1997-02-30 截止时间：' || {d} ELSE {d} || '报名截止，活动时间：' || {d} END"


@query(f"""SELECT o_orderkey, d || 'T23:59:59+08:00' AS deadline, CASE WHEN o_orderkey % 3 <> 1 THEN d || 'T08:00:00+08:00' END AS event_time
  FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")
def t9_labelled_dates(spark, sf):
    text = F.expr(_NOTICE.format(d="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return table(spark, sf, "orders").select(
        "o_orderkey", T.labelled_date(text, T.DEADLINES, "23:59:59").alias("deadline"), T.labelled_date(text, T.EVENT_DATES, "08:00:00").alias("event_time")
    )


#: An order's date and the one nine days later in text, by parts; {y} and so on are filled in for Spark and for DuckDB.
def _dated(form: str, spark: bool) -> str:
    for key, (java, c) in {"ISO": ("yyyy-MM-dd", "%Y-%m-%d"), "NAME": ("MMMM d", "%B %-d"), "SHORT": ("MMM d", "%b %-d"), "DAY": ("d MMMM", "%-d %B"), "YEAR": ("yyyy", "%Y"), "CN": ("yyyy年M月d日", "%Y年%-m月%-d日"), "CNSHORT": ("M月d日", "%-m月%-d日"), "DD": ("d", "%-d")}.items():
        for name, col in (("A", "o_orderdate"), ("B", "o_orderdate + INTERVAL 9 DAY")):
            form = form.replace("{" + key + name + "}", f"' || date_format({col}, '{java}') || '" if spark else f"' || strftime({col}, '{c}') || '")
    return form


def _texts(forms: list[str], spark: bool) -> str:
    return "CASE " + " ".join(f"WHEN o_orderkey % {len(forms)} = {i} THEN '{_dated(f, spark)}'" for i, f in enumerate(forms)) + " END"


def _notices(spark, sf, forms):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(_texts(forms, True)).alias("t"))


_D, _E = "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d')"
_FAR = "and so on " * 25
_TWO = [
    "Apply here. Registration deadline: {ISOA}; hackathon begins: {ISOB}", "deadline: {NAMEA}th, {YEARA}", "Apply by {SHORTA}", "报名截止：{CNA}，地点待定",
    "活动时间：{CNA}", "{CNA}至{CNB} 报名", "no date at all", "on {ISOA} and again {ISOA}, then {ISOB}",
]


@query(f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN strftime(try_cast('1996' || strftime(o_orderdate, '-%m-%d') AS DATE), '%Y-%m-%d') WHEN 5 THEN {_E} WHEN 6 THEN NULL ELSE {_D} END AS deadline,
  CASE o_orderkey % 8 WHEN 0 THEN {_E} WHEN 4 THEN {_D} WHEN 5 THEN {_D} WHEN 7 THEN {_E} END AS event_time, o_orderkey % 8 NOT IN (1, 2, 6) AS has_full FROM orders""")
def t10_two_dates(spark, sf):
    found = _notices(spark, sf, _TWO).select("o_orderkey", D.two_dates(F.col("t"), 1996).alias("x"))
    return found.select("o_orderkey", F.col("x.signup_deadline").alias("deadline"), "x.event_time", F.col("x.has_full_deadline").alias("has_full"))


_SCORED = [
    "The event starts {ISOA}. " + _FAR + "Last day: {DAYB} {YEARB}, registration deadline", "applications close on {NAMEA}, {YEARA} " + _FAR + "hackathon date {CNB}",
    "applications open on {ISOA} " + _FAR + "deadline {ISOB}", "just {ISOA} and {ISOB}", "deadline 1997-02-30 or {ISOB}",
]


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN {_D} WHEN 3 THEN NULL ELSE {_E} END AS deadline,
  CASE o_orderkey % 5 WHEN 0 THEN {_D} WHEN 1 THEN {_E} END AS event_start, CASE o_orderkey % 5 WHEN 2 THEN {_D} END AS opens FROM orders""")
def t11_scored_dates(spark, sf):
    roles = D.assign_dates(D.scored_dates(F.col("t")))
    found = _notices(spark, sf, _SCORED).select("o_orderkey", roles.alias("x"))
    return found.select("o_orderkey", F.col("x.signup_deadline").alias("deadline"), "x.event_start", F.col("x.registration_open_time").alias("opens"))


_RANGES = [
    "{NAMEA}-{DDB}, {YEARA}", "{NAMEA} to {NAMEB}, {YEARA}", "{SHORTA} - {SHORTB} in 2027", "{DDA}-{DAYB} {YEARB}", "{ISOA} - {ISOB}", "报名截止 {CNA}至{CNB}",
    "{CNA}到{CNSHORTB}", "apply by {SHORTA} - {SHORTB}", "no range",
]
#: The day of B in the month of A, and of A in the month of B; in a given year. Null where there is none.
_MIX = "strftime(try_cast(strftime({m}, '{y}-%m-') || strftime({d}, '%d') AS DATE), '%Y-%m-%d')"
_B = "o_orderdate + INTERVAL 9 DAY"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 5 THEN {_E} WHEN 7 THEN {_MIX.format(m=_B, d=_B, y='1996')} END AS deadline,
  CASE o_orderkey % 9 WHEN 0 THEN {_D} WHEN 1 THEN {_D} WHEN 2 THEN {_MIX.format(m='o_orderdate', d='o_orderdate', y='2027')} WHEN 3 THEN {_MIX.format(m=_B, d='o_orderdate', y='%Y')}
    WHEN 4 THEN {_D} WHEN 6 THEN {_D} END AS first_day,
  CASE o_orderkey % 9 WHEN 0 THEN {_MIX.format(m='o_orderdate', d=_B, y='%Y')} WHEN 1 THEN {_MIX.format(m='o_orderdate', d=_B, y='%Y')} WHEN 2 THEN {_MIX.format(m=_B, d=_B, y='2027')}
    WHEN 3 THEN {_E} WHEN 4 THEN {_E} WHEN 6 THEN strftime(try_cast(strftime(o_orderdate, '%Y') || strftime({_B}, '-%m-%d') AS DATE), '%Y-%m-%d') END AS last_day FROM orders""")
def t12_ranges(spark, sf):
    found = _notices(spark, sf, _RANGES).select("o_orderkey", D.ranges(F.col("t"), 1996).alias("x"))
    return found.select("o_orderkey", F.col("x.signup_deadline").alias("deadline"), F.col("x.event_start").alias("first_day"), F.col("x.event_end").alias("last_day"))


_PLATFORM = ["{SHORTA} - {SHORTB}, 2027", "{SHORTA} - {SHORTB}", "soon", "{ISOA} - {ISOB}"]


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {_MIX.format(m='o_orderdate', d='o_orderdate', y='2027')} WHEN 1 THEN {_MIX.format(m='o_orderdate', d='o_orderdate', y='1997')} END AS first_day,
  CASE o_orderkey % 4 WHEN 0 THEN {_MIX.format(m=_B, d=_B, y='2027')} WHEN 1 THEN {_MIX.format(m=_B, d=_B, y='1997')} END AS last_day FROM orders""")
def t13_range_text(spark, sf):
    got = T.range_dates(F.expr(_texts(_PLATFORM, True)), 1997)
    return table(spark, sf, "orders").select("o_orderkey", got["start"].cast("string").alias("first_day"), got["end"].cast("string").alias("last_day"))


_MIXED = ["Dates: {ISOA} - {ISOB}", "The event starts {ISOA}", "come along", "register by {ISOB}"]


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN {_E} ELSE '1995-01-01' END AS deadline,
  CASE o_orderkey % 4 WHEN 0 THEN {_D} WHEN 1 THEN {_D} ELSE '1995-01-02' END AS first_day, CASE o_orderkey % 4 WHEN 0 THEN {_E} ELSE '1995-01-03' END AS last_day FROM orders""")
def t14_resolve_dates(spark, sf):
    text, own = F.col("t"), [F.lit(f"1995-01-0{i}") for i in (1, 2, 3)]
    found = _notices(spark, sf, _MIXED).select("o_orderkey", D.resolve_dates(D.ranges(text, 1996), D.assign_dates(D.scored_dates(text)), *own).alias("x"))
    return found.select("o_orderkey", F.col("x.signup_deadline").alias("deadline"), F.col("x.event_start").alias("first_day"), F.col("x.event_end").alias("last_day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00+08:00' END AS v FROM orders")
def t15_event_date_iso(spark, sf):
    c = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') || ' 10:00' END")
    return table(spark, sf, "orders").select("o_orderkey", T.event_date_iso(c).alias("v"))

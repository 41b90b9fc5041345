"""Queries of the read API, of detail pages and of article URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import notices as N
from concord.operators import api as A
from concord.operators import dedup as D
from concord.plans.q_rank import _SCORE, _on, _pairs
from concord.plans.q_text import EVENTS_SQL, NOW, as_events
from concord.plans.register import query, table

_STATES = "CASE status WHEN 'O' THEN '报名中' WHEN 'P' THEN '即将截止' ELSE '已截止' END"


@query(f"""WITH e AS (SELECT event_id, {_STATES} AS state, deadline FROM {EVENTS_SQL}),
  n AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY deadline, event_id) AS n FROM e WHERE state <> '已截止' AND deadline BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 7 DAY)
  SELECT event_id, state AS status, CAST(date_diff('day', DATE '{NOW[:10]}', CAST(deadline AS DATE)) AS INT) AS days_remaining FROM n WHERE n <= 50""")
def w4_reminders_of_both_states(spark, sf):
    events = as_events(spark, sf).withColumn("status", F.expr(_STATES))
    return A.reminders(events, F.lit(NOW).cast("timestamp")).select("event_id", "status", "days_remaining")


@query(f"SELECT event_id, title, scope_type, category, status, 'text of ' || event_id AS original_text FROM {EVENTS_SQL} WHERE event_id = (SELECT max(o_orderkey) FROM orders)")
def p4_detail_with_text(spark, sf):
    events = as_events(spark, sf).withColumn("original_text", F.concat(F.lit("text of "), "event_id"))
    return A.detail(events, F.lit(events.agg(F.max("event_id")).first()[0]))


@query(f"""WITH s AS (SELECT user_id, seq, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, seq) AS n FROM {_SCORE})
  SELECT user_id, seq, CAST(n AS INT) AS rank, (SELECT lower(c_mktsegment) || ' / STEEL,' || lower(substr(c_name, 1, 3)) FROM customer WHERE c_custkey = user_id) AS profile, (SELECT count(*) FROM part) AS n_candidates FROM s WHERE n <= 5""")
def r4_recommendations(spark, sf):
    profiles, events = _pairs(spark, sf)
    events = events.withColumn("status", F.when(F.col("seq") % 2 == 0, "报名中")).withColumn("organizer", F.lit(""))
    got = A.recommendations(profiles.withColumn("grade", F.lit("")), events, {**_on(), "organizer": F.col("organizer")})
    return got.select("user_id", "seq", "rank", "profile", "n_candidates")


@query("""SELECT s_nationkey AS account_class, count(*) AS n, (SELECT count(*) FROM supplier) AS total, string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY 1""")
def g6_accounts(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("account_class"), F.col("s_name").alias("name"))
    return A.accounts(s, most=1_000_000).withColumn("names", F.array_join("names", ","))


@query("""WITH c AS (SELECT * FROM (VALUES ('event_type', (SELECT count_if(event_type = 'none') FROM events)), ('user_id', 0), ('v', (SELECT count_if(event_id % 7 = 0) FROM events))) t(c, n_missing))
  SELECT c AS "column", (SELECT count(*) FROM events) AS n_rows, n_missing, (SELECT count(*) - count(DISTINCT user_id) FROM events) AS n_repeated FROM c""")
def a9_quality(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return A.quality(e, "user_id")


@query("""WITH p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos, min(event_id) OVER (PARTITION BY event_type) AS f FROM events),
  k AS (SELECT event_type FROM p ORDER BY pos, f LIMIT 60)
  SELECT event_type, count(*) - (SELECT count(*) FROM k WHERE k.event_type = e.event_type) AS n FROM events e GROUP BY event_type HAVING count(*) > (SELECT count(*) FROM k WHERE k.event_type = e.event_type)""")
def w1_truncated(spark, sf):
    e = table(spark, sf, "events")
    return D.truncated(e, D.cap_round_robin(e, 60, "event_type", "event_id"), "event_type", "event_id")


#: Texts of documents behind labels, on their line or on a later one.
_NOTICE = """concat('Intro\\n', CASE WHEN doc_id % 3 = 0 THEN '主办方：\\n\\n' WHEN doc_id % 3 = 1 THEN '主办单位：' ELSE '主办 ' END, 'host ', doc_id, '\\n参赛对象：\\n费用：', doc_id % 5, '  yuan\\nall ', lang, '\\n',
  CASE WHEN doc_id % 2 = 0 THEN '报名日间：2026/3/4 noon。more' ELSE '报名时间：soon' END)"""


@query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'host ' || doc_id END AS organizer, 'all ' || lang AS participant_scope, doc_id % 5 || ' yuan' AS fee_or_status,
  CASE WHEN doc_id % 2 = 0 THEN '2026/3/4 noon' ELSE 'soon' END AS registration_time FROM documents WHERE lang IS NOT NULL""")
def f6_label_groups(spark, sf):
    rows = table(spark, sf, "documents").filter("lang is not null").select("doc_id", F.expr(_NOTICE).alias("t"))
    return N.detail_fields(rows, "t").select("doc_id", "organizer", "participant_scope", "fee_or_status", "registration_time")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://mp.weixin.qq.com/s?__biz=B' || page_id || '&mid=' || page_id % 9 || '&sn=z' WHEN 1 THEN 'https://mp.weixin.qq.com/s/' || page_id || '?t=1' ELSE '' END AS v FROM pages""")
def n13_article_keys(spark, sf):
    u = F.expr("""CASE page_id % 4 WHEN 0 THEN concat('https://mp.weixin.qq.com/s?scene=3&sn=z&mid=', page_id % 9, '&__biz=B', page_id, '#rd') WHEN 1 THEN concat('https://mp.weixin.qq.com/s/', page_id, '?t=1') ELSE url END""")
    return table(spark, sf, "pages").select("page_id", N.article_url(u).alias("v"))


@query("""SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'https://mp.weixin.qq.com/s?a=' || page_id || '&timestamp=' || length(html) END AS v FROM pages""")
def n15_redirect_pages(spark, sf):
    page = F.expr("""concat('<script>var url = \\'\\';', 'url += \\'https://', CASE WHEN page_id % 3 < 2 THEN 'mp.@wei' ELSE 'other.' END, '\\'; url += "xin.qq.com/s?a=', page_id, '&amp;";\\nurl += \\'timestamp=', length(html), '\\';</script>')""")
    return table(spark, sf, "pages").select("page_id", N.redirect_target(page).alias("v"))

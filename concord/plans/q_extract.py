"""Queries of field extraction and identity keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import extract as E
from concord.functions import pages as P
from concord.functions import text as X
from concord.functions.times import range_dates
from concord.plans.q_text import titles, titles_sql
from concord.plans.register import query, table

_LEVEL = "CASE doc_id % 6 WHEN 0 THEN '全国' WHEN 1 THEN '省级' WHEN 2 THEN '校际' WHEN 3 THEN '书院x主办' ELSE '' END"


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '国家级' WHEN 1 THEN '省级' WHEN 2 THEN '校级' WHEN 3 THEN '院级' END AS v FROM documents")
def f1_level(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.level(F.concat(F.expr(_LEVEL), F.col("text"))).alias("v"))


@query("SELECT s_suppkey, s_name AS a, s_name AS b FROM supplier")
def f2_organizer(spark, sf):
    zh, en = F.concat(F.lit("通知\n主办单位： "), F.col("s_name"), F.lit("，欢迎")), F.concat(F.lit("Organized by: "), F.col("s_name"), F.lit(". Join"))
    return table(spark, sf, "supplier").select("s_suppkey", E.organizer(zh).alias("a"), E.organizer(en, E.ORGANIZERS_BOTH).alias("b"))


@query(r"""SELECT doc_id, array_to_string(list_filter(['黑客松', CASE WHEN doc_id % 3 = 0 OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])ai($|[^\p{L}\p{N}_])|artificial intelligence') THEN 'AI' END, CASE WHEN doc_id % 3 = 1 OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])web3($|[^\p{L}\p{N}_])|blockchain') THEN 'Web3' END,
  CASE WHEN doc_id % 3 = 0 OR regexp_matches(lower(text), 'online|virtual|remote') THEN '线上' END, CASE WHEN regexp_matches(lower(text), 'offline|in[\s-]person|on[\s-]site') THEN '线下' END,
  CASE WHEN doc_id % 3 = 1 OR regexp_matches(lower(text), 'open[\s-]source') THEN '开源' END, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])ml($|[^\p{L}\p{N}_])|machine learning') THEN '机器学习' END,
  CASE WHEN regexp_matches(lower(text), 'social good|impact') THEN '公益' END], lambda x: x IS NOT NULL), ',') AS v FROM documents""")
def f3_tags(spark, sf):
    head = F.expr("CASE doc_id % 3 WHEN 0 THEN 'an AI event, online ' WHEN 1 THEN 'Web3 and open-source ' ELSE '' END")
    return table(spark, sf, "documents").select("doc_id", F.array_join(E.tags(F.concat(head, F.col("text"))), ",").alias("v"))


#: Orders as notices of registration: what their text, and the status word of their source, say.
_STATUS_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN 'Registration is closed since ' WHEN 1 THEN 'Applications open on ' WHEN 2 THEN '报名火热 ' WHEN 3 THEN 'please register by ' WHEN 4 THEN '' ELSE 'about ' END || o_custkey"""
_STATUS_WORD = "CASE o_orderstatus WHEN 'F' THEN ' Ended ' WHEN 'O' THEN 'LIVE' ELSE 'x' END"


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'closed' WHEN 1 THEN 'upcoming' WHEN 2 THEN 'open' WHEN 3 THEN 'open'
  ELSE CASE o_orderstatus WHEN 'F' THEN 'ended' WHEN 'O' THEN 'open' END END AS v FROM orders""")
def f4_status(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", E.detect_status(F.expr(_STATUS_TEXT), F.expr(_STATUS_WORD)).alias("v"))


@query(titles_sql("CASE p_partkey % 4 WHEN 0 THEN '数学类' WHEN 1 THEN '环保类' WHEN 2 THEN '信息技术/AI类' ELSE '综合类' END AS v"))
def f5_category(spark, sf):
    t = F.concat(F.lit("t"), F.expr("CASE p_partkey % 4 WHEN 0 THEN '数学建模' WHEN 1 THEN '绿色' WHEN 2 THEN '编程' ELSE '' END"))
    return titles(spark, sf).select("p_partkey", E.category(t).alias("v"))


@query("SELECT doc_id, 'place ' || doc_id AS a, 'host ' || doc_id AS b FROM documents")
def f6_labelled_fields(spark, sf):
    text = F.expr("'intro\n地点：place ' || doc_id || '\n主办：\n\n时间\nhost ' || doc_id || '\nend'")
    field = lambda x: E.labelled_field(text, [x], ["地点", "主办", "时间"])
    return table(spark, sf, "documents").select("doc_id", field("地点").alias("a"), field("主办").alias("b"))


@query("""SELECT p_partkey, p_name, coalesce(b, 'unknown') AS brand, b IS NOT NULL AS matched FROM part LEFT JOIN
  (SELECT p_name AS n, min(p_brand) AS b FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) ON p_name = n""")
def f7_enrich_rule_based(spark, sf):
    part = table(spark, sf, "part")
    catalog = part.filter("p_partkey % 2 = 0").groupBy(X.match_key(F.col("p_name")).alias("k")).agg(F.min("p_brand").alias("b"))
    both = part.withColumn("k", X.match_key(F.col("p_name"))).join(catalog, "k", "left")
    return both.select("p_partkey", "p_name", F.coalesce("b", F.lit("unknown")).alias("brand"), F.col("b").isNotNull().alias("matched"))


@query("SELECT doc_id, 'Long title ' || doc_id AS title, 'the host' AS organizer, '环保类' AS category FROM documents")
def f8_parse_notices(spark, sf):
    text = F.expr("'hi\nLong title ' || doc_id || '\n主办方：the host\n绿色'")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 5)
    return table(spark, sf, "documents").select("doc_id", F.get(lines, F.lit(0)).alias("title"), E.organizer(text).alias("organizer"), E.category(text).alias("category"))


@query("SELECT page_id, CASE WHEN contains(url, '.edu') OR contains(url, '.gov') THEN 'high' WHEN contains(url, '.org') THEN 'medium' ELSE 'low' END AS authority FROM pages")
def f9_authority(spark, sf):
    u = F.col("url")
    a = F.when(u.contains(".edu") | u.contains(".gov"), "high").when(u.contains(".org"), "medium").otherwise("low")
    return table(spark, sf, "pages").select("page_id", a.alias("authority"))


@query("SELECT page_id, 'id_' || page_id AS v FROM pages")
def f10_script_values(spark, sf):
    html = F.expr("""concat('<script>var sn = "bad value"; sn = "id_', page_id, '";</script>', html)""")
    return table(spark, sf, "pages").select("page_id", E.script_value(html, "sn", r"[a-z]+_\d+").alias("v"))


def landed(spark, sf, *parts):
    """Orders as landed pages, with the given parts of HTML joined."""
    return table(spark, sf, "orders").select("o_orderkey", F.concat(*[F.expr(p) for p in parts]).alias("html"))


_LIST = ["""'<ul class="news-list"><li><h3><a target="x" href="/link?url=' || o_orderkey || '"><em>' || o_orderpriority || '</em> &amp; more</a></h3><p class="txt-info">by ' || o_custkey || '</p><span class="all-time-y2">' || o_orderstatus
  || '</span><script>document.write(timeConvert("' || unix_timestamp(o_orderdate) || '"))</script></li><li>no title</li>'""",
  """CASE WHEN o_orderkey % 3 = 0 THEN '<li><h3><a href="https://x.org/' || o_custkey || '">second</a></h3></li></ul>' ELSE '</ul>' END"""]  # fmt: skip


@query("""SELECT o_orderkey, 0 AS place, o_orderpriority || ' & more' AS title, 'https://weixin.sogou.com/link?url=' || o_orderkey AS url, 'by ' || o_custkey AS summary, o_orderstatus AS publisher,
    strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS publish_time FROM orders
  UNION ALL SELECT o_orderkey, 1, 'second', 'https://x.org/' || o_custkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0""")
def f11_articles(spark, sf):
    rows = landed(spark, sf, *_LIST).select("o_orderkey", F.posexplode(P.article_list(F.col("html"))).alias("place", "a"))
    return rows.select("o_orderkey", "place", "a.*")


_ARTICLE = ["""'<title>T ' || o_custkey || '</title><meta name="author" content="Ann ' || o_orderstatus || '"><script>var biz = "MzA' || o_custkey || '=="; var mid = "' || o_orderkey || '"; var idx = "1"; var sn = "not hex!"; var ct = "' || unix_timestamp(o_orderdate) || '";</script>'""",
  """CASE WHEN o_orderkey % 2 = 0 THEN '<h1 id="activity-name"> Head ' || o_orderkey || '</h1>' ELSE '' END""", """CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '<div class="x" id="js_content"><p>body of</p> ' || o_orderpriority || '</div>' END"""]  # fmt: skip


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Head ' || o_orderkey ELSE 'T ' || o_custkey END AS title, 'Ann ' || o_orderstatus AS author, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS publish_time,
  'body of ' || o_orderpriority AS body, 'MzA' || o_custkey || '==' AS biz, CAST(o_orderkey AS VARCHAR) AS mid, '1' AS idx, NULL AS sn FROM orders WHERE o_orderkey % 5 <> 0""")
def f12_article_pages(spark, sf):
    return landed(spark, sf, *_ARTICLE).select("o_orderkey", P.article_page(F.col("html")).alias("a")).filter("a is not null").select("o_orderkey", "a.*")


_CARDS = ["""CASE WHEN o_orderkey % 4 = 0 THEN '<h3><a href="/e/' || o_orderkey || '">Plain ' || o_custkey || '</a></h3><p> AUG ' || (1 + o_orderkey % 9) || ' - 24</p><div>Berlin, DE</div><i>Hybrid</i>' ELSE '<a itemScope="" itemType="https://schema.org/Event" href="https://a.example/?utm=1"><meta itemProp="startDate" content="'
  || date_format(o_orderdate, 'yyyy-MM-dd') || '"/><h4>Card ' || o_custkey || '</h4>' END""", """CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN '<meta itemProp="url" content="https://e.org/' || o_orderkey || '"/><meta itemProp="eventAttendanceMode" content="https://schema.org/OnlineEventAttendanceMode"/><span itemProp="name">Hall '
  || o_orderstatus || '</span></a>' ELSE '<meta itemProp="endDate" content="2030-01-01"/></a>' END"""]  # fmt: skip


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Plain ' ELSE 'Card ' END || o_custkey AS name, CASE o_orderkey % 4 WHEN 0 THEN 'https://list.example' WHEN 1 THEN 'https://e.org/' || o_orderkey ELSE 'https://a.example/?utm=1' END AS url,
  CASE WHEN o_orderkey % 4 = 0 THEN 'AUG ' || (1 + o_orderkey % 9) || ' - 24' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "start", CASE WHEN o_orderkey % 4 > 1 THEN '2030-01-01' END AS "end", CASE o_orderkey % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'online' END AS mode, CASE o_orderkey % 4 WHEN 0 THEN 'Berlin, DE' WHEN 1 THEN 'Hall ' || o_orderstatus END AS location FROM orders""")
def f13_event_cards(spark, sf):
    return landed(spark, sf, *_CARDS).select("o_orderkey", F.explode(P.event_cards(F.col("html"), F.lit("https://list.example"))).alias("e")).select("o_orderkey", "e.*")


_STATE = ["""CASE WHEN o_orderkey % 3 = 0 THEN '<h2><a href="/h/' || o_custkey || '">Seen ' || o_custkey || '</a></h2><b>Live now</b>' ELSE '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"hackathons":[{"' || CASE WHEN o_orderkey % 3 = 1 THEN 'name' ELSE 'title' END
  || '":"E' || o_orderkey || '","slug":"s-' || o_custkey || '","start_date":"' || date_format(o_orderdate, 'yyyy-MM-dd') || '","state":"' || o_orderstatus || '"},{"slug":"nameless"}]}}}</script>' END"""]  # fmt: skip


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Seen ' || o_custkey ELSE 'E' || o_orderkey END AS name, 'https://d.example' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/s-' || o_custkey END AS url,
  CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "start", NULL AS "end", CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE 'Live' END AS status FROM orders""")
def f14_page_state(spark, sf):
    return landed(spark, sf, *_STATE).select("o_orderkey", F.explode(P.page_state(F.col("html"), "https://d.example")).alias("e")).select("o_orderkey", "e.*")


@query("""SELECT o_orderkey, unnest(['Alpha ' || o_custkey, 'Beta Day']) AS name, unnest([strftime(try_cast('2027' || strftime(o_orderdate, '-%m-%d') AS DATE), '%Y-%m-%d'), NULL]) AS first_day,
  unnest([strftime(try_cast('2027' || strftime(o_orderdate + INTERVAL 40 DAY, '-%m-%d') AS DATE), '%Y-%m-%d'), NULL]) AS last_day FROM orders""")
def f15_described_events(spark, sf):
    text = F.expr("'Alpha ' || o_custkey || ' (' || date_format(o_orderdate, 'MMM d') || ' - ' || date_format(o_orderdate + INTERVAL 40 DAY, 'MMM d') || '), Beta Day (' || o_orderstatus || ')'")
    each = table(spark, sf, "orders").select("o_orderkey", F.explode(P.described_events(text, 2027)).alias("e"))
    return each.select("o_orderkey", "e.name", F.col("e.start").cast("string").alias("first_day"), F.col("e.end").cast("string").alias("last_day"))


@query("""SELECT page_id, place, href, title FROM (SELECT page_id, unnest(range(len(h))) AS place, unnest(h) AS href, unnest(t) AS title FROM (SELECT page_id,
  regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h,
  list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))) AS t FROM pages)) WHERE length(title) >= 4""")
def f16_links(spark, sf):
    each = table(spark, sf, "pages").select("page_id", F.posexplode(E.links(F.col("html"))).alias("place", "l"))
    return each.select("page_id", F.col("place").cast("long").alias("place"), "l.href", "l.title").filter(F.length("title") >= 4)


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS v FROM part""")
def f17_name_from_host(spark, sf):
    host = F.concat(F.lit("https://"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".example.org/x"))
    return table(spark, sf, "part").select("p_partkey", E.name_from_host(host).alias("v"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '高' ELSE '中' END AS authority, CASE WHEN o_orderkey % 3 = 0 THEN '["a","线上"]' ELSE '["a"]' END AS tags FROM orders""")
def f18_candidates_to_events(spark, sf):
    c = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "high").otherwise("medium").alias("s"), F.when(F.col("o_orderkey") % 3 == 0, "online").alias("mode"))
    tag = F.when(F.col("mode") == "online", F.array(F.lit("线上"))).otherwise(F.array().cast("array<string>"))
    names = F.create_map(F.lit("high"), F.lit("高"), F.lit("medium"), F.lit("中"), F.lit("low"), F.lit("低"))
    return c.select("o_orderkey", F.element_at(names, F.col("s")).alias("authority"), F.to_json(F.array_union(F.array(F.lit("a")), tag)).alias("tags"))


@query("SELECT page_id, url AS source_url, coalesce(CASE WHEN page_id % 2 = 0 THEN 'p' || page_id END, url) AS source_article_id FROM pages")
def f19_articles_to_raw(spark, sf):
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return table(spark, sf, "pages").select("page_id", F.col("url").alias("source_url"), F.coalesce(own, "url").alias("source_article_id"))


@query(titles_sql("'EVT-' || upper(substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name || '|' || '2026' || '|' || title || '|')), 1, 12)) AS v"))
def i1_event_id(spark, sf):
    return titles(spark, sf).select("p_partkey", E.event_id(F.col("p_name"), F.lit(2026), F.col("title"), F.lit(None)).alias("v"))


@query("""SELECT event_id, 'WX-' || substr(upper(sha256(CASE event_id % 3 WHEN 0 THEN 'MzA' || user_id || ':' || event_id || ':1'
  WHEN 1 THEN event_type || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+08:00|' || 'big news ' || event_id
  ELSE event_type || '|soon|abc ' || event_id END)), 1, 24) AS v FROM events""")
def i2_article_id(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id") % 3
    biz, mid, idx = F.concat(F.lit("MzA"), "user_id"), F.when(k == 0, F.col("event_id").cast("string")), F.lit("1")
    time = F.when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    title = F.concat(F.when(k == 1, " BIG News ").otherwise(" ＡＢc "), "event_id")
    return e.select("event_id", E.article_id(biz, mid, idx, F.upper("event_type"), time, title).alias("v"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'platform|' || o_orderstatus || '|' || o_custkey
  WHEN 1 THEN 'url|x.org/event/' || o_custkey WHEN 2 THEN 'listing_event|' || o_orderstatus || '|' || replace(lower(o_orderpriority), ' ', '') || '|' || strftime(o_orderdate, '%Y-%m-%d')
  ELSE 'listing_url|' || o_orderstatus || '|x.org/hackathons' END AS v FROM orders""")
def i3_candidate_identity(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey") % 4
    url = F.when(k == 1, F.concat(F.lit("https://www.x.org/event/"), "o_custkey", F.lit("/"))).otherwise("https://x.org/hackathons")
    title = F.when(k <= 2, F.concat(F.lit("【"), "o_orderpriority", F.lit("】")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("o_orderkey", E.candidate_identity(F.when(k == 0, F.col("o_custkey").cast("string")), F.col("o_orderstatus"), url, title, day).alias("v"))

"""Queries of the projections, filters and normalisations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from concord.functions import text as X
from concord.operators.merge import event_payload
from concord.plans.register import query, table

NOW = "1998-06-01 12:00:00"
#: part dressed as edition titles, in Spark and in DuckDB alike.
TITLE = "concat(cast(2012 + p_partkey % 20 as string), '年第', cast(p_partkey % 9 + 1 as string), '届 ', p_name, ' (', cast(2024 + p_partkey % 3 as string), ')', case when p_partkey % 3 = 0 then '决赛' when p_partkey % 3 = 1 then '报名通知' else '' end)"
TITLE_SQL = TITLE.replace("as string", "as varchar")
URL_SQL = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


def titles(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", F.expr(TITLE).alias("title"))


def titles_sql(cols: str) -> str:
    return f"SELECT p_partkey, {cols} FROM (SELECT p_partkey, p_name, {TITLE_SQL} AS title FROM part)"


def as_events(spark, sf):
    """orders dressed as events: deadline 90 days after the order, start 30 days later."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.concat(F.lit("event "), F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, "national").otherwise("campus").alias("scope_type"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).cast("timestamp").alias("deadline"),
        (F.col("o_orderdate") + F.expr("INTERVAL 120 DAY")).cast("timestamp").alias("start"),
        F.col("o_totalprice").alias("weight"),
        F.col("o_custkey").alias("owner"),
    )


EVENTS_SQL = """(SELECT o_orderkey AS event_id, 'event ' || o_orderpriority AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'national' ELSE 'campus' END AS scope_type, o_orderpriority AS category, o_orderstatus AS status,
  o_orderdate + INTERVAL 90 DAY AS deadline, o_orderdate + INTERVAL 120 DAY AS start, o_totalprice AS weight, o_custkey AS owner FROM orders)"""


@query("SELECT o_orderkey AS event_id, 'event ' || o_orderpriority AS title, o_orderpriority AS category, o_orderstatus AS status FROM orders")
def p1_event_payload(spark, sf):
    raw = as_events(spark, sf).select("category", "status", "event_id", "title", "weight", "owner")
    return event_payload(raw)


@query("""SELECT c_custkey, v, v IS NOT NULL AND lower(trim(v)) NOT IN ('', 'null', 'none') AS meaningful FROM (SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN ' NULL ' WHEN 1 THEN NULL WHEN 2 THEN '  ' WHEN 3 THEN 'None' ELSE c_name END AS v FROM customer)""")
def p2_is_meaningful(spark, sf):
    v = F.expr("CASE c_custkey % 5 WHEN 0 THEN ' NULL ' WHEN 1 THEN NULL WHEN 2 THEN '  ' WHEN 3 THEN 'None' ELSE c_name END")
    return table(spark, sf, "customer").select("c_custkey", v.alias("v")).withColumn("meaningful", X.is_meaningful(F.col("v")))


def query_events(df, *, scope_type=None, category=None, status=None, contest_level=None, target_major=None, target_grade=None, keyword=None, days_within=None, now=NOW, limit=50):
    """Events by equality, by substrings (title, major, grade) and a deadline window from now on, nearest deadline first,
    unknown last."""
    for c, v in (("scope_type", scope_type), ("category", category), ("status", status), ("contest_level", contest_level)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    for c, v in (("title", keyword), ("target_major", target_major), ("target_grade", target_grade)):
        if v:
            df = df.filter(F.contains(F.lower(F.col(c)), F.lower(F.lit(v))))
    at = F.lit(now).cast("timestamp")
    if days_within and days_within > 0:
        df = df.filter(F.col("deadline").between(at, at + F.expr(f"INTERVAL {days_within} DAY")))
    return df.orderBy(F.col("deadline").asc_nulls_last(), "event_id").limit(limit)


@query(f"""SELECT event_id, title, strftime(deadline, '%Y-%m-%d') AS deadline FROM {EVENTS_SQL}
  WHERE scope_type = 'national' AND title ILIKE '%urgent%' AND event_id % 2 = 0 AND event_id % 7 < 5 AND deadline BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 180 DAY
  ORDER BY deadline ASC NULLS LAST, event_id LIMIT 50""")
def p3_query_events(spark, sf):
    events = as_events(spark, sf).withColumn("contest_level", F.when(F.col("event_id") % 2 == 0, "国家级").otherwise("省级"))
    events = events.withColumn("target_major", F.when(F.col("event_id") % 7 < 5, "Physics, AI").otherwise("Law"))
    got = query_events(events, scope_type="national", contest_level="国家级", target_major="physics", keyword="urgent", days_within=180)
    return got.select("event_id", "title", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"))


@query(f"SELECT event_id, title, scope_type, status FROM {EVENTS_SQL} WHERE event_id = 7")
def p4_event_detail(spark, sf):
    return as_events(spark, sf).filter("event_id = 7").select("event_id", "title", "scope_type", "status")


def _words(spark, sf):
    """Documents' texts as titles, some with a promotion word."""
    word = F.element_at(F.array(F.lit("培 训"), F.lit("GRE"), F.lit("会员"), F.lit(""), F.lit("付费")), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat("text", word).alias("title"))


_WORDS_SQL = "(SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN '培 训' WHEN 1 THEN 'GRE' WHEN 2 THEN '会员' WHEN 3 THEN '' ELSE '付费' END AS title FROM documents)"


def _alternation(words):
    return X.quoted(words).replace("'", "''")


@query(f"SELECT doc_id, regexp_matches(regexp_replace(lower(title), '{X.PROMOTION_MARKS}', '', 'g'), '{_alternation(X.PROMOTIONS_1)}') AS promotion FROM {_WORDS_SQL}")
def p5_promotions_1(spark, sf):
    return _words(spark, sf).select("doc_id", X.is_promotion(F.col("title"), 1).alias("promotion"))


@query(f"SELECT doc_id, regexp_matches(regexp_replace(lower(title), '[\\s（()）【\\[\\]《》<>「」】“”''\"·—_\\-，,。.!！:：;；]', '', 'g'), '{_alternation(X.PROMOTIONS_2)}') AS promotion FROM {_WORDS_SQL}")
def p6_promotions_2(spark, sf):
    return _words(spark, sf).select("doc_id", X.is_promotion(F.col("title"), 2).alias("promotion"))


@query(f"SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ICPC' ELSE 'x' END AS title, text FROM documents) WHERE regexp_matches(lower(title || ' ' || substr(text, 1, 5000)), '{_alternation([w.lower() for w in X.RELEVANT])}')")
def p7_relevant(spark, sf):
    df = table(spark, sf, "documents").withColumn("title", F.when(F.col("doc_id") % 4 == 0, "ICPC").otherwise("x"))
    return df.filter(X.is_relevant(F.col("title"), F.col("text"))).select("doc_id")


_TOPIC_TITLE = "CASE doc_id % 4 WHEN 0 THEN 'Spring Hackathon' WHEN 1 THEN 'Hack Day winners' WHEN 2 THEN 'buildathon' ELSE 'other' END"


@query(f"SELECT doc_id, regexp_matches(s, '(?i){X.any_of(X.TOPIC)}') AND NOT regexp_matches(s, '(?i){X.any_of(X.OFF_TOPIC)}') AS topic FROM (SELECT doc_id, {_TOPIC_TITLE} || chr(10) || substr(text, 1, 2000) AS s FROM documents)")
def p8_topic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.is_topic(F.expr(_TOPIC_TITLE), F.col("text")).alias("topic"))


@query("SELECT page_id, (" + " + ".join(f"CAST(regexp_matches(t, '{p}') AS INT)" for p in X.LISTING) + """) >= 2
  OR (contains(u, '/hackathons') AND NOT regexp_matches(u, '/hackathons/[^/]+/.')) OR regexp_matches(u, '/events|/search|/explore|/browse') AS listing
  FROM (SELECT page_id, lower(url) AS u, lower(regexp_replace(regexp_replace(substr(html, 1, 10000), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)""")
def p9_listing_page(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.is_listing_page(F.col("html"), F.col("url")).alias("listing"))


_LIST_URL = "CASE page_id % 5 WHEN 0 THEN url || '/hackathons' WHEN 1 THEN 'https://x.org/hackathons/a/b' WHEN 2 THEN '' WHEN 3 THEN 'https://x.org/seasons/2026/events/' ELSE url END"


@query(f"SELECT page_id, CASE WHEN u IS NULL OR u = '' THEN true ELSE (contains(lower(u), '/hackathons') AND NOT regexp_matches(lower(u), '/hackathons/[^/]+/.')) OR regexp_matches(lower(u), '/(hackathons|events|seasons)$') OR regexp_matches(lower(u), '/seasons/\\d{{4}}/events/?$') END AS listing FROM (SELECT page_id, {_LIST_URL} AS u FROM pages)")
def p10_listing_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.expr(_LIST_URL).alias("u")).select("page_id", X.is_listing_url(F.col("u")).alias("listing"))


_ANY_URL = """CASE page_id % 12 WHEN 0 THEN 'http://192.168.1.' || page_id % 250 || '/a' WHEN 1 THEN 'file:///etc/x' WHEN 2 THEN 'http://localhost:80/' WHEN 3 THEN 'http://172.20.0.1/x'
  WHEN 4 THEN 'http://10.example.com/' || page_id WHEN 5 THEN 'http://127.evil.org/' WHEN 6 THEN 'http://printer.local/' WHEN 7 THEN 'http://172.32.0.1/x' WHEN 8 THEN 'http://[fe80::1]/x' ELSE url END"""


@query("SELECT page_id, page_id % 12 NOT IN (0, 1, 2, 3, 8) AS public FROM pages")
def p11_public_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.is_public_url(F.expr(_ANY_URL)).alias("public"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(url), '/(project|gallery|rules)|utm_')")
def p12_source_urls(spark, sf):
    return table(spark, sf, "pages").filter(~F.lower("url").rlike("/(project|gallery|rules)|utm_")).select("page_id", "url")


@query("SELECT page_id, length(html) < 400 OR NOT contains(html, substr(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), 1, 8)) OR starts_with(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 'home') AS generic FROM pages")
def p13_generic_pages(spark, sf):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    short = F.length("html") < 400
    return table(spark, sf, "pages").select("page_id", (short | ~F.col("html").contains(F.substring(title, 1, 8)) | F.lower(title).startswith("home")).alias("generic"))


@query(f"SELECT page_id, regexp_matches(lower(CASE WHEN page_id % 7 = 0 THEN html || 'VerifyCode' ELSE html END), '{X.quoted(X.BLOCKED)}') AS blocked FROM pages")
def p14_blocked(spark, sf):
    html = F.expr("CASE WHEN page_id % 7 = 0 THEN html || 'VerifyCode' ELSE html END")
    return table(spark, sf, "pages").select("page_id", X.is_blocked(html).alias("blocked"))


@query(f"SELECT category, count_if(trim(title) <> '' AND (deadline IS NOT NULL OR start IS NOT NULL) AND status IN ('O', 'P')) AS structured, count(*) AS n FROM {EVENTS_SQL} GROUP BY category")
def p15_structured(spark, sf):
    ok = (F.trim("title") != "") & (F.col("deadline").isNotNull() | F.col("start").isNotNull()) & F.col("status").isin("O", "P")
    return as_events(spark, sf).groupBy("category").agg(F.count_if(ok).alias("structured"), F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'name' || CASE WHEN c_acctbal < 0 THEN ',balance' ELSE '' END ELSE 'balance' END AS missing
  FROM customer WHERE c_custkey % 3 = 0 OR c_acctbal < 0""")
def p16_missing_fields(spark, sf):
    name, balance = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string"))
    gone = F.array_compact(F.array(F.when(~X.is_meaningful(name), "name"), F.when(~X.is_meaningful(balance), "balance")))
    return table(spark, sf, "customer").select("c_custkey", gone.alias("g")).filter(F.size("g") > 0).select("c_custkey", F.array_join("g", ",").alias("missing"))


@query("SELECT event_id, event_type IN ('click', 'purchase') AS known FROM events")
def p17_known_publisher(spark, sf):
    accounts = spark.createDataFrame([("Click", ["CLICK "]), ("Purchase", ["buy"])], "name string, aliases array<string>")
    keys = accounts.select(F.explode(F.array_append("aliases", F.col("name"))).alias("k")).select(F.lower(F.trim("k")).alias("k")).distinct()
    events = table(spark, sf, "events")
    return events.join(F.broadcast(keys), F.lower("event_type") == F.col("k"), "left").select("event_id", F.col("k").isNotNull().alias("known"))


@query(f"""SELECT event_id FROM {EVENTS_SQL} WHERE CASE event_id % 4 WHEN 0 THEN start + INTERVAL 40 DAY >= TIMESTAMP '{NOW}' WHEN 1 THEN start >= TIMESTAMP '{NOW}'
  WHEN 2 THEN true ELSE deadline >= TIMESTAMP '{NOW}' END""")
def p18_drop_finished(spark, sf):
    e, k = as_events(spark, sf), F.col("event_id") % 4
    end = F.when(k == 0, F.col("start") + F.expr("INTERVAL 40 DAY")).when(k == 3, F.col("deadline"))
    own = e.withColumn("end", end).withColumn("start", F.when(k != 2, F.col("start")))
    return X.drop_finished(own, "end", "start", F.lit(NOW).cast("timestamp")).select("event_id")


@query(f"SELECT event_id FROM {EVENTS_SQL} WHERE status IN ('O', 'P') AND deadline >= TIMESTAMP '{NOW}'")
def p19_open_events(spark, sf):
    return as_events(spark, sf).filter(F.col("status").isin("O", "P") & (F.col("deadline") >= F.lit(NOW).cast("timestamp"))).select("event_id")


def _title_query(name, expression, sql):
    @query(titles_sql(sql + " AS v"))
    def run(spark, sf):
        return titles(spark, sf).select("p_partkey", expression(F.col("title")).alias("v"))

    from concord.plans import register

    register.QUERIES[name], register.ORACLES[name] = register.QUERIES.pop("run"), register.ORACLES.pop("run")


def _chain(*patterns, start="trim(title)"):
    for p in patterns:
        start = f"regexp_replace({start}, '{p}', '', 'g')"
    return start


_KEY_SQL = _chain(r"^\d{4}年", r"第[一二三四五六七八九十\d]+届", r"[\(\)（）]\d{4}[\(\)（）]", "初赛|决赛|复赛|分区赛|赛区赛|赛区|第一轮报名|第二轮报名|报名通知", r"\s+")
_MATCH_SQL = f"lower({_chain(r'\d{4}[年\-]?', r'第[一二三四五六七八九十百零\d]+届', r'[（(][^)）]*[)）]', r'\s+')})"
_title_query("n1_catalog_key", X.catalog_key, _KEY_SQL)
_title_query("n2_edition_year", X.edition_year, r"CASE WHEN TRY_CAST(regexp_extract(title, '(\d{4})', 1) AS INT) BETWEEN 2020 AND 2030 THEN TRY_CAST(regexp_extract(title, '(\d{4})', 1) AS INT) END")
_title_query("n3_match_key", X.match_key, _MATCH_SQL)
_title_query("n4_light_key", X.light_key, _chain(r"[【】\[\]{}()（）\",.!！。，、：:；;「」『』]", r"\s+", start="lower(trim(title))"))
_title_query("n5_title_identity", lambda c: X.title_identity(F.concat(c, F.lit("-home|site x")), (r"-home\|site",)),
             _chain(r"-home\|site.*$", r"[\s（）()【】\[\]《》<>「」“”\"·—_\-，,。.!！:：;；]", start="lower(title || '-home|site x')"))
_title_query("n6_marketing_title", lambda c: X.clean_marketing_title(F.concat(F.lit("【x】 "), c)), r"trim(regexp_replace(title, '\s+', ' ', 'g'))")
_title_query("n7_search_keyword", X.search_keyword, f"substr(CASE WHEN length({_MATCH_SQL}) > 5 THEN {_MATCH_SQL} ELSE trim(title) END, 1, 30)")
_title_query("n8_catalog_name_key", lambda c: X.catalog_name_key(F.concat(c, F.lit("竞赛"))), r"trim(regexp_replace(regexp_replace(title || '竞赛', '[（(][^)）]*[)）]', '', 'g'), '竞赛$', ''))")


#: Names of accounts in full-width letters, with dots, dashes and brackets; what they come to is written out by hand.
_ACCOUNT = "CASE s_suppkey % 4 WHEN 0 THEN ' ＡＢ·c•D_e ' || s_suppkey WHEN 1 THEN 'x—y（z）(w)[v].' || s_suppkey WHEN 2 THEN s_name ELSE NULL END"
_ACCOUNT_KEY = "CASE s_suppkey % 4 WHEN 0 THEN 'abcde' || s_suppkey WHEN 1 THEN 'xyzw[v].' || s_suppkey WHEN 2 THEN replace(lower(replace(s_name, '#', '#')), '-', '') ELSE NULL END"


@query(f"SELECT s_suppkey, regexp_replace({_ACCOUNT_KEY}, '\\s', '', 'g') AS v FROM supplier")
def n9_account_key(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", X.account_key(F.expr(_ACCOUNT)).alias("v"))


_PATH = "rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/')"


@query(f"SELECT page_id, regexp_replace(lower({URL_SQL}), '^www\\.', '') || CASE {_PATH} WHEN '' THEN '/' ELSE {_PATH} END AS v FROM pages")
def n10_url_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.url_key(F.col("url")).alias("v"))


@query(f"SELECT page_id, regexp_extract(lower(url), '^(https?)://', 1) || '://' || regexp_replace(lower({URL_SQL}), '^m\\.', 'www.') || CASE {_PATH} WHEN '' THEN '/' ELSE {_PATH} END AS v FROM pages")
def n11_canonical_url(spark, sf):
    pages = table(spark, sf, "pages")
    host = F.lower(X.url_part(F.col("url"), "AUTHORITY"))
    plain = X.canonical_url(F.col("url"), {})
    moved = F.when(host.startswith("m."), F.replace(plain, F.concat(F.lit("://"), host), F.concat(F.lit("://www."), F.substr(host, F.lit(3))))).otherwise(plain)
    return pages.select("page_id", moved.alias("v"))


@query("SELECT page_id, place, u FROM (SELECT page_id, unnest([0, 1]) AS place, unnest([url, regexp_replace(url, '://m\\.', '://www.')]) AS u, url FROM pages) WHERE place = 0 OR u <> url")
def n12_alias_urls(spark, sf):
    both = F.array_distinct(F.array("url", F.regexp_replace("url", r"://m\.", "://www.")))
    return table(spark, sf, "pages").select("page_id", F.posexplode(both).alias("place", "u"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '[?&]id=') THEN '/s?id=' || regexp_extract(url, '[?&]id=([^&#]*)', 1) ELSE regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) END AS v FROM pages")
def n13_article_url(spark, sf):
    key = X.url_part(F.col("url"), "QUERY")
    own = F.nullif(F.regexp_extract(F.concat(F.lit("?"), key), r"[?&]id=([^&#]*)", 1), F.lit(""))
    rest = F.concat(F.coalesce(X.url_part(F.col("url"), "PATH"), F.lit("")), F.when(key.isNotNull(), F.concat(F.lit("?"), key)).otherwise(""))
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.concat(F.lit("/s?id="), own), rest).alias("v"))


_DOMAINS = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')"


@query(f"""SELECT page_id, CASE WHEN NOT contains(h, '.') THEN '' WHEN regexp_matches(h, '\\.(ac|com|edu|gov|net|org)\\.cn$|\\.(co|org)\\.uk$')
  THEN regexp_extract(h, '([^.]+\\.[^.]+\\.[^.]+)$', 1) ELSE regexp_extract(h, '([^.]+\\.[^.]+)$', 1) END AS v FROM (SELECT page_id, {_DOMAINS} AS h FROM pages)""")
def n14_source_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.source_domain(F.col("url")).alias("v"))


@query("SELECT page_id, url AS v FROM pages")
def n15_unwrap_redirect(spark, sf):
    wrapped = F.concat(F.lit("https://search.example/link?target="), F.url_encode("url"))
    return table(spark, sf, "pages").select("page_id", wrapped.alias("w")).select("page_id", F.try_url_decode(F.try_parse_url("w", F.lit("QUERY"), F.lit("target"))).alias("v"))


_HTML = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _code, _raw in X.ENTITIES.items():
    _HTML = f"replace({_HTML}, '{_code}', '{_raw.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, trim(regexp_replace({_HTML}, '\\s+', ' ', 'g')) AS v FROM pages")
def n16_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("v"))


_HEAD = "coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1))"


@query(f"SELECT page_id, substr(trim(regexp_replace({_HTML}, '\\s+', ' ', 'g')), 1, 200) AS v FROM (SELECT page_id, {_HEAD} AS html FROM pages)")
def n17_page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.page_title(F.col("html")).alias("v"))


@query("""SELECT page_id, nullif(regexp_extract(h, '(?is)<meta[^>]*name="author"[^>]*content="([^"]*)"', 1), '') AS v FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<META name="author" content="A ' || page_id || '">' || html ELSE html END AS h FROM pages)""")
def n18_meta_content(spark, sf):
    h = F.expr("""CASE WHEN page_id % 2 = 0 THEN concat('<META name="author" content="A ', page_id, '">', html) ELSE html END""")
    return table(spark, sf, "pages").select("page_id", X.meta_content(h, "author").alias("v"))


@query("""WITH l AS (SELECT doc_id, trim(x) AS x, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  f AS (SELECT doc_id, x, min(i) AS i FROM l WHERE length(x) > 2 GROUP BY doc_id, x)
  SELECT doc_id, coalesce(v, '') AS v FROM documents LEFT JOIN (SELECT doc_id, substr(string_agg(x, chr(10) ORDER BY i), 1, 600) AS v FROM f GROUP BY doc_id) USING (doc_id)""")
def n19_compact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.compact_text(F.col("text")).alias("v"))

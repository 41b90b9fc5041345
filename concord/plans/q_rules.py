"""Queries of notices, candidates, source configuration, accounts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import candidates as CF
from concord.functions import preview as V
from concord.operators import candidates as C
from concord.operators.profiles import upsert_profiles
from concord.plans import pipelines as P
from concord.plans.q_merge import shared_folder
from concord.plans.q_text import NOW
from concord.plans.register import query, table
from concord.sources import tables as IO

#: Documents as notices: what stands before their text.
_HEAD = """CASE doc_id % 7 WHEN 0 THEN '关于全国比赛的通知' WHEN 1 THEN '省级大赛' WHEN 2 THEN '学院讲座' WHEN 3 THEN '编程竞赛 ' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN chr(10) ELSE ' ' END
  || CASE doc_id % 5 WHEN 0 THEN '主办单位：' || source || '，欢迎' WHEN 1 THEN '承办方: ' || source || chr(10) WHEN 2 THEN '举办 ' || doc_id || ' 主办：x' ELSE '' END
  || CASE doc_id % 4 WHEN 0 THEN '团队保研' WHEN 1 THEN '个人综测' ELSE '' END || chr(10)"""
_NOTICE = f"({_HEAD} || coalesce(text, ''))"
_NOTICE_URL = "CASE doc_id % 3 WHEN 0 THEN 'https://www.nju.edu.cn/' || doc_id WHEN 1 THEN 'https://x.org/' || source END"
_AFTER = "trim(substr(substr(t, {at}, 50), {sep} + 1), ' ' || chr(10) || chr(9) || chr(13))"


def _one_of(words: str, other: str = "NULL") -> str:
    rules = [r.split(">") for r in words.split(";")]
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '{w}') THEN '{label}'" for w, label in rules) + f" ELSE {other} END"


def _all_of(words: str) -> str:
    rules = [r.split(">") for r in words.split(";")]
    return "CAST(to_json(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{w}') THEN '{label}' END" for w, label in rules) + "], lambda x: x IS NOT NULL)) AS VARCHAR)"


_BEHIND = "CASE WHEN strpos(t, '{w}') > 0 THEN (SELECT CASE WHEN p > 0 THEN regexp_extract(regexp_replace(substr(g, p + 1), '^\\s+', ''), '^[^\\n，。]*') END FROM (SELECT g, CASE WHEN strpos(g, '：') > 0 THEN strpos(g, '：') WHEN strpos(g, ':') > 0 THEN strpos(g, ':') WHEN strpos(g, '是') > 0 THEN strpos(g, '是') ELSE strpos(g, '为') END AS p FROM (SELECT substr(t, strpos(t, '{w}'), 50) AS g))) END"


@query(f"""WITH n AS (SELECT doc_id, {_NOTICE} AS t, coalesce({_NOTICE_URL}, '') AS u FROM documents)
  SELECT doc_id, coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 5)[1][:200], '') AS title,
    {_one_of('国际|全国|中国>校外竞赛;省>校外竞赛;学院|书院|院系>校内活动;竞赛|比赛|大赛|挑战>校内竞赛', "'校内活动'")} AS scope_type, {_one_of('国际|全国|中国>国家级;省>省级;学院|书院|院系>院级', "'校级'")} AS contest_level,
    {_one_of('程序设计|编程|算法|ACM|ICPC>程序设计竞赛;建模>数学建模;创业|三创|挑战杯>创新创业;五育|体育|美育|德育|劳育>五育活动;讲座|沙龙|分享>学术讲座;人工智能|AI|机器学习>人工智能', "'其他'")} AS category,
    {_all_of('组队|团队|三人>需要组队;个人|独立>个人赛;保研>保研相关;五育>五育学分')} AS tags, {_all_of('保研>保研可能相关;综测|综合测评>综测加分;五育>五育明确相关')} AS policy_tags,
    CASE WHEN u = '' THEN '' WHEN contains(u, 'nju.edu.cn') THEN '南京大学官网' ELSE '外部来源' END AS source_name, CASE WHEN contains(u, 'nju.edu.cn') THEN '高' ELSE '中' END AS authority_level,
    coalesce({", ".join(_BEHIND.format(w=w) for w in ("举办", "承办", "组织", "主办"))}, '') AS organizer, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')[:100]) AS head, length(t[:2000]) AS kept FROM n""")
def f8_notice_preview(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_NOTICE).alias("t"), F.expr(_NOTICE_URL).alias("u"))
    p = V.parse_notices(docs, "t", "u")
    names = ["title", "scope_type", "contest_level", "category", "tags", "policy_tags", "source_name", "authority_level", "organizer"]
    return p.select("doc_id", *[f"preview.{n}" for n in names], F.length("preview.summary").cast("long").alias("head"), F.length("preview.original_text").cast("long").alias("kept"))


#: Orders as candidates of events, of platforms and others.
_URL = """CASE o_orderkey % 6 WHEN 0 THEN 'https://My-' || o_custkey || '.Devpost.com/' WHEN 1 THEN 'https://devfolio.co/hackathons' WHEN 2 THEN 'https://cs.x' || o_custkey % 9 || '.edu.cn:8080/a' WHEN 3 THEN 'https://events.mlh.io/e/' || o_orderkey
  WHEN 4 THEN '' ELSE 'https://site' || o_custkey % 9 || '.org/e/' || o_orderkey END"""
_NAME = "CASE o_custkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN '' WHEN 2 THEN 'MLH' WHEN 3 THEN 'Hackclub feed' ELSE 'websearch ' || o_orderpriority END"
_FOUND = "CASE WHEN o_orderkey % 10 = 0 THEN 'devfolio_listing' WHEN o_orderkey % 10 = 5 THEN 'a general list' END"
_WORD = "CASE o_orderstatus WHEN 'O' THEN ' High ' WHEN 'F' THEN 'low' END"
_HOST = f"regexp_replace(lower(regexp_extract({_URL}, '^https://([^/]*)', 1)), '^$', '')"
_PLATFORM = f"CASE WHEN {_URL} = '' THEN 'unknown' WHEN contains({_HOST}, 'devfolio') THEN 'devfolio' WHEN contains({_HOST}, 'mlh.io') THEN 'mlh' WHEN contains({_HOST}, 'devpost') THEN 'devpost' ELSE 'general_search' END"


@query(f"""SELECT o_orderkey, {_PLATFORM} AS platform,
  CASE WHEN o_orderkey % 10 = 0 THEN 'devfolio' WHEN o_custkey % 5 = 2 THEN 'mlh' WHEN o_custkey % 5 = 4 OR o_orderkey % 10 = 5 THEN 'general_search' WHEN o_custkey % 5 = 3 THEN 'hackclub' ELSE {_PLATFORM} END AS source,
  CASE WHEN o_custkey % 5 > 1 THEN {_NAME} WHEN contains({_HOST}, 'devpost') THEN 'Devpost' WHEN contains({_HOST}, 'devfolio') THEN 'Devfolio' WHEN contains({_HOST}, 'mlh.io') THEN 'MLH' ELSE {_HOST} END AS label,
  CASE WHEN o_orderstatus = 'O' THEN '高' WHEN o_orderstatus = 'F' THEN '低' WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN '高' ELSE '中' END AS authority FROM orders""")
def f9_sources(spark, sf):
    url, name = F.expr(_URL), F.expr(_NAME)
    return table(spark, sf, "orders").select(
        "o_orderkey", CF.platform_of(url).alias("platform"), CF.candidate_source(F.expr(_FOUND), name, url).alias("source"), CF.source_label(name, url).alias("label"), CF.authority(F.expr(_WORD), url).alias("authority"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 AND o_custkey % 3 > 0 AND o_orderstatus = 'O' THEN 'structured' WHEN {_URL} = '' OR contains({_URL}, '/hackathons') THEN 'listing' ELSE 'detail' END AS kind FROM orders""")
def p15_candidate_kinds(spark, sf):
    o = table(spark, sf, "orders")
    title, start = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).otherwise(" "), F.when(F.col("o_custkey") % 3 == 1, F.col("o_orderdate").cast("string"))
    deadline = F.when(F.col("o_custkey") % 3 == 2, F.col("o_orderdate").cast("string")).otherwise("")
    word = F.when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    return o.select("o_orderkey", CF.candidate_kind(title, start, F.lit(None).cast("string"), deadline, word, F.expr(_URL)).alias("kind"))


@query("""SELECT doc_id, (doc_id % 5 = 0 OR (length(t) < 200 AND contains(t, 'hub of contests')) OR (doc_id % 3 > 0 AND NOT contains(t, 'expected') AND NOT contains(t, '竞赛详情') AND length(t) < 600)) AS generic
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'hub of contests ' WHEN 1 THEN 'an expected one ' WHEN 2 THEN '竞赛详情 ' ELSE '' END || coalesce(text, '') AS t FROM documents)""")
def p13_platform_pages(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    text = F.concat(F.expr("CASE doc_id % 4 WHEN 0 THEN 'hub of contests ' WHEN 1 THEN 'an expected one ' WHEN 2 THEN '竞赛详情 ' ELSE '' END"), F.coalesce("text", F.lit("")))
    title, expected = F.when(k % 5 == 0, "Home - all").otherwise("x Home"), F.when(k % 3 > 0, "expected title")
    return d.select("doc_id", CF.is_generic_page(title, text, expected, "Home", "hub of contests", "竞赛详情").alias("generic"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'signup_deadline' END, CASE WHEN c_custkey % 4 = 0 THEN 'event_time' END, CASE WHEN c_acctbal < 0 THEN 'organizer' END, CASE WHEN c_custkey % 5 = 0 THEN 'tags' END], lambda x: x IS NOT NULL), ',') AS missing,
  c_custkey % 3 = 0 OR c_custkey % 4 = 0 AS critical FROM customer""")
def p16_verifiable_fields(spark, sf):
    k = F.col("c_custkey")
    fields = {"signup_deadline": F.when(k % 3 != 0, F.col("c_mktsegment")), "event_time": F.when(k % 4 == 0, "  ").otherwise(F.col("c_name")), "organizer": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "tags": F.when(k % 5 == 0, "[]").otherwise('["a"]')}
    gone = CF.missing_fields(fields)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(gone, ",").alias("missing"), F.arrays_overlap(gone, F.array(*map(F.lit, CF.CRITICAL))).alias("critical"))


_LINKED = """concat('<a href="', url, '">self</a><A HREF="https://Own.org/', page_id, '">a</A><a href="http://x.org/', page_id % 7, '">b</a><a href="', url, '">again</a>', html)"""


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all({_LINKED}, '(?i)href="(https?://[^"]+)"', 1) AS l FROM pages),
  k AS (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i AND NOT regexp_matches(lower(x), '^https?://own\\.org')) AS l FROM l)
  SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS place, unnest(l) AS url FROM k""")
def f16_external_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(CF.external_links(F.expr(_LINKED), ["own.org"])).alias("place", "url"))


@query("""SELECT page_id, regexp_extract(regexp_extract(url, '^https?://([^/?#]+)', 1), '([^.]+\\.[^.]+)$', 1) AS d, CASE WHEN regexp_matches(url, '^https?://([^/?#]*\\.)?example\\.org([/?#]|$)') THEN 'Org' WHEN regexp_matches(url, '^https?://([^/?#]*\\.)?example\\.net([/?#]|$)') THEN 'Net' END AS platform,
  CASE WHEN regexp_matches(url, '^https?://([^/?#]*\\.)?example\\.org([/?#]|$)') THEN 'high' WHEN regexp_matches(url, '^https?://([^/?#]*\\.)?example\\.net([/?#]|$)') THEN 'medium' ELSE 'low' END AS platform_authority
  FROM pages WHERE strlen(html) <= 4000 AND NOT contains(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 'the')""")
def s3_source_rules(spark, sf):
    path = shared_folder(spark)
    config = "named_struct('known_platforms', array(named_struct('name', 'Org', 'domain', 'Example.org', 'base_url', '', 'authority', 'high'), named_struct('name', 'Net', 'domain', 'example.net', 'base_url', '', 'authority', 'medium')), 'exclusion_patterns', array('The'), 'max_page_bytes', 4000)"
    spark.range(1).select(F.to_json(F.expr(config)).alias("value")).coalesce(1).write.text(path)
    pages = table(spark, sf, "pages").withColumn("t", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    got = IO.apply_source_config(pages, IO.read_source_config(spark, path), "url", "t", "html")
    return got.select("page_id", F.regexp_extract(F.regexp_extract("url", "^https?://([^/?#]+)", 1), r"([^.]+\.[^.]+)$", 1).alias("d"), "platform", "platform_authority")


@query("""WITH c AS (SELECT DISTINCT c_mktsegment AS name, 'core' AS descr, CASE WHEN c_mktsegment < 'C' THEN 'school_level' ELSE 'college' END AS category FROM customer WHERE c_mktsegment < 'G'),
  f AS (SELECT coalesce(CASE WHEN o_orderkey % 4 = 0 THEN c_mktsegment END, 'n' || o_custkey % 40) AS name, arg_min(o_orderpriority, o_orderkey) AS descr FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
  SELECT name, descr, category, true AS is_core FROM c UNION ALL SELECT name, descr, 'dynamic', false FROM f WHERE name NOT IN (SELECT name FROM c)""")
def d5_account_classes(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    core = customer.filter("c_mktsegment < 'G'").select(F.col("c_mktsegment").alias("name"), F.lit("core").alias("descr"), F.when(F.col("c_mktsegment") < "C", "school_level").otherwise("college").alias("category")).distinct()
    name = F.coalesce(F.when(F.col("o_orderkey") % 4 == 0, F.col("c_mktsegment")), F.concat(F.lit("n"), F.col("o_custkey") % 40))
    found = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("seq"), name.alias("name"), F.col("o_orderpriority").alias("descr"))
    return C.merge_account_lists(core, found)


@query(f"""WITH e AS (SELECT user_id, event_id, event_type AS t FROM events), c AS (SELECT user_id, arg_max(CASE WHEN event_id % 10 = 0 THEN 'none' ELSE t END, event_id) FILTER (event_id % 3 = 0) AS major, arg_max('["' || t || '"]', event_id) FILTER (event_id % 4 = 1) AS tags,
    count_if(event_id % 3 = 0 OR event_id % 4 = 1) > 0 AS touched FROM e GROUP BY 1), p AS (SELECT c_custkey AS user_id, c_mktsegment AS major FROM customer WHERE c_custkey % 2 = 0)
  SELECT CAST(coalesce(p.user_id, c.user_id) AS VARCHAR) AS user_id, coalesce(c.major, p.major, '') AS major, coalesce(c.tags, '[]') AS interest_tags, 'daily' AS notify_preference, '[]' AS focus_contests, coalesce(c.touched, false) OR p.user_id IS NULL AS fresh, p.user_id IS NULL AS made
  FROM p FULL JOIN c ON p.user_id = c.user_id""")
def m9_partial_updates(spark, sf):
    now, old = F.lit(NOW).cast("timestamp"), F.lit("2020-01-01").cast("timestamp")
    c, e = table(spark, sf, "customer").filter("c_custkey % 2 = 0"), table(spark, sf, "events")
    fixed = {"nickname": "", "college": "", "grade": "", "interest_tags": "[]", "focus_contests": "[]", "notify_preference": "daily"}
    profiles = c.select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("major"), *[F.lit(v).alias(k) for k, v in fixed.items()], *[old.alias(t) for t in ("last_active_time", "create_time", "update_time")])
    pairs = F.array(
        F.when(F.col("event_id") % 3 == 0, F.struct(F.lit("major").alias("k"), F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.col("event_type")).alias("v"))),
        F.when(F.col("event_id") % 4 == 1, F.struct(F.lit("interest_tags").alias("k"), F.concat(F.lit('["'), "event_type", F.lit('"]')).alias("v"))),
        F.struct(F.lit("focus_contests").alias("k"), F.lit("not to be set").alias("v")))
    changes = e.select(F.concat(F.lit(" "), "user_id", F.lit("\n")).alias("user_id"), F.col("event_id").alias("seq"), F.map_from_entries(F.array_compact(pairs)).alias("fields"))
    blank = e.select(F.lit(" ").alias("user_id"), F.col("event_id").alias("seq"), F.create_map(F.lit("major"), F.lit("x")).alias("fields"))
    got = upsert_profiles(profiles, changes.unionByName(blank), now)
    return got.select("user_id", "major", "interest_tags", "notify_preference", "focus_contests", (F.col("update_time") == now).alias("fresh"), (F.col("create_time") == now).alias("made"))


#: When the pages are judged.
AT = "2026-08-01 00:00:00"
#: Pages as candidates: structured ones, listings that tell of two events each, and pages with a text.
_KIND = "CASE WHEN page_id % 5 = 0 THEN 'structured' WHEN page_id % 5 = 1 THEN 'listing' ELSE 'detail' END"


def _staged(spark, sf):
    """(candidates, listed, pages, parsed) for the full candidate sync, made of pages."""
    p, k = table(spark, sf, "pages"), F.col("page_id") % 5
    none = F.lit(None).cast("string")
    url = F.when(k == 1, F.concat(F.lit("https://l"), "page_id", F.lit(".example.org/hackathons"))).otherwise(F.concat(F.lit("https://d"), "page_id", F.lit(".example.org/e/1")))
    candidates = p.select(
        F.col("page_id").cast("long").alias("seq"), F.lit(0).alias("place"), none.alias("platform_id"), F.concat(F.lit("devpost"), F.lit("")).alias("source"),
        F.when(k == 0, F.concat(F.lit("Event "), "page_id")).otherwise("").alias("title"), url.alias("url"), none.alias("organizer"),
        F.when(k == 0, F.when(F.col("page_id") % 2 == 0, "2026-08-20").otherwise("2026-07-01")).alias("signup_deadline"), none.alias("event_start"), none.alias("event_end"),
        none.alias("status"), none.alias("mode"), none.alias("summary"), F.when(k == 0, "high").otherwise("low").alias("authority"), F.array().cast("array<string>").alias("tags"))
    lists = p.filter("page_id % 5 = 1").select("page_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
    listed = lists.select(
        F.concat(F.lit("l"), "page_id", F.lit(".example.org/hackathons")).alias("url_key"), "place", none.alias("platform_id"), F.lit("devpost").alias("source"),
        F.when(F.col("place") == 1, F.concat(F.lit("Listed "), "page_id")).otherwise(F.concat(F.lit("Event "), F.col("page_id") - 1)).alias("title"), none.alias("url"), none.alias("organizer"),
        F.lit("2026-08-20").alias("signup_deadline"), none.alias("event_start"), none.alias("event_end"), none.alias("status"), none.alias("mode"), none.alias("summary"), F.lit("medium").alias("authority"), F.array().cast("array<string>").alias("tags"))
    text = F.expr("CASE page_id % 5 WHEN 2 THEN 'A hackathon. Registration is closed. ' WHEN 3 THEN 'A hackathon, register now. Organized by: The Club. Registration deadline: 2026-08-15. ' ELSE 'Cooking. ' END")
    pages = p.filter("page_id % 5 > 1 and page_id % 7 > 0").select(F.concat(F.lit("d"), "page_id", F.lit(".example.org/e/1")).alias("url_key"), F.concat(F.lit("Page "), "page_id").alias("page_title"), text.alias("text"))
    parsed = p.filter("page_id % 10 = 3").select(F.concat(F.lit("d"), "page_id", F.lit(".example.org/e/1")).alias("url_key"), F.concat(F.lit("Parsed "), "page_id").alias("title"), F.lit("").alias("organizer"), F.lit("online").alias("mode"))
    return candidates, listed, pages, parsed


_STAGED = f"""(SELECT page_id AS seq, 0 AS place, {_KIND} AS kind, CASE page_id % 5 WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN 'accepted' ELSE 'expired_filtered' END
    ELSE CASE WHEN page_id % 7 = 0 THEN 'fetch_failed' WHEN page_id % 5 = 2 THEN 'closed_filtered' WHEN page_id % 5 = 3 THEN 'accepted' ELSE 'not_hackathon' END END AS reason FROM pages WHERE page_id % 5 <> 1
  UNION ALL SELECT page_id, 1, 'structured', 'accepted' FROM pages WHERE page_id % 5 = 1
  UNION ALL SELECT page_id, 2, 'structured', CASE WHEN page_id % 2 = 1 THEN 'postparse_duplicates' ELSE 'accepted' END FROM pages WHERE page_id % 5 = 1)"""


@query(f"SELECT CAST(seq AS BIGINT) AS seq, place, kind, reason FROM {_STAGED}")
def g2_staged_decisions(spark, sf):
    parts = _staged(spark, sf)
    return C.decide(*parts, F.lit(AT).cast("timestamp"), 2026, parts[0].count()).select("seq", "place", "kind", "reason")


@query(f"""SELECT coalesce(s, '(all)') AS source, count(*) AS discovered, count_if(reason = 'accepted') AS accepted, count_if(reason = 'postparse_duplicates') AS postparse_duplicates, count_if(reason = 'closed_filtered') AS closed_filtered, count_if(reason = 'not_hackathon') AS not_hackathon
  FROM (SELECT reason, 'devpost' AS s FROM {_STAGED}) GROUP BY ROLLUP (s)""")
def g2_full_candidate_sync(spark, sf):
    parts, path = _staged(spark, sf), shared_folder(spark)
    got = P.sync_candidates(IO.TableStore(spark, f"{path}/store"), *parts, F.lit(AT).cast("timestamp"), 2026, parts[0].count(), f"{path}/report")
    return got.select(F.coalesce("source_key", F.lit("(all)")).alias("source"), "discovered", "accepted", "postparse_duplicates", "closed_filtered", "not_hackathon")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 3 AND page_id % 10 = 3 THEN 'Parsed ' || page_id ELSE 'Page ' || page_id END AS title, CASE WHEN page_id % 10 = 3 THEN '' ELSE 'The Club' END AS organizer, '2026-08-15T00:00:00+08:00' AS signup_deadline,
  CASE WHEN page_id % 10 = 3 THEN '["黑客松","线上"]' ELSE '["黑客松"]' END AS tags, '中' AS authority_level, '报名中' AS status FROM (SELECT * FROM pages WHERE page_id % 5 = 3 AND page_id % 7 > 0)""".replace("'中' AS", "'低' AS"))
def f18_events_of_details(spark, sf):
    parts = _staged(spark, sf)
    rows = C.decide(*parts, F.lit(AT).cast("timestamp"), 2026, parts[0].count()).filter("reason = 'accepted' and kind = 'detail'")
    return C.to_events(rows).select(F.col("seq").alias("page_id"), "title", "organizer", "signup_deadline", "tags", "authority_level", "status")

"""Queries of ranking, reports and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from concord.operators import rank as R
from concord.operators import state as S
from concord.operators.dedup import cap_round_robin
from concord.plans.q_text import EVENTS_SQL, NOW, as_events
from concord.plans.register import query, table


@query("""WITH p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos, min(event_id) OVER (PARTITION BY event_type) AS f FROM events)
  SELECT event_type, event_id, CAST(row_number() OVER (ORDER BY pos, f) AS INT) AS place FROM p ORDER BY pos, f LIMIT 60""")
def w1_round_robin_cap(spark, sf):
    return cap_round_robin(table(spark, sf, "events"), 60, "event_type", "event_id").select("event_type", "event_id", "place")


@query("""SELECT user_id, event_id, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3""")
def w2_top_k(spark, sf):
    return R.top_k(table(spark, sf, "events"), "user_id", "value", "event_id", 3).select("user_id", "event_id", "rank")


@query("SELECT url, CAST(row_number() OVER (ORDER BY page_id) AS INT) AS rank FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) ORDER BY page_id LIMIT 20")
def w3_rank_merged(spark, sf):
    first = table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page_id")).orderBy("page_id").limit(20)
    return first.select("url", F.row_number().over(Window.orderBy("page_id")).alias("rank"))


_DAYS = f"date_diff('day', DATE '{NOW[:10]}', CAST(deadline AS DATE))"


@query(f"""SELECT event_id, status, coalesce(CAST({_DAYS} AS INT), 9999) AS days FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY deadline NULLS LAST, event_id) AS n FROM {EVENTS_SQL}
  WHERE status IN ('O', 'P') AND deadline >= TIMESTAMP '{NOW}' AND deadline <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY) WHERE n <= 50""")
def w4_deadline_reminders(spark, sf):
    at = F.lit(NOW).cast("timestamp")
    e = as_events(spark, sf).filter(F.col("status").isin("O", "P") & F.col("deadline").between(at, at + F.expr("INTERVAL 7 DAY")))
    order = Window.partitionBy("status").orderBy(F.col("deadline").asc_nulls_last(), "event_id")
    days = F.coalesce(F.datediff(F.to_date("deadline"), F.to_date(at)), F.lit(9999))
    return e.withColumn("n", F.row_number().over(order)).filter("n <= 50").select("event_id", "status", days.alias("days"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 14 DAY ORDER BY ts DESC, event_id DESC LIMIT 500")
def w5_prune_state(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.prune_state(e, "ts", "event_id", F.lit("2024-01-20").cast("timestamp"), 14, 500).select("event_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def w6_last_n_turns(spark, sf):
    return R.last_n_turns(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role")


_REASON_OF = "CASE event_id % 30 {} WHEN 23 THEN 'no_title' WHEN 24 THEN event_type ELSE 'accepted' END".format(" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(R.COUNTERS)))


@query(f"""WITH s AS (SELECT event_type AS source, {_REASON_OF} AS reason FROM events), c AS (SELECT source, count(*) AS discovered, {", ".join(f"count_if(reason = '{c}') AS {c}" for c in R.COUNTERS)}, grouping(source) AS g FROM s GROUP BY ROLLUP (source)),
  o AS (SELECT source, string_agg(reason || '=' || n, ',' ORDER BY reason) AS other FROM (SELECT source, reason, count(*) AS n FROM s WHERE reason = 'no_title' OR reason = source GROUP BY 1, 2) GROUP BY 1
    UNION ALL SELECT NULL, string_agg(reason || '=' || n, ',' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM s WHERE reason = 'no_title' OR reason = source GROUP BY 1))
  SELECT c.* EXCLUDE (g), coalesce(o.other, '') AS other FROM c LEFT JOIN o ON c.source IS NOT DISTINCT FROM o.source""")
def a2_funnel(spark, sf):
    steps = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.expr(_REASON_OF).alias("reason"))
    text = F.array_join(F.transform(F.map_entries("other"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return R.funnel(steps).withColumn("other", text)


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'updated' WHEN 2 THEN 'skipped' ELSE 'error' END AS action, count(*) AS n FROM orders GROUP BY 1")
def a3_sync_stats(spark, sf):
    action = F.element_at(F.array(*map(F.lit, ("added", "updated", "skipped", "error"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT 'status' AS col, o_orderstatus AS val, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a4_distributions(spark, sf):
    long = table(spark, sf, "orders").select(F.explode(F.array(F.struct(F.lit("status").alias("col"), F.col("o_orderstatus").alias("val")), F.struct(F.lit("priority").alias("col"), F.col("o_orderpriority").alias("val")))).alias("x"))
    return long.groupBy("x.col", "x.val").agg(F.count("*").alias("n"))


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason")
def a5_reason_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query("""SELECT s_nationkey, count(*) AS n, string_agg(s_name, ',' ORDER BY s_name) AS names, grouping(s_nationkey) AS total FROM supplier WHERE s_nationkey IS NOT NULL GROUP BY s_nationkey
  UNION ALL SELECT NULL, count(*), NULL, 1 FROM supplier""")
def a6_account_summary(spark, sf):
    s = table(spark, sf, "supplier")
    names = s.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("names"), F.lit(0).cast("long").alias("total"))
    whole = s.agg(F.lit(None).cast("int").alias("s_nationkey"), F.count("*").alias("n"), F.lit(None).cast("string").alias("names"), F.lit(1).cast("long").alias("total"))
    return names.unionByName(whole)


@query("""SELECT count(*) AS seen, count_if(event_type <> 'error') AS verified, count_if(event_type <> 'error' AND ts < TIMESTAMP '2024-01-10') AS out_of_window, count_if(event_type = 'error') AS quarantined,
  count_if(event_type <> 'error' AND ts >= TIMESTAMP '2024-01-10' AND value > 50) AS relevant, count_if(event_type <> 'error' AND ts >= TIMESTAMP '2024-01-10' AND value <= 50) AS irrelevant,
  count(DISTINCT user_id) AS accounts, count(*) - count(DISTINCT user_id || '/' || event_type) AS duplicates FROM events""")
def a7_crawl_stats(spark, sf):
    ok, recent, high = F.col("event_type") != "error", F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"), F.col("value") > 50
    n = F.count_if
    return table(spark, sf, "events").agg(
        F.count("*").alias("seen"), n(ok).alias("verified"), n(ok & ~recent).alias("out_of_window"), n(~ok).alias("quarantined"), n(ok & recent & high).alias("relevant"),
        n(ok & recent & ~high).alias("irrelevant"), F.count_distinct("user_id").alias("accounts"), (F.count("*") - F.count_distinct("user_id", "event_type")).alias("duplicates"))


_OLD = "(SELECT DISTINCT p_name || p_size % 3 AS name FROM part WHERE p_partkey % 3 <> 0)"
_NEW = "(SELECT DISTINCT CASE WHEN p_size % 3 = 1 THEN upper(p_name || p_size % 3) ELSE p_name || p_size % 3 END AS name FROM part WHERE p_partkey % 3 <> 1)"


@query(f"""WITH o AS {_OLD}, n AS {_NEW}, g AS (SELECT lower(name) AS k, min(name) AS name FROM o WHERE name NOT IN (FROM n) GROUP BY 1), c AS (SELECT lower(name) AS k, min(name) AS name FROM n WHERE name NOT IN (FROM o) GROUP BY 1),
  r AS (SELECT g.name AS a, c.name AS b FROM g JOIN c ON g.k = c.k)
  SELECT 'unchanged' AS change, name AS old_name, name AS new_name FROM o WHERE name IN (FROM n) UNION ALL SELECT 'renamed', a, b FROM r
  UNION ALL SELECT 'removed', name, NULL FROM o WHERE name NOT IN (FROM n) AND name NOT IN (SELECT a FROM r) UNION ALL SELECT 'added', NULL, name FROM n WHERE name NOT IN (FROM o) AND name NOT IN (SELECT b FROM r)""")
def a8_catalog_diff(spark, sf):
    part, name = table(spark, sf, "part"), F.concat("p_name", F.col("p_size") % 3)
    old = part.filter("p_partkey % 3 <> 0").select(name.alias("name"))
    new = part.filter("p_partkey % 3 <> 1").select(F.when(F.col("p_size") % 3 == 1, F.upper(name)).otherwise(name).alias("name"))
    return R.catalog_diff(old, new, "name", F.lower("name"))


@query("SELECT count(*) AS n, count(DISTINCT url) AS n_urls, count_if(html IS NULL) AS no_html, count_if(url IS NULL) AS no_url FROM pages")
def a9_quality_profile(spark, sf):
    return table(spark, sf, "pages").agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"), F.count_if(F.col("html").isNull()).alias("no_html"), F.count_if(F.col("url").isNull()).alias("no_url"))


@query("""SELECT user_id, CAST(floor(epoch(greatest(CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-15' END, max(ts) FILTER (event_type <> 'error')))) AS BIGINT) AS cursor FROM events
  GROUP BY user_id HAVING user_id % 3 = 0 OR count_if(event_type <> 'error') > 0""")
def a10_advance_cursors(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    old = e.filter("user_id % 3 = 0").select("user_id").distinct().withColumn("last_at", F.lit("2024-01-15").cast("timestamp"))
    got = S.advance_cursors(old, e.filter("event_type <> 'error'"), "user_id", "at")
    return got.select("user_id", F.unix_timestamp("last_at").alias("cursor"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN 'checked' ELSE '' END, ''), 'active') AS status, '2026-07-21' AS verified_at FROM part")
def a11_stamp_verified(spark, sf):
    status = F.when(F.col("p_size") > 25, "checked").otherwise("")
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.nullif(status, F.lit("")), F.lit("active")).alias("status"), F.lit("2026-07-21").alias("verified_at"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE '' END AS tags FROM customer""")
def r1_json_array(spark, sf):
    text = F.when(F.col("c_custkey") % 2 == 0, '["a", "b"]').otherwise("not json")
    tags = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(tags, ",").alias("tags"))


def _pairs(spark, sf, *more):
    """The stated query set, every 50th customer, as profiles; all parts as events, with more columns."""
    c = table(spark, sf, "customer").filter("c_custkey % 50 = 0").select(
        F.col("c_custkey").alias("user_id"), F.lower("c_mktsegment").alias("major"), F.array(F.lit("STEEL"), F.lower(F.substring("c_name", 1, 3))).alias("interests"))
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), F.lower("p_name").alias("target_major"), F.col("p_type").alias("category"), F.col("p_size").alias("days"),
        F.when(F.col("p_partkey") % 3 == 0, "国家级").otherwise("省级").alias("level"), (F.col("p_partkey") % 5 == 0).alias("approved"), *more)
    return c, p


def _on():
    blank, none = F.lit(""), F.array().cast("array<string>")
    cols = {k: F.col(k) for k in ("major", "interests", "target_major", "category", "days", "level", "approved")}
    return cols | {"grade": blank, "target_grade": blank, "tags": none, "policy_tags": none, "followed": F.col("seq") == F.col("user_id")}


_SCORE = """(SELECT c_custkey AS user_id, p_partkey AS seq, CASE WHEN contains(lower(p_name), lower(c_mktsegment)) THEN 3.0 ELSE 0.0 END
  + CASE WHEN contains(lower(p_type), 'steel') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(p_type), lower(substr(c_name, 1, 3))) THEN 1.0 ELSE 0.0 END
  + CASE WHEN p_partkey % 5 = 0 THEN 2.0 ELSE 0.0 END + CASE WHEN p_partkey = c_custkey THEN 5.0 ELSE 0.0 END
  + CASE WHEN p_size BETWEEN 0 AND 7 THEN 3.0 WHEN p_size <= 30 THEN 2.0 WHEN p_size > 0 THEN 1.0 ELSE 0.0 END
  + CASE WHEN p_partkey % 3 = 0 THEN 2.0 ELSE 1.0 END AS score FROM customer, part WHERE c_custkey % 50 = 0)"""


@query(f"SELECT user_id, seq, CAST(score AS DOUBLE) AS score FROM {_SCORE}")
def r2_relevance_score(spark, sf):
    c, p = _pairs(spark, sf)
    return R.score_each_pair(c, p, _on())


#: Parts dressed as events with all that reasons are made of, alike in Spark and DuckDB.
_REASON_PARTS = """SELECT p_partkey AS seq, lower(p_name) AS target_major, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2021,2022' END AS target_grade, p_type AS category,
  CASE WHEN p_size % 10 <> 0 THEN p_size - 3 END AS days, CASE p_partkey % 4 WHEN 0 THEN '国际级' WHEN 1 THEN '国家级' WHEN 2 THEN '省级' ELSE '校级' END AS level, p_partkey % 5 = 0 AS approved,
  CASE p_partkey % 6 WHEN 0 THEN '教育部高等教育司（北京）某某办公室' ELSE p_brand END AS organizer, p_partkey % 4 AS policy, p_partkey % 7 AS tag FROM part"""
_REASON_USERS = "SELECT c_custkey AS user_id, lower(c_mktsegment) AS major, CASE WHEN c_custkey % 4 = 0 THEN '2022' ELSE '2023' END AS grade FROM customer WHERE c_custkey % 50 = 0"


@query(f"""SELECT user_id, seq, array_to_string(list_filter([CASE WHEN contains(target_major, major) THEN '专业核心竞赛（' || major || '）' END,
  CASE WHEN target_grade = '' THEN NULL WHEN contains(target_grade, grade) THEN '适合当前年级（' || grade || '）' ELSE '可跨年级参与' END,
  CASE WHEN policy = 1 THEN '保研加分项' END, CASE WHEN policy = 2 THEN '综测加分项' END, CASE WHEN policy = 3 THEN '奖学金评定相关' END, CASE WHEN policy = 2 THEN '五育认定' END,
  CASE WHEN approved THEN '教育部官方认证竞赛' END, CASE level WHEN '国际级' THEN '国际级高含金量赛事' WHEN '国家级' THEN '国家级权威竞赛' WHEN '省级' THEN '省级竞赛' END,
  CASE WHEN days IS NULL THEN '报名时间待确认，建议主动查询' WHEN days BETWEEN 0 AND 3 THEN '⏰ 即将截止（仅剩' || days || '天）' WHEN days BETWEEN 4 AND 7 THEN '本周截止（' || days || '天）'
    WHEN days BETWEEN 8 AND 30 THEN '本月截止（' || days || '天）' ELSE '充裕准备时间（' || days || '天）' END,
  CASE WHEN tag = 1 THEN '经典数学建模赛事' END, CASE WHEN tag = 2 THEN '创新创业类竞赛' END, CASE WHEN tag = 3 THEN '程序设计竞赛' END,
  CASE WHEN contains(organizer, '教育部') THEN '权威主办方（' || substr(organizer, 1, 15) || '）' END], lambda x: x IS NOT NULL), '|') AS reasons
  FROM ({_REASON_USERS}) u, ({_REASON_PARTS}) p""")
def r3_reasons(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    words = lambda c, *kinds: F.element_at(F.array(*[F.array(*map(F.lit, k)).cast("array<string>") for k in kinds]), F.col(c).cast("int") + 1)
    p = spark.sql(_REASON_PARTS).withColumn("policy_tags", words("policy", [], ["保研明确相关"], ["综测加分", "五育A"], ["奖学金评定"]))
    p = p.withColumn("tags", words("tag", [], ["全国数学建模"], ["创新创业"], ["ACM-x"], [], [], []))
    names = ("major", "grade", "target_major", "target_grade", "category", "days", "level", "approved", "organizer", "policy_tags", "tags")
    reasons = F.array_join(R.recommendation_reasons({c: F.col(c) for c in names}), "|")
    return R.each_pair(spark.sql(_REASON_USERS), p, reasons).withColumnRenamed("value", "reasons")


@query()
def r3_recommendation_reasons(spark, sf):
    c, p = _pairs(spark, sf, F.col("p_brand").alias("organizer"))
    return R.each_pair(c, p, R.recommendation_reasons({**_on(), "organizer": F.col("organizer")})).withColumnRenamed("value", "reasons")


@query(f"SELECT user_id, seq, CAST(score AS DOUBLE) AS score, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, seq) AS n FROM {_SCORE}) WHERE n <= 5")
def r4_recommend(spark, sf):
    c, p = _pairs(spark, sf)
    return R.score_pairs(c, p, _on(), 5)


@query("SELECT p_partkey, 'title: ' || p_name || chr(10) || CASE WHEN p_size > 25 THEN 'organizer: ' || p_brand || chr(10) ELSE '' END || 'category: ' || p_type AS v FROM part")
def r5_event_document(spark, sf):
    brand = F.when(F.col("p_size") > 25, F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", R.event_document(F.col("p_name"), brand, F.col("p_type"), F.lit("")).alias("v"))


@query()
def r6_chunk_documents(spark, sf):
    return R.chunk_documents(table(spark, sf, "documents").select("doc_id", "text"), "text", 200).select("doc_id", "chunk", "chunk_text")


_COS = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query(f"""SELECT query_id, vec_id, CAST(n AS INT) AS rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM
  (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {_COS} / ({_NORM.format('v')} * {_NORM.format('q')}) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE score >= 0.3) WHERE n <= 5""")
def r7_vector_top_k(spark, sf):
    v = table(spark, sf, "embeddings")
    return R.vector_top_k(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v).select("query_id", "vec_id", "rank")

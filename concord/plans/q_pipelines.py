"""Queries of whole pipelines and of the read API."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import verify as V
from concord.plans import pipelines as P
from concord.plans.q_dedup import _NAMES, names
from concord.plans.q_merge import _CONSENSUS, _RAW, observations, shared_folder
from concord.plans.q_text import EVENTS_SQL, NOW, as_events, query_events
from concord.plans.register import query, table
from concord.sources.tables import TableStore


def _sync(spark, sf):
    """Two full syncs, the second of all orders in two sources; the store, and the actions of the second."""
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.expr(_RAW).alias("title"), F.lit("u").alias("url"), F.col("o_orderstatus").alias("organizer"), F.col("o_orderdate").cast("timestamp").alias("deadline"))
    entries, now = spark.createDataFrame([], "seq long, title string, organizer string, category string, contest_level string, authority_level string, source_name string"), F.lit(NOW).cast("timestamp")
    store = TableStore(spark, shared_folder(spark))
    P.run_full_sync(store, entries, [raw.filter("seq % 50 = 7 and trim(title) <> ''")], now)
    return store, P.run_full_sync(store, entries, [raw.filter("seq % 2 = 0"), raw.filter("seq % 2 = 1")], now)


@query(f"""WITH r AS (SELECT o_orderkey AS seq, regexp_replace({_RAW}, '\\s+', '', 'g') AS k, CASE WHEN trim({_RAW}) = '' THEN 'skipped_invalid' WHEN contains({_RAW}, '培训') THEN 'skipped_ad' END AS skip FROM orders),
  f AS (SELECT k, min(seq) AS first FROM r WHERE skip IS NULL GROUP BY k), e AS (SELECT DISTINCT k FROM r WHERE seq % 50 = 7 AND k <> '')
  SELECT coalesce(skip, CASE WHEN seq = first AND e.k IS NULL THEN 'added' ELSE 'updated' END) AS action, count(*) AS n FROM r LEFT JOIN f ON r.k = f.k LEFT JOIN e ON r.k = e.k GROUP BY 1""")
def g1_full_sync(spark, sf):
    return _sync(spark, sf)[1]


@query(f"""WITH r AS (SELECT o_orderkey AS seq, {_RAW} AS title, o_orderdate AS d, o_orderstatus AS o FROM orders WHERE o_orderkey % 9 > 1)
  SELECT regexp_replace(title, '\\s+', '', 'g') AS catalog_key, arg_max(title, seq) AS title, strftime(arg_max(d, seq), '%Y-%m-%d') AS deadline FROM r GROUP BY 1""")
def g1_full_sync_editions(spark, sf):
    return _sync(spark, sf)[0].read("editions").select("catalog_key", "title", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"))


@query(f"""WITH c AS (SELECT page_id AS seq, 's' || page_id % 3 AS source, regexp_replace(lower(regexp_extract(url, '^https?://([^?#]+)', 1)), '^www\\.', '') AS k FROM pages),
  f AS (SELECT seq, source, row_number() OVER (PARTITION BY rtrim(k, '/') ORDER BY seq) AS n FROM c),
  o AS (SELECT seq, source, row_number() OVER (PARTITION BY source ORDER BY seq) AS pos FROM f WHERE n = 1),
  m AS (SELECT source, min(seq) AS s FROM o GROUP BY source), cap AS (SELECT o.seq FROM o JOIN m ON o.source = m.source ORDER BY pos, s LIMIT 40)
  SELECT source, CASE WHEN n > 1 THEN 'duplicate' WHEN seq NOT IN (SELECT seq FROM cap) THEN 'truncated' WHEN seq % 4 = 0 THEN 'expired_filtered' WHEN seq % 4 = 1 THEN 'accepted' WHEN seq % 4 = 2 THEN 'unverified_skipped' ELSE 'closed_filtered' END AS reason, count(*) AS n
  FROM f GROUP BY 1, 2""")
def g2_candidate_sync(spark, sf):
    pages = spark.createDataFrame([], "url_key string, page_title string, topic boolean")
    return P.candidate_decisions(_candidates(spark, sf), pages, F.lit(NOW).cast("timestamp"), 40).groupBy("source", "reason").agg(F.count("*").alias("n"))


def _candidates(spark, sf):
    at = F.lit(NOW).cast("timestamp")
    k = F.col("page_id") % 4
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("seq"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("source"), "url", F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"),
        F.when(k == 0, at - F.expr("INTERVAL 1 DAY")).when(k == 1, at + F.expr("INTERVAL 9 DAY")).alias("deadline"), F.lit(None).cast("timestamp").alias("start"), F.when(k == 3, "closed").alias("status"))


@query("""WITH c AS (SELECT page_id AS seq, 's' || page_id % 3 AS source, rtrim(regexp_replace(lower(regexp_extract(url, '^https?://([^?#]+)', 1)), '^www\\.', ''), '/') AS k FROM pages),
  f AS (SELECT seq, source, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM c),
  o AS (SELECT seq, source, row_number() OVER (PARTITION BY source ORDER BY seq) AS pos FROM f WHERE n = 1),
  m AS (SELECT source, min(seq) AS s FROM o GROUP BY source), cap AS (SELECT o.seq FROM o JOIN m ON o.source = m.source ORDER BY pos, s LIMIT 40)
  SELECT unnest(['candidates', 'accepted', 'duplicates', 'truncated', 'editions']) AS name,
    unnest([(SELECT count(*) FROM c), (SELECT count(*) FROM cap WHERE seq % 4 = 1), (SELECT count(*) FROM f WHERE n > 1), (SELECT count(*) FROM o) - (SELECT count(*) FROM cap), (SELECT count(*) FROM cap WHERE seq % 4 = 1)]) AS n""")
def g2_candidate_merge(spark, sf):
    """Candidates decided, reported and merged: the editions, and the totals of the report."""
    c, store, path = _candidates(spark, sf), TableStore(spark, shared_folder(spark)), shared_folder(spark)
    pages = spark.createDataFrame([], "url_key string, page_title string, topic boolean")
    P.run_candidate_sync(store, c, pages, F.lit(NOW).cast("timestamp"), 40, path)
    totals = spark.read.schema("name string, n long").json(f"{path}/totals").select("name", "n")
    return totals.unionByName(store.read("editions").select(F.lit("editions").alias("name")).groupBy("name").agg(F.count("*").alias("n")))


@query(f"""SELECT DISTINCT user_id AS entity_id, CASE WHEN user_id % 2 = 0 THEN 'known' ELSE c.value END AS level, user_id % 2 = 1 AND c.value IS NOT NULL AS verified
  FROM events e LEFT JOIN {_CONSENSUS} c ON e.user_id = c.entity_id""")
def g3_verification(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("entity_id")).distinct()
    return P.verify_incomplete(users.withColumn("level", F.when(F.col("entity_id") % 2 == 0, "known")), observations(spark, sf), "level")


@query("""SELECT CASE WHEN event_type = 'error' THEN 'unknown_publisher' WHEN ts < TIMESTAMP '2024-01-15' THEN 'late' WHEN event_id % 3 = 0 THEN 'processed' WHEN event_id % 2 = 0 THEN 'irrelevant' ELSE 'taken' END AS outcome, count(*) AS n FROM events GROUP BY 1""")
def g4_article_sync(spark, sf):
    items = table(spark, sf, "events").select(
        F.col("event_id").alias("key"), F.col("event_type").alias("account"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 2 == 0, "hello").otherwise("ACM deadline").alias("title"))
    items = items.withColumn("seq", F.col("key")).withColumn("publisher", F.col("account"))
    accounts = items.filter("account <> 'error'").select("account", F.lit(None).cast("array<string>").alias("aliases")).distinct()
    cursors = spark.createDataFrame([], "account string, last_at timestamp")
    got = P.article_outcomes(items, accounts, cursors, items.filter("key % 3 = 0").select("key"), F.lit("2024-01-16").cast("timestamp"), 24, overlap=0)
    return got.groupBy("outcome").agg(F.count("*").alias("n"))


_ARTICLES = """(SELECT event_id AS seq, 'k' || event_id AS key, event_type AS account, CASE WHEN event_id % 17 <> 0 THEN ts END AS ts, event_id % 2 = 1 AS good, CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type || '-Club' END AS publisher FROM events)"""


@query(f"""WITH a AS (SELECT *, publisher = '' OR account = 'error' AS strange FROM {_ARTICLES}),
  one AS (SELECT *, CASE WHEN strange THEN 'unknown_publisher' WHEN ts IS NULL THEN 'undated' WHEN ts < TIMESTAMP '2024-01-10' - INTERVAL 48 HOUR THEN 'late' WHEN good THEN 'taken' ELSE 'irrelevant' END AS o FROM a WHERE ts IS NULL OR ts < TIMESTAMP '2024-01-10'),
  cur AS (SELECT account, max(ts) AS t FROM one WHERE o IN ('taken', 'irrelevant') GROUP BY 1),
  two AS (SELECT a.*, CASE WHEN strange THEN 'unknown_publisher' WHEN a.ts IS NULL THEN 'undated'
      WHEN a.ts < least(TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR, coalesce(cur.t - INTERVAL 24 HOUR, TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR)) THEN 'late'
      WHEN a.seq IN (SELECT seq FROM one WHERE o IN ('taken', 'irrelevant') ORDER BY key DESC LIMIT 5000) THEN 'processed' WHEN good THEN 'taken' ELSE 'irrelevant' END AS o FROM a LEFT JOIN cur ON cur.account = a.account WHERE a.ts IS NULL OR a.ts < TIMESTAMP '2024-01-20')
  SELECT 1 AS round, o AS outcome, count(*) AS n FROM one GROUP BY ALL UNION ALL SELECT 2, o, count(*) FROM two GROUP BY ALL""")
def g4_article_rounds(spark, sf):
    """Two rounds over a store: the second starts from the cursors and the processed keys of the first, of which the store keeps the last 5,000."""
    e = table(spark, sf, "events")
    items = e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("k"), "event_id").alias("key"), F.col("event_type").alias("account"), F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat("event_type", F.lit("-Club"))).alias("publisher"),
        F.when(F.col("event_id") % 17 != 0, F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("ACM 竞赛 "), "event_id")).otherwise("hello").alias("title"), F.concat(F.lit("https://a.org/"), "event_id").alias("url"))
    accounts = e.filter("event_type <> 'error'").select(F.col("event_type").alias("account")).distinct().withColumn("aliases", F.array(F.concat("account", F.lit("（club）"))))
    store, rounds = TableStore(spark, shared_folder(spark)), []
    for n, day in ((1, "2024-01-10"), (2, "2024-01-20")):
        now = F.lit(day).cast("timestamp")
        rounds.append(P.run_article_sync(store, items.filter(F.col("at").isNull() | (F.col("at") < now)), accounts, now, 24).select(F.lit(n).alias("round"), "outcome", "n"))
    return rounds[0].unionByName(rounds[1])


#: Pages dressed as announcements of forty events: deadline and organiser with labels, some silent.
_SAYS = "CASE WHEN page_id % 7 = 0 THEN '' ELSE '报名截止：2026-0' || (1 + page_id % 2) || '-15 ' END || CASE WHEN page_id % 3 = 0 THEN '主办单位：学会' || page_id % 4 || ' ' ELSE '' END || 'x'"


@query(f"""WITH p AS (SELECT page_id % 40 AS e, page_id AS s, url, regexp_extract(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '([^.]+\\.[^.]+)$', 1) AS d,
    CASE WHEN page_id % 7 <> 0 THEN '2026-0' || (1 + page_id % 2) || '-15T23:59:59+08:00' END AS v FROM pages),
  f AS (SELECT e, d, min(s) AS s FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY s, d) AS n FROM f),
  r AS (SELECT p.* FROM p JOIN k ON p.e = k.e AND p.d = k.d AND p.s = k.s WHERE n <= 3 AND p.e % 5 <> 0), m AS (SELECT e, count(*) AS n FROM r GROUP BY 1),
  c AS (SELECT e, v, count(*) AS n, min(s) AS s FROM r WHERE v IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY n DESC, s) AS k FROM c),
  g AS (SELECT t.e, t.v FROM t JOIN m ON t.e = m.e WHERE k = 1 AND t.n >= 2 AND m.n >= 2)
  SELECT g.e AS entity_id, g.v AS field_value, r.url AS source_url FROM g JOIN r ON r.e = g.e AND r.v = g.v""")
def g3_page_evidence(spark, sf):
    p = table(spark, sf, "pages").select((F.col("page_id") % 40).alias("entity_id"), F.col("page_id").alias("seq"), "url", F.expr(_SAYS).alias("text"))
    deadline = F.when(F.col("entity_id") % 5 == 0, "2026-01-01T00:00:00+08:00").alias("signup_deadline")
    records = p.select("entity_id").distinct().select("entity_id", deadline, F.lit("known").alias("event_time"), F.lit("校级").alias("contest_level"), F.lit("学校").alias("organizer"), F.lit("pending_review").alias("verification_status"))
    got = V.verify_incomplete(records, p, F.lit(NOW).cast("timestamp"))
    return got["evidence"].filter("field_name = 'signup_deadline'").select("entity_id", "field_value", "source_url")


@query(f"SELECT seq, seq AS r_seq, 'updated' AS action FROM {_NAMES}")
def g5_fuzzy_import(spark, sf):
    n = names(spark, sf, False).withColumnRenamed("key", "title")
    return P.fuzzy_import(n.withColumn("title", F.concat(F.lit("【x】"), F.col("title"))), n)


@query(f"SELECT event_id, category FROM {EVENTS_SQL} WHERE status = 'O' AND deadline BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 30 DAY ORDER BY deadline, event_id LIMIT 50")
def g6_read_api(spark, sf):
    return query_events(as_events(spark, sf), status="O", days_within=30).select("event_id", "category")

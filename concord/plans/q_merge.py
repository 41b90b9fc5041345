"""Queries of merges, sources, sinks, streaming and whole pipelines."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from concord.functions import text as X
from concord.functions import times as T
from concord.operators import dedup
from concord.operators import merge as M
from concord.operators import state as S
from concord.operators import verify as V
from concord.plans.q_text import EVENTS_SQL, NOW, as_events
from concord.plans.register import query, table
from concord.sources import tables as IO
from concord.streaming.sync import BucketTable, route_stream, run_stream_sync


def shared_folder(spark) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{dedup.shared_base(spark).rstrip('/')}/{uuid.uuid4().hex}"


_FIELDS = ["organizer", "summary", "authority_level"]


def versions(spark, sf):
    """customer as existing records, and as incoming ones of other authority, some fields empty."""
    c = table(spark, sf, "customer")
    old = c.filter("c_custkey % 5 <> 0").select(
        F.col("c_custkey").alias("event_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("organizer"), F.col("c_mktsegment").alias("summary"),
        F.when(F.col("c_custkey") % 3 == 0, "高").otherwise("中").alias("authority_level"), (F.col("c_custkey") % 7 == 0).alias("is_ministry_approved"))
    new = c.filter("c_custkey % 4 <> 1").select(
        F.col("c_custkey").alias("event_id"), F.concat(F.lit("new "), F.col("c_name")).alias("organizer"), F.when(F.col("c_custkey") % 11 != 0, "new summary").otherwise("null").alias("summary"),
        F.when(F.col("c_custkey") % 2 == 0, "高").otherwise("低").alias("authority_level"), (F.col("c_custkey") % 13 == 0).alias("is_ministry_approved"))
    return old, new


_VERSIONS = """WITH o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS organizer, c_mktsegment AS summary, CASE WHEN c_custkey % 3 = 0 THEN '高' ELSE '中' END AS authority_level,
    c_custkey % 7 = 0 AS ap FROM customer WHERE c_custkey % 5 <> 0),
  i AS (SELECT c_custkey AS id, 'new ' || c_name AS organizer, CASE WHEN c_custkey % 11 <> 0 THEN 'new summary' ELSE 'null' END AS summary, CASE WHEN c_custkey % 2 = 0 THEN '高' ELSE '低' END AS authority_level,
    c_custkey % 13 = 0 AS ap FROM customer WHERE c_custkey % 4 <> 1),
  b AS (SELECT o.id AS oid, i.id AS iid, {higher} AS hi, o.organizer AS oo, i.organizer AS io, o.summary AS os, i.summary AS ins, o.authority_level AS oa, i.authority_level AS ia, o.ap AS oap, i.ap AS iap FROM o FULL JOIN i ON o.id = i.id)
  SELECT coalesce(oid, iid) AS event_id, CASE WHEN oid IS NULL THEN io WHEN iid IS NOT NULL AND (hi OR oo IS NULL) THEN io ELSE oo END AS organizer,
   CASE WHEN oid IS NULL THEN ins WHEN iid IS NOT NULL AND ins <> 'null' AND hi THEN ins ELSE os END AS summary,
   CASE WHEN oid IS NULL THEN ia WHEN iid IS NOT NULL AND hi THEN ia ELSE oa END AS authority_level,
   CASE WHEN oid IS NULL OR (hi AND iap IS NOT NULL) THEN iap ELSE coalesce(oap, iap) END AS is_ministry_approved FROM b"""
_RANK = "CASE {0} WHEN '高' THEN 3 WHEN '中' THEN 2 ELSE 1 END"
_BOTH = f"coalesce((i.ap::INT * 10 + {_RANK.format('i.authority_level')}) > (o.ap::INT * 10 + {_RANK.format('o.authority_level')}), false)"


@query(_VERSIONS.format(higher=_BOTH))
def m1_merge_by_priority(spark, sf):
    return M.merge_by_priority(*versions(spark, sf), "event_id", _FIELDS)


@query(_VERSIONS.format(higher="coalesce(i.ap AND NOT o.ap, false)"))
def m2_merge_approved_only(spark, sf):
    return M.merge_by_priority(*versions(spark, sf), "event_id", _FIELDS, approved_only=True)


def _merged(o, i):
    """SQL of o merged with i, both (id, organizer, summary, authority_level, ap)."""
    good = lambda c: f"({c} IS NOT NULL AND {c} NOT IN ('', 'null'))"
    level = lambda t: f"(coalesce({t}.ap, false)::INT * 10 + coalesce({_RANK.format(t + '.authority_level')}, 0))"
    up = f"coalesce({level('i')} > {level('o')}, false)"
    value = lambda c: f"CASE WHEN o.id IS NULL THEN i.{c} WHEN i.id IS NOT NULL AND {good('i.' + c)} AND ({up} OR NOT {good('o.' + c)}) THEN i.{c} ELSE o.{c} END AS {c}"
    ap = f"CASE WHEN o.id IS NULL OR (i.id IS NOT NULL AND {up} AND i.ap IS NOT NULL) THEN i.ap ELSE coalesce(o.ap, i.ap) END AS ap"
    return f"SELECT coalesce(o.id, i.id) AS id, {', '.join(map(value, _FIELDS))}, {ap} FROM {o} o FULL JOIN {i} i ON o.id = i.id"


_OLD, _NEW = re.search(r"o AS \((.*?)\),\n", _VERSIONS, re.S)[1], re.search(r"i AS \((.*?)\),\n", _VERSIONS, re.S)[1]


@query(f"""WITH o AS ({_OLD}), i AS ({_NEW}), j AS (SELECT id, 'second' AS organizer, summary, '高' AS authority_level, ap FROM i), m AS ({_merged('o', 'i')}), n AS ({_merged('m', 'j')})
  SELECT id AS event_id, organizer, summary, authority_level, ap AS is_ministry_approved FROM n""")
def m1_fold_several(spark, sf):
    old, new = versions(spark, sf)
    twice = new.withColumn("seq", F.lit(1)).unionByName(new.withColumn("organizer", F.lit("second")).withColumn("authority_level", F.lit("高")).withColumn("seq", F.lit(2)))
    return M.fold(old, twice, "event_id", _FIELDS)


@query("""WITH c AS (SELECT event_id AS id, event_id % 3 AS ra, event_id % 4 AS rb, user_id AS u, event_type AS t, event_id % 5 AS k FROM events),
  s AS (SELECT id, t, u, k, ra + 1 AS a, CASE WHEN rb = 3 THEN 0 ELSE rb + 1 END AS b FROM c)
  SELECT id, CASE WHEN k = 1 THEN 'a' || u WHEN b >= a OR k = 0 THEN 'b' || u ELSE 'a' || u END AS signup_deadline, CASE WHEN b >= a THEN 'y' ELSE 'x' END AS event_start,
    'only b' AS event_end, CASE WHEN b >= a THEN t ELSE 'open' END AS registration_status, CASE WHEN k = 2 THEN t ELSE 'own' END AS organizer, 'a,' || t AS tags, 'y' AS src FROM s""")
def m3_merge_candidates(spark, sf):
    u, k, blank = F.col("user_id").cast("string"), F.col("event_id") % 5, F.lit("")

    def side(deadline, start, end, status, organizer, authority, tags, src):
        values = (deadline, start, end, status, organizer, blank, blank, authority)
        names = ("signup_deadline", "event_start", "event_end", "registration_status", "organizer", "location", "mode", "source_authority")
        return F.struct(F.lit("t").alias("title"), *[v.alias(n) for v, n in zip(values, names)], tags.alias("tags"), F.create_map(F.lit("src"), F.lit(src)).alias("evidence"))

    rank = lambda n: F.element_at(F.array(*map(F.lit, ["low", "medium", "high", ""])), (F.col("event_id") % n + 1).cast("int"))
    a = side(F.when(k != 0, F.concat(F.lit("a"), u)), F.lit("x"), blank, F.lit("open"), F.when(k == 2, "").otherwise("own"), rank(3), F.array(F.lit("a")), "x")
    b = side(F.when(k == 1, "").otherwise(F.concat(F.lit("b"), u)), F.lit("y"), F.lit("only b"), F.col("event_type"), F.col("event_type"), rank(4), F.array(F.lit("a"), F.col("event_type")), "y")
    got = M.merge_candidates(table(spark, sf, "events").select(F.col("event_id").alias("id"), a.alias("a"), b.alias("b")))
    return got.select("id", *M.RANKED, "organizer", F.array_join("tags", ",").alias("tags"), F.element_at("evidence", "src").alias("src"))


@query("""WITH o AS (SELECT p_name, min(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END) AS b FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), i AS (SELECT p_name, min(p_type) AS b FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1)
  SELECT coalesce(o.p_name, i.p_name) AS p_name, CASE WHEN o.b IS NULL OR o.b IN ('', '中') THEN coalesce(nullif(i.b, ''), o.b) ELSE o.b END AS brand, o.p_name IS NULL AS created FROM o FULL JOIN i ON o.p_name = i.p_name""")
def m4_upsert_catalog(spark, sf):
    p = table(spark, sf, "part")
    old = p.filter("p_partkey % 2 = 0").groupBy("p_name").agg(F.min(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand"))).alias("brand"))
    new = p.filter("p_partkey % 5 <> 0").groupBy("p_name").agg(F.min("p_type").alias("brand"))
    return M.fill_if_empty(old, new, "p_name", ["brand"])


def upsert_editions(editions, incoming, now):
    """Title replaced, valid incoming times win and missing ones never erase, start before deadline cleared, state recomputed."""
    e, i = editions.alias("e"), incoming.alias("i")
    both = e.join(i, F.col("e.event_id") == F.col("i.event_id"), "full")
    deadline, start = F.coalesce("i.deadline", "e.deadline"), F.coalesce("i.start", "e.start")
    return both.select(
        F.coalesce("e.event_id", "i.event_id").alias("event_id"), F.coalesce("i.title", "e.title").alias("title"), deadline.alias("deadline"),
        F.when(start < deadline, None).otherwise(start).alias("start"), T.status_of(deadline, now).alias("status"), F.col("e.event_id").isNull().alias("created"),
    )


@query(f"""WITH o AS (SELECT * FROM {EVENTS_SQL} WHERE event_id % 3 <> 0), i AS (SELECT event_id, 'new' AS title, CASE WHEN event_id % 2 = 0 THEN deadline + INTERVAL 40 DAY END AS deadline, NULL::TIMESTAMP AS start FROM {EVENTS_SQL} WHERE event_id % 4 <> 0)
  SELECT event_id, title, strftime(d, '%Y-%m-%d') AS deadline, strftime(CASE WHEN s < d THEN NULL ELSE s END, '%Y-%m-%d') AS start, created FROM
  (SELECT coalesce(o.event_id, i.event_id) AS event_id, coalesce(i.title, o.title) AS title, coalesce(i.deadline, o.deadline) AS d, coalesce(i.start, o.start) AS s, o.event_id IS NULL AS created FROM o FULL JOIN i ON o.event_id = i.event_id)""")
def m5_upsert_editions(spark, sf):
    e = as_events(spark, sf)
    new = e.filter("event_id % 4 <> 0").select("event_id", F.lit("new").alias("title"), F.when(F.col("event_id") % 2 == 0, F.col("deadline") + F.expr("INTERVAL 40 DAY")).alias("deadline"), F.lit(None).cast("timestamp").alias("start"))
    got = upsert_editions(e.filter("event_id % 3 <> 0"), new, F.lit(NOW).cast("timestamp"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return got.select("event_id", "title", day("deadline"), day("start"), "created")


@query("""SELECT event_id, f AS field_name, v AS field_value, 'u' AS source_url FROM (SELECT c_custkey AS event_id, unnest(['organizer', 'summary']) AS f, unnest([c_name, CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_mktsegment END]) AS v FROM customer)
  WHERE v <> 'none' AND NOT (f = 'organizer' AND event_id % 2 = 0)""")
def m6_record_evidence(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("event_id"), F.lit("u").alias("source_url"), F.col("c_name").alias("organizer"), F.when(F.col("c_custkey") % 3 == 0, "none").otherwise(F.col("c_mktsegment")).alias("summary"))
    known = c.filter("event_id % 2 = 0").select("event_id", F.lit("organizer").alias("field_name"), F.col("organizer").alias("field_value"), "source_url")
    return M.record_evidence(c, known, ["organizer", "summary"])


_RAW = "CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN '培训' || o_custkey ELSE o_orderpriority || o_custkey END"
#: Raw events made of orders: titles with and without years, some blank or promotions.
_EVENT_TITLE = "CASE WHEN o_orderkey % 9 = 0 THEN ' ' WHEN o_orderkey % 9 = 1 THEN '培训' || o_custkey ELSE {year} || o_orderpriority || o_custkey % 50 || '大赛' END"
_EVENT_TITLE = _EVENT_TITLE.format(year="(2020 + o_custkey % 5) || '年'")


def raw_events(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    day = lambda n: (F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAY")).cast("timestamp")
    return o.select(
        k.alias("seq"), F.expr(_EVENT_TITLE).alias("title"), F.concat(F.lit("https://x.org/"), (k % 97).cast("string")).alias("url"),
        F.when(k % 3 != 0, F.col("o_orderstatus")).otherwise("").alias("organizer"), F.lit("其他").alias("category"), F.when(k % 2 == 0, "国家级").alias("contest_level"),
        F.when(k % 5 == 0, "高").otherwise("中").alias("authority_level"), F.when(k % 11 == 0, "教育部竞赛目录").otherwise("web").alias("source_name"),
        F.when(k % 4 != 0, day(90)).alias("deadline"), F.when(k % 5 != 0, day(120)).alias("event_time"), F.when(k % 7 == 0, F.concat(F.lit("sum "), k)).otherwise("").alias("summary"),
    )


_GOOD = f"""(SELECT o_orderkey AS seq, {_EVENT_TITLE} AS title, replace(o_orderpriority, ' ', '') || o_custkey % 50 || '大赛' AS k, 2020 + o_custkey % 5 AS y, o_orderkey % 97 AS u, *
  FROM orders WHERE o_orderkey % 9 > 1)"""


def merged_events(spark, sf):
    """The tables after two batches, of which the second repeats rows of the first."""
    from concord.operators import upsert as U

    raw, now = raw_events(spark, sf), F.lit(NOW).cast("timestamp")
    one = U.merge_events(raw.filter("seq % 3 <> 2"), *[spark.createDataFrame([], s) for s in (U.CATALOG, U.EDITIONS, U.EVIDENCE)], now)
    dedup.shared_folder(spark)
    return U.merge_events(raw.filter("seq % 3 <> 1"), *[one[n].checkpoint() for n in ("catalog", "editions", "evidence")], now)


@query(f"""WITH g AS {_GOOD}, a AS (SELECT k, y FROM g WHERE seq % 3 <> 2 GROUP BY ALL), b AS (SELECT k, y, min(seq) AS f FROM g WHERE seq % 3 <> 1 GROUP BY ALL)
  SELECT action, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL AND seq = f THEN 'added' ELSE 'updated' END AS action FROM g LEFT JOIN a ON g.k = a.k AND g.y = a.y JOIN b ON g.k = b.k AND g.y = b.y WHERE seq % 3 <> 1
  UNION ALL SELECT CASE o_orderkey % 9 WHEN 0 THEN 'skipped_invalid' ELSE 'skipped_ad' END FROM orders WHERE o_orderkey % 9 < 2 AND o_orderkey % 3 <> 1) GROUP BY 1""")
def m7_sync_events(spark, sf):
    return merged_events(spark, sf)["actions"].groupBy("action").agg(F.count("*").alias("n"))


_MERGED = f"""WITH r AS (SELECT *, 0 AS batch FROM {_GOOD} WHERE seq % 3 <> 2 UNION ALL SELECT *, 1 FROM {_GOOD} WHERE seq % 3 <> 1), g AS (SELECT *, batch * 1000000000000 + seq AS o FROM r)"""


@query(f"""{_MERGED}, m AS (SELECT k, y, arg_max(title, o) AS title, arg_max(o_orderdate + INTERVAL 90 DAY, o) FILTER (seq % 4 <> 0) AS d, arg_max(o_orderdate + INTERVAL 120 DAY, o) FILTER (seq % 5 <> 0) AS e,
    arg_min('sum ' || seq, o) FILTER (seq % 7 = 0) AS summary FROM g GROUP BY k, y),
  one AS (SELECT k, y, arg_max(o_orderdate + INTERVAL 90 DAY, o) FILTER (seq % 4 <> 0) AS d, arg_max(o_orderdate + INTERVAL 120 DAY, o) FILTER (seq % 5 <> 0) AS e FROM g WHERE batch = 0 GROUP BY k, y),
  two AS (SELECT k, y, arg_max(o_orderdate + INTERVAL 120 DAY, o) FILTER (seq % 5 <> 0) AS e FROM g WHERE batch = 1 GROUP BY k, y)
  SELECT m.k AS catalog_key, CAST(m.y AS INT) AS year, title, strftime(m.d, '%Y-%m-%d') AS deadline,
    strftime(CASE WHEN coalesce(two.e, CASE WHEN one.e < one.d THEN NULL ELSE one.e END) < m.d THEN NULL ELSE coalesce(two.e, CASE WHEN one.e < one.d THEN NULL ELSE one.e END) END, '%Y-%m-%d') AS event_time, summary
  FROM m LEFT JOIN one ON m.k = one.k AND m.y = one.y LEFT JOIN two ON m.k = two.k AND m.y = two.y""")
def m7_editions(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return merged_events(spark, sf)["editions"].select("catalog_key", "year", "title", day("deadline"), day("event_time"), "summary")


@query(f"""{_MERGED} SELECT k AS catalog_key, coalesce(arg_min(o_orderstatus, o) FILTER (seq % 3 <> 0), '') AS organizer, CASE WHEN count_if(seq % 2 = 0) > 0 THEN '国家级' ELSE '' END AS contest_level,
  CASE WHEN count_if(seq % 5 = 0) > 0 THEN '高' ELSE '中' END AS authority_level, arg_min(seq % 11 = 0, o) AS approved FROM g GROUP BY k""")
def m7_catalog(spark, sf):
    return merged_events(spark, sf)["catalog"].select("catalog_key", "organizer", "contest_level", "authority_level", F.col("is_ministry_approved").alias("approved"))


@query(f"""WITH g AS {_GOOD}, v AS (SELECT k, y, u, unnest(['deadline', 'event_time', 'summary', 'organizer', 'contest_level', 'source_url']) AS f, unnest([CASE WHEN seq % 4 <> 0 THEN strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') END,
  CASE WHEN seq % 5 <> 0 THEN strftime(o_orderdate + INTERVAL 120 DAY, '%Y-%m-%d') END, CASE WHEN seq % 7 = 0 THEN 'sum ' || seq END, CASE WHEN seq % 3 <> 0 THEN o_orderstatus END, CASE WHEN seq % 2 = 0 THEN '国家级' END, 'https://x.org/' || u]) AS x FROM g)
  SELECT f AS field_name, count(*) AS n FROM (SELECT DISTINCT * FROM v WHERE x IS NOT NULL) GROUP BY f""")
def m7_evidence(spark, sf):
    return merged_events(spark, sf)["evidence"].groupBy("field_name").agg(F.count("*").alias("n"))


#: Undated and dated titles of few catalogs, every third URL blank.
_LOOSE = "CASE WHEN o_orderkey % 4 = 0 THEN (2024 + o_orderkey % 3) || '年' ELSE '' END || o_custkey % 20 || '号' || o_orderstatus || '杯大赛'"
_LOOSE_URL = "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'https://x.org/' || o_custkey % 7 END"


@query(f"""WITH g AS (SELECT o_orderkey AS seq, {_LOOSE} AS title, nullif({_LOOSE_URL}, '') AS url, o_custkey % 20 || '号' || o_orderstatus || '杯大赛' AS k, CASE WHEN o_orderkey % 4 = 0 THEN 2024 + o_orderkey % 3 END AS y FROM orders),
  f AS (SELECT k, y, arg_min(title, seq) AS t, min(seq) AS s FROM g WHERE y IS NOT NULL GROUP BY k, y), d AS (SELECT f.*, g.url AS u FROM f JOIN g ON g.seq = f.s),
  du AS (SELECT k, u, arg_min(y, s) AS y FROM d WHERE u IS NOT NULL GROUP BY k, u),
  n AS (SELECT g.seq, g.k, g.title, coalesce(g.y, du.y) AS y, CASE WHEN g.y IS NULL AND du.y IS NULL THEN coalesce(g.url, g.title) END AS p FROM g LEFT JOIN du ON g.y IS NULL AND du.k = g.k AND du.u = g.url)
  SELECT k AS catalog_key, arg_max(title, seq) AS title, count(*) AS n FROM n GROUP BY k, y, p""")
def m7_blank_urls(spark, sf):
    from concord.operators import upsert as U

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.expr(_LOOSE).alias("title"), F.expr(_LOOSE_URL).alias("url"))
    raw = o.select("*", *[F.lit("").alias(c) for c in ("organizer", "category", "contest_level", "authority_level", "source_name", "summary")], *[F.lit(None).cast("timestamp").alias(c) for c in ("deadline", "event_time")])
    merged = U.merge_events(raw, *[spark.createDataFrame([], s) for s in (U.CATALOG, U.EDITIONS, U.EVIDENCE)], F.lit(NOW).cast("timestamp"))
    return merged["editions"].select("event_id", "catalog_key", "title").join(merged["actions"].groupBy("event_id").agg(F.count("*").alias("n")), "event_id").drop("event_id")


def observations(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("domain"), F.lit("level").alias("field"), F.floor(F.col("value") / 60).cast("string").alias("value"))


_CONSENSUS = """(WITH f AS (SELECT user_id AS e, event_type AS d, arg_min(CAST(floor(value / 60) AS BIGINT), event_id) AS v, min(event_id) AS s FROM events GROUP BY 1, 2),
  c AS (SELECT e, v, count(*) AS n, min(s) AS s FROM f GROUP BY 1, 2), t AS (SELECT e, count(*) AS m FROM f GROUP BY 1)
  SELECT c.e AS entity_id, CAST(c.v AS VARCHAR) AS value, n AS n_agree, m AS n_domains FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY n DESC, s) AS k FROM c) c JOIN t ON c.e = t.e WHERE k = 1 AND n >= 2 AND m >= 2)"""


@query(f"SELECT * FROM {_CONSENSUS}")
def a1_consensus(spark, sf):
    return M.consensus(observations(spark, sf)).select("entity_id", "value", "n_agree", "n_domains")


@query(f"SELECT DISTINCT e.user_id, coalesce(c.value, 'unknown') AS level, c.value IS NOT NULL AS verified FROM events e LEFT JOIN {_CONSENSUS} c ON e.user_id = c.entity_id")
def m8_apply_verified(spark, sf):
    got = M.consensus(observations(spark, sf)).select(F.col("entity_id").alias("user_id"), "value")
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.join(got, "user_id", "left").select("user_id", F.coalesce("value", F.lit("unknown")).alias("level"), F.col("value").isNotNull().alias("verified"))


_FIRST_SAID = """(SELECT user_id AS e, event_type AS d, min(event_id) AS s, arg_min(CAST(floor(value / 60) AS BIGINT), event_id) AS v FROM events GROUP BY 1, 2)"""


@query(f"""WITH f AS {_FIRST_SAID}, c AS (SELECT e, v, count(*) AS n, min(s) AS s FROM f GROUP BY 1, 2),
  t AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY n DESC, s) AS k FROM c), m AS (SELECT e, count(*) AS n_domains FROM f GROUP BY 1)
  SELECT t.e AS entity_id, CAST(t.v AS VARCHAR) AS value, t.n AS n_agree, m.n_domains, t.n >= 2 AND m.n_domains >= 2 AS accepted,
    (SELECT string_agg(f.d || '=' || f.v, ';' ORDER BY f.s) FROM f WHERE f.e = t.e) AS said FROM t JOIN m ON t.e = m.e WHERE k = 1""")
def a1_trace(spark, sf):
    rows = observations(spark, sf).withColumn("source_url", F.col("domain"))
    said = F.array_join(F.transform("sources", lambda s: F.concat(s["domain"], F.lit("="), s["value"])), ";")
    return V.consensus_trace(rows).select("entity_id", "value", F.col("n_agree").cast("long").alias("n_agree"), "n_domains", "accepted", said.alias("said"))


@query(f"""WITH f AS {_FIRST_SAID}, c AS (SELECT e, v, count(*) AS n, min(s) AS s FROM f GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY n DESC, s) AS k FROM c)
  SELECT f.e AS entity_id, 'level' AS field_name, CAST(f.v AS VARCHAR) AS field_value, f.d AS source_url, 'cross_verify' AS extraction_method, 'high' AS confidence, 'verified' AS verification_status
  FROM t JOIN f ON f.e = t.e AND f.v = t.v WHERE k = 1 AND n >= 2 AND t.e % 3 <> 0""")
def m8_evidence(spark, sf):
    rows = observations(spark, sf).withColumn("source_url", F.col("domain"))
    users = rows.select("entity_id").distinct().select("entity_id", F.when(F.col("entity_id") % 3 == 0, "own").alias("level"), F.lit("pending_review").alias("verification_status"))
    return V.apply_verified(users, V.consensus_trace(rows), ["level"], F.lit(NOW).cast("timestamp"))[1].drop("fetched_at")


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'cs' ELSE c_mktsegment END AS major, 'none' AS notify FROM customer")
def m9_upsert_profiles(spark, sf):
    c = table(spark, sf, "customer")
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("major"))
    new = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, "cs").when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).alias("major"))
    both = old.alias("o").join(new.alias("n"), "user_id", "full")
    return both.select("user_id", F.coalesce("n.major", "o.major").alias("major"), F.lit("none").alias("notify"))


@query("SELECT user_id, CASE WHEN count_if(event_type = 'purchase') > 0 THEN 'bought' ELSE '' END AS focus FROM events GROUP BY 1")
def m10_follow_changes(spark, sf):
    e = table(spark, sf, "events")
    profiles = e.select("user_id").distinct().withColumn("focus", F.array(F.lit("old")))
    ops = e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "add").otherwise("remove").alias("op"), F.when(F.col("event_type") == "purchase", "bought").otherwise("old").alias("item"))
    ops = ops.unionByName(e.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("seq"), F.lit("remove").alias("op"), F.lit("old").alias("item")))
    return M.apply_follow_changes(profiles, ops).select("user_id", F.array_join("focus", ",").alias("focus"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'parsed ' || page_id ELSE url END AS title FROM pages")
def m11_overlay_parsed(spark, sf):
    p = table(spark, sf, "pages")
    parsed = p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("parsed "), F.col("page_id").cast("string"))).otherwise("").alias("t"))
    return p.join(parsed, "page_id", "left").select("page_id", F.coalesce(F.nullif("t", F.lit("")), "url").alias("title"))


@query("SELECT p_name AS title, p_brand AS organizer, '' AS source_url, 'active' AS status FROM part")
def s1_catalog_json(spark, sf):
    path = shared_folder(spark)
    table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("organizer")).write.json(path)
    return IO.read_catalog_json(spark, path, multi_line=False).select("title", "organizer", "source_url", "status")


@query("SELECT 'p' || page_id AS title, url, 'unknown' AS source_name FROM pages")
def s2_contest_records(spark, sf):
    path = shared_folder(spark)
    table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("source_url")).write.json(path)
    return IO.read_contest_records(spark, path, multi_line=False)


@query("SELECT page_id, CASE WHEN contains(url, '.org') THEN 'medium' ELSE 'low' END AS authority FROM pages")
def s3_source_config(spark, sf):
    rules = spark.createDataFrame([(".org", "medium")], "mark string, authority string")
    p = table(spark, sf, "pages")
    return p.join(F.broadcast(rules), F.col("url").contains(F.col("mark")), "left").select("page_id", F.coalesce("authority", F.lit("low")).alias("authority"))


@query("SELECT page_id, substr(html, 1, 8192) AS html FROM pages WHERE strlen(html) <= 2097152")
def s4_read_pages(spark, sf):
    return IO.read_pages(table(spark, sf, "pages")).select("page_id", "html")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def s5_table_store(spark, sf):
    store, n = IO.TableStore(spark, shared_folder(spark)), table(spark, sf, "nation").select("n_nationkey", "n_name")
    store.overwrite("nation", n)
    store.overwrite("nation", store.read("nation").filter("n_nationkey % 2 = 1"))
    return store.read("nation")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s7_report(spark, sf):
    path = shared_folder(spark)
    e = table(spark, sf, "events").select("event_id", F.lit("all").alias("source"), "event_type")
    IO.write_report(e, {}, path, "source", "event_type", "event_id")
    return spark.read.schema("event_type string, n long").json(f"{path}/funnel")


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE url END AS url FROM pages")
def s8_export_ranked(spark, sf):
    return IO.export_columns(table(spark, sf, "pages").withColumn("url", F.when(F.col("page_id") % 2 == 1, F.col("url"))), ["page_id", "url"])


@query("SELECT page_id, '2026-07-21' AS run_date FROM pages")
def s9_snapshot(spark, sf):
    path = shared_folder(spark)
    IO.write_snapshot(table(spark, sf, "pages"), path, F.lit("2026-07-21"))
    return spark.read.parquet(path).select("page_id", F.col("run_date").cast("string").alias("run_date"))


@query("SELECT url, min(page_id % 2) = 0 AS seeded FROM pages GROUP BY url")
def s10_append_new(spark, sf):
    p = table(spark, sf, "pages")
    seed = p.filter("page_id % 2 = 0").select("url").distinct().withColumn("seeded", F.lit(True))
    return IO.append_new(seed, p.filter("page_id % 2 = 1").select("url").withColumn("seeded", F.lit(False)), "url")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def x5_stream_sync(spark, sf):
    path = shared_folder(spark)
    table(spark, sf, "events").select("event_id", "user_id").repartition(4, "user_id").sortWithinPartitions("event_id").write.parquet(f"{path}/in")
    final = BucketTable(spark, f"{path}/final", "user_id", "event_id")
    for _ in range(2):  # the second run finds nothing new
        run_stream_sync(IO.stream_raw_events(spark, f"{path}/in", "event_id long, user_id long"), final, f"{path}/checkpoint")
    return final.read().select("user_id", "event_id")


def arrivals(spark, sf):
    """events as rows of accounts that arrive in three batches, out of order; an id comes several times."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    key = F.concat_ws("-", "event_type", (F.col("event_id") % 37).cast("string"))
    batch = F.when(F.col("event_id") % 10 == 0, F.lit(2)).otherwise((F.dayofmonth("ts") > 12).cast("int"))
    return e.select("event_id", "user_id", key.alias("key"), F.when(F.col("event_id") % 23 != 0, F.col("ts")).alias("ts"), batch.alias("batch"))


_ARRIVALS = """(SELECT event_id, user_id, event_type || '-' || event_id % 37 AS key, CASE WHEN event_id % 23 <> 0 THEN ts END AS ts, CASE WHEN event_id % 10 = 0 THEN 2 ELSE CAST(day(ts) > 12 AS INT) END AS batch FROM events)"""


@query(f"""WITH a AS (SELECT * FROM {_ARRIVALS}), m AS (SELECT user_id, batch, max(ts) AS t FROM a GROUP BY ALL),
  c AS (SELECT a.*, (SELECT max(t) FROM m WHERE m.user_id = a.user_id AND m.batch < a.batch) AS newest FROM a),
  r AS (SELECT *, CASE WHEN ts IS NULL THEN 'undated' WHEN ts < newest - INTERVAL 24 HOUR THEN 'late' END AS gone FROM c),
  n AS (SELECT event_id, gone, row_number() OVER (PARTITION BY user_id, key, gone IS NULL ORDER BY batch, ts, event_id) AS k FROM r)
  SELECT event_id, coalesce(gone, CASE WHEN k = 1 THEN 'take' ELSE 'known' END) AS route FROM n""")
def x2_stream_routes(spark, sf):
    """Three batches, each by a query of its own that starts from the checkpoint of the one before."""
    path, rows = shared_folder(spark), arrivals(spark, sf)
    for k in range(3):
        rows.filter(F.col("batch") == k).drop("batch").repartition(2).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("event_id long, user_id long, key string, ts timestamp").parquet(f"{path}/in")
        routed = route_stream(stream, "user_id", "key", "ts", order="event_id")
        sink = routed.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "route")


@query("SELECT event_id FROM events WHERE ts >= least(TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-10' - INTERVAL 24 HOUR ELSE TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR END)")
def x1_incremental_intake(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cursors = e.filter("user_id % 2 = 0").select("user_id").distinct().withColumn("last_at", F.lit("2024-01-10").cast("timestamp"))
    return S.incremental_intake(e, cursors, "ts", "user_id", F.lit("2024-01-20").cast("timestamp"), 48).select("event_id")


@query("SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0")
def x2_drop_processed(spark, sf):
    e = table(spark, sf, "events").select("user_id")
    return S.drop_processed(e, e.filter("user_id % 3 = 0").distinct(), "user_id")


@query("SELECT user_id AS key, 'fetch' AS stage, CAST(CASE WHEN user_id % 2 = 0 THEN 2 ELSE 0 END + 1 AS INT) AS attempts FROM (SELECT DISTINCT user_id FROM events)")
def x3_failures(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.lit("fetch").alias("stage")).distinct()
    at = F.lit("2026-01-01").cast("timestamp")
    old = users.filter("key % 2 = 0").select("key", "stage", F.lit(2).alias("attempts"), at.alias("first_seen_at"), at.alias("last_seen_at"))
    return S.upsert_failures(old, users, at).select("key", "stage", "attempts")


@query("SELECT user_id AS key, count_if(event_type = 'purchase') > 0 AS done FROM events GROUP BY 1")
def x4_acknowledge(spark, sf):
    e, at = table(spark, sf, "events"), F.lit("2026-01-01").cast("timestamp")
    actions = e.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "purchase", "added").otherwise("error").alias("action"))
    keys = actions.select("key").distinct()
    processed, failures = S.acknowledge(actions, keys.limit(0).withColumn("processed_at", at), keys, at)
    return processed.select("key", F.lit(True).alias("done")).unionByName(failures.select("key", F.lit(False).alias("done")))


@query("SELECT CASE WHEN event_id % 10 = 0 THEN 'undated' WHEN ts < TIMESTAMP '2024-01-15' THEN 'late' ELSE 'take' END AS route, count(*) AS n FROM events GROUP BY 1")
def x6_route_by_time(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp")))
    return S.route_by_time(e, "at", F.lit("2024-01-15").cast("timestamp")).groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events")
def s6_stream_source(spark, sf):
    path = shared_folder(spark)
    table(spark, sf, "events").select("event_id", "user_id").write.parquet(f"{path}/in")
    stream = IO.stream_raw_events(spark, f"{path}/in", "event_id long, user_id long")
    sink = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")

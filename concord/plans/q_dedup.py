"""Queries of joins, matching, de-duplication and set operations."""

from __future__ import annotations


from pyspark.sql import functions as F


from concord.operators import dedup as D
from concord.operators import match as M
from concord.plans.q_text import EVENTS_SQL, as_events
from concord.plans.register import query, table


@query(f"SELECT event_id, title, c_name AS owner_name FROM {EVENTS_SQL} JOIN customer ON owner = c_custkey")
def j1_event_view(spark, sf):
    catalog = table(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("owner_name"))
    return as_events(spark, sf).join(catalog, "owner").select("event_id", "title", "owner_name")


def names(spark, sf, left):
    """Distinct part names with a seq; the left ones with an edit in their middle."""
    d = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("seq"))
    key = F.concat(F.substring("p_name", 1, 4), F.lit("x"), F.substr("p_name", F.lit(5))) if left else F.col("p_name")
    return d.select("seq", key.alias("key"))


_NAMES = "(SELECT min(p_partkey) AS seq, p_name AS key FROM part GROUP BY p_name)"
_LEFT = "(SELECT min(p_partkey) AS seq, substr(p_name, 1, 4) || 'x' || substr(p_name, 5) AS key FROM part GROUP BY p_name)"
_SIM = "(1.0 - levenshtein(l.key, r.key) / greatest(length(l.key), length(r.key)))"


@query(f"SELECT l_seq, r_seq FROM (SELECT l.seq AS l_seq, r.seq AS r_seq, row_number() OVER (PARTITION BY l.seq ORDER BY {_SIM} DESC, r.seq) AS n FROM {_LEFT} l JOIN {_NAMES} r ON {_SIM} >= 0.85) WHERE n = 1")
def j2_fuzzy_best(spark, sf):
    return M.fuzzy_match(names(spark, sf, True), names(spark, sf, False), "key").select("l_seq", "r_seq")


@query(f"SELECT l.seq AS l_seq, min(r.seq) AS r_seq FROM {_LEFT} l JOIN {_NAMES} r ON {_SIM} >= 0.7 GROUP BY l.seq")
def j3_fuzzy_first(spark, sf):
    return M.fuzzy_match(names(spark, sf, True), names(spark, sf, False), "key", 0.7, "first").select("l_seq", "r_seq")


_SHORT = "(SELECT min(p_partkey) AS seq, CASE WHEN min(p_partkey) % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS key FROM part GROUP BY p_name)"


@query(f"""SELECT l.seq AS l_seq, coalesce(min(r.seq) FILTER (WHERE r.key = l.key), min(r.seq)) AS r_seq, CASE WHEN count_if(r.key = l.key) > 0 THEN 'exact' ELSE 'contains' END AS how
  FROM {_SHORT} l JOIN {_NAMES} r ON contains(l.key, r.key) OR contains(r.key, l.key) GROUP BY l.seq""")
def j4_exact_then_contains(spark, sf):
    left = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("seq"))
    left = left.select("seq", F.when(F.col("seq") % 2 == 0, F.col("p_name")).otherwise(F.substring_index("p_name", " ", 1)).alias("key"))
    return M.exact_then_contains(left, names(spark, sf, False), "key")


@query("""SELECT p_partkey, a = b OR contains(a, b) OR contains(b, a) OR list_unique(list_intersect(string_split(a, ''), string_split(b, ''))) / greatest(list_unique(string_split(a, '')), list_unique(string_split(b, ''))) > 0.7 AS similar
  FROM (SELECT p_partkey, p_name AS a, p_type || p_name[1:3] AS b FROM part)""")
def j5_charset_match(spark, sf):
    pairs = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat("p_type", F.substring("p_name", 1, 3)).alias("b"))
    return M.charset_match(pairs, "a", "b").select("p_partkey", "similar")


_ED = "(SELECT o_orderkey AS event_id, o_custkey AS ck, year(o_orderdate) AS y, o_orderpriority AS u, o_orderkey AS seq FROM orders WHERE o_orderkey % 2 = 0)"
_IN = "(SELECT o_orderkey AS seq, o_custkey AS ck, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE year(o_orderdate) END AS y, o_orderpriority AS u FROM orders WHERE o_orderkey % 2 = 1)"


@query(f"""SELECT i.seq, coalesce(a.e, b.e) AS event_id, CASE WHEN a.e IS NOT NULL THEN 'year' WHEN b.e IS NOT NULL THEN 'url' ELSE 'new' END AS how FROM {_IN} i
  LEFT JOIN (SELECT ck, y, min(event_id) AS e FROM {_ED} GROUP BY 1, 2) a ON i.ck = a.ck AND i.y = a.y LEFT JOIN (SELECT ck, u, min(event_id) AS e FROM {_ED} GROUP BY 1, 2) b ON i.ck = b.ck AND i.u = b.u""")
def j6_resolve_editions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("catalog_key"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("url"), F.col("o_orderkey").cast("string").alias("title"))
    incoming = o.filter("seq % 2 = 1").withColumn("year", F.when(F.col("seq") % 5 != 0, F.col("year")))
    return M.resolve_editions(incoming, o.filter("seq % 2 = 0").withColumn("event_id", F.col("seq"))).select("seq", "event_id", "how")


@query("""SELECT event_id FROM events WHERE user_id || '-' || strftime(ts, '%Y-%m-%d') NOT IN
  (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'purchase')""")
def j7_drop_processed(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    return D.drop_processed(e, "k", e.filter("event_type = 'purchase'")).select("event_id")


@query("SELECT s_suppkey, min(page_id) AS page_id FROM supplier JOIN (SELECT page_id, lower(url) AS u FROM pages) ON contains(u, CAST(s_suppkey AS VARCHAR)) GROUP BY 1")
def j8_names_to_hosts(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("k"))
    p = table(spark, sf, "pages").select("page_id", F.lower("url").alias("u"))
    digits = p.select("page_id", F.explode(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("u", F.lit(r"(\d+)"), 1), _runs)))).alias("k"))
    return s.join(digits, "k").groupBy("s_suppkey").agg(F.min("page_id").alias("page_id"))


def _runs(x):
    """All substrings of a run of digits: what it contains, as keys for an equality join."""
    starts = F.sequence(F.lit(1), F.length(x))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length(x) - i + 1), lambda n: F.substring(x, i, n))))


@query("""SELECT c_custkey, count(*) AS n, sum(p_size) AS days FROM customer, part
  WHERE p_size >= 0 AND p_name IS NOT NULL GROUP BY 1""")
def j9_profile_pairs(spark, sf):
    """Every profile meets every event, so that the totals of its pairs are those of all events, taken once, for each of its rows."""
    profiles = table(spark, sf, "customer").groupBy("c_custkey").agg(F.count("*").alias("_rows"))
    events = table(spark, sf, "part").filter("p_size >= 0 and p_name is not null").agg(F.count("*").alias("n"), F.sum("p_size").alias("days"))
    pairs = profiles.crossJoin(F.broadcast(events.filter("n > 0")))  # one row, or none
    return pairs.select("c_custkey", (F.col("n") * F.col("_rows")).alias("n"), (F.col("days") * F.col("_rows")).alias("days"))


@query("SELECT user_id, count(*) AS n FROM (SELECT e.*, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-10' END AS cur FROM events e) WHERE ts >= least(TIMESTAMP '2024-01-15', coalesce(cur - INTERVAL 24 HOUR, TIMESTAMP '2024-01-15')) GROUP BY user_id")
def j10_apply_cursor(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cursors = e.filter("user_id % 2 = 0").select("user_id").distinct().withColumn("cur", F.lit("2024-01-10").cast("timestamp"))
    cut = F.lit("2024-01-15").cast("timestamp")
    return e.join(cursors, "user_id", "left").filter(F.col("ts") >= F.least(cut, F.coalesce(F.col("cur") - F.expr("INTERVAL 24 HOUR"), cut))).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"SELECT l.seq, arg_max('fixed ' || r.seq % 7, r.seq) AS fixed FROM {_SHORT} l JOIN {_NAMES} r ON contains(l.key, r.key) OR contains(r.key, l.key) GROUP BY 1")
def j11_propagate_urls(spark, sf):
    left = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("seq"))
    left = left.select("seq", F.when(F.col("seq") % 2 == 0, F.col("p_name")).otherwise(F.substring_index("p_name", " ", 1)).alias("key"))
    return M.propagate_urls(left, names(spark, sf, False).withColumn("fixed", F.concat(F.lit("fixed "), F.col("seq") % 7)), "key", "fixed")


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://fixed.example/' || page_id ELSE url END AS url FROM pages")
def j12_repair_urls(spark, sf):
    p = table(spark, sf, "pages")
    fixes = p.filter("page_id % 4 = 0").select("page_id", F.concat(F.lit("https://fixed.example/"), F.col("page_id").cast("string")).alias("fix"))
    return p.join(fixes, "page_id", "left").select("page_id", F.coalesce("fix", "url").alias("url"))


_PLAIN_HOST = "regexp_replace(lower(regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '^www\\.', '')), '[^a-z0-9]', '', 'g')"


@query(f"""WITH u AS (SELECT page_id, url, {_PLAIN_HOST} AS h FROM pages), n AS (SELECT page_id AS seq, regexp_replace(lower(substr(url, 9, 10 + page_id % 20)), '[^a-z0-9]', '', 'g') AS k FROM pages WHERE page_id % 3 = 0)
  SELECT seq, min(page_id) AS url_seq, arg_min(url, page_id) AS url FROM n JOIN u ON k <> '' AND h <> '' AND (contains(h, k) OR contains(k, h)) GROUP BY seq""")
def j8_first_hosts(spark, sf):
    p = table(spark, sf, "pages")
    name = F.upper(F.expr("substr(url, 9, 10 + page_id % 20)"))
    return M.match_names_to_hosts(p.filter("page_id % 3 = 0").select(F.col("page_id").alias("seq"), name.alias("name")), p.select(F.col("page_id").alias("seq"), "url"))


_TITLE = "substr(regexp_extract(html, '<title>([^<]*)', 1), 1, 40)"
_KEY = "lower(regexp_replace(regexp_replace({0}, '[\\s\\p{{Z}}　·・—―‐-]+', '', 'g'), '[（）()【】\\[\\]《》<>\"''“”‘’]', '', 'g'))"
_CORE = "regexp_replace({0}, '2026|2025|第[一二三四五六七八九十0-9]+届|全国|大学生', '', 'g')"
_SETS = "list_unique(list_intersect(string_split(a.k, ''), string_split(b.k, ''))) / greatest(list_unique(string_split(a.k, '')), list_unique(string_split(b.k, '')))"
#: Titles of pages and, as candidates, parts of those titles with years and the word for students.
_ASKED = f"(SELECT page_id AS seq, k, {_CORE.format('k')} AS c FROM (SELECT page_id, {_KEY.format(_TITLE)} AS k FROM pages))"
_OFFERED = f"(SELECT page_id AS seq, k, {_CORE.format('k')} AS c FROM (SELECT page_id, {_KEY.format(chr(39) + '2026年全国' + chr(39) + ' || substr(' + _TITLE + ', 1 + page_id % 3, 8 + page_id % 31)')} AS k FROM pages WHERE page_id % 2 = 0))"
_SCORED = f"""SELECT a.seq AS l_seq, b.seq AS r_seq, CASE WHEN a.k = b.k THEN 2.0 ELSE CASE WHEN contains(a.k, b.k) OR contains(b.k, a.k) THEN 0.8 ELSE {_SETS} END
  + CASE WHEN a.c <> '' AND b.c <> '' AND (contains(a.c, b.c) OR contains(b.c, a.c)) THEN 0.3 ELSE 0 END END AS score FROM {_ASKED} a, {_OFFERED} b WHERE a.k <> '' AND b.k <> ''"""
_BEST = f"(SELECT l_seq, r_seq, score FROM (SELECT *, row_number() OVER (PARTITION BY l_seq ORDER BY round(score, 9) DESC, r_seq) AS n FROM ({_SCORED}) WHERE score >= 0.5 - 1e-9) WHERE n = 1)"


def page_titles(spark, sf):
    title = F.substring(F.regexp_extract("html", "<title>([^<]*)", 1), 1, 40)
    asked = table(spark, sf, "pages").select("page_id", F.col("page_id").alias("seq"), "url", "html", title.alias("title"))
    offered = asked.filter("page_id % 2 = 0").select("seq", F.concat(F.lit("2026年全国"), F.expr("substr(title, 1 + page_id % 3, 8 + page_id % 31)")).alias("title"), F.concat(F.lit("https://fixed.example/"), "page_id").alias("url"))
    return asked, offered


@query(f"SELECT l_seq, r_seq, round(score, 6) AS score FROM {_BEST}")
def j5_best_titles(spark, sf):
    asked, offered = page_titles(spark, sf)
    return M.best_titles(asked, offered).withColumn("score", F.round("score", 6))


@query(f"""WITH e AS (SELECT page_id AS seq, url, CASE WHEN page_id % 4 <> 0 THEN 'x' ELSE 'y' END AS source_name, page_id % 4 <> 0 AND (contains(url, '/fr/') OR contains(html, 'track(1')) AS bad FROM pages)
  SELECT e.seq, CASE WHEN NOT bad THEN url WHEN r_seq IS NULL THEN '' ELSE 'https://fixed.example/' || r_seq END AS url, CASE WHEN NOT bad THEN 'kept' WHEN r_seq IS NULL THEN 'cleared' ELSE 'repaired' END AS how
  FROM e LEFT JOIN {_BEST} ON l_seq = e.seq""")
def j12_repair_pages(spark, sf):
    asked, offered = page_titles(spark, sf)
    events = asked.select("seq", "title", F.when(F.col("page_id") % 4 != 0, "x").otherwise("y").alias("source_name"), "url")
    return M.repair_urls(events, asked.select("url", "html"), offered, ["x"], [], "/fr/", ["track(1"]).select("seq", "url", "how")


_UK = "lower(regexp_extract(url, '^https?://([^?#]+)', 1))"


@query(f"""WITH a AS (SELECT page_id, k FROM (SELECT page_id, html, {_UK} AS k, row_number() OVER (PARTITION BY {_UK} ORDER BY page_id) AS n FROM pages) WHERE n = 1)
  SELECT page_id FROM (SELECT a.page_id, row_number() OVER (PARTITION BY length(html) ORDER BY a.page_id) AS n FROM a JOIN pages p ON a.page_id = p.page_id) WHERE n = 1""")
def d1_url_then_title(spark, sf):
    p = table(spark, sf, "pages")
    key = F.lower(F.regexp_extract("url", r"^https?://([^?#]+)", 1))
    return D.dedup_url_then_title(p, key, F.length("html").cast("string"), "page_id").select("page_id")


@query("SELECT event_type, count(*) - count(DISTINCT user_id || '|' || event_type) AS dropped FROM events GROUP BY 1 HAVING count(*) > count(DISTINCT user_id || '|' || event_type)")
def d2_by_identity(spark, sf):
    e = table(spark, sf, "events")
    kept = D.first_by(e, F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), "event_id")
    return D.with_dropped(e, kept, "event_type", "event_id")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id || '/' || event_id % 7 END AS pid, event_type || CAST(floor(value) AS BIGINT) AS title FROM events),
  a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY event_id) AS n FROM e) WHERE pid IS NULL OR n = 1)
  SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY title ORDER BY event_id) AS m FROM a) WHERE m = 1""")
def d3_cross_source(spark, sf):
    pid = F.when(F.col("event_id") % 3 != 0, F.concat("user_id", F.lit("/"), F.col("event_id") % 7))
    e = table(spark, sf, "events").withColumn("pid", pid)
    return D.dedup_cross_source(e, "pid", F.concat("event_type", F.floor("value")), "event_id").select("event_id")


@query(r"""SELECT doc_id FROM documents WHERE text IS NULL UNION ALL
  SELECT min(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY CASE WHEN text = '' THEN 'row ' || doc_id ELSE trim(regexp_replace(lower(text), '\s+', ' ', 'g')) END""")
def d4_greedy_or(spark, sf):
    """Equal texts have equal words, so that the words alone decide here; see d4_greedy_or_links for keys that cross."""
    words = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    digest = lambda c: F.when(F.col("text") != "", F.sha2(c, 256))
    d = table(spark, sf, "documents").select("doc_id", digest(F.col("text")).alias("u"), digest(words).alias("t"))
    return D.dedup_greedy_or(d, "u", "t", "doc_id").select("doc_id")


@query("""WITH RECURSIVE e AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber <> 3 THEN 's' || l_suppkey || '/' || l_orderkey % 40 END AS u,
    CASE WHEN l_linenumber <> 5 THEN 'p' || l_partkey END AS t FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
  r AS (SELECT seq, u, t, false AS kept FROM e
    UNION ALL SELECT seq, u, t, own FROM (SELECT *, u IS NOT NULL AND bool_or(own) OVER (PARTITION BY u) OR t IS NOT NULL AND bool_or(own) OVER (PARTITION BY t) AS hit FROM
      (SELECT *, (u IS NULL OR min(seq) OVER (PARTITION BY u) = seq) AND (t IS NULL OR min(seq) OVER (PARTITION BY t) = seq) AS own FROM r WHERE NOT kept)) WHERE own OR NOT hit)
  SELECT seq FROM r WHERE kept""")
def d4_greedy_or_links(spark, sf):
    """Lines of orders as links, supplier and order as URL, part as title: keys that cross, some of them blank. A line number that an order has twice counts once."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_partkey").alias("l_partkey"))
    u = F.when(F.col("l_linenumber") != 3, F.concat(F.lit("s"), "l_suppkey", F.lit("/"), F.col("l_orderkey") % 40)).otherwise("")
    t = F.when(F.col("l_linenumber") != 5, F.concat(F.lit("p"), "l_partkey"))
    return D.dedup_greedy_or(rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), u.alias("u"), t.alias("t")), "u", "t").select("seq")


@query("SELECT s_nationkey, min(s_suppkey) AS s_suppkey, bool_or(s_suppkey % 3 = 0) AS core FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 <> 0, s_suppkey) AS n FROM supplier) WHERE n = 1 GROUP BY 1")
def d5_merge_account_lists(spark, sf):
    s = table(spark, sf, "supplier")
    both = s.filter("s_suppkey % 3 = 0").withColumn("core", F.lit(True)).unionByName(s.filter("s_suppkey % 3 <> 0").withColumn("core", F.lit(False)))
    return D.first_by(both, F.col("s_nationkey").cast("string"), ~F.col("core"), F.col("s_suppkey")).select("s_nationkey", "s_suppkey", "core")


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def d6_union_first_by_name(spark, sf):
    p = table(spark, sf, "part")
    both = p.filter("p_partkey % 2 = 0").unionByName(p.filter("p_partkey % 2 = 1"))
    return D.first_by(both, F.col("p_name"), "p_partkey").select("p_name", "p_partkey")


@query("SELECT min(page_id) AS page_id FROM pages GROUP BY regexp_replace(lower(regexp_extract(url, '^https?://([^?#]+)', 1)), '^m\\.', 'www.')")
def d7_alias_urls(spark, sf):
    key = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^?#]+)", 1)), r"^m\.", "www.")
    return D.first_by(table(spark, sf, "pages"), key, "page_id").select("page_id")


@query("SELECT 'documents' AS origin, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'pages', page_id, NULL, url FROM pages")
def u1_union_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "lang")
    return d.unionByName(table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("(SELECT 'only_old' AS side, p_name FROM (SELECT p_name FROM part WHERE p_partkey % 5 = 0 EXCEPT SELECT p_name FROM part WHERE p_partkey % 5 = 1)) UNION ALL (SELECT 'both', p_name FROM (SELECT p_name FROM part WHERE p_partkey % 5 = 0 INTERSECT SELECT p_name FROM part WHERE p_partkey % 5 = 1))")
def u2_name_sets(spark, sf):
    p = table(spark, sf, "part")
    a, b = p.filter("p_partkey % 5 = 0").select("p_name"), p.filter("p_partkey % 5 = 1").select("p_name")
    side = lambda df, s: df.select(F.lit(s).alias("side"), "p_name")
    return side(a.exceptAll(b).distinct().join(b, "p_name", "left_anti"), "only_old").unionByName(side(a.intersect(b), "both"))




"""Merging a batch of raw events into catalog, editions and evidence, and keeping the three as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import extract as E
from concord.functions import text as X
from concord.functions import times as T
from concord.operators.dedup import shared_folder
from concord.sources.tables import TableStore

CATALOG = "catalog_key string, organizer string, category string, contest_level string, authority_level string, is_ministry_approved boolean"
EDITIONS = (
    "event_id string, seq long, catalog_key string, year int, title string, url string, deadline timestamp, event_time timestamp, "
    "summary string, source_name string, status string"
)
EVIDENCE = "event_id string, field_name string, field_value string, source_url string"
#: Fields of the catalog that a row fills where they are empty, and those of editions.
STABLE = ["organizer", "category", "contest_level", "authority_level"]
FILLED = ["summary", "source_name", "url"]
#: Fields that leave evidence of where they come from.
TRACED = ["deadline", "event_time", "summary", "source_url", "organizer", "contest_level"]
#: The default authority, which any other value replaces, and the sources whose events are approved.
DEFAULT_AUTHORITY = "中"
APPROVING_SOURCES = ["教育部竞赛目录", "教育部竞赛目录（2015-2018）"]


def _first(c: str, order: str = "seq") -> Column:
    """The first known value of a field."""
    value = F.when(F.col(c) != "", F.col(c))
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def _last(c: str, order: str = "seq") -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))


def merge_catalog(catalog: DataFrame, rows: DataFrame, promote_approved: bool = False) -> DataFrame:
    """catalog with the stable fields of rows (seq, catalog_key, source_name, ...), which fill what is empty or the default,
    in the order of seq. A new entry is approved if the source of its first row is an approving one; an entry that is there
    stays as it is, unless promote_approved lets any row of such a source approve it."""
    authority = F.when(F.col("authority_level") != DEFAULT_AUTHORITY, F.col("authority_level"))
    approves = F.coalesce(F.col("source_name").isin(APPROVING_SOURCES), F.lit(False))
    approved = F.max(approves) if promote_approved else F.min_by(approves, "seq")
    new = rows.withColumn("authority_level", authority).groupBy("catalog_key").agg(*[_first(c).alias(c) for c in STABLE], approved.alias("approved"))
    both = catalog.alias("c").join(new.alias("n"), "catalog_key", "full")
    known = lambda c: F.when(~F.col(f"c.{c}").isin("", DEFAULT_AUTHORITY if c == "authority_level" else ""), F.col(f"c.{c}"))
    other = {"authority_level": DEFAULT_AUTHORITY}
    fields = [F.coalesce(known(c), F.col(f"n.{c}"), F.lit(other.get(c, ""))).alias(c) for c in STABLE]
    old, fresh = F.col("c.is_ministry_approved"), F.coalesce("n.approved", F.lit(False))
    flag = F.coalesce(old, F.lit(False)) | fresh if promote_approved else F.coalesce(old, fresh)
    return both.select("catalog_key", *fields, flag.alias("is_ministry_approved"))


def _keys(rows: DataFrame, *cols: str) -> DataFrame:
    """A row for each key that an edition may be found by: (catalog_key, how, place, *cols), how being 1 for the year, 2
    for the URL and 3 for the title. Blank URLs and titles are no keys."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    each = [F.struct(F.lit(n).alias("how"), v.alias("place")) for n, v in ((1, F.col("year").cast("string")), (2, text("url")), (3, text("title")))]
    return rows.select("catalog_key", *cols, F.inline(F.array(*each))).filter("place is not null")


def _lookup(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """(seq, event_id) of the rows (seq, catalog_key, year, url, title) that an edition is found for: by the first of
    year, URL and, without a year, title; of several editions the one with the smallest seq."""
    index = _keys(editions, "event_id", "seq").groupBy("catalog_key", "how", "place").agg(F.min_by("event_id", "seq").alias("event_id"))
    asked = _keys(rows, "seq", "year").filter("how < 3 or year is null").drop("year")
    return asked.join(index, ["catalog_key", "how", "place"]).groupBy("seq").agg(F.min_by("event_id", "how").alias("event_id"))


def kinds_of(rows: DataFrame) -> DataFrame:
    """(title, link, seq, url, skip, catalog_key, year) of each different title and URL of rows, which are all that skipping
    and identity hang on: link is the URL, empty if there is none, and seq that of the first such row. Rules and keys of a
    title are taken here, after the grouping, and not once and again for each row."""
    link = F.coalesce("url", F.lit("")).alias("link")
    title = F.col("title")
    kinds = rows.groupBy("title", link).agg(F.min("seq").alias("seq")).withColumn("url", F.nullif("link", F.lit("")))
    return kinds.select("*", F.when(X.is_promotion(title), "skipped_ad").alias("skip"), X.catalog_key(title).alias("catalog_key"), X.edition_year(title).alias("year"))


def identify(kinds: DataFrame, editions: DataFrame) -> DataFrame:
    """kinds (kinds_of) with event_id, known, whether the edition existed, and first, the smallest seq of those with that
    event_id. An edition is found by catalog and year, else by catalog and URL, else, without a year, by catalog and title;
    a blank URL finds nothing. Kinds of a batch that none is found for make new ones: one for each catalog and year; kinds
    without a year join the first one of such an edition by URL or title, and else make one for each URL, or for each
    title where the URL is blank.

    Identities are settled over the few columns that decide them, each step from the checkpoint of the one before."""
    shared_folder(kinds.sparkSession)
    own = E.event_id(F.col("catalog_key"), F.col("year"), F.col("title"), F.col("url"))
    ids = kinds.join(_lookup(kinds, editions), "seq", "left").withColumn("known", F.col("event_id").isNotNull()).withColumn("own", own).checkpoint()
    first = Window.partitionBy("catalog_key", "year").orderBy("seq")
    dated = ids.filter("not known and year is not null").withColumn("event_id", F.first("own").over(first)).withColumn("n", F.row_number().over(first)).checkpoint()
    alone = ids.filter("not known and year is null").drop("event_id")
    undated = alone.join(_lookup(alone, dated.filter("n = 1")), "seq", "left")
    place = F.when(F.col("event_id").isNull(), F.coalesce("url", "title"))
    group = Window.partitionBy("catalog_key", place).orderBy("seq")
    undated = undated.withColumn("event_id", F.coalesce("event_id", F.first("own").over(group)))
    found = reduce(DataFrame.unionByName, [p.select(*kinds.columns, "event_id", "known") for p in (ids.filter("known"), dated, undated)])
    return found.withColumn("first", F.min("seq").over(Window.partitionBy("event_id")))


#: Most bytes of titles and URLs of the kinds that are broadcast; beyond it they meet their rows by a shuffle.
KIND_BYTES = 8 << 20


def with_kinds(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """rows with what their kinds (title, link, ...) have; kinds are checkpointed."""
    size = kinds.agg(F.sum(F.octet_length("title") + F.octet_length("link") + 100)).first()[0] or 0
    side = F.broadcast(kinds) if size <= KIND_BYTES else kinds.hint("merge")
    return rows.withColumn("link", F.coalesce("url", F.lit(""))).join(side, ["title", "link"]).drop("link")


def merge_editions(editions: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """editions with identified rows: title and year of the last row, its times where it has any (a missing time erases
    nothing), other fields where they were empty; then the timeline rule and the state at now."""
    new = rows.groupBy("event_id").agg(
        F.min("seq").alias("seq"), F.first("catalog_key").alias("catalog_key"), F.max_by("title", "seq").alias("title"), F.max_by("year", "seq").alias("year"),
        *[_last(c).alias(c) for c in ("deadline", "event_time")], *[_first(c).alias(c) for c in FILLED],
    )
    both = editions.alias("e").join(new.alias("n"), "event_id", "full")
    newer = lambda c: F.coalesce(f"n.{c}", f"e.{c}")
    older = lambda c: F.coalesce(F.when(F.col(f"e.{c}") != "", F.col(f"e.{c}")), F.col(f"n.{c}"))
    deadline = newer("deadline")
    return both.select(
        "event_id", F.coalesce("e.seq", "n.seq").alias("seq"), newer("catalog_key").alias("catalog_key"),
        F.when(F.col("n.title").isNotNull(), F.col("n.year")).otherwise(F.col("e.year")).alias("year"), newer("title").alias("title"), older("url").alias("url"),
        deadline.alias("deadline"), T.timeline(deadline, newer("event_time")).alias("event_time"), older("summary").alias("summary"), older("source_name").alias("source_name"),
        T.state_name(T.status_of(deadline, now)).alias("status"),
    )


def merge_evidence(evidence: DataFrame, rows: DataFrame, cut: int = 2000) -> DataFrame:
    """evidence with a row for each filled field of identified rows, and for each URL, that it does not hold yet."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    value = {"deadline": iso("deadline"), "event_time": iso("event_time"), "source_url": F.col("url")}
    each = [F.struct(F.lit(c).alias("field_name"), F.substring(value.get(c, F.col(c)), 1, cut).alias("field_value")) for c in TRACED]
    keys = ["event_id", "field_name", "field_value", "source_url"]
    long = rows.select("event_id", F.coalesce("url", F.lit("")).alias("source_url"), F.inline(F.array(*each))).filter(X.is_meaningful(F.col("field_value")))
    both = evidence.select(*keys, F.lit(1).alias("old")).unionByName(long.select(*keys, F.lit(0).alias("old")))
    rows_of = both.groupBy(*keys).agg(F.sum("old").alias("n"))  # one shuffle of both; what evidence holds stays as often as it does
    return rows_of.select(*keys, F.explode(F.array_repeat(F.lit(0), F.greatest("n", F.lit(1)).cast("int")))).select(*keys)


def merge_events(raw: DataFrame, catalog: DataFrame, editions: DataFrame, evidence: DataFrame, now: Column, promote_approved: bool = False) -> dict[str, DataFrame]:
    """The new catalog, editions and evidence after raw (seq, title, url, organizer, category, contest_level,
    authority_level, source_name, deadline, event_time, summary), and actions (seq, event_id, action): rows without a
    title and promotions are skipped, the first row of a new edition is added, all others are updates. All four are made
    from one checkpoint of the identified rows."""
    shared_folder(raw.sparkSession)
    titled = X.is_meaningful(F.col("title"))
    rows = raw.filter(titled)
    kinds = kinds_of(rows).checkpoint()
    known = identify(kinds.filter("skip is null"), editions).drop("seq", "url")
    ads = kinds.filter("skip is not null").select("title", "link", "skip")
    marked = with_kinds(rows, known.unionByName(ads, allowMissingColumns=True).checkpoint())
    action = F.coalesce("skip", F.when(~F.col("known") & (F.col("seq") == F.col("first")), "added").otherwise("updated"))
    judged = marked.withColumn("action", action).drop("known", "first").checkpoint()
    found = judged.filter("skip is null").drop("skip")
    blank = raw.filter(~titled).select("seq", F.lit(None).cast("string").alias("event_id"), F.lit("skipped_invalid").alias("action"))
    return {
        "catalog": merge_catalog(catalog, found, promote_approved),
        "editions": merge_editions(editions, found, now),
        "evidence": merge_evidence(evidence, found),
        "actions": judged.select("seq", "event_id", "action").unionByName(blank),
    }


def sync_events(store: TableStore, raw: DataFrame, now: Column, promote_approved: bool = False) -> DataFrame:
    """Merge raw into the store's tables catalog, editions and evidence, and return the actions. The same rows again change
    none of the tables. Every table is written whole and becomes current when it is; editions come last, so that a run
    that is repeated after a failure finds the same identities. The actions are stored too."""
    empty = lambda schema: store.spark.createDataFrame([], schema)
    now_in = {n: store.read(n) if store.exists(n) else empty(s) for n, s in (("catalog", CATALOG), ("editions", EDITIONS), ("evidence", EVIDENCE))}
    merged = merge_events(raw, now_in["catalog"], now_in["editions"], now_in["evidence"], now, promote_approved)
    for name in ("actions", "catalog", "evidence", "editions"):
        store.overwrite(name, merged[name])
    return store.read("actions")


def flat_events(catalog: DataFrame, editions: DataFrame) -> DataFrame:
    """The flat view: editions with the stable fields of their catalog entry."""
    return editions.join(catalog, "catalog_key")

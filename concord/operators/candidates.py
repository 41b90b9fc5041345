"""Candidates of a sync: listing pages opened into their events, details taken from pages, and what is made of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import candidates as C
from concord.functions import dates as D
from concord.functions import extract as E
from concord.functions import text as X
from concord.functions import times as T
from concord.operators.dedup import cap_round_robin, first_by, shared_folder

#: What a candidate has; times are text. place tells events of one listing apart, and is 0 for other rows.
CANDIDATE = (
    "seq long, place int, platform_id string, source string, title string, url string, organizer string, signup_deadline string, event_start string, "
    "event_end string, status string, mode string, summary string, authority string, tags array<string>"
)
NAMES = [c.split()[0] for c in CANDIDATE.split(", ")]
#: Fields that a parsed page replaces where it has a value.
OVERLAID = ["title", "organizer", "signup_deadline", "event_start", "event_end", "mode", "summary"]
DATES = ["signup_deadline", "event_start", "event_end"]
ORDER = ["_later", "seq", "place"]


def overlay_parsed(candidates: DataFrame, parsed: DataFrame, key: str, fields: list[str] = OVERLAID) -> DataFrame:
    """candidates with each of fields from the parsed row of the same key where that is neither null nor ''. parsed has one
    row a key, and some of fields; candidates without a parsed row, or with a null key, stay as they are."""
    got = [f for f in fields if f in parsed.columns]
    rows = parsed.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_p_{f}") for f in got])
    both = candidates.join(rows, F.col(key) == F.col("_k"), "left")
    new = {f: F.coalesce(F.nullif(F.col(f"_p_{f}"), F.lit("")), F.col(f)) for f in got}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in candidates.columns])


def fill_from_text(df: DataFrame, text: Column, where: Column) -> DataFrame:
    """df with the organizer that a page's text names, and the head of the text as summary where there is none, in the rows
    that where holds for."""
    organizer = F.coalesce(F.nullif(E.organizer(text, E.ORGANIZERS_BOTH), F.lit("")), F.col("organizer"))
    summary = F.when(F.coalesce(F.col("summary"), F.lit("")) == "", F.substring(text, 1, 200)).otherwise(F.col("summary"))
    return df.withColumns({"organizer": F.when(where, organizer).otherwise(F.col("organizer")), "summary": F.when(where, summary).otherwise(F.col("summary"))})


def _place_of(key: Column, compared: Column, *order: str) -> Column:
    """The place of a row among those of its key that are compared; 1 for rows that are not, or have a blank key."""
    one = compared & key.isNotNull() & (key != "")
    return F.row_number().over(Window.partitionBy(F.when(one, key), F.when(~F.coalesce(one, F.lit(False)), F.struct("seq", "place"))).orderBy(*order))


def identity() -> Column:
    day = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("event_start", "signup_deadline", "event_end")])
    return E.candidate_identity(F.col("platform_id"), F.col("source"), F.col("url"), F.col("title"), day)


def with_kind(df: DataFrame) -> DataFrame:
    kind = C.candidate_kind(*[F.col(c) for c in ("title", "event_start", "event_end", "signup_deadline", "authority", "url")])
    return df.withColumn("kind", kind)


def expand_listings(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """candidates with their kind, those of kind listing replaced by the events that their landed pages list (listed:
    url_key and the columns of CANDIDATE but seq). A listing without listed events has no row."""
    rows = with_kind(candidates)
    own = rows.filter("kind <> 'listing'").withColumn("_later", F.when(F.col("kind") == "detail", 0).otherwise(1))
    opened = rows.filter("kind = 'listing'").select("seq", X.url_key(F.col("url")).alias("url_key")).join(listed, "url_key")
    inner = with_kind(opened.select(*NAMES)).withColumn("_later", F.lit(2))
    return own.unionByName(inner)


def decide(candidates: DataFrame, listed: DataFrame, pages: DataFrame, parsed: DataFrame, now: Column, year: int, limit: int, max_days: int = 400) -> DataFrame:
    """The decision table of a sync: every candidate (columns of CANDIDATE) once, listing pages as their events, with kind
    and reason, and with the fields that the decision went by.

    First by identity, dealt round robin up to limit, and listings opened (expand_listings), first by identity again;
    events of listings come after detail and structured rows. A structured row is judged by its own fields; any other by
    its landed page (pages: url_key, page_title, text; one row a key): fetch_failed without one, not_hackathon off the
    topic, then by the fields parsed from it (parsed: url_key and some of OVERLAID; else organizer and summary out of the
    text), the dates of ranges, of their context, its own, and the status that the text tells. Rows without a URL cannot be
    opened: fetch_failed. Of accepted rows with one platform id or one title the first stays, the others are
    postparse_duplicates. What the texts tell is taken out once and checkpointed, so that the rules work on short columns.
    Rows left out earlier have the reasons prefetch_duplicates and truncated_by_limit."""
    rows = candidates.select(*NAMES).withColumn("_n", _place_of(identity(), F.lit(True), "seq"))
    first = rows.filter("_n = 1").drop("_n", "place")
    taken = cap_round_robin(first, limit, "source").drop("place").withColumn("place", F.lit(0)).select(*NAMES)
    early = rows.filter("_n > 1").drop("_n").withColumn("reason", F.lit("prefetch_duplicates"))
    cut = first.join(taken.select("seq"), "seq", "left_anti").withColumn("place", F.lit(0)).withColumn("reason", F.lit("truncated_by_limit"))

    opened = expand_listings(taken, listed).withColumn("_again", _place_of(identity(), F.lit(True), *ORDER) > 1)
    structured = F.col("kind") == "structured"
    to_read = ~structured & ~F.col("_again") & (F.coalesce(F.col("url"), F.lit("")) != "")
    read = opened.withColumn("url_key", F.when(to_read, X.url_key(F.col("url")))).join(pages.select("url_key", "page_title", "text"), "url_key", "left")
    read = read.withColumn("title", F.when(structured, F.col("title")).otherwise(F.coalesce(F.nullif("title", F.lit("")), "page_title")))
    topic = X.is_topic(F.coalesce("title", F.lit("")), F.col("text"))
    why = F.when(F.col("_again"), "prefetch_duplicates").when(structured, None).when(F.col("text").isNull(), "fetch_failed").when(~topic, "not_hackathon")
    read = read.withColumn("_why", why).withColumn("url_key", F.when(F.col("_why").isNull(), F.col("url_key")))
    full = overlay_parsed(read, parsed, "url_key").join(parsed.select("url_key", F.lit(True).alias("_parsed")), "url_key", "left")
    by_page = F.col("url_key").isNotNull()
    full = fill_from_text(full, F.col("text"), by_page & F.col("_parsed").isNull())

    full, text = full.withColumns({"text": F.when(by_page, F.col("text")), "_read": by_page}), F.col("text")
    told = D.resolve_dates(D.ranges(text, year), D.assign_dates(D.scored_dates(text)), *[F.col(c) for c in DATES])
    shared_folder(candidates.sparkSession)
    full = full.select(*NAMES, "kind", "_later", "_why", "_read", told.alias("_told"), E.detect_status(text, F.col("status")).alias("_says")).checkpoint()
    by_own = F.coalesce(E.status_word(F.col("status")), F.when(F.col("event_start") != "", "upcoming"))
    status = F.when(F.col("_read"), F.col("_says")).otherwise(by_own)
    full = full.withColumns({**{c: F.when(F.col("_read"), F.col("_told")[c]).otherwise(F.col(c)) for c in DATES}, "status": status})
    at = lambda c, last=False: T.coerce_ts(F.col(c), "Asia/Shanghai", last)
    judged = T.accept_by_time(at("signup_deadline", True), at("event_start"), at("event_end", True), F.col("status"), now, max_days)
    reason = F.coalesce("_why", F.when((judged == "accepted") & (F.trim(F.coalesce("title", F.lit(""))) == ""), "missing_title_filtered"), judged)
    decided = full.withColumn("reason", reason).withColumn("_ok", F.col("reason") == "accepted")

    decided = decided.withColumn("_first", F.col("_ok") & (_place_of(F.col("platform_id"), F.col("_ok"), *ORDER) == 1))
    decided = decided.withColumn("_stays", F.col("_first") & (_place_of(X.light_key(F.col("title")), F.col("_first"), *ORDER) == 1))
    decided = decided.withColumn("reason", F.when(F.col("_ok") & ~F.col("_stays"), "postparse_duplicates").otherwise(F.col("reason")))
    return decided.select(*NAMES, "kind", "reason").unionByName(with_kind(early)).unionByName(with_kind(cut))


def to_events(candidates: DataFrame) -> DataFrame:
    """Candidates as events to be merged: dates as times at +08:00, the mode among the tags, authority in the catalog's
    words, a status by whether a deadline is known. seq and place stay."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("黑客松")))
    extra = F.when(F.col("mode") == "online", "线上").when(F.col("mode") == "offline", "线下")
    tags = F.when(extra.isNull() | F.array_contains(tags, extra), tags).otherwise(F.array_append(tags, extra))
    undated = c("signup_deadline") == ""
    time = lambda name: T.event_date_iso(F.nullif(F.trim(F.col(name)), F.lit("")))
    return candidates.select(
        "seq", "place", c("title").alias("title"), F.lit("校外竞赛").alias("scope_type"), F.lit("黑客松").alias("category"), c("summary").alias("summary"),
        time("signup_deadline").alias("signup_deadline"), time("event_start").alias("event_time"), F.lit("").alias("target_major"), F.lit("").alias("target_grade"),
        F.lit("").alias("contest_level"), F.to_json(tags).alias("tags"), F.lit("").alias("policy_tags"), C.source_label(F.col("source"), F.col("url")).alias("source_name"),
        c("url").alias("source_url"), C.authority(F.col("authority"), F.col("url")).alias("authority_level"), F.when(undated, "待确认").otherwise("报名中").alias("status"),
        c("organizer").alias("organizer"), F.substring(c("summary"), 1, 500).alias("original_text"), F.lit(False).alias("is_ministry_approved"),
    )


#: Classes of accounts in their order.
ACCOUNT_CLASSES = ["school_level", "college", "dynamic"]


def merge_account_lists(core: DataFrame, found: DataFrame) -> DataFrame:
    """Accounts (name, descr, category, is_core) of a core list (name, descr, category), and of what was found (seq, name,
    descr) those with a name that neither the core list nor an earlier row has, as class dynamic; ordered by class, then
    name. Rows of other classes go, as do found rows without a name."""
    new = first_by(found.filter(F.coalesce("name", F.lit("")) != ""), F.col("name"), "seq").join(core.select("name").distinct(), "name", "left_anti")
    both = core.select("name", "descr", "category", F.lit(True).alias("is_core")).unionByName(
        new.select("name", "descr", F.lit("dynamic").alias("category"), F.lit(False).alias("is_core"))
    )
    place = F.array_position(F.array(*map(F.lit, ACCOUNT_CLASSES)), F.col("category"))
    return both.withColumn("_class", place).filter("_class > 0").orderBy("_class", "name").drop("_class")

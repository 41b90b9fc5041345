"""Whole pipelines over the operators: every one is one plan per table, and takes now as a parameter."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from concord.functions import candidates as CF
from concord.functions import extract as E
from concord.functions import text as X
from concord.functions import times as T
from concord.operators import candidates as C
from concord.operators import dedup as D
from concord.operators import match as M
from concord.operators import merge as G
from concord.operators import rank as R
from concord.operators import state as S
from concord.operators import upsert as U
from concord.sources.tables import TableStore, write_report


def _table(store: TableStore, name: str, schema: str) -> DataFrame:
    return store.read(name) if store.exists(name) else store.spark.createDataFrame([], schema)


def refresh(store: TableStore, now: Column) -> None:
    """Write the state at now of every edition, where any state changes."""
    if store.exists("editions"):
        editions = store.read("editions")
        fresh = T.state_name(T.status_of(F.col("deadline"), now))
        if not editions.filter(~fresh.eqNullSafe(F.col("status"))).isEmpty():
            store.overwrite("editions", editions.withColumn("status", fresh))


def load_catalog(store: TableStore, entries: DataFrame) -> None:
    """Merge catalog entries (seq, title, organizer, category, contest_level, authority_level, source_name) into the
    store's catalog; they make no editions."""
    rows = entries.filter(X.is_meaningful(F.col("title"))).withColumn("catalog_key", X.catalog_key(F.col("title")))
    store.overwrite("catalog", U.merge_catalog(_table(store, "catalog", U.CATALOG), rows))


def enrich_by_rules(raw: DataFrame, entries: DataFrame, least: float = 0.85) -> DataFrame:
    """raw events with gaps filled: organizer, category and level of the catalog entry whose title is most alike (by match
    key, least similarity), else category and level by the rules on the title, and the default authority."""
    key = lambda df: df.withColumn("key", X.match_key(F.col("title")))
    if entries.isEmpty():  # nothing to match with
        found = raw.sparkSession.createDataFrame([], "seq long, r_seq long")
    else:
        found = M.fuzzy_match(key(raw), key(entries), "key", least).select(F.col("l_seq").alias("seq"), "r_seq")
    known = entries.select(F.col("seq").alias("r_seq"), *[F.col(c).alias(f"_{c}") for c in ("organizer", "category", "contest_level", "authority_level")])
    both = raw.join(found.join(known, "r_seq"), "seq", "left")
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    rules = {"category": E.category(F.col("title")), "contest_level": E.level(F.col("title")), "authority_level": F.lit(U.DEFAULT_AUTHORITY), "organizer": F.lit("")}
    filled = {c: F.coalesce(own(c), own(f"_{c}"), rule) for c, rule in rules.items()}
    return both.withColumns(filled).select(*raw.columns)


RAW = "seq long, title string, url string, organizer string, category string, contest_level string, authority_level string, source_name string, deadline timestamp, event_time timestamp, summary string"


def run_full_sync(store: TableStore, entries: DataFrame, sources: list[DataFrame], now: Column) -> DataFrame:
    """Refresh all states, load the catalog entries, fill the raw events of all sources by rules, and merge them into the
    store's catalog, editions and evidence. Returns (action, n). sources have some of the columns of RAW; seq is unique
    over them."""
    refresh(store, now)
    load_catalog(store, entries)
    raw = store.spark.createDataFrame([], RAW)
    for s in sources:
        raw = raw.unionByName(s, allowMissingColumns=True)
    actions = U.sync_events(store, enrich_by_rules(raw.select(*[c.split()[0] for c in RAW.split(", ")]), entries), now)
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def candidate_decisions(candidates: DataFrame, pages: DataFrame, now: Column, limit: int) -> DataFrame:
    """The decision table (seq, source, title, reason) of candidates (seq, source, url, title, deadline, start, status): first
    by URL key, dealt round robin up to limit, titles filled from pages (url_key, page_title, topic), then the time rules."""
    keyed = candidates.withColumn("url_key", X.url_key(F.col("url")))
    first = D.first_by(keyed, F.col("url_key"), "seq")
    capped = D.cap_round_robin(first, limit, "source")
    read = capped.join(pages, "url_key", "left")
    title = F.coalesce(X.filled(F.col("title")), F.col("page_title"))
    reason = F.when(title.isNull(), "no_title").when(~F.coalesce("topic", F.lit(True)), "off_topic").otherwise(
        T.accept_by_time(F.col("deadline"), F.col("start"), F.lit(None).cast("timestamp"), F.col("status"), now)
    )
    decided = read.select("seq", "source", title.alias("title"), reason.alias("reason"))
    dropped = candidates.join(first.select("seq"), "seq", "left_anti").select("seq", "source", "title", F.lit("duplicate").alias("reason"))
    cut = first.join(capped.select("seq"), "seq", "left_anti").select("seq", "source", "title", F.lit("truncated").alias("reason"))
    return decided.unionByName(dropped).unionByName(cut)


def run_candidate_sync(store: TableStore, candidates: DataFrame, pages: DataFrame, now: Column, limit: int, report: str, dry_run: bool = False) -> DataFrame:
    """Decide on candidates (seq, source, url, title, deadline, start, status), write the report, and, unless it is a dry run,
    merge the accepted ones into the store. The decision table is written once, below report; its counters are taken
    while it is written, and the report and the merge read it. Returns (source, reason, n)."""
    decided = candidate_decisions(candidates, pages, now, limit)
    seen = Observation(f"decisions-{uuid.uuid4().hex}")
    counted = decided.observe(seen, F.count("*").alias("candidates"), F.count_if(F.col("reason") == "accepted").alias("accepted"), F.count_if(F.col("reason") == "duplicate").alias("duplicates"), F.count_if(F.col("reason") == "truncated").alias("truncated"))
    counted.write.parquet(f"{report}/decisions")
    rows = store.spark.read.schema(decided.schema).parquet(f"{report}/decisions")
    write_report(rows, seen.get, report, "source", "reason", "seq")
    if not dry_run:
        good = rows.filter("reason = 'accepted'").join(candidates.drop("source", "title"), "seq")
        raw = good.select("seq", "title", "url", F.col("source").alias("source_name"), "deadline", F.col("start").alias("event_time"))
        empty = store.spark.createDataFrame([], RAW)
        U.sync_events(store, enrich_by_rules(empty.unionByName(raw, allowMissingColumns=True), empty), now)
    return rows.groupBy("source", "reason").agg(F.count("*").alias("n"))


def sync_candidates(
    store: TableStore, candidates: DataFrame, listed: DataFrame, pages: DataFrame, parsed: DataFrame, now: Column, year: int, limit: int, report: str, dry_run: bool = False
) -> DataFrame:
    """Candidate sync over all its phases: the decisions of operators.candidates.decide are written once, below report,
    their counters taken meanwhile; the report, the funnel and, unless it is a dry run, the merge of the accepted rows into
    the store read that table. Returns the funnel, a row a source and one of all."""
    decided = C.decide(candidates, listed, pages, parsed, now, year, limit)
    seen, source = Observation(f"sync-{uuid.uuid4().hex}"), CF.candidate_source(F.lit(None), F.col("source"), F.col("url"))
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in ("accepted", "prefetch_duplicates", "truncated_by_limit", "postparse_duplicates")]
    counted = decided.withColumn("source_key", source).observe(seen, F.count("*").alias("candidates"), *counts)
    counted.write.parquet(f"{report}/decisions")
    rows = store.spark.read.schema(counted.schema).parquet(f"{report}/decisions")
    write_report(rows, seen.get, report, "source_key", "reason", "seq")
    if not dry_run:
        at = lambda c: T.coerce_ts(F.col(c), "Asia/Shanghai")
        events = C.to_events(rows.filter("reason = 'accepted'"))
        raw = events.withColumn("seq", F.col("seq") * (1 << 20) + F.col("place"))  # a page of bounded bytes lists fewer events
        raw = raw.select("seq", "title", F.col("source_url").alias("url"), "organizer", "category", "contest_level", "authority_level", "source_name", "summary", at("signup_deadline").alias("deadline"), at("event_time").alias("event_time"))
        U.sync_events(store, raw, now)
    return R.funnel(rows, "source_key", "reason")


def verify_incomplete(editions: DataFrame, observations: DataFrame, field: str) -> DataFrame:
    """editions (entity_id, field) with missing values filled by what two independent domains or more agree on."""
    missing = editions.filter(~X.is_meaningful(F.col(field))).select("entity_id")
    got = G.consensus(observations.join(missing, "entity_id", "left_semi"))
    both = editions.join(got.select("entity_id", "value"), "entity_id", "left")
    return both.select("entity_id", F.coalesce(X.filled(F.col(field)), "value").alias(field), F.col("value").isNotNull().alias("verified"))


def article_outcomes(items: DataFrame, accounts: DataFrame, cursors: DataFrame, processed: DataFrame, now: Column, hours: int, overlap: int = 24) -> DataFrame:
    """items (seq, key, account, publisher, at, title, url) with outcome: unknown_publisher, undated, late, processed,
    irrelevant or taken. A publisher is known if its account key is that of the account's name or of one of its aliases
    (accounts: account, aliases). A row is late before the account's window: hours back and the overlap, or the overlap
    before its cursor, whichever is earlier; 0 hours ask for everything. Of rows with one key the first by seq is taken."""
    names = accounts.select("account", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("account"))).alias("name"))
    names = names.select("account", X.account_key(F.col("name")).alias("_p")).filter("_p <> ''").distinct().withColumn("_known", F.lit(True))
    rows = items.withColumn("_p", X.account_key(F.coalesce("publisher", F.lit("")))).join(names, ["account", "_p"], "left")
    rows = rows.join(processed.select("key").distinct().withColumn("_done", F.lit(True)), "key", "left").join(cursors, "account", "left")
    back = F.expr(f"INTERVAL {overlap} HOUR")
    start = now - F.expr(f"INTERVAL {hours + overlap} HOUR")
    late = F.lit(False) if hours == 0 else F.coalesce(F.col("at") < F.least(start, F.coalesce(F.col("last_at") - back, start)), F.lit(False))
    undated = F.col("at").isNull() if hours else F.lit(False)
    outcome = F.when(F.col("_known").isNull(), "unknown_publisher").when(undated, "undated").when(late, "late").when(F.col("_done"), "processed")
    first = F.row_number().over(Window.partitionBy("key", outcome.isNull()).orderBy("seq")) == 1
    outcome = outcome.when(~first, "processed").when(~X.is_relevant(F.col("title"), F.lit("")), "irrelevant").otherwise("taken")
    return rows.withColumn("outcome", outcome).select(*items.columns, "outcome")


#: Outcomes that are tried again, and the stage that they failed in.
QUARANTINED = {"unknown_publisher": "publisher_verification", "undated": "publish_time"}


def run_article_sync(store: TableStore, items: DataFrame, accounts: DataFrame, now: Column, hours: int) -> DataFrame:
    """One round of account articles on the store's tables cursors (account, last_at), processed (key, processed_at) and
    failures (key, stage, attempts, first_seen_at, last_seen_at): relevant new articles are merged as events; items that
    cannot be judged are quarantined; items with a terminal action, irrelevant ones too, are acknowledged, their
    failures cleared and their accounts' cursors advanced. State is written after the merge, so that a round that fails
    is done again; state older than its bounds is pruned. Returns (outcome, n)."""
    cursors, processed = _table(store, "cursors", "account string, last_at timestamp"), _table(store, "processed", "key string, processed_at timestamp")
    failures = _table(store, "failures", "key string, stage string, attempts int, first_seen_at timestamp, last_seen_at timestamp")
    D.shared_folder(store.spark)
    known = article_outcomes(items, accounts, cursors, processed, now, hours).checkpoint()
    raw = known.filter("outcome = 'taken'").select("seq", "title", "url", F.col("publisher").alias("source_name"))
    empty = store.spark.createDataFrame([], RAW)
    actions = U.sync_events(store, enrich_by_rules(empty.unionByName(raw, allowMissingColumns=True), empty), now)
    done = known.join(actions.select("seq", "action"), "seq", "left").withColumn("action", F.when(F.col("outcome") == "irrelevant", "skipped_invalid").otherwise(F.col("action")))
    acked = done.filter(F.col("action").isin(S.TERMINAL))
    stage = F.element_at(F.create_map(*[F.lit(x) for kv in QUARANTINED.items() for x in kv]), F.col("outcome"))
    failed = S.upsert_failures(failures, known.select("key", stage.alias("stage")).filter("stage is not null"), now)
    now_processed, now_failed = S.acknowledge(acked.select("key", "action"), processed, failed, now)
    store.overwrite("failures", R.prune_state(now_failed, "last_seen_at", "key", now, 14, 500))
    store.overwrite("processed", R.prune_state(now_processed, "processed_at", "key", now, 90, 5000))
    store.overwrite("cursors", S.advance_cursors(cursors, acked, "account", "at"))
    return known.groupBy("outcome").agg(F.count("*").alias("n"))


def fuzzy_import(batch: DataFrame, events: DataFrame, least: float = 0.85) -> DataFrame:
    """batch (seq, title, url) against events (seq, title): (seq, r_seq, action), updated where a similar title is found."""
    key = lambda df: df.withColumn("key", X.match_key(X.clean_marketing_title(F.col("title"))))
    got = M.fuzzy_match(key(batch), key(events), "key", least)
    both = batch.join(got, batch["seq"] == got["l_seq"], "left")
    return both.select("seq", "r_seq", F.when(F.col("r_seq").isNotNull(), "updated").otherwise("added").alias("action"))

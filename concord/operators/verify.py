"""Filling gaps with what independent sources agree on, with a trace of who said what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import extract as E
from concord.functions import text as X
from concord.functions import times as T

#: Pages of so many different domains are read for an entity.
MOST_DOMAINS = 3
#: Fields that pages can fill.
VERIFIABLE = ["signup_deadline", "event_time", "contest_level", "organizer"]


def first_pages(pages: DataFrame, most: int = MOST_DOMAINS) -> DataFrame:
    """pages (entity_id, seq, url, text) with their domain: of each entity the first page with text of each of its first most
    domains, in the order of seq. Chosen by seq and domain alone, so that no text travels to be left out."""
    known = pages.withColumn("domain", X.source_domain(F.col("url"))).filter((F.col("domain") != "") & X.is_meaningful(F.col("text")))
    first = known.groupBy("entity_id", "domain").agg(F.min("seq").alias("seq"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("seq", "domain"))).filter(F.col("n") <= most).drop("n")
    return known.join(ranked, ["entity_id", "domain", "seq"])


def page_observations(pages: DataFrame) -> DataFrame:
    """What pages (entity_id, seq, domain, url, text) say: (entity_id, seq, domain, source_url, field, value), a row for each of
    VERIFIABLE, its value null where the page is silent."""
    text = F.col("text")
    values = {"signup_deadline": T.labelled_date(text, T.DEADLINES, "23:59:59"), "event_time": T.labelled_date(text, T.EVENT_DATES, "08:00:00"), "contest_level": E.level(text), "organizer": E.organizer(text)}
    each = [F.struct(F.lit(c).alias("field"), values[c].alias("value")) for c in VERIFIABLE]
    return pages.select("entity_id", "seq", "domain", F.col("url").alias("source_url"), F.inline(F.array(*each)))


def consensus_trace(observations: DataFrame, least: int = 2) -> DataFrame:
    """(entity_id, field, value, n_agree, n_domains, accepted, sources) of observations (entity_id, seq, domain, source_url,
    field, value): the value that most domains give, the first seen one of a tie, and who said what in the order of seq.
    The first seq of a domain counts, a domain without values counts among n_domains. A value is accepted if least
    domains or more were asked and as many agree. sources holds a row for each domain of an entity."""
    first = F.min("seq").over(Window.partitionBy("entity_id", "domain"))
    rows = observations.filter("domain <> ''").withColumn("_m", first).filter("seq = _m").drop("_m")
    domains = rows.groupBy("entity_id").agg(F.count_distinct("domain").alias("n_domains"))
    said = rows.filter(X.is_meaningful(F.col("value"))).groupBy("entity_id", "field").agg(F.sort_array(F.collect_set(F.struct("seq", "domain", "source_url", "value"))).alias("sources"))
    votes = F.transform("sources", lambda s, i: F.struct(F.size(F.filter("sources", lambda o: o["value"] == s["value"])).alias("n"), (-i).alias("place"), s["value"].alias("value")))
    best = said.join(domains, "entity_id").withColumn("best", F.array_max(votes))
    value, n = F.col("best")["value"], F.col("best")["n"]
    return best.select("entity_id", "field", value.alias("value"), n.alias("n_agree"), "n_domains", ((n >= least) & (F.col("n_domains") >= least)).alias("accepted"), "sources")


def apply_verified(records: DataFrame, trace: DataFrame, fields: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(records, evidence): records (entity_id, fields, verification_status, ...) whose missing fields took the accepted
    values, 'verified' where any did; and an evidence row for each source that gave an applied value."""
    accepted = trace.filter("accepted").select("entity_id", "field", "value", "sources")
    got = accepted.groupBy("entity_id").agg(*[F.max(F.when(F.col("field") == c, F.col("value"))).alias(f"_{c}") for c in fields])
    missing = lambda c: ~X.is_meaningful(F.col(c).cast("string"))
    both = records.join(got, "entity_id", "left")
    applied = F.array_compact(F.array(*[F.when(missing(c) & F.col(f"_{c}").isNotNull(), F.lit(c)) for c in fields]))
    marked = both.withColumn("_applied", applied)
    kinds = dict(records.dtypes)
    value = lambda c: F.when(F.array_contains("_applied", c), F.col(f"_{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c)
    status = F.when(F.size("_applied") > 0, "verified").otherwise(F.col("verification_status")).alias("verification_status")
    out = marked.select(*[value(c) if c in fields else status if c == "verification_status" else F.col(c) for c in records.columns])
    done = marked.select("entity_id", F.explode("_applied").alias("field"))
    agreeing = F.filter("sources", lambda s: s["value"] == F.col("value"))
    evidence = accepted.join(done, ["entity_id", "field"]).select("entity_id", F.col("field").alias("field_name"), F.col("value").alias("field_value"), F.explode(agreeing).alias("s"))
    return out, evidence.select(
        "entity_id", "field_name", "field_value", F.col("s.source_url").alias("source_url"), F.lit("cross_verify").alias("extraction_method"),
        F.lit("high").alias("confidence"), F.lit("verified").alias("verification_status"), now.alias("fetched_at"),
    )


def verify_incomplete(records: DataFrame, pages: DataFrame, now: Column) -> dict[str, DataFrame]:
    """records (entity_id, VERIFIABLE, verification_status, ...) with their gaps filled from pages (entity_id, seq, url,
    text): 'records', the 'evidence' of what was filled, and the 'trace' of what was found. Only pages of records with a
    gap are read, of MOST_DOMAINS domains each, and only missing fields are looked at."""
    gap = F.array_compact(F.array(*[F.when(~X.is_meaningful(F.col(c).cast("string")), F.lit(c)) for c in VERIFIABLE]))
    missing = records.select("entity_id", gap.alias("_gap")).filter(F.size("_gap") > 0)
    read = first_pages(pages.join(missing.select("entity_id"), "entity_id", "left_semi"))
    asked = page_observations(read).join(missing, "entity_id").withColumn("value", F.when(F.array_contains("_gap", F.col("field")), F.col("value")))
    trace = consensus_trace(asked.drop("_gap"))
    out, evidence = apply_verified(records, trace, VERIFIABLE, now)
    return {"records": out, "evidence": evidence, "trace": trace}

"""Merges that never lose better data: by priority, fill-if-empty, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.text import filled, is_meaningful

#: Ranks of authority.
AUTHORITY = {"低": 1, "中": 2, "高": 3, "low": 1, "medium": 2, "high": 3}
#: The columns of an event record.
EVENT_COLUMNS = (
    "event_id title scope_type category summary signup_deadline event_time target_major target_grade contest_level tags "
    "policy_tags source_name source_url authority_level status organizer update_time original_text is_ministry_approved"
).split()


def event_payload(df: DataFrame) -> DataFrame:
    """df with the columns of an event record only, in their order."""
    return df.select(*[c for c in EVENT_COLUMNS if c in df.columns])


def priority(approved: Column, authority: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv])
    return F.struct(F.coalesce(approved, F.lit(False)).alias("a"), F.coalesce(F.element_at(rank, authority), F.lit(0)).alias("r"))


def merge_by_priority(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str], approved_only: bool = False) -> DataFrame:
    """One row a key: incoming values replace populated ones only if their source is of strictly higher priority (approved,
    then authority; or approved alone), and fill empty ones otherwise. At most one incoming row a key; see fold()."""
    e, i = existing.alias("e"), incoming.alias("i")
    both = e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full")
    rank = lambda s: priority(F.col(f"{s}.is_ministry_approved"), F.lit(None).cast("string") if approved_only else F.col(f"{s}.authority_level"))
    higher = rank("i") > rank("e")
    value = lambda c: F.when(F.col(f"e.{key}").isNull(), F.col(f"i.{c}")).when(
        is_meaningful(F.col(f"i.{c}")) & (higher | ~is_meaningful(F.col(f"e.{c}"))), F.col(f"i.{c}")
    ).otherwise(F.col(f"e.{c}"))
    approved = F.when(F.col(f"e.{key}").isNull() | (higher & F.col("i.is_ministry_approved").isNotNull()), F.col("i.is_ministry_approved")).otherwise(
        F.coalesce("e.is_ministry_approved", "i.is_ministry_approved")
    )
    return both.select(F.coalesce(f"e.{key}", f"i.{key}").alias(key), *[value(c).alias(c) for c in fields], approved.alias("is_ministry_approved"))


def fold(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """merge_by_priority with several incoming rows a key, in the order of seq (unique in a key), one after the other.
    fields hold authority_level.

    A key's rows never meet. What a key's priority can become depends only on whether rows are approved and on the rank of
    their authority, and of rows alike in both only the first can raise it: so a key's few classes, each with its first
    seq, tell by which rows the priority rises. A field has the value of the last of these that knows it, else the first
    known value; so the rest is minima and maxima, which Spark combines before it shuffles."""
    cols = [*fields, "is_ministry_approved"]
    rows = existing.select(key, F.lit(-1).cast("long").alias("seq"), *cols).unionByName(incoming.select(key, F.col("seq").cast("long"), *cols))
    known = lambda c: F.col(c).isNotNull() if c == "is_ministry_approved" else is_meaningful(F.col(c))
    rank = F.when(known("authority_level"), priority(F.lit(None), F.col("authority_level"))["r"])
    classes = rows.groupBy(key, F.col("is_ministry_approved").alias("a"), rank.alias("r")).agg(F.min("seq").alias("seq"))
    by = classes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "a", "r"))).alias("c"))  # some 15 classes at most
    start = F.struct(F.get("c", F.lit(0))["a"].alias("a"), F.get("c", F.lit(0))["r"].alias("r"), F.array().cast("array<bigint>").alias("rises"))

    def step(s: Column, x: Column) -> Column:
        level = lambda v: F.struct(F.coalesce(v["a"], F.lit(False)), F.coalesce(v["r"], F.lit(0)))
        up = level(x) > level(s)
        a = F.when(up & x["a"].isNotNull(), x["a"]).otherwise(F.coalesce(s["a"], x["a"]))
        r = F.when(up & x["r"].isNotNull(), x["r"]).otherwise(F.coalesce(s["r"], x["r"]))
        return F.struct(a.alias("a"), r.alias("r"), F.when(up, F.array_append(s["rises"], x["seq"])).otherwise(s["rises"]).alias("rises"))

    rest = F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0)))
    rises = by.select(key, F.explode(F.aggregate(rest, start, step)["rises"]).alias("seq"))
    last = rows.join(rises, [key, "seq"]).groupBy(key).agg(*[F.max_by(c, F.when(known(c), F.col("seq"))).alias(f"_{c}") for c in cols])
    firsts = rows.groupBy(key).agg(*[F.coalesce(F.min_by(c, F.when(known(c), F.col("seq"))), F.min_by(c, "seq")).alias(c) for c in cols])
    return firsts.join(last, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def fill_if_empty(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str], default: str = "中") -> DataFrame:
    """existing and new keys; a field takes the incoming value where it is null, empty or the default. created marks new keys."""
    e, i = existing.alias("e"), incoming.alias("i")
    both = e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full")
    empty = lambda c: F.col(f"e.{c}").isNull() | F.col(f"e.{c}").isin("", default)
    value = lambda c: F.when(empty(c), F.coalesce(F.nullif(f"i.{c}", F.lit("")), F.col(f"e.{c}"))).otherwise(F.col(f"e.{c}"))
    return both.select(F.coalesce(f"e.{key}", f"i.{key}").alias(key), *[value(c).alias(c) for c in fields], F.col(f"e.{key}").isNull().alias("created"))


def record_evidence(editions: DataFrame, evidence: DataFrame, fields: list[str], cut: int = 2000) -> DataFrame:
    """The new evidence rows (event_id, field_name, field_value, source_url) of editions: a row a filled field, that is not
    in evidence yet."""
    long = editions.select("event_id", "source_url", *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(["event_id", "source_url"], fields, "field_name", "field_value")
    rows = long.filter(is_meaningful(F.col("field_value"))).withColumn("field_value", F.substring("field_value", 1, cut))
    keys = ["event_id", "field_name", "field_value", "source_url"]
    return rows.select(*keys).distinct().join(evidence, [rows[k].eqNullSafe(evidence[k]) for k in keys], "left_anti")


def consensus(observations: DataFrame, least: int = 2) -> DataFrame:
    """(entity_id, field, value, n_agree, n_domains) of values that least domains agree on, out of least domains or more.
    observations: entity_id, seq, domain, field, value; the first of each domain counts, and the first seen value wins a tie."""
    rows = observations.withColumn("m", F.min("seq").over(Window.partitionBy("entity_id", "domain"))).filter("seq = m")
    domains = rows.groupBy("entity_id").agg(F.count_distinct("domain").alias("n_domains"))
    by = rows.filter(is_meaningful(F.col("value"))).groupBy("entity_id", "field", "value").agg(F.count_distinct("domain").alias("n"), F.min("seq").alias("s"))
    best = by.groupBy("entity_id", "field").agg(F.max_by("value", F.struct("n", -F.col("s"))).alias("value"), F.max("n").alias("n_agree"))
    return best.join(domains, "entity_id").filter((F.col("n_domains") >= least) & (F.col("n_agree") >= least))


#: Fields of a candidate that a source of the same or a higher authority replaces, and those that only fill.
RANKED = ["signup_deadline", "event_start", "event_end", "registration_status"]
FILLING = ["organizer", "location", "mode"]


def merge_candidates(pairs: DataFrame) -> DataFrame:
    """pairs of struct columns a and b (title, RANKED, FILLING, source_authority, tags, evidence): what b knows replaces a's
    RANKED values if its authority is not lower, and fills gaps of all; tags are united, evidence is merged with b's
    winning. The rest is a's."""
    rank = lambda s: priority(F.lit(False), F.col(f"{s}.source_authority"))["r"]
    known = lambda s, c: F.when(F.col(f"{s}.{c}") != "", F.col(f"{s}.{c}"))
    ranked = [F.when(rank("b") >= rank("a"), F.coalesce(known("b", c), F.col(f"a.{c}"))).otherwise(F.coalesce(known("a", c), F.col(f"b.{c}"))).alias(c) for c in RANKED]
    filling = [F.coalesce(known("a", c), F.col(f"b.{c}")).alias(c) for c in FILLING]
    ev = F.map_zip_with("a.evidence", "b.evidence", lambda k, x, y: F.coalesce(y, x))
    return pairs.select("id", F.col("a.title").alias("title"), *ranked, *filling, F.array_union("a.tags", "b.tags").alias("tags"), ev.alias("evidence"), F.col("a.source_authority").alias("source_authority"))


def apply_follow_changes(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """profiles (user_id, focus array) with changes (user_id, seq, op add or remove, item) applied in order; no duplicates.

    An item stays where it was if nothing removed it, and else stands in the order of its first addition behind its last
    removal. Both are taken by item, combined before the shuffle; only the items that remain meet in a user's row."""
    removed = changes.filter("op = 'remove'").groupBy("user_id", "item").agg(F.max("seq").alias("gone"))
    added = changes.filter("op = 'add'").join(removed, ["user_id", "item"], "left").filter("gone is null or seq > gone")
    added = added.groupBy("user_id", "item").agg(F.min("seq").alias("seq"))
    own = profiles.select("user_id", F.posexplode("focus").alias("pos", "item"))
    stays = own.join(removed, ["user_id", "item"], "left_anti").select("user_id", F.lit(0).alias("k"), F.col("pos").cast("long").alias("seq"), "item")
    new = added.join(stays.select("user_id", "item").distinct(), ["user_id", "item"], "left_anti").select("user_id", F.lit(1).alias("k"), F.col("seq").cast("long"), "item")
    by = stays.unionByName(new).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("k", "seq", "item")))["item"].alias("focus"))
    return profiles.select("user_id").join(by, "user_id", "left").select("user_id", F.coalesce("focus", F.array().cast("array<string>")).alias("focus"))

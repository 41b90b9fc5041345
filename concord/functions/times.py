"""Column expressions over event times. now is always given; a time without an offset means what each function says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRICT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def parse_event_ts(c: Column) -> Column:
    """struct(ts, offset_sec) of ISO text with an explicit offset; nulls for anything else."""
    ok = c.rlike(_STRICT)
    zone = F.regexp_extract(c, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hours, minutes = F.regexp_extract(zone, r"(\d{2}):?\d{2}", 1).try_cast("int"), F.regexp_extract(zone, r"\d{2}:?(\d{2})", 1).try_cast("int")
    ts = F.try_to_timestamp(F.when(ok, c))
    offset = F.when(zone == "Z", 0).otherwise(sign * (hours * 3600 + minutes * 60))
    return F.struct(ts.alias("ts"), F.when(ts.isNotNull(), offset).alias("offset_sec"))


def coerce_ts(c: Column, zone: str = "UTC", end_of_day: bool = False) -> Column:
    """A timestamp from ISO text or a date (also with /): without an offset in zone; a bare date at its last second if asked."""
    c = F.regexp_replace(F.trim(c), r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    own = parse_event_ts(c)["ts"]
    local = F.try_to_timestamp(F.when(~c.rlike(r"(Z|[+-]\d{2}:?\d{2})$") | c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c))
    bare = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    local = F.when(bare & F.lit(end_of_day), local + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).otherwise(local)
    return F.coalesce(own, F.to_utc_timestamp(local, zone))


def days_remaining(ts: Column, offset_sec: Column, now: Column) -> Column:
    """Calendar days to ts in its own offset: -1 if past, 0 today, null if unknown."""
    shift = lambda t: F.to_date(F.timestamp_seconds(F.unix_timestamp(t) + offset_sec))
    return F.when(ts.isNull(), None).when(ts < now, -1).otherwise(F.datediff(shift(ts), shift(now)))


def status_of(ts: Column, now: Column) -> Column:
    """none, expired, closing (less than four times 24 h), open."""
    days = F.floor((F.unix_micros(ts) - F.unix_micros(now)) / F.lit(86400000000))
    return F.when(ts.isNull(), "none").when(days < 0, "expired").when(days <= 3, "closing").otherwise("open")


#: What the states are called: without a deadline, unclear, past, within four days, later.
STATES = {"none": "暂无本届信息", "unclear": "待确认", "expired": "已截止", "closing": "即将截止", "open": "报名中"}


def state_name(state: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return F.element_at(names, state)


def status_of_text(c: Column, now: Column) -> Column:
    """As status_of, of a deadline's text: none if null or empty, unclear if it is no time with an offset, expired as soon
    as it is past."""
    ts = parse_event_ts(c)["ts"]
    return F.when(c.isNull() | (c == ""), "none").when(ts.isNull(), "unclear").when(ts < now, "expired").otherwise(status_of(ts, now))


def timeline(deadline: Column, event: Column) -> Column:
    """The event's time, unless it lies before the deadline: nobody knows which of both is wrong."""
    return F.when(event < deadline, None).otherwise(event)


def epoch_to_iso(seconds: Column, zone: str = "Asia/Shanghai") -> Column:
    """Local ISO time, without an offset, of seconds since 1970."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), "yyyy-MM-dd'T'HH:mm:ss")


def refresh_status(df: DataFrame, deadline: str, status: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """df with the state that its deadline stands for now, and the rows whose state changes, with the new one. No row goes."""
    new = df.withColumn(status, state_name(status_of(F.col(deadline), now)))
    return new, df.withColumn("_new", state_name(status_of(F.col(deadline), now))).filter(~F.col("_new").eqNullSafe(F.col(status)))


def accept_by_time(deadline: Column, start: Column, end: Column, status: Column, now: Column, max_days: int = 400) -> Column:
    """The reason why an event is taken or not; the first rule that applies."""
    far = now + F.expr(f"INTERVAL {max_days} DAY")
    opened = status == "open"
    return (
        F.when(status == "closed", "closed_filtered")
        .when(deadline < now, "expired_filtered")
        .when((start < now) & ~F.coalesce(opened & (end >= now), F.lit(False)), "event_passed_filtered")
        .when((deadline > far) | (start > far) | (end > far), "too_far_future_filtered")
        .when((start < deadline) | (end < start), "invalid_date_filtered")
        .when(deadline.isNull() & start.isNull() & status.isNull(), "unverified_skipped")
        .when(deadline.isNull() & opened & (end >= now), "accepted")
        .when(deadline.isNull() & status.isin("open", "upcoming") & (start >= now), "accepted")
        .when(deadline >= now, "accepted")
        .otherwise("unverified_skipped")
    )


#: How the patterns of labelled_date write a date, and the same in one group.
_PARTS, _WHOLE = r"(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})", r"(\d{4}[年/-]\d{1,2}[月/-]\d{1,2})"


def labelled_date(text: Column, patterns: list[str], clock: str) -> Column:
    """The first match of the first pattern whose first match is a real date, as ISO text at +08:00. A pattern is searched
    for once, and only where none before it gave a date."""
    date = lambda p: F.translate(F.regexp_extract(text, p.replace(_PARTS, _WHOLE), 1), "年月/", "---")
    found = [F.date_format(F.try_to_date(date(p), "yyyy-M-d"), "yyyy-MM-dd") for p in patterns]
    return F.concat(F.coalesce(*found), F.lit(f"T{clock}+08:00"))


#: Labels of deadlines and of event dates, in order.
DEADLINES = [
    r"报名截止[：:]\s*(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})",
    r"截止日期[：:]\s*(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})",
    r"截止时间[：:]\s*(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})",
    r"(\d{4})[年/-](\d{1,2})[月/-](\d{1,2}).*截止",
    r"报名时间[：:].*?[至~-]\s*(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})",
]
EVENT_DATES = [
    r"比赛时间[：:]\s*(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})",
    r"活动时间[：:]\s*(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})",
    r"竞赛时间[：:]\s*(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})",
    r"举办时间[：:]\s*(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})",
    r"(\d{4})[年/-](\d{1,2})[月/-](\d{1,2}).*[举行举办开赛开始]",
]
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def range_dates(text: Column, year: int) -> Column:
    """struct(start, end) of 'AUG 22 - 24[, 2027]' or 'Jun 29 - Aug 3'; the year given where the text has none."""
    p = r"(?i)^\s*([a-z]{3})[a-z]*\s+(\d{1,2})\s*[-–]\s*(?:([a-z]{3})[a-z]*\s+)?(\d{1,2})(?:\s*,\s*(\d{4}))?\s*$"
    g = lambda i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    month = lambda c: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(c)).cast("int"), F.lit(0))
    y = F.coalesce(g(5).try_cast("int"), F.lit(year))
    at = lambda m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d.try_cast("int")), "yyyy-MM-dd")
    return F.struct(at(month(g(1)), g(2)).alias("start"), at(month(F.coalesce(g(3), g(1))), g(4)).alias("end"))


def event_date_iso(c: Column) -> Column:
    """A leading date as midnight at +08:00; other text as it is."""
    day = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    return F.when(day.isNotNull(), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00+08:00"))).otherwise(c)

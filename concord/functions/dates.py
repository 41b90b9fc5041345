"""Dates in free text: two-date, context-scored and range extraction, and which of them counts.

Every function takes a text column and gives a struct of ISO dates (yyyy-MM-dd) or null. Impossible dates are no dates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English names of months, and their numbers.
MONTH_NAMES = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
#: Patterns of the two-date rule and the groups of year, month and day (0: the given year); month names where
#: the last is true. English ones first.
TWO_DATES_EN = [
    (r"(?i)registration\s+deadline[:\s]*(\d{4})[/-](\d{1,2})[/-](\d{1,2})", (1, 2, 3), False),
    (r"(?i)deadline[:\s]*([A-Z][a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})", (3, 1, 2), True),
    (r"(?i)apply\s+by[:\s]*([A-Z][a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})?", (3, 1, 2), True),
    (r"(?i)(?:event|hackathon)\s+(?:starts?|begins?|date)[:\s]*(\d{4})[/-](\d{1,2})[/-](\d{1,2})", (1, 2, 3), False),
    (r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3), False),
]
TWO_DATES_CN = [
    r"报名截止[：:]\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日",
    r"报名时间[：:].*?(?:至|到|-|–).*?(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日",
    r"(?:比赛|活动|举办)时间[：:]\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日",
    r"(?i)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*(?:至|到|-|–)\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*(?:注册|截止|报名|deadline)",
    r"(\d{4})/(\d{1,2})/(\d{1,2})",
]
EVENT_DATE_CN = TWO_DATES_CN[2]
#: Words near a deadline, an event's date, an opening and a closing.
DEADLINE_WORDS = [
    "registration deadline", "application deadline", "apply by", "registration closes", "deadline", "submission deadline",
    "报名截止", "截止日期", "截止时间", "注册截止", "applications close", "register by", "sign up by",
]
EVENT_WORDS = [
    "event date", "hackathon date", "event starts", "starts", "begins", "event will be held", "taking place", "scheduled for",
    "比赛时间", "活动时间", "举办时间", "开始时间", "happening on", "dates:", "when:",
]
OPEN_WORDS = [
    "registration open", "applications open", "apply now", "register now", "submit your project", "sign up today",
    "open for registration", "now accepting", "报名中", "开放报名", "正在报名", "火热报名", "opens on", "registration starts",
    "applications open on", ">Register<", ">Apply Now<", ">Apply<", ">Register Now<", ">Sign Up<", ">Join Now<",
]
CLOSED_WORDS = [
    "registration closed", "applications closed", "registration has ended", "submissions closed", "no longer accepting",
    "报名已截止", "报名结束", "已截止", "报名关闭", "event has ended", "event ended", "past event",
]
#: Forms of a date, and the groups of year, month and day; month names where the last is true.
SCORED_DATES = [
    (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", (1, 2, 3), False),
    (r"([A-Z][a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})", (3, 1, 2), True),
    (r"(\d{1,2})\s+([A-Z][a-z]+)\s+(\d{4})", (3, 2, 1), True),
    (r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", (1, 2, 3), False),
]
#: Forms of a range of dates, with the number of groups.
RANGES = [
    (r"(\w+ \d{1,2})\s*[-–]\s*(\w+ \d{1,2}),?\s*(\d{4})", 3),
    (r"(\w+ \d{1,2})\s*[-–]\s*(\d{1,2}),?\s*(\d{4})", 3),
    (r"(\w+ \d{1,2})\s*to\s*(\w+ \d{1,2}),?\s*(\d{4})", 3),
    (r"(\w+ \d{1,2})\s*[-–]\s*(\w+ \d{1,2})", 2),
    (r"(\d{1,2})\s*[-–]\s*(\d{1,2})\s+(\w+)\s+(\d{4})", 4),
    (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})\s*[-–]\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})", 6),
    (r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*[-–到至]\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", 6),
    (r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*[-–到至]\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", 5),
]
#: Characters of context on either side of a date.
NEAR = 100


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def month_number(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in MONTH_NAMES.items() for x in kv])
    return F.element_at(names, F.lower(F.trim(name)))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd of whole numbers, null if there is no such day."""
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd").cast("string")


def hits(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<m, g array<string>, before int>> of all matches of a pattern: the match, its groups and how many
    characters lie before it, added up over the pieces between the matches."""
    p = F.lit(pattern)
    pieces = F.arrays_zip(
        F.split(text, pattern).alias("piece"),
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
        *[F.regexp_extract_all(text, p, F.lit(i)).alias(f"g{i}") for i in range(1, groups + 1)],
    )
    empty = F.array().cast("array<struct<m:string,g:array<string>,before:int>>")

    def step(a: Column, x: Column) -> Column:
        before = a["at"] + F.length(x["piece"])
        own = F.struct(x["m"].alias("m"), F.array(*[x[f"g{i}"] for i in range(1, groups + 1)]).alias("g"), before.alias("before"))
        return F.struct(
            F.when(x["m"].isNull(), a["out"]).otherwise(F.array_append(a["out"], own)).alias("out"), (before + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at")
        )

    return F.aggregate(pieces, F.struct(empty.alias("out"), F.lit(0).alias("at")), step, lambda a: a["out"])


def _date_of(g: Column, places: tuple[int, int, int], named: bool, year: int | None = None) -> Column:
    y, m, d = (F.get(g, F.lit(i - 1)) for i in places)
    if year is not None:
        y = F.when(y == "", F.lit(str(year))).otherwise(y)
    return iso_date(y, month_number(m).cast("string") if named else m, d)


def two_dates(text: Column, year: int) -> Column:
    """struct(signup_deadline, event_time, has_full_deadline): the first date of the English patterns, in their order, and
    the next other one; else by the Chinese patterns. year stands in where 'apply by' has none."""
    found = []
    for pattern, places, named in TWO_DATES_EN:
        dates = F.transform(hits(text, pattern, 3), lambda h: F.struct(_date_of(h["g"], places, named, year).alias("d"), F.lit(not named).alias("full")))
        found.append(F.filter(dates, lambda x: x["d"].isNotNull()))
    got = lambda p, i: F.regexp_extract(text, p, i)
    cn, early = [], F.lit(None).cast("string")
    for p in TWO_DATES_CN:
        if "(?:注册" in p:
            early = iso_date(got(p, 1), got(p, 2), got(p, 3))
            cn.append(iso_date(got(p, 4), got(p, 5), got(p, 6)))
        else:
            cn.append(iso_date(got(p, 1), got(p, 2), got(p, 3)))
    own_event = iso_date(*(got(EVENT_DATE_CN, i) for i in (1, 2, 3)))
    at_range = next(i for i, p in enumerate(TWO_DATES_CN) if "(?:注册" in p)

    def result(x: Column) -> Column:
        first, chinese = F.get(x["every"], F.lit(0)), F.get(F.filter(x["cn"], lambda c: c.isNotNull()), F.lit(0))
        by_range = F.forall(F.slice(x["cn"], 1, at_range), lambda c: c.isNull()) & F.get(x["cn"], F.lit(at_range)).isNotNull()
        return let(
            F.struct(first["d"].alias("d"), first["full"].alias("full"), chinese.alias("cn")),
            lambda y: F.struct(
                F.coalesce(y["d"], y["cn"]).alias("signup_deadline"),
                F.coalesce(
                    F.get(F.filter(x["every"], lambda z: z["d"] != y["d"]), F.lit(0))["d"],
                    F.when(y["d"].isNull() & by_range & (x["early"] != y["cn"]), x["early"]),
                    x["event"],
                ).alias("event_time"),
                F.when(y["d"].isNotNull(), y["full"]).otherwise(y["cn"].isNotNull()).alias("has_full_deadline"),
            ),
        )

    return let(F.struct(F.concat(*found).alias("every"), F.array(*cn).alias("cn"), early.alias("early"), own_event.alias("event")), result)


def _around(text: Column, h: Column) -> Column:
    """The text from NEAR characters before a match to NEAR behind it, in lower case."""
    start = F.greatest(h["before"] - NEAR, F.lit(0))
    return F.lower(F.substring(text, start + 1, h["before"] - start + F.length(h["m"]) + NEAR))


def _count(context: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [context.contains(w).cast("int") for w in words])


def scored_dates(text: Column) -> Column:
    """array<struct<date, deadline_score, event_score, open_score, closed_score>> of every date, with how many words of
    each kind stand around it; forms in their order, then places."""
    found = []
    for pattern, places, named in SCORED_DATES:
        near = F.transform(hits(text, pattern, 3), lambda h: F.struct(_date_of(h["g"], places, named).alias("date"), _around(text, h).alias("near")))
        kinds = {"deadline_score": DEADLINE_WORDS, "event_score": EVENT_WORDS, "open_score": OPEN_WORDS, "closed_score": CLOSED_WORDS}
        found.append(F.transform(near, lambda x: F.struct(x["date"].alias("date"), *[_count(x["near"], w).alias(k) for k, w in kinds.items()])))
    return F.filter(F.concat(*found), lambda x: x["date"].isNotNull())


def assign_dates(scored: Column) -> Column:
    """struct(signup_deadline, event_start, registration_open_time): for each role the date with the highest score above 0,
    the first of equals, that no earlier role has taken."""
    def best(placed: Column, score: str, *taken: Column) -> Column:
        free = lambda d: reduce(lambda a, b: a & b, [~d.eqNullSafe(t) for t in taken], F.lit(True))
        ranked = F.transform(
            F.filter(placed, lambda p: (p["x"][score] > 0) & free(p["x"]["date"])),
            lambda p: F.struct(p["x"][score].alias("s"), (-p["i"]).alias("i"), p["x"]["date"].alias("date")),
        )
        return F.array_max(ranked)["date"]

    def roles(p: Column) -> Column:
        return let(best(p, "deadline_score"), lambda d: let(best(p, "event_score", d), lambda s: F.struct(
            d.alias("signup_deadline"), s.alias("event_start"), best(p, "open_score", d, s).alias("registration_open_time")
        )))

    return let(F.transform(scored, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), roles)


def ranges(text: Column, year: int) -> Column:
    """struct(signup_deadline, event_start, event_end) from ranges of dates. The end of a range near words of deadlines is a
    deadline; the ends of one near words of events, or near neither, are the event's. A range without a year takes the
    first from 2020 on around it or at the head of the text, else the given one."""
    digits = lambda c: F.regexp_extract(c, r"\d+", 0)
    first_word = lambda c: F.substring_index(c, " ", 1)
    found = []
    for pattern, n in RANGES:

        def dates(h: Column, near: Column) -> tuple[Column, Column]:
            g = lambda i: F.get(h["g"], F.lit(i))
            if n == 2:
                seen = F.regexp_extract(F.concat(near, F.lit(" "), F.substring(text, 1, 500)), r"\b(20[2-9]\d)\b", 1)
                y = F.when(seen == "", F.lit(str(year))).otherwise(seen)
                m, k = month_number(first_word(g(0))), month_number(first_word(g(1)))
                both = m.isNotNull() & k.isNotNull()
                return tuple(F.when(both, iso_date(y, x.cast("string"), digits(g(i)))) for i, x in enumerate((m, k)))
            if n == 3:
                m = month_number(first_word(g(0))).cast("string")
                return iso_date(g(2), m, digits(g(0))), iso_date(g(2), m, digits(g(1)))
            if n == 4:
                m = month_number(g(2)).cast("string")
                return iso_date(g(3), m, g(0)), iso_date(g(3), m, g(1))
            if n == 5:
                return iso_date(g(0), g(1), g(2)), iso_date(g(0), g(3), g(4))
            return iso_date(g(0), g(1), g(2)), iso_date(g(3), g(4), g(5))

        def one(h: Column) -> Column:
            def placed(near: Column) -> Column:
                start, end = dates(h, near)
                return F.struct(start.alias("start"), end.alias("end"), (_count(near, DEADLINE_WORDS) > 0).alias("late"), (_count(near, EVENT_WORDS) > 0).alias("event"))

            return let(let(_around(text, h), placed), lambda x: F.struct(
                F.when(x["late"], x["end"]).alias("deadline"),
                F.when(x["event"] | ~x["late"], x["start"]).alias("start"),
                F.when(x["event"] | ~x["late"], x["end"]).alias("end"),
            ))

        found.append(F.transform(hits(text, f"(?iU){pattern}", n), one))
    first = lambda every, c: F.get(F.filter(F.transform(every, lambda x: x[c]), lambda x: x.isNotNull()), F.lit(0))
    return let(F.concat(*found), lambda e: F.struct(
        first(e, "deadline").alias("signup_deadline"), first(e, "start").alias("event_start"), first(e, "end").alias("event_end")
    ))


def resolve_dates(range_: Column, context: Column, deadline: Column, start: Column, end: Column) -> Column:
    """struct(signup_deadline, event_start, event_end): of a range, else by context, else as the candidate has it. Context
    knows no end."""
    return let(F.struct(range_.alias("r"), context.alias("c")), lambda x: F.struct(
        F.coalesce(x["r"]["signup_deadline"], x["c"]["signup_deadline"], deadline).alias("signup_deadline"),
        F.coalesce(x["r"]["event_start"], x["c"]["event_start"], start).alias("event_start"),
        F.coalesce(x["r"]["event_end"], end).alias("event_end"),
    ))

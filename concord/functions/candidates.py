"""Candidates of events: which source found them, how far it can be trusted, and which of their fields are there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import text as X

#: Keys of the platforms in their order, and what the domain of each holds.
PLATFORMS = {"devfolio": ["devfolio"], "mlh": ["mlh.io", "mlh.com"], "hackclub": ["hackclub"], "devpost": ["devpost"]}
#: The source of what no platform found, and of what has no URL.
GENERAL, UNKNOWN = "general_search", "unknown"
#: Names shown for domains, in order.
NAMES = {"devpost": "Devpost", "devfolio": "Devfolio", "mlh.io": "MLH"}
#: Parts of domains that are of high authority, and the words for authority.
HIGH_DOMAINS = ["devpost.com", "devfolio.co", "mlh.io", ".edu", ".edu.cn", ".ac.", ".ac.cn", ".gov", ".gov.cn"]
AUTHORITY_WORDS = {"high": "高", "medium": "中", "low": "低", "高": "高", "中": "中", "低": "低"}
#: Paths of a platform that hold no event of their own.
PROJECT_PATHS = ["/software/", "/updates/", "/submit-to/", "/submissions", "/manage/", "/discussions/", "/participants", "/judging", "/rules", "/prizes", "/resources", "/gallery"]
#: Fields that other sources can fill, and those of them without which a row must be verified.
VERIFIABLE = ["signup_deadline", "event_time", "contest_level", "organizer", "summary"]
CRITICAL = ["signup_deadline", "event_time"]

_text = lambda c: F.coalesce(c, F.lit(""))
_any = lambda conditions: reduce(lambda a, b: a | b, conditions)
_holds = lambda c, parts: _any([c.contains(p) for p in parts])


def domain(url: Column) -> Column:
    """The authority part of a URL in lower case, port included; '' where there is none."""
    return F.lower(F.regexp_extract(_text(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def platform_of(url: Column) -> Column:
    """The key of the platform that a URL's domain belongs to, else GENERAL; UNKNOWN without a URL."""
    keys = [F.when(_holds(domain(url), parts), key) for key, parts in PLATFORMS.items()]
    return F.when(_text(url) == "", UNKNOWN).otherwise(F.coalesce(*keys, F.lit(GENERAL)))


def candidate_source(discovered_from: Column, source_name: Column, url: Column) -> Column:
    """The key of the source that first found a candidate: by how it was discovered or its source's exact name, else by
    words in them, else by its URL."""
    found, name = F.lower(_text(discovered_from)), F.lower(_text(source_name))
    exact = [F.when(found.startswith(key) | (name == key), key) for key in (*PLATFORMS, GENERAL)]
    general = F.when(name.contains("websearch") | found.contains("general"), GENERAL)
    within = [F.when(name.contains(key), key) for key in PLATFORMS if key != "mlh"]  # three letters are too few to be looked for
    return F.coalesce(*exact, general, *within, platform_of(url))


def source_label(name: Column, url: Column) -> Column:
    """A source's name, 80 characters at most: the given one, else that of the URL's domain, else the domain."""
    given = F.when(~_text(name).isin("", UNKNOWN), name)
    named = [F.when(domain(url).contains(part), label) for part, label in NAMES.items()]
    return F.substring(F.coalesce(given, *named, domain(url)), 1, 80)


def authority(word: Column, url: Column) -> Column:
    """The authority that a word stands for, else what the URL's domain deserves."""
    words = F.create_map(*[F.lit(x) for kv in AUTHORITY_WORDS.items() for x in kv])
    return F.coalesce(F.element_at(words, F.lower(F.trim(_text(word)))), F.when(_holds(domain(url), HIGH_DOMAINS), "高").otherwise("中"))


def is_structured(title: Column, start: Column, end: Column, deadline: Column, word: Column) -> Column:
    """Whether a listing told enough of an event to judge it without its page: a title, a date, and some authority."""
    dated = _any([_text(d.cast("string")) != "" for d in (start, end, deadline)])
    return (F.trim(_text(title)) != "") & dated & _text(word).isin("high", "medium")


def candidate_kind(title: Column, start: Column, end: Column, deadline: Column, word: Column, url: Column) -> Column:
    """structured (judged by its own fields), listing (its page lists events) or detail (its page tells of one)."""
    return F.when(is_structured(title, start, end, deadline, word), "structured").when(X.is_listing_url(url), "listing").otherwise("detail")


def is_event_url(url: Column, excluded: list[str] = PROJECT_PATHS) -> Column:
    """Whether a platform's URL has none of the excluded paths."""
    return ~_text(url).rlike(X.any_of(excluded))


def is_generic_page(title: Column, text: Column, expected: Column, home: str, mark: str, detail: str) -> Column:
    """Whether a page is the platform's own instead of an event's: its title starts with home; or its text, under 200
    characters, has the mark; or its text, under 600, has neither the first eight characters of the expected title nor
    the word that details stand under. Without an expected title the last rule does not apply; null counts as empty."""
    text, head = _text(text), F.substring(_text(expected), 1, 8)
    lost = (head != "") & ~text.contains(head) & ~text.contains(detail) & (F.length(text) < 600)
    return _text(title).startswith(home) | ((F.length(text) < 200) & text.contains(mark)) | lost


def missing_fields(fields: dict[str, Column]) -> Column:
    """The names of the fields that are null, blank or empty collections, in their order."""

    def gone(c: Column) -> Column:
        return F.trim(_text(c.cast("string"))).isin("", "[]", "{}")

    return F.array_compact(F.array(*[F.when(gone(c), name) for name, c in fields.items()]))


def external_links(html: Column, own: list[str]) -> Column:
    """The distinct absolute links of a page, in order, to hosts that start with none of own."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)href="(https?://[^"]+)"'), 1)
    return F.filter(F.array_distinct(found), lambda u: ~F.regexp_extract(F.lower(u), r"^https?://(.*)$", 1).rlike("^(?:" + X.quoted([o.lower() for o in own]) + ")"))


def visible_lines(html: Column) -> Column:
    """The lines of a page's text that are not blank, in order: control characters, scripts, styles and noscripts gone, tags
    too, entities undone, white space squeezed."""
    c = F.regexp_replace(html, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    c = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?s)<[^>]+>", "")
    for code, raw in X.ENTITIES.items():
        c = F.replace(c, F.lit(code), F.lit(raw))
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[\s\xA0]+", " ")))
    return F.filter(lines, lambda x: x != "")


def platform_page_title(html: Column, suffix: str, home: str) -> Column:
    """The title of a platform's page without the platform's suffix (a pattern); '' for its home page or without a title."""
    raw = X.html_text(F.regexp_extract(_text(html), r"(?is)<title[^>]*>(.*?)</title>", 1))
    title = F.trim(F.regexp_replace(raw, f"(?:{suffix})$", ""))
    return F.when(title.startswith(home), "").otherwise(title)

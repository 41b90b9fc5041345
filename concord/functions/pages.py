"""Records out of landed pages: listings, article pages, event cards, embedded state and described events.

A block is an element with all that is nested in it: the page is cut where its tags begin, and a block goes on until as
many elements of its kind are closed as were opened. Where a page has no such marks, its visible lines are read. Each
function gives an array of structs in page order, or one struct, with null for what a page does not say.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import text as X
from concord.functions.dates import let
from concord.functions.times import epoch_to_iso, range_dates

#: The base of relative links of an article list.
ARTICLE_BASE = "https://weixin.sogou.com"
#: What an attendance mode's address ends with, and what it is called.
MODES = {"OnlineEventAttendanceMode": "online", "OfflineEventAttendanceMode": "offline", "MixedEventAttendanceMode": "hybrid"}


def one(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match of a pattern without its tags, unescaped and trimmed; null if there is none or it is empty."""
    return F.nullif(F.trim(X.html_text(F.regexp_replace(F.regexp_extract(c, pattern, group), "<[^>]+>", ""))), F.lit(""))


def raw(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def absolute(href: Column, base: str) -> Column:
    """A link with its base; links that have a scheme stay."""
    return F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(href, "^/+", ""))
    )


def element_blocks(html: Column, tags: str, opening: str) -> Column:
    """array<string> of the outermost elements of a page whose opening tag is of one of tags (an alternation) and fits the
    pattern opening: the tag and what is nested in the element, without its closing tag. An element that is never closed
    goes on to the end; closing tags that close nothing are passed over."""
    parts = F.split(html, rf"(?i)(?=</?(?:{tags})\b)", -1)
    name = lambda c: F.lower(F.regexp_extract(c, r"^</?(\w+)", 1))
    start = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("n"))

    def step(s: Column, x: Column, kind: Column) -> Column:
        change = F.when(name(x) != kind, 0).when(x.startswith("</"), -1).otherwise(1)
        depth = F.when(s["depth"] == 0, 0).otherwise(s["depth"] + change)
        return F.struct(depth.alias("depth"), F.when(depth > 0, s["n"] + 1).otherwise(s["n"]).alias("n"))

    def read(ps: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(ps)), lambda i: F.element_at(ps, i).rlike(opening) & ~F.element_at(ps, i).startswith("</"))

        def block(i: Column) -> Column:
            rest = F.slice(ps, i + 1, F.size(ps))
            return F.struct(i.alias("i"), F.aggregate(rest, start, lambda s, x: step(s, x, name(F.element_at(ps, i))))["n"].alias("n"))

        none = F.array().cast("array<struct<i:int,n:int>>")
        inside = lambda kept, b: (F.size(kept) > 0) & (b["i"] < F.element_at(kept, -1)["i"] + F.element_at(kept, -1)["n"])
        outer = F.aggregate(F.transform(at, block), none, lambda kept, b: F.when(F.coalesce(inside(kept, b), F.lit(False)), kept).otherwise(F.array_append(kept, b)))
        return F.transform(outer, lambda b: F.array_join(F.slice(ps, b["i"], b["n"]), ""))

    return let(F.coalesce(parts, F.array().cast("array<string>")), lambda ps: F.when(F.size(ps) > 0, read(ps)))


def article_list(html: Column, base: str = ARTICLE_BASE) -> Column:
    """array<struct<title, url, summary, publisher, publish_time>> of a list's items that have a linked title. Times are
    seconds since 1970 in a script, given as ISO text at +08:00."""
    items = element_blocks(html, "li", r"(?i)^<li\b")

    def item(b: Column) -> Column:
        at = raw(b, r"timeConvert\(['\"]?(\d+)['\"]?\)").try_cast("long")
        return F.struct(
            one(b, r"(?is)<h3[^>]*>.*?<a\b[^>]*>(.*?)</a>").alias("title"),
            absolute(raw(b, r'(?is)<h3[^>]*>.*?<a\b[^>]*href="([^"]*)"'), base).alias("url"),
            one(b, r'(?is)<p\b[^>]*class="[^"]*txt-info[^"]*"[^>]*>(.*?)</p>').alias("summary"),
            one(b, r'(?is)<span\b[^>]*class="[^"]*all-time-y2[^"]*"[^>]*>(.*?)</span>').alias("publisher"),
            F.concat(epoch_to_iso(at), F.lit("+08:00")).alias("publish_time"),
        )

    return F.filter(F.transform(items, item), lambda x: x["title"].isNotNull() & x["url"].isNotNull())


def article_page(html: Column) -> Column:
    """struct<title, author, publish_time, body, biz, mid, idx, sn> of an article's page; null without a body."""
    content = F.get(element_blocks(html, "div", r'(?is)^<div\b[^>]*id="js_content"'), F.lit(0))
    body = F.nullif(F.trim(X.html_text(content)), F.lit(""))
    value = lambda name, grammar: raw(html, rf"(?s)\b{name}\s*=\s*['\"]({grammar})['\"]")
    at = raw(html, r"\bct\s*=\s*['\"](\d{9,11})['\"]").try_cast("long")
    page = F.struct(
        F.coalesce(one(html, r'(?is)<h1\b[^>]*id="activity-name"[^>]*>(.*?)</h1>'), X.page_title(html)).alias("title"),
        F.coalesce(one(html, r'(?is)<[^>]*id="js_name"[^>]*>(.*?)</'), X.meta_content(html, "author")).alias("author"),
        F.concat(epoch_to_iso(at), F.lit("+08:00")).alias("publish_time"),
        body.alias("body"),
        value("biz", r"[A-Za-z0-9+/=]+").alias("biz"), value("mid", r"\d+").alias("mid"), value("idx", r"\d+").alias("idx"), value("sn", r"[0-9a-f]+").alias("sn"),
    )
    return F.when(body.isNotNull(), page)


#: Where a listing of events begins, how much of it is read, lines that are no titles, modes, and months.
LISTING, LISTING_CHARS = "Upcoming Events", 50_000
NOISE = [
    "Menu", "MLH", "Major League Hacking", "Upcoming Events", "Apply", "Login", "Sign up", "Register", "About", "Contact", "Privacy", "Terms", "Cookie", "Season",
    "Events", "Sponsors", "Community", "Fellowship", "Top 50", "Hackathon", "©", "All rights",
]
LINE_MODES, MONTHS = ["Digital", "In-Person", "Hybrid", "Online", "Virtual"], "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def listed_events(html: Column) -> Column:
    """array<struct<title, date_text, location, mode>> of the visible lines of a listing: a title is a line of 3 to 80
    characters with a space, not all capitals; of the lines up to the next title the last range of days is its date, the
    first 'City, Country' its location and the last mode its mode."""
    at = F.greatest(F.locate(LISTING, html), F.locate(LISTING.lower(), html), F.lit(1))
    shown = F.regexp_replace(F.substr(html, at, F.lit(LISTING_CHARS)), r"(?s)<(svg|script)[^>]*>.*?</\1>", "")
    raw = F.transform(F.split(shown, "<[^>]+>"), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    wanted = F.filter(raw, lambda x: (F.length(x) > 2) & ~x.rlike(r"^\d{4}$") & ~x.isin(NOISE))

    def kind(x: Column) -> Column:
        date = x.rlike(rf"(?i)^({MONTHS})\s+\d{{1,2}}\s*[-–]\s*\d{{1,2}}(,\s*\d{{4}})?$")
        place = x.rlike(r"^[A-Z][a-z]+.*,\s*[A-Z]([A-Z]|[a-z]+)")
        title = F.length(x).between(3, 80) & x.contains(" ") & ~((F.upper(x) == x) & (F.lower(x) != x))
        return F.when(date, "date").when(place, "place").when(x.isin(LINE_MODES), "mode").when(title, "title").otherwise("")

    def read(ls: Column) -> Column:
        titles = F.filter(F.transform(ls, lambda x, i: F.when(x["kind"] == "title", i + 1)), lambda i: i.isNotNull())

        def event(i: Column) -> Column:
            end = F.coalesce(F.array_min(F.filter(titles, lambda j: j > i)), F.size(ls) + 1)
            window = F.slice(ls, i + 1, end - i - 1)
            of = lambda k: F.transform(F.filter(window, lambda x: x["kind"] == k), lambda x: x["line"])
            last = lambda c: F.get(c, F.size(c) - 1)
            return F.struct(F.element_at(ls, i)["line"].alias("title"), last(of("date")).alias("date_text"), F.get(of("place"), F.lit(0)).alias("location"), F.lower(last(of("mode"))).alias("mode"))

        return F.transform(titles, event)

    return let(F.transform(wanted, lambda x: F.struct(x.alias("line"), kind(x).alias("kind"))), read)


def event_cards(html: Column, listing: Column | None = None) -> Column:
    """array<struct<name, url, start, end, mode, location>> of a page's schema.org event cards that have an address: the
    card's own url, else its link. Without any card, the events of its visible lines, whose url is that of the listing
    and whose start is the text of their dates."""
    cards = element_blocks(html, "a|div", r'(?is)^<(?:a|div)\b[^>]*itemtype="https?://schema\.org/Event"')
    prop = lambda b, name: raw(b, rf'(?is)<meta\b[^>]*itemprop="{name}"[^>]*content="([^"]*)"')
    modes = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])

    def card(b: Column) -> Column:
        return F.struct(
            one(b, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>").alias("name"), F.coalesce(prop(b, "url"), raw(b, r'(?is)^<[^>]*href="([^"]*)"')).alias("url"),
            prop(b, "startDate").alias("start"), prop(b, "endDate").alias("end"), F.element_at(modes, F.substring_index(prop(b, "eventAttendanceMode"), "/", -1)).alias("mode"),
            one(b, r'(?is)<span\b[^>]*itemprop="name"[^>]*>(.*?)</span>').alias("location"),
        )

    found = F.filter(F.transform(cards, card), lambda x: x["url"].isNotNull())
    own = F.lit(None).cast("string") if listing is None else listing
    none = F.lit(None).cast("string")
    other = F.transform(listed_events(html), lambda e: F.struct(e["title"].alias("name"), own.alias("url"), e["date_text"].alias("start"), none.alias("end"), e["mode"].alias("mode"), e["location"].alias("location")))
    return F.when(F.size(found) > 0, found).otherwise(other)


STATE = "array<struct<name:string,title:string,slug:string,url:string,starts_at:string,start_date:string,ends_at:string,end_date:string,status:string,state:string>>"


#: Words of a state, and how far before one its event's name stands.
STATES, BEFORE = "Open|Upcoming|Live|Closed|Registration", 500


def events_near_states(html: Column, listing: Column) -> Column:
    """array<struct<name, url, start, end, status>> of the visible page: for each word of a state the nearest heading in the
    BEFORE characters before it, else the nearest element of a title class, else the nearest line of 5 to 120 characters
    if it says hackathon; the first of a name stays, names of under 5 characters go. url is that of the listing."""
    shown = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", "")
    last = lambda c: F.get(c, F.size(c) - 1)
    none = F.lit(None).cast("string")

    def read(ps: Column) -> Column:
        def near(k: Column) -> Column:
            first = F.greatest(F.lit(1), k - BEFORE // 4)  # a word of a state has four characters or more
            before = F.right(F.array_join(F.slice(ps, first, k - first), ""), F.lit(BEFORE))
            heads = F.regexp_extract_all(before, F.lit("<h[1-6][^>]*>(.*?)</h[1-6]>"), 1)
            classes = F.regexp_extract_all(before, F.lit('(?i)class="[^"]*title[^"]*"[^>]*>(.*?)<'), 1)
            lines = F.filter(F.transform(F.split(before, "<[^>]+>"), lambda x: F.trim(x)), lambda x: F.length(x).between(5, 120))
            plain = F.when(F.lower(last(lines)).contains("hackathon"), last(lines))
            marked = F.coalesce(last(heads), last(classes))
            name = F.when(marked.isNotNull(), F.trim(F.regexp_replace(marked, "<[^>]+>", ""))).otherwise(plain)
            return F.struct(name.alias("name"), listing.alias("url"), none.alias("start"), none.alias("end"), F.regexp_extract(F.element_at(ps, k), f"(?i)^({STATES})", 1).alias("status"))

        each = F.transform(F.filter(F.sequence(F.lit(1), F.size(ps)), lambda k: F.element_at(ps, k).rlike(f"(?i)^(?:{STATES})")), near)
        good = F.filter(each, lambda e: F.length(e["name"]) >= 5)
        names = F.transform(good, lambda e: e["name"])
        return F.filter(F.transform(good, lambda e, i: F.when(F.array_position(names, e["name"]) == i + 1, e)), lambda e: e.isNotNull())

    return let(F.split(shown, f"(?i)(?={STATES})", -1), lambda ps: F.when(F.size(ps) > 0, read(ps)))


def page_state(html: Column, base: str, script: str = "__NEXT_DATA__", path: str = "$.props.pageProps.hackathons") -> Column:
    """array<struct<name, url, start, end, status>> of the events in a page's embedded JSON, whose fields go by several names.
    Without such JSON, or without a name in it, the events of the visible page near a word of a state."""
    rows = F.from_json(F.get_json_object(F.regexp_extract(html, rf'(?is)<script id="{script}"[^>]*>(.*?)</script>', 1), path), STATE)
    stated = F.filter(F.transform(rows, lambda e: F.struct(
        F.coalesce(e["name"], e["title"]).alias("name"), F.coalesce(e["url"], absolute(e["slug"], base)).alias("url"), F.coalesce(e["starts_at"], e["start_date"]).alias("start"),
        F.coalesce(e["ends_at"], e["end_date"]).alias("end"), F.coalesce(e["status"], e["state"]).alias("status"),
    )), lambda e: e["name"].isNotNull())
    return F.when(F.size(stated) > 0, stated).otherwise(events_near_states(html, F.lit(base)))


def described_events(text: Column, year: int) -> Column:
    """array<struct<name, start, end>> of 'Name (Aug 22 - 24), Other (Jun 29 - Aug 3)'; null dates where the brackets hold
    none."""
    p = F.lit(r"([A-Z][^(),]*?)\s*\(([^)]*)\)")
    both = F.arrays_zip(F.regexp_extract_all(text, p, 1).alias("n"), F.regexp_extract_all(text, p, 2).alias("d"))

    def event(e: Column) -> Column:
        got = range_dates(e["d"], year)
        return F.struct(e["n"].alias("name"), got["start"].alias("start"), got["end"].alias("end"))

    return F.transform(both, event)

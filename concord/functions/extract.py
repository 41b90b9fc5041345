"""Column expressions that take fields out of text, and classify it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.text import account_key, any_of, is_listing_url, light_key, nfkc, url_key
from concord.functions.times import coerce_ts

#: Levels and their patterns, in order.
LEVELS = [("国家级", r"国家[级际]|全国"), ("省级", r"省[级际]|全省"), ("校级", r"校[级际]|全校|南京大学.*主办"), ("院级", r"院[级际]|书院.*主办|学院.*主办")]
#: Organiser patterns.
ORGANIZERS = [r"主办(?:方|单位)[：:]\s*([^\n。，,]{4,40})", r"承办(?:方|单位)[：:]\s*([^\n。，,]{4,40})", r"由\s*([^\n。，,]{3,30})\s*主办"]
ORGANIZERS_BOTH = [
    r"(?:organi[zs]ed|hosted|presented)\s+by[:\s]*([^\n.,;]{4,60})",
    r"(?:主办|承办)(?:方|单位)?[：:]\s*([^\n。，,]{4,40})",
    r"由\s*([^\n。，,]{3,30})\s*(?:主办|承办|组织)",
]
#: Tags and their patterns.
TAGS = [
    (r"\bai\b|人工智能|artificial intelligence", "AI"), (r"\bweb3\b|区块链|blockchain", "Web3"), (r"线上|online|virtual|remote", "线上"),
    (r"线下|offline|in[\s-]person|on[\s-]site", "线下"), (r"开源|open[\s-]source", "开源"), (r"\bml\b|machine learning|机器学习", "机器学习"),
    (r"社会公益|social good|impact", "公益"),
]
#: Registration status, first and second rule set.
CLOSED_1 = [
    r"registration\s+(is\s+)?(closed|has\s+ended|ended)", r"报名\s*(已|已经)?\s*(结束|关闭|截止)", r"applications?\s+(are\s+)?closed",
    r"submissions?\s+(are\s+)?closed", r"no\s+longer\s+accepting", r"event\s+has\s+ended", r"活动\s*(已|已经)?\s*结束",
]
OPEN_1 = [
    r"registration\s+(is\s+)?(open|now\s+open)", r"报名\s*(正在|火热|开放|进行)", r"applications?\s+(are\s+)?(open|now\s+open)",
    r"apply\s+now", r"register\s+now", r"submit\s+your\s+project", r"sign\s+up\s+today",
]
CLOSED_2 = [
    r"registration\s+(is\s+)?(?:closed|has\s+ended|ended)", r"applications?\s+(?:are\s+)?closed", r"submissions?\s+(?:are\s+)?closed",
    r"报名\s*(?:已|已经)?\s*(?:结束|关闭|截止)",
]
UPCOMING_2 = [r"registration\s+(?:opens|starts|begins)\s+on", r"applications?\s+(?:open|start)\s+on", r"即将.*报名|报名.*即将.*开放", r"coming\s+soon"]
OPEN_2 = [*OPEN_1, r"open\s+for\s+(?:registration|applications|submissions)", r"now\s+accepting\s+(?:applications|submissions|registrations)"]
#: Categories of titles, in order.
CATEGORIES = [
    (["翻译", "英语", "外语", "阅读", "写作", "语法", "词汇", "普通话", "商务英语", "外宣"], "英语/语言类"),
    (["数学建模", "数学", "奥林匹克数学"], "数学类"),
    (["人工智能", "ai", "机器人", "算法", "编程", "量子计算", "计算机", "软件", "集成电路", "工业互联网", "数据", "办公"], "信息技术/AI类"),
    (["创新创业", "创业", "就业"], "创新创业类"),
    (["摄影", "数字艺术", "文旅", "创作", "诗经", "吟唱"], "文化艺术类"),
    (["环保", "生态", "绿色"], "环保类"),
    (["医学", "健康"], "医药健康类"),
    (["物理"], "理工类"),
    (["保研"], "职业发展类"),
    (["党史", "知识", "丝绸之路"], "知识竞赛类"),
    (["汉语言", "文字"], "语言文学类"),
]
OTHER_CATEGORY = "综合类"
#: What a candidate's status words mean.
STATUS_WORDS = {"open": "open", "live": "open", "registration": "open", "upcoming": "upcoming", "closed": "closed", "ended": "ended"}


def first_rule(c: Column, rules: list[tuple[str, str]], other: Column | None = None) -> Column:
    out = None
    for label, pattern in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out if other is None else out.otherwise(other)


def level(text: Column) -> Column:
    return first_rule(text, LEVELS)


def organizer(text: Column, patterns: list[str] = ORGANIZERS, cut: int = 80) -> Column:
    found = [F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in patterns]
    return F.substring(F.trim(F.coalesce(*found)), 1, cut)


def tags(text: Column, rules: list[tuple[str, str]] = TAGS, always: tuple[str, ...] = ("黑客松",)) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*map(F.lit, always), *[F.when(low.rlike(p), t) for p, t in rules]))


def registration_status(text: Column) -> Column:
    """closed, open or null by the first rule set."""
    head = F.substring(text, 1, 4000)
    return F.when(head.rlike("(?iu)" + any_of(CLOSED_1)), "closed").when(head.rlike("(?iu)" + any_of(OPEN_1)), "open")


def registration_status_2(text: Column) -> Column:
    """closed, upcoming, open or null; a lone 'register' or 'apply' is open."""
    head = F.lower(F.substring(text, 1, 4000))
    return (
        F.when(head.rlike(any_of(CLOSED_2)), "closed")
        .when(head.rlike(any_of(UPCOMING_2)), "upcoming")
        .when(head.rlike(any_of(OPEN_2)) | head.rlike(r"\b(register|apply)\b"), "open")
    )


def status_word(c: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in STATUS_WORDS.items() for x in kv])
    return F.element_at(words, F.lower(F.trim(F.coalesce(c, F.lit("")))))


def detect_status(text: Column, word: Column) -> Column:
    return F.coalesce(registration_status_2(text), registration_status(text), status_word(word))


def category(title: Column) -> Column:
    low = F.lower(title)
    return first_rule(low, [(name, "|".join(words)) for words, name in CATEGORIES], F.lit(OTHER_CATEGORY))


def labelled_field(text: Column, labels: list[str], all_labels: list[str], ahead: int = 4) -> Column:
    """The value after a label: on its line, or on the first of the next lines that is neither empty nor a label."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    head, any_label = f"^(?:{'|'.join(labels)})[：:]?\\s*", f"^(?:{'|'.join(all_labels)})"

    def at(x: Column, i: Column) -> Column:
        own = F.trim(F.regexp_replace(x, head, ""))
        later = F.filter(F.slice(lines, i + 2, ahead), lambda y: (y != "") & ~y.rlike(any_label))
        return F.when(x.rlike(head), F.when(own != "", own).otherwise(F.get(later, F.lit(0))))

    return F.get(F.array_compact(F.transform(lines, at)), F.lit(0))


def script_value(html: Column, name: str, grammar: str = ".*") -> Column:
    """The first value assigned to a name in a script that fits the grammar."""
    found = F.regexp_extract_all(html, F.lit(rf'\b{name}\b\s*[:=]\s*["\']([^"\']*)["\']'), 1)
    return F.get(F.filter(found, lambda x: x.rlike(f"^(?:{grammar})$")), F.lit(0))


def links(html: Column) -> Column:
    """array<struct<href, title>> of a page's anchors, in order; tags within a title go."""
    p = F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    titles = F.transform(F.regexp_extract_all(html, p, 2), lambda t: F.trim(F.regexp_replace(t, "<[^>]+>", "")))
    return F.arrays_zip(F.regexp_extract_all(html, p, 1).alias("href"), titles.alias("title"))


def name_from_host(c: Column) -> Column:
    """'spring-data-days.example.org' to 'Spring Data Days'."""
    label = F.regexp_extract(c, r"^https?://(?:www\.)?([^./]+)\.", 1)
    return F.initcap(F.translate(label, "-_", "  "))


def event_id(*parts: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """'EVT-' and the first 12 hex digits, upper case, of the name-based UUID of the parts (catalog, year, title, URL)."""
    name = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    return F.concat(F.lit("EVT-"), F.upper(F.substring(digest, 1, 12)))


def article_id(biz: Column, mid: Column, idx: Column, publisher: Column, time: Column, title: Column) -> Column:
    """'WX-' and 24 upper-case hex digits of SHA-256: of biz:mid:idx where all are known, else of the publisher's account
    key, the time as ISO text at +08:00 (as it is, if it is no time) and the title in NFKC and lower case."""
    known = lambda c: F.nullif(c, F.lit(""))
    platform = F.concat(known(biz), F.lit(":"), known(mid), F.lit(":"), known(idx))  # null if any is unknown
    at = F.date_format(F.from_utc_timestamp(coerce_ts(time, "Asia/Shanghai"), "Asia/Shanghai"), "yyyy-MM-dd'T'HH:mm:ss'+08:00'")
    text = lambda c: F.coalesce(c, F.lit(""))
    named = F.concat_ws("|", account_key(text(publisher)), F.coalesce(at, text(time)), F.lower(F.trim(nfkc(text(title)))))
    return F.concat(F.lit("WX-"), F.upper(F.substring(F.sha2(F.coalesce(platform, named), 256), 1, 24)))


def candidate_identity(platform_id: Column, source: Column, url: Column, title: Column, day: Column) -> Column:
    """What makes a candidate one: its platform's id, else its URL unless that is a listing, else source, title and date,
    else source and URL. day is the first known of start, deadline and end, as text."""
    url_of, name = url_key(url), light_key(F.coalesce(title, F.lit("")))
    known = lambda c: c.isNotNull() & (c != "")
    part = lambda kind, *cs: F.concat_ws("|", F.lit(kind), *[F.coalesce(c, F.lit("")) for c in cs])
    return (
        F.when(known(platform_id), part("platform", source, platform_id))
        .when(known(url_of) & ~is_listing_url(url), part("url", url_of))
        .when(known(name), part("listing_event", source, name, F.substring(day, 1, 10)))
        .otherwise(part("listing_url", source, url_of))
    )

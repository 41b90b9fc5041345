"""Notices and detail pages: fields behind labels, links worth following, article URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import text as X
from concord.functions.dates import let

#: The groups of labels of a detail page, in order.
LABELS = {
    "organizer": ["主办方", "主办单位", "组织单位", "主办机构", "主办"],
    "category": ["竞赛类别", "赛事类别", "类别"],
    "registration_time": ["报名时间", "报名截止", "报名日期", "参赛报名"],
    "contest_time": ["竞赛时间", "比赛时间", "活动时间", "比赛日期", "作品提交时间", "参赛作品提交时间"],
    "participant_scope": ["参赛对象", "参赛资格", "面向对象", "参赛人群", "参与对象"],
    "fee_or_status": ["报名费", "参赛费用", "费用", "报名状态", "状态"],
}
#: Where registration times stand without a plain label.
REGISTRATION = [r"报名[时日]间[：:]\s*(\d{4}[./\-]\d{1,2}[./\-]\d{1,2}[^。\n]{0,50})", r"报名截止[：:]\s*(\d{4}[./\-]\d{1,2}[./\-]\d{1,2}[^。\n]{0,30})"]
#: Values are shorter than this, and stand on the label's line or on one of so many next lines.
MOST_CHARS, AHEAD = 200, 4
#: The host and scheme of article pages, and the query keys that name an article.
ARTICLE_HOST, ARTICLE_KEYS = "mp.weixin.qq.com", ["__biz", "mid", "idx", "sn"]
#: Spellings of an ampersand in a redirecting page.
AMPERSANDS = ["&amp;", "&#38;", "&#x26;", "&#X26;"]


def label_values(text: Column, labels: dict[str, list[str]] = LABELS, ahead: int = AHEAD) -> Column:
    """A struct of the value of each group of labels. A label is followed by a colon; its value is the rest of the first
    line that has it, or, where that line ends with the colon, the first of the next ahead lines that is neither blank
    nor has a label itself. A group has the value of the first of its labels that has one of fewer than MOST_CHARS
    characters, white space squeezed, else null.

    Blank lines are left out and label lines marked once; each value is a look at a window of the numbered lines."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    any_label = "(?:" + "|".join(w for words in labels.values() for w in words) + ")[：:]"
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    lines = F.transform(raw, lambda x: F.struct(squeeze(x).alias("line"), x.rlike(any_label).alias("label")))

    def read(ls: Column) -> Column:
        def value(label: str) -> Column:
            own = F.transform(ls, lambda x, i: F.when(x["label"] & x["line"].rlike(f"{label}[：:]"), F.struct(i.alias("i"), F.trim(F.regexp_extract(x["line"], f"{label}[：:](.*)$", 1)).alias("own"))))
            first = F.get(F.array_compact(own), F.lit(0))
            later = F.get(F.filter(F.slice(ls, first["i"] + 2, F.lit(ahead)), lambda y: ~y["label"]), F.lit(0))["line"]
            found = F.when(first["own"] != "", first["own"]).when(first.isNotNull(), later)
            return F.when(F.length(found) < MOST_CHARS, found)

        return F.struct(*[F.coalesce(*map(value, words)).alias(g) for g, words in labels.items()])

    return let(lines, read)


def detail_fields(pages: DataFrame, text: str) -> DataFrame:
    """pages with the columns of LABELS from the lines of text; a registration time without a plain label is looked for by
    REGISTRATION."""
    found = pages.withColumn("_f", label_values(F.col(text)))
    times = [F.nullif(F.trim(F.regexp_extract(F.col(text), p, 1)), F.lit("")) for p in REGISTRATION]
    value = lambda g: F.coalesce(F.col("_f")[g], *(times if g == "registration_time" else [])).alias(g)
    return found.select(*pages.columns, *[value(g) for g in LABELS])


def is_article_url(url: Column) -> Column:
    return url.rlike(f"(?i)^https://{ARTICLE_HOST}(:\\d+)?([/?#].*)?$").eqNullSafe(True)


def article_url(url: Column, known: dict[str, Column] | None = None) -> Column:
    """The canonical URL of an article: its host and /s with those of ARTICLE_KEYS that known or the query has, in this
    order; without any of them its own path (or /s) and query; '' if it is no article's URL."""
    known, query = known or {}, F.regexp_extract(url, r"\?([^#]*)", 1)
    part = lambda k: F.nullif(F.regexp_extract(F.concat(F.lit("&"), query), f"&{k}=([^&]*)", 1), F.lit(""))
    own = lambda k: F.when(F.nullif(known[k], F.lit("")).isNotNull(), F.url_encode(known[k])) if k in known else F.lit(None)
    pairs = [F.concat(F.lit(f"{k}="), F.coalesce(own(k), part(k))) for k in ARTICLE_KEYS]
    stable = F.array_compact(F.array(*pairs))
    base = F.lit(f"https://{ARTICLE_HOST}")
    path = F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1)
    rest = F.concat(F.when(path == "", "/s").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    out = F.when(F.size(stable) > 0, F.concat(base, F.lit("/s?"), F.array_join(stable, "&"))).otherwise(F.concat(base, rest))
    return F.when(is_article_url(url), out).otherwise("")


def redirect_target(html: Column) -> Column:
    """The article URL that a redirecting page puts together from string fragments (url += '...'), without its at signs and
    with plain ampersands; null if there are none or they make no article's URL."""
    whole = F.array_join(F.regexp_extract_all(html, F.lit(r"(?s)url\s*\+=\s*(['\"])(.*?)\1\s*;"), 2), "")
    for spelling in AMPERSANDS:
        whole = F.replace(whole, F.lit(spelling), F.lit("&"))
    plain = F.replace(whole, F.lit("@"), F.lit(""))
    return F.when(is_article_url(plain), plain)


def detail_links(html: Column, base: str, detail: str, hosts: dict[str, str], suffixes: tuple[str, ...] = ()) -> Column:
    """array<struct<title, url>> of a listing page's links to detail pages, in order: absolute URLs that fit the pattern
    detail, in canonical form (hosts renamed), with the link's text, or its title attribute where the text has fewer than
    four characters, cleaned of suffixes; promotions go, and of links with one URL or one title identity the first stays."""
    anchor = F.lit(r"(?is)<a\s([^>]*)>(.*?)</a>")
    both = F.arrays_zip(F.regexp_extract_all(html, anchor, 1).alias("a"), F.regexp_extract_all(html, anchor, 2).alias("b"))
    attribute = lambda c, name: F.regexp_extract(c, rf"(?is)(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"(?U)\s+", " "))

    def made(x: Column) -> Column:
        href = attribute(x["a"], "href")
        url = F.when(href.startswith("/"), F.concat(F.lit(base), href)).when(href.startswith("http"), href)
        text, other = plain(x["b"]), plain(attribute(x["a"], "title"))
        title = F.when(F.length(text) >= 4, text).when(F.length(other) >= 4, other)
        return F.struct(X.platform_title(title, suffixes).alias("title"), X.canonical_url(url, hosts).alias("url"), url.rlike(detail).alias("fits"))

    good = F.filter(F.transform(both, made), lambda x: x["fits"] & x["title"].isNotNull() & ~F.coalesce(X.is_promotion(x["title"]), F.lit(False)))
    empty = F.array().cast("array<struct<title:string,url:string>>")

    def step(kept: Column, x: Column) -> Column:
        same = F.exists(kept, lambda k: (k["url"] == x["url"]) | ((X.title_identity(k["title"], suffixes) == X.title_identity(x["title"], suffixes)) & (X.title_identity(x["title"], suffixes) != "")))
        return F.when(same, kept).otherwise(F.array_append(kept, F.struct(x["title"].alias("title"), x["url"].alias("url"))))

    return F.aggregate(good, empty, step)

"""A notice's text as a preview of an event. Nothing is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.extract import first_rule
from concord.functions.text import quoted

#: Words of a notice, and the scope and level that they stand for, in order.
SCOPES = [
    (["国际", "全国", "全国大学生", "中国"], "校外竞赛", "国家级"),
    (["省级", "省"], "校外竞赛", "省级"),
    (["学院", "书院", "院系"], "校内活动", "院级"),
    (["竞赛", "比赛", "大赛", "挑战"], "校内竞赛", "校级"),
]
NO_SCOPE = ("校内活动", "校级")
#: Categories of notices, in order.
NOTICE_CATEGORIES = [
    (["程序设计", "编程", "算法", "ACM", "ICPC"], "程序设计竞赛"),
    (["数学建模", "建模"], "数学建模"),
    (["创新创业", "创业", "三创", "挑战杯"], "创新创业"),
    (["五育", "体育", "美育", "德育", "劳育"], "五育活动"),
    (["讲座", "沙龙", "分享"], "学术讲座"),
    (["人工智能", "AI", "机器学习"], "人工智能"),
]
NO_CATEGORY = "其他"
#: Tags and policy tags, and the words that give them.
NOTICE_TAGS = [(["组队", "团队", "三人"], "需要组队"), (["个人", "独立"], "个人赛"), (["保研"], "保研相关"), (["五育"], "五育学分")]
POLICY_TAGS = [(["保研"], "保研可能相关"), (["综测", "综合测评"], "综测加分"), (["五育"], "五育明确相关")]
#: Words before an organiser, the separators in their order, and how far behind the word one may stand.
ORGANISING, SEPARATORS, REACH = ["主办", "组织", "承办", "举办"], ["：", ":", "是", "为"], 50
#: Whose own pages are of high authority, and the names of sources.
OWN_HOST, OWN_SOURCE, OTHER_SOURCE = "nju.edu.cn", "南京大学官网", "外部来源"


def _by_words(text: Column, rules: list[tuple[list[str], str]], other: str) -> Column:
    return first_rule(text, [(label, quoted(words)) for words, label in rules], F.lit(other))


def _given(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(quoted(words)), label) for words, label in rules]))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def notice_scope(text: Column) -> Column:
    """struct(scope_type, contest_level)."""
    scope = _by_words(text, [(words, scope) for words, scope, _ in SCOPES], NO_SCOPE[0])
    return F.struct(scope.alias("scope_type"), _by_words(text, [(words, level) for words, _, level in SCOPES], NO_SCOPE[1]).alias("contest_level"))


def notice_category(text: Column) -> Column:
    return _by_words(text, NOTICE_CATEGORIES, NO_CATEGORY)


def notice_tags(text: Column) -> Column:
    return _given(text, NOTICE_TAGS)


def policy_tags(text: Column) -> Column:
    return _given(text, POLICY_TAGS)


def separated_organizer(text: Column) -> Column:
    """The organiser behind a separator: of each organising word the first place counts, of its separators the first kind
    that stands within REACH characters; the name ends at a line end, comma or full stop. The last word that has a
    separator wins, even with an empty name; '' if none has."""

    def behind(word: str) -> Column:
        at = F.instr(text, word)
        near = F.substring(text, at, F.lit(REACH))
        place = F.coalesce(*[F.nullif(F.instr(near, s), F.lit(0)) for s in SEPARATORS])
        name = F.substring(_strip(F.substring(near, place + 1, F.lit(REACH))), 1, 100)
        return F.when(at > 0, F.regexp_extract(name, "^[^\n，。]*", 0))

    return F.coalesce(*[behind(w) for w in reversed(ORGANISING)], F.lit(""))


def notice_title(text: Column) -> Column:
    """The first line of more than five characters, cut at 200; '' if there is none."""
    lines = F.transform(F.split(text, "\n"), _strip)
    return F.substring(F.coalesce(F.get(F.filter(lines, lambda x: F.length(x) > 5), F.lit(0)), F.lit("")), 1, 200)


def parse_notices(df: DataFrame, text: str, url: str) -> DataFrame:
    """df with the struct column preview: what a notice's text and its URL (null or empty: unknown) tell of an event. A null
    text is an empty one; every field has a value."""
    t, u = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    scope = notice_scope(t)
    fields = {
        "title": notice_title(t), "scope_type": scope["scope_type"], "category": notice_category(t), "summary": F.substring(_strip(t), 1, 100),
        "contest_level": scope["contest_level"], "tags": F.to_json(notice_tags(t)), "policy_tags": F.to_json(policy_tags(t)),
        "source_name": F.when(u == "", "").when(u.contains(OWN_HOST), OWN_SOURCE).otherwise(OTHER_SOURCE), "source_url": u,
        "authority_level": F.when(u.contains(OWN_HOST), "高").otherwise("中"), "status": F.lit("报名中"), "organizer": separated_organizer(t),
        "original_text": F.substring(t, 1, 2000),
    }
    return df.withColumn("preview", F.struct(*[c.alias(name) for name, c in fields.items()]))

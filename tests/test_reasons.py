from pyspark.sql import functions as F

from concord.operators.rank import recommendation_reasons
from concord.plans.registry import QUERIES
from tests.oracle import SF

FIELDS = "major string, grade string, target_major string, target_grade string, category string, level string, organizer string, days int, approved boolean, tags array<string>, policy_tags array<string>"


def test_reasons_in_their_order(spark):
    rows = [
        ("数学", "大二", "数学,统计", "大一,大二", "数学建模", "国际级", "教育部高等教育司竞赛组织委员会办公室", 3, True, ["创新创业", "ICPC亚洲"], ["五育并举", "奖学金评定", "综测加分", "保研明确相关"]),
        ("物理,数学", "大三", "数学", "大一", "其他", "国家级", "某大学", 7, False, ["ACM"], ["保研明确相关吗"]),
        ("化学", "", "数学", "大一", "创新创业大赛", "省级", None, 30, None, None, None),
        (None, None, None, None, None, None, None, -1, False, [], []),
        ("", "", "", "", "", "", "中国数学会", None, False, ["数学建模"], []),
        ("", "", "", "", "", "", "", 8, False, ["程序设计"], []),
        ("", "", "", "", "", "", "", 31, False, [], []),
    ]
    df = spark.createDataFrame(rows, FIELDS).coalesce(1)
    got = [r.v for r in df.select(recommendation_reasons({c: F.col(c) for c in df.columns}).alias("v")).collect()]
    assert got == [
        ["专业核心竞赛（数学）", "适合当前年级（大二）", "保研加分项", "综测加分项", "奖学金评定相关", "五育认定", "教育部官方认证竞赛", "国际级高含金量赛事", "⏰ 即将截止（仅剩3天）", "经典数学建模赛事", "创新创业类竞赛", "程序设计竞赛", "权威主办方（教育部高等教育司竞赛组织委员会）"],
        ["专业相关（物理,数学）", "可跨年级参与", "国家级权威竞赛", "本周截止（7天）", "程序设计竞赛"],
        ["省级竞赛", "本月截止（30天）", "创新创业类竞赛"],
        ["充裕准备时间（-1天）"],
        ["报名时间待确认，建议主动查询", "经典数学建模赛事", "权威主办方（中国数学会）"],
        ["本月截止（8天）", "程序设计竞赛"],
        ["充裕准备时间（31天）"],
    ]


def test_query_takes_all_events(spark):
    users = spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey % 50 = 0").count()
    assert QUERIES["r3_recommendation_reasons"](spark, SF).count() == users * spark.read.parquet(f"{SF}/part.parquet").count()

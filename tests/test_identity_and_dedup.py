import hashlib
import random

import pytest
from pyspark.sql import functions as F

from concord.functions import dates as D
from concord.functions import extract as E
from concord.functions import text as X
from concord.operators import dedup, match


def greedy(rows):
    """One row after the other."""
    urls, titles, kept = set(), set(), []
    for seq, u, t in rows:
        if (u and u in urls) or (t and t in titles):
            continue
        kept.append(seq)
        urls |= {u} if u else set()
        titles |= {t} if t else set()
    return kept


def test_greedy_or_with_blank_keys_and_chains(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, "", *(f"u{k}" for k in range(25))]), r.choice([None, "", *(f"t{k}" for k in range(25))])) for i in range(150)]
    rows += [(1000, None, None), (1001, None, None), (1002, "", "")]
    rows += [(2000 + k, f"c{(k + 1) // 2}", f"d{k // 2}") for k in range(9)]  # each shares a key with the next
    df = spark.createDataFrame(rows, "seq long, url string, title string")
    assert sorted(x.seq for x in dedup.dedup_greedy_or(df, "url", "title").collect()) == greedy(rows)
    assert dedup.dedup_greedy_or(df.limit(0), "url", "title").count() == 0
    assert dedup.dedup_greedy_or(df.filter("seq = 1000"), "url", "title").count() == 1


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_identities_by_hand(spark):
    s = F.lit
    key = lambda text: "WX-" + hashlib.sha256(text.encode()).hexdigest()[:24].upper()
    assert one(spark, E.article_id(s("B"), s("7"), s("1"), s("x"), s("y"), s("z"))) == key("B:7:1")
    args = (s(" Ａ·B（x） "), s("2026-07-01T02:00:00Z"), s(" Ｎews "))
    assert one(spark, E.article_id(s("B"), s(""), s("1"), *args)) == key("abx|2026-07-01T10:00:00+08:00|news")
    assert one(spark, E.article_id(s(None), s(None), s(None), s(None), s("soon"), s(None))) == key("|soon|")
    assert one(spark, E.event_id(s("k"), s(2026), s("t"), s(None))).startswith("EVT-")
    assert one(spark, X.account_key(s("a.b[c] ·•_-—（）()"))) == "a.b[c]"
    for url, public in {
        "http://10.example.com": True, "http://127.evil.org/x": True, "http://a.local": True, "http://10.0.0.1": False, "https://127.1.2.3:8/": False,
        "http://[::1]/": False, "http://[fd00::1]/": False, "http://8.8.8.8": True, "http://172.15.0.1": True, "http://172.16.0.1": False, "ftp://x.org": False,
    }.items():
        assert one(spark, X.is_public_url(s(url))) is public, url


def test_dates_by_hand(spark):
    two = lambda t: tuple(one(spark, D.two_dates(F.lit(t), 2026)))
    assert two("Apply by July 15") == ("2026-07-15", None, False)
    assert two("2026年2月30日") == (None, None, False)
    assert two("报名时间：2026年7月1日 - 2026年7月15日，比赛时间：2026年8月1日") == ("2026-07-15", "2026-08-01", True)
    ranges = lambda t: tuple(one(spark, D.ranges(F.lit(t), 2026)))
    assert ranges("July 15-17, 2026") == (None, "2026-07-15", "2026-07-17")
    assert ranges("Registration deadline and event date: 2026-07-15 - 2026-07-17") == ("2026-07-17", "2026-07-15", "2026-07-17")


def test_fuzzy_and_containing_pairs_against_all_pairs(spark):
    r = random.Random(8)
    words = ["".join(r.choices("abc", k=r.randrange(1, 12))) for _ in range(120)]
    left, right = words[:60] + [""], [w[:-1] + r.choice("abc") + r.choice(["", "a"]) for w in words[:50]] + words[60:]
    frame = lambda xs: spark.createDataFrame(list(enumerate(xs)), "seq long, key string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for least in (0.85, 0.7, 0.6):
        want = {}
        for i, a in enumerate(left):
            good = [(-(1 - distance(a, b) / max(len(a), len(b))), j) for j, b in enumerate(right) if a and b and 1 - distance(a, b) / max(len(a), len(b)) >= least]
            if good:
                want[i] = min(good)[1]
        got = {x.l_seq: x.r_seq for x in match.fuzzy_match(frame(left), frame(right), "key", least).collect()}
        assert got == want
    pairs = match.containing_pairs(frame(left).withColumnRenamed("key", "k"), frame(right).withColumnRenamed("key", "rk")).collect()
    assert {tuple(p) for p in pairs} == {(a, b) for a in left for b in right if a and b and (a in b or b in a)}


def jobs(spark, run):
    """How many jobs run() takes."""
    spark.sparkContext.setJobGroup("counted", "")
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("", "")
    return n


@pytest.mark.parametrize("rest", [200_000, 0])
def test_greedy_or_on_random_keys_and_long_chains(spark, monkeypatch, rest):
    monkeypatch.setattr(dedup, "REST_ROWS", rest)
    rng = random.Random(8)
    key = lambda n: rng.choice(["", None, *map(str, range(n))])
    rows = [(i, key(40), key(60)) for i in range(400)] + [(1000 + i, "hot", f"t{i % 50}") for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, url string, title string")
    assert sorted(x.seq for x in dedup.dedup_greedy_or(df, "url", "title").collect()) == greedy(rows)
    n = 10_000 if rest else 600
    chain = [(i, f"u{i // 2}", f"t{(i + 1) // 2}") for i in range(n)]
    df = spark.createDataFrame(chain, "seq long, url string, title string")
    got = []
    used = jobs(spark, lambda: got.extend(x.seq for x in dedup.dedup_greedy_or(df, "url", "title").collect()))
    assert sorted(got) == list(range(0, n, 2)) and used < (40 if rest else 250)


def test_greedy_or_follows_chains_only_where_rounds_are_slow(spark, monkeypatch):
    followed = []
    decided = dedup._decided
    monkeypatch.setattr(dedup, "_decided", lambda left: followed.append(1) or decided(left))
    monkeypatch.setattr(dedup, "REST_ROWS", 300)
    rng, big = random.Random(5), 1 << 60  # ids that no double holds
    rows = [(big + i, f"u{rng.randrange(300)}" if i % 7 else None, f"t{rng.randrange(200)}" if i % 5 else "") for i in range(4000)]
    frame = lambda rows: spark.createDataFrame(rows, "seq long, url string, title string")
    assert sorted(x.seq for x in dedup.dedup_greedy_or(frame(rows), "url", "title").collect()) == greedy(rows) and not followed
    chain = [(i, f"u{i // 2}", f"t{(i + 1) // 2}") for i in range(800)]
    assert sorted(x.seq for x in dedup.dedup_greedy_or(frame(chain), "url", "title").collect()) == list(range(0, 800, 2)) and len(followed) == 1

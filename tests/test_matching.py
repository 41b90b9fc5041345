import random

import pytest

from concord.operators import match as M


def keys(spark, words, column):
    return spark.createDataFrame([(w,) for w in words], f"{column} string")


def near(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def words(seed, n):
    rng, out = random.Random(seed), set()
    while len(out) < n:
        w = "".join(rng.choices("abcd", k=rng.randint(1, 22)))
        out.add(w)
        for _ in range(2):
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice(["", "x", "ab"]) + w[i + rng.randint(0, 2) :]
            out |= {w} if w else set()
    return sorted(out)


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85, 0.95])
def test_near_pairs_are_all_found(spark, least):
    left, right = words(1, 90), words(2, 60) + words(1, 90)[::3]
    want = {(a, b) for a in left for b in set(right) if a != b and 1 - near(a, b) / max(len(a), len(b)) >= least}
    got = {(r.lk, r.rk) for r in M.near_pairs(keys(spark, left, "lk"), keys(spark, sorted(set(right)), "rk"), least).collect()}
    assert got == want and len(want) > 1


def test_containment_by_rarest_substring(spark):
    left, right = [*words(3, 120), "", "a", "ab", "é語x"], [*words(4, 120), "", "b", "aé語xb", "dab"]
    want = {(a, b) for a in left for b in right if a and b and (a in b or b in a)}
    assert {(r.k, r.rk) for r in M.containing_pairs(keys(spark, left, "k"), keys(spark, right, "rk")).collect()} == want


@pytest.mark.parametrize("least", [0.5, 0.7, 1.0])
def test_sets_of_characters(spark, least):
    rng = random.Random(6)
    some = ["".join(rng.choices("abcdefghijklmnop竞赛大学", k=rng.randint(1, 9))) for _ in range(150)]
    left, right = some[:90], some[60:]
    want = {(a, b) for a in left for b in right if len(set(a) & set(b)) / max(len(set(a)), len(set(b))) >= least}
    assert {(r.k, r.rk) for r in M.sharing_pairs(keys(spark, left, "k"), keys(spark, right, "rk"), least).collect()} == want


def test_best_titles_rules(spark):
    left = spark.createDataFrame([(1, "第十届 机器人大赛"), (2, "全国大学生数学竞赛"), (3, "zzz"), (4, ""), (5, "abcd")], "seq long, title string")
    right = spark.createDataFrame([(10, "机器人大赛"), (11, "第十届机器人大赛"), (12, "2026数学竞赛决赛"), (13, "abcx"), (14, "dcba")], "seq long, title string")
    got = {r.l_seq: (r.r_seq, round(r.score, 3)) for r in M.best_titles(left, right).collect()}
    assert got == {1: (11, 2.0), 2: (12, 0.8), 5: (14, 1.0)}


def test_last_match_wins(spark):
    left = spark.createDataFrame([(1, "ring"), (2, "none")], "seq long, key string")
    right = spark.createDataFrame([(1, "a ring", "zz"), (2, "ring", "aa"), (3, "gold", "bb")], "seq long, key string, url string")
    assert [tuple(r) for r in M.propagate_urls(left, right, "key", "url").collect()] == [(1, "aa")]

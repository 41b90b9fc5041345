import random

import pytest

from concord.operators import merge as M

RANKS = {"低": 1, "中": 2, "高": 3}
GOOD = lambda v: v not in (None, "", "null")


def one_after_the_other(rows):
    """Rows (seq, organizer, authority, approved) of a key, merged in order."""
    rows = sorted(rows, key=lambda r: r[0])
    state = list(rows[0][1:])
    level = lambda s: (bool(s[2]), RANKS.get(s[1], 0))
    for _, *x in rows[1:]:
        up = level(x) > level(state)
        fields = [x[k] if GOOD(x[k]) and (up or not GOOD(state[k])) else state[k] for k in (0, 1)]
        flag = x[2] if up and x[2] is not None else (state[2] if state[2] is not None else x[2])
        state = [*fields, flag]
    return tuple(state)


@pytest.mark.parametrize("seed", range(3))
def test_fold_is_the_merge_in_order(spark, seed):
    rng, of = random.Random(seed), {}
    for k in range(60):
        for seq in rng.sample(range(-1, 40), rng.randint(1, 9)):
            of.setdefault(k, []).append((seq, rng.choice(["", None, "null", f"o{seq}"]), rng.choice(["低", "中", "高", "other", "", None]), rng.choice([True, False, None])))
    of[99] = [(i, f"o{i}", rng.choice("低中"), False) for i in range(20_000)]
    schema = "id long, seq long, organizer string, authority_level string, is_ministry_approved boolean"
    rows = spark.createDataFrame([(k, *r) for k, v in of.items() for r in v], schema)
    got = M.fold(rows.filter("seq = -1").drop("seq"), rows.filter("seq >= 0"), "id", ["organizer", "authority_level"]).collect()
    assert {r.id: (r.organizer, r.authority_level, r.is_ministry_approved) for r in got} == {k: one_after_the_other(v) for k, v in of.items()}
    assert M.fold(rows.limit(0).drop("seq"), rows.limit(0), "id", ["organizer", "authority_level"]).count() == 0


def test_follow_changes_in_order(spark):
    rng = random.Random(5)
    profiles = [(u, rng.choice([None, [], ["a", "b"], ["c", "a", "d"]])) for u in range(40)]
    changes = [(u, seq, rng.choice(["add", "remove"]), rng.choice("abcdef")) for u in range(42) for seq in rng.sample(range(100), rng.randint(0, 12))]
    want = {}
    for u, focus in profiles:
        now = list(focus or [])
        for _, _, op, item in sorted(c for c in changes if c[0] == u):
            now = [*now, item] if op == "add" and item not in now else [x for x in now if x != item] if op == "remove" else now
        want[u] = now
    rng.shuffle(changes)
    p, c = spark.createDataFrame(profiles, "user_id long, focus array<string>"), spark.createDataFrame(changes, "user_id long, seq long, op string, item string")
    assert {r.user_id: r.focus for r in M.apply_follow_changes(p, c).collect()} == want

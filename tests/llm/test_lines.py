import random

import pytest

from concord.llm import lines
from concord.llm.common import table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(texts):
    """Classes of comparable lines by comparing all pairs."""
    own = sorted({p for t in texts for x in lines.split(t) if (p := lines.plain(x))})
    root = {x: x for x in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(own):
        for b in own[:i]:
            if min(len(a), len(b)) >= lines.MIN_CHARS and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                root[find(a)] = find(b)
    return {x: find(x) for x in own}


def edited(r, line, n):
    for _ in range(n):
        k = r.randrange(len(line) + 1)
        line = r.choice([line[:k] + r.choice("abé") + line[k:], line[:k] + line[k + 1 :], line[:k] + "z" + line[k + 1 :]])
    return line


def test_verifier(monkeypatch):
    r = random.Random(1)
    a = ["".join(r.choices("ab", k=r.randrange(0, 40))) for _ in range(800)]
    b = [edited(r, x, r.randrange(5)) for x in a]
    want = [distance(x, y) <= 2 for x, y in zip(a, b)]
    assert lines.near(a, b).tolist() == want
    monkeypatch.setattr(lines, "LONG", 5)
    assert lines.near(a, b).tolist() == want


@pytest.mark.parametrize("bound, refine", [(256, 4096), (6, 12)])
def test_against_all_pairs(spark, monkeypatch, bound, refine):
    monkeypatch.setattr(lines, "KEY_ROWS", bound)
    monkeypatch.setattr(lines, "REFINE_ROWS", refine)
    r = random.Random(5)
    base = ["".join(r.choices("abcd ", k=r.randrange(19, 60))) for _ in range(25)]
    pool = base + [edited(r, r.choice(base), r.randrange(1, 4)) for _ in range(120)] + ["a" * 20 + c + d for c in "xyzw" for d in "pqrst"] + ["short", "tiny", "", "  "]
    texts = ["\n".join(r.choices(pool, k=r.randrange(1, 6))) for _ in range(90)] + [None, "", pool[0], pool[0] + "\n" + pool[0]]
    rows = list(enumerate(texts)) + [(None, pool[3]), (0, texts[0]), (3, "other " * 5)]
    clash = "doc_id long, text string, gone int, _row int, _K int, _doc string, _gone int, d int, k int"
    df = spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, 5, 6) for i, t in rows], clash)
    found = lines.dedup_lines(df)
    assert found.columns == [*df.columns, "_n_lines", "_n_removed"] and found.first()[2:9] == (1, 2, 3, "x", 4, 5, 6)
    got = sorted(map(tuple, found.select("doc_id", "text", "_n_lines", "_n_removed").collect()), key=repr)
    cls, seen, want = brute([t for _, t in rows]), {}, []
    keyed = df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) k").collect()
    order = sorted({(x.doc_id is not None, x.doc_id or 0, x.k, x.text) for x in keyed if x.text is not None})
    kept_of = {}
    for has, d, k, t in order:
        kept = []
        for i, x in enumerate(lines.split(t)):
            p = lines.plain(x)
            if not p or seen.setdefault(cls[p], (has, d, k, i)) == (has, d, k, i):
                kept.append(x)
        kept_of[has, d, t] = kept
    for d, t in rows:
        kept = [] if t is None else kept_of[d is not None, d or 0, t]
        n = 0 if t is None else len(lines.split(t))
        want.append((d, None if t is None else "\n".join(kept), n, n - len(kept)))
    assert got == sorted(want, key=repr)


def test_empty_and_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    found = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    cls = brute([r.text for r in docs.collect()])
    seen = set()
    for r in sorted(docs.collect()):
        n = 0
        for x in lines.split(r.text):
            p = lines.plain(x)
            n += bool(p) and cls[p] in seen
            seen |= {cls[p]} if p else set()
        assert found[r.doc_id]._n_removed == n


def test_keys_of_long_lines_and_batches(monkeypatch):
    r = random.Random(9)
    own = ["".join(r.choices("abé語", k=n)) for n in (0, 1, 7, 30, 64, 200, 45)]
    whole = lines.keys(own, 20)
    monkeypatch.setattr(lines, "CHARS", 40)  # several batches, and lines longer than one
    parts = lines.keys(own, 20)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_very_long_lines(spark):
    r = random.Random(3)
    long = "".join(r.choices("abcdefgh ", k=40_000))
    rows = [(1, long), (2, long[:20_000] + "X" + long[20_000:]), (3, "y" + long[:-1]), (4, long[:1000]), (5, "\n".join([long[:5000]] * 3))]
    got = {x.doc_id: x._n_removed for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 2}


def test_template_with_many_variants(spark, monkeypatch):
    monkeypatch.setattr(lines, "KEY_ROWS", 16)
    monkeypatch.setattr(lines, "REFINE_ROWS", 32)
    rows = [(i, f"Posted by the user number {i:07d} today") for i in range(0, 4_000, 67)]
    cls = brute([t for _, t in rows])
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("_n_removed = 0").count()
    assert got == len(set(cls.values()))


def test_only_lines_of_large_keys_are_shuffled_again(spark, monkeypatch):
    monkeypatch.setattr(lines, "KEY_ROWS", 16)
    plans, cut = [], lines.cut

    def seen(df):
        if df.columns == ["key", "start", "size", "d", "rest", "line"]:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(lines, "cut", seen)
    r = random.Random(2)
    other = ["".join(r.choices("abcdefgh ", k=40)) for _ in range(30)]
    rows = list(enumerate([f"Posted by the user number {i:07d} today" for i in range(0, 4_000, 67)] + other + [x + "y" for x in other]))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("_n_removed = 0").count()
    assert got == len(set(brute([t for _, t in rows]).values()))
    assert len(plans) == 1 and "Generate" not in plans[0] and "MapInArrow" in plans[0]  # no row of another key before the join

import random
from collections import defaultdict
from itertools import permutations

import pyarrow as pa
import pytest

from concord.llm import audit, queries, sql
from tests.llm.oracle import rows_of, rows_of_sql

SCHEMA = "doc_id long, text string, lang string, part int, fails string, key string"


def mask(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    out = audit.A * (len(words) < 200) + audit.B * (100 * len(set(words)) < 50 * len(words))
    out += audit.C * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
    return out + audit.D * any(c in "#$%&*|" for c in text)


def brute_flags(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    return sorted(((i, p or "", mask(t or "") + audit.E * (i is not None and i > least[t or ""])) for i, t, p in rows), key=repr)


def brute(rows, labels):
    out = []
    marked = brute_flags(rows)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    for part in {p for _, p, _ in marked}:
        own, removed_by, at = [(i, m) for i, p, m in marked if p == part], defaultdict(int), []
        for order in permutations("ABCDE"):
            gone = set()
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                failing = {k for k, (_, m) in enumerate(own) if m & bit}
                new = failing - gone
                removed_by[letter] += len(new)
                lost = [own[k][0] for k in new]
                only = sum(m == bit for _, m in own)
                at.append((part, "".join(order), step, len(own) - len(gone | new), len(new), len(failing & gone), only, sum(i in good for i in lost), sum(i in toxic for i in lost), letter))
                gone |= new
        out += [(*x[:-1], removed_by[x[-1]]) for x in at]
    return sorted(out)


def odd_rows():
    rng, some = random.Random(5), ["a b " * 120, "x " * 250, "AbC d", "", None, "50% off " + "w " * 300, "é" * 30 + " Z", "  \x1c", "same start " * 40 + "1", "same start " * 40 + "2"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(some), rng.choice(["en", "de", "", None])) for _ in range(300)]
    many = [(k, "the hot text", "en") for k in range(900, 100, -1)]
    unique = [(2000 + k, " ".join(str((k * 37 + j * j) % 997) for j in range(230)), "fr") for k in range(40)]
    return [*rows, *many, *unique, (3000, "word " * 200_000, "en"), (3001, " ".join(map(str, range(200_000))), "en"), (3002, " ".join(map(str, range(200_000))), "de")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, p, 4, "q", "z") for i, t, p in rows], SCHEMA)


@pytest.mark.parametrize("parts", [1, 7])
def test_flags_and_audit_of_odd_rows(spark, parts):
    rows = odd_rows()
    random.Random(parts).shuffle(rows)
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 900, 4)] + [(8, 1, 0), (None, 1, 1), (3002, None, 1)]
    docs = frame(spark, rows).repartition(parts)
    assert sorted(map(tuple, audit.flags(docs).collect()), key=repr) == brute_flags(rows)
    known = spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in audit.audit(docs, known).collect()) == brute(rows, labels)


def test_long_prefixes_get_longer_keys(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BYTES", 2000)
    rows = [(i, "a common opening of many texts, " * (i % 3) + str(i % 11), "en") for i in range(300)]
    assert sorted(map(tuple, audit.flags(frame(spark, rows)).collect()), key=repr) == brute_flags(rows)
    keyed, n = audit._key(frame(spark, rows).select("doc_id", "text"))
    got = {r.text: r.key for r in keyed.collect()}
    assert n > 4 and all(t.startswith(k) for t, k in got.items()) and max(map(len, got.values())) > 16
    assert [got[t] for t in sorted(got)] == sorted(got.values())


def test_tries_in_turn(monkeypatch):
    monkeypatch.setattr(audit, "TRIE_BYTES", 60)
    rng = random.Random(2)
    rows = sorted((rng.choice(["", "tea", "team", "te", "toast", "é", "tea" * 30]), rng.randrange(50)) for _ in range(400))
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i for _, i in part], "part": ["p"] * len(part), "fails": pa.array([1] * len(part), pa.int32()), "text": [t for t, _ in part]}) for part in (rows[k : k + 9] for k in range(0, 400, 9))]
    got = [tuple(r.values()) for b in audit._marked(iter(batches)) for r in b.to_pylist()]
    least = {t: min(i for u, i in rows if u == t) for t, _ in rows}
    assert got == [(i, "p", 1 | audit.E * (i > least[t])) for t, i in rows]


def test_trie_in_any_order():
    trie, rng = audit.RadixTrie(), random.Random(1)
    words = [bytes(rng.choices(b"ab", k=rng.randint(0, 7))) for _ in range(500)]
    for k, w in enumerate(words):
        trie.insert(w, 1000 - k, k)
    want = {w: (1000 - max(k for k, x in enumerate(words) if x == w), [k for k, x in enumerate(words) if x == w]) for w in words}
    assert sorted(trie.terminals()) == sorted(want.values())
    assert len(trie.label) < 2 * len(want) + 2


def test_empty_table_and_sql(spark):
    docs = frame(spark, [(1, "a", "en")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).collect() == []
    sf = "/root/testdata/sf0.001"
    assert rows_of(queries.op11_filter_audit(spark, sf)) == rows_of_sql(sql.ORACLES["op11_filter_audit"], sf)

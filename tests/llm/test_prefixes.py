import hashlib
import random
import zlib

import numpy as np
import pytest

from concord.llm import prefixes, queries, sql
from tests.llm.oracle import rows_of, rows_of_sql

SCHEMA = "conv_id long, turn long, role string, text string, node int, seg string, chars long"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows):
    of = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            of.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [x[3] for x in sorted(v)] for c, v in of.items()}


def rebuilt(of):
    out = {}
    for c, own in of.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = of.get(base, [])[:h] + own[h:]
    return out


def brute(of):
    members = {}
    for c, turns in of.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(of[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends[p]) for p, m in members.items()), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 5) for r in rows], SCHEMA)


def odd_rows():
    rng, out = random.Random(4), []
    for c in [*range(0, 330, 3), -7, -150, 10**12, 10**12 + 5, 100, 200]:
        for turn in range(rng.randint(1, 8)):
            out.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "hi there", "", None, "é語😀", "x" * 5000, str(c % 4)])))
    out += [(500 + k, t, "user", "same") for k in range(90) for t in range(7)]
    out += [(700, t, "user", f"turn {t // 2}") for t in range(60)] + [(701, t, "user", f"turn {t // 2}") for t in range(55)]
    out += [(None, 1, "user", "nobody"), (800, 1, "user", "b"), (800, 1, "user", "a"), (800, 1, "user", "b")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("segment", [1024, 4])
def test_odd_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(prefixes, "SEGMENT", segment)
    rows = odd_rows()
    assert got(prefixes.rebuilt_trie(frame(spark, rows).repartition(5))) == brute(rebuilt(sequences(rows)))


def test_dealt_shards_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SHARD_TURNS", 20)
    monkeypatch.setattr(prefixes, "END_IDS", 3)
    rows = odd_rows()
    assert got(prefixes.trie(frame(spark, rows))) == brute(sequences(rows))


def test_only_roots_and_no_rows(spark):
    some = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 > 1]
    rows = [(c, 1, "user", "gone") for c in some]
    want = brute(rebuilt(sequences(rows)))
    assert len(want) == 1 and got(prefixes.rebuilt_trie(frame(spark, rows))) == want
    assert prefixes.rebuilt_trie(frame(spark, rows).limit(0)).collect() == []


def test_long_conversation_counted_over_ranges(spark):
    rows = [(1, t, "u", str(t)) for t in range(5000)] + [(c, 0, "u", "x") for c in range(2, 40)]
    found = prefixes.turns(frame(spark, rows).repartition(8)).filter("conv_id = 1")
    assert sorted(r.pos for r in found.collect()) == list(range(5000))


def test_double_array():
    rng = np.random.default_rng(1)
    array, known = prefixes.DoubleArray(), {}
    states = [0]
    for _ in range(300):
        state = states.pop(rng.integers(len(states)))
        symbols = np.sort(rng.choice(3000, rng.choice([1, 1, 1, 2, 9, 300]), replace=False))
        new = array.add(np.full(len(symbols), state), symbols)
        known.update(((state, c), t) for c, t in zip(symbols.tolist(), new.tolist()))
        states += new.tolist()
    assert len(set(known.values())) == len(known)
    for (s, c), t in list(known.items())[::7]:
        assert array.walk(np.array([s]), np.array([c]))[0] == t
    missing = [(s, c) for s in {s for s, _ in known} for c in range(0, 3000, 97) if (s, c) not in known]
    assert (array.walk(*map(np.array, zip(*missing))) == -1).all()


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of(queries.op13_conversation_trie(spark, sf)) == rows_of_sql(sql.ORACLES["op13_conversation_trie"], sf)

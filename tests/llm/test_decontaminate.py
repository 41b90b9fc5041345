import random
import re

import pytest

from concord.llm import decontaminate as d
from concord.llm import queries, sql
from tests.llm.oracle import SF, rows_of, rows_of_sql


def low(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, ids = low(text), set(), set()
    for item, t in items:
        x = low(t)
        n = min(13, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[i : i + n]:
                    hit |= set(range(p, p + n))
                    ids |= {item} - {None}
    return len(w), len(hit), sorted(map(str, ids))


def check(spark, docs, items):
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r._n_words, r._n_hit, r._items) for r in d.verdicts(df, bench).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(docs)}
    assert d.drop_contaminated(df, bench).columns == df.columns


@pytest.mark.parametrize("limit", [32 << 20, 700])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "BLOCK_BYTES", limit)
    r = random.Random(3)
    text = lambda n: " ".join(r.choices(["a", "B", "c1", "été", "d"], k=n))
    items = [(1, text(20)), (2, text(13)), (3, text(4)), (4, None), (5, ""), (6, "zz"), (None, "qq qq"), (7, text(30)), (8, text(2) + " zz")]
    long = [text(25) + " " + (items[k][1] or "") + "; " + text(30) for k in range(len(items))]
    check(spark, long + [None, "", "zz", "ZZ-zz", "qq qq", text(12), items[0][1], items[0][1] * 2], items)


def test_empty_tables(spark):
    check(spark, ["a b", None], [])
    check(spark, [], [(1, "a b")])


def test_long_text_in_pieces(monkeypatch):
    from concord.llm import common

    r = random.Random(5)
    text = " ".join(r.choices(["a", "b", "c"], k=3000))
    rows = [("1", low(text)[700:713]), ("2", low(text)[50:60])]
    index = d.Index(rows)
    index.order_by_rarity(index.count([text]))
    want = index.search(text)
    monkeypatch.setattr(d, "blocks", lambda data: common.blocks(data, 64))
    assert index.search(text) == want and want[2] == {"1", "2"} and want[0] == 3000


def test_query_matches_sql(spark):
    name = "op2_benchmark_decontamination"
    assert rows_of(queries.op2_benchmark_decontamination(spark, SF)) == rows_of_sql(sql.ORACLES[name])


def test_pipeline_stage_keeps_columns_of_any_name(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, item, 1, 2, 3, "a", True, 4), (2, "clean words only", 1, 2, 3, "b", False, 4), (3, None, 1, 2, 3, None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans int, _n_words int, _n_hit int, _items string, _contaminated boolean, c0 int")
    kept = d.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[1:]


def test_long_runs_of_benchmark_words(spark, monkeypatch):
    monkeypatch.setattr(d, "RUN_WORDS", 40)
    words = [f"w{i}" for i in range(30)]
    text = " ".join(words * 40)
    monkeypatch.setattr(d, "words", lambda t: (text.encode().split()[i : i + 50] for i in range(0, 1200, 50)))
    index = d.Index([("a", words[:13]), ("b", words[28:] + words[:11])])
    index.order_by_rarity({})
    n, spans, items = index.search(text)
    assert n == 1200 and items == {"a", "b"} and sum(e - s for s, e in spans) == 40 * 13 + 39 * 2

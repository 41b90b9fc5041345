import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from concord.llm import bpe, queries
from concord.llm.common import table
from tests.llm.test_wavelet import ODD

OWN = Tokenizer.from_file(bpe.default_tokenizer())


def brute(text):
    ids = OWN.encode(text or "", add_special_tokens=False).ids
    return ids, OWN.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("chars", [24_000_000, 300])
def test_whole_table_against_the_library(spark, monkeypatch, chars):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
    monkeypatch.setattr(bpe, "BATCH_IDS", 1 << 21 if chars > 1000 else 50)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {tuple(r) for r in queries.op12_bpe(spark, "/root/testdata/sf0.001").collect()}
    want = set()
    for r in docs.collect():
        ids, text = brute(r.text)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want


def test_odd_texts_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcéß1.", k=rng.randint(1, 9))) for _ in range(60_000))
    rows = [*enumerate(ODD), (3, ODD[3]), (3, "other"), (None, "x  y"), (50, "a" * 20_000), (51, long), (52, " \n ")]
    df = spark.createDataFrame([(i, t, 7, "w", t) for i, t in rows], "doc_id long, text string, block int, words string, decoded string")
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in bpe.round_trip(df).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(df).collect()), key=repr) == sorted(((i, brute(t)[0]) for i, t in rows), key=repr)
    assert bpe.round_trip(df.limit(0)).collect() == [] and bpe.encode(df.limit(0)).collect() == []


def test_decode_alone(spark):
    rows = [(1, [49406, 320, 49407]), (2, []), (2, None), (None, [5, None, 10**6, 5])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    want = [(i, OWN.decode([x for x in ids or [] if x is not None], skip_special_tokens=False)) for i, ids in rows]
    assert sorted(map(tuple, bpe.decode(df).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.decode(df.limit(0)).collect() == []


def test_forgetting_words_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(bpe, "TASK_WORDS", 3)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    rows = [(i, f"the cat {i % 3} sat on the mat {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, list(r.ids), r.decoded) for r in bpe.round_trip(df).collect()) == sorted((i, *brute(t)) for i, t in rows)

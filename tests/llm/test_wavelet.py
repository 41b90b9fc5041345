import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from concord.llm import wavelet
from concord.llm.common import table

ODD = [None, "", "it's  A\tTest\x1c! x", "<|endoftext|> a<|startoftext|>b", "é e ́x", "ÀÉ 123 !!?\n\nΣΑΣ", "語 語　語 😀", "\r\n a\r b\x0bc\x85d"]


def brute(rows):
    own = Tokenizer.from_file(wavelet.default_tokenizer())
    out, start = [], 0
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("tokens", [1 << 20, 20])
def test_files_hold_the_ids(spark, monkeypatch, tokens):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", tokens)
    real = [(r.doc_id + 100, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    rows = [(None, "first"), *enumerate(ODD), *sorted(real)]
    df = spark.createDataFrame([(i, t, 1) for i, t in random.Random(1).sample(rows, len(rows))], "doc_id long, text string, part int")
    folder = wavelet.new_folder(spark)
    shards = wavelet.write(df, folder)
    got = sorted(map(tuple, wavelet.read(shards, folder).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert tokens > 1000 or shards.count() > 20


def test_empty_table_and_repeated_ids(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (1, "c")], "doc_id long, text string")
    for d in (df, df.limit(0)):
        folder = wavelet.new_folder(spark)
        got = wavelet.read(wavelet.write(d, folder), folder).collect()
        assert sorted(r.start for r in got) == [2 * i for i in range(d.count())]


def test_rank_select_access():
    ids = np.random.default_rng(1).choice([2, 7, 7, 9, 400, 49405, 3], 3000).astype(np.uint32)
    matrix, docs, sizes = wavelet.unpack(wavelet.pack(ids, [4, None], [1000, 2000]))
    assert (matrix.all() == ids).all() and docs == [4, None] and sizes.tolist() == [1000, 2000]
    assert [matrix.access(i) for i in (0, 511, 512, 2999)] == ids[[0, 511, 512, 2999]].tolist()
    for s in (2, 7, 49405, 8):
        places = np.flatnonzero(ids == s)
        assert matrix.count(s) == len(places) and matrix.count(s, 100, 2050) == ((places >= 100) & (places < 2050)).sum()
        assert [matrix.select(s, j) for j in (0, 5, 10**6)] == ([*places[[0, 5]].tolist(), -1] if len(places) else [-1] * 3)
    one = wavelet.WaveletMatrix.build(np.array([5, 5], np.uint32))
    assert one.all().tolist() == [5, 5] and one.access(1) == 5


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(wavelet, "PART_BYTES", 30)
    tokens, texts = wavelet.Tokens(wavelet.default_tokenizer()), ["Ein Übermaß,\nnone here. " * 9, None, "a\n" * 40, "x" * 90 + " y", *ODD]
    got = [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(tokens.encode(pa.array(texts)))]
    assert got == [(i, n, crc) for i, _, n, crc in brute(enumerate(texts))]


def test_repeated_words_are_numbered_by_arrow():
    tokens, texts = wavelet.Tokens(wavelet.default_tokenizer()), pa.array(["the same few words, again and again " * 1000] * 10)
    tracemalloc.start()
    got = [len(x) for x in tokens.encode(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [8 * 1000 + 1] * 10 and peak < 1 << 20  # a Python object for each of 70,000 words has over 3 MB


def test_a_task_reads_several_shards(spark):
    rows = spark.range(40).selectExpr("id AS doc_id", "concat('word ', id) AS text").repartition(40)
    folder = wavelet.new_folder(spark)
    shards = spark.createDataFrame([(f"s{i}", i, 0, 1, 1) for i in range(40)], "file string, part int, k int, n_docs long, n_tokens long")
    assert wavelet.read(shards, folder).rdd.getNumPartitions() == 10
    assert wavelet.read(wavelet.write(rows, folder), folder).count() == 40

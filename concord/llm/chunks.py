"""Substring dedup by content-defined chunking (operator 4).

1. A gear hash rolls over the words of a text, joined by single spaces. A chunk ends at a space where the hash of the
   last _WINDOW bytes has CUT_BITS zero bits, so cuts depend on nearby bytes only and an insertion moves none of them
   for long. The key of two neighbouring chunks (more, if they are short) is their digest. Spans are chunks by more
   bits, 2 ** SPAN_BITS words long in the mean, and are deduplicated whole by their digest.
2. A PASSAGE-word window has as its own the keys whose cuts its own bytes decide, which are therefore the same in every
   document that has the window. A window that two documents share has shared keys only; so windows are left out if one
   of their own keys is not shared.
3. A key is closed if all of its occurrences, in all documents, lie in spans of one digest. Every document that has a
   window with a closed key of its own, inside such a span, then has the whole span: the span's digest answers for the
   window, which is left out too. So of copies only the seams of spans are compared word by word.
4. A second pass over the texts knows shared and open keys by Bloom filters of bounded size; if there are more keys
   than they can tell apart, by a join. A key that is wrongly taken for shared or open adds windows that are compared
   in vain, and changes no result.
5. Spans and the windows left are compared by their digests. Those that two documents share are repeated passages;
   overlapping ones are joined.

Keys and windows are counted by grouped minimum and maximum of doc_id, so a key that a third of all documents share is
two numbers per task. Those counts are written before they are joined back, which leaves both sides of the join
exchanged and so lets adaptive execution split a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import FILTER_BITS, cut, encode, fresh, key_filter, let_go, may_hold, slices, stored

#: A passage has so many words at least: more than 50.
PASSAGE = 51
#: One space in 2 ** CUT_BITS ends a chunk, in the mean.
CUT_BITS = 2
#: And one in 2 ** SPAN_BITS a span.
SPAN_BITS = 8
#: A key has so many words at least.
KEY_WORDS = 6
#: Up to so many shared keys go by the filter: 8 bits a key.
FILTER_KEYS = FILTER_BITS // 8
#: Bytes of the rolling window, a power of two.
_WINDOW = 16
_PIECE = 1 << 22


def _gear_table() -> np.ndarray:
    """A number for every byte value."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)


_GEAR = _gear_table()


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: the sum of the last _WINDOW bytes' numbers, each shifted by its distance."""
    h, k = _GEAR[data], 1
    while k < _WINDOW:
        far = np.zeros_like(h)
        far[k:] = h[:-k] << np.uint32(k) if len(h) > k else 0
        h, k = h + far, 2 * k
    return h


def _ends(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint32(_WINDOW - 1 - bits)) & np.uint32((1 << bits) - 1) == 0


def chunked(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined words; where each word begins (and one past the end); the words at which chunks begin, and the last end;
    the same of spans."""
    data = b" ".join(encode(text or "").split())
    if not data:
        return data, *(np.zeros(1, np.int64) for _ in range(3))
    raw = np.frombuffer(data, np.uint8)
    space = np.flatnonzero(raw == 32)
    ends, far = np.zeros(len(space), bool), np.zeros(len(space), bool)
    for s in range(0, len(raw), _PIECE):  # in pieces that overlap by the window
        a = max(0, s - _WINDOW)
        h = rolled(raw[a : s + _PIECE])
        here = slice(*np.searchsorted(space, [s, s + _PIECE]))
        at = h[space[here] - a]
        ends[here], far[here] = _ends(at, CUT_BITS), _ends(at, SPAN_BITS)
    starts = np.concatenate([[0], space + 1, [len(data) + 1]])
    cuts, borders = (np.concatenate([[0], np.flatnonzero(x) + 1, [len(space) + 1]]) for x in (ends, far))
    return data, starts, cuts, borders


def keys_of(data: bytes, starts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, number of words) from every cut on: two chunks, or more up to KEY_WORDS words."""
    if len(starts) <= PASSAGE or len(cuts) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.maximum(np.arange(len(cuts)) + 2, np.searchsorted(cuts, cuts + KEY_WORDS))
    fits = last < len(cuts)
    s, e = cuts[fits], cuts[last[fits]]
    digest = xxhash.xxh3_64_intdigest
    key = np.array([digest(data[a:b]) for a, b in zip(starts[s].tolist(), (starts[e] - 1).tolist())], np.uint64)
    return key, s, e - s


def spans_of(data: bytes, starts: np.ndarray, borders: np.ndarray) -> list[bytes]:
    """The digest of each span; empty for spans of fewer than PASSAGE words."""
    digest, at = xxhash.xxh3_128_digest, starts[borders].tolist()
    return [digest(data[a : b - 1]) if n >= PASSAGE else b"" for a, b, n in zip(at, at[1:], np.diff(borders).tolist())]


def home_of(first: np.ndarray, size: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The span that holds each stretch of words (first, size) whole; -1 if none of PASSAGE words or more does."""
    span = np.searchsorted(borders, first, "right") - 1
    whole = (first + size <= borders[np.minimum(span + 1, len(borders) - 1)]) & (np.diff(borders, append=borders[-1])[span] >= PASSAGE)
    return np.where(whole, span, -1)


def _contexts(doc: int, data: bytes, starts: np.ndarray, borders: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each key what it lies in: a number of its span's digest, or one that no other place has."""
    home = home_of(first, size, borders)
    own = np.array([int.from_bytes(d[:8], "little") for d in spans_of(data, starts, borders)] + [0], np.uint64)
    with np.errstate(over="ignore"):
        alone = (np.uint64(doc & (1 << 64) - 1) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(home >= 0, own[home], alone)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, s, ctx) of all documents, and k if there is one: the first word of a key, and what it lies in."""
    for batch in batches:
        for part in slices(batch, 512):
            docs = part.column("doc_id").to_pylist()
            rows = part.column("k").to_pylist() if "k" in part.schema.names else []
            out = {"key": [], "doc_id": [], "s": [], "ctx": []} | ({"k": []} if rows else {})
            for n, (doc, text) in enumerate(zip(docs, part.column("text"))):
                data, starts, cuts, borders = chunked(text.as_py())
                key, first, size = keys_of(data, starts, cuts)
                if len(key):
                    cols = (key, np.full(len(key), doc, np.int64), first.astype(np.int32), _contexts(doc, data, starts, borders, first, size))
                    for c, x in zip(out.values(), (*cols, np.full(len(key), rows[n], np.int64)) if rows else cols):
                        c.append(x)
            kinds = (np.int64, np.int64, np.int32, np.int64, np.int64)
            cols = [pa.array((np.concatenate(c) if c else np.zeros(0, k)).view(k)) for c, k in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays(cols, list(out))


_KEY = "key long, doc_id long, s int, ctx long"


def shared_by_two(rows: DataFrame, key: str) -> DataFrame:
    """(key, first): the keys that two documents or more have, and the smallest of their doc_ids."""
    by = rows.groupBy(key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return cut(by.filter("first < last").select(key, "first"))


def window_starts(starts: np.ndarray, first: np.ndarray, size: np.ndarray, shared: np.ndarray, open_: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where the windows begin that are compared: those without an own key that is not shared and, inside a span, without
    an own key that is not open. Keys have first word, number of words and whether they are shared and open. A
    window's own keys begin _WINDOW bytes after it or later and end before its last word ends; windows without any are
    all compared."""
    w = np.arange(max(0, len(starts) - PASSAGE))
    low = np.searchsorted(starts[first], starts[w] + _WINDOW)
    high = np.maximum(low, np.searchsorted(first + size, w + PASSAGE - 1, "right"))
    single, closed = (np.concatenate([[0], np.cumsum(~x)]) for x in (shared, open_))
    inside = home_of(w, np.full(len(w), PASSAGE), borders) >= 0
    return w[(single[high] == single[low]) & (~inside | (closed[high] == closed[low]))]


def span_starts(borders: np.ndarray, first: np.ndarray, size: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which spans are compared: of PASSAGE words or more, without a key that is not shared."""
    home = home_of(first, size, borders)
    alone = np.bincount(home[(home >= 0) & ~shared], minlength=len(borders) - 1)
    return np.flatnonzero((np.diff(borders) >= PASSAGE) & (alone[: len(borders) - 1] == 0))


def _window_rows(own: DataFrame, known) -> DataFrame:
    """(doc_id, k, s, n, h): spans and windows to compare of own (doc_id, k, text, ...); known(batch, row, key, first) says which
    keys are shared and which are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in chain.from_iterable(slices(b) for b in batches):
            docs, rows, start, many, h = [], [], [], [], []
            for row, (d, k, t) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("k").to_pylist(), part.column("text"))):
                data, starts, cuts, borders = chunked(t.as_py())
                key, first, size = keys_of(data, starts, cuts)
                shared, open_ = known(part, row, key, first)
                spans = span_starts(borders, first, size, shared)
                windows = window_starts(starts, first, size, shared, open_, borders)
                s = np.concatenate([borders[spans], windows])
                n = np.concatenate([np.diff(borders)[spans], np.full(len(windows), PASSAGE)])
                docs.append(np.full(len(s), d, np.int64))
                rows.append(np.full(len(s), k, np.int64))
                start.append(s)
                many.append(n)
                h += [digest(data[a:b]) for a, b in zip(starts[s].tolist(), (starts[s + n] - 1).tolist())]
            cols = [np.concatenate(docs), np.concatenate(rows), np.concatenate(start).astype(np.int32), np.concatenate(many).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(h, pa.binary())], ["doc_id", "k", "s", "n", "h"])

    return own.mapInArrow(run, "doc_id long, k long, s int, n int, h binary")


def _by_filter(own: DataFrame, common: DataFrame, n: int) -> DataFrame:
    shared, open_ = key_filter(common, n), key_filter(common.filter("open"), n)

    def known(_, __, key: np.ndarray, ___) -> tuple[np.ndarray, np.ndarray]:
        return may_hold(shared.value, key), may_hold(open_.value, key)

    return _window_rows(own, known)


def _by_join(own: DataFrame, common: DataFrame) -> DataFrame:
    keyed = own.mapInArrow(_keys, f"{_KEY}, k long").join(common, "key")
    marked = keyed.groupBy("k").agg(F.collect_set("s").alias("at"), F.collect_set(F.when(F.col("open"), F.col("s"))).alias("wide"))

    def known(batch: pa.RecordBatch, row: int, _, first: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(np.isin(first, batch.column(c)[row].as_py() or []) for c in ("at", "wide"))

    return _window_rows(own.join(marked, "k", "left"), known)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id): every stretch of documents' words that consists of passages of
    PASSAGE or more words which another document has too. first_doc_id is the smallest doc_id that has one of them; the
    stretch of that document itself is listed as well (keep it, and drop the others).

    Words are parted by ASCII white space and compared byte by byte. Repeats within one document do not count, nor do
    rows with a null doc_id; rows that share a doc_id are one document to each other, so repeated rows are no repeats.
    Null, empty and shorter texts, and empty tables, give no rows. Other columns are ignored. Every passage is found. A text of any length is handled whole in
    the task that has its row, with some 50 bytes for each of its words."""
    return _passages(docs).drop("k")


def _row_key() -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _passages(docs: DataFrame) -> DataFrame:
    """repeated_passages with k, the _row_key() of their row: stretches of different texts under one doc_id stay apart."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("k"), F.col("text").cast("string").alias("text"))
    own = own.filter("doc_id is not null and text is not null")
    seen = own.drop("k").mapInArrow(_keys, _KEY).groupBy("key").agg(*(f(c).alias(f"{n}_{c}") for c in ("doc_id", "ctx") for n, f in (("min", F.min), ("max", F.max))))
    common = cut(seen.filter("min_doc_id < max_doc_id").select("key", (F.col("min_ctx") < F.col("max_ctx")).alias("open")))
    n = common.count()
    let_go(docs.sparkSession)
    found = stored(_by_filter(own, common, n) if n <= FILTER_KEYS else _by_join(own, common))
    same = shared_by_two(found, "h")
    let_go(docs.sparkSession)
    hits = found.join(same, "h").select("doc_id", "k", "s", "n", "first")
    each = hits.groupBy("doc_id", "k").agg(F.sort_array(F.collect_set(F.struct("s", "n", "first"))).alias("x"))
    return each.mapInArrow(_joined, "doc_id long, k long, start_word long, n_words long, first_doc_id long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for d, k, x in zip(b.column("doc_id").to_pylist(), b.column("k").to_pylist(), b.column("x").to_pylist()):
            open_: list | None = None
            for r in x:
                if open_ and r["s"] <= open_[3]:
                    open_[3], open_[4] = max(open_[3], r["s"] + r["n"]), min(open_[4], r["first"])
                else:
                    if open_:
                        out.append(tuple(open_))
                    open_ = [d, k, r["s"], r["s"] + r["n"], r["first"]]
            if open_:
                out.append(tuple(open_))
        d, k, s, e, f = zip(*out) if out else ((),) * 5
        cols = [pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array([y - x for x, y in zip(s, e)], pa.int64()), pa.array(f, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k", "start_word", "n_words", "first_doc_id"])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words of repeated passages taken out of text, save in the document that has them first (by
    doc_id). Changed texts have their words joined by single spaces; other texts, and all other columns, stay."""
    names, (row, gone) = docs.columns, fresh(docs.columns, "_row", "_gone")
    found = _passages(docs).filter("doc_id <> first_doc_id")
    by = found.groupBy(F.col("k").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias(gone))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            text = []
            for t, spans in zip(b.column("text").to_pylist(), b.column(gone).to_pylist()):
                if t is not None and spans:
                    words = encode(t).split()
                    for x in reversed(spans):
                        del words[x["start_word"] : x["start_word"] + x["n_words"]]
                    t = b" ".join(words).decode()
                text.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(text, f.type) if f.name == "text" else c for f, c in zip(b.schema, b.columns)], schema=b.schema)

    both = docs.join(by, _row_key() == F.col(row), "left").select(*names, gone)
    return both.mapInArrow(taken, both.schema).select(*names)

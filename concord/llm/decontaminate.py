"""Benchmark decontamination by a prefix-filtered set join (operator 2).

A window is WINDOW consecutive words of an item (the whole item if it has fewer). It is contained in a document only if
all of its shingles are, so the necessary prefix of a window, its shingles ordered by rarity, is one: the rarest.

1. Rarity: one map pass over all documents counts the benchmark's shingles; partial counts are added up by Spark.
2. Each window is indexed under its rarest shingle, with that shingle's position in the window.
3. A second map pass looks up the documents' shingles. Length bound: only runs of benchmark words at least as long as
   the shortest window are looked at. Positional bound: the window must fit before and after the match. A candidate is
   then verified word by word over the window.

The index of a block of windows is broadcast; a block holds at most BLOCK_BYTES of window text (checked by a sum over
the benchmark). A larger benchmark is dealt into several blocks, and the documents are passed over once for each, so
neither the driver nor a worker ever holds more than one block. The documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import blocks, cut, encode

WINDOW = 13
#: Words in a shingle; a window of fewer words is one shingle.
SHINGLE = 3
#: A document is contaminated if a 1/SHARE of its words, or more, is hit.
SHARE = 20
#: Words of a run that are looked at together.
RUN_WORDS = 1 << 16
#: Most bytes of window text in one broadcast block.
BLOCK_BYTES = 32 << 20

#: Words are runs of ASCII digits, lower-cased letters and all characters beyond ASCII; everything else parts them.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    for part in blocks(encode(text or "").translate(_WORDS)):
        yield part.split()


def windows_of(benchmark: DataFrame) -> DataFrame:
    """(item_id string, window array<string>): the distinct windows of every item."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.col("w")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (WINDOW - 1)))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(lower, F.lit(_ITEM_WORDS), 0).alias("w"))
        .filter(F.size("w") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i, WINDOW))).alias("window"))
        .distinct()
    )


class Index:
    """A block of windows, ready to be searched for: built on the driver, broadcast, and read by every task."""

    def __init__(self, rows: list[tuple[str | None, list[str]]]):
        texts: dict[tuple, list] = {}
        for item, window in rows:
            texts.setdefault(tuple(encode(x) for x in window), []).append(item)
        self.items = list(texts.values())
        vocabulary = sorted({x for w in texts for x in w})
        self.word_id = {x: i + 1 for i, x in enumerate(vocabulary)}
        self.windows = [np.array([self.word_id[x] for x in w], np.int64) for w in texts]
        self.shortest = min(map(len, self.windows), default=1)
        self.base = len(vocabulary) + 1
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})
        self.shingles = {n: np.unique(np.concatenate([self.codes(w, n) for w in self.windows if min(SHINGLE, len(w)) == n])) for n in self.sizes}
        self.prefix: dict[int, tuple[np.ndarray, list]] = {}

    def codes(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A number for each run of n words; 0 where one of them is no benchmark word. Numbers of very large vocabularies run
        over and may then coincide: what they find is compared word by word."""
        out = np.zeros(max(0, len(ids) - n + 1), np.int64)
        known = np.ones(len(out), bool)
        for k in range(n):
            part = ids[k : k + len(out)]
            out = out * self.base + part
            known &= part > 0
        return np.where(known, out, 0)

    def order_by_rarity(self, counts: dict[tuple[int, int], int]) -> None:
        """Put every window under its rarest shingle: the first of those with the lowest count."""
        found: dict[int, dict[int, list]] = {n: {} for n in self.sizes}
        for k, w in enumerate(self.windows):
            n = min(SHINGLE, len(w))
            codes = self.codes(w, n).tolist()
            at = min(range(len(codes)), key=lambda i: (counts.get((n, codes[i]), 0), codes[i], i))
            found[n].setdefault(codes[at], []).append((at, k))
        self.prefix = {n: (np.array(sorted(x), np.int64), x) for n, x in found.items()}

    def stretches(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, word ids) of the runs of benchmark words that are long enough to hold a window; last (number of
        words, nothing). Runs go on over the pieces of a long text; one of more than RUN_WORDS is handed on in parts
        that overlap by a window."""
        at, open_ids, get = 0, np.zeros(0, np.int64), self.word_id.get
        for part in words(text):
            ids = np.fromiter((get(w, 0) for w in part), np.int64, len(part))
            ids = np.concatenate([open_ids, ids])
            begin = at - len(open_ids)
            at += len(part)
            unknown = np.flatnonzero(ids == 0)
            edges = np.concatenate([[-1], unknown, [len(ids)]])
            for k in np.flatnonzero(np.diff(edges) > self.shortest):
                s, e = edges[k] + 1, edges[k + 1]
                if e < len(ids):
                    yield begin + s, ids[s:e]
            open_ids = ids[edges[-2] + 1 :]
            if len(open_ids) > RUN_WORDS:
                yield at - len(open_ids), open_ids
                open_ids = open_ids[-(WINDOW - 1) :]
        if len(open_ids) >= self.shortest:
            yield at - len(open_ids), open_ids
        yield at, np.zeros(0, np.int64)

    def count(self, texts: Iterator[str | None]) -> dict[tuple[int, int], int]:
        """How often each benchmark shingle occurs in texts."""
        total = {n: np.zeros(len(s), np.int64) for n, s in self.shingles.items()}
        for text in texts:
            for _, ids in self.stretches(text):
                for n, known in self.shingles.items():
                    codes = self.codes(ids, n)
                    if len(codes):
                        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                        np.add.at(total[n], at[known[at] == codes], 1)
        return {(n, int(self.shingles[n][i])): int(total[n][i]) for n in total for i in np.flatnonzero(total[n])}

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """The number of words, the spans that windows cover (merged, in order), and the items they are of."""
        n_words, spans, items = 0, [], set()
        for begin, ids in self.stretches(text):
            n_words = begin + len(ids)
            for n, (keys, under) in self.prefix.items():
                codes = self.codes(ids, n)
                if not len(codes):
                    continue
                near = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                for i in np.flatnonzero(keys[near] == codes).tolist():
                    for offset, k in under[int(codes[i])]:
                        window = self.windows[k]
                        s = i - offset
                        if s >= 0 and s + len(window) <= len(ids) and (ids[s : s + len(window)] == window).all():
                            spans.append((begin + s, begin + s + len(window)))
                            items.update(self.items[k])
        return n_words, merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _rarity(docs: DataFrame, index: Broadcast) -> dict[tuple[int, int], int]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value.count(t.as_py() for b in batches for t in b.column(0))
        yield pa.RecordBatch.from_pydict(
            {"n": pa.array([k[0] for k in found], pa.int32()), "code": pa.array([k[1] for k in found], pa.int64()), "c": pa.array(list(found.values()), pa.int64())}
        )

    rows = docs.select(F.col("text").cast("string")).mapInArrow(counted, "n int, code long, c long").groupBy("n", "code").agg(F.sum("c").alias("c"))
    return {(r.n, r.code): r.c for r in rows.collect()}  # at most the shingles of one block of windows


def annotate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with _n_words, _spans (merged word spans [s, e) that windows cover) and _items (sorted item ids).

    Windows that several items share count for each. A null text has no words; a null item_id's windows hit, but the
    item is not listed. Repeated rows each get their own answer; an empty benchmark hits nothing. Columns of docs stay,
    whatever their names (those three excepted, which are replaced)."""
    spark = docs.sparkSession
    windows = cut(windows_of(benchmark))
    size = windows.agg(F.sum(F.length(F.array_join("window", " ")) + F.lit(40))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    names = [c for c in docs.columns if c not in ("_n_words", "_spans", "_items")]
    span = "array<struct<s:long,e:long>>"
    out = docs.select(*names).withColumns({"_n_words": F.lit(0).cast("long"), "_spans": F.array().cast(span), "_items": F.array().cast("array<string>")})
    for block in range(n_blocks):
        part = windows.filter(F.pmod(F.xxhash64("window", "item_id"), F.lit(n_blocks)) == block)
        index = Index([(r.item_id, r.window) for r in part.collect()])  # one block
        if index.windows:
            index.order_by_rarity(_rarity(docs, first := spark.sparkContext.broadcast(index)))
            first.unpersist()
        held = spark.sparkContext.broadcast(index)

        def searched(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n_words, spans, items = [], [], []
                for text, s0, i0 in zip(b.column("text"), b.column("_spans"), b.column("_items")):
                    n, s, i = held.value.search(text.as_py())
                    n_words.append(n)
                    spans.append([{"s": x, "e": y} for x, y in merged(s + [(x["s"], x["e"]) for x in s0.as_py()])])
                    items.append(sorted({x for x in i if x is not None} | set(i0.as_py())))
                new = {"_n_words": pa.array(n_words, pa.int64()), "_spans": pa.array(spans, b.schema.field("_spans").type), "_items": pa.array(items, b.schema.field("_items").type)}
                yield pa.RecordBatch.from_arrays([new.get(c, b.column(i)) for i, c in enumerate(b.schema.names)], schema=b.schema)

        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
        out = out.mapInArrow(searched, schema)
        if block + 1 < n_blocks:
            out = cut(out)
    return out


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with _n_words, _n_hit, _items and _contaminated (a SHARE-th of the words hit, and at least one)."""
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    found = annotate(docs, benchmark).withColumn("_n_hit", hit)
    return found.withColumn("_contaminated", _rule(F.col("_n_hit"), F.col("_n_words"))).drop("_spans")


def _rule(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' own columns, whatever their names. A null text has no words and
    is not contaminated; repeated rows go or stay together; an empty benchmark contaminates nothing."""
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]  # annotate() has names of its own
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    found = annotate(docs.select("text", *own), benchmark)
    return found.filter(~_rule(hit, F.col("_n_words"))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


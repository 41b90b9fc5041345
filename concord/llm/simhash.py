"""SimHash near-duplicates by bit-sliced comparison (operator 9).

1. One map pass makes a 64-bit fingerprint of each document's 3-word shingles.
2. Equal fingerprints are one class. Distinct fingerprints are dealt by agreeing bits: with four 16-bit blocks and a
   radius of 2, two near fingerprints agree in at least two blocks, so six 32-bit keys lose no pair.
3. Within a key the fingerprints are stored as bit planes (plane b holds bit b of 64 members in a word). A carry-save
   counter adds plane after plane for 64 distances at once; a block whose distances all exceed the radius is
   abandoned. Only a spanning set of links leaves a key.
4. Keys with more than KEY_ROWS members are not compared; their members are dealt anew by twelve blocks of which ten
   agree (66 keys of 52 bits or more). Such a key has at most 4096 distinct members, so no pair is lost and no task
   grows with the input.
5. Components of the links are found by star contraction; a document's component is the smallest doc_id in it.

keep_one, the stage of a pipeline, follows the general rule for near duplicates instead: wider fingerprints of 5-word
shingles, keys of sampled bits, the same bit-sliced comparison within keys, and an exact check of the links (see similar).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import blocks, connected_components, cut, encode, let_go, slices, stored

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: A key with more distinct fingerprints is refined; the bound keeps a task's comparison below about a million pairs.
KEY_ROWS = 1024
#: (block, query) pairs compared at once, which bounds a task's arrays.
LANES = 1 << 15
#: Near duplicates by the general rule: words in a shingle, least similarity, bits of a fingerprint, and the bits that may
#: differ in a pair that is checked (three standard deviations above the mean of the least similarity).
NEAR_WORDS, NEAR_SHARE, WIDE_BITS, NEAR_RADIUS = 5, 0.8, 128, 31
#: The chance that two texts of the least similarity share a key.
RECALL = 0.95
#: Fingerprints of a key in a block.
BLOCK_ROWS = 1024
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, as a signed integer.

    Null or without words: 0. Fewer than three words: their sequence is the one shingle."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for part in blocks(encode(text or "")):
        words = tail + part.lower().split()
        if len(words) >= SHINGLE_WORDS:
            grams = map(b" ".join, zip(words, words[1:], words[2:]))
            digest = xxhash.xxh64_intdigest
            h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(words) - 2)
            for i in range(0, len(h), 4096):
                bits = np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.uint16)
            total += len(h)
            words = words[-2:]
        tail = words
    if not total and tail:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)
        ones, total = np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = pa.array((fingerprint(t.as_py()) for t in batch.column("text")), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def _masks(n_blocks: int, agree: int) -> list[int]:
    """One mask for each choice of agreeing blocks."""
    edges = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, agree)]


def _keyed(fps: DataFrame, n_blocks: int) -> DataFrame:
    """(key, fp): a row for each choice of n_blocks - RADIUS agreeing blocks."""
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(n_blocks, n_blocks - RADIUS)]
    keys = [F.struct(F.lit(i).cast("byte").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of up to 64 x n fingerprints: row i, column b holds bit b of members 64 i .. 64 i + 63."""
    n = -(-len(fps) // 64)
    padded = np.zeros(n * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 64, 8), axis=2, bitorder="little")
    vertical = np.ascontiguousarray(bits.transpose(0, 2, 1))
    return np.packbits(vertical.reshape(n * 64, 64), axis=1, bitorder="little").copy().view(np.uint64).reshape(n, 64)


def _above(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Where bit-sliced counts exceed the radius, or have run over."""
    more, equal = over, ~over
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            more, equal = more | (equal & count[k]), equal & ~count[k]
    return more


def within(planes_of: np.ndarray, valid: np.ndarray, block: np.ndarray, query: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (block[i], query[i]): positions i that have members within radius, and their 64-bit member masks.
    query has a word of 64 bits for every 64 planes."""
    query = query.reshape(len(block), -1)
    alive = np.arange(len(block))
    count = [np.zeros(len(block), np.uint64) for _ in range(radius.bit_length())]
    over = ~valid[block]
    n_planes = planes_of.shape[1]
    for b in range(n_planes):
        carry = planes_of[block[alive], b] ^ ((query[alive, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)) * _ALL
        for k, c in enumerate(count):
            count[k], carry = c ^ carry, c & carry
        over = over | carry
        if b % 8 == 7:
            gone = _above(count, over, radius)
            keep = gone != _ALL
            if not keep.all():
                alive, over, count = alive[keep], over[keep], [c[keep] for c in count]
    return alive, ~_above(count, over, radius)


def _members(groups: list[np.ndarray]) -> np.ndarray:
    """The members of all groups, a row each, of one or more words."""
    return np.concatenate(groups).reshape(sum(map(len, groups)), -1)


def _near_pairs(groups: list[np.ndarray], radius: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (in _members) of all pairs within the radius, at_once (block, query) comparisons after the other: 64 times
    as many pairs at most."""
    sizes = np.array([len(g) for g in groups])
    base = np.concatenate([[0], np.cumsum(-(-sizes // 64))])
    flat = _members(groups)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    parts = [flat[a:b] for a, b in zip(starts, starts[1:])]
    store = np.concatenate([np.concatenate([planes(g[:, w]) for w in range(flat.shape[1])], axis=1) for g in parts])
    lanes = np.concatenate([np.minimum(64, np.maximum(0, s - 64 * np.arange(-(-s // 64)))) for s in sizes])
    valid = np.where(lanes == 64, _ALL, (np.uint64(1) << lanes.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    n_blocks = np.diff(base)
    group = np.repeat(np.arange(len(groups)), sizes)
    tasks = np.repeat(np.arange(len(flat)), n_blocks[group])
    nth = np.arange(len(tasks)) - np.repeat(np.cumsum(n_blocks[group]) - n_blocks[group], n_blocks[group])
    block = base[group[tasks]] + nth
    for i in range(0, len(tasks), at_once):
        q = tasks[i : i + at_once]
        hit, mask = within(store, valid, block[i : i + at_once], flat[q], radius)
        bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        at = hit[row]
        other = starts[group[q[at]]] + 64 * nth[i : i + at_once][at] + lane
        right_of = other > q[at]
        yield q[at][right_of], other[right_of]


def _pairs(groups: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Spanning links (fp, smaller fp) of each group's near pairs."""
    flat = _members(groups)[:, 0]
    a, b = (np.concatenate(x) for x in zip(*_near_pairs(groups, RADIUS, LANES)))
    label = np.arange(len(flat))
    while len(a):  # smallest member that links reach
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(flat)))
    yield from zip(flat[moved], flat[label[moved]])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("fps")
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        groups, rows, out = [], 0, []
        for s, e in zip(offsets, offsets[1:]):
            groups.append(np.sort(values[s:e]))
            rows += e - s
            if rows >= 4096:
                out += _pairs(groups)
                groups, rows = [], 0
        if groups:
            out += _pairs(groups)
        both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _compared(keyed: DataFrame) -> DataFrame:
    """Links within the keys of keyed (key, fp), whose groups are bounded."""
    return keyed.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_links, "a long, b long")


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints fps (fp) at RADIUS or fewer differing bits."""
    keyed = _keyed(fps, 4)
    counts = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = keyed.join(counts, "key")
    links = _compared(shared.filter(F.col("n") <= KEY_ROWS))
    if counts.filter(F.col("n") > KEY_ROWS).isEmpty():
        return links
    hot = cut(shared.filter(F.col("n") > KEY_ROWS).select("fp").distinct())
    finer = _keyed(hot, 12)
    several = cut(finer.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    return links.unionByName(_compared(finer.join(several.select("key"), "key")))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text); other columns are ignored.

    component_id is the smallest doc_id reachable over links of RADIUS or fewer differing bits. Null, empty and
    word-less texts have fingerprint 0 and link like any other. Repeated rows each give a row. A null doc_id takes
    part but never names a component, unless all of its component are null. An empty table gives no rows."""
    each = cut(fingerprints(docs))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return _named(each, fps, near_links(fps.select("fp")))


def wide_fingerprint(text: str | None) -> bytes:
    """The WIDE_BITS-bit SimHash of a text's shingles of NEAR_WORDS words, repeats included; fewer words: their sequence.
    Null or without words: zero bits."""
    ones, total, tail = np.zeros(WIDE_BITS, np.int64), 0, []
    for part in blocks(encode(text or "")):
        words = tail + part.lower().split()
        for h in _shingle_digests(words):
            ones += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        tail = words[-(NEAR_WORDS - 1) :]
    if not total and tail:
        ones, total = np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(tail)), np.uint8), bitorder="little").astype(np.int64), 1
    return np.packbits(2 * ones > total, bitorder="little").tobytes()


def _shingle_digests(words: list[bytes]) -> Iterator[np.ndarray]:
    digest = xxhash.xxh3_128_digest
    grams = list(map(b" ".join, zip(*(words[k:] for k in range(NEAR_WORDS)))))
    for i in range(0, len(grams), 4096):
        yield np.frombuffer(b"".join(map(digest, grams[i : i + 4096])), np.uint8).reshape(-1, WIDE_BITS // 8)


def shingle_set(text: str | None) -> np.ndarray:
    """32-bit digests of the distinct shingles of NEAR_WORDS words, sorted."""
    parts, tail = [], []
    for part in blocks(encode(text or "")):
        words = tail + part.lower().split()
        grams = set(map(b" ".join, zip(*(words[k:] for k in range(NEAR_WORDS)))))
        parts.append(np.fromiter(map(xxhash.xxh32_intdigest, grams), np.uint32, len(grams)))
        tail = words[-(NEAR_WORDS - 1) :]
    if not any(map(len, parts)) and tail:
        parts = [np.array([xxhash.xxh32_intdigest(b" ".join(tail))], np.uint32)]
    return np.unique(np.concatenate(parts)).view(np.int32)


def recall_of(tables: int, bits: int, share: float) -> float:
    """The chance that two texts of a similarity share a key of so many sampled bits in one of the tables, and differ in
    NEAR_RADIUS bits or fewer: their bits agree each with the chance that the angle of their shingle sets gives."""
    differ = np.arccos(2 * share / (1 + share)) / np.pi
    chance = 0.0
    for d in range(NEAR_RADIUS + 1):
        often = comb(WIDE_BITS, d) * differ**d * (1 - differ) ** (WIDE_BITS - d)
        same = np.prod([(WIDE_BITS - d - i) / (WIDE_BITS - i) for i in range(bits)])
        chance += often * (1 - (1 - same) ** tables)
    return float(chance)


def tables_for(n: int) -> np.ndarray:
    """Masks (table, word) of the sampled bits that n fingerprints are dealt by. A key has more bits where there are more
    fingerprints, so that keys stay small, and there are as many tables as give two texts of NEAR_SHARE similarity
    RECALL of a chance to share a key, at any n. All tables sample the same bits, so the chance is that of each number of
    bits that may differ, weighed by how often so many do."""
    bits = min(48, max(16, n.bit_length() - 2))
    count = 1
    while recall_of(count, bits, NEAR_SHARE) < RECALL:
        count += max(1, count // 20)
    rng = np.random.default_rng(SEED)
    out = np.zeros((count, WIDE_BITS), np.uint8)
    for row in out:
        row[rng.choice(WIDE_BITS, bits, replace=False)] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def _dealt(masks: np.ndarray):
    """(key, fp) for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(at, 4096)
                words = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(fp), -1)
                key = np.empty((len(fp), len(masks)), np.uint64)
                with np.errstate(over="ignore"):
                    for t, mask in enumerate(masks):
                        x = np.full(len(fp), t + 1, np.uint64)
                        for w in range(words.shape[1]):
                            x = (x ^ (words[:, w] & mask[w])) * np.uint64(0x9E3779B97F4A7C15)
                            x ^= x >> np.uint64(29)
                        key[:, t] = x
                fps = fp.take(pa.array(np.repeat(np.arange(len(fp)), len(masks))))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), fps], ["key", "fp"])

    return run


def _spanning(n: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the links a, b among n members make a minimum spanning forest: every component takes its nearest link to
    another, until there are none."""
    order = np.lexsort((b, a, apart))
    label, chosen = np.arange(n), []
    while True:
        la, lb = label[a[order]], label[b[order]]
        cross = la != lb
        order, la, lb = order[cross], la[cross], lb[cross]
        if not len(order):
            return np.concatenate(chosen) if chosen else order
        _, at = np.unique(np.stack([la, lb], axis=1).ravel(), return_index=True)  # the first, so nearest, of each component
        take = np.unique(at // 2)
        chosen.append(order[take])
        x, y = la[take], lb[take]
        while True:
            m = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, m)
            np.minimum.at(new, y, m)
            new = new[new]
            if (new == label).all():
                break
            label = new


def forest(groups: list[np.ndarray], radius: int) -> list[tuple[bytes, bytes]]:
    """A minimum spanning forest, by differing bits, of each group's pairs within the radius. Pairs are looked at a part
    at a time, and only the forest of those so far is kept."""
    flat = _members(groups)
    kept = [np.zeros(0, np.int64) for _ in range(3)]
    for a, b in _near_pairs(groups, radius, LANES // 8):
        apart = np.bitwise_count(flat[a] ^ flat[b]).sum(axis=1)
        kept = [np.concatenate(x) for x in zip(kept, (a, b, apart))]
        if len(kept[0]) > 2 * len(flat):
            chosen = _spanning(len(flat), *kept)
            kept = [x[chosen] for x in kept]
    chosen = _spanning(len(flat), *kept)
    raw, n = flat.tobytes(), flat.shape[1] * 8
    both = zip(kept[0][chosen].tolist(), kept[1][chosen].tolist())
    return [(raw[i * n : (i + 1) * n], raw[j * n : (j + 1) * n]) for i, j in both]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("fps")
        out: list[tuple[bytes, bytes]] = []
        groups, rows = [], 0
        for fps in column:
            own = sorted(set(fps.as_py()))
            groups.append(np.frombuffer(b"".join(own), np.uint64).reshape(len(own), -1))
            rows += len(own)
            if rows >= 4096:
                out += forest(groups, NEAR_RADIUS)
                groups, rows = [], 0
        if groups:
            out += forest(groups, NEAR_RADIUS)
        yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.binary()), pa.array([max(x) for x in out], pa.binary())], ["a", "b"])


def candidate_links(fps: DataFrame) -> DataFrame:
    """Distinct links (a, b) of fps (fp binary, distinct): for every key the nearest links that span its near pairs. Keys of
    more than BLOCK_ROWS fingerprints are compared in pairs of blocks."""
    n = fps.count()
    keyed = fps.mapInArrow(_dealt(tables_for(n)), "key long, fp binary")
    counts = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    n_blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    own = keyed.join(counts, "key").withColumn("o", F.pmod(F.xxhash64("fp"), n_blocks).cast("int"))
    own = own.withColumn("p", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    sets = own.groupBy("key", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j")).agg(F.collect_list("fp").alias("fps"))
    return sets.select("fps").mapInArrow(_forests, "a binary, b binary").distinct()


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, fp binary, component_id) for every row of docs (doc_id, text): near duplicates by the general rule.

    Two texts are linked if the sets of their shingles of NEAR_WORDS words have a Jaccard similarity of NEAR_SHARE or
    more. Candidates come from WIDE_BITS-bit SimHashes: a pair that shares one of the sampled keys is compared bit by
    bit, and the nearest links of each key, within NEAR_RADIUS bits, are checked exactly. The keys find a pair at the
    very border with a chance of RECALL, closer pairs almost surely. Texts with equal fingerprints are one. Words are
    parted by ASCII white space, A-Z lower-cased. component_id is the smallest doc_id reachable; null, empty and word-less
    texts are one group; a null doc_id takes part and names no component unless all of it are null."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array((wide_fingerprint(t.as_py()) for t in batch.column("text")), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), fp], ["doc_id", "k", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shingle_set(t.as_py()) for t in part.column("text")]
                offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("fp"), lists], ["fp", "own"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("k", F.xxhash64("doc_id", "text"))
    each = stored(own.mapInArrow(made, "doc_id long, k long, fp binary"))
    first = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("k").alias("k")))
    links = cut(candidate_links(first.select("fp")))
    let_go(docs.sparkSession)
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    of = stored(own.join(first.join(ends, "fp").select("k", "fp"), "k").select("text", "fp").mapInArrow(sets, "fp binary, own array<int>").dropDuplicates(["fp"]))
    both = links.join(of.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    near = both.filter(same >= NEAR_SHARE * (F.size("x") + F.size("y") - same)).select("a", "b")
    return _named(each, first.select("fp", "first"), near)


def _named(each: DataFrame, fps: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): each row's component, named by its smallest doc_id."""
    roots = cut(connected_components(links).withColumnRenamed("node", "fp"))
    linked = fps.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("fp", "least")
    of = cut(fps.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return each.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates (see similar): that with the smallest doc_id.

    All columns stay as they are. A document is its doc_id: rows that repeat a kept doc_id become one row, and a
    doc_id with several texts stays if it names the component of any. Rows without a doc_id all stay."""
    known = similar(docs.select("doc_id", "text")).filter("doc_id is not null")
    ids = cut(known.groupBy("doc_id").agg(F.max(F.expr("doc_id = component_id")).alias("names"), F.count("*").alias("n")))
    kept = docs.join(ids.filter("not names").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = ids.filter("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)

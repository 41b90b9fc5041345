"""Line dedup by a segment-partition edit join (operator 6).

Lines of MIN_CHARS or more characters are near if at most EDITS edits (insert, delete, replace a character) part them.

1. A line is split into EDITS + 1 segments. Of any two near lines the longer one holds a segment of the shorter one
   unharmed, shifted by no more than the edits before and after it allow. So every line is indexed under (its length,
   segment number, segment), and probes for each shorter length only the substrings that could be such a segment.
2. Keys with two different lines are found by grouped minimum and maximum of a line hash; only their lines go on, each
   distinct one once with its text. The rest is passed over by a filter of those keys, of bounded size, and an exact join.
3. Within a key, pairs are verified by a banded bit-parallel automaton: for each number of edits a bit vector over the
   2 EDITS + 1 diagonals of the band, stepped for many pairs at once. Only links that span a key's components leave it.
4. A key with more than KEY_ROWS lines is verified in pairs of blocks of KEY_ROWS, in as many tasks; a filter of these
   keys, of bounded size, spares the lines of all others a second shuffle. A key with more than REFINE_ROWS is dealt anew
   first: its lines, without the common segment, are split and indexed below that key, and so on for REFINE_LEVELS levels.
5. Components of the links, with equal lines as one, are the classes. The first line of a class by (doc_id, place)
   stays; all others go. Shorter lines are classes of equal lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import connected_components, cut, encode, fresh, key_filter, let_go, may_hold, slices, stored

EDITS = 2
MIN_CHARS = 20
KEY_ROWS = 256
REFINE_ROWS = 4096
#: How often a large key is dealt anew; what is still large then is verified in pairs of blocks.
REFINE_LEVELS = 2
#: Characters compared at once; lines of more than LONG lose their common ends first.
CHARS, LONG = 1 << 20, 1 << 8


def split(text: str | None) -> list[str]:
    return (text or "").split("\n")


def plain(line: str) -> str:
    """A line as it is compared: without white space at its ends."""
    return line.strip()


def _segments(size: int) -> list[tuple[int, int]]:
    """(start, length) of the EDITS + 1 segments of a line of size characters; the longer ones come last."""
    k = EDITS + 1
    base, more = divmod(size, k)
    out, at = [], 0
    for i in range(k):
        n = base + (i >= k - more)
        out.append((at, n))
        at += n
    return out


_plans: dict[tuple[int, int], np.ndarray] = {}


def _plan(size: int, least: int) -> np.ndarray:
    """Rows (length of the shorter line, segment, start, length) of all substrings of a line that are looked at; the first
    EDITS + 1 are its own segments."""
    found = _plans.get((size, least))
    if found is None:
        rows = [(size, i, s, n) for i, (s, n) in enumerate(_segments(size))]
        for gap in range(EDITS + 1):
            if size - gap < least:
                break
            for i, (s, n) in enumerate(_segments(size - gap)):
                low = max(-i, gap - (EDITS - i), -((EDITS - gap) // 2))
                high = min(i, gap + (EDITS - i), (EDITS + gap) // 2)
                for shift in range(low, high + 1):
                    if (gap or shift) and 0 <= s + shift and s + shift + n <= size:
                        rows.append((size - gap, i, s + shift, n))
        found = np.array(rows, np.int64)
        if len(_plans) < 1 << 14:
            _plans[size, least] = found
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: The base of the substrings' polynomial digest, modulo 2 ** 64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of _BACK, or more; n is about CHARS at most."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), x, np.uint64)]), dtype=np.uint64) for x in (_BASE, _BACK)]
    return _powers[0], _powers[1]


def _long_digest(code: np.ndarray) -> int:
    """The polynomial digest of mixed code points, block by block."""
    up, total = _power_tables(CHARS)[0], 0
    for i in range(0, len(code), CHARS):
        part = code[i : i + CHARS]
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, i, 1 << 64)
    return total & (1 << 64) - 1


def keys(lines: list[str], least: int, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of the line, start, length) of the substrings that lines are indexed under or probe for: a digest of
    the substring, its segment, the shorter line's length and the line's seed. Substrings are digested from prefix
    sums of a polynomial, all at once; lines of more than CHARS characters block by block."""
    parts, at = [], 0
    while at < len(lines):
        end, chars = at + 1, len(lines[at])
        while end < len(lines) and chars + len(lines[end]) <= CHARS:
            chars += len(lines[end])
            end += 1
        part = lines[at:end]
        plan = [_plan(len(x), least) for x in part]
        own = np.repeat(np.arange(len(part)), [len(p) for p in plan])
        size, segment, start, n = np.concatenate(plan).T
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        with np.errstate(over="ignore"):
            code = (code + np.uint64(1)) * np.uint64(_BACK)
            code ^= code >> np.uint64(29)
            if chars > CHARS:  # one long line
                h = np.array([_long_digest(code[s : s + k]) for s, k in zip(start.tolist(), n.tolist())], np.uint64)
            else:
                up, down = _power_tables(CHARS)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[: len(code)], dtype=np.uint64)])
                base = np.cumsum([0, *map(len, part[:-1])])[own] + start
                h = (sums[base + n] - sums[base]) * down[base]
            salt = (size * 4 + segment).astype(np.uint64) * np.uint64(_BASE)
            if seeds is not None:
                salt ^= seeds[at:end][own]
            parts.append((_mixed(h ^ _mixed(salt)), own + at, start, n))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _agree(a: str, b: str) -> int:
    """How many characters a and b have in common from the start, found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _cores(a: str, b: str) -> tuple[str, str]:
    """a and b without what they have in common at both ends, which leaves their distance as it is."""
    n = _agree(a, b)
    a, b = a[n:], b[n:]
    m = _agree(a[::-1], b[::-1])
    return (a[:-m], b[:-m]) if m else (a, b)


def near(a: list[str], b: list[str]) -> np.ndarray:
    """Whether a[i] and b[i] are EDITS or fewer edits apart."""
    both = [_cores(x, y) if len(x) > LONG and abs(len(x) - len(y)) <= EDITS else (x, y) for x, y in zip(a, b)]
    a, b = [x for x, _ in both], [y for _, y in both]
    out = np.zeros(len(a), bool)
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * size[order[end]] <= CHARS:
            end += 1
        part = order[at:end]
        out[part] = _near([a[i] for i in part], [b[i] for i in part])
        at = end
    return out


def _grid(lines: list[str], before: int, width: int) -> np.ndarray:
    """Code points, a line a column, with `before` rows of filling above."""
    out = np.zeros((before + width, len(lines)), np.uint32)
    for i, x in enumerate(lines):
        out[before : before + len(x), i] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _near(a: list[str], b: list[str]) -> np.ndarray:
    """Bit d of reach[k] says that the first i characters of a and the first i + d - EDITS of b are k edits apart, or fewer."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    band = 2 * EDITS + 1
    out = np.zeros(len(a), bool)
    live = np.flatnonzero(abs(n - m) <= EDITS)
    left = _grid(a, 0, int(n.max(initial=0)))
    right = _grid(b, EDITS, int(m.max(initial=0)) + 2 * EDITS)
    full = np.uint16((1 << band) - 1)
    reach = [np.full(len(live), ((1 << (k + 1)) - 1) << EDITS, np.uint16) & full for k in range(EDITS + 1)]
    for i in range(int(n.max(initial=0)) + 1):
        done = n[live] == i
        if done.any():
            goal = (m[live] - i + EDITS).astype(np.uint16)
            out[live[done]] = (reach[EDITS] >> goal & 1 == 1)[done]
        stop = done | (reach[EDITS] == 0)
        if stop.any():
            live, reach = live[~stop], [r[~stop] for r in reach]
        if not len(live):
            break
        own = left[i, live]
        same = np.zeros(len(live), np.uint16)
        for d in range(band):
            same |= (right[i + d, live] == own).astype(np.uint16) << np.uint16(d)
        new = [reach[0] & same]
        for k in range(1, EDITS + 1):
            less = reach[k - 1]
            new.append(((reach[k] & same) | less | (less >> np.uint16(1)) | (new[k - 1] << np.uint16(1))) & full)
        reach = new
    return out


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, str]]]]:
    """Slices of batches with their comparable lines: (row, place, line)."""
    for part in chain.from_iterable(map(slices, batches)):
        yield part, [(r, i, x) for r, t in enumerate(part.column("text").to_pylist()) for i, line in enumerate(split(t)) if (x := plain(line))]


def _digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(encode(line))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _line_rows(batches):
        where = pa.array([r for r, _, _ in rows], pa.int32())
        d = pa.array([_digest(x) for _, _, x in rows], pa.binary())
        cols = [d, part.column("doc_id").take(where), part.column("k").take(where), pa.array([i for _, i, _ in rows], pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, ["d", "doc_id", "k", "place"])


def _edit_lines(rows: list[tuple[int, int, str]]) -> list[str]:
    return list({x for _, _, x in rows if len(x) >= MIN_CHARS})


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _line_rows(batches):
        lines = _edit_lines(rows)
        key, own, _, _ = keys(lines, MIN_CHARS)
        hashes = np.array([xxhash.xxh3_64_intdigest(encode(x)) for x in lines], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(hashes[own].view(np.int64))], ["key", "line"])


def _spots(key: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """A list of (key, start, size) for each of n lines; of is ascending."""
    offsets = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
    fields = [pa.array(key.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["key", "start", "size"]))


def _candidates(held) -> callable:
    """Lines (d, line) with the keys that may be shared; lines without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _line_rows(batches):
            lines = _edit_lines(rows)
            key, of, start, size = keys(lines, MIN_CHARS)
            hit = may_hold(held.value, key)
            found, of = np.unique(of[hit], return_inverse=True)
            lines = [lines[i] for i in found.tolist()]
            spots = _spots(key[hit], start[hit], size[hit], of, len(lines))
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, lines), pa.binary()), pa.array(lines, pa.string()), spots], ["d", "line", "spots"])

    return run


def _spots_of(held) -> callable:
    """The spots of lines whose keys the filter may hold, a row each (key, start, size, d, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(slices(x, 1 << 12, column="line") for x in batches):
            spots = b.column("spots")
            fields = dict(zip(("key", "start", "size"), spots.flatten().flatten()))
            hit = may_hold(held.value, fields["key"].to_numpy(zero_copy_only=False))
            of = pa.array(np.repeat(np.arange(len(b)), spots.value_lengths().to_numpy(zero_copy_only=False))[hit])
            cols = [x.filter(pa.array(hit)) for x in fields.values()] + [b.column("d").take(of), b.column("line").take(of)]
            yield pa.RecordBatch.from_arrays(cols, [*fields, "d", "line"])

    return run


def _spanning(a: list[int], b: list[int], n: int) -> list[tuple[int, int]]:
    """(member, smallest member) of the components of links a[i], b[i] among n."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a, b):
        x, y = sorted((find(x), find(y)))
        root[y] = x
    return [(i, find(i)) for i in range(n) if find(i) != i]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among the members (d, line) of each key, which are KEY_ROWS at most, or two blocks of as many."""
    for batch in batches:
        left, right = [], []
        groups, chars = [], 0

        def flush() -> None:
            nonlocal groups, chars
            pairs = [(g, i, j) for g, own in enumerate(groups) for i in range(len(own)) for j in range(i) if abs(len(own[i][1]) - len(own[j][1])) <= EDITS]
            ok = near([groups[g][i][1] for g, i, _ in pairs], [groups[g][j][1] for g, _, j in pairs])
            by: dict[int, tuple[list, list]] = {}
            for (g, i, j), yes in zip(pairs, ok.tolist()):
                if yes:
                    x = by.setdefault(g, ([], []))
                    x[0].append(i), x[1].append(j)
            for g, (a, b) in by.items():
                for i, j in _spanning(a, b, len(groups[g])):
                    left.append(groups[g][i][0]), right.append(groups[g][j][0])
            groups, chars = [], 0

        ends, values = batch.column("members").offsets.to_pylist(), batch.column("members").values
        for a, b in zip(ends, ends[1:]):
            member = values.slice(a, b - a)
            own = sorted(set(zip(member.field("d").to_pylist(), member.field("line").to_pylist())))
            groups.append(own)
            chars += sum(len(r) for _, r in own) * len(own)
            if chars > 4 * CHARS:
                flush()
        if groups:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a large key, without its segment, under the keys of what is left."""
    for batch in batches:
        for part in slices(batch, 1 << 12, column="rest"):
            key, start, size, rest = (part.column(c).to_pylist() for c in ("key", "start", "size", "rest"))
            left = [r[:s] + r[s + n :] for r, s, n in zip(rest, start, size)]
            found, of, start, size = keys(left, 0, part.column("key").to_numpy().view(np.uint64))
            of = pa.array(of)
            cols = [pa.array(found.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))]
            cols += [part.column("d").take(of), pa.array(left, pa.string()).take(of), part.column("line").take(of)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "start", "size", "d", "rest", "line"])


_LINE = "d binary, line string, spots array<struct<key:long,start:int,size:int>>"
_SPOT = "key long, start int, size int, d binary, line string"
_ROW = "key long, start int, size int, d binary, rest string, line string"


def _shared(rows: DataFrame, line: str) -> DataFrame:
    """Keys of two or more different lines, with the number of rows."""
    by = rows.groupBy("key").agg(F.min(line).alias("a"), F.max(line).alias("b"), F.count("*").alias("n"))
    return cut(by.filter("a < b").select("key", "n"))


def links(own: DataFrame) -> DataFrame:
    """Links (a, b) between digests of near lines of own (doc_id, text, k) that span all their components."""
    shared = _shared(own.mapInArrow(_keyed, "key long, line long"), "line")
    held = key_filter(shared, shared.count())
    let_go(own.sparkSession)
    lines = stored(own.mapInArrow(_candidates(held), _LINE).dropDuplicates(["d"]))
    let_go(own.sparkSession)
    each = lines.select("d", "line", F.explode("spots").alias("spot")).select("spot.*", "d", "line")
    few = each.join(shared.filter(F.col("n") <= KEY_ROWS).select("key"), "key")
    found = _verified(few.groupBy("key").agg(F.collect_list(F.struct("d", "line")).alias("members")))
    hot = shared.filter(F.col("n") > KEY_ROWS).select("key")
    if not (n_hot := hot.count()):
        return found
    some = lines.mapInArrow(_spots_of(key_filter(hot, n_hot)), _SPOT)  # few of all, so that only these are shuffled once more
    level = cut(some.join(hot, "key").select("key", "start", "size", "d", F.col("line").alias("rest"), "line").dropDuplicates(["key", "d"]))
    for depth in range(REFINE_LEVELS + 1):
        sized = level.join(_shared(level, "d"), "key")
        last = depth == REFINE_LEVELS
        found = found.unionByName(_in_blocks(sized if last else sized.filter(F.col("n") <= REFINE_ROWS)))
        if last or (large := sized.filter(F.col("n") > REFINE_ROWS)).isEmpty():
            break
        level = cut(large.select(*level.columns).mapInArrow(_finer, _ROW).dropDuplicates(["key", "d"]))
    return found


def _verified(sets: DataFrame) -> DataFrame:
    return sets.select("members").mapInArrow(_verify, "a binary, b binary")


def _in_blocks(sized: DataFrame) -> DataFrame:
    """Links within the keys of sized (key, n, d, line), in pairs of blocks of about KEY_ROWS lines."""
    n_blocks = F.ceil(F.col("n") / KEY_ROWS).cast("int")
    own = sized.withColumn("o", F.pmod(F.xxhash64("d"), n_blocks).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    return _verified(own.groupBy("key", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j")).agg(F.collect_list(F.struct("d", "line")).alias("members")))


def removals(docs: DataFrame) -> DataFrame:
    """(k, doc_id, gone) for docs (doc_id, text): the places of the lines that go from the rows with that doc_id and
    that hash k of both columns."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    lines = stored(own.mapInArrow(_occurrences, "d binary, doc_id long, k long, place int"))
    place = F.struct("doc_id", "k", "place")
    first = cut(lines.groupBy("d").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    roots = cut(connected_components(links(own)).withColumnRenamed("node", "d"))
    several = first.join(roots, "d", "left").filter("n > 1 or root is not null").withColumn("root", F.coalesce("root", "d"))
    best = several.groupBy("root").agg(F.min("first").alias("keep"))
    known = cut(several.join(best, "root").select("d", "keep"))
    gone = lines.join(known, "d").filter(place != F.col("keep"))
    let_go(docs.sparkSession)
    return gone.groupBy("k", "doc_id").agg(F.collect_set("place").alias("gone"))


def dedup_lines(docs: DataFrame, lines: str = "_n_lines", removed: str = "_n_removed") -> DataFrame:
    """docs with text without the lines that repeat an earlier one, equal or EDITS or fewer edits apart, directly or
    over others, and with the numbers of its lines and of those removed, named lines and removed. The other columns stay.

    Lines end at line feeds and are compared without white space at their ends. Lines of fewer than MIN_CHARS characters
    repeat only equal ones; blank lines always stay. Earlier is a smaller doc_id (null before all), then a smaller hash of
    the text, then an earlier place. Repeated rows are one row to each other: they stay equal. Null text stays null, with
    no lines; an empty text has one empty line. A document may lose all its lines; it stays, with an empty text. A
    text is held whole, line by line, in the task that has its row; lines of any length are compared. Columns of any
    name stay (those named lines and removed excepted, which are replaced)."""
    names = [c for c in docs.columns if c not in (lines, removed)]
    row, k, doc, gone = fresh(names, "_row", "_k", "_doc", "_gone")
    found = removals(docs).select(F.col("k").alias(k), F.col("doc_id").alias(doc), F.col("gone").alias(gone))
    keyed = docs.select(*names, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias(row))
    both = keyed.join(found, (F.col(row) == F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left").select(*names, gone)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            text, n_lines, n_removed = [], [], []
            for t, places in zip(b.column("text").to_pylist(), b.column(gone).to_pylist()):
                all_lines = split(t) if t is not None else []
                if places:
                    out = set(places)
                    t = "\n".join(x for i, x in enumerate(all_lines) if i not in out)
                text.append(t)
                n_lines.append(len(all_lines))
                n_removed.append(len(places or ()))
            own = [pa.array(text, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*names, lines, removed])

    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in both.schema.fields if f.name != gone]
    return both.mapInArrow(kept, T.StructType([*fields, T.StructField(lines, T.LongType()), T.StructField(removed, T.LongType())]))

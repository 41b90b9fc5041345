"""SentencePiece encoding by sampling, and lossless decoding (operator 8).

A text is cut into units, runs of spaces with the word after them, which no piece of the model crosses. The lattice of
a unit has an edge for every piece of the vocabulary; a character without a piece has one edge that stands for its
UTF-8 bytes. Forward filtering adds up, position by position and for all distinct units of a batch at once, the
probability of all segmentations that reach a position. Backward sampling then walks from each occurrence's end to its
start, drawing an incoming edge in proportion to what it contributed. The draws are hashes of the row's key, the unit's
place and the step, so a row's segmentation depends on nothing else: not on batches, partitions or retries.

A unit of more than LONG characters is filtered and sampled in stretches of STRETCH characters: the forward pass keeps
only the probabilities of the last positions before each stretch, and the backward pass makes the stretches again from
the last to the first. The lattice held at once is so bounded, however long a text or a word is.

The model's pieces carry ranks, not probabilities; a piece of rank r weighs 1 / (r + RANK_SHIFT), and POWER sharpens
(above 1) or flattens the distribution.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import slices

RANK_SHIFT = 2.7
POWER = 1.0
#: Characters of text, and of distinct units, that are handled at once.
CHARS, DISTINCT = 1 << 19, 1 << 16
#: Units of more characters go in stretches of so many.
LONG, STRETCH = 1 << 10, 1 << 12
_UNITS = re.compile(r" *[^ \n]+|\n| +")
#: Where a text may be parted without parting a unit: before a line feed, or before the first space of a run.
_BORDER = re.compile(r"\n|(?<=[^ ]) ")
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def draws(key: np.ndarray, place: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) for the step-th draw of the unit at place of the row with key."""
    with np.errstate(over="ignore"):
        x = key + (place.astype(np.uint64) * np.uint64(1 << 20) + np.asarray(step + 1, np.uint64)) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def row_keys(ids: list[int | None]) -> np.ndarray:
    """A key for each doc_id; null has one of its own."""
    with np.errstate(over="ignore"):
        known = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
        null = np.array([i is None for i in ids])
        return np.where(null, np.uint64(0x5851F42D4C957F2D), (known + np.uint64(1)) * np.uint64(_MIX[1]))


def n_bytes(code: np.ndarray) -> np.ndarray:
    """How many bytes the UTF-8 of code points has."""
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


class Model:
    """The vocabulary as a trie over characters, with ' ' for the space mark."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        self.bytes = [b""] * n
        first_byte, plain = None, []
        for i in range(n):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                first_byte = i if first_byte is None else first_byte
            elif not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes[i] = text.encode()
                plain.append((text, i))
        self.first_byte = first_byte
        symbols = sorted({c for t, _ in plain for c in t})
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        self.width = len(symbols) + 1
        nodes: dict[str, int] = {"": 0}
        edges: dict[int, int] = {}
        for t, _ in plain:
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(nodes)
                    edges[nodes[t[: k - 1]] * self.width + int(self.symbol[ord(t[k - 1])])] = nodes[t[:k]]
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.first = np.zeros(self.width, np.int64)  # the children of the root
        at_root = self.keys < self.width
        self.first[self.keys[at_root]] = self.child[at_root]
        self.piece = np.full(len(nodes), -1, np.int32)
        for t, i in plain:
            self.piece[nodes[t]] = i
        rank = np.arange(n) - min(i for _, i in plain)
        weight = np.where(rank >= 0, 1 / (np.maximum(rank, 0) + RANK_SHIFT), 0)
        self.log = POWER * np.log(np.maximum(weight / weight.sum(), 1e-30))
        self.byte_log = POWER * np.log(weight.min(initial=1, where=weight > 0) / weight.sum())
        self.longest = max(len(t) for t, _ in plain)

    def edges(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece, log weight) of all edges that leave the places of text (code points); left has how many
        characters an edge may have from each place on. A place without a one-letter piece gets the edge of its bytes,
        whose piece is -1 - place."""
        symbol = self.symbol[text]
        at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        src, length, piece = [], [], []
        single = left <= 0
        for d in range(1, self.longest + 1):
            fits = left[at] >= d
            at, node = at[fits], node[fits]
            if d == 1:
                node = self.first[symbol[at]]
                hit = node > 0
                at, node = at[hit], node[hit]
            else:
                key = node * self.width + symbol[at + d - 1]
                slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[slot] == key
                at, node = at[hit], self.child[slot[hit]]
            if not len(at):
                break
            whole = self.piece[node] >= 0
            src.append(at[whole])
            length.append(np.full(whole.sum(), d))
            piece.append(self.piece[node[whole]])
            if d == 1:
                single[at[whole]] = True
        rest = np.flatnonzero(~single)
        src, length = np.concatenate([*src, rest]), np.concatenate([*length, np.ones(len(rest), np.int64)])
        known = np.concatenate(piece) if piece else np.zeros(0, np.int32)
        log = np.concatenate([self.log[known], self.byte_log * n_bytes(text[rest])])
        return src, length, np.concatenate([known, -1 - rest]), log

    def ids(self, piece: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of edges, and how many each has (the bytes of a character without a piece, else one)."""
        raw = piece < 0
        many = np.ones(len(piece), np.int64)
        if not raw.any():
            return piece.astype(np.int32), many
        code = text[-1 - piece[raw]]
        many[raw] = n_bytes(code)
        out = np.repeat(piece, many).astype(np.int32)
        data = "".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass")
        out[np.repeat(raw, many)] = np.frombuffer(data, np.uint8).astype(np.int32) + self.first_byte
        return out, many

    def decode(self, ids: list[int]) -> str:
        """The text of encoded ids; the space that encoding puts first goes."""
        get = self.bytes.__getitem__
        return b"".join(map(get, ids))[1:].decode("utf-8", "surrogatepass")


class Lattice:
    """The forward-filtered lattice of distinct units. Node base[u] + p is position p of unit u."""

    def __init__(self, model: Model, units: list[str]):
        size = np.fromiter(map(len, units), np.int64, len(units))
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.model, self.text = model, text
        self.size, self.base = size, np.cumsum(size + 1) - (size + 1)
        unit = np.repeat(np.arange(len(units)), size)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        start_node = self.base[unit] + offset
        src, length, piece, log = model.edges(text, size[unit] - offset)
        end = offset[src] + length
        order = np.argsort(end << 40 | (start_node[src] + length) << 8 | length)  # no two edges are equal here
        self.src, self.piece, log, end = start_node[src][order], piece[order], log[order], end[order]
        self.dst = self.src + length[order]
        alpha = np.full(len(text) + len(units), -np.inf)
        alpha[self.base] = 0
        share = np.empty(len(log))
        first = np.flatnonzero(np.diff(self.dst, prepend=-1))  # first edge into each node
        step = np.flatnonzero(np.diff(end, prepend=-1))
        bounds = np.append(step, len(end))
        in_step = np.append(np.searchsorted(first, step), len(first))
        for k in range(len(step)):
            a, b = bounds[k], bounds[k + 1]
            heads = first[in_step[k] : in_step[k + 1]]
            reach = alpha[self.src[a:b]] + log[a:b]
            alpha[self.dst[heads]] = np.logaddexp.reduceat(reach, heads - a)
            share[a:b] = np.exp(reach - alpha[self.dst[a:b]])
        total = np.cumsum(share)
        rank = np.cumsum(np.diff(self.dst, prepend=-1) != 0) - 1
        head = total[first] - share[first]
        inside = np.minimum(total - head[rank], 1)
        last = np.append(first[1:], len(share)) - 1
        inside[last] = 1
        self.ladder = rank + inside
        self.rank_of = np.zeros(len(alpha), np.int64)
        self.rank_of[self.dst[first]] = np.arange(len(first))

    def sample(self, unit: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of every occurrence in text order, and how many each has."""
        node, home = (self.base + self.size)[unit], self.base[unit]
        live = np.arange(len(unit))
        count = np.zeros(len(unit), np.int64)
        steps = []
        while len(live):
            u = draws(key[live], place[live], len(steps))
            at = node[live]
            edge = np.searchsorted(self.ladder, self.rank_of[at] + u, side="right")
            steps.append((live, edge))
            count[live] += 1
            node[live] = self.src[edge]
            live = live[node[live] > home[live]]
        end = np.cumsum(count)
        out = np.empty(int(count.sum()), np.int64)
        for s, (who, edge) in enumerate(steps):
            out[end[who] - 1 - s] = edge
        return out, count

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of edges, and how many each has."""
        return self.model.ids(self.piece[edges], self.text)


class LongUnit:
    """One unit of any length, whose lattice is made STRETCH characters at a time."""

    def __init__(self, model: Model, unit: str):
        self.model, self.n = model, len(unit)
        self.text = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.before: list[list[float]] = []  # for each stretch: log alpha of the last positions up to its start
        alpha = [0.0]
        for a in range(0, self.n, STRETCH):
            self.before.append(alpha)
            alpha = self._stretch(a, alpha)[0]

    def _stretch(self, a: int, before: list[float]) -> tuple[list[float], list[int], list[float], np.ndarray, np.ndarray, np.ndarray, int]:
        """The edges that end in (a, a + STRETCH], by end: log alpha of the last positions; where each position's edges
        begin; their cumulated shares; their pieces and lengths; the code points pieces refer to."""
        keep = self.model.longest
        low, high = max(0, a - keep), min(self.n, a + STRETCH)
        text = self.text[low:high]
        src, length, piece, log = self.model.edges(text, np.arange(len(text), 0, -1))
        end = src + length
        inside = end > a - low
        src, length, piece, log, end = src[inside], length[inside], piece[inside], log[inside], end[inside]
        order = np.lexsort((length, end))
        src, length, piece, log, end = src[order], length[order], piece[order], log[order], end[order]
        first = np.searchsorted(end, np.arange(a - low + 1, high - low + 2)).tolist()
        alpha = [-np.inf] * (a - low + 1 - len(before)) + before
        share: list[float] = []
        exp, from_, weight = math.exp, src.tolist(), log.tolist()
        for p in range(len(first) - 1):
            reach = [alpha[from_[e]] + weight[e] for e in range(first[p], first[p + 1])]
            top = max(reach)
            part = [exp(x - top) for x in reach]
            total = sum(part)
            alpha.append(top + math.log(total))
            run = 0.0
            for x in part:
                run += x
                share.append(run / total)
        return alpha[-keep:], first, share, piece, length, text, low

    def sample(self, key: np.ndarray, place: int) -> np.ndarray:
        """The ids of one occurrence; key has one number."""
        node, step, out = self.n, 0, []
        spot = np.array([place])
        for k in range(len(self.before) - 1, -1, -1):
            a = k * STRETCH
            _, first, share, piece, length, text, _ = self._stretch(a, self.before[k])
            size, chosen, u = length.tolist(), [], []
            while node > a:
                if not u:
                    u = draws(key, spot, step + np.arange(1024))[::-1].tolist()
                low, high = first[node - a - 1], first[node - a]
                e = min(bisect.bisect_right(share, u.pop(), low, high), high - 1)
                chosen.append(e)
                node -= size[e]
                step += 1
            out.append(self.model.ids(piece[np.array(chosen[::-1], np.int64)], text)[0])
        return np.concatenate(out[::-1])


_models: dict[str, Model] = {}


def model_at(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _unit_lists(text: str) -> Iterator[list[str]]:
    """The units of a text, in lists of about CHARS characters."""
    text, at = " " + text, 0
    while len(text) - at > CHARS:
        found = _BORDER.search(text, at + CHARS)
        if not found:
            break
        yield _UNITS.findall(text, at, found.start())
        at = found.start()
    yield _UNITS.findall(text, at)


def encode_rows(model: Model, ids: list[int | None], texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The ids of each row, in order. Units of several rows, and of parts of long rows, are handled together."""
    keys = row_keys(ids)
    known: dict[str, int] = {}
    rows: list[list[np.ndarray]] = []  # what each row has so far, from row `done` on
    codes, owner, places, chars, fresh, done = [], [], [], 0, 0, 0

    def flush() -> None:
        nonlocal known, codes, owner, places, chars, fresh
        if codes:
            unit, of, place = np.concatenate(codes), np.concatenate(owner), np.concatenate(places)
            lattice = Lattice(model, list(known))
            edges, per_unit = lattice.sample(unit, keys[of], place)
            out, per_edge = lattice.ids(edges)
            sizes = np.bincount(np.repeat(np.repeat(of - done, per_unit), per_edge), minlength=len(rows))
            for got, part in zip(rows, np.split(out, np.cumsum(sizes)[:-1])):
                if len(part):
                    got.append(part)
        known, codes, owner, places, chars, fresh = {}, [], [], [], 0, 0

    for row, text in enumerate(texts):
        rows.append([])
        place = 0
        for units in _unit_lists(text) if text else ():
            while units:  # up to the next long unit
                cut = next((i for i, u in enumerate(units) if len(u) > LONG), len(units)) if max(map(len, units)) > LONG else len(units)
                if cut:
                    was = len(known)
                    codes.append(np.array([known.setdefault(u, len(known)) for u in units[:cut]], np.int64))
                    owner.append(np.full(cut, row))
                    places.append(np.arange(place, place + cut))
                    fresh += sum(map(len, islice(known, was, None)))
                    chars += sum(map(len, units[:cut]))
                if cut < len(units):
                    flush()
                    rows[-1].append(LongUnit(model, units[cut]).sample(keys[row : row + 1], place + cut))
                place += min(cut + 1, len(units))
                units = units[cut + 1 :]
                if chars > CHARS or fresh > DISTINCT:
                    flush()
        if not codes:  # everything up to here is done
            for got in rows:
                yield np.concatenate(got) if got else np.zeros(0, np.int32)
            rows, done = [], row + 1
    flush()
    for got in rows:
        yield np.concatenate(got) if got else np.zeros(0, np.int32)


def _id_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with _ids, the sampled piece ids of text; the other columns stay.

    Null and empty texts have no ids. The draws are seeded by doc_id: repeated rows are segmented alike, equal texts of
    different documents need not be; rows with a null doc_id share one seed. Marks that the model uses itself (U+2581)
    and characters that it lacks go in as bytes, so decoding gives back every text exactly."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for b in chain.from_iterable(map(slices, batches)):
            lists = _id_lists(list(encode_rows(model, b.column("doc_id").to_pylist(), (t.as_py() for t in b.column("text")))))
            own = [(f.name, c) for f, c in zip(b.schema, b.columns) if f.name != "_ids"]
            yield pa.RecordBatch.from_arrays([c for _, c in own] + [lists], [x for x, _ in own] + ["_ids"])

    fields = [f for f in docs.schema.fields if f.name != "_ids"]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("_ids", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (with _ids) with _decoded, the text, and _ids_crc32, the checksum of the ids as little-endian unsigned
    32-bit integers. A row whose _ids are null or empty is decoded as empty text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for b in batches:
            text, crc = [], []
            for x in b.column("_ids"):
                ids = x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)
                text.append(model.decode(ids.tolist()))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            own = [(f.name, c) for f, c in zip(b.schema, b.columns) if f.name not in ("_decoded", "_ids_crc32")]
            yield pa.RecordBatch.from_arrays([c for _, c in own] + [pa.array(text, pa.string()), pa.array(crc, pa.int64())], [x for x, _ in own] + ["_decoded", "_ids_crc32"])

    fields = [f for f in rows.schema.fields if f.name not in ("_decoded", "_ids_crc32")]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("_decoded", T.StringType()), T.StructField("_ids_crc32", T.LongType())]))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_pieces, ids_crc32, decoded_sha256, lossless) of every row: encoded, then decoded from the ids
    alone, in one pass. Null and empty texts have no ids and decode to the empty text; a text of any length is handled
    with bounded lattices, and only its own ids grow with it. Repeated rows give equal rows; no rows give none."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for b in chain.from_iterable(map(slices, batches)):
            got = list(encode_rows(model, b.column("doc_id").to_pylist(), (t.as_py() for t in b.column("text"))))
            crc, digest, same = [], [], []
            for ids, text in zip(got, b.column("text")):
                crc.append(zlib.crc32(ids.astype("<u4")))
                back = model.decode(ids.tolist())
                digest.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == (text.as_py() or ""))
            n = [len(x) for x in got]
            cols = [b.column("doc_id"), _id_lists(got), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(digest, pa.string()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")

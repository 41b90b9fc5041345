"""Token ids in wavelet-matrix shards (operator 7).

Documents are dealt by ranges of (doc_id, a hash of the text) and sorted within them, so shards in the order of their
names hold ascending doc_ids. A task tokenizes its range and closes a shard at about SHARD_TOKENS ids; a document never
spans two. A shard is one file in the shared folder, written under another name and then renamed, with the same bytes
in every attempt, so a repeated or speculative task does no harm.

A shard's ids are replaced by their places in its own alphabet, and the places are kept as bit planes of a wavelet
matrix: plane k holds the k-th highest bit of all ids, stably parted by the bits above. Counts of ones before every 512th
bit give rank, and with it access to any token, the number of occurrences in any range, and the place of the j-th
occurrence, from the planes alone. Sections are compressed with zstd.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import cut, shared_dir, slices

END_ID = 2
SHARD_TOKENS = 1 << 20
#: Shards that a task reads, one after the other, and most tasks that read shards.
READ_SHARDS, READ_TASKS = 4, 10_000
#: Words, and pieces of words, whose ids a worker remembers: some 200 bytes each.
CACHE_WORDS, CACHE_PIECES = 1 << 18, 1 << 18
#: Below this character lower case goes letter by letter and nothing composes.
_SIMPLE = "\u0250"
#: Marks that often end a word.
_MARKS = frozenset(".,;:!?")
#: Bytes of texts, or characters of a longer one, whose words are handled at once.
PART_BYTES = 1 << 23
_MAGIC, _BLOCK = b"WMT1", 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokens:
    """Ids of whole texts. The tokenizer drops white space and no token spans it, so a text is cut at spaces and line
    feeds and each distinct word is encoded once. Words of Latin letters are cut further into the pieces that the
    tokenizer encodes one by one, and unknown pieces are encoded as one text, whose ids are dealt back at the tokens that
    carry the word-end mark. All other words are encoded alone. Up to CACHE_WORDS words and pieces stay known."""

    #: Fixed value: the tokenizer's pattern for the pieces of a word.
    _PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.own.model)  # for pieces, which are lower-case and composed already
        self.plain.pre_tokenizer = self.own.pre_tokenizer
        self.known = {"": b""}
        self.piece: dict[str, bytes] = {}
        vocabulary = self.own.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _pieces(self, new: list[str]) -> None:
        """Learn the ids of pieces, encoded as one text."""
        for i in range(0, len(new), 1024):
            part = new[i : i + 1024]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                cuts, data = [0, *(4 * ends).tolist()], ids.tobytes()
                self.piece.update((w, data[x:y]) for w, x, y in zip(part, cuts, cuts[1:]))
            else:
                self.piece.update((w, self._alone(w)) for w in part)

    def _alone(self, word: str) -> bytes:
        return np.array(self.own.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of words. A word of letters is one piece, and one mark behind it another."""
        letters, marked, other, odd = [], [], [], []
        for w in words:
            if not w.isascii() and (max(w) >= _SIMPLE or "\u0130" in w) or "<|" in w:
                odd.append(w)
            elif w.isalpha():
                letters.append(w)
            elif w[-1] in _MARKS and w[:-1].isalpha():
                marked.append(w)
            else:
                other.append(w)
        low, heads = list(map(str.lower, letters)), [w[:-1].lower() for w in marked]
        cut = [self._PIECES.findall(w.lower()) for w in other]
        if len(self.piece) > CACHE_PIECES:
            self.piece = {}
        self._pieces(list(set(chain(low, heads, chain.from_iterable(cut), _MARKS)).difference(self.piece)))
        get = self.piece.__getitem__
        found = dict(zip(letters, map(get, low)))
        found.update((w, get(h) + get(w[-1])) for w, h in zip(marked, heads))
        found.update((w, b"".join(map(get, ps))) for w, ps in zip(other, cut))
        found.update((w, self._alone(w)) for w in odd)
        return found

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, with END_ID. Texts of over PART_BYTES in all go one by one, each in parts cut at spaces."""
        end = np.array([END_ID], "<u4").tobytes()
        if (pc.sum(pc.binary_length(texts)).as_py() or 0) <= PART_BYTES:
            data, cuts = self._ids(texts)
            yield from (np.frombuffer(data[x:y].to_pybytes() + end, "<u4") for x, y in zip(cuts, cuts[1:]))
            return
        for text in texts:
            parts = (self._ids(pa.array([p])) for p in _parts((text.as_py() or "").replace("\n", " ")))
            yield np.frombuffer(b"".join([*(data[: cuts[-1]].to_pybytes() for data, cuts in parts), end]), "<u4")

    def _ids(self, texts: pa.Array) -> tuple[pa.Buffer, list[int]]:
        """The ids of texts in a row, and the bytes at which each text begins and the last one ends. Arrow cuts the texts
        and numbers their words, so that Python sees each distinct one once. Up to CACHE_WORDS words stay known."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.string()), "\n", " "), " ")
        code = lists.flatten().dictionary_encode()
        words = code.dictionary.to_numpy(zero_copy_only=False).tolist()
        each = list(map(self.known.get, words))
        at = [i for i, x in enumerate(each) if x is None]
        new = self._encoded(words[i] for i in at)
        for i in at:
            each[i] = new[words[i]]
        if len(self.known) < CACHE_WORDS:
            self.known.update(new)
        got = pa.array(each, pa.binary()).take(code.indices)
        del code, words, each
        pa.default_memory_pool().release_unused()
        ends = np.frombuffer(got.buffers()[1], np.int32, len(got) + 1)
        firsts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists))])
        return got.buffers()[2], ends[firsts].tolist()


def _parts(text: str) -> Iterator[str]:
    """text in parts of about PART_BYTES characters, cut at spaces, which are left out."""
    at = 0
    while len(text) - at > PART_BYTES and (end := text.find(" ", at + PART_BYTES)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


_known: dict[str, Tokens] = {}


def tokens_at(path: str) -> Tokens:
    """The tokenizer of a worker process, with the words it has met in earlier tasks."""
    if path not in _known:
        _known[path] = Tokens(path)
    return _known[path]


class WaveletMatrix:
    """alphabet (sorted ids), planes (packed bits, highest first), zeros (in each plane), n."""

    def __init__(self, alphabet: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int], n: int):
        self.alphabet, self.planes, self.ranks, self.zeros, self.n = alphabet, planes, ranks, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
        place = np.zeros(int(alphabet.max(initial=0)) + 1, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        place[alphabet] = np.arange(len(alphabet))
        code = place[ids]
        depth = max(1, int(max(0, len(alphabet) - 1)).bit_length())
        planes, ranks, zeros = [], [], []
        for b in range(depth - 1, -1, -1):
            bit = (code & code.dtype.type(1 << b)) != 0
            planes.append(np.packbits(bit))
            ranks.append(cls.directory(planes[-1]))
            one = np.flatnonzero(bit)
            zeros.append(len(bit) - len(one))
            code = np.concatenate([code[np.flatnonzero(~bit)], code[one]])
        return cls(alphabet.astype(np.uint32), planes, ranks, zeros, len(ids))

    @staticmethod
    def directory(plane: np.ndarray) -> np.ndarray:
        """The ones before every _BLOCK-th bit of packed bits."""
        each = np.bitwise_count(plane)
        ones = np.add.reduceat(each, np.arange(0, len(each), _BLOCK // 8), dtype=np.uint32) if len(each) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // _BLOCK
        part = self.planes[level][block * _BLOCK // 8 : -(-i // 8)]
        return int(self.ranks[level][block]) + int(np.unpackbits(part)[: i - block * _BLOCK].sum())

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        """The i-th id."""
        code = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self.bit(level, i), self.rank(level, i)
            code = code << 1 | bit
            i = zeros + ones if bit else i - ones
        return int(self.alphabet[code])

    def _path(self, symbol: int) -> list[int] | None:
        at = int(np.searchsorted(self.alphabet, symbol))
        if at == len(self.alphabet) or self.alphabet[at] != symbol:
            return None
        return [at >> (len(self.zeros) - 1 - k) & 1 for k in range(len(self.zeros))]

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        end, path = self.n if end is None else end, self._path(symbol)
        for level, bit in enumerate(path or []):
            a, b = self.rank(level, start), self.rank(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if bit else (start - a, end - b)
        return end - start if path else 0

    def select(self, symbol: int, j: int) -> int:
        """The place of the j-th occurrence of an id, from 0; -1 if there are fewer."""
        path = self._path(symbol)
        if path is None or not 0 <= j < self.count(symbol):
            return -1
        start = 0
        for level, bit in enumerate(path):
            ones = self.rank(level, start)
            start = self.zeros[level] + ones if bit else start - ones
        place = start + j
        for level in range(len(path) - 1, -1, -1):
            want = place - self.zeros[level] if path[level] else place
            low, high = 0, self.n  # the smallest i with want + 1 such bits among the first i + 1
            while low < high:
                mid = (low + high) // 2
                ones = self.rank(level, mid + 1)
                if (ones if path[level] else mid + 1 - ones) >= want + 1:
                    high = mid
                else:
                    low = mid + 1
            place = low
        return place

    def all(self) -> np.ndarray:
        """All ids in order: the planes, undone from the last one up."""
        code = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up = np.empty_like(code)
            up[np.flatnonzero(~bit)] = code[: self.zeros[k]]
            up[np.flatnonzero(bit)] = code[self.zeros[k] :] | code.dtype.type(1 << (len(self.zeros) - 1 - k))
            code = up
        return self.alphabet[code]


def pack(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int]) -> bytes:
    """The bytes of a shard's file."""
    m = WaveletMatrix.build(ids)
    null = np.array([d is None for d in doc_ids])
    parts = [m.alphabet, *m.planes, *m.ranks, np.array([d or 0 for d in doc_ids], "<i8"), np.packbits(null), np.array(sizes, "<i8")]
    squeeze = zstandard.ZstdCompressor(level=1)
    body = [squeeze.compress(p.tobytes()) for p in parts]
    head = json.dumps({"n": m.n, "zeros": m.zeros, "docs": len(doc_ids), "sections": [len(x) for x in body]}).encode()
    return b"".join([_MAGIC, struct.pack("<I", len(head)), head, *body])


def unpack(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the doc_ids and the number of ids of each document of a shard's file."""
    if data[:4] != _MAGIC:
        raise ValueError("not a token shard")
    (size,) = struct.unpack("<I", data[4:8])
    head, at, parts = json.loads(data[8 : 8 + size]), 8 + size, []
    open_ = zstandard.ZstdDecompressor()
    for n in head["sections"]:
        parts.append(open_.decompress(data[at : at + n]))
        at += n
    depth = len(head["zeros"])
    planes = [np.frombuffer(x, np.uint8) for x in parts[1 : 1 + depth]]
    ranks = [np.frombuffer(x, np.uint32) for x in parts[1 + depth : 1 + 2 * depth]]
    ids, null, sizes = parts[1 + 2 * depth :]
    gone = np.unpackbits(np.frombuffer(null, np.uint8), count=head["docs"])
    docs = [None if g else d for d, g in zip(np.frombuffer(ids, "<i8").tolist(), gone.tolist())]
    return WaveletMatrix(np.frombuffer(parts[0], np.uint32), planes, ranks, head["zeros"], head["n"]), docs, np.frombuffer(sizes, "<i8")


def write(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text) as shards into folder, a URI that all executors share, and returns the table of shards
    (file, part, k, n_docs, n_tokens); (part, k) is their order. Null texts count as empty: the end id alone. Null
    doc_ids come first; rows that share a doc_id are written one after the other. No rows, no shards. A text of any length
    is one document of one shard, which it may make larger than SHARD_TOKENS; its words are handled part by part."""
    path = tokenizer or default_tokenizer()
    key = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", key)
    laid = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        tokens = tokens_at(path)
        ids, doc_ids, sizes, done, part = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal ids, doc_ids, sizes, done
            name = f"shard-{part:06d}-{done:06d}.wm"
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(pack(np.concatenate(ids), doc_ids, sizes))
            store.move(draft, f"{root}/{name}")
            row = {"file": [name], "part": [part], "k": [done], "n_docs": [len(sizes)], "n_tokens": [sum(sizes)]}
            ids, doc_ids, sizes, done = [], [], [], done + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("k", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        total = 0
        for b in batches:
            for some in slices(b, b.num_rows, PART_BYTES):
                part = some.column("part")[0].as_py()
                for doc, got in zip(some.column("doc_id").to_pylist(), tokens.encode(some.column("text"))):
                    ids.append(got)
                    doc_ids.append(doc)
                    sizes.append(len(got))
                    total += len(got)
                    if total >= SHARD_TOKENS:
                        yield close()
                        total = 0
        if ids:
            yield close()

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return cut(laid.mapInArrow(written, "file string, part int, k int, n_docs long, n_tokens long"))


def read(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. start is the number of ids of all
    documents before it: totals of the parts are added up first, then those of the shards within a part."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))  # a row for each task that wrote
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("k")) - F.col("n_tokens")
    placed = shards.withColumn("own", own).join(before, "part").select("file", (F.col("base") + F.col("own")).alias("start"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as f:
                    matrix, docs, sizes = unpack(f.read())
                data = memoryview(matrix.all().astype("<u4")).cast("B")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                cols = [pa.array(docs, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(-(-shards.count() // READ_SHARDS), READ_TASKS))  # rows are few and small, but each stands for a file
    return placed.repartition(tasks, "file").mapInArrow(opened, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

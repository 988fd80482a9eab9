"""Token ids in fixed-width bit-packed files, with random access.

File (little-endian): magic ``BLTOK1``, two bytes of version and bits per id,
four bytes of ids a block, three counts of eight bytes (ids, blocks,
documents), then the offsets of the blocks (8 bytes each, from the start of the
payload), the documents (id and first id within the file, 8 bytes each) and the
payload. Every block starts at a byte and holds its ids one after another,
lowest bit first; so a block, or any range of ids, unpacks by numpy alone
without reading what is before it. ``manifest.json`` lists the files in order
with the ids of all files before.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import SharedFiles, new_folder, tune

MAGIC, VERSION, BLOCK_IDS = b"BLTOK1", 1, 4096
HEAD = struct.Struct("<6sBBI3Q")


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, the last byte filled up with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int, start: int = 0) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of what ``pack`` gave."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n, offset=start * bits // 8).astype(np.uint32)
    raw = np.frombuffer(data, dtype=np.uint8)
    raw = np.r_[raw, np.zeros(8, np.uint8)]
    at = (start + np.arange(n, dtype=np.int64)) * bits
    words = np.lib.stride_tricks.as_strided(raw.view(), (len(raw) - 7,), (1,))
    base = at >> 3
    value = np.zeros(n, dtype=np.uint64)
    for k in range((bits + 14) // 8):
        value |= words[base + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenFile:
    """Reads one file; ``data`` may be a memory map. ``before``: ids of all files before."""

    def __init__(self, data: bytes | memoryview, before: int = 0):
        self.data = memoryview(data)
        magic, version, self.bits, self.block, self.n, blocks, docs = HEAD.unpack_from(self.data)
        self.before = before
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token file")
        at = HEAD.size
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at)
        at += 8 * blocks
        index = np.frombuffer(self.data, "<i8", 2 * docs, at).reshape(-1, 2)
        self.doc_ids, self.starts = index[:, 0], index[:, 1]
        self.payload = self.data[at + 16 * docs :]

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file, from the blocks that hold them alone."""
        out = [np.empty(0, np.uint32)]
        while n > 0:
            k, i = divmod(start, self.block)
            m = min(n, self.block - i)
            end = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else len(self.payload)
            out.append(unpack(self.payload[int(self.offsets[k]) : end], m, self.bits, i))
            start, n = start + m, n - m
        return np.concatenate(out)

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start over all files, ids) of each document in order."""
        ends = [*self.starts[1:].tolist(), self.n]
        for d, s, e in zip(self.doc_ids.tolist(), self.starts.tolist(), ends, strict=True):
            yield d, self.before + s, self.read(s, e - s)


class FileWriter:
    """Takes documents in order and gives the parts of one file; holds packed blocks only."""

    def __init__(self, bits: int, block: int = BLOCK_IDS):
        self.bits, self.block = bits, block
        self.blocks: list[bytes] = []
        self.rest = np.empty(0, np.uint32)
        self.docs: list[tuple[int, int]] = []
        self.n = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n))
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // self.block * self.block
        for i in range(0, full, self.block):
            self.blocks.append(pack(self.rest[i : i + self.block], self.bits))
        self.rest = self.rest[full:]

    def parts(self) -> list[bytes]:
        blocks = [*self.blocks, *([pack(self.rest, self.bits)] if len(self.rest) else [])]
        offsets = np.cumsum([0, *[len(b) for b in blocks]])[: len(blocks)].astype("<u8")
        head = HEAD.pack(MAGIC, VERSION, self.bits, self.block, self.n, len(blocks), len(self.docs))
        return [head, offsets.tobytes(), np.array(self.docs, dtype="<i8").reshape(-1, 2).tobytes(), *blocks]


class ChunkEncoder:
    """The tokenizers library over chunks between spaces and line ends, each distinct chunk once.

    Exact where the tokenizer lower-cases, drops white space, and no piece spans
    white space or the end of a run of letters: then the ids of a text are those
    of its chunks in order, of a chunk those of its A-Z lower-cased form, and of
    a chunk that ends in a letter and ASCII marks those of both parts in order.
    Texts that hold the string of an added token, and all texts under a file of
    other rules than ``RULES`` (``chunked`` is false), go to the library whole.
    Ids are kept as bytes, 4 each, which join fast and are no concern of the
    collector's. Two generations of them are kept: what is in use moves on.
    """

    CHUNKS = 300_000
    MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
    _LOWER = {i: i + 32 for i in range(65, 91)}
    #: The steps of a tokenizers file that chunks rely on.
    RULES = (
        [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocabulary = self.tok.get_vocab_size()
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        rules = json.loads(self.tok.to_str())
        found = [(rules[k] or {}).get(v, [None]) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.chunked = (found[0], found[1][0]) == self.RULES
        added = [re.escape(t["content"]) for t in rules["added_tokens"]]
        self.added = re.compile("|".join(added), re.IGNORECASE).search if added else lambda text: None

    def _encode_words(self, words: list[str]) -> None:
        """Runs of letters, many in one call, told apart by the pieces' numbers; where those don't tally, they are left to the caller."""
        lines = [words[i : i + 64] for i in range(0, len(words), 64)]
        for line, e in zip(lines, self.tok.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            number = np.array(e.word_ids)
            if len(number) and number[-1] == len(line) - 1:
                cuts = (4 * np.r_[np.searchsorted(number, np.arange(len(line))), len(number)]).tolist()
                data = array("I", e.ids).tobytes()
                self.cache.update(zip(line, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def _parts(self, chunk: str) -> tuple[str, str]:
        if chunk.isalpha() and chunk.islower():
            return chunk, ""
        low = chunk.lower() if chunk.isascii() else chunk.translate(self._LOWER)
        base = low.rstrip(self.MARKS)
        return (base, low[len(base) :]) if base[-1:].isalpha() else (low, "")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = {i for i, t in enumerate(texts) if not self.chunked or self.added(t)}
        chunks = [[] if i in whole else t.replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        gc.disable()  # nothing here is cyclic, and the collector would walk all chunks again and again
        try:
            self._learn(chunks)
        finally:
            gc.enable()
        for i, x in enumerate(chunks):
            if i in whole:
                yield np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield np.frombuffer(b"".join(map(self.cache.__getitem__, x)), dtype=np.uint32)

    def _learn(self, chunks: list[list[str]]) -> None:
        """Puts all chunks into the cache."""
        if len(self.cache) > self.CHUNKS:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        new = set().union(*chunks).difference(cache)
        parts: dict[str, tuple[str, str]] = {}
        for c in new:
            if c in old:
                cache[c] = old[c]
            else:
                parts[c] = self._parts(c)
        bases = []
        for b in {x for p in parts.values() for x in p}.difference(cache):
            if b in old:
                cache[b] = old[b]
            else:
                bases.append(b)
        words = [b for b in bases if b.isalpha()]
        for i in range(0, len(words), 64 * 64):
            self._encode_words(words[i : i + 64 * 64])
        others = [b for b in bases if b not in cache]
        for i in range(0, len(others), 4096):
            some = others[i : i + 4096]
            cache.update(zip(some, [array("I", e.ids).tobytes() for e in self.tok.encode_batch(some, add_special_tokens=False)], strict=True))
        for c, (b, e) in parts.items():
            cache[c] = cache[b] + cache[e]


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, make: Callable[[], Callable[[list[str]], Iterator[np.ndarray]]], vocabulary: int, end_id: int | None, folder: str | None = None, key: str = "doc_id", text: str = "text", file_rows: int = 20_000, file_ids: int = 1 << 26) -> tuple[str, int]:
    """Writes the ids of all ``docs`` in ascending doc_id order; returns the folder and the number of files.

    ``make`` gives, in a worker, a function from texts to their ids; ``end_id``
    is appended to every document. Partitions cover consecutive ranges of
    (doc_id, hash of the text), of about ``file_rows`` rows each, whose bounds
    come from a range partitioning of those two numbers alone: texts are
    encoded once, and only packed ids are shuffled. A partition is a file, or
    several where it has more than ``file_ids`` ids, which bounds what a task
    holds. Null ids come first, as the smallest 64-bit integer; rows of one id
    stand in the order of a hash of their text. A null text counts as empty.
    """
    spark = tune(docs.sparkSession)
    folder, bits = folder or new_folder(spark, "tokens"), bits_for(vocabulary)
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"))
    rows = source.count()
    files = max(1, -(-rows // file_rows))
    cuts: list[tuple[int, int]] = []  # the greatest (doc_id, tie) of each partition but the last: two numbers for each file
    if files > 1:
        ends = source.select("doc_id", "tie").repartitionByRange(files, "doc_id", "tie").groupBy(F.spark_partition_id()).agg(F.max(F.struct("doc_id", "tie")).alias("end"))
        cuts = sorted((r.end.doc_id, r.end.tie) for r in ends.collect())[:-1]
    bounds = spark.sparkContext.broadcast(cuts)

    def tokens(b: pa.RecordBatch) -> pa.RecordBatch:
        tail = [] if end_id is None else [end_id]
        got = [np.append(x, tail).astype(np.uint32) for x in make()([t or "" for t in b.column(1).to_pylist()])]
        part = [bisect_left(bounds.value, x) for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(part, pa.int32()), pa.array([pack(x, bits) for x in got], pa.binary()), pa.array([len(x) for x in got], pa.int64())], names=["doc_id", "tie", "part", "ids", "n"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield tokens(b)

    packed = source.mapInArrow(encoded, "doc_id long, tie long, part int, ids binary, n long")
    dealt = packed.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("doc_id", "tie")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, w, part, nth = SharedFiles(folder), FileWriter(bits), 0, 0
        for b in batches:
            for part, d, n, data in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids")), strict=True):
                if w.n >= file_ids:
                    yield put(out, w, part, nth)
                    w, nth = FileWriter(bits), nth + 1
                w.add(d, unpack(data, n, bits))
        if w.docs:
            yield put(out, w, part, nth)

    def put(out: SharedFiles, w: FileWriter, part: int, nth: int) -> pa.RecordBatch:
        out.put(_file(part, nth), w.parts())
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([w.n], pa.int64())], names=["part", "nth", "n"])

    counts = sorted(map(tuple, dealt.mapInArrow(written, "part int, nth int, n long").collect()))  # three numbers for each file
    listed, total = [], 0
    for part, nth, n in counts:
        listed.append([_file(part, nth), total])
        total += n
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(json.dumps(listed).encode())
    out.close()
    return folder, len(counts)


def _file(part: int, nth: int) -> str:
    return f"{part:06d}-{nth:03d}.tok"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a folder, a task each."""
    listed = json.loads("".join(r.value for r in spark.read.text(f"{folder}/manifest.json").collect()))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(folder)
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(np.memmap(files.local(name), mode="r"), before)
                rows = [(None if d == -(2**63) else d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in f.documents()]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(listed, "name string, before long").repartition(len(listed)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encodes ``docs`` with the tokenizers file at ``path``, writes the files and reads them back.

    One row for each row of ``docs``: doc_id (null where it was), start,
    n_tokens with the end id, ids_crc32. An empty table gives no files and an
    empty result; extra columns are not carried.
    """
    folder, _ = write(docs, lambda: chunk_encoder(path).encode, ChunkEncoder(path).vocabulary, end_id)
    return read(docs.sparkSession, folder)


def ids_of(folder: str, name: str) -> TokenFile:
    """One file for random access, memory mapped."""
    return TokenFile(np.memmap(SharedFiles(folder).local(name), mode="r"))


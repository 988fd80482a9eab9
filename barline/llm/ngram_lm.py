"""Scoring texts by a bigram model in an Elias-Fano trie.

The trie lies in the shared folder and is memory mapped. Its first level is the
vocabulary: word hashes in shards by their leading bits, with counts; a word's
id is its place among all. The second level is cut into groups of consecutive
contexts (a context with more than its share of the tokens has groups of its
own, by successor). In a group, monotone pointers give each context's range of
entries; successors are stored relative to their context, added up so that the
group is one monotone sequence, and both are Elias-Fano coded; a 16-bit code
holds each entry's discounted probability. The model is interpolated absolute
discounting over add-one unigrams,

    p(w | h) = max(c(h w) - D, 0) / c(h) + D T(h) / c(h) p(w),
    p(w) = (c(w) + 1) / (N + V + 1),

T(h) being the length of the context's range; p(w | h) = p(w) after an unseen
context. A text is its words and one end; the end is also the first context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import elias_fano
from barline.llm.common import SharedFiles, doc_crc, new_folder, tune

DISCOUNT = 0.75
#: Codes a unit of log10 has; 16 bits reach to 10^-16.
STEPS = 4000
END = b"\n"  # no word has a line end
#: Words a worker remembers; n-grams that it gathers before they are summed; tokens behind one group of the second level.
WORDS, GATHERED, GROUP_TOKENS = 300_000, 3_000_000, 4_000_000


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


@dataclass
class Model:
    """Where the trie is; small enough to go with every task (a number for each shard and group)."""

    folder: str
    bits: int
    offsets: list[int]
    total: int
    groups: int = 1
    hot: list[tuple[int, int]] = field(default_factory=list)  # contexts with groups of their own, and how many
    spans: dict[int, int] = field(default_factory=dict)  # T of these contexts
    written: bytes = b""  # a bit for each group of the second level: whether it has entries

    def has(self, group: int) -> bool:
        return group >> 3 < len(self.written) and bool(self.written[group >> 3] >> (7 - (group & 7)) & 1)

    @property
    def size(self) -> int:
        return self.offsets[-1]


class Reader:
    """A worker's view of a model; files are mapped when first needed."""

    def __init__(self, model: Model):
        self.m, self.files = model, SharedFiles(model.folder)
        self.cache: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.shards: dict[int, dict[str, np.ndarray]] = {}
        self.parts: dict[int, dict[str, np.ndarray] | None] = {}
        self.starts = np.array(model.offsets, dtype=np.int64)
        self.hot = np.array([c for c, _ in model.hot], dtype=np.int64)
        self.hot_n = np.array([n for _, n in model.hot], dtype=np.int64)
        self.hot_at = model.groups + np.r_[0, np.cumsum(self.hot_n)][:-1].astype(np.int64)
        self.hot_t = np.array([model.spans.get(c, 0) for c, _ in model.hot], dtype=np.int64)

    def shard(self, s: int) -> dict[str, np.ndarray]:
        if s not in self.shards:
            self.shards[s] = elias_fano.load(self.files.local(f"words-{s:05d}"))
        return self.shards[s]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Id of each word, -1 for an unknown one."""
        if len(self.cache) > WORDS:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        new = []
        for w in set(words).difference(cache):
            if w in old:
                cache[w] = old[w]
            else:
                new.append(w)
        if new:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, new), dtype=np.uint64, count=len(new))
            order = np.argsort(h)
            out, h = np.full(len(new), -1, dtype=np.int64), h[order]
            cuts = np.searchsorted(h, np.arange(1, 1 << self.m.bits, dtype=np.uint64) << np.uint64(64 - self.m.bits))
            for s, (a, b) in enumerate(zip(np.r_[0, cuts], np.r_[cuts, len(h)], strict=True)):
                if a < b and self.starts[s] < self.starts[s + 1]:
                    known = self.shard(s)["hash"]
                    at = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
                    out[order[a:b]] = np.where(known[at] == h[a:b], at + self.starts[s], -1)
            cache.update(zip(new, out.tolist(), strict=True))
        return np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training count of ids in ascending order, 0 for -1."""
        out = np.zeros(len(ids), dtype=np.int64)
        cuts = np.searchsorted(ids, self.starts)
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                out[a:b] = self.shard(s)["count"][ids[a:b] - self.starts[s]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.m.total + self.m.size + 1)

    def group_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        size = max(1, self.m.size)
        out = context * self.m.groups // size
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            is_hot = self.hot[i] == context
            out = np.where(is_hot, self.hot_at[i] + word * self.hot_n[i] // size, out)
        return out

    def part(self, g: int) -> dict | None:
        if g not in self.parts:
            # a group that was written and can't be read is an error, never an empty one
            a = elias_fano.load(self.files.local(f"pairs-{g:06d}")) if self.m.has(g) else None
            self.parts[g] = a and {"first": int(a["first"][0]), "ptr": elias_fano.EliasFano(a, "ptr"), "succ": elias_fano.EliasFano(a, "succ"), "code": a["code"]}
        return self.parts[g]

    def pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For known words in context: the discounted probability (0 if not seen), and T of the context."""
        seen, span = np.zeros(len(context)), np.zeros(len(context), dtype=np.int64)
        group = self.group_of(context, word)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True) if len(order) else ():
            at = order[a:b]
            p = self.part(int(group[at[0]]))
            if p is None:
                continue
            fresh = np.r_[True, np.diff(context[at]) != 0]  # pairs come in the order of contexts
            begin, end, base = (x[np.cumsum(fresh) - 1] for x in self._ranges(p, context[at[fresh]]))
            span[at] = end - begin
            some = np.flatnonzero(end > begin)
            at, begin, end, base = at[some], begin[some], end[some], base[some]
            i, found = p["succ"].successor(base + word[at].astype(np.uint64) + np.uint64(1))
            hit = np.flatnonzero(found & (i >= begin) & (i < end))
            seen[at[hit]] = 10.0 ** (-p["code"][i[hit]].astype(np.float64) / STEPS)
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            span = np.where(self.hot[i] == context, self.hot_t[i], span)
        return seen, span

    def _ranges(self, p: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range of entries of each context in a group (empty if not there), and the value before it."""
        begin, end, base = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64), np.zeros(len(context), np.uint64)
        j = context - p["first"]
        ok = np.flatnonzero((j >= 0) & (j + 1 < p["ptr"].n))
        begin[ok], end[ok] = p["ptr"].access(j[ok]).astype(np.int64), p["ptr"].access(j[ok] + 1).astype(np.int64)
        later = np.flatnonzero((begin > 0) & (end > begin))
        base[later] = p["succ"].access(begin[later] - 1)
        return begin, end, base

    def in_context(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ids of all tokens of the texts, the ids before them, where each text ends, and the id of the end."""
        lists = [tokens(t) for t in texts]
        ends = np.cumsum([len(x) for x in lists])
        ids = self.ids([w for x in lists for w in x])
        boundary = int(self.ids([END])[0])
        before = np.r_[boundary, ids[:-1]]
        before[ends[:-1]] = boundary
        return ids, before, ends, boundary

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text."""
        ids, before, ends, boundary = self.in_context(texts)
        types, inverse = np.unique(ids, return_inverse=True)
        count = self.counts(types)
        p1 = self.unigram(count)
        pair = before * (self.m.size + 1) + ids  # unknown ids are -1, so shifted
        keys, where = np.unique(pair + self.m.size + 2, return_inverse=True)
        first = np.empty(len(keys), dtype=np.int64)
        first[where] = np.arange(len(where))
        h, w = before[first], ids[first]
        c_h = np.where(h >= 0, self._lookup(types, count, h, boundary), 0)
        p_w = p1[np.searchsorted(types, w)]
        both = np.flatnonzero((h >= 0) & (w >= 0) & (c_h > 0))
        seen, span = np.zeros(len(keys)), np.zeros(len(keys), dtype=np.int64)
        seen[both], span[both] = self.pairs(h[both], w[both])
        ctx = np.flatnonzero((h >= 0) & (w < 0) & (c_h > 0))  # an unknown word still needs T of its context
        span[ctx] = self.pairs(h[ctx], np.zeros(len(ctx), dtype=np.int64))[1]
        back = np.where(span > 0, DISCOUNT * span / np.maximum(c_h, 1), 1.0)
        logs = np.log10(seen + back * p_w)[where]
        base = np.log10(p1)[inverse]
        known = (count > 0)[inverse]
        cut = np.r_[0, ends[:-1]]
        return list(zip(np.diff(np.r_[0, ends]).tolist(), np.add.reduceat(known.astype(np.int64), cut).tolist(), np.add.reduceat(base, cut).tolist(), np.add.reduceat(logs, cut).tolist(), strict=True))

    def _lookup(self, types: np.ndarray, count: np.ndarray, ids: np.ndarray, boundary: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(types, ids), len(types) - 1)
        return np.where(types[at] == ids, count[at], 0)


_READERS: dict[str, Reader] = {}


def reader(model: Model) -> Reader:
    """One reader a worker for the model at hand; that of another model is let go."""
    key = f"{model.folder}:{model.groups}:{len(model.spans)}:{len(model.hot)}"
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(model)
    return _READERS[key]


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unblob(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, count = key[order], count[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[cut], np.add.reduceat(count, cut) if len(key) else count


def _shards(group: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(group, start, end) of runs in a sorted array."""
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    yield from zip(group[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True)


def train(texts: DataFrame, text: str = "text") -> Model:
    """Builds the trie of all texts in the shared folder; only sizes, totals and over-frequent contexts reach the driver."""
    spark = tune(texts.sparkSession)
    folder, parts = new_folder(spark, "ngrams"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (parts - 1).bit_length())
    rows = texts.select(F.col(text).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def told() -> Iterator[pa.RecordBatch]:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), dtype=np.uint64, count=len(seen))
            h, n = _summed(h, np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
            got = [(s, _blob(h[a:b], n[a:b])) for s, a, b in _shards((h >> np.uint64(64 - bits)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["shard", "data"])

        for b in batches:
            for t in b.column(0).to_pylist():
                for w in tokens(t):
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > WORDS:
                yield from told()
                seen.clear()
        if seen:
            yield from told()

    def word_shard(t: pa.Table) -> pa.Table:
        data = [_unblob(x) for x in t.column("data").to_pylist()]
        h, n = _summed(np.concatenate([np.frombuffer(x, np.uint64, len(x) // 16) for x in data]), np.concatenate([np.frombuffer(x, np.int64, len(x) // 16, len(x) // 2) for x in data]))
        s = t.column("shard")[0].as_py()
        SharedFiles(folder).put(f"words-{s:05d}", elias_fano.dump({"hash": h, "count": n}))
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(h)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64())})

    sizes = {r.shard: (r.n, r.total) for r in rows.mapInArrow(words, "shard int, data binary").groupBy("shard").applyInArrow(word_shard, "shard int, n long, total long").collect()}
    offsets = [0, *np.cumsum([sizes.get(s, (0, 0))[0] for s in range(1 << bits)]).tolist()]
    model = Model(folder, bits, offsets, sum(t for _, t in sizes.values()))
    if not model.size:
        return model
    if model.size >= 1 << 32:
        raise ValueError("word ids have 32 bits")
    model.groups = max(parts, -(-model.total // GROUP_TOKENS))
    share = max(1, model.total // model.groups)
    model.hot = _frequent(spark, model, sorted(sizes), share)
    bare = Model(folder, bits, offsets, model.total, model.groups, model.hot)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader(bare)
        held: list[np.ndarray] = []
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            group = r.group_of(context, word)
            order = np.argsort(group, kind="stable")
            context, word, n, group = context[order], word[order], n[order], group[order]
            got = [(g, _blob(np.diff(context[a:b], prepend=0).astype(np.uint32), word[a:b].astype(np.uint32), n[a:b].astype(np.uint32))) for g, a, b in _shards(group)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["part", "data"])

        for b in batches:
            if b.num_rows:
                ids, before, _, _ = r.in_context(b.column(0).to_pylist())
                held.append((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
                size += len(ids)
            if size >= GATHERED:
                yield from told()
                held, size = [], 0
        if size:
            yield from told()

    def pair_group(t: pa.Table) -> pa.Table:
        r, g = reader(bare), t.column("part")[0].as_py()
        data = [_unblob(x) for x in t.column("data").to_pylist()]
        col = lambda i, x: np.frombuffer(x, np.uint32, len(x) // 12, i * (len(x) // 3))
        key = np.concatenate([(np.cumsum(col(0, x), dtype=np.uint64) << np.uint64(32)) | col(1, x) for x in data])
        key, n = _summed(key, np.concatenate([col(2, x).astype(np.int64) for x in data]))
        context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        kinds, starts = np.unique(context, return_index=True)
        ends = np.r_[starts[1:], len(context)]
        pointers = np.searchsorted(context, np.arange(kinds[0], kinds[-1] + 2)).astype(np.uint64)
        last = np.cumsum(word[ends - 1] + 1)  # the value of each context's last entry
        base = np.repeat(np.r_[0, last[:-1]], ends - starts)
        c_h = np.repeat(r.counts(kinds), ends - starts)
        code = np.clip(np.rint(-np.log10((n - DISCOUNT) / c_h) * STEPS), 0, 65535).astype("<u2")
        arrays = {"first": np.array([kinds[0]], dtype="<i8"), "code": code} | elias_fano.build(pointers, "ptr") | elias_fano.build((base + word + 1).astype(np.uint64), "succ")
        SharedFiles(folder).put(f"pairs-{g:06d}", elias_fano.dump(arrays))
        return pa.table({"part": pa.array([g], pa.int32()), "context": pa.array([int(kinds[0])], pa.int64()), "n": pa.array([len(key)], pa.int64())})

    built = rows.mapInArrow(pairs, "part int, data binary").groupBy("part").applyInArrow(pair_group, "part int, context long, n long")
    written = np.zeros(model.groups + sum(n for _, n in model.hot), dtype=bool)
    for r in built.collect():  # three numbers for each group
        written[r.part] = True
        if r.part >= model.groups:
            model.spans[r.context] = model.spans.get(r.context, 0) + r.n
    model.written = np.packbits(written).tobytes()
    return model


def _frequent(spark: SparkSession, model: Model, shards: list[int], share: int) -> list[tuple[int, int]]:
    """Contexts of more than ``share`` tokens (so at most as many as groups) and the groups each gets, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(model)
        for b in batches:
            for s in b.column(0).to_pylist():
                n = r.shard(s)["count"]
                at = np.flatnonzero(n > share)
                yield pa.RecordBatch.from_arrays([pa.array(at + model.offsets[s]), pa.array(n[at])], names=["id", "n"])

    got = spark.createDataFrame([(s,) for s in shards], "shard int").repartition(min(len(shards), 64)).mapInArrow(run, "id long, n long").collect()
    return sorted((r.id, -(-r.n // share)) for r in got)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    The model learns from the rows whose crc32(doc_id as text) leaves other
    than 2 when divided by 7 (a null id counts as 0) and scores all. A null
    text counts as empty: its one token is the end. Repeated rows are counted
    and scored as often as they stand. With no training row every probability
    is 1 and both scores are 0. Extra columns are not carried.
    """
    spark = tune(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (doc_crc(key) % 7 == 2).alias("held_out"))
    model = train(rows.where("not held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader(model)
        for b in batches:
            if b.num_rows:
                n, known, base, total = zip(*r.score(b.column(1).to_pylist()), strict=True)
                cols = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.total] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    assert spark is docs.sparkSession
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

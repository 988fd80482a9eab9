"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into four 16-bit segments on a ring. Where two
fingerprints differ in at most three bits, some start segment exists from which
every chain of l consecutive segments differs in at most floor(3 l / 4) bits:
0, 1, 2, 3 (the pigeonring principle). The first segment is therefore equal,
and of the second, cut into halves, at least one half is: eight 24-bit keys for
each distinct fingerprint find every link. Candidates of a key must pass the
chain of two, then of three segments, and only then the full Hamming check.

``near_duplicates`` fingerprints three-word shingles. An edit of one word changes
three of them, so copies with five-word Jaccard 0.8 differ in 4 to 11 bits and
few meet at three. ``near_copies`` therefore takes four fingerprints of a text's
words, where one edit changes one feature: a pair is linked where any of the four
is within three bits and the five-word shingles themselves have Jaccard 0.8 or
more; sketches of the shingles (256 one-bit minima) choose the pairs to compare.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import checkpoint, map_arrow, tune, with_cleared, written
from barline.llm.components import components

SEED = 42
MAX_BITS = 3
#: Members of one key that are compared as one block; more are dealt out as pairs of blocks.
BLOCK = 1024
#: Word fingerprints of ``near_copies``; each more finds more of the pairs at the edge of similarity.
TABLES = 4
#: Bits of 256 in which the sketches of a linked pair may differ: Jaccard 0.8 differs in 25.6 on average, with deviation 4.8, so this is over six deviations away.
SKETCH_BUDGET = 57
#: Bits within which pairs are tried first, as those are mostly links.
FIRST_BUDGET = 30
SKETCH = ["s0", "s1", "s2", "s3"]
#: Texts of one cluster whose shingles are compared as one block, blocks of a cluster, and shingles of a block: more texts make
#: larger blocks, not more copies of each, until a block would not fit a task.
EXACT_BLOCK, EXACT_BLOCKS, EXACT_SHINGLES = 256, 16, 1 << 21


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(len(words) - width + 1, 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long. A null text counts as empty."""
    tune(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id long, fp long", run)


def shingle_set(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted XXH64 of the distinct word shingles; of fewer words the whole sequence, of none nothing."""
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if n > 0 else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype=np.uint64, count=max(n, min(len(words), 1))))


@lru_cache(maxsize=1 << 16)
def _word_bytes(word: bytes) -> bytes:
    return xxhash.xxh3_128_digest(word, seed=SEED) + xxhash.xxh3_128_digest(word, seed=SEED + 1)


def signature(text: str | None) -> np.ndarray:
    """Eight words: four SimHash fingerprints of the words, then 256 one-bit minima of the five-word shingles; zeros where there is no word.

    A word weighs the 0.6th power of its count, in sixteenths: by plain counts
    a few frequent words make unlike texts alike, and by presence alone an edit
    weighs more in short texts.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(8, dtype=np.uint64)
    counts = list(Counter(words).items())
    ones, total = np.zeros(64 * TABLES), 0
    for i in range(0, len(counts), 1024):
        part = counts[i : i + 1024]
        w = np.floor(16 * np.array([c for _, c in part], dtype=np.float64) ** 0.6)  # whole numbers, so sums are exact
        bits = np.unpackbits(np.frombuffer(b"".join([_word_bytes(x) for x, _ in part]), dtype=np.uint8).reshape(len(part), -1), axis=1)
        ones += w @ bits.astype(np.float64)
        total += w.sum()
    low = np.full(64 * len(SKETCH), 2**32 - 1, dtype=np.uint32)
    h = shingle_set(words).astype(np.uint32)  # the lower halves order well enough
    for i in range(0, len(h), 64):
        np.minimum(low, (h[i : i + 64, None] * _STEPS).min(axis=0), out=low)
    bits = np.r_[2 * ones > total, (low & 256).astype(bool)]
    return np.packbits(bits).view("<u8")


#: Odd multipliers that make an ordering of shingles each.
_STEPS = np.array([xxhash.xxh64_intdigest(f"{i}", seed=SEED) | 1 for i in range(64 * len(SKETCH))], dtype=np.uint64).astype(np.uint32)


def _chained(a: np.ndarray, b: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Where the chains of two and three segments from the start segment, and then the whole, stay within their budgets."""
    x = a ^ b
    s = (turn * 16).astype(np.uint64)
    x = (x >> s) | (x << ((np.uint64(64) - s) & np.uint64(63)))
    ok = np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= 1
    at = np.flatnonzero(ok)
    y = x[at]
    at = at[(np.bitwise_count(y & np.uint64(0xFFFFFFFFFFFF)) <= 2) & (np.bitwise_count(y) <= MAX_BITS)]
    out = np.zeros(len(x), dtype=bool)
    out[at] = True
    return out


def _alike(sketch: list[np.ndarray], part: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where the sketches of rows i and j are within the budget, and the parts differ; everywhere, if rows carry neither."""
    ok = np.ones(len(j), dtype=bool) if part is None else part[i] != part[j]
    if sketch:
        ok &= sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int64) for s in sketch) <= (FIRST_BUDGET if part is None else SKETCH_BUDGET)
    return ok


def _forest(fp: np.ndarray, sketch: list[np.ndarray], part: np.ndarray | None, turn: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in one block: each row is compared with those not yet reached."""
    todo, out = np.arange(len(fp)), []
    if part is not None and (part == part[0]).all():
        return out
    while len(todo):
        stack, todo = [int(todo[0])], todo[1:]
        while stack and len(todo):
            i = stack.pop()
            hit = _chained(fp[todo], np.full(len(todo), fp[i]), np.full(len(todo), turn))
            hit[hit] = _alike(sketch, part, np.full(int(hit.sum()), i), todo[hit])
            near = todo[hit]
            if len(near):
                out += [(i, int(j)) for j in near]
                stack += near.tolist()
                todo = todo[~hit]
    return out


def _links(rows: list[np.ndarray], apart: bool) -> pa.RecordBatch:
    """Links among rows sorted by group, or among those of different parts; a group's rows are consecutive."""
    turn, group, fp, node, *sketch = rows
    part = sketch.pop() if apart else None
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    a, b = [], []
    small = np.repeat(sizes <= 12, sizes)
    for d in range(1, 12):  # small groups: every pair at distance d in the sorted rows
        i = np.flatnonzero((group[d:] == group[:-d]) & small[d:]) if len(group) > d else np.empty(0, int)
        if not len(i):
            break
        i = i[_chained(fp[i], fp[i + d], turn[i])]
        i = i[_alike(sketch, part, i, i + d)]
        a.append(node[i])
        b.append(node[i + d])
    for s, n in zip(starts[sizes > 12], sizes[sizes > 12], strict=True):
        e = np.array(_forest(fp[s : s + n], [x[s : s + n] for x in sketch], part[s : s + n] if apart else None, int(turn[s])), dtype=np.int64).reshape(-1, 2) + s
        a.append(node[e[:, 0]])
        b.append(node[e[:, 1]])
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _exact(sig: np.ndarray, part: np.ndarray, own: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of the links between parts of a block, or of two blocks: a row is compared with those of parts not yet joined to its own."""
    sizes = np.array([len(x) for x in sets])
    cut = np.r_[0, np.cumsum(sizes)]
    found, ids = np.unique(np.concatenate(sets), return_inverse=True)
    hit, part, out = np.zeros(len(found), dtype=bool), part.copy(), []
    two = (own != own[0]).any()  # pairs within either block are another group's
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
        if two:
            j = j[own[j] != own[i]]
        j = j[(np.bitwise_count(sig[j, :TABLES] ^ sig[i, :TABLES]) <= MAX_BITS).any(axis=1)]
        j = j[np.bitwise_count(sig[j, TABLES:] ^ sig[i, TABLES:]).sum(axis=1) <= SKETCH_BUDGET]
        least = -(-4 * (sizes[i] + sizes[j]) // 9)  # common / all >= 4 / 5
        fits = np.minimum(sizes[i], sizes[j]) >= least
        j, least = j[fits], least[fits]
        if not len(j):
            continue
        mine = ids[cut[i] : cut[i + 1]]
        hit[mine] = True
        common = np.add.reduceat(hit[np.concatenate([ids[cut[k] : cut[k + 1]] for k in j])], np.r_[0, np.cumsum(sizes[j])[:-1]], dtype=np.int64)
        hit[mine] = False
        for k in j[common >= least].tolist():
            if part[k] != part[i]:
                part[part == part[k]] = part[i]
                out.append((i, k))
    return out


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): node pairs that connect all distinct fingerprints (fp, node) at most three bits apart.

    Not all pairs are returned: within a block of candidates a spanning forest
    is enough for the components. A key with more than ``block`` members is cut
    into blocks and each pair of blocks goes to a task of its own, so that no
    task ever holds more than about three blocks. Where ``distinct`` has the
    columns of SKETCH, linked rows must be alike by them too; where it has
    ``slot``, only rows with the same slot (0 to 2^20) meet. Where it has
    ``part``, the forest is one of the pairs of different parts (then up to
    SKETCH_BUDGET), and none within a part is returned.
    """
    apart = "part" in distinct.columns
    carried = ["fp", "node"] + [c for c in [*SKETCH, "part"] if c in distinct.columns]
    turn = lambda r: F.expr(f"(shiftrightunsigned(fp, {16 * r}) | shiftleft(fp, {(64 - 16 * r) % 64}))") if r else F.col("fp")
    keys = F.array(*[F.struct(F.lit(2 * r + h).alias("slot"), turn(r).bitwiseAND(F.lit((0xFFFF | (0xFF << (16 + 8 * h))))).alias("val")) for r in range(4) for h in range(2)])
    slot = F.shiftleft(F.col("slot").cast("long"), 40) if "slot" in distinct.columns else F.lit(0)
    rows = distinct.select(*carried, slot.alias("of"), F.explode(keys).alias("k")).select((F.col("of") + F.col("k.val") * 8 + F.col("k.slot")).alias("key"), *carried)
    many = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    nb = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), nb).cast("int")
    rows = rows.join(many, "key").select("key", *carried, nb.alias("nb"), own.alias("own"))
    rows = rows.select("key", *carried, F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.expr("transform(sequence(0, nb - 1), j -> least(own, j) * nb + greatest(own, j))"))).alias("pair"))
    rows = rows.repartition("key", "pair").sortWithinPartitions("key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for b in batches:
            key, pair, fp, node, *sketch = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "pair", *carried))
            new = [key, pair, fp.view(np.uint64), node, *(s.view(np.uint64) for s in sketch)]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
            key, pair = kept[:2]
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield grouped([x[:cut] for x in kept])
                kept = [x[cut:] for x in kept]
        if kept and len(kept[0]):
            yield grouped(kept)

    def grouped(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, pair, *rest = rows
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
        return _links([(key & 7) >> 1, group, *rest], apart)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id), a row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints at most
    three bits apart, the document's own included. Rows without a word (null
    and empty texts) have fingerprint zero and are linked like any other.
    Repeated rows stay repeated. A null doc_id is never the smallest of a
    component that has others; in one of null ids only, component_id is null.
    An empty table gives an empty result. Extra columns are not carried.
    """
    fps = checkpoint(fingerprints(docs, key, text, width))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.coalesce("low", F.lit(-(2**63)) + F.abs(F.xxhash64("fp") % 2**40))))
    found = components(links(distinct.select("fp", "node")))
    ids = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("root"), "low")
    if not distinct.where("low is null").isEmpty():  # a stand-in for a null id must not name a component
        ids = checkpoint(ids)
        ids = ids.join(ids.groupBy("root").agg(F.min("low").alias("least")), "root").select("fp", F.col("least").alias("component_id"))
    else:
        ids = ids.select("fp", F.col("root").alias("component_id"))
    return fps.join(checkpoint(ids), "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def exact_links(ends: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): nodes of different parts that link all parts of a cluster which any link joins.

    ``ends`` has a row for each node with its signature, part and cluster,
    ``known`` the shingles of each node. A cluster of many texts is cut into
    blocks, and each pair of blocks is compared by itself.
    """
    names = [f"f{i}" for i in range(TABLES)] + SKETCH
    rows = ends.join(known.withColumnRenamed("doc_id", "node"), "node")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("all"))
    sizes = checkpoint(sizes.select("cluster", F.greatest(F.least(F.ceil(F.col("n") / EXACT_BLOCK), F.lit(EXACT_BLOCKS)), F.ceil(F.col("all") / EXACT_SHINGLES)).cast("int").alias("nb")))
    rows = rows.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = F.explode(F.expr("transform(sequence(0, nb - 1), j -> least(own, j) * nb + greatest(own, j))")).alias("pair")
    rows = rows.select("cluster", pairs, "own", "part", "node", *names, "shingles").repartition("cluster", "pair").sortWithinPartitions("cluster", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, list[np.ndarray]]] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            flat = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(b.num_columns - 1)], axis=1)
            lists = b.column(b.num_columns - 1)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            starts = np.flatnonzero(np.r_[True, (flat[1:, :2] != flat[:-1, :2]).any(axis=1)]).tolist()
            for s, e in zip(starts, [*starts[1:], len(flat)], strict=True):
                if last != (last := tuple(flat[s, :2].tolist())) and kept:
                    yield grouped(kept)
                    kept = []
                kept.append((flat[s:e, 2:], [values[at[k] : at[k + 1]] for k in range(s, e)]))
        if kept:
            yield grouped(kept)

    def grouped(kept: list[tuple[np.ndarray, list[np.ndarray]]]) -> pa.RecordBatch:
        own, part, node, *sig = np.concatenate([x for x, _ in kept]).T
        e = np.array(_exact(np.stack(sig, axis=1).view(np.uint64), part, own, [x for _, sets in kept for x in sets]), dtype=np.int64).reshape(-1, 2)
        a, b = node[e[:, 0]], node[e[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id), a row for each row of ``docs`` that has an id.

    Texts are linked where one of four word fingerprints is within three bits
    and the sets of five-word shingles have Jaccard 0.8 or more. A first pass
    takes a forest of each block by the sketches and compares the shingles of
    its edges; a second one compares every pair of candidates whose texts are still
    in different components, so that no link is lost behind an edge that the
    shingles refused. Its pairs are never listed: a forest of them joins texts to
    clusters, and the tasks that compare blocks of a cluster return a forest of the
    links. Only pairs whose sketches differ in more than SKETCH_BUDGET
    bits of 256, which is over six deviations away, are not compared. The shingles
    of candidates alone are gathered. ``component_id`` is the smallest doc_id
    reachable, the document's own included. Texts without a word (null and empty ones) are
    linked with each other only; texts of one to four words only with texts of
    the same words. Rows without an id link nothing and have no row. Repeated rows stay
    repeated; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    names = [f"f{i}" for i in range(TABLES)] + SKETCH

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.array([signature(t) for t in b.column(1).to_pylist()], dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in sig.T)], names=["doc_id", *names])

    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = checkpoint(map_arrow(own, f"doc_id long, {', '.join(f'{c} long' for c in names)}", run))
    distinct = checkpoint(rows.groupBy(*names).agg(F.min("doc_id").alias("node")))
    tables = F.posexplode(F.array(*names[:TABLES])).alias("slot", "fp")
    keyed = distinct.select("node", *SKETCH, tables)
    near = written(links(keyed).where("a <> b").distinct(), "links")

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set((t or "").encode("utf-8", "surrogatepass").lower().split()).view(np.int64) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    def shingled(ends: DataFrame) -> DataFrame:
        return written(map_arrow(own.join(ends, "doc_id", "left_semi"), "doc_id long, shingles array<long>", sets), "shingles")

    def confirmed(pairs: DataFrame, known: DataFrame) -> DataFrame:
        side = lambda c, of: known.select(F.col("doc_id").alias(c), F.col("shingles").alias(of))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")  # common / all >= 4 / 5

    ends_of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sure = checkpoint(confirmed(near, shingled(written(ends_of(near), "ends"))))
    # what the first pass can lose: links behind an edge of a forest that the shingles refused, and those beyond the first budget of the sketch
    found = components(sure)
    parts = checkpoint(distinct.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("part")))
    clusters = components(links(keyed.join(parts, "node")))
    if not clusters.isEmpty():
        ends = written(distinct.join(parts, "node").join(clusters, "node").select("node", *names, "part", F.col("component").alias("cluster")), "ends")
        more = checkpoint(exact_links(ends, shingled(ends.select(F.col("node").alias("doc_id")))))
        found = components(sure.unionByName(more))
    ids = checkpoint(distinct.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id")))
    return rows.join(ids, names).select("doc_id", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component of ``near_copies``: one document of each group of near duplicates.

    Of repeated rows with that id one stays. Rows without an id can't be told
    apart by it and all stay. Every column of ``docs`` is returned.
    """
    own = with_cleared(docs, "__bl_one", "__bl_nth")
    heads = checkpoint(near_copies(own, key, text).where("doc_id = component_id").groupBy(F.col("doc_id").alias("__bl_one")).agg(F.count("*").alias("__bl_nth")))
    kept = own.join(heads.select("__bl_one"), own[key].cast("long") == F.col("__bl_one"), "left_semi")
    if not heads.where("__bl_nth > 1").isEmpty():
        kept = kept.withColumn("__bl_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text), text))).where("__bl_nth = 1").drop("__bl_nth")
    return kept.unionByName(own.where(F.col(key).isNull()))

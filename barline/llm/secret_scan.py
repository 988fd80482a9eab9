"""Secret scans: fixed patterns, and tokens that a battery of randomness tests takes for keys.

Candidates are long runs of the characters that encodings of keys use. The
smallest alphabet that holds a run is its encoding; its symbols are then put to
three tests of "uniform and independent": chi-squared over the alphabet, runs
above and below the alphabet's middle (Wald and Wolfowitz), and serial
correlation at lag one. A run that one of them rejects is ordinary.

Short runs pass such tests by chance, so a pass isn't a finding yet. The null
hypothesis of the finding is "as in ordinary text", which the corpus itself
describes: how often each symbol occurs, and with that the exact mean and
variance of the number of equal pairs among n symbols; and how often a digit
stands beside a letter, and with that the chance of so many changes between
the two. The gap between random and ordinary grows with n, and so does the
evidence of either, of which twice the smaller p-value counts. Benjamini and
Hochberg's step-up bounds the share of false findings at ``fdr`` in each
stratum of encoding and length; a run that fails the battery counts with a
p-value of one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import map_arrow, tune, with_cleared, written

# The base patterns and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Shortest run that is tested, level of the battery, bound on the share of false findings.
MIN_SYMBOLS, ALPHA, FDR = 16, 0.01, 0.05
#: Lower ends of the strata of length, and the parts of a unit of -ln(p) in which p-values are counted.
OCTAVES, STEP, DEEPEST = (16, 24, 32, 48, 96), 20, 2000

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by alphabet, smallest first; a run belongs to the first that holds it. Digits alone are no key.
ALPHABETS = {
    "digits": _DIGITS, "hex": _DIGITS + "abcdef", "hex_upper": _DIGITS + "ABCDEF", "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER, "base36_upper": _DIGITS + _UPPER, "letters": _UPPER + _LOWER, "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_", "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}
_NAMES = list(ALPHABETS)


def _table(chars: str) -> np.ndarray:
    out = np.full(256, -1, dtype=np.int16)
    out[np.frombuffer(chars.encode(), np.uint8)] = np.arange(len(chars))
    return out


_INDEX = [_table(c) for c in ALPHABETS.values()]
_TOKEN = _INDEX[-1] >= 0
_DIGIT, _LETTER = _table(_DIGITS) >= 0, _table(_LOWER + _UPPER) >= 0


def encoding(symbols: np.ndarray) -> int:
    """Number of the smallest alphabet that holds all of these bytes."""
    present = np.flatnonzero(np.bincount(symbols, minlength=256))
    return next(i for i, t in enumerate(_INDEX) if (t[present] >= 0).all())


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(symbols: np.ndarray, k: int) -> tuple[float, float, float]:
    """p-values of uniformity (chi-squared), of runs and of serial correlation, for symbols 0 to k - 1.

    Chi-squared is taken to a normal by Wilson and Hilferty's cube root, with
    its exact variance for n symbols, which differs from 2 (k - 1) in short runs.
    """
    n = len(symbols)
    counts = np.bincount(symbols, minlength=k).astype(np.float64)
    chi, df = float(((counts - n / k) ** 2).sum() * k / n), k - 1
    scale = (n - 1) / n  # variance 2 df (n - 1) / n: a gamma of this scale
    shape = df / scale
    z = ((chi / scale / shape) ** (1 / 3) - (1 - 2 / (9 * shape))) / math.sqrt(2 / (9 * shape))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = symbols >= (k + 1) // 2
    a = int(high.sum())
    b = n - a
    runs = 0.0
    mean = 2 * a * b / n + 1
    if a and b and (var := (mean - 1) * (mean - 2) / (n - 1)) > 0:
        runs = two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    x = symbols - symbols.mean()
    energy = float((x * x).sum())
    serial = 0.0
    if energy > 0:
        r = float((x * np.roll(x, 1)).sum()) / energy
        serial = two_sided((r + 1 / (n - 1)) / math.sqrt(n * (n - 3) / ((n + 1) * (n - 1) ** 2)))
    return uniform, runs, serial


def changes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte but the first, whether it and the one before are both letters or digits, and whether they are one of each."""
    digit, letter = _DIGIT[data], _LETTER[data]
    either = digit | letter
    return either[1:] & either[:-1], (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])


def _spans(text: bytes, long_runs: list[tuple[int, int]], assigned: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in bytes; access and hex matches of their least lengths lie within long runs."""
    out = []
    if assigned:
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for a, b in long_runs:
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            out += [(a + m.start(), kind, a + m.end()) for m in pattern.finditer(text[a:b]) if m.end() - m.start() >= LEAST[KINDS[kind]]]
    return sorted(out)


def _candidates(data: np.ndarray, runs: list[tuple[int, int]], taken: list[tuple[int, int, int]], alpha: float) -> list[dict]:
    """The runs of a text that no base span touches, with encoding, length, equal pairs and the battery's verdict."""
    out = []
    for a, b in runs:
        if any(s < b and e > a for s, _, e in taken) or (a and data[a - 1] >= 0x80) or (b < len(data) and data[b] >= 0x80):
            continue
        code = encoding(data[a:b])
        if not code:
            continue
        symbols = _INDEX[code][data[a:b]].astype(np.int64)
        k = len(ALPHABETS[_NAMES[code]])
        counts = np.bincount(symbols, minlength=k)
        beside, changed = (int(x.sum()) for x in changes(data[a:b]))
        passed = min(battery(symbols, k)) >= alpha / 3
        out.append({"start": a, "end": b, "encoding": code, "n": b - a, "pairs": int((counts * (counts - 1) // 2).sum()), "beside": beside, "changed": changed, "passed": passed})
    return out


def _to_points(data: np.ndarray, places: list[int]) -> list[int]:
    """Byte offsets within a UTF-8 text as code points."""
    before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return before[places].tolist()


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("n", pa.int64()), ("pairs", pa.int64()), ("beside", pa.int64()), ("changed", pa.int64()), ("passed", pa.bool_())])
_FOUND = "doc_id long, base array<struct<start:long,kind:int,end:long>>, candidates array<struct<start:long,end:long,encoding:int,n:long,pairs:long,beside:long,changed:long,passed:boolean>>, symbols array<long>"


def _first_pass(b: pa.RecordBatch, alpha: float, least: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, then one with the batch's counts of bytes, of letters and digits side by side, and of changes between them."""
    col = b.column(1)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    whole = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _TOKEN[whole]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(whole))]  # runs end with their text
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    runs: dict[int, list[tuple[int, int]]] = {}
    for d, s, e in zip((np.searchsorted(offsets, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        runs.setdefault(d, []).append((s - int(offsets[d]), e - int(offsets[d])))
    low, assigned = whole.tobytes().lower(), set()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:  # on to the next text: one hit is enough to look at a text
            d = int(np.searchsorted(offsets, at, side="right")) - 1
            assigned.add(d)
            at = low.find(word, int(offsets[d + 1]))
    base: list[list[dict]] = [[] for _ in range(len(col))]
    found: list[list[dict]] = [[] for _ in range(len(col))]
    for d in sorted(runs.keys() | assigned):
        data = whole[offsets[d] : offsets[d + 1]]
        spans = _spans(data.tobytes(), runs.get(d, []), d in assigned)
        extra = _candidates(data, runs.get(d, []), spans, alpha)
        points = _to_points(data, [p for s, _, e in spans for p in (s, e)] + [p for x in extra for p in (x["start"], x["end"])])
        base[d] = [{"start": points[2 * i], "kind": k, "end": points[2 * i + 1]} for i, (_, k, _) in enumerate(spans)]
        rest = points[2 * len(spans) :]
        found[d] = [x | {"start": rest[2 * i], "end": rest[2 * i + 1]} for i, x in enumerate(extra)]
    beside, changed = changes(whole)
    beside[edges - 1], changed[edges - 1] = False, False
    names, counts = ["doc_id", "base", "candidates", "symbols"], [*np.bincount(whole, minlength=256).tolist(), int(beside.sum()), int(changed.sum())]
    longs = pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_CANDIDATE)), pa.nulls(len(col), longs)], names=names)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(_SPAN)), pa.nulls(1, pa.list_(_CANDIDATE)), pa.array([counts], longs)], names=names)


def moments(counts: dict[int, int]) -> dict[int, tuple[float, float]]:
    """By encoding, the sums of squares and of cubes of the symbols' shares in ordinary text; uniform where the text has none."""
    out = {}
    for i, chars in enumerate(ALPHABETS.values()):
        c = np.array([counts.get(ord(x), 0) for x in chars], dtype=np.float64)
        share = c / c.sum() if c.sum() else np.full(len(c), 1 / len(c))
        out[i] = float((share**2).sum()), float((share**3).sum())
    return out


def depth(c: Column, s2: Column, s3: Column, rate: float) -> Column:
    """-ln of a run's p-value in whole steps, rounded towards 0; 0 for runs that failed the battery.

    Both p-values are bounded from above: the lower tail of the number of equal
    pairs, which is skewed to the right, by the normal one, and that by
    exp(-z^2 / 2) / 2; the upper tail of the binomial number of changes by
    Chernoff's exp(-n KL). Errors are to the safe side.
    """
    n = c["n"]
    two, three = n * (n - 1) / 2, n * (n - 1) * (n - 2)
    spread = F.sqrt(F.greatest(two * (s2 - s2 * s2) + three * (s3 - s2 * s2), F.lit(1e-9)))
    z = F.greatest((two * s2 - c["pairs"]) / spread, F.lit(0.0))
    x = c["changed"] / F.greatest(c["beside"], F.lit(1))
    part = lambda x, q: F.when(x > 0, x * F.ln(F.when(x > 0, x / q).otherwise(1.0))).otherwise(0.0)
    tail = F.when(x > rate, c["beside"] * (part(x, rate) + part(1 - x, 1 - rate))).otherwise(0.0)
    nats = F.greatest(z * z / 2 + math.log(2), tail) - math.log(2)
    return F.when(c["passed"], F.least(F.greatest(F.floor(nats * STEP), F.lit(0)), F.lit(DEEPEST))).otherwise(0).cast("int")


def cutoffs(counted: dict[tuple[int, int], dict[int, int]], fdr: float) -> dict[tuple[int, int], int]:
    """By stratum, the least depth that is a finding: Benjamini and Hochberg's step-up over counted p-values."""
    out = {}
    for stratum, by_depth in counted.items():
        m, so_far = sum(by_depth.values()), 0
        for d in sorted(by_depth, reverse=True):
            so_far += by_depth[d]
            if math.exp(-d / STEP) <= fdr * so_far / m:
                out[stratum] = d
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, fdr: float = FDR, least: int = MIN_SYMBOLS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans), a row for each row of ``docs``.

    ``base``: array of (start, kind, end) of the fixed patterns, ``spans``: these
    and the findings of the battery, of kind ``random``; in order of start, then
    kind as listed; code points, end exclusive. A run that touches a base span
    is not tested again, nor one that a letter beyond ASCII adjoins, as it is a
    piece of a word. A null text is an empty one and has no spans; a null id
    stays null; repeated rows have the same spans; an empty table gives an empty
    result; other columns are ignored. Texts are read once. What the driver
    sees: 258 counts, and counts of strata and depths, whose number is fixed.
    """
    spark = tune(docs.sparkSession)
    own = with_cleared(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    found = written(map_arrow(own, _FOUND, lambda b: _first_pass(b, alpha, least)), "secrets")
    sums = found.where("symbols is not null").select(F.posexplode("symbols").alias("symbol", "n")).groupBy("symbol").agg(F.sum("n").alias("n"))
    known = {r.symbol: r.n for r in sums.collect()}  # 258 rows
    shares, rate = moments(known), (known.get(257, 0) + 1) / (known.get(256, 0) + 2)
    rows = found.where("symbols is null")
    pick = lambda c, j: F.element_at(F.array(*[F.lit(shares[i][j]) for i in range(len(_NAMES))]), c["encoding"] + 1)
    octave = lambda c: sum((c["n"] >= o).cast("int") for o in OCTAVES)
    rated = lambda c: F.struct(c["encoding"].alias("encoding"), octave(c).alias("octave"), depth(c, pick(c, 0), pick(c, 1), rate).alias("depth"))
    counts = rows.where(F.size("candidates") > 0).select(F.explode(F.transform("candidates", rated)).alias("c")).groupBy("c").count()
    strata: dict[tuple[int, int], dict[int, int]] = {}
    for r in counts.collect():  # encodings x octaves x depths at most
        strata.setdefault((r.c.encoding, r.c.octave), {})[r.c.depth] = r["count"]
    cuts = cutoffs(strata, fdr)
    allowed = F.create_map(*[F.lit(x) for (e, o), d in sorted(cuts.items()) for x in (e * 100 + o, max(d, 1))]) if cuts else None

    def finding(c: Column) -> Column:
        r = rated(c)
        return F.coalesce(r["depth"] >= F.try_element_at(allowed, r["encoding"] * 100 + r["octave"]), F.lit(False))

    names = F.array(*map(F.lit, (*KINDS, "random")))
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    random = F.transform(F.filter("candidates", finding), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), c["end"].alias("end"))) if cuts else F.filter("base", lambda c: F.lit(False))
    named = lambda s: F.transform(F.sort_array(F.transform(s, plain)), lambda c: F.struct(c["start"].alias("start"), F.element_at(names, c["kind"] + 1).alias("kind"), c["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], named(F.col("base")).alias("base"), named(F.concat("base", random)).alias("spans"))


def joined(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")

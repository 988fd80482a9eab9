"""Mixing to target weights by soft membership, with DataFrame and SQL functions only.

A naive-Bayes classifier over hashed words, fitted on a labelled table, gives
each document's domain posteriors p. Document rates r >= 0 (or another least)
are fitted by projected gradients to minimise

    1/2 sum_d (s_d - t_d)^2 / a_d + ridge/2 sum_i n_i (r_i - 1)^2,
    s_d = sum_i n_i p_id r_i,

where n_i are tokens, a_d natural totals and t_d the targets. The steps are
summed and the sum is projected (lazy projection): a rate's gradient needs only
its own posteriors and one number for each domain, so after any number of steps

    r_i = max(least, 1 - p_i . l),    l the sum of the domains' numbers.

Rates are never stored and no step is replayed: a round is one sum over a
compact table. Steps are scaled by an estimate of the curvature among domains
(quasi-Newton, on the driver: domains squared numbers), since overlapping
domains and rates at their least make plain steps crawl. The rounds end where
(s_d - t_d) / a_d = ridge l_d for every domain, which holds at the minimum and
nowhere else; a fit that doesn't get there is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import checkpoint, with_cleared

BUCKETS, MAX_LABELLED, MAX_DOMAINS, BLANK = 1024, 20_000, 256, r"[\x20\x09-\x0D]+"
#: Words' worth of evidence that a posterior counts at most; more would make all memberships hard.
EVIDENCE = 50
#: CLOSE: how far from the minimum's condition a fit may end, as a share of a domain's natural total.
RIDGE, ROUNDS, CLOSE = 1e-4, 1000, 1e-5


def _exploded(docs: DataFrame, text: str, **keep: Column) -> DataFrame:
    """A row for each word, lower-cased, as its bucket ``b``; an empty word has the bucket BUCKETS.

    What is kept is computed before the words are exploded: in one select it
    would be computed for each word.
    """
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BLANK)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], words.alias("ws")).select(*keep, F.explode("ws").alias("w"))
    return rows.select(*keep, F.when(F.col("w") == "", F.lit(BUCKETS)).otherwise(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")).alias("b"))


def row_key(key: str, text: str) -> Column:
    """Tells rows apart; rows equal in id and text are one document whose tokens count as often as it stands."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text), F.lit("mix"))


def classifier(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_LABELLED) -> tuple[list[str], list[list[float]]]:
    """Domains in order, and for each the log probabilities of the buckets, the last entry the log prior.

    Fitted on the documents of a labelled table (doc_id, domain), at most
    ``max_rows`` rows of it in the order of a hash of the id; at most
    MAX_DOMAINS x BUCKETS counts reach the driver.
    """
    marks = labelled.where("doc_id is not null and domain is not null").select(F.col("doc_id").alias("_id"), F.col("domain").cast("string").alias("d"))
    marks = checkpoint(marks.orderBy(F.xxhash64("_id"), "d").limit(max_rows))
    sizes = {r.d: r.n for r in marks.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    names = sorted(sizes)
    counts = {n: [1.0] * BUCKETS for n in names}
    # at most max_rows short rows: safe to broadcast whatever the tables' size
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("t")).join(F.broadcast(marks), "_id")
    for r in _exploded(rows, "t", d=F.col("d")).where(F.col("b") < BUCKETS).groupBy("d", "b").count().collect():
        counts[r.d][r.b] += r["count"]
    total = sum(sizes.values())
    return names, [[math.log(c / sum(counts[n])) for c in counts[n]] + [math.log(sizes[n] / total)] for n in names]


def posteriors(docs: DataFrame, names: list[str], weights: list[list[float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, tokens, p): tokens (words) and domain posteriors of every document.

    Words are exploded and summed within the task that read them; one small row
    for each document is shuffled. A text without words has the prior.
    """
    base = _exploded(docs, text, row=row_key(key, text), doc_id=F.col(key).cast("long"))
    sums = [F.sum(F.get(F.lit([*w[:BUCKETS], 0.0]), F.col("b"))).alias(f"l{i}") for i, w in enumerate(weights)]
    got = base.groupBy("row", "doc_id").agg(F.sum((F.col("b") < BUCKETS).cast("long")).alias("tokens"), *sums)
    share = F.least(F.lit(1.0), EVIDENCE / F.greatest(F.col("tokens"), F.lit(1)))
    logs = F.array(*[F.col(f"l{i}") * share + F.lit(w[BUCKETS]) for i, w in enumerate(weights)])
    top = got.select("row", "doc_id", "tokens", logs.alias("l")).withColumn("m", F.array_max("l"))
    e = top.select("row", "doc_id", "tokens", F.transform("l", lambda x: F.exp(x - F.col("m"))).alias("e"))
    return e.select("row", "doc_id", "tokens", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))").alias("p"))


def _dot(x: list[float], y: list[float]) -> float:
    return sum(a * b for a, b in zip(x, y, strict=True))


def _pull(steps: list[float]) -> Column:
    """p . l of a document."""
    return sum((F.get("p", F.lit(i)) * F.lit(float(x)) for i, x in enumerate(steps)), F.lit(0.0))


def fit_rates(table: DataFrame, targets: list[float], ridge: float = RIDGE, rounds: int = ROUNDS, close: float = CLOSE, natural: list[float] | None = None, least: float = 0.0) -> tuple[Column, list[list[float]]]:
    """The rate as an expression over ``p`` of ``table`` (tokens, p), and the domain totals after each round (natural ones first).

    A domain without tokens takes no part. Raises ArithmeticError where
    ``rounds`` don't bring every domain within ``close`` of the minimum's condition.
    """
    n = len(targets)
    rate = lambda steps: F.greatest(F.lit(float(least)), F.lit(1.0) - _pull(steps))
    shares = [F.col("tokens") * F.get("p", F.lit(i)) for i in range(n)]

    def sums(*columns: Column) -> list[float]:
        return [float(x or 0.0) for x in table.agg(*[F.sum(c) for c in columns]).first()]

    natural = natural or sums(*shares)
    size, scale = max(sum(natural), 1.0), [math.sqrt(a) for a in natural]

    def at(point: list[float]) -> tuple[float, list[float], list[float]]:
        """Dual value and its gradient at scaled steps, and the totals there."""
        steps = [x / c if c else 0.0 for x, c in zip(point, scale, strict=True)]
        r = rate(steps)
        cost = F.col("tokens") * ((r - 1) * (r - 1) / 2 + r * _pull(steps))
        *totals, spent = sums(*[c * r for c in shares], cost)
        value = (-spent + _dot(targets, steps) + ridge / 2 * _dot(point, point)) / size
        down = [(ridge * x - (s - t) / c) / size if c else 0.0 for x, s, t, c in zip(point, totals, targets, scale, strict=True)]
        return value, down, totals

    def off(down: list[float]) -> float:
        return max((abs(g) * size / c for g, c in zip(down, scale, strict=True) if c), default=0.0)

    point, seen = [0.0] * n, [natural]
    value, down, totals = at(point)
    metric = [[size / (1 + ridge) if i == j else 0.0 for j in range(n)] for i in range(n)]
    while off(down) > close:
        way = [-_dot(row, down) for row in metric]
        slope, step, low, high = _dot(way, down), 1.0, 0.0, None
        for _ in range(40):  # a step that descends enough and flattens enough
            new = [x + step * w for x, w in zip(point, way, strict=True)]
            new_value, new_down, totals = at(new)
            seen.append(totals)
            if new_value > value + 1e-4 * step * slope + 1e-13 * abs(value):
                high = step
            elif _dot(way, new_down) < 0.5 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high else 2 * step
        if len(seen) > rounds:
            raise ArithmeticError(f"rates are {off(down):.2g} from their minimum after {rounds} rounds")
        moved, bent = [x - y for x, y in zip(new, point, strict=True)], [x - y for x, y in zip(new_down, down, strict=True)]
        point, value, down = new, new_value, new_down
        if (along := _dot(moved, bent)) > 0:
            turned = [_dot(row, bent) for row in metric]
            grow = 1 / along + _dot(bent, turned) / along**2
            metric = [[m + grow * moved[i] * moved[j] - (turned[i] * moved[j] + moved[i] * turned[j]) / along for j, m in enumerate(row)] for i, row in enumerate(metric)]
    return rate([x / c if c else 0.0 for x, c in zip(point, scale, strict=True)]), seen


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None) -> DataFrame:
    """(row, doc_id, tokens, domain, posterior, rate, copies) of every document.

    ``labelled`` (doc_id, domain) marks some of them; ``weights``: the share of tokens each domain
    is to have (any scale; domains without a weight get none; weights of unknown
    domains don't count). ``total``: tokens of the mix; by default the least at
    which no domain is cut, and rates are then projected to at least 1, so that
    nothing is thrown away. ``copies`` is the
    rate rounded up or down by a hash of the row, so that its mean is the rate.
    Rows equal in id and text are one document here and appear once. Null and
    empty texts have no tokens, the prior as posterior and the rate that fits
    it. Without labelled rows, or without weights of theirs, every rate is 1.
    """
    names, model = classifier(docs, labelled, key, text)
    if not names:
        names, model = [""], [[0.0] * BUCKETS + [0.0]]
    table = checkpoint(posteriors(docs, names, model, key, text))
    natural = [float(x or 0.0) for x in table.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(len(names))]).first()]
    share = [max(0.0, weights.get(n, 0.0)) for n in names]
    if sum(share) and sum(natural):
        share = [x / sum(share) for x in share]
        size = total if total is not None else max((a / w for a, w in zip(natural, share, strict=True) if w), default=sum(natural))
        rate, _ = fit_rates(table, [w * size for w in share], natural=natural, least=0.0 if total is not None else 1.0)
    else:
        rate = F.lit(1.0)
    out = table.withColumn("rate", rate)
    unit = F.pmod(F.xxhash64("row", F.lit("round")), F.lit(1 << 32)) / float(1 << 32)
    best = F.get(F.lit(names), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    copies = F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("int")
    return out.select("row", "doc_id", "tokens", best.alias("domain"), F.col("p").alias("posterior"), "rate", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None) -> DataFrame:
    """``docs`` with every row repeated as its document's copies say; the columns of ``docs``."""
    own = with_cleared(docs, "__bl_row", "__bl_copies", "__bl_n")
    found = rates(own, labelled, weights, key, text, total).select(F.col("row").alias("__bl_row"), F.col("copies").alias("__bl_copies"))
    joined = own.withColumn("__bl_row", row_key(key, text)).join(found, "__bl_row").where("__bl_copies > 0")
    return joined.withColumn("__bl_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__bl_copies")))).select(*docs.columns)

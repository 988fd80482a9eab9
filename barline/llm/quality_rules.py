"""Risk-controlled quality rules, with DataFrame and SQL functions only.

Fixed base rules reject first. Then, in each stratum (a language), each of a
few statistics gets an upper cutoff from a fixed ladder. A labelled holdout
tells how many good documents a cutoff would reject; the cutoff is allowed if an
exact binomial test rejects "it falsely rejects more than ``risk`` of the good
documents" at level ``delta``, divided by all tests made (Bonferroni: strata x
statistics), while the ladder of one statistic is walked from its loosest rung
and stops at the first that fails (fixed-sequence testing keeps the level). The
risk is divided by the statistics, so that a stratum's rules together reject at
most ``risk`` of its good documents, with probability 1 - delta over everything.
All allowed cutoffs hold this at once, so any of them may be taken: it is the
one with the greatest gain, bad documents rejected less ``COST`` times the good
ones, the loosest of equals, and none where no gain is positive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import WORD, checkpoint, with_cleared

MIN_WORDS, REPEAT_PERCENT, SYMBOLS, BLANK = 10, 20, "#*$%&|<>", r"[\x20\x09-\x0D]"
RISK, DELTA, COST = 0.02, 0.05, 10
#: Statistic, as whole parts of a thousand, and its ladder from the loosest cutoff to the tightest.
LADDERS = {
    "symbol_pm": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_line_pm": "1000 * n_dup_lines div greatest(n_words, 1)",
    "repeat_pm": "1000 * n_repeat_words div greatest(n_words, 1)",
    "char_pm": "100 * word_chars div greatest(n_words, 1)",
}
RUNGS = {
    "symbol_pm": [5000, 3000, 2000, 1500, 1000, 700, 450, 300, 200, 100],
    "dup_line_pm": [500, 300, 200, 150, 100, 80, 60, 40, 30, 20],
    "repeat_pm": [190, 170, 150, 130, 110, 90, 70, 50, 35, 20],
    "char_pm": [2000, 1600, 1400, 1200, 1100, 1000, 950, 900, 850, 800],
}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f over a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text has no words. Windows of five words are compared by a 64-bit
    hash chained over the words. Nothing is shuffled: everything happens within
    a row, so a very long text costs its own length (and its logarithm) only.
    """
    own = with_cleared(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "__bl_s")
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"{BLANK}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        at = lambda i, k: F.get(w, i + k)
        hashed = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.struct(F.xxhash64(*[at(i, k) for k in range(5)]).alias("h"), i.alias("i")))

        def found(s: Column) -> Column:  # starts of windows that occur twice or more, in order
            twice = F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), ((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])).alias("d"))), lambda x: x["d"])
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        covered = lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - i, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(n < 6, F.lit(0).cast("long")).otherwise(_let(F.sort_array(hashed), lambda s: _let(found(s), covered)))

    stats = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).alias("n_repeat_words")))
    out = own.withColumn("__bl_s", stats).withColumns({
        "n_words": F.col("__bl_s.n_words"),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(BLANK))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("__bl_s.n_repeat_words"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).drop("__bl_s")


def thresholds(labelled: DataFrame, stratum: str = "lang", good: str = "quality", risk: float = RISK, delta: float = DELTA, strata: int | None = None) -> DataFrame:
    """(stratum, statistic, cutoff) of the cutoffs taken; no row where none is.

    ``labelled``: rows of ``statistics`` with a 0/1 label; only documents that
    pass the base rules count. Counts are combined before the shuffle and the
    table that leaves is at most strata x statistics rows.
    """
    pairs = [(k, v, i) for k in LADDERS for i, v in enumerate(RUNGS[k])]
    is_good = F.col("_good")
    rows = labelled.where("not base_failed").select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), (F.col(good) == 1).alias("_good"), *[F.expr(e).alias(k) for k, e in LADDERS.items()])
    over = lambda k, v, who: F.count(F.when(who & (F.col(k) > v), 1))
    counted = checkpoint(rows.groupBy("stratum").agg(F.count(F.when(is_good, 1)).alias("n"), *[over(k, v, is_good).alias(f"{k}_{i}") for k, v, i in pairs], *[over(k, v, ~is_good).alias(f"bad_{k}_{i}") for k, v, i in pairs]))
    n_strata = strata if strata is not None else counted.count()
    level = delta / max(1, n_strata * len(LADDERS))
    share = risk / len(LADDERS)
    rungs = F.array(*[F.struct(F.lit(k).alias("statistic"), F.lit(v).cast("long").alias("cutoff"), F.lit(i).alias("rung"), F.col(f"{k}_{i}").alias("k"), F.col(f"bad_{k}_{i}").alias("bad")) for k, v, i in pairs])
    tests = counted.select("stratum", "n", F.explode(rungs).alias("r")).select("stratum", "n", "r.*")
    walk = Window.partitionBy("stratum", "statistic").orderBy("rung")
    allowed = tests.withColumn("ok", F.min((F.col("k") <= share * F.col("n")).cast("int") * (binomial_tail("n", "k", share) <= level).cast("int")).over(walk)).where("ok = 1")
    gain = (F.col("bad") - COST * F.col("k")).alias("gain")
    best = allowed.groupBy("stratum", "statistic").agg(F.max(F.struct(gain, (-F.col("rung")).alias("loose"), "cutoff")).alias("b"))
    return best.where("b.gain > 0").select("stratum", "statistic", F.col("b.cutoff").alias("cutoff"))


def binomial_tail(n: str, k: str, share: float) -> Column:
    """P(Bin(n, share) <= k), summed exactly for k up to the mean (beyond it: 1), each term from the one before."""
    base = F.col(n) * F.log(F.lit(1 - share))
    term = lambda t, j: t + F.log((F.col(n) - j + 1) / j * F.lit(share / (1 - share)))
    steps = F.when((F.col(k) > 0) & (F.col(k) <= share * F.col(n)), F.sequence(F.lit(1).cast("long"), F.col(k))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, F.struct(base.alias("t"), F.exp(base).alias("s")), lambda a, j: _let(term(a["t"], j), lambda t: F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))), lambda a: a["s"])
    return F.when(F.col(k) > share * F.col(n), F.lit(1.0)).otherwise(tail)


def row_key(key: str, text: str, stratum: str) -> Column:
    """Tells rows apart; rows equal in all three are judged alike anyway."""
    return F.xxhash64(F.col(key).cast("string"), F.col(text), F.col(stratum).cast("string"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(row, doc_id, stratum, the statistics, base_failed, kept), a row for each row of ``docs``.

    ``labels`` (doc_id, quality) is the holdout. A null label or id, or an id
    without a document, doesn't count; a document whose id occurs several times
    counts as often as rows match. A null stratum and an empty one are the
    same. A stratum without enough good labels has no cutoffs and loses only what the
    base rules reject. Repeated rows are judged alike; an empty table gives an
    empty result. Texts are read once: what goes on is a small row for each.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("text"), row_key(key, text, stratum).alias("row"))
    stats = checkpoint(statistics(own).drop("text"))
    marks = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").alias("_label")).distinct()
    held = stats.join(marks, "doc_id")
    cuts = thresholds(held, "stratum", "_label", risk, delta).collect()  # at most strata x statistics
    kept = ~F.col("base_failed")
    for k, e in LADDERS.items():  # one lookup for each statistic, however many strata there are
        if by := [F.lit(x) for r in sorted(cuts) if r.statistic == k for x in (r.stratum, r.cutoff)]:
            kept = kept & ~F.coalesce(F.expr(e) > F.try_element_at(F.create_map(*by), F.col("stratum")), F.lit(False))
    return stats.withColumn("kept", kept)


def reject(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    own = with_cleared(docs, "__bl_row")
    out = judge(own, labels, key, text, stratum).where("not kept").select(F.col("row").alias("__bl_row")).distinct()
    return own.withColumn("__bl_row", row_key(key, text, stratum)).join(out, "__bl_row", "left_anti").select(*docs.columns)


def oracle() -> str:
    """The same verdicts in DuckDB SQL, over ``documents`` and ``labels``."""
    ladder = {k: e.replace(" div ", " // ") for k, e in LADDERS.items()}
    rungs = ", ".join(f"('{k}', {i}, {v})" for k in LADDERS for i, v in enumerate(RUNGS[k]))
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, quality, '{k}' AS statistic, {e} AS value FROM held" for k, e in ladder.items())
    over = " OR ".join(f"(c.statistic = '{k}' AND {e} > c.cutoff)" for k, e in ladder.items())
    share = RISK / len(LADDERS)
    return f"""
        WITH w AS (
          SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
                 regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ), g AS (
          SELECT doc_id, i, words[i:i + 4] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
        ), d AS (
          SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
        ), covered AS (
          SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM d) GROUP BY doc_id
        ), s AS (
          SELECT w.doc_id, stratum, len(words) AS n_words,
                 CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
                   - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
                 coalesce(covered.n, 0) AS n_repeat_words
          FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
        ), b AS (
          SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM s
        ), held AS (
          SELECT b.*, quality FROM b JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IS NOT NULL) l ON b.doc_id = l.doc_id WHERE NOT base_failed
        ), v AS ({values}
        ), sizes AS (
          SELECT stratum, count(*) FILTER (quality = 1) AS n FROM held GROUP BY stratum
        ), t AS (
          SELECT v.stratum, v.statistic, r.rung, r.cutoff, any_value(n) AS n,
                 count(*) FILTER (quality = 1 AND value > cutoff) AS k, count(*) FILTER (quality <> 1 AND value > cutoff) AS bad
          FROM v JOIN (VALUES {rungs}) r(statistic, rung, cutoff) ON v.statistic = r.statistic JOIN sizes ON v.stratum = sizes.stratum
          GROUP BY ALL
        ), p AS (
          SELECT *, k <= {share} * n AND list_sum(list_transform(range(0, CAST(least(k, {share} * n) AS BIGINT) + 1),
              lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({share}) + (n - j) * ln(1 - {share}))))
            <= {DELTA} / (greatest(1, (SELECT count(*) FROM sizes)) * {len(LADDERS)}) AS passed FROM t
        ), ok AS (
          SELECT *, bool_and(passed) OVER (PARTITION BY stratum, statistic ORDER BY rung) AS allowed FROM p
        ), cuts AS (
          SELECT stratum, statistic, arg_max(cutoff, (bad - {COST} * k) * 1000 - rung) AS cutoff FROM ok
          WHERE allowed GROUP BY ALL HAVING max(bad - {COST} * k) > 0
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT EXISTS (SELECT 1 FROM cuts c WHERE c.stratum = b.stratum AND ({over})) AS kept
        FROM b"""

"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import quality_rules
from barline.llm.common import table


#: Share of tokens that each domain, a language, is to have in the mix.
MIX_WEIGHTS = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the labelled documents, with their language as domain."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.substring import deduplicate

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), extend=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.quality_rules import judge

    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barline.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barline.llm.token_io import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.licenses import ALL_TEMPLATES, scan

    return scan(table(spark, sf_dir, "documents"), ALL_TEMPLATES)


def op4_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.maxscore import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.quality_gbt import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.mixing import rates

    docs = table(spark, sf_dir, "documents")
    return rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), MIX_WEIGHTS)


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.ngram_lm import score

    return score(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.secret_scan import joined, scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barline.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"), least=10, top=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_substring_dedup, op3_license_scan, op4_maxscore_topk, op5_quality_rules, op6_byte_bpe, op7_mixing, op8_ngram_lm, op9_token_files, op10_quality_gbt,
        op11_secret_scan, op12_lexical_search, op13_source_divergence,
    )
}
ORACLES = {
    "op5_quality_rules": quality_rules.oracle(),
    "op4_maxscore_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_lexical_search": r"""
        WITH w AS (
          SELECT d, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM (SELECT row_number() OVER () AS d, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
        ), tf AS (
          SELECT d, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM w GROUP BY d, term
        ), sizes AS (
          SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY d
        ), totals AS (
          SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
        ), weights AS (
          SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs
        ), asked AS (
          SELECT i, any_value(item_id) AS item_id, term, count(*) AS times FROM (
            SELECT i, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS i, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark)
          ) GROUP BY i, term
        ), scored AS (
          SELECT i, any_value(a.item_id) AS item_id, tf.d, any_value(tf.doc_id) AS doc_id,
                 CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
          FROM asked a JOIN tf ON tf.term = a.term JOIN weights v ON v.term = a.term JOIN sizes s ON s.d = tf.d, totals
          GROUP BY i, tf.d
        ), ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op13_source_divergence": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), w AS (
          SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ), kept AS (
          SELECT lang, term, count(*) AS lang_count FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= 10
        ), c AS (
          SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL
        ), l AS (
          SELECT lang, count(*) AS v, CAST(sum(lang_count) AS HUGEINT) AS total FROM kept GROUP BY lang
        ), g AS (
          SELECT q.lang, q.source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce((SELECT CAST(sum(n) AS HUGEINT) FROM c WHERE c.lang = q.lang AND c.source = q.source), 0) AS total
          FROM (SELECT DISTINCT lang, source FROM docs) q LEFT JOIN l ON l.lang = q.lang
        ), p AS (
          SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
                 1 + (CAST(1000000000 AS HUGEINT) * (k.lang_count + 2)) // (g.lang_total + 2 * g.v) AS q
          FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), pair AS (
          SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), parts AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
        ), ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
}

"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result of
one is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import bpe, mixing, quality_rules, simhash, substring
from barline.llm.common import new_folder, table
from barline.llm.queries import MIX_WEIGHTS, labelled_domains


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    return quality_rules.reject(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of all documents but the first; ``n_chars`` follows the text."""
    out = substring.deduplicate(docs, extend=True)
    if "n_chars" in docs.columns:
        cut = F.size("removed_spans") > 0
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the languages' token totals meet their weights; none is dropped."""
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), MIX_WEIGHTS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, checked by decoding."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", rules), ("simhash_near_dedup", near_dedup), ("substring_dedup", passages), ("mixing", mix), ("byte_bpe", token_ids)]

#: Fingerprint links, projected gradients and byte-pair merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; stage tables go to the shared folder."""
    docs, base = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

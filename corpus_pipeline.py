"""A training-corpus pipeline: each stage is one operator, written as Parquet before the next reads it.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``docs`` with the stage's decisions applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import decontaminate, langid, lexicon, linededup, minhash
from lanternflow.llm.common import bounded_batches, durable, table
from lanternflow.llm.queries import tokenizer_path


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, with ``n_chars`` counted anew if there is one."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or text, for which no language can be told.

    The classifier learns from the labelled documents; ``lang`` becomes the predicted language.
    """
    bounded_batches(spark)
    model = langid.fit_languages(docs)
    told = langid.identify(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN)
    return _same_columns(told.withColumn("lang", F.col("lang_pred")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out repeated passages; documents of which nothing is left go."""
    bounded_batches(spark)
    left = linededup.dedup_lines(docs)
    return _same_columns(left.filter("NOT (lines_removed > 0 AND trim(text) = '')"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, 0.8)."""
    bounded_batches(spark)
    kept = minhash.near_duplicates(docs, percent=80).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return _same_columns(docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.filter("n_hit = 0").select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left: doc_id, number of tokens, and digests of ids and decoded text."""
    bounded_batches(spark)
    return lexicon.encoding_digest(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

# Language models, rolling hashes and merges have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A cleaning run over ``documents`` made of the corpus operators.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchloom.llm import byte_bpe, decontaminate, language, ngram_join, surrogates
from patchloom.llm.tools import stored, table, unused

# Stands in for a secret that a deployment would pass in.
SURROGATE_KEY = "change-me"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    known = language.samples(docs.filter(~F.coalesce(language.held_out(), F.lit(False))), "text", "lang", "doc_id")
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    return language.predict(docs, known, lang_col=lang, score_col=score).filter(F.col(lang) != language.UNKNOWN).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of the documents linked by 0.8 of their five-word runs: the smallest id
    (null ids last), of its texts the one with the smallest digest, and of equal rows one.
    Rows without words are not linked to any other and stay."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    # a row's own identity: an id can occur with several texts
    named = stored(docs.select("*", F.monotonically_increasing_id().alias("_row"), digest.alias("_digest")), "named")
    found = ngram_join.similar_components(named, width=5, percent=80, id_col="_row").filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_digest", "_row")
    grouped = named.join(found.select("_row", "component_id"), "_row")
    first = grouped.groupBy("component_id").agg(F.min(order).getField("_row").alias("_first"))
    gone = grouped.join(first, "component_id").filter("_row != _first").select("_row")
    return named.join(gone, "_row", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; ``n_chars`` follows the text."""
    done = surrogates.replace(docs, SURROGATE_KEY, count_col="_replaced")
    length = F.when(F.col("_replaced") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every remaining text."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language), ("ngram_join", one_of_each_group), ("decontaminate", without_benchmark),
    ("surrogates", without_personal_data), ("byte_bpe", encode)]

# Language ID and the surrogates of personal data have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

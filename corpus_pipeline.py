"""A training-data pipeline over documents: language ID, line dedup, near-duplicate join, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrack.llm import bpe, jaccard, language, lines, mixing
from gridtrack.llm.common import fresh, materialize, tune

#: A document goes if no language was found or the best one has less than this share against the others.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; models are fitted on this input's own labelled rows.

    Null, empty and letterless texts go, as does a text whose best language has under ``LEAST_SCORE`` of the share. If
    nothing could be learned, every text with a letter stays. Repeated rows are judged alike; an empty table stays empty.
    """
    tune(spark)
    trees = language.fit(docs)
    if not trees.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = fresh(docs.columns, "lang_pred", "score")
    out = language.identify(docs, trees, names=tuple(names))
    return out.where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; n_chars is the new length.

    All rows stay, null and empty texts and repeated rows too; a document of nothing but such lines stays whole.
    """
    tune(spark)
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least doc_id, nulls last.

    Rows without words are in no group and all stay; rows that repeat are one group; very long texts count whole.
    """
    tune(spark)
    return jaccard.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a mix of sources: one row per document and pass, with the words taken.

    Documents without words are in no mix; a null source is a source; repeated rows are mixed separately.
    """
    tune(spark)
    return mixing.Mix(docs).documents(n_chars="n_chars").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE digests of every text, whole; a null text is empty. A row each, repeated rows too."""
    tune(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]
#: Trees of byte contexts, permutations and BPE are beyond SQL; tests hold each stage against a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

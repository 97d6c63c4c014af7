"""The corpus pipeline: quality, language, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.  Rows with a null text are kept by no filter that
judges text: quality scores them as empty, and language ID rejects them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import langid, linededup, ngramjoin, packing, quality
from marlstone.llm.runtime import free_names, held_out, table, through_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as of quality 1."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = free_names(docs, "score", "predicted")
    return quality.predict(docs, model, (score, predicted)).filter(F.col(predicted) == 1).drop(score, predicted)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages; those far from all centroids, or without a letter, go."""
    names = free_names(docs, "lang_pred", "score", "rejected")
    return langid.predict(docs, langid.fit(docs, ~held_out()), tuple(names)).filter(~F.col(names[-1])).drop(*names)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; a document left without text goes. n_chars follows the text."""
    lines, exact, near = names = free_names(docs, "n_lines", "n_exact", "n_near")
    cleaned = linededup.dedup(docs, names=tuple(names)).filter((F.col("text") != "") | (F.col(lines) == 0) | (F.col(exact) + F.col(near) == 0))
    return cleaned.select(*(F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, Jaccard of 0.8 or more."""
    return ngramjoin.keep_one(docs, width=5, per_cent=80)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added_tokens=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("line dedup", line_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", sequences),
]

#: Two stages are learnt models and one is a tokenizer: no SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = through_table(docs, f"stage-{k}")
    return docs

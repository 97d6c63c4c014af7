"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, codes, importance, langid, licenses, linededup, media, ngramjoin, packing, quality, sql, suffixes, topk, urlfilter
from marlstone.llm.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("query")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"), width=4, per_cent=85)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document that its path numbers, so that document's labels are the page's outcome."""
    bad = F.greatest(F.col("quality") == 0, F.col("toxic") == 1).cast("int")
    return urlfilter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), bad.alias("bad")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added_tokens=True)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(table(spark, sf_dir, "documents")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks, _ = codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "label")
    out = codes.with_label_error(coded)
    return out.select("vec_id", codes.hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(codes.digest(codebooks)).alias("codebooks_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return cut.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_top_k": op1_exact_top_k,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_url_filter": op3_url_filter,
        "op4_line_dedup": op4_line_dedup,
        "op5_bpe_codec": op5_bpe_codec,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_license_scan": op8_license_scan,
        "op9_language_id": op9_language_id,
        "op10_media_columns": op10_media_columns,
        "op11_vector_codes": op11_vector_codes,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_suffix_array_dedup": op13_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": sql.OP1, "op2_ngram_jaccard_join": sql.OP2, "op3_url_filter": sql.OP3, "op4_line_dedup": sql.OP4, "op8_license_scan": sql.op8(), "op11_vector_codes": sql.op11(), "op12_importance_resampling": sql.OP12, "op13_suffix_array_dedup": sql.OP13}

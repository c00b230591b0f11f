"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, line_quality, lm_score, mixing, packing, simhash, span_dedup, toxicity, url_filter
from ._common import fold, table
from .sql import ORACLES  # noqa: F401

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _held(key: str, n: int, k: int):
    return F.coalesce(fold(key, n) == k, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.trained(docs, labels, fit_rows=fold("doc_id", 5) != 0)
    out = toxicity.score(docs.select("doc_id", "text"), model).select("row.doc_id", "score", "guessed")
    return out.select("doc_id", _held("doc_id", 5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "guessed")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.learn(docs, fold("doc_id", 4) != 2)
    out = langid.predict(docs.select("doc_id", "text"), learned)
    return out.select("row.doc_id", "lang_pred", "score", "rejected").select("doc_id", _held("doc_id", 4, 2), "lang_pred", "score", "rejected")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import id_type

    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return packing.digests(pieces, id_type(TOKENIZER).itemsize)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm_score.score(docs, fold("doc_id", 10) != 0)
    return out.select("doc_id", _held("doc_id", 10, 0), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "text", "n_sentences", "n_removed")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_langid, op3_line_quality, op4_packing, op5_lm_score, op6_url_filter, op7_simhash, op8_ann, op9_span_dedup, op10_mixing)}

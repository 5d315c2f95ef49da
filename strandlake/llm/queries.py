"""Registered queries of the corpus operators: op<N>_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.bpe import encode_documents
from strandlake.llm import decontam, embedding_dedup, fill_middle, filter_audit, html_template, langid_ppm, minhash_join, pitman_yor, quality_nbsvm, secret_scan, substring_dedup, token_rollup
from strandlake.llm.spark_io import crc_mod, shared_dir, table, tuned


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(tuned(spark), sf_dir, "documents"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a corpus's batches, each sent twice."""
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    history = token_rollup.corpus_history(table(spark, sf_dir, "documents"))
    for name, changes in [*history, *history]:
        rollup.commit(name, changes)
    return rollup.totals()


def op2_bpe_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a tokenizer's tokens."""
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    history = token_rollup.bpe_history(table(tuned(spark), sf_dir, "documents"))
    for name, changes in [*history, *history]:
        rollup.commit(name, changes)
    rollup.compact()
    return rollup.totals()


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(tuned(spark), sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by document and benchmark item found in it; clean documents have none."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(tuned(spark), sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by document that repeats an earlier passage: its spans, and the text without them."""
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    spans = substring_dedup.durable(substring_dedup.repeated_spans(docs), "spans")
    found = substring_dedup.cut(docs, spans, how="inner", keep="spans")
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["n_words"])
    return found.select("doc_id", F.size("spans").alias("n_spans"), words.alias("removed_words"), "spans", "text")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(tuned(spark), sf_dir, "documents"), width=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_nbsvm.fit(docs, labels.where(crc_mod("doc_id", 3) != 1).select("doc_id", "quality"))
    out = quality_nbsvm.score(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    out = pitman_yor.score(docs, crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    model = langid_ppm.fit(docs.where(crc_mod("doc_id", 4) != 2))
    out = langid_ppm.predict(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.col("code_bits"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.marked(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(tuned(spark), sf_dir, "documents")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.arrange(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_token_rollup": token_rollup.ORACLE, "op4_decontaminate": decontam.oracle(), "op11_filter_audit": filter_audit.ORACLE, "op13_fill_middle": fill_middle.ORACLE}

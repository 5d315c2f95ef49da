"""From raw documents to encoded training text: the stages in order, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, extra
ones included. Between stages the rows are written to the shared folder as Parquet and read again. In every stage an empty
table gives an empty result, texts of any length are worked on whole, and rows that repeat are treated alike; what a null
does is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontam, langid_ppm, minhash_join, substring_dedup
from strandlake.llm.bpe import encode_documents
from strandlake.llm.spark_io import durable, table, tuned


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those with a null text or one without letters go. Learns from the labelled
    rows it is given, whose text and lang are not null; without any such row nothing can be told and all go."""
    tuned(spark)
    out = langid_ppm.predict(docs, langid_ppm.fit(docs), keep=[c for c in docs.columns if c not in ("doc_id",)])
    return out.where(F.col("lang_pred") != langid_ppm.UNKNOWN).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the least id. Null or
    wordless texts and null ids are near copies of nothing and stay; rows that repeat an id stay together."""
    found = minhash_join.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that occur before in the corpus; n_chars follows the text. Null texts stay null
    (and their n_chars), a text that is all repetition becomes empty and its document stays."""
    return substring_dedup.deduplicate(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; a document without id is not looked at."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids (little-endian unsigned 32-bit numbers), how many, and digests of the ids and of the decoded
    text. A null text is empty. Workers that served the stages before remember less here than in a run of its own."""
    return encode_documents(docs, with_ids=True, cache_bytes=24 << 20)


STAGES = [("language_id", language), ("minhash_near_dedup", near_dedup), ("substring_dedup", repeated_passages), ("decontamination", decontaminate), ("bpe", encode)]

#: Language models, MinHash and merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

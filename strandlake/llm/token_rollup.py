"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes is rolled up to one row by group (sum of signed documents and tokens), written under a name of its
own, and committed by one row in the log. Totals are the sum over committed batches. A batch id that is in the log is
not applied again, and a write that never reached the log is not read, so a batch may be sent any number of times.
compact() adds the committed batches up under one log entry that covers them; their ids stay known. Compactions may run
at once: each lists the batches that it covers, and where two cover the same batch only one of them counts, so that every
batch counts once. A batch that two writers log at once counts once, too.

Changes are rows (op, source, lang, tokenizer, n_tokens, old_tokens): 'insert' adds a document, 'delete' takes one
away, 'revise' replaces old_tokens by n_tokens. Tokenizer names a tokenizer's version: bpe_changes() counts by a
vocabulary file, corpus_history() by two rules that SQL can check. Null sources and languages are groups of their own;
null counts are 0; other ops are an error; an empty batch commits and changes nothing. Totals may be negative where
deletes precede inserts. Repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.bpe import encode_documents
from strandlake.llm.spark_io import durable, join_counted, shared_dir

GROUP = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


def count_words(text: Column) -> Column:
    """Runs without the bytes 0x20 and 0x09-0x0D; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))


def count_terms(text: Column) -> Column:
    """Runs of letters and digits; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), ""))


class TokenRollup:
    """Additive totals under a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame | None:
        """(batch_id, folder, covers): a row by batch; of a compaction, one by batch that it covers."""
        try:
            return self.spark.read.schema("batch_id string, folder string, covers string").parquet(f"{self.path}/log/*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _batches(self, log: DataFrame) -> DataFrame:
        """(batch_id, folder) of the batches, one folder each."""
        return log.where("covers is null").groupBy("batch_id").agg(F.min("folder").alias("folder"))

    def _compactions(self, log: DataFrame) -> DataFrame:
        """(batch_id, folder, covers) of the compactions that count: those that for each batch they cover are the largest
        that does, by the number of batches and then by name. No two of them cover the same batch."""
        every = log.where("covers is not null")
        one = every.join(every.groupBy("batch_id").agg(F.min("folder").alias("folder"), F.countDistinct("covers").alias("size")), ["batch_id", "folder"]).distinct()
        best = one.groupBy("covers").agg(F.max_by("batch_id", F.struct("size", "batch_id")).alias("best"))
        lost = one.join(best, "covers").where("batch_id != best").select("batch_id")
        return one.join(lost, "batch_id", "left_anti").select("batch_id", "folder", "covers")

    def _active(self, log: DataFrame) -> DataFrame:
        """(batch_id, folder) of the entries that make up the totals."""
        compactions = self._compactions(log)
        left = self._batches(log).join(compactions.select(F.col("covers").alias("batch_id")), "batch_id", "left_anti")
        return left.unionByName(compactions.select("batch_id", "folder").distinct())

    def _deltas(self, log: DataFrame) -> DataFrame:
        """Rows of the active entries; what never reached the log is read over."""
        every = self.spark.read.schema(DELTAS).parquet(f"{self.path}/data/*")
        folder = F.concat(F.lit("data/"), F.element_at(F.split("_metadata.file_path", "/"), -2))
        return every.withColumn("folder", folder).join(self._active(log).select("folder"), "folder", "left_semi").drop("folder")

    def committed(self, batch_id: str) -> bool:
        log = self._log()
        return log is not None and not log.where(F.col("batch_id") == batch_id).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies the batch once; False if it was applied before."""
        if self.committed(batch_id):
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
        op = F.col("op")
        known = F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - old).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))))
        docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
        rolled = changes.select(*GROUP, docs.alias("d"), known.alias("t")).groupBy(*GROUP).agg(F.sum("d").cast("long").alias("d_docs"), F.sum("t").alias("d_tokens"))
        self._write(batch_id, rolled, self.spark.createDataFrame([(None,)], "covers string"))
        return True

    def _write(self, batch_id: str, rows: DataFrame, covers: DataFrame) -> None:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        name = uuid.uuid5(uuid.NAMESPACE_URL, batch_id).hex  # the same batch always logs under the same name
        entry = covers.select(F.lit(batch_id).alias("batch_id"), F.lit(folder).alias("folder"), "covers")
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{name}")

    def compact(self) -> None:
        """Adds up what is committed so far under one entry; batches that are committed meanwhile stay beside it. The entry
        is named after what it covers, so that two compactions of the same batches are one."""
        log = self._log()
        if log is None:
            return
        log = durable(log, "log")  # one state of it for sums and covers
        rows = self._deltas(log).groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        covered = self._batches(log).select(F.col("batch_id").alias("covers"))
        n, x, y = covered.agg(F.count("*"), F.bit_xor(F.xxhash64("covers")), F.bit_xor(F.xxhash64("covers", F.lit(1)))).first()
        self._write(f"compaction {n} {x} {y}", rows, covered)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches."""
        log = self._log()
        deltas = self.spark.createDataFrame([], DELTAS) if log is None else self._deltas(log)
        return deltas.groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))


def bpe_changes(docs: DataFrame, op: str, path: str | None = None, version: str = "byte_bpe_50k/1") -> DataFrame:
    """Changes that insert or delete documents (doc_id, text, source, lang) with their tokens by a BPE vocabulary file."""
    counted = encode_documents(docs.select(F.struct("source", "lang").alias("g"), "text"), id_col="g", path=path)
    return counted.select(F.lit(op).alias("op"), "g.source", "g.lang", F.lit(version).alias("tokenizer"), "n_tokens", F.lit(0).alias("old_tokens"))


def bpe_history(docs: DataFrame, path: str | None = None, version: str = "byte_bpe_50k/1") -> list[tuple[str, DataFrame]]:
    """The same of a tokenizer's counts: all documents; exact copies (of a smaller id) deleted; documents in which a line
    comes again counted without its repeats. A text is encoded once, and once more without the lines that come again."""
    group = F.struct("doc_id", "source", "lang").alias("g")
    counted = encode_documents(docs.select(group, "text"), id_col="g", path=path)
    base = durable(counted.select("g.*", "n_tokens", F.unhex("ids_sha256").alias("digest")), "counts")
    first = base.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    placed = durable(join_counted(base, first, ["digest"], base.count()), "placed")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    once = docs.where(F.size(lines) != F.size(F.array_distinct(lines))).select(group, F.array_join(F.array_distinct(lines), "\n").alias("text"))
    once = durable(encode_documents(once, id_col="g", path=path).select("g.doc_id", F.col("n_tokens").alias("once")).groupBy("doc_id").agg(F.min("once").alias("once")), "once")
    again = placed.where("doc_id = first").dropDuplicates(["doc_id"]).join(once, "doc_id")
    changes = lambda df, op, n, old: df.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), F.col(n).alias("n_tokens"), old.alias("old_tokens"))
    return [("bpe", changes(base, "insert", "n_tokens", F.lit(0))), ("bpe copies", changes(placed.where("doc_id != first"), "delete", "n_tokens", F.lit(0))), ("bpe lines", changes(again, "revise", "once", F.col("n_tokens")))]


def corpus_history(docs: DataFrame) -> list[tuple[str, DataFrame]]:
    """Batches of a corpus's life: counted by words; counted by terms too; exact copies deleted; lines that come again
    in a document no longer counted as words. Each text is read once; the batches work on its counts and digest."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    once = F.when(F.size(lines) != F.size(F.array_distinct(lines)), count_words(F.array_join(F.array_distinct(lines), "\n")))
    base = durable(docs.select("doc_id", "source", "lang", F.unhex(F.sha2(text, 256)).alias("digest"), count_words(text).alias("words"), count_terms(text).alias("terms"), once.alias("once")), "counts")
    changes = lambda df, op, tokenizer, n, old=None: df.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(0)).alias("old_tokens"))
    first = base.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    placed = durable(join_counted(base, first, ["digest"], base.count()), "placed")
    copies, again = placed.where("doc_id != first"), placed.where("doc_id = first and once is not null")
    return [
        ("words", changes(base, "insert", "words/1", "words")),
        ("terms", changes(base, "insert", "terms/1", "terms")),
        ("copies", changes(copies, "delete", "words/1", "words").union(changes(copies, "delete", "terms/1", "terms"))),
        ("lines", changes(again, "revise", "words/1", "once", "words")),
    ]


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, source, lang, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
c as (select *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) as terms,
             len(regexp_extract_all(array_to_string(list_distinct(string_split(text, chr(10))), chr(10)), '[^\x20\x09-\x0D]+')) as once from d),
x as (select source, lang, 'words/1' as tokenizer, case when doc_id = first then 1 else 0 end as n, case when doc_id = first then once else 0 end as t from c
      union all select source, lang, 'terms/1', case when doc_id = first then 1 else 0 end, case when doc_id = first then terms else 0 end from c)
select source, lang, tokenizer, cast(sum(n) as bigint) as n_docs, cast(sum(t) as bigint) as n_tokens from x group by source, lang, tokenizer"""

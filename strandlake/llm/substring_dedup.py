"""Removal of passages that occur before in the corpus, by content-defined chunks.

A gear rolling hash runs over the words of a text (lower-cased A-Z, white space ignored): for each word the hash is
shifted by SHIFT bits and the word's own 64-bit value is added, so that after 64 / SHIFT words nothing of an earlier
word is left. A chunk begins before each word whose hash is the strict minimum among the RADIUS words on either side.
Only words of the text itself count, so equal texts have equal cuts. Cuts thus depend on nearby words only: after an
insertion they fall as before within a few words, and chunks have RADIUS + 1 words at least, but for those at either
end of a text. Runs without a minimum (one word over and over) are cut every LONGEST words.

Chunks are compared by a 96-bit digest of their words. The first occurrence by (document id, digest of the text, place)
stays. Adjoining repeated chunks form a span; spans of MIN_WORDS words or more are removed, shorter ones are chance and
stay. Spans belong to a row: its id and a 64-bit digest of its text.

Defined cases: null and empty texts have no chunks and stay as they are; a text that is one repetition becomes empty;
rows that repeat an id with another text are documents of their own, and so are several texts without id; equal rows are
one row's chunks each at the same place, so neither loses anything to the other; a null id sorts before all others; extra
columns of any name pass unchanged; texts of any length are cut whole; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.bytesets import Spans, U, mix, texts, word_hashes, words
from strandlake.llm.spark_io import durable, join_counted

SHIFT = 16
RADIUS = 4
LONGEST = 64
MIN_WORDS = 16
_WORDS = Spans(0x9FB21C651E98DF25)


def gear(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The rolling hash after each word, from the values of its text's words; place: of each word in its text."""
    out = h.copy()
    for k in range(1, 64 // SHIFT):
        out[k:] += np.where(place[k:] >= k, h[:-k] << U(SHIFT * k), U(0))
    return out


def chunk_starts(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Word places at which a chunk begins, over the texts whose words are offs[i]..offs[i+1]."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    g = mix(gear(h, place))
    least = np.ones(n, bool)
    for k in range(1, RADIUS + 1):
        apart = place[k:] < k  # words of two texts are not compared
        least[k:] &= (g[k:] < g[:-k]) | apart
        least[:-k] &= (g[:-k] < g[k:]) | apart
    least[offs[:-1][np.diff(offs) > 0]] = True
    at = np.flatnonzero(least)
    size = np.diff(np.append(at, n))
    pieces = -(-size // LONGEST)
    return np.repeat(at, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))


def row_digest(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text)


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d1, d2, id, row, at, n): digest, row (its id and the digest of its text), first word and number of words of each chunk."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(1)):
                w = words(t)
                h = word_hashes(t, w)
                start = chunk_starts(h, w.offs)
                end = np.append(start[1:], len(h))
                d = mix(_WORDS.hashes(h, start, end) + (end - start).astype(U))
                d2 = mix(_WORDS.hashes(mix(h), start, end))
                doc = np.searchsorted(w.offs, start, "right") - 1
                ids, row = (batch.column(c)[t.first : t.first + t.n].take(pa.array(doc)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d.view(np.int64)), pa.array((d2 >> U(32)).astype(np.uint32).view(np.int32)), ids, row, pa.array((start - w.offs[doc]).astype(np.int32)), pa.array((end - start).astype(np.int32))],
                    ["d1", "d2", "id", "row", "at", "n"],
                )

    return docs.where(docs[text_col].isNotNull()).select(docs[id_col], docs[text_col], row_digest(docs[text_col])).mapInArrow(run, f"d1 long, d2 int, id {kind}, row long, at int, n int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, row, spans): for each row with repeats its spans (start_word, n_words, first_id), in order; row as row_digest.

    Chunks are counted after map-side aggregation, so a digest that a third of the corpus holds is a few rows by then;
    the marks of such digests are joined back by broadcast, the others by a shuffle. Nothing is gathered beyond one document.
    """
    every = durable(chunks(docs, id_col, text_col), "chunks")
    first = every.groupBy("d1", "d2").agg(F.min(F.struct("id", "row", "at")).alias("first"), F.max(F.struct("id", "row", "at")).alias("last"), F.count("*").alias("copies")).where("not first <=> last")
    first = first.select("d1", "d2", "first", F.col("copies").alias("n"))
    marked = join_counted(every.withColumnRenamed("n", "words"), first, ["d1", "d2"], every.count()).where("not struct(id, row, at) <=> first")
    marked = marked.select("id", "row", "at", F.col("words").alias("n"), F.col("first.id").alias("first_id")).distinct()
    order = Window.partitionBy("id", "row").orderBy("at")
    run = F.sum(F.when(F.lag(F.col("at") + F.col("n")).over(order) == F.col("at"), 0).otherwise(1)).over(order)
    spans = marked.withColumn("run", run).groupBy("id", "row", "run").agg(F.min("at").alias("start_word"), F.sum("n").cast("int").alias("n_words"), F.min("first_id").alias("first_id"))
    return spans.where(F.col("n_words") >= min_words).groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("start_word", "n_words", "first_id"))).alias("spans")).withColumnRenamed("id", id_col)


def cut(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "left", keep: str | None = None) -> DataFrame:
    """The documents with their spans removed from the text; with how='inner' only those that have any.

    A span goes from its first word to the beginning of the word after it. Further columns of docs pass unchanged; the
    spans come behind them in a column named keep, if one is named.
    """
    own = uuid.uuid4().hex  # no column of docs is named like ours
    marks = spans.select(F.col(id_col).alias(f"id_{own}"), F.col("row").alias(f"row_{own}"), *([F.col("spans").alias(f"spans_{own}")] if keep else []), F.col("spans.start_word").alias(f"from_{own}"), F.col("spans.n_words").alias(f"n_{own}"))
    mine = docs[id_col].eqNullSafe(F.col(f"id_{own}")) & (row_digest(docs[text_col]) == F.col(f"row_{own}"))
    joined = docs.join(marks, mine, how).drop(f"id_{own}", f"row_{own}")
    if keep:
        joined = joined.withColumnRenamed(f"spans_{own}", keep).select(*docs.columns, keep, f"from_{own}", f"n_{own}")
    names = joined.columns[:-2]
    place = names.index(text_col)
    kinds = joined.select(names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, first, count = (batch.column(i) for i in (place, len(names), len(names) + 1))
            if first.null_count == len(batch):
                yield batch.select(names)
                continue
            out: list = []
            for t in texts(text):
                for i in range(t.n):
                    row = t.first + i
                    if not first[row].is_valid or not text[row].is_valid:
                        out.append(text[row].as_py())
                        continue
                    raw = text[row].as_py().encode()
                    w = words(next(texts(text[row : row + 1], len(raw) + 1)))
                    edge = np.append(w.start, len(raw))
                    parts, at = [], 0
                    for a, n in zip(first[row].as_py(), count[row].as_py(), strict=True):
                        parts.append(raw[at : edge[a]])
                        at = edge[a + n]
                    parts.append(raw[at:])
                    out.append(b"".join(parts).decode())
            columns = [batch.column(i) for i in range(len(names))]
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, kinds)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All documents, repeated passages removed from their texts."""
    return cut(docs, durable(repeated_spans(docs, id_col, text_col, min_words), "spans"), id_col, text_col)

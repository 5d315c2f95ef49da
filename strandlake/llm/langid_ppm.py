"""Language identification by prediction with partial matching.

Per language a context tree over bytes holds how often each byte followed each context of up to ORDER bytes. The
statistics are frozen after training. A byte seen after a context of total n with q distinct followers has probability
count / (n + q); the rest, q / (n + q), is the escape to the next shorter context, where bytes that the longer one would
have coded itself are excluded, so that each context's probabilities sum to one. The last resort is the uniform
distribution over the 256 bytes. A text's code length under a language is the exact sum of -log2 of these; the shortest
wins.

Bytes are those of the UTF-8 text; A-Z count as a-z, white space as one value, digits as another. Texts begin after white
space. The trees are sparse: sorted codes of the contexts that occurred, with the code lengths under all languages side by
side, so that a place of a text is looked up once for all languages, and again, one byte shorter, only where no language
knows the longer context.

Defined cases: null texts and texts without a letter get `und` and score 0; ties go to the first language in order;
repeated rows are repeated, extra columns are ignored unless asked for; a long text is worked on in bounded pieces; an
empty table gives an empty result; without any training row every text is `und`; repeated training rows count as often as
they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.bytesets import LOWER, SPACE, Texts, texts

ORDER = 3
UNKNOWN = "und"
#: Bound on the sample of labelled text a language is learned from, in bytes (about; rows are drawn by a hash of the text).
TRAIN_BYTES = 4_000_000
#: Code lengths gathered at a time, over places and languages.
CELLS = 1 << 21
SYMBOL = LOWER.copy()
SYMBOL[SPACE] = 0x20
SYMBOL[0x30:0x3A] = 0x30
BYTE = np.uint64(8)


def codes(t: Texts, order: int) -> np.ndarray:
    """For each byte the number whose base-256 digits are the order bytes before it and its own."""
    pad = np.repeat(np.arange(1, t.n + 1) * order, np.diff(t.offs))
    at = np.arange(len(t.data)) + pad
    line = np.full(len(t.data) + order * (t.n + 1), 0x20, np.uint8)
    line[at] = SYMBOL[t.data]
    code = np.zeros(len(line), np.uint64)
    for k in range(order, -1, -1):
        code <<= BYTE
        code[k:] |= line[: len(line) - k]
    return code[at]


def tail(code: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of codes."""
    return code & np.uint64((1 << 8 * n) - 1)


def find(codes_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x among sorted codes, and whether it is there."""
    if not len(codes_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(codes_, x), len(codes_) - 1)
    return at, codes_[at] == x


@dataclass
class Level:
    """Contexts of one length: codes (context and byte) with code lengths by language, contexts with escape lengths."""

    codes: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def tree(code: np.ndarray, count: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """One language: (codes, probabilities, contexts, escape factors) of contexts of 0..order bytes.

    A byte not seen after a context has its probability in the next shorter context times the escape factor.
    """
    counted = {order: (code, count)}
    for k in range(order - 1, -1, -1):  # drop the earliest byte
        above, n = counted[k + 1]
        shorter, to = np.unique(tail(above, k + 1), return_inverse=True)
        counted[k] = shorter, np.bincount(to, n, len(shorter))
    out: list = []
    for k in range(order + 1):
        own, n = counted[k]
        context, of = np.unique(own >> BYTE, return_inverse=True)
        total, followers = np.bincount(of, n, len(context)), np.bincount(of, minlength=len(context))
        low = out[-1][1][np.searchsorted(out[-1][0], tail(own, k))] if k else np.full(len(own), 1 / 256)
        rest = 1 - np.bincount(of, low, len(context))
        whole = rest < 1e-9  # nothing is left to escape to
        p = n / (total + np.where(whole, 0, followers))[of]
        factor = np.where(whole, 1.0, followers / (total + followers) / np.maximum(rest, 1e-9))
        out.append((own, p, context, factor))
    return out


@dataclass
class Model:
    """The frozen trees of all languages, merged level by level."""

    languages: list[str]
    levels: list[Level]
    order: int

    @classmethod
    def of(cls, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], order: int) -> Model:
        trees = [tree(code, n, order) for code, n in counts]
        levels: list[Level] = []
        for k in range(order + 1):
            every = np.unique(np.concatenate([t[k][0] for t in trees])) if trees else np.zeros(0, np.uint64)
            contexts = np.unique(np.concatenate([t[k][2] for t in trees])) if trees else np.zeros(0, np.uint64)
            escapes = np.zeros((len(contexts), len(trees)), np.float32)
            for i, t in enumerate(trees):
                escapes[np.searchsorted(contexts, t[k][2]), i] = -np.log2(t[k][3])
            if k:
                shorter = levels[-1].bits[np.searchsorted(levels[-1].codes, tail(every, k))]
            else:
                shorter = np.full((len(every), len(trees)), 8, np.float32)
            bits = shorter + escapes[np.searchsorted(contexts, every >> BYTE)]
            for i, t in enumerate(trees):
                bits[np.searchsorted(every, t[k][0]), i] = -np.log2(t[k][1])
            levels.append(Level(every, bits, contexts, escapes))
        return cls(languages, levels, order)

    def lengths(self, code: np.ndarray) -> np.ndarray:
        """Code length in bits of each place under each language."""
        at, there = find(self.levels[self.order].codes, code)
        out = self.levels[self.order].bits[at]
        todo = np.flatnonzero(~there)
        out[todo] = 0
        for k in range(self.order, -1, -1):
            if not len(todo):
                break
            level = self.levels[k]
            if k < self.order:
                at, there = find(level.codes, tail(code[todo], k + 1))
                out[todo[there]] += level.bits[at[there]]
                todo = todo[~there]
            at, there = find(level.contexts, tail(code[todo], k + 1) >> BYTE)
            out[todo[there]] += level.escapes[at[there]]
        out[todo] += 8
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_bytes: int = TRAIN_BYTES, order: int = ORDER) -> Model:
    """Learns from the labelled rows: one pass for sizes, one that counts contexts.

    What comes to the driver is bounded by train_bytes numbers a language, whatever the input.
    """
    if not 0 <= order <= 6:
        raise ValueError("order must be between 0 and 6")
    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text is not null and lang is not null and text != ''")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model.of([], [], order)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_bytes / sizes[k]))])
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    number = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for t in texts(batch.column(0)):
                of = lang[t.first : t.first + t.n]
                each, code = np.repeat(of, np.diff(t.offs)), codes(t, order)
                for i in np.unique(of).tolist():
                    seen, n = np.unique(code[each == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), i, np.int32)), pa.array(seen.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    got = picked.select("text", "lang").mapInArrow(count, "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    got = got.sort_values(["lang", "code"])
    lang, code, n = got["lang"].to_numpy(), got["code"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.float64)
    edge = np.searchsorted(lang, np.arange(len(langs) + 1))
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
    return Model.of([langs[i] for i, _, _ in pairs], [(code[a:b], n[a:b]) for _, a, b in pairs], order)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: id, the columns in keep, lang_pred, score (posterior under equal priors), code_bits.

    Each text is read once, where it lies; nothing is shuffled. The broadcast trees are bounded as fit() says, and each
    Python worker unpacks them once.
    """
    spark = docs.sparkSession
    keep = [id_col, *(keep or [])]
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        many = len(m.languages)
        names = np.array([*m.languages, UNKNOWN], object)
        step = max(1, CELLS // max(1, many))
        for batch in batches:
            column = batch.column(len(keep))
            rows = len(column)
            length = np.zeros((rows, max(1, many)))
            for t in texts(column, step) if many else ():
                code, of = codes(t, m.order), np.repeat(np.arange(t.first, t.first + t.n), np.diff(t.offs))
                for a in range(0, len(code), step):  # a long text comes in several pieces
                    bits, row = m.lengths(code[a : a + step]), of[a : a + step]
                    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    length[row[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.float64)
            best = length.argmin(axis=1)
            low = length[np.arange(rows), best]
            score = 1 / np.exp2(np.maximum(low[:, None] - length, -1000)).sum(axis=1)
            letter = pc.match_substring_regex(column.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False) & bool(many)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(names[np.where(letter, best, many)], pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(low)],
                [*keep, "lang_pred", "score", "code_bits"],
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, code_bits double"
    return docs.select(*[docs[c] for c in keep], docs[text_col]).mapInArrow(run, schema)

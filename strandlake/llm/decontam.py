"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become tokens: runs of letters and digits, lower-cased. An item counts as leaked if some WINDOW aligned tokens (the
whole item where it is shorter) agree in SHARE of their places at least. A fixed mask picks some places of a window, one
in every STRIDE, and ignores those between; the picked tokens are hashed. Where m places of a window may disagree, the
stride is m + 1: m substitutions spoil at most m of the m + 1 masks that begin at the window's first places, so that each
leak has a hit (a test enumerates all patterns). For 20 tokens that is every fifth token, four in all. Hashes of the
corpus are joined to those of the benchmark; a hit proposes an alignment of an item to a document, which is then verified
token by token.

Defined cases: null and empty texts and items have no tokens and match nothing; an item of fewer than five tokens must
stand in the document as it is; a document with fewer tokens than the window matches nothing; repeated rows give one row
by document and item, an empty table none; extra columns are ignored by leaks() and kept by clean(); a document
with a null id is not looked at by leaks() and stays in clean(); ties between windows go to the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.spark_io import durable

WINDOW = 20
SHARE = 0.8
#: Seeds of the benchmark up to which its side of the join is broadcast (about 40 bytes each); beyond, both are shuffled.
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: as a lambda's variable it is not copied into the places that use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mask(n: int) -> tuple[int, ...]:
    """The places picked in a window of an item of n tokens, counted from the first that is picked."""
    compared = min(n, WINDOW)
    least = next(k for k in range(compared + 1) if k >= compared * SHARE)
    stride = compared - least + 1
    return tuple(range(0, compared // stride * stride, stride))


def _mask_hashes(h: Column, picked: tuple[int, ...]) -> Column:
    """The hash of the picked tokens at every place where the mask fits; h: hashes of the tokens."""
    n = F.size(h)
    places = F.when(n > picked[-1], F.sequence(F.lit(0), n - 1 - picked[-1])).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(str(picked)), *[F.get(h, i + p) for p in picked]))


def _seeds(df: DataFrame, key: str, value: Column, masks: list[tuple[int, ...]]) -> DataFrame:
    """(key, pos, h): the hashes of every mask at every place of the token array value."""
    tokens_ = F.transform(value, lambda x: F.xxhash64(x))
    hashes = _let(tokens_, lambda h: F.array(*[_mask_hashes(h, m) for m in masks]))
    return df.select(key, F.explode(hashes).alias("s")).select(key, F.posexplode("s").alias("pos", "h"))


def _benchmark(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return bench.where(bench[item_col].isNotNull()).select(bench[item_col].alias("item_id"), tokens(bench[text_col]).alias("t")).where(F.size("t") > 0).distinct()


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc id, item_id, matched, compared, start_token): the best window of each leaked item in each document."""
    items = _benchmark(bench, item_col, item_text)
    sized = items.withColumn("n", F.least(F.size("t"), F.lit(WINDOW)))
    masks = sorted({mask(r["n"]) for r in sized.select("n").distinct().collect()}) or [mask(WINDOW)]
    theirs = [_seeds(sized.where(F.col("n").isin([n for n in range(1, WINDOW + 1) if mask(n) == m])), "item_id", F.col("t"), [m]) for m in masks]
    theirs = reduce(DataFrame.union, theirs).select("item_id", F.col("pos").alias("item_pos"), "h")
    if theirs.count() <= BROADCAST_SEEDS:
        theirs = F.broadcast(theirs)
    corpus = docs.where(docs[text_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    ours = _seeds(corpus, "id", tokens(F.col("text")), masks)
    hits = durable(ours.join(theirs, "h").select("id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "hits")
    texts = corpus.join(hits.select("id").distinct(), "id", "left_semi").distinct().select("id", tokens(F.col("text")).alias("t"))
    lo, hi = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("b"), F.size("t") - F.col("shift"))
    aligned = hits.join(texts, "id").join(items.select("item_id", F.col("t").alias("b")), "item_id")
    aligned = aligned.select("id", "item_id", "shift", "b", "t", lo.alias("lo"), hi.alias("hi"), F.least(F.lit(WINDOW), F.size("b")).alias("compared")).where("hi - lo >= compared")
    length = F.col("hi") - F.col("lo")
    same = F.zip_with(F.slice("b", F.col("lo") + 1, length), F.slice("t", F.col("lo") + F.col("shift") + 1, length), lambda x, y: F.when(x == y, 1).otherwise(0))

    def windows(s: Column) -> Column:
        each = F.sequence(F.lit(1), length - F.col("compared") + 1)
        total = lambda i: F.aggregate(F.slice(s, i, F.col("compared")), F.lit(0), lambda acc, x: acc + x)
        return F.array_max(F.transform(each, lambda i: F.struct(total(i).alias("matched"), (-(F.col("lo") + F.col("shift") + i - 1)).alias("neg"))))

    best = aligned.withColumn("best", _let(same, windows)).where(F.col("best.matched") >= F.col("compared") * SHARE)
    out = best.groupBy("id", "item_id").agg(F.max(F.struct("best.matched", "best.neg", "compared")).alias("x"))
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "x.matched", "x.compared", (-F.col("x.neg")).alias("start_token"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    return docs.join(leaks(docs, bench, id_col, text_col, item_col, item_text).select(id_col).distinct(), id_col, "left_anti").select(docs.columns)


def oracle() -> str:
    """In DuckDB, without seeds: every alignment with enough equal tokens is looked at window by window."""
    tok = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
with d as (select doc_id as k, {tok} as t from documents where text is not null),
b as (select distinct item_id as k, {tok} as t from benchmark where item_id is not null),
dt as (select k, unnest(t) as w, unnest(range(len(t))) as p from d),
bt as (select k, unnest(t) as w, unnest(range(len(t))) as p, len(t) as n from b),
hits as (select dt.k as doc_id, bt.k as item_id, dt.p - bt.p as shift from dt join bt using (w) group by all having count(*) >= min(least({WINDOW}, bt.n)) * {SHARE}),
al as (select doc_id, item_id, shift, d.t as t, b.t as b, greatest(0, -shift) as lo, least(len(b.t), len(d.t) - shift) as hi, least({WINDOW}, len(b.t)) as compared
       from hits join d on d.k = doc_id join b on b.k = item_id),
places as (select *, unnest(range(lo, hi - compared + 1)) as p from al where hi - lo >= compared),
sums as (select doc_id, item_id, compared, p + shift as start_token,
         len(list_filter(range(p, p + compared), lambda q: b[q + 1] = t[q + shift + 1])) as matched from places),
ranked as (select *, row_number() over (partition by doc_id, item_id order by matched desc, start_token, compared desc) as r from sums where matched >= compared * {SHARE})
select doc_id, item_id, matched::int as matched, compared::int as compared, start_token::int as start_token from ranked where r = 1"""

"""What each filter of a chain removes, in every order of the filters, part by part of a corpus.

Five filters look at a document: A too few words, B too few distinct words, C too many capitals, D a mark of markup,
E a text that a smaller id has too. What an order's step removes depends only on which filters a document fails, so
documents are counted by that mask once, and all orders follow from the counts of 32 masks.

Equal texts (E) are found by refining a partition of the documents: first by length in code points, then by the hash of
one block of the text after another. Blocks grow by GROWTH, so the rounds are as many as the logarithm of the longest
text. After each round classes of one document are dropped, and documents without further text wait. Rounds work on rows
of numbers; a class that holds a third of the corpus is one row of counts by map-side aggregation and is joined back by
broadcast. The full texts of the classes left over are then compared: they are grouped by class and text, which sends one
text a task and class. Where a class holds more than one text, its documents are told apart by text. A document fails E
if its id is greater than the least of its text.

Defined cases: a null text is empty, and equal to other empty ones; a null id fails E never and makes nobody fail; rows
that repeat an id count each, and an id's own repeats are no smaller id; a null source is the part of the empty string; a
document without label is neither good nor toxic, with several labels it is what any says; texts of any length are read
whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.spark_io import HOT_SHARE, LEAST_HOT, discard, durable, join_counted

FILTERS = "ABCDE"
#: Code points of the first block; each further block is GROWTH times as long as the one before.
BLOCK = 4096
GROWTH = 4
#: Classes whose numbers are broadcast to the texts (a key of 8 bytes each); of more, only the hot ones.
BROADCAST_CLASSES = 2_000_000
WORD = r"[^\x20\x09-\x0D]+"


def failing(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 1, 2, 4, 8."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = lambda w: F.when(F.size(w) < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0)
    by_words = F.get(F.transform(F.array(words), counts), F.lit(0))  # a lambda's variable is computed once
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return by_words + F.when(100 * capitals.cast("long") > 2 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def blocks() -> list[tuple[int, int]]:
    """(start, length) of the blocks of the longest text that a column can hold."""
    out, start, size, longest = [], 0, BLOCK, (1 << 31) - 1
    while start < longest:
        out.append((start, min(size, longest)))
        start, size = start + size, size * GROWTH
    return out


def block_hashes(text: Column, size: Column) -> Column:
    """The hash of each block of a text of size code points; an empty text has none."""
    places = F.array(*[F.struct(F.lit(start).alias("start"), F.lit(length).alias("length")) for start, length in blocks()])
    return F.transform(F.filter(places, lambda b: b["start"] < size), lambda b: F.xxhash64(F.substring(text, b["start"] + 1, b["length"])))


def _class(size: Column, hashes: Column, rounds: Column) -> Column:
    """The number of the class of a document after some rounds: length and the hashes of as many blocks."""
    return F.xxhash64(size, F.slice(hashes, 1, rounds))


def whole_class(df: DataFrame) -> DataFrame:
    return df.withColumn("class", _class(F.col("size"), F.col("hashes"), F.size("hashes")))


def facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, size, hashes, text): what is known of a document by itself."""
    plain = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("size", F.length("text"))
    return plain.select("id", "part", failing(F.col("text")).alias("mask"), "size", block_hashes(F.col("text"), F.col("size")).alias("hashes"), "text")


def refined(rows: DataFrame) -> DataFrame:
    """(class, n): the classes of two documents or more that agree in length and in all blocks' hashes.

    rows: (size, hashes) of every document.
    """
    left, done, k = rows.select("size", "hashes"), [], 0
    while True:
        keyed = left.withColumn("class", _class(F.col("size"), F.col("hashes"), F.lit(k)))
        many = durable(keyed.groupBy("class").agg(F.count("*").alias("n")).where("n > 1"), "classes")
        total = left.count()
        kept = durable(join_counted(keyed, many, ["class"], total).drop("class"), "refined")
        discard(many)
        ended = kept.where(F.size("hashes") <= k)
        done.append((kept, ended.withColumn("class", _class(F.col("size"), F.col("hashes"), F.size("hashes"))).groupBy("class").agg(F.count("*").alias("n"))))
        left, k = kept.where(F.size("hashes") > k), k + 1
        if left.isEmpty():
            break
    out = done[0][1]
    for _, classes in done[1:]:
        out = out.unionByName(classes)
    out = durable(out.groupBy("class").agg(F.sum("n").alias("n")), "survivors")
    discard(*(kept for kept, _ in done))
    return out


def least_ids(texts: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """(class, text, least): the distinct full texts of the classes and the least id of each; texts: (id, class, text)."""
    near, far = classes, None
    if classes.count() > BROADCAST_CLASSES:
        least = max(LEAST_HOT, total // HOT_SHARE)
        near, far = classes.where(F.col("n") > least), classes.where(F.col("n") <= least)
    # distinct texts of a task go on, once each; behind the join of far classes they are together already
    out = texts.join(F.broadcast(near.select("class")), "class", "left_semi").groupBy("class", "text").agg(F.min("id").alias("least"))
    if far is not None:
        out = out.unionByName(texts.join(far.select("class").hint("merge"), "class", "left_semi").groupBy("class", "text").agg(F.min("id").alias("least")))
    return out


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask): per document the filters it fails, E included, as bits 1 to 16."""
    every = facts(docs, id_col, text_col, part_col)
    known = durable(every.drop("text"), "facts")
    classes, total = refined(known), known.count()
    texts = whole_class(every).select("id", "class", "text")
    compared = least_ids(texts, classes, total).groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least"))
    compared = durable(compared.join(classes, "class"), "compared")
    one, mixed = compared.where("texts = 1").drop("texts"), compared.where("texts > 1").select("class", "n")
    rows = whole_class(known)
    mask = (F.col("mask") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("mask")
    if mixed.isEmpty():
        return join_counted(rows, one, ["class"], total, "left").select("id", "part", mask)
    # hashes that met by chance: these documents are told apart by their texts
    few = mixed.select("class")
    told = whole_class(every).join(few, "class", "left_semi").join(least_ids(texts, mixed, total), ["class", "text"]).select("id", "part", mask)
    return join_counted(rows.join(few, "class", "left_anti"), one, ["class"], total, "left").select("id", "part", mask).unionByName(told)


def orders(spark) -> DataFrame:
    """(filter_order, step, own, before): the 600 steps of all orders; own and before are bits of filters."""
    rows = [("".join(order), k + 1, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])) for order in permutations(FILTERS) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, own int, before int")


def audit(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row by part, order and step. masks: (id, part, mask); labels: (id, quality, toxic)."""
    told = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("bad"))
    counts = masks.join(told, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("toxic"))
    steps = [(1 << f, before) for f in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before >> f & 1]
    each = counts.withColumn("s", F.explode(F.array(*[F.struct(F.lit(own).alias("own"), F.lit(before).alias("before")) for own, before in steps]))).select("part", "mask", "n", "good", "toxic", "s.*")
    mask = F.col("mask")
    fails, earlier = mask.bitwiseAND(F.col("own")) != 0, mask.bitwiseAND(F.col("before")) != 0
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    # of a document's failing filters each stands first in as many of the 120 orders
    share = F.sum(F.when(fails, F.col("n") * F.floor(120 / F.bit_count(mask))).otherwise(0)).cast("long")
    sums = each.groupBy("part", "own", "before").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(mask == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )
    return sums.join(F.broadcast(orders(masks.sparkSession)), ["own", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents),
w as (select doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
m as (select doc_id, part, (len(words) < 200)::int as a, (100 * len(list_distinct(words)) < 50 * len(words))::int as b, (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::int as c,
      regexp_matches(text, '[#$%&*|]')::int as d, (coalesce(doc_id > min(doc_id) over (partition by text), false))::int as e from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by doc_id),
f as (select m.*, a + 2 * b + 4 * c + 8 * d + 16 * e as mask, coalesce(l.good, 0) as good, coalesce(l.bad, 0) as bad from m left join l using (doc_id)),
g as (select part, mask, count(*) as n, sum(good) as good, sum(bad) as bad from f group by part, mask),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
st as (select filter_order, step, cast(2 ** (strpos('ABCDE', filter_order[step:step]) - 1) as int) as own,
       cast(list_sum(list_transform(range(1, step), lambda k: 2 ** (strpos('ABCDE', filter_order[k:k]) - 1))) as int) as before from o, (select unnest(range(1, 6))::int as step)),
r as (select g.part, st.filter_order, st.step, st.own, sum(case when mask & (own | coalesce(before, 0)) = 0 then n else 0 end) as kept, sum(case when mask & own <> 0 and mask & coalesce(before, 0) = 0 then n else 0 end) as removed,
      sum(case when mask & own <> 0 and mask & coalesce(before, 0) <> 0 then n else 0 end) as redundant, sum(case when mask = own then n else 0 end) as unique_fails,
      sum(case when mask & own <> 0 and mask & coalesce(before, 0) = 0 then good else 0 end) as good_lost, sum(case when mask & own <> 0 and mask & coalesce(before, 0) = 0 then bad else 0 end) as toxic_lost
      from g, st group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
cast(sum(removed) over (partition by part, own) as bigint) as shapley from r"""

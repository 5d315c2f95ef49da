"""Fill-in-the-middle arrangement of documents, and the way back, in Spark SQL functions only.

A text is cut into units: runs of the letters A-Z and a-z, and every other code point by itself. Two cuts among the units
come from a digest of the document id, so that a run over the same documents always gives the same examples. The
middle goes to the end, behind sentinels: psm is prefix, suffix, middle, spm is suffix, prefix, middle. A text that holds
a sentinel is left plain, for it could not be told apart again; so is a share of all documents.

One projection over the documents, without a shuffle. Defined cases: a null text is empty; an empty text is plain with no
units; a null id is written as nothing, so that all null ids have the same digest; repeated rows give equal rows; texts
of any length are cut whole; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "([A-Za-z]+|[^A-Za-z])"
#: Percent of the documents that are rearranged, and of those the percent with the suffix first.
ARRANGED = 90
SUFFIX_FIRST = 20


def drawn(key: Column, k: int, seed: str = "1") -> Column:
    """The k-th number, from 1, of 32 bits each, of the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def restored(output: Column, form: Column) -> Column:
    """The text that was arranged: what stands between the sentinels, in its first order."""
    part = lambda k: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def arrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST, seed: str = "1") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): units, arrangement (plain, psm, spm) and the training text."""
    key, text = docs[id_col], F.coalesce(docs[text_col], F.lit(""))
    units = docs.select(key.alias(id_col), text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(1)).alias("units"), *[drawn(key, k, seed).alias(f"h{k}") for k in (1, 2, 3, 4)])
    place = lambda k: F.col(f"h{k}") % (F.size("units") + 1)
    holds = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        holds |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | holds | (F.col("h3") % 100 >= arranged)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    cuts = units.select(id_col, "text", "units", F.size("units").cast("long").alias("n"), form.alias("form"), F.least(place(1), place(2)).cast("int").alias("a"), F.greatest(place(1), place(2)).cast("int").alias("b"))
    joined = lambda start, size: F.array_join(F.slice("units", start, size), "")
    moved = F.col("form") != "plain"
    parts = cuts.select(
        id_col, "text", "n", "form", F.when(moved, joined(F.lit(1), F.col("a"))).alias("prefix"),
        F.when(moved, joined(F.col("a") + 1, F.col("b") - F.col("a"))).alias("middle"), F.when(moved, joined(F.col("b") + 1, F.size("units") - F.col("b"))).alias("suffix"),
    )
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    return parts.select(id_col, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def digests(arranged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The examples' digests instead of their texts, with those of the texts rebuilt from output and form."""
    return arranged.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"), sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
      case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') as pre, coalesce(array_to_string(units[a + 1:b], ''), '') as mid, coalesce(array_to_string(units[b + 1:], ''), '') as suf from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from p"""

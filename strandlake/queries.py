"""Registered queries on the star view of alignments, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.config import StatConfig
from strandlake.functions.sequence import with_dust
from strandlake.operators import compare, coverage, kmers, reads, selection, taxonomy
from strandlake.operators.filters import alignment_filter, mapped
from strandlake.plans import bamstats as bam
from strandlake.plans import held, holding
from strandlake.plans import refstats as ref
from strandlake.plans import taxstats as tax
from strandlake.shared import durable
from strandlake.sources import star

VIEW = ["qname", "flag", "tid", "ref_len", "pos", "end_pos", "qlen", "nm", "as_score", "seq"]
STRICT = StatConfig(minreads=3, minreflen=100, minalnas=0, maxdust=20)
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def r6(df: DataFrame) -> DataFrame:
    """Figures to six digits, ties decided on the product, as the SQL engine does."""
    return holding(df.select(*[(F.round(F.col(c) * 1e6) / 1e6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]), *held(df))


def query(sql: str, prelude: str | None = None):
    def register(f):
        _Q[f.__name__] = lambda spark, d: r6(f(spark, d))
        _SQL[f.__name__] = (prelude or PRELUDE) + sql
        return f

    return register


def _taxonomy(s, d):
    return star.reference(s, d), star.acc2tax(s, d), star.taxnode(s, d), star.taxname(s, d)


def _mapped(s, d):
    return star.alignments(s, d).where(mapped())


def _first(s, d):
    return reads.first_records(_mapped(s, d), ["tid"], seq=True)


def _segs(s, d):
    return coverage.segments(_mapped(s, d), ["tid"])


def _bins(s, d, segs=None):
    return coverage.bins_of(segs or durable(_segs(s, d), "stretches"), star.reference(s, d).select("tid", "ref_len"), ["tid"])


def _histogram(s, d):
    segs = durable(_segs(s, d), "stretches")
    bins = durable(_bins(s, d, segs), "bins")
    return holding(coverage.bin_histogram(segs, bins, ["tid"]), segs, bins)


def _shape(s, d):
    hist = _histogram(s, d)
    return holding(coverage.shape(hist, ["tid"]), *held(hist))


def _stats_sql(group: str, taxon: bool, source: str, having: str, head: str) -> str:
    """refstats or taxstats in SQL over source (rows with tid, dust and the group column)."""
    least = 2 if not taxon else 3
    most = "least(sl - 17 + 1, 238)" if taxon else "sl - 17 + 1"
    exposure = "covbases / len" if taxon else "depthsum / len"
    shape = "" if taxon else "left join shape using (tid)"
    shape_cols = "" if taxon else "coalesce(round(entropy, 6), 0) as entropy, coalesce(round(gini, 6), 0) as gini, coalesce(round(norm_entropy, 6), 0) as norm_entropy, coalesce(round(norm_gini, 6), 0) as norm_gini, round(tad80, 6) as tad80,"
    g = group
    return f"""
, src as ({source}),
fr as (select * from (select *, row_number() over (partition by {g}, qname order by ord) as rn from src) where rn = 1),
rl as (select {g}, count(*) as num_reads, avg(qlen) as mean_readl, case when count(*) >= {least} then sqrt(coalesce(var_samp(qlen), 0)) else 0 end as stdev_readl, min(qlen) as readl_min, max(qlen) as readl_max from fr group by {g}),
rk as (select {g}, least(qlen, 255) as l, row_number() over (partition by {g} order by least(qlen, 255)) as k, count(*) over (partition by {g}) as n from fr),
med as (select {g}, max(l) as median_readl from rk where k = n // 2 + 1 group by {g}),
moc as (select {g}, l, count(*) as n from rk group by {g}, l),
mo as (select {g}, l as mode_readl from (select *, row_number() over (partition by {g} order by n desc, l) as r from moc) where r = 1),
al as (select {g}, count(*) as num_alns, avg(nm) as mean_alnnm, avg((1 - nm / qlen) * 100) as mean_alnani, coalesce(stddev_samp((1 - nm / qlen) * 100), 0) as stdev_alnani, median((1 - nm / qlen) * 100) as median_alnani, avg(dust) as mdust, coalesce(stddev_samp(dust), 0) as stdev_dust from src group by {g}),
gt as (select distinct {g}, tid, ref_len from src),
gl as (select {g}, count(*) as num_accessions, cast(sum(ref_len) as bigint) as len from gt group by {g}),
gev as (select {g}, tid, p, sum(x) as x from (select {g}, tid, pos as p, 1 as x from src union all select {g}, tid, end_pos, -1 from src) group by all),
gseg as (select {g}, tid, p, lead(p) over w - p as length, sum(x) over w as depth from gev window w as (partition by {g}, tid order by p)),
gc as (select {g}, cast(sum(length) as bigint) as covbases, cast(sum(length * depth) as bigint) as depthsum, cast(sum(length * depth * depth) as bigint) as sumsq from gseg where depth > 0 and length > 0 group by {g}),
km as (select {g}, seq, least(length(seq), 255) as sl from fr),
ke as (select {g}, substr(seq, i::int, 17) as k from (select {g}, seq, unnest(range(1, {most} + 1)) as i from km)),
kc as (select {g}, case when regexp_matches(k, '[^ACGT]') then 'N' else least(k, reverse(translate(k, 'ACGT', 'TGCA'))) end as k from ke),
du as (select {g}, count(distinct k) / count(*) as duplicity from kc group by {g}),
fin as (select *, depthsum / len as mean_cov, covbases / len as breath_cov, 1 - exp(-({exposure})) as exp_breath, depthsum / covbases as mean_covcovered,
        sqrt(greatest(0, sumsq / covbases - (depthsum / covbases) * (depthsum / covbases))) as stdev_covcovered
        from rl join med using ({g}) join mo using ({g}) join al using ({g}) join gl using ({g}) left join gc using ({g}) left join du using ({g}) {shape} where {having})
select {head} num_alns, num_reads, round(mean_readl, 6) as mean_readl, round(stdev_readl, 6) as stdev_readl, median_readl, mode_readl, readl_min, readl_max, round(mean_alnnm, 6) as mean_alnnm, round(mean_alnani, 6) as mean_alnani,
round(stdev_alnani, 6) as stdev_alnani, round(median_alnani, 6) as median_alnani, covbases as num_covbases, round(mean_cov, 6) as mean_cov, round(breath_cov, 6) as breath_cov, round(exp_breath, 6) as exp_breath, round(breath_cov / exp_breath, 6) as breath_ratio,
round(mean_covcovered, 6) as mean_covcovered, round(stdev_covcovered, 6) as stdev_covcovered, round(stdev_covcovered / mean_covcovered, 6) as evenness_cov, round(1000 * breath_cov, 6) as site_density, round(coalesce(duplicity, 0), 6) as duplicity, {shape_cols}
round(mdust, 6) as mdust, round(stdev_dust, 6) as stdev_dust from fin"""


PRELUDE = """
with recursive dna as (select doc_id, upper(translate(regexp_replace(lower(text), '[^a-z.]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz.', 'acgtacgtacgtacgtacgtacgtacn')) as dna from documents),
base as (select cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as bigint) as ord, l_orderkey as qname, case when (l_orderkey + l_linenumber) % 53 = 0 then 4 else 0 end as flag, l_partkey as tid, 40 * cast(p_size as bigint) as ref_len,
  (l_orderkey * 7919 + l_suppkey * 613 + l_linenumber * 31) % (40 * cast(p_size as bigint)) as pos, 30 + (l_orderkey * 13) % 271 as qlen, cast(round(l_discount * 100) as bigint) as nm,
  case when l_linenumber = 7 then null else cast(round(l_tax * 100) as bigint) - cast(round(l_discount * 100) as bigint) end as as_score from lineitem join part on l_partkey = p_partkey),
aln as (select b.ord, b.qname, b.flag, b.tid, b.ref_len, b.pos, b.pos + least(b.qlen, b.ref_len - b.pos) as end_pos, b.qlen, b.nm, b.as_score, substr(d.dna, 1, cast(b.qlen as int)) as seq from base b join dna d on d.doc_id = b.qname % (select count(*) from documents)),
mapd as (select * from aln where flag & 4 = 0),
reference as (select p_partkey as tid, concat('ACC', p_partkey) as rname, 40 * cast(p_size as bigint) as ref_len from part),
taxnode as (select 100000 + s_suppkey as taxid, 1000 + cast(s_nationkey as bigint) as parent, 'species' as rank from supplier union all select 1000 + cast(n_nationkey as bigint), 10 + cast(n_regionkey as bigint), case when n_nationkey % 5 = 0 then 'clade' else 'genus' end from nation
  union all select 10 + cast(r_regionkey as bigint), cast(1 as bigint), 'family' from region union all select cast(1 as bigint), cast(1 as bigint), 'no rank'),
lev as (select *, case rank when 'species' then 0 when 'genus' then 1 when 'family' then 2 when 'order' then 3 when 'class' then 4 when 'phylum' then 5 when 'kingdom' then 6 when 'domain' then 7 else 0 end as level from taxnode),
taxname as (select 100000 + s_suppkey as taxid, s_name as name from supplier union all select 1000 + cast(n_nationkey as bigint), n_name from nation union all select 10 + cast(r_regionkey as bigint), r_name from region union all select cast(1 as bigint), 'root'),
acc2tax as (select concat('ACC', p_partkey) as accession, 100000 + p_partkey % (select count(*) from supplier) as taxid from part where p_partkey % 17 <> 0),
goal as (select unnest([0, 1, 2, 7]) as goal),
walk as (select taxid, taxid as at_, parent, level, goal, false as stop from lev, goal
  union all select w.taxid, n.taxid, n.parent, n.level, w.goal, n.taxid = n.parent from walk w join lev n on n.taxid = w.parent where w.level < w.goal and not w.stop),
lin as (select taxid, goal, coalesce(min(case when level >= goal and not stop then at_ end), taxid) as rank_taxid from walk group by taxid, goal),
sq as (select distinct qname, regexp_replace(seq, '[^ACGT]', '', 'g') as s from aln),
wd as (select qname, greatest(length(s) - 2, 0) as m, i, substr(s, i::int + 1, 3) as w from (select qname, s, unnest(range(0, length(s) - 2)) as i from sq)),
pr as (select a.qname, a.m, a.i as i, b.i as j from wd a join wd b on a.qname = b.qname and a.w = b.w and a.i < b.i and b.i < a.i + 64),
pev as (select qname, m, e, sum(x) as x from (select qname, m, j as e, 1 as x from pr union all select qname, m, i + 64, -1 from pr) group by all),
pru as (select qname, m, e, sum(x) over w as v, coalesce(lead(e) over w, 1000000) as nx from pev window w as (partition by qname order by e)),
plong as (select qname, max(v) as v from pru where m > 64 and nx > 64 and e <= m - 1 group by qname),
pshort as (select qname, count(*) as v from pr where m <= 64 group by qname),
dust as (select qname, cast(floor(0.5 + case when length(s) - 2 > 64 then 200 * coalesce(plong.v, 0) / (64 * 63.0) when length(s) - 2 > 1 then 200 * coalesce(pshort.v, 0) / ((length(s) - 2) * (length(s) - 3.0)) else 0 end) as int) as dust from sq left join plong using (qname) left join pshort using (qname)),
flt as (select * from mapd join dust using (qname)),
ev as (select tid, p, cast(sum(x) as bigint) as d from (select tid, pos as p, 1 as x from mapd union all select tid, end_pos, -1 from mapd) group by tid, p),
seg as (select tid, p, length, depth from (select tid, p, lead(p) over w - p as length, cast(sum(d) over w as bigint) as depth from ev window w as (partition by tid order by p)) where depth > 0 and length > 0),
cb as (select tid, cast(sum(length) as bigint) as covbases, cast(sum(length * depth) as bigint) as depthsum, cast(sum(length * depth * depth) as bigint) as sumsq from seg group by tid),
cum as (select *, sum(length) over (partition by tid order by p) as upto, sum(length) over (partition by tid) as n from seg),
qr as (select tid, cast(max(n) as bigint) as covbases, cast(min(case when upto >= n // 4 then p + n // 4 - (upto - length) end) as bigint) as q1, cast(min(case when upto >= 3 * n // 4 then p + 3 * n // 4 - (upto - length) end) as bigint) as q3 from cum group by tid),
wi as (select *, 2.0 * (q3 - q1) / case when round(cbrt(covbases)) ** 3 = covbases then round(cbrt(covbases)) else cbrt(covbases) end as fd from qr join reference using (tid)),
bn as (select tid, ref_len, covbases, q1, q3, case when ref_len < 100 then ref_len / ceil(log2(covbases) + 1) when fd < 1 then 100.0 else fd end as width from wi),
bi as (select *, cast(ceil(ref_len / width) as bigint) as n_bins from bn),
bp as (select tid, least(floor(p / width), n_bins - 1) as b from (select tid, unnest(range(p, p + length)) as p from seg) join bi using (tid)),
bf as (select tid, b, count(*) as value from bp group by tid, b),
bh as (select tid, value, count(*) as bins from (select tid, value from bf union all select tid, 0 from (select tid, unnest(range(n_bins - k)) as z from bi join (select tid, count(*) as k from bf group by tid) using (tid))) group by tid, value),
bw as (select *, sum(bins) over (partition by tid) as n, sum(bins) over (partition by tid order by value) as after_, sum(bins) over (partition by tid order by value) - bins as below, sum(value * bins) over (partition by tid order by value) - value * bins as mass from bh),
bk as (select *, greatest(0, case when below = 0 then after_ else least(after_, n - ceil(n / 10)) end - greatest(below, ceil(n / 10))) as kept from bw),
sh as (select tid, abs(-sum(bins / n * log2(bins / n))) as entropy, count(*) as k, max(n) as n, sum(value * bins) as total, sum(bins * (value * below - mass)) as spread, sum(value * kept) / nullif(sum(kept), 0) as tad80 from bk group by tid),
shape as (select tid, entropy, case when k = 1 then 1.0 else entropy / log2(k) end as norm_entropy, case when total = 0 then 0 else spread / (n * total) end as gini, case when n <= 1 or total = 0 then 0 else spread / (n * total) * n / (n - 1) end as norm_gini, tad80 from sh),
res as (select r.tid, r.rname, r.ref_len, a.taxid as acc_taxid, g.rank_taxid as genus, s.rank_taxid as species from reference r left join acc2tax a on a.accession = r.rname left join lin g on g.taxid = a.taxid and g.goal = 1 left join lin s on s.taxid = a.taxid and s.goal = 0),
sc as (select *, (1 - nm / (end_pos - pos)) * 100 as score from mapd),
ins as (select *, max(score) over (partition by qname) as best, row_number() over (partition by qname order by score desc, ord) as rn from sc where score between 90 and 100)
"""
COLS = "qname, flag, tid, ref_len, pos, end_pos, qlen, nm, as_score, seq"
_REF = _stats_sql("tid", False, "select * from flt", "true", "tid, len as Length,")
_REF_STRICT_SRC = "select * from flt where ref_len >= 100 and (as_score is null or as_score >= 0) and dust <= 20"


@query(f"select {COLS} from aln")
def aln_view(s, d):
    return star.alignments(s, d).select(VIEW)


@query(f"select {COLS}, dust from ({_REF_STRICT_SRC})")
def aln_filter(s, d):
    return alignment_filter(star.alignments(s, d), STRICT).select(*VIEW, "dust")


@query("select tid, count(*) as num_alns, count(distinct qname) as num_reads from mapd group by tid")
def ref_counts(s, d):
    return _mapped(s, d).groupBy("tid").agg(F.count("*").alias("num_alns"), F.countDistinct("qname").alias("num_reads"))


_FR = ", fr as (select * from (select *, row_number() over (partition by tid, qname order by ord) as rn from mapd) where rn = 1)"


@query(_FR + "select tid, count(*) as num_reads, round(avg(qlen), 6) as mean_readl, round(coalesce(stddev_samp(qlen), 0), 6) as stdev_readl, min(qlen) as readl_min, max(qlen) as readl_max from fr group by tid")
def ref_read_length(s, d):
    return reads.read_lengths(_first(s, d), ["tid"])


@query(_FR + ", rk as (select tid, least(qlen, 255) as l, row_number() over (partition by tid order by least(qlen, 255)) as k, count(*) over (partition by tid) as n from fr), mc as (select tid, l, count(*) as n from rk group by tid, l), mo as (select tid, l from (select *, row_number() over (partition by tid order by n desc, l) as r from mc) where r = 1) select rk.tid, rk.l as median_readl, mo.l as mode_readl from rk join mo using (tid) where k = rk.n // 2 + 1")
def ref_read_median_mode(s, d):
    return reads.median_mode(_first(s, d), ["tid"])


@query("select tid, round(avg((1 - nm / qlen) * 100), 6) as mean_alnani, round(coalesce(stddev_samp((1 - nm / qlen) * 100), 0), 6) as stdev_alnani from mapd group by tid")
def ref_ani(s, d):
    return reads.alignment_stats(_mapped(s, d), ["tid"]).select("tid", "mean_alnani", "stdev_alnani")


@query("select tid, round(median((1 - nm / qlen) * 100), 6) as median_alnani from mapd group by tid")
def ref_ani_median(s, d):
    return reads.alignment_stats(_mapped(s, d), ["tid"]).select("tid", "median_alnani")


@query("select tid, round(avg(nm), 6) as mean_alnnm from mapd group by tid")
def ref_nm(s, d):
    return reads.alignment_stats(_mapped(s, d), ["tid"]).select("tid", "mean_alnnm")


@query("select tid, p, d from ev")
def cov_events(s, d):
    return coverage.events(_mapped(s, d), ["tid"])


@query("select tid, p, length, depth from seg")
def cov_depth_segments(s, d):
    return _segs(s, d)


@query("select tid, depth, cast(sum(length) as bigint) as bases from seg group by tid, depth")
def cov_depth_histogram(s, d):
    return _segs(s, d).groupBy("tid", "depth").agg(F.sum("length").alias("bases"))


@query("select tid, ref_len, num_alns, num_reads, covbases, round(depthsum / ref_len, 6) as mean_cov, round(covbases / ref_len, 6) as breath_cov from cb join reference using (tid) join (select tid, count(*) as num_alns, count(distinct qname) as num_reads from mapd group by tid) using (tid)")
def cov_basic(s, d):
    out = coverage.basic(_segs(s, d), ["tid"]).join(star.reference(s, d).select("tid", "ref_len"), "tid").join(ref_counts(s, d), "tid")
    return out.select("tid", "ref_len", "num_alns", "num_reads", "covbases", (F.col("depthsum") / F.col("ref_len")).alias("mean_cov"), (F.col("covbases") / F.col("ref_len")).alias("breath_cov"))


@query("select tid, round(depthsum / covbases, 6) as mean_covcovered, round(sqrt(greatest(0, sumsq / covbases - (depthsum / covbases) * (depthsum / covbases))), 6) as stdev_covcovered from cb")
def cov_variance(s, d):
    f = coverage.figures(F.lit(1))
    return coverage.basic(_segs(s, d), ["tid"]).select("tid", *[f[c].alias(c) for c in ("mean_covcovered", "stdev_covcovered")])


@query("select tid, covbases, q1, q3 from qr")
def cov_quartiles(s, d):
    return coverage.quartiles(_segs(s, d), ["tid"])


@query("select tid, value, bins from bh")
def cov_bins(s, d):
    return _histogram(s, d)


@query("select tid, round(width, 6) as width, n_bins from bi")
def cov_bin_width(s, d):
    return _bins(s, d).select("tid", "width", "n_bins")


@query("select tid, round(entropy, 6) as entropy, round(norm_entropy, 6) as norm_entropy from shape")
def cov_entropy(s, d):
    return _shape(s, d).select("tid", "entropy", "norm_entropy")


@query("select tid, round(gini, 6) as gini, round(norm_gini, 6) as norm_gini from shape")
def cov_gini(s, d):
    return _shape(s, d).select("tid", "gini", "norm_gini")


@query("select tid, round(tad80, 6) as tad80 from shape")
def cov_tad80(s, d):
    return _shape(s, d).select("tid", "tad80")


@query("select tid, round(covbases / ref_len, 6) as breath_cov, round(1 - exp(-depthsum / ref_len), 6) as exp_breath, round(covbases / ref_len / (1 - exp(-depthsum / ref_len)), 6) as breath_ratio, round(1000 * (covbases / ref_len), 6) as site_density from cb join reference using (tid)")
def cov_breadth(s, d):
    out = coverage.basic(_segs(s, d), ["tid"]).join(star.reference(s, d), "tid").withColumns(coverage.figures(F.col("ref_len")))
    return out.select("tid", "breath_cov", "exp_breath", "breath_ratio", "site_density")


@query("select tid, round(avg(dust), 6) as mdust, round(coalesce(stddev_samp(dust), 0), 6) as stdev_dust from flt group by tid")
def ref_dust(s, d):
    return reads.alignment_stats(with_dust(_mapped(s, d)), ["tid"]).select("tid", "mdust", "stdev_dust")


@query("select qname, dust from dust")
def seq_dust(s, d):
    return with_dust(star.alignments(s, d).select("qname", "seq").distinct()).select("qname", "dust")


_KM = _FR + ", ke as (select tid, substr(seq, i::int, 17) as k from (select tid, seq, unnest(range(1, least(length(seq), 255) - 15)) as i from fr)), kc as (select tid, case when regexp_matches(k, '[^ACGT]') then 'N' else least(k, reverse(translate(k, 'ACGT', 'TGCA'))) end as k from ke)"


def _kmers(s, d):
    a, bounds = _mapped(s, d), (17, 255, 1 << 30)
    sized = durable(a.groupBy("tid").agg(*kmers.sizes(kmers.per_read(*bounds))), "sizes")
    table = kmers.read_table(a, ["tid"], *bounds, sized)
    return holding(kmers.counts(table, ["tid"], *bounds), table, sized)


@query(_KM + "select tid, count(distinct k) as distinct_kmers, count(*) as total_kmers from kc group by tid")
def seq_kmers(s, d):
    return _kmers(s, d)


@query(_KM + "select tid, round(count(distinct k) / count(*), 6) as duplicity from kc group by tid")
def seq_duplicity(s, d):
    found = _kmers(s, d)
    return holding(reads.duplicity(found, ["tid"]), *held(found))


@query(_REF)
def refstats(s, d):
    return ref.refstats(star.alignments(s, d))


@query(_stats_sql("tid", False, "select * from flt", "true", "(select rname from reference r where r.tid = fin.tid) as Id, coalesce((select acc_taxid from res where res.tid = fin.tid), 0) as taxID, len as Length,"))
def refstats_tax(s, d):
    r, a, _, _ = _taxonomy(s, d)
    return ref.with_taxid(ref.refstats(star.alignments(s, d)), r, a)


#: Two files over the same references: the second numbers them backwards.
_FAR = "4294967296 + (select count(*) from part) - "
_TWO_FILES = PRELUDE.replace("l_partkey as tid", f"case when l_orderkey % 2 = 0 then l_partkey else {_FAR}l_partkey end as tid").replace("reference as (select p_partkey as tid", f"reference as (select {_FAR}p_partkey as tid, concat('ACC', p_partkey) as rname, 40 * cast(p_size as bigint) as ref_len from part union all select p_partkey as tid")


@query(_stats_sql("tid", False, "select * from flt", "true", "(tid >> 32)::int as file_no, (select rname from reference r where r.tid = fin.tid) as Id, len as Length,"), _TWO_FILES)
def refstats_by_file(s, d):
    alns, refs = star.two_files(s, d)
    stats = ref.refstats(alns, key="ref")
    return holding(refs.select("ref", "file_no", F.col("rname").alias("Id")).join(stats, "ref").drop("ref"), *held(stats))


@query(f", src as ({_REF_STRICT_SRC}), g as (select tid, count(*) as a, count(distinct qname) as r from src group by tid) select (select count(*) from src) as alns, cast((select sum(r) from g) as bigint) as reads, cast(sum(a) as bigint) as passed_alns, cast(sum(r) as bigint) as passed_reads, count(*) as passed_refs from g where r >= 3")
def refstats_summary(s, d):
    a = star.alignments(s, d)
    first = reads.first_records(alignment_filter(a, STRICT), ["tid"])
    stats = reads.read_lengths(first, ["tid"]).where(F.col("num_reads") >= STRICT.minreads)
    alns = alignment_filter(a, STRICT).groupBy("tid").agg(F.count("*").alias("num_alns"))
    return ref.summary(a, stats.join(alns, "tid"), STRICT)


@query("select taxid, parent, rank, level from lev")
def tax_levels(s, d):
    return taxonomy.nodes_with_levels(star.taxnode(s, d))


@query("select taxid, rank_taxid from lin where goal = 7")
def tax_lineage(s, d):
    n = star.taxnode(s, d)
    return taxonomy.climb(n.select("taxid"), n, "domain")


@query("select taxid, rank_taxid from lin where goal = 1")
def tax_rank_genus(s, d):
    n = star.taxnode(s, d)
    return taxonomy.climb(n.select("taxid"), n, "genus")


@query("select taxid, rank_taxid from lin where goal = 2")
def tax_rank_family(s, d):
    n = star.taxnode(s, d)
    return taxonomy.climb(n.select("taxid"), n, "family")


@query("select tid, rname, ref_len from res where acc_taxid is null")
def tax_missing(s, d):
    r, a, _, _ = _taxonomy(s, d)
    return taxonomy.missing_references(r, a).select("tid", "rname", "ref_len")


@query("select qname, tid, pos, coalesce(acc_taxid, 0) as xt, coalesce(genus, 0) as xr from aln join res using (tid)")
def aln_tagged(s, d):
    r, a, n, _ = _taxonomy(s, d)
    return taxonomy.tagged(star.alignments(s, d), taxonomy.resolve(r, a, n, "genus")).select("qname", "tid", "pos", "xt", "xr")


_TAX = lambda rank, having="true": _stats_sql("taxid", True, f"select flt.*, {rank} as taxid from flt join res using (tid) where {rank} is not null", having, "taxid, (select name from taxname t where t.taxid = fin.taxid) as name, num_accessions, len as total_length,")


@query(_TAX("genus"))
def taxstats_genus(s, d):
    return tax.taxstats(star.alignments(s, d), *_taxonomy(s, d))


@query(_TAX("species"))
def taxstats_species(s, d):
    return tax.taxstats(star.alignments(s, d), *_taxonomy(s, d), StatConfig(rank="species"))


@query(_TAX("species", "mean_alnani >= 95.7 and num_reads >= 5"))
def taxstats_minmani(s, d):
    """Species of reads that resemble them: least mean identity and least number of reads."""
    return tax.taxstats(star.alignments(s, d), *_taxonomy(s, d), StatConfig(rank="species", minmani=95.7, minreads=5))


@query(_TAX("genus"))
def taxstats_from_tags(s, d):
    r, a, n, names = _taxonomy(s, d)
    tags = taxonomy.tagged(star.alignments(s, d), taxonomy.resolve(r, a, n, "genus")).withColumn("xr", F.when(F.col("xr") != 0, F.col("xr")))
    return tax.taxstats_from_tags(tags, names)


@query(", src as (select flt.*, genus as taxid from flt join res using (tid) where genus is not null), t as (select taxid, count(distinct qname) as r, count(distinct tid) as refs from src group by taxid), k as (select * from t where r >= 600) select (select count(*) from aln) as alns, (select count(distinct qname) from src) as reads, (select count(distinct qname) from src join k using (taxid)) as passed_reads, (select count(*) from src join k using (taxid)) as passed_alns, cast((select sum(refs) from k) as bigint) as passed_refs, (select count(*) from k) as passed_taxa")
def taxstats_summary(s, d):
    r, a, n, _ = _taxonomy(s, d)
    return tax.summary(star.alignments(s, d), taxonomy.resolve(r, a, n, "genus"), StatConfig(minreads=600))


_BAM = ", fr as (select * from (select *, row_number() over (partition by qname order by ord) as rn from mapd) where rn = 1), rk as (select least(qlen, 255) as l, row_number() over (order by least(qlen, 255)) as k, count(*) over () as n from fr)"


@query(_BAM + "select 'star.sam' as name, (select count(*) from mapd) as aln, count(*) as tread, round(avg(l), 6) as mreadl, round(stddev_samp(l), 6) as vreadl, max(case when k = n // 2 + 1 then l end) as mdreadl, (select l from rk group by l order by count(*) desc, l limit 1) as moreadl, (select round(avg((1 - nm / qlen) * 100), 6) from mapd) as mani, (select round(avg(nm), 6) from mapd) as mnm, (select cast(sum(ref_len) as bigint) from reference where tid in (select tid from mapd)) as tbases, (select cast(sum(covbases) as bigint) from cb) as covbases, round((select sum(covbases) from cb) / (select sum(ref_len) from reference where tid in (select tid from mapd)), 6) as covbreath from rk")
def bamstats(s, d):
    return bam.bamstats(star.alignments(s, d).withColumn("file", F.lit("data/star.sam")))


@query(_BAM + "select length, (select count(*) from rk where l = length) as n from (select unnest(range(256)) as length)")
def hist_read_length(s, d):
    return bam.read_length_distribution(star.alignments(s, d))


@query("select floor((1 - nm / qlen) * 100 * 10) / 10 as ani, count(*) as n from mapd group by 1")
def hist_ani(s, d):
    return bam.ani_distribution(star.alignments(s, d))


FILT = "select qname, tid, pos, end_pos, nm, round(score, 6) as score from ins where "


def _filt(s, d, **k):
    return selection.alnfilt(star.alignments(s, d), **k).select("qname", "tid", "pos", "end_pos", "nm", "score")


@query(FILT + "score = best and score > 0")
def alnfilt_alltop(s, d):
    return _filt(s, d)


@query(FILT + "score >= best * 0.99 and score > 0")
def alnfilt_pcttop(s, d):
    return _filt(s, d, mode="PCTTOP", pct=0.99)


@query(FILT + "score > 0")
def alnfilt_all(s, d):
    return _filt(s, d, mode="ALL")


@query(FILT + "score = best and qname not in (select qname from sc where score not between 90 and 100)")
def alnfilt_strict(s, d):
    return _filt(s, d, strict=True)


@query(FILT + "rn = 1")
def alnfilt_rndtop(s, d):
    return _filt(s, d, mode="RNDTOP")


#: The two engines write a price of millions differently; prices stay below that.
_DRAW = "md5(concat_ws(':', '7', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))"


@query(f", drawn as (select ord, {_DRAW} as draw from (select *, cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as bigint) as ord from lineitem join part on l_partkey = p_partkey)), pick as (select *, row_number() over (partition by qname order by score desc, draw, ord) as chosen from ins join drawn using (ord)) " + FILT.replace("from ins", "from pick") + "chosen = 1")
def alnfilt_random(s, d):
    return _filt(s, d, mode="RNDTOP", seed=7)


@query("select (select count(*) from mapd) as alns, (select count(distinct qname) from mapd) as queries, (select count(distinct tid) from mapd) as refs, count(*) as passed_alns, count(distinct qname) as passed_queries, count(distinct tid) as passed_refs from ins where score = best")
def alnfilt_summary(s, d):
    a = _mapped(s, d)
    return selection.alnfilt_summary(a, selection.alnfilt(a))


@query("select qname, tid, pos, as_score, round(round((as_score - lo + 1) / len / sum((as_score - lo + 1) / len) over (partition by qname), 12), 6) as weight from (select *, min(as_score) over (partition by qname) as lo, nullif(end_pos - pos, 0) as len from mapd)")
def aln_weights(s, d):
    return selection.reassign_weights(_mapped(s, d)).select("qname", "tid", "pos", "as_score", "weight")


@query(f", src as ({_REF_STRICT_SRC}) select qname, tid, pos, end_pos, dust from src where tid in (select tid from src group by tid having count(distinct qname) >= 3)")
def filter_refs(s, d):
    a = star.alignments(s, d)
    stats = reads.read_lengths(reads.first_records(alignment_filter(a, STRICT), ["tid"]), ["tid"]).where(F.col("num_reads") >= STRICT.minreads)
    return ref.filter_alignments(a, stats, STRICT).select("qname", "tid", "pos", "end_pos", "dust")


@query("select tid, row_number() over (order by tid) - 1 as new_tid from (select distinct tid from mapd where nm = 0 and qlen > 280)")
def renumbered_refs(s, d):
    return selection.renumber(_mapped(s, d).where("nm = 0 and qlen > 280"))


@query("select rname as accession, rname as accession_version, acc_taxid as taxid from res where acc_taxid is not null")
def present_accessions(s, d):
    r, a, _, _ = _taxonomy(s, d)
    return taxonomy.present_accessions(r, a)


@query(", a as (select tid, count(*) as n from mapd group by tid), b as (select tid, count(*) as n from mapd where nm = 0 group by tid) select b.tid as Id, a.n as all_alns, b.n as exact_alns from a join b using (tid)")
def cmpstat(s, d):
    m = _mapped(s, d)
    count = lambda x: x.groupBy("tid").agg(F.count("*").alias("n"))
    return compare.cmpstat(count(m), count(m.where("nm = 0")), 1, 1, ("all_alns", "exact_alns"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

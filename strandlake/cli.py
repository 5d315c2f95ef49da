"""Command line: python -m strandlake.cli COMMAND ... Each command reads files, runs a plan and writes a table."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.config import StatConfig
from strandlake.operators import selection, taxonomy
from strandlake.operators.compare import cmpstat, unmatched
from strandlake.plans import refstats as ref
from strandlake.plans import release
from strandlake.session import Session
from strandlake.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-b", "--bam", action="append", default=[])
    common.add_argument("--filelist")
    common.add_argument("-o", "--outbam")
    common.add_argument("--onefile", action="store_true", help="join the parts of a BAM output to one file")
    common.add_argument("--outstat")
    common.add_argument("-t", "--threads", type=int, help="accepted; Spark sets the number of tasks")
    common.add_argument("--qsize", type=int, help="accepted; Spark sets the size of batches")
    common.add_argument("--verbose", action="store_true")
    stats = argparse.ArgumentParser(add_help=False)
    stats.add_argument("-k", "--ksize", type=int, default=17)
    stats.add_argument("--minreflen", "--minrefl", type=int)
    stats.add_argument("--minreads", type=int, default=1)
    stats.add_argument("--minalnas", type=int)
    stats.add_argument("--maxdust", type=int, default=100)
    stats.add_argument("--minmani", type=float, default=0.0)
    stats.add_argument("-n", "--names")
    stats.add_argument("-d", "--nodes")
    stats.add_argument("-a", "--acc2tax")
    stats.add_argument("--rank", default="genus")
    stats.add_argument("--withtaxid", action="store_true", help="accepted; with a taxonomy the taxid is always given")
    stats.add_argument("--onlypresent", dest="present", help="write the accessions of the input's references; .parquet for fast reloading")
    stats.add_argument("--dumpacc2tax", dest="dump", help="write the whole accession table; .parquet for fast reloading")
    sub.add_parser("refstats", parents=[common, stats])
    sub.add_parser("taxstats", parents=[common, stats])
    sub.add_parser("bamstats", parents=[common]).add_argument("--printdists")
    f = sub.add_parser("alnfilt", parents=[common])
    f.add_argument("--mode", default="ALLTOP", choices=["ALLTOP", "RNDTOP", "PCTTOP", "ALL"])
    f.add_argument("--minani", type=float, default=90.0)
    f.add_argument("--maxani", type=float, default=100.0)
    f.add_argument("--pct", type=float, default=0.9)
    f.add_argument("--strictbounds", action="store_true")
    f.add_argument("--seed", type=int, help="RNDTOP: another choice among the best for each seed")
    c = sub.add_parser("cmpstat")
    c.add_argument("-1", dest="one", required=True)
    c.add_argument("-2", dest="two", required=True)
    c.add_argument("-p", type=int, required=True)
    c.add_argument("-q", type=int, required=True)
    c.add_argument("--outstat")
    return p


def _emit(df: DataFrame, path: str | None) -> None:
    sinks.write_tsv(df, path) if path else df.show(1000, truncate=False)


def _say(text: str) -> None:
    print(f"[strandlake] {text}", file=sys.stderr)


def _share(name: str, every: int, passed: int) -> None:
    _say(f"{every} {name}, {passed} passed filters ({passed / every if every else 0:f})")


def _write(run: Session, df: DataFrame, out: str, tags: list[str], more: list[str], whole: bool) -> None:
    for file, path in run.write(df, out, tags, more, whole):
        _say(f"{file} written to {path}")


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    if a.command == "cmpstat":
        one, two = files.read_stats(spark, a.one), files.read_stats(spark, a.two)
        _emit(cmpstat(one, two, a.p, a.q), a.outstat)
        unmatched(one, two).show(truncate=False)
        return
    paths = a.bam + (files.file_list(spark, a.filelist) if a.filelist else [])
    if not paths:
        raise SystemExit("no input file")
    given = [getattr(a, k, None) for k in ("acc2tax", "names", "nodes")]
    if any(given) and not all(given):
        raise SystemExit("--acc2tax, --names and --nodes go together")
    if a.command == "taxstats" and not all(given):
        raise SystemExit("taxstats needs --acc2tax, --names and --nodes")
    with Session(spark, paths, raw=bool(a.outbam) and a.command != "bamstats") as one:
        if a.verbose:
            _say(f"{a.command}: {len(one.files)} files, {one.inputs.count} references")
        COMMANDS[a.command](spark, one, a)


def _bamstats(spark: SparkSession, one: Session, a: argparse.Namespace) -> None:
    _emit(one.bamstats(), a.outstat or a.outbam)
    if a.printdists:
        one.write_distributions(a.printdists)


def _alnfilt(spark: SparkSession, one: Session, a: argparse.Namespace) -> None:
    kept = one.alnfilt(a.mode, a.minani, a.maxani, a.pct, a.strictbounds, a.seed)
    n = selection.alnfilt_summary(one.alignments.where(F.col("flag").bitwiseAND(4) == 0), kept, "ref").first()
    for name, k in (("alignments", "alns"), ("queries", "queries"), ("references", "refs")):
        _share(name, n[k], n[f"passed_{k}"])
    if a.outbam:
        _write(one, kept, a.outbam, [], [], a.onefile)


def _config(a: argparse.Namespace) -> StatConfig:
    return StatConfig(a.minreads, (1 if a.command == "taxstats" else 0) if a.minreflen is None else a.minreflen, a.minmani, a.minalnas, a.maxdust, a.ksize, a.rank)


def _taxonomy(spark: SparkSession, one: Session, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first taxid of each accession, nodes, names); writes the accession tables asked for."""
    acc2tax, nodes, names = files.load_taxonomy(spark, a.acc2tax, a.names, a.nodes)
    if a.dump:
        sinks.write_accessions(taxonomy.accession_table(acc2tax), a.dump)
    if a.present:
        sinks.write_accessions(taxonomy.present_accessions(one.inputs.references, acc2tax.select("accession", "taxid")), a.present)
    return taxonomy.accessions(acc2tax, "ord"), nodes, names


def _taxstats(spark: SparkSession, one: Session, a: argparse.Namespace) -> None:
    stats = one.taxstats(*_taxonomy(spark, one, a), _config(a))
    _emit(stats, a.outstat)
    n, reads = one.totals(), one.read_totals()
    _share("alignments", n["records"], n["passed_alns"])
    _share("reads", reads["reads"], reads["passed_reads"])
    _say(f"{n['groups']} taxa out of {n['passed_refs']} references")
    release(stats)


def _refstats(spark: SparkSession, one: Session, a: argparse.Namespace) -> None:
    cfg, tags, more, alns = _config(a), [], [], one.alignments
    if not all([a.acc2tax, a.names, a.nodes]):
        stats = one.refstats(cfg)
        _emit(one.named(stats), a.outstat)
    else:
        first, nodes, _ = _taxonomy(spark, one, a)
        stats = one.refstats(cfg)
        _emit(one.named(stats, first), a.outstat)
        absent, every = taxonomy.missing_references(one.inputs.references, first).count(), one.inputs.count
        _say(f"Warning: {absent} of {every} references ({absent / every if every else 0:f}) were not found in the accession table")
        tags, more = ["xt", "xr"], [f"@CO\tstrandlake:tax-tags\tXR=rank_taxid\trank={cfg.rank}"]
        if a.outbam:
            alns = taxonomy.tagged(alns, taxonomy.resolve(one.inputs.references, first, nodes, cfg.rank, "ref"), "ref")
    n = one.totals()
    _share("alignments", n["records"] if one.by_coordinate else n["alns"], n["passed_alns"])
    _share("reads", n["reads"], n["passed_reads"])
    _share("references", one.inputs.count, n["groups"])
    if a.outbam:
        _write(one, ref.filter_alignments(alns, stats, cfg, "ref"), a.outbam, tags, more, a.onefile)
    release(stats)


COMMANDS = {"bamstats": _bamstats, "alnfilt": _alnfilt, "taxstats": _taxstats, "refstats": _refstats}


if __name__ == "__main__":
    run(SparkSession.builder.appName("strandlake").getOrCreate(), sys.argv[1:])

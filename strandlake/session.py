"""Input files, the statistics made of them, and their run totals, in one object."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.config import StatConfig
from strandlake.operators import selection
from strandlake.operators.taxonomy import accessions
from strandlake.plans import bamstats as bam
from strandlake.plans import held, holding
from strandlake.plans import refstats as ref
from strandlake.plans import taxstats as tax
from strandlake.plans.counters import Counters
from strandlake.schema import REFSTATS
from strandlake.sources import files, sinks
from strandlake.sources.headers import InputFile, open_inputs


class Session:
    """Alignments of one or more files. Each file has a dictionary of references of its own: statistics by reference and by
    taxon are of one file each, and with several files their tables begin with the file's name. Use it in a with
    statement, or close() it, so that the table of headers goes."""

    def __init__(self, spark: SparkSession, paths: str | list[str], raw: bool = False):
        self.spark, self.inputs, self.raw = spark, open_inputs(spark, paths), raw
        self.seen, self.stats = Counters(), None

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.inputs.close()

    @property
    def files(self) -> list[InputFile]:
        return self.inputs.files

    @property
    def by_coordinate(self) -> bool:
        return any(f.by_coordinate for f in self.files)

    @property
    def grouped(self) -> bool:
        """Whether the records of a read stand together in every file, by the files' own word."""
        return all(f.order.get("SO") == "queryname" or f.order.get("GO") == "query" for f in self.files)

    @cached_property
    def alignments(self) -> DataFrame:
        return files.read_alignments(self.spark, self.inputs, self.raw)

    @property
    def _more(self) -> tuple[str, ...]:
        return ("file",) if len(self.files) > 1 else ()

    def bamstats(self) -> DataFrame:
        return bam.bamstats(self.alignments)

    def write_distributions(self, base: str) -> None:
        by = ("file_no",)
        sinks.write_distributions(bam.read_length_distribution(self.alignments, by), bam.ani_distribution(self.alignments, by), self.inputs, base)

    def alnfilt(self, mode: str = "ALLTOP", minani: float = 90.0, maxani: float = 100.0, pct: float = 0.9, strict: bool = False, seed: int | None = None) -> DataFrame:
        return selection.alnfilt(self.alignments, mode, minani, maxani, pct, strict, seed, by=("file_no",))

    def refstats(self, cfg: StatConfig | None = None) -> DataFrame:
        """Keyed by ref; named() gives the references' names. totals() are there once it has been written."""
        self.seen = Counters(on=True)
        self.stats = ref.refstats(self.alignments, cfg, "ref", self.seen)
        return self.stats

    def named(self, stats: DataFrame, acc2tax: DataFrame | None = None) -> DataFrame:
        """Statistics by reference with the file (if there are several), the name and, with a taxonomy, the taxid."""
        refs = self.inputs.references.join(self.inputs.paths(), "file_no")
        if acc2tax is not None:
            return ref.with_taxid(stats, refs, accessions(acc2tax), "ref", self._more)
        return holding(refs.select("ref", *self._more, F.col("rname").alias("Id")).join(stats, "ref").select(*self._more, "Id", *REFSTATS), *held(stats))

    def taxstats(self, acc2tax: DataFrame, nodes: DataFrame, names: DataFrame, cfg: StatConfig | None = None) -> DataFrame:
        """By file, if there are several, and taxon."""
        self.seen = Counters(on=True)
        by = ("file_no",) if self._more else ()
        self.stats = tax.taxstats(self.alignments, self.inputs.references, acc2tax, nodes, names, cfg, "ref", by, self.seen)
        if not by:
            return self.stats
        return holding(self.stats.join(self.inputs.paths(), "file_no").select("file", *[c for c in self.stats.columns if c != "file_no"]), *held(self.stats))

    def totals(self) -> dict[str, int]:
        """records read, alns that pass the row filters, reads of all references, and groups, passed_alns, passed_reads (or
        passed_refs) of the result: from the pass that made the statistics, once their table has been written."""
        return self.seen.totals()

    def read_totals(self) -> dict[str, int]:
        """Distinct reads that pass, and of the surviving taxa, over all files."""
        by = ("file_no",) if self._more else ()
        return tax.read_totals(self.stats, by).agg(F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.coalesce(F.sum("passed_reads"), F.lit(0)).alias("passed_reads")).first().asDict()

    def write(self, df: DataFrame, out: str, tags: list[str] | None = None, more: list[str] | None = None, whole: bool = False) -> Iterator[tuple[str, str]]:
        """Writes records as they came, one output for each input, with that input's header: out itself, or
        out.NAME.NUMBER.bam for several. BAM comes back as BAM, text as text. Yields (input, output)."""
        for f in self.files:
            name = f.path.rsplit("/", 1)[-1]
            to = out if len(self.files) == 1 else f"{out}.{name}.{f.number}{'.bam' if f.is_bam else ''}"
            own = df.where(F.col("file_no") == f.number)
            header = sinks.kept_header(own, self.inputs, f, more or [])
            if f.is_bam:
                sinks.write_bam(own, to, header, tags, whole)
            else:
                sinks.write_sam(own, to, header, tags)
            yield f.path, to

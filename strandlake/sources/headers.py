"""Headers of the inputs, read once a file by one job: what kind a file is, where its records begin, its references.

Every file has a dictionary of references of its own, so a reference is known by file and number. The dictionaries of all
inputs are one table in the shared folder; alignments get names and lengths from it by a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.shared import discard, durable
from strandlake.sources import store
from strandlake.sources.bam import HeaderReader, Place

#: References of all inputs up to which the dictionary is broadcast (about 100 bytes each).
BROADCAST_REFERENCES = 500_000
#: References of one Arrow batch.
BATCH = 50_000
_ROW = "file_no int, kind string, n int, name string, size long, line string"


@dataclass
class InputFile:
    """number: its place among the inputs; kind: bam, bam.gz, sam, sam.gz, or text, which only Spark can open.
    lines: the header's lines but for those of references; order: so, go and ss of the @HD line."""

    number: int
    path: str
    kind: str
    references: int
    lines: list[str] = field(default_factory=list)
    where: Place | None = None

    @property
    def is_bam(self) -> bool:
        return self.kind.startswith("bam")

    @property
    def by_spark(self) -> bool:
        """Text that Spark reads (and unpacks) by the file's name."""
        return self.kind == "text" or (not self.is_bam and (self.kind == "sam.gz") == self.path.endswith(".gz"))

    @property
    def order(self) -> dict[str, str]:
        head = next((x for x in self.lines if x.startswith("@HD")), "")
        return {k: v for k, _, v in (x.partition(":") for x in head.split("\t")[1:]) if k in ("SO", "GO", "SS")}

    @property
    def by_coordinate(self) -> bool:
        return self.order.get("SO") == "coordinate"


@dataclass
class Inputs:
    """Files and their references: (ref, file_no, tid, rname, ref_len)."""

    spark: SparkSession
    files: list[InputFile]
    table: DataFrame

    @property
    def count(self) -> int:
        return sum(f.references for f in self.files)

    @property
    def references(self) -> DataFrame:
        number = F.shiftleft(F.col("file_no").cast("long"), 32) + F.col("n")
        return self.table.where("kind = 'reference'").select(number.alias("ref"), "file_no", F.col("n").alias("tid"), F.col("name").alias("rname"), F.col("size").alias("ref_len"))

    def names(self) -> DataFrame:
        """The references, marked for broadcast if they are few enough."""
        return F.broadcast(self.references) if self.count <= BROADCAST_REFERENCES else self.references

    def paths(self) -> DataFrame:
        """(file_no, file): one row an input, known to the driver."""
        return F.broadcast(self.spark.createDataFrame([(f.number, f.path) for f in self.files], "file_no int, file string"))

    def reference_lines(self, file: InputFile) -> DataFrame:
        """(tid, line) of a file's references: its own @SQ lines, or made from name and length where it has none."""
        own = self.table.where(F.col("file_no") == file.number)
        line = own.where("kind = 'line'").select("n", F.col("line").alias("own"))
        made = F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("size").cast("string"))
        return own.where("kind = 'reference'").drop("line").join(line, "n", "left").select(F.col("n").alias("tid"), F.coalesce("own", made).alias("line"))

    def close(self) -> None:
        discard(self.table)


def _tag(line: str, name: str) -> str:
    return next((x[3:] for x in line.split("\t")[1:] if x.startswith(name + ":")), "")


def _rows(number: int, path: str) -> Iterator[tuple]:
    """The rows of one file's header; the last tells the rest."""
    kind, lines, n, told = store.content(path), [], 0, {}
    if kind.startswith("bam"):
        head, seen = HeaderReader(path, kind == "bam"), 0
        for line in head.lines():
            if line.startswith("@SQ"):
                yield number, "line", seen, None, None, line
                seen += 1
            else:
                lines.append(line)
        for n, (name, size) in enumerate(head.references(), 1):
            yield number, "reference", n - 1, name, size, None
        block, place = head.first()
        told = {"block": block, "place": place, "size": head.f.seek(0, 2)}
    else:
        with store.open_lines(path) as f:
            for raw in f:
                if not raw.startswith(b"@"):
                    break
                line = raw.decode(errors="replace").rstrip("\r\n")
                if line.startswith("@SQ"):
                    yield number, "line", n, None, None, line
                    yield number, "reference", n, _tag(line, "SN"), int(_tag(line, "LN") or 0), None
                    n += 1
                else:
                    lines.append(line)
    yield number, "file", n, path, None, json.dumps({"kind": kind, "lines": lines, **told})


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_no", pa.int32()), ("kind", pa.string()), ("n", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("line", pa.string())])
    for batch in batches:
        for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = []
            for row in _rows(number, path):
                held.append(row)
                if len(held) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _by_spark(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    """The same rows of text files that only Spark can open; @ lines anywhere in a file count as header."""
    numbers = F.broadcast(spark.createDataFrame([(n, p, store.as_spark_says(spark, p)) for n, p in files], "file_no int, path string, said string"))
    lines = spark.read.text([p for _, p in files]).where(F.col("value").startswith("@")).select(F.input_file_name().alias("said"), F.monotonically_increasing_id().alias("at"), "value").join(numbers, "said")
    sq = lines.where(F.col("value").startswith("@SQ"))
    sq = sq.select("file_no", "value", (F.row_number().over(Window.partitionBy("file_no").orderBy("at")) - 1).alias("n"))
    own = sq.select("file_no", F.lit("line").alias("kind"), "n", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("size"), F.col("value").alias("line"))
    refs = sq.select("file_no", F.lit("reference"), "n", F.regexp_extract("value", r"\tSN:([^\t]+)", 1), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long"), F.lit(None).cast("string"))
    rest = lines.groupBy("file_no", "path").agg(F.transform(F.array_sort(F.collect_list(F.when(~F.col("value").startswith("@SQ"), F.struct("at", "value")))), lambda x: x["value"]).alias("lines"), F.count_if(F.col("value").startswith("@SQ")).cast("int").alias("n"))
    rest = rest.select("file_no", F.lit("file"), "n", "path", F.lit(None).cast("long"), F.to_json(F.struct(F.lit("text").alias("kind"), "lines")))
    return own.union(refs).union(rest)


def open_inputs(spark: SparkSession, paths: str | list[str]) -> Inputs:
    """Looks into the files; patterns and folders stand for the files in them. One task a file reads its header."""
    found = store.expand(spark, [paths] if isinstance(paths, str) else list(paths))
    numbered = list(enumerate(found))
    mine = [(n, p) for n, p in numbered if store.readable(p) and not p.endswith(store.PACKED)]
    theirs = [x for x in numbered if x not in set(mine)]
    parts = []
    if mine:
        parts.append(spark.createDataFrame(mine, "file_no int, path string").repartition(len(mine), "file_no").mapInArrow(_parse, _ROW))
    if theirs:
        parts.append(_by_spark(spark, theirs))
    table = durable(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), "headers")
    told = {r["file_no"]: r for r in table.where("kind = 'file'").select("file_no", "n", "line").collect()}  # one row a file
    files = []
    for number, path in numbered:
        if number not in told:  # a text without any header line
            files.append(InputFile(number, path, "text", 0))
            continue
        n, more = told[number]["n"], json.loads(told[number]["line"])
        where = Place(path, number, more["size"], n, more["block"], more["place"], more["kind"] == "bam") if "block" in more else None
        files.append(InputFile(number, path, more["kind"], n, more["lines"], where))
    return Inputs(spark, files, table)

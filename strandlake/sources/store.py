"""Input files: listing through Spark's file systems, ranged reads in tasks, and what a file holds by its first bytes."""

from __future__ import annotations

import gzip
import io
import zlib
from typing import BinaryIO
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession

from strandlake.shared import hadoop_path

#: Bytes read ahead at a time.
AHEAD = 1 << 20
#: Suffixes of text that Spark unpacks by itself; such files are text whatever their first bytes.
PACKED = (".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".xz", ".deflate")


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files of the paths in their order, with their scheme: patterns and folders become the files in them by name."""
    out = []
    for path in paths:
        system, at = hadoop_path(spark, path)
        found = system.globStatus(at)
        if not found:
            raise FileNotFoundError(path)
        for one in found:
            inside = [x for x in system.listStatus(one.getPath()) if x.isFile()] if one.isDirectory() else [one]
            out += sorted(_slashes(system.makeQualified(x.getPath()).toString()) for x in inside if x.getPath().getName()[0] not in "._")
    return out


def _slashes(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path


def as_spark_says(spark: SparkSession, path: str) -> str:
    """The path as input_file_name() spells it, with its special characters escaped."""
    return _slashes(hadoop_path(spark, path)[1].toUri().toString())


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file://") or "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file://")
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def readable(path: str) -> bool:
    """Whether tasks can open the path by themselves; other stores are read by Spark alone."""
    try:
        _opened(path)
    except (ValueError, NotImplementedError, ImportError, OSError):
        return False
    return True


def open_input(path: str) -> BinaryIO:
    """The file, seekable, read ahead."""
    system, at = _opened(path)
    return io.BufferedReader(system.open_input_file(at), AHEAD)


def content(path: str) -> str:
    """What a file holds: bam (packed in blocks), bam.gz (packed as one stream), sam.gz or sam."""
    with open_input(path) as f:
        head = f.read(1 << 16)
        if head[:2] != b"\x1f\x8b":
            return "sam"
        try:
            first = zlib.decompressobj(31).decompress(head, 4)
        except zlib.error:
            return "sam"
        blocked = head[2:4] == b"\x08\x04"
        return ("bam" if blocked else "bam.gz") if first == b"BAM\1" else "sam.gz"


def open_lines(path: str) -> BinaryIO:
    """Text, unpacked if it is gzip, whatever its name."""
    f = open_input(path)
    packed = f.peek(2)[:2] == b"\x1f\x8b"
    return io.BufferedReader(gzip.GzipFile(fileobj=f), AHEAD) if packed else f

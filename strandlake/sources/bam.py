"""BAM files: a data source whose tasks read byte ranges of a file, and the blocks of a new one.

Records and blocks follow the public SAM/BAM specification. A header is read once a file, by headers.open_inputs; what
ranges need of it is where the records begin and the number of references. A file is cut into ranges of SPLIT bytes; a
task finds the first block of its range and the first record in it, and reads the records that begin in its blocks.
Records are parsed many at a time and go to Spark as Arrow batches. A file that is gzip but not blocked is one range.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandlake.schema import RECORD
from strandlake.sources.store import open_input

#: Compressed bytes of a range, and bytes of records parsed at a time.
SPLIT = 64 << 20
PIECE = 8 << 20
#: Fixed values of the format.
MAGIC = b"BAM\1"
BLOCK_HEAD = b"\x1f\x8b\x08\x04"
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES = np.frombuffer(b"=ACMGRSVTWYHKDBN", np.uint8)
BLOCK_BYTES = 65_280
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_KIND = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}
TAGS = {"nm": b"NM", "as_score": b"AS", "xt": b"XT", "xr": b"XR"}


def block_size(head: bytes) -> int:
    """Bytes of the compressed block that begins with head, 0 if none does."""
    if len(head) < 18 or head[:4] != BLOCK_HEAD:
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(12 + extra, len(head)):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def first_block(f: BinaryIO, at: int, end: int) -> int:
    """Where the first block at or after at begins; end if none does before it. A block is one if blocks follow it."""
    while at < end:
        f.seek(at)
        window = f.read(1 << 17)
        if not window:
            return end
        k = window.find(BLOCK_HEAD)
        while 0 <= k:
            place, good = at + k, 0
            while good < 3:
                f.seek(place)
                head = f.read(64)
                if not head and good:
                    return at + k
                size = block_size(head)
                if not size:
                    break
                place, good = place + size, good + 1
            if good == 3:
                return at + k
            k = window.find(BLOCK_HEAD, k + 1)
        at += max(1, len(window) - 3)
    return end


class Blocks:
    """Uncompressed bytes of the blocks from an offset on, with the number of bytes of those that begin before end."""

    def __init__(self, f: BinaryIO, at: int, end: int):
        self.f, self.at, self.end, self.own, self.read_, self.over = f, at, end, 0, 0, False

    def more(self) -> bytes:
        """The next block's bytes; b'' at the end of the file."""
        while True:
            self.f.seek(self.at)
            size = block_size(head := self.f.read(64))
            if not size:
                if head:
                    raise ValueError("broken block")
                self.over = True
                return b""
            self.f.seek(self.at)
            raw = self.f.read(size)
            extra = struct.unpack_from("<H", raw, 10)[0]
            out = zlib.decompress(raw[12 + extra : -8], -15)
            if self.at < self.end:
                self.own += len(out)
            self.at += size
            self.read_ += len(out)
            if out:
                return out


@dataclass(frozen=True)
class Place:
    """What a task needs to read a file's records: its number among the inputs, size, number of references, and where the
    first record begins (block and place in it)."""

    path: str
    number: int
    size: int
    references: int
    block: int
    place: int
    blocked: bool


class HeaderReader:
    """The header of a BAM file, read from its beginning in bounded memory: text line by line, then the references."""

    def __init__(self, path: str, blocked: bool):
        self.path, self.blocked, self.data, self.begin = path, blocked, bytearray(), 0
        self.f = open_input(path)
        self.source = Blocks(self.f, 0, 1 << 62) if blocked else None
        self.stream = None if blocked else gzip.GzipFile(fileobj=self.f)
        self.starts: list[tuple[int, int]] = []
        if self.take(4) != MAGIC:
            raise ValueError(f"{path} is no BAM file")
        self.text = struct.unpack("<i", self.take(4))[0]

    def need(self, n: int) -> None:
        while len(self.data) < n:
            if self.source:
                before, at = self.source.read_, self.source.at
                got = self.source.more()
                self.starts = [*(x for x in self.starts[-1:]), (before, self.source.at if not got else at)]
            else:
                got = self.stream.read(1 << 16)
            if not got:
                raise ValueError(f"{self.path} ends within its header")
            self.data += got

    def take(self, n: int) -> bytes:
        self.need(n)
        out = bytes(self.data[:n])
        del self.data[:n]
        self.begin += n
        return out

    def lines(self) -> Iterator[str]:
        left, rest = self.text, b""
        while left:
            part = self.take(min(left, 1 << 20))
            left -= len(part)
            *whole, rest = (rest + part).split(b"\n")
            yield from (x.decode(errors="replace") for x in whole if x)
        rest = rest.rstrip(b"\0")
        if rest:
            yield rest.decode(errors="replace")

    def references(self) -> Iterator[tuple[str, int]]:
        """Names and lengths; to be read behind the lines."""
        self.many = struct.unpack("<i", self.take(4))[0]
        for _ in range(self.many):
            n = struct.unpack("<i", self.take(4))[0]
            raw = self.take(n + 4)
            yield raw[: n - 1].decode(), struct.unpack_from("<i", raw, n)[0]

    def first(self) -> tuple[int, int]:
        """Block and place of the first record, behind the references."""
        if not self.blocked:
            return 0, self.begin
        if not self.data:  # the next block with bytes holds it
            return self.source.at, 0
        before, block = max(x for x in self.starts if x[0] <= self.begin)
        return block, self.begin - before


def int32_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<i4").ravel()


def first_record(data: bytes, references: int, whole: bool) -> int:
    """Where the first record of a run of records begins, -1 if the bytes don't tell; whole: the bytes go to the file's end."""
    raw = np.frombuffer(data, np.uint8)
    at = np.arange(max(0, len(raw) - 36))
    size, ref, pos = (int32_at(raw, at + k) for k in (0, 4, 8))
    likely = (size >= 34) & (size < 1 << 26) & (ref >= -1) & (ref < references) & (pos >= -1)

    def record(u: int) -> int:
        """The place after the record at u, 0 if there is none."""
        size, ref, pos, name, _, _, cigar, _, seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, u)
        if not (size >= 34 and -1 <= ref < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and name > 0 and seq >= 0):
            return 0
        if 32 + name + 4 * cigar + (seq + 1) // 2 + seq > size or (u + 36 + name <= len(data) and data[u + 35 + name] != 0):
            return 0
        return u + 4 + size

    for u in np.flatnonzero(likely).tolist():
        place, good = u, 0
        while place + 36 <= len(data) and good < 8 and (after := record(place)):
            place, good = after, good + 1
        if good == 8 or (good >= 1 and whole and place == len(data)) or (good >= 2 and place + 36 > len(data)):
            return u
    return 0 if whole and not len(data) else -1


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after another, and their offsets."""
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return data[np.arange(offs[-1]) - np.repeat(offs[:-1], size) + np.repeat(start, size)], offs


def strings(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())


def integer_tags(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> dict[str, pa.Array]:
    """The integer tags in TAGS of records whose tags lie in at..end; all records step from tag to tag together."""
    wanted = {int.from_bytes(v, "big"): k for k, v in TAGS.items()}
    value = {k: np.zeros(len(at), np.int64) for k in TAGS}
    there = {k: np.zeros(len(at), bool) for k in TAGS}
    size_of = np.zeros(256, np.int64)
    for k, n in TAG_BYTES.items():
        size_of[ord(k)] = n
    zeros = np.flatnonzero(data == 0)
    at = at.copy()
    row = np.flatnonzero(at + 3 <= end)
    while len(row):
        place = at[row]
        name, kind = data[place].astype(np.int64) << 8 | data[place + 1], data[place + 2]
        size = size_of[kind]
        text = np.flatnonzero((kind == ord("Z")) | (kind == ord("H")))
        size[text] = zeros[np.minimum(np.searchsorted(zeros, place[text] + 3), len(zeros) - 1)] + 1 - (place[text] + 3) if len(zeros) else 0
        many = np.flatnonzero(kind == ord("B"))
        if len(many):
            size[many] = 5 + size_of[data[place[many] + 3]] * int32_at(data, place[many] + 4)
        if (size <= 0).any():
            raise ValueError("broken tag")
        for code, column in wanted.items():
            for letter, form in TAG_KIND.items():
                hit = np.flatnonzero((name == code) & (kind == ord(letter)))
                if len(hit):
                    raw = np.ascontiguousarray(data[place[hit][:, None] + 3 + np.arange(TAG_BYTES[letter])]).view(form).ravel()
                    value[column][row[hit]], there[column][row[hit]] = raw, True
        at[row] = place + 3 + size
        row = row[at[row] + 3 <= end[row]]
    return {k: pa.array(value[k].astype(np.int32), mask=~there[k]) for k in TAGS}


def columns(data: np.ndarray, start: np.ndarray, size: np.ndarray, path: str, number: int, ord_: int, raw: bool) -> pa.RecordBatch:
    """Rows of RECORD from the records data[start:start + size]."""
    head = np.ascontiguousarray(data[start[:, None] + np.arange(32)])
    word = head.view("<i4")
    short = head.view("<u2")
    tid, pos, mate, l_seq = (word[:, k].astype(np.int64) for k in (0, 1, 5, 4))
    l_name, n_cigar, flag = head[:, 8].astype(np.int64), short[:, 6].astype(np.int64), short[:, 7].astype(np.int32)
    at = start + 32
    qname = strings(*gather(data, at, l_name - 1))
    at = at + l_name
    flat, offs = gather(data, at, 4 * n_cigar)
    op = np.ascontiguousarray(flat).view("<u4")
    used = np.where(np.isin(op & 15, (0, 2, 3, 7, 8)), op >> 4, 0).astype(np.int64)
    aligned = np.bincount(np.repeat(np.arange(len(start)), n_cigar), used, len(start)).astype(np.int64)
    at = at + 4 * n_cigar
    offs = np.concatenate([[0], np.cumsum(l_seq)]).astype(np.int64)
    inside = np.arange(offs[-1]) - np.repeat(offs[:-1], l_seq)
    pair = data[np.repeat(at, l_seq) + (inside >> 1)]
    seq = strings(BASES[np.where(inside & 1, pair & 15, pair >> 4)], offs)
    at = at + (l_seq + 1) // 2 + l_seq
    tags = integer_tags(data, at, start + size)
    whole = pa.nulls(len(start), pa.binary())
    if raw:
        whole = pa.array([data[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)], pa.binary())
    out = {
        "file": pa.array([path]).take(pa.array(np.zeros(len(start), np.int64))), "file_no": pa.array(np.full(len(start), number, np.int32)), "ord": pa.array(ord_ + np.arange(len(start))), "qname": qname, "flag": pa.array(flag),
        "tid": pa.array(tid.astype(np.int32)), "ref": pa.array((number << 32) + tid, mask=tid < 0), "pos": pa.array(pos), "end_pos": pa.array(pos + np.maximum(1, aligned)), "qlen": pa.array(l_seq.astype(np.int32)), "seq": seq, **tags,
        "mate": pa.array(mate.astype(np.int32)), "raw": whole,
    }
    return pa.RecordBatch.from_arrays([out[c.split()[0]] for c in RECORD.split(", ")], [c.split()[0] for c in RECORD.split(", ")])


def offsets(data: bytes, at: int, own: int) -> tuple[np.ndarray, int]:
    """Places of the size fields of the whole records that begin before own, and the place after the last."""
    out = []
    while at < own and at + 4 <= len(data):
        size = struct.unpack_from("<i", data, at)[0]
        if at + 4 + size > len(data):
            break
        out.append(at)
        at += 4 + size
    return np.array(out, np.int64), at


class Range(InputPartition):
    def __init__(self, file: Place, number: int, begin: int, end: int):
        super().__init__((file.path, number))
        self.file, self.number, self.begin, self.end = file, number, begin, end


class _Reader(DataSourceReader):
    def __init__(self, files: list[Place], raw: bool, split: int):
        self.files, self.raw, self.split = files, raw, split

    def partitions(self) -> list[InputPartition]:
        out = []
        for f in self.files:
            ranges = range(0, f.size, self.split) if f.blocked else [0]
            out += [Range(f, k, a, min(a + self.split, f.size) if f.blocked else f.size) for k, a in enumerate(ranges)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        file = partition.file
        ord_ = partition.number << 40
        with open_input(file.path) as packed:
            if file.blocked:
                if file.block >= partition.end:
                    return
                mine = partition.begin <= file.block
                source = Blocks(packed, file.block if mine else first_block(packed, partition.begin, partition.end), partition.end)
                if source.at >= partition.end:
                    return
                held = bytearray(source.more())
                place = file.place
                if not mine:
                    most = 1 << 18
                    while (place := first_record(bytes(held), file.references, source.over)) < 0:
                        if source.over:
                            return
                        most *= 2
                        while len(held) < most and not source.over:
                            held += source.more()
                more = source.more
            else:
                stream = gzip.GzipFile(fileobj=packed)
                stream.seek(file.place)
                held, place, source = bytearray(), 0, None
                more = lambda: stream.read(1 << 16)
            over = False
            while True:
                while not over and len(held) < PIECE and (source is None or source.at < source.end):
                    got = more()
                    over = not got
                    held += got
                data = bytes(held)
                own = source.own - (source.read_ - len(held)) if source else len(data)
                at, after = offsets(data, place, min(own, len(data)))
                if len(at):
                    array = np.frombuffer(data, np.uint8)
                    for k in range(0, len(at), 20_000):
                        part = at[k : k + 20_000]
                        yield columns(array, part + 4, int32_at(array, part).astype(np.int64), file.path, file.number, ord_, self.raw)
                        ord_ += len(part)
                held, place = held[after:], 0
                left = source.own - (source.read_ - len(held)) if source else len(held)
                if (over or (source is not None and source.at >= source.end)) and left <= 0:
                    return
                got = more()  # the last record goes on in the next block
                if not got:
                    if left > 0 and len(held):
                        raise ValueError(f"{file.path} ends within a record")
                    return
                held += got


def tag_spans(raw: bytes, at: int) -> Iterator[tuple[bytes, int, int]]:
    while at < len(raw):
        name, kind, begin = raw[at : at + 2], chr(raw[at + 2]), at
        at += 3
        if kind in "ZH":
            at = raw.index(0, at) + 1
        elif kind == "B":
            at += 5 + TAG_BYTES[chr(raw[at])] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            at += TAG_BYTES[kind]
        yield name, begin, at


def patched(raw: bytes, tid: int, mate: int, tags: dict[bytes, bytes]) -> bytes:
    """The record with other reference numbers, and with tags in place of those of the same names."""
    if tags:
        l_name, n_cigar, l_seq = raw[8], struct.unpack_from("<H", raw, 12)[0], struct.unpack_from("<i", raw, 16)[0]
        at = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        kept = b"".join(raw[a:b] for name, a, b in tag_spans(raw, at) if name not in tags)
        raw = raw[:at] + kept + b"".join(tags.values())
    return struct.pack("<i", tid) + raw[4:20] + struct.pack("<i", mate) + raw[24:]


def block(data: bytes, level: int = 5) -> bytes:
    squeezed = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeezed.compress(data) + squeezed.flush()
    return BLOCK_HEAD + bytes(4) + b"\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocked:
    """Blocks of the bytes written to it; flush begins a new one."""

    def __init__(self) -> None:
        self.held, self.blocks, self.size = bytearray(), [], 0

    def _put(self, data: bytes) -> None:
        self.blocks.append(block(data))
        self.size += len(self.blocks[-1])

    def write(self, data: bytes) -> None:
        self.held += data
        at = 0
        while len(self.held) - at >= BLOCK_BYTES:
            self._put(bytes(self.held[at : at + BLOCK_BYTES]))
            at += BLOCK_BYTES
        del self.held[:at]

    def flush(self) -> None:
        if self.held:
            self._put(bytes(self.held))
            self.held = bytearray()

    def taken(self) -> bytes:
        """The blocks so far, which are forgotten."""
        out = b"".join(self.blocks)
        self.blocks, self.size = [], 0
        return out


def header_bytes(text: str, references: list[tuple[str, int]]) -> bytes:
    raw = text.encode()
    names = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)
    return MAGIC + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(references)) + names


class BamDataSource(DataSource):
    """spark.read.format("bam").option("files", described(places)).load() gives RECORD; option raw keeps each record's own
    bytes. Tasks open the files by pyarrow's file systems."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader([Place(**x) for x in json.loads(self.options["files"])], self.options.get("raw", "false") == "true", int(self.options.get("split", SPLIT)))


def described(files: list[Place]) -> str:
    return json.dumps([asdict(f) for f in files])

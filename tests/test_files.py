import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandlake.cli import run
from strandlake.operators import taxonomy
from strandlake.session import Session
from strandlake.sources import bam as bam_files
from strandlake.sources import files, headers, sinks, store

SAM = [
    "@HD\tVN:1.6\tSO:queryname", "@SQ\tSN:A1\tLN:200", "@SQ\tSN:A2\tLN:90",
    "r1\t0\tA1\t1\t60\t8M2D2M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:2\tAS:i:-5", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*", "r1\t0\tA2\t11\t60\t10M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:0\tXR:i:7",
]


def bam(path):
    out = bytearray(b"BAM\1") + struct.pack("<i", 0) + struct.pack("<i", 2)
    for name, size in ((b"A1\0", 200), (b"A2\0", 90)):
        out += struct.pack("<i", len(name)) + name + struct.pack("<i", size)
    for name, flag, tid, pos, cigar, tags in ((b"r1\0", 0, 0, 0, [(8, 0), (2, 2), (2, 0)], b"NMC\x02ASs" + struct.pack("<h", -5)), (b"r2\0", 4, -1, -1, [], b"ZZZabc\0BBBs" + struct.pack("<ihh", 2, 1, 2)), (b"r1\0", 0, 1, 10, [(10, 0)], b"NMC\0XRi" + struct.pack("<i", 7))):
        seq = b"\x12\x48\x12\x48\x12" if flag == 0 else b"\x12\x48"
        n = 10 if flag == 0 else 4
        raw = struct.pack("<iiBBHHHiiii", tid, pos, len(name), 60, 0, len(cigar), flag, n, -1, -1, 0) + name + b"".join(struct.pack("<I", a << 4 | b) for a, b in cigar) + seq + b"\xff" * n + tags
        out += struct.pack("<i", len(raw)) + raw
    with gzip.open(path, "wb") as f:
        f.write(bytes(out))


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "x.sam").write_text("\n".join(SAM) + "\n")
    bam(tmp_path / "x.bam")
    (tmp_path / "nodes.dmp").write_text("5\t|\t9\t|\tspecies\t|\n9\t|\t1\t|\tclade\t|\n9\t|\t1\t|\tgenus\t|\n1\t|\t1\t|\tno rank\t|\n")
    (tmp_path / "names.dmp").write_text("5\t|\tfoo\t|\t\t|\tsynonym\t|\n5\t|\tbar\t|\t\t|\tscientific name\t|\n5\t|\tbaz\t|\t\t|\tscientific name\t|\n9\t|\tg\t|\t\t|\tscientific name\t|\n1\t|\troot\t|\t\t|\tscientific name\t|\n")
    (tmp_path / "acc.tsv").write_text("a\tb\tc\nx\tA1\t5\nx\tA1\t6\n\nx\tA3\t7\n")
    return tmp_path


def test_sam_and_bam_agree(spark, inputs):
    cols = ["qname", "flag", "tid", "rname", "ref_len", "pos", "end_pos", "qlen", "seq", "nm", "as_score", "xr"]
    got = [sorted(map(str, files.read_alignments(spark, str(inputs / f)).where("tid >= 0").select(cols).collect())) for f in ("x.sam", "x.bam")]
    assert got[0] == got[1] and len(got[0]) == 2 and "end_pos=12" in got[0][0] + got[0][1]
    assert headers.open_inputs(spark, str(inputs / "x.sam")).files[0].order == {"SO": "queryname"}


def bam_records(n):
    """Random records with all kinds of tags, some longer than a block."""
    rng = random.Random(5)
    out = []
    for i in range(n):
        size, name = (rng.randrange(0, 200) if i % 500 else 90_000), f"read{i // 2}".encode() + b"\0"
        cigar = [(size, 0)] if size else []
        tags = [b"NMC" + bytes([rng.randrange(9)]), b"ASs" + struct.pack("<h", rng.randrange(-300, 300)), b"ZZZ" + b"x" * rng.randrange(9) + b"\0", b"BBBs" + struct.pack("<ihh", 2, 1, 2), b"XTi" + struct.pack("<i", i), b"FFf" + struct.pack("<f", 0.5)]
        rng.shuffle(tags)
        tid = rng.randrange(-1, 3)
        raw = struct.pack("<iiBBHHHiiii", tid, rng.randrange(100) if tid >= 0 else -1, len(name), 60, 0, len(cigar), 0 if tid >= 0 else 4, size, rng.randrange(-1, 3), -1, 0) + name
        raw += b"".join(struct.pack("<I", a << 4 | b) for a, b in cigar) + bytes(rng.choice((0x11, 0x22, 0x48, 0x84)) for _ in range((size + 1) // 2)) + b"\x20" * size + b"".join(tags[: rng.randrange(7)])
        out.append(raw)
    return out


@pytest.fixture(scope="module")
def long_bam(tmp_path_factory):
    path, records = tmp_path_factory.mktemp("bam") / "long.bam", bam_records(3000)
    with open(path, "wb") as f:
        out = bam_files.Blocked()
        out.write(bam_files.header_bytes("@HD\tVN:1.6\tSO:queryname\n@SQ\tSN:A1\tLN:200\tM5:ab\n@SQ\tSN:A2\tLN:90\n@SQ\tSN:A3\tLN:70\n@RG\tID:g\n@PG\tID:p\n", [("A1", 200), ("A2", 90), ("A3", 70)]))
        out.flush()
        for raw in records:
            out.write(struct.pack("<i", len(raw)) + raw)
        out.flush()
        f.write(out.taken() + bam_files.END_OF_FILE)
    return str(path), records


@pytest.mark.parametrize("split", [1 << 30, 50_000, 3_000])
def test_ranges_of_a_file(spark, long_bam, split):
    """However a file is cut, each record is read once, in order, with its own bytes."""
    path, records = long_bam
    df = files.read_alignments(spark, path, raw=True, split=split)
    rows = df.orderBy("ord").collect()
    assert [bytes(r["raw"]) for r in rows] == records
    assert df.rdd.getNumPartitions() > (1 if split < 1 << 20 else 0)
    for r, raw in list(zip(rows, records, strict=True))[:600]:
        tags = {n: raw[a:b] for n, a, b in bam_files.tag_spans(raw, 32 + raw[8] + 4 * struct.unpack_from("<H", raw, 12)[0] + (r["qlen"] + 1) // 2 + r["qlen"])}
        assert r["nm"] == (tags[b"NM"][3] if b"NM" in tags else None) and r["as_score"] == (struct.unpack("<h", tags[b"AS"][3:])[0] if b"AS" in tags else None)
        assert r["xt"] == (struct.unpack("<i", tags[b"XT"][3:])[0] if b"XT" in tags else None) and r["mate"] == struct.unpack_from("<i", raw, 20)[0]
        assert r["rname"] == (None if r["tid"] < 0 else f"A{r['tid'] + 1}") and len(r["seq"]) == r["qlen"] and r["end_pos"] == r["pos"] + max(1, r["qlen"])


@pytest.mark.parametrize("whole", [False, True])
def test_bam_comes_back(spark, long_bam, tmp_path, whole):
    """Filtered files hold the input's records byte for byte, but for reference numbers and new tags: as a folder of files
    that each are a BAM, or as one file."""
    path, records = long_bam
    one = Session(spark, path, raw=True)
    out = str(tmp_path / "out.bam")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few records are one part
    assert list(one.write(one.alignments.where("tid in (0, 2)"), out, whole=whole)) == [(f"file://{path}", out)]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    made = [tmp_path / "out.bam"] if whole else sorted(p for p in (tmp_path / "out.bam").iterdir() if p.name.startswith("part-"))
    assert len(made) == 1 if whole else len(made) > 1
    for p in made:
        head = bam_files.HeaderReader(str(p), True)
        text = list(head.lines())
        assert [n for n, _ in head.references()] == ["A1", "A3"] and "@SQ\tSN:A1\tLN:200\tM5:ab" in text and "@RG\tID:g" in text and "@PG\tID:strandlake\tPN:strandlake\tPP:p" in text
        assert p.read_bytes().endswith(bam_files.END_OF_FILE)
    with gzip.open(made[0]) as f:  # any reader of gzip can unpack it
        assert f.read(4) == b"BAM\1"
    new = {-1: -1, 0: 0, 1: -1, 2: 1}
    number = lambda raw, at: struct.unpack_from("<i", raw, at)[0]
    want = [struct.pack("<i", new[number(x, 0)]) + x[4:20] + struct.pack("<i", new[number(x, 20)]) + x[24:] for x in records if number(x, 0) in (0, 2)]
    got = [bytes(r["raw"]) for r in files.read_alignments(spark, out, raw=True).orderBy("file", "ord").collect()]
    assert got == want and not [p for p in tmp_path.iterdir() if p.name.strip(".").removesuffix(".crc") != "out.bam"]
    tagged = sinks.with_ani(one.alignments.where("tid in (0, 2)").orderBy("ord").limit(50).withColumn("xt", F.lit(77)).withColumn("nm", F.lit(1)))
    list(one.write(tagged, str(tmp_path / "tags.bam"), ["xt", "an"]))
    back = files.read_alignments(spark, str(tmp_path / "tags.bam"), raw=True).collect()
    assert {r["xt"] for r in back} == {77} and all(bytes(r["raw"]).count(b"XTi") == 1 for r in back) and sum(b"ANf" in bytes(r["raw"]) for r in back) == sum(r["qlen"] > 0 for r in back)


def test_files_told_by_content(spark, inputs, long_bam):
    """A BAM, a gzip SAM and a plain SAM under other names; folders and patterns."""
    path, records = long_bam
    (inputs / "mis").mkdir()
    (inputs / "mis" / "a.sam").write_bytes(open(path, "rb").read())
    (inputs / "mis" / "b.sam").write_bytes(gzip.compress((inputs / "x.sam").read_bytes()))
    (inputs / "mis" / "c +%20é.bam").write_bytes((inputs / "x.sam").read_bytes())
    (inputs / "mis" / "d.gz").write_bytes((inputs / "x.sam").read_bytes())
    (inputs / "mis" / "e.sam.gz").write_bytes(gzip.compress((inputs / "x.sam").read_bytes()))
    (inputs / "mis" / "f").write_bytes((inputs / "x.bam").read_bytes())
    one = headers.open_inputs(spark, [str(inputs / "mis"), str(inputs / "x.s*")])
    assert [f.kind for f in one.files] == ["bam", "sam.gz", "sam", "sam", "sam.gz", "bam.gz", "sam"] and [f.references for f in one.files] == [3, 2, 2, 2, 2, 2, 2]
    rows = files.read_alignments(spark, one).groupBy("file_no").count().collect()
    assert {r[0]: r[1] for r in rows} == {0: len(records), **dict.fromkeys(range(1, 7), 3)}
    cols = ["qname", "flag", "tid", "rname", "ref_len", "pos", "end_pos", "qlen", "seq", "nm", "as_score"]
    every = {k: sorted(map(str, files.read_alignments(spark, one).where(F.col("file_no") == k).select(cols).collect())) for k in range(1, 7)}
    assert every[1] == every[2] == every[3] == every[4] == every[6] and len(every[5]) == 3
    one.close()
    with pytest.raises(FileNotFoundError):
        headers.open_inputs(spark, str(inputs / "none"))
    assert not store.readable("viewfs://x/y") and store.readable(f"file://{path}")


def test_text_that_only_spark_opens(spark, inputs, monkeypatch):
    monkeypatch.setattr(store, "readable", lambda path: False)
    (inputs / "y z.sam").write_text("\n".join(SAM[2:]) + "\n")
    one = headers.open_inputs(spark, [str(inputs / "x.sam"), str(inputs / "y z.sam")])
    assert [(f.kind, f.references, f.order) for f in one.files] == [("text", 2, {"SO": "queryname"}), ("text", 1, {})]
    rows = files.read_alignments(spark, one).orderBy("file_no", "ord").collect()
    assert [(r["file_no"], r["qname"], r["tid"], r["ref"], r["ref_len"]) for r in rows] == [(0, "r1", 0, 0, 200), (0, "r2", -1, None, None), (0, "r1", 1, 1, 90), (1, "r1", -1, None, None), (1, "r2", -1, None, None), (1, "r1", 0, 1 << 32, 90)]
    assert [r["line"] for r in one.reference_lines(one.files[1]).collect()] == ["@SQ\tSN:A2\tLN:90"]


def test_large_dictionary(spark, tmp_path, monkeypatch):
    """A header of many blocks is read once; ranges don't parse it, and names come by a join when they are many."""
    names = [(f"reference_{i:06d}", 100 + i) for i in range(60_000)]
    head = bam_files.header_bytes("@HD\tVN:1.6\n", names)
    out = bam_files.Blocked()
    out.write(head)  # records begin inside the header's last block
    for i in range(500):
        raw = struct.pack("<iiBBHHHiiii", i * 100, 5, 3, 60, 0, 1, 0, 4, -1, -1, 0) + b"r1\0" + struct.pack("<I", 4 << 4) + b"\x12\x48" + b"\xff" * 4
        out.write(struct.pack("<i", len(raw)) + raw)
    out.flush()
    (tmp_path / "many.bam").write_bytes(out.taken() + bam_files.END_OF_FILE)
    one = headers.open_inputs(spark, str(tmp_path / "many.bam"))
    monkeypatch.setattr(bam_files, "HeaderReader", None)
    assert one.count == 60_000 and one.files[0].where.block > 0
    for most in (500_000, 10):
        monkeypatch.setattr(headers, "BROADCAST_REFERENCES", most)
        rows = files.read_alignments(spark, one, split=20_000).collect()
        assert len(rows) == 500 and all(r["rname"] == f"reference_{r['tid']:06d}" and r["ref_len"] == 100 + r["tid"] and r["tid"] % 100 == 0 for r in rows)


TWO = {
    "one.sam": ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:A\tLN:100", "@SQ\tSN:B\tLN:200", "r1\t0\tA\t1\t60\t10M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:0", "r2\t0\tB\t1\t60\t10M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:1"],
    "two.sam": ["@SQ\tSN:B\tLN:200\tM5:x", "@SQ\tSN:C\tLN:300", "@SQ\tSN:D\tLN:9", "r1\t0\tB\t1\t60\t10M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:0", "r1\t0\tC\t1\t60\t10M\tB\t5\t0\tACGTACGTAC\t*\tNM:i:2", "r9\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*"],
}


@pytest.fixture
def two(tmp_path):
    for name, lines in TWO.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    (tmp_path / "nodes.dmp").write_text("5\t|\t9\t|\tspecies\t|\n6\t|\t9\t|\tspecies\t|\n9\t|\t1\t|\tgenus\t|\n1\t|\t1\t|\tno rank\t|\n")
    (tmp_path / "names.dmp").write_text("".join(f"{t}\t|\t{n}\t|\t\t|\tscientific name\t|\n" for t, n in ((5, "five"), (6, "six"), (9, "nine"), (1, "root"))))
    (tmp_path / "acc.tsv").write_text("a\tb\tc\nx\tA\t5\nx\tB\t6\nx\tC\t6\n")
    return tmp_path


def test_files_keep_their_dictionaries(spark, two, capsys):
    """References of two files are never put together, whatever their numbers; totals come from the same pass."""
    paths = ["-b", f"{two}/one.sam", "-b", f"{two}/two.sam"]
    run(spark, ["refstats", *paths, "-k", "3", "--outstat", f"{two}/ref", "-o", f"{two}/out"])
    rows = sorted((r["file"][-7:], r["Id"], r["Length"], r["num_alns"], r["num_reads"]) for r in files.read_stats(spark, f"{two}/ref").collect())
    assert rows == [("one.sam", "A", 100, 1, 1), ("one.sam", "B", 200, 1, 1), ("two.sam", "B", 200, 1, 1), ("two.sam", "C", 300, 1, 1)]
    said = capsys.readouterr().err
    assert "5 alignments, 4 passed" in said and "4 reads, 4 passed" in said and "5 references, 4 passed" in said  # one file is sorted by coordinate
    for number, name in enumerate(TWO):
        records = [r[0] for r in spark.read.text(f"{two}/out.{name}.{number}/records").collect()]
        head = [r[0] for r in spark.read.text(f"{two}/out.{name}.{number}/header").collect()]
        assert records == [x for x in TWO[name] if x[0] == "r" and "\t4\t*" not in x]
        assert [x for x in head if x.startswith("@SQ")] == [x for x in TWO[name] if x.startswith("@SQ") and "SN:D" not in x]
    tables = ["-a", f"{two}/acc.tsv", "-n", f"{two}/names.dmp", "-d", f"{two}/nodes.dmp"]
    run(spark, ["refstats", *paths, *tables, "-k", "3", "--outstat", f"{two}/ref2"])
    assert sorted((r["file"][-7:], r["Id"], r["taxID"]) for r in files.read_stats(spark, f"{two}/ref2").collect()) == [("one.sam", "A", 5), ("one.sam", "B", 6), ("two.sam", "B", 6), ("two.sam", "C", 6)]
    assert "1 of 5 references" in capsys.readouterr().err
    run(spark, ["taxstats", *paths, *tables, "--rank", "species", "-k", "3", "--outstat", f"{two}/tax", "--onlypresent", f"{two}/present"])
    got = sorted((r["file"][-7:], r["taxid"], r["num_accessions"], r["total_length"], r["num_alns"], r["num_reads"]) for r in files.read_stats(spark, f"{two}/tax").collect())
    assert got == [("one.sam", 5, 1, 100, 1, 1), ("one.sam", 6, 1, 200, 1, 1), ("two.sam", 6, 2, 500, 2, 1)]
    said = capsys.readouterr().err
    assert "5 alignments, 4 passed" in said and "3 reads, 3 passed" in said and "3 taxa out of 4 references" in said
    assert sorted(r["accession"] for r in files.read_stats(spark, f"{two}/present").collect()) == ["A", "B", "C"]
    run(spark, ["bamstats", *paths, "--outstat", f"{two}/bam", "--printdists", f"{two}/d"])
    assert sorted((r["name"], r["aln"], r["tbases"]) for r in files.read_stats(spark, f"{two}/bam").collect()) == [("one.sam", 2, 300), ("two.sam", 2, 500)]
    dist = {r["length"]: r["n"] for r in files.read_stats(spark, f"{two}/d.two.sam.1.rlen.dists.txt").collect()}
    assert len(dist) == 256 and dist[10] == 1 and sum(dist.values()) == 1
    run(spark, ["alnfilt", *paths, "-o", f"{two}/f", "--mode", "RNDTOP", "--minani", "0"])
    assert [r[0][:2] for r in spark.read.text(f"{two}/f.one.sam.0/records").collect()] == ["r1", "r2"] and spark.read.text(f"{two}/f.two.sam.1/records").count() == 1


def test_totals_equal_summaries(spark, two):
    """What is observed in the one pass is what queries over the same alignments give."""
    from strandlake.config import StatConfig
    from strandlake.plans import refstats as ref
    from strandlake.plans import release

    with Session(spark, [f"{two}/one.sam", f"{two}/two.sam"]) as one:
        cfg = StatConfig(minreads=1, minreflen=150, ksize=3)
        stats = one.refstats(cfg)
        stats.write.format("noop").mode("overwrite").save()
        n, want = one.totals(), ref.summary(one.alignments, stats, cfg, key="ref").first()
        assert (n["alns"], n["reads"], n["passed_alns"], n["passed_reads"], n["groups"]) == tuple(want[c] for c in ("alns", "reads", "passed_alns", "passed_reads", "passed_refs")) == (3, 3, 3, 3, 3)
        assert n["records"] == 5 and one.by_coordinate and not one.grouped
        release(stats)


def test_accession_map_as_parquet(spark, inputs):
    acc = files.read_acc2tax(spark, str(inputs / "acc.tsv"))
    sinks.write_accessions(taxonomy.accession_table(acc), str(inputs / "acc.parquet"))
    again = files.read_acc2tax(spark, str(inputs / "acc.parquet"))
    assert {tuple(r) for r in taxonomy.accessions(again, "ord").collect()} == {tuple(r) for r in taxonomy.accessions(acc, "ord").collect()}


def test_taxonomy_files(spark, inputs):
    acc, nodes, names = files.load_taxonomy(spark, *(str(inputs / f) for f in ("acc.tsv", "names.dmp", "nodes.dmp")))
    assert {tuple(r) for r in taxonomy.accessions(acc, "ord").collect()} == {("A1", 5), ("A3", 7)} and taxonomy.conflicts(acc).first()[0] == 1
    assert {r["taxid"]: r["name"] for r in names.collect()}[5] == "bar" and {r["taxid"]: r["rank"] for r in nodes.collect()}[9] == "genus"


def test_commands(spark, inputs):
    tables = ["-a", f"{inputs}/acc.tsv", "-n", f"{inputs}/names.dmp", "-d", f"{inputs}/nodes.dmp"]
    run(spark, ["refstats", "-b", f"{inputs}/x.sam", *tables, "-k", "3", "--outstat", f"{inputs}/ref", "-o", f"{inputs}/out", "--onlypresent", f"{inputs}/present"])
    stats = {r["Id"]: r for r in files.read_stats(spark, f"{inputs}/ref").collect()}
    assert stats["A1"]["taxID"] == 5 and stats["A2"]["taxID"] == 0 and stats["A1"]["num_covbases"] == 12
    lines = [r[0] for r in spark.read.text(f"{inputs}/out/records").collect()]
    assert lines[0].startswith(SAM[3].rsplit("\tNM", 1)[0]) and "8M2D2M" in lines[0] and lines[0].endswith("XT:i:5\tXR:i:9")
    assert len(lines) == 2 and "XR:i:9" in "".join(r[0] for r in spark.read.text(f"{inputs}/out/records").collect())
    run(spark, ["taxstats", "-b", f"{inputs}/x.sam", *tables, "-k", "3", "--outstat", f"{inputs}/tax"])
    assert [(r["taxid"], r["name"], r["num_alns"]) for r in files.read_stats(spark, f"{inputs}/tax").collect()] == [(9, "g", 1)]
    run(spark, ["bamstats", "-b", f"{inputs}/x.bam", "--outstat", f"{inputs}/bam", "--printdists", f"{inputs}/d"])
    assert files.read_stats(spark, f"{inputs}/bam").first()["aln"] == 2
    run(spark, ["alnfilt", "-b", f"{inputs}/x.sam", "-o", f"{inputs}/f"])
    assert [r[0] for r in spark.read.text(f"{inputs}/f/records").collect()] == [SAM[5]]
    (inputs / "list").write_text(f"{inputs}/x.sam\n\n")
    run(spark, ["alnfilt", "--filelist", f"{inputs}/list", "--mode", "RNDTOP", "--seed", "3", "-t", "4", "--verbose", "-o", f"{inputs}/g"])
    assert [r[0] for r in spark.read.text(f"{inputs}/g/records").collect()] == [SAM[5]]
    run(spark, ["alnfilt", "-b", f"{inputs}/x.bam", "-o", f"{inputs}/h.bam", "--onefile"])
    assert (inputs / "h.bam").is_file() and files.read_alignments(spark, f"{inputs}/h.bam").count() == 1
    run(spark, ["taxstats", "-b", f"{inputs}/x.sam", *tables, "-k", "3", "--minmani", "99", "--qsize", "9", "--outstat", f"{inputs}/none"])
    assert files.read_stats(spark, f"{inputs}/none").count() == 0
    run(spark, ["refstats", "-b", f"{inputs}/x.bam", "-k", "3", "--outstat", f"{inputs}/r2", "-o", f"{inputs}/y.bam"])
    assert files.read_alignments(spark, f"{inputs}/y.bam").count() == 2
    run(spark, ["cmpstat", "-1", f"{inputs}/ref", "-2", f"{inputs}/ref", "-p", "3", "-q", "4", "--outstat", f"{inputs}/cmp"])
    assert files.read_stats(spark, f"{inputs}/cmp").count() == 2
    with pytest.raises(SystemExit):
        run(spark, ["refstats", "-b", f"{inputs}/x.sam", "-n", "only"])

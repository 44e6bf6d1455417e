import gzip
import io
import random
import struct

import pytest

from readqc.plans.engine import run
from readqc.sources import bgzf, sniff
from readqc.sources.files import read_files


def some_reads(n=400, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.randint(1, 80)
        out.append((f"A:1:F:1:{1101 + i % 3}:1:{i}", "".join(r.choice("ACGTN") for _ in range(k)), "".join(chr(r.randint(35, 74)) for _ in range(k))))
    out[5] = (out[5][0], "ACGT", "@@+@")
    out[7] = (out[7][0], "", "")
    return out


def fastq(reads):
    return "".join(f"@{n}\n{s}\n+{n if i % 2 else ''}\n{q}\n" for i, (n, s, q) in enumerate(reads)).encode()


TURN = str.maketrans("ACGT", "TGCA")


def sam(reads):
    lines = ["@HD\tVN:1.6", "@SQ\tSN:c\tLN:9"]
    for i, (n, s, q) in enumerate(reads):
        flag = 16 if i % 2 else 0
        s, q = (s.translate(TURN)[::-1], q[::-1]) if flag else (s, q)
        lines.append("\t".join([n, str(flag), "*", "0", "0", "*", "*", "0", "0", s or "*", q or "*"] + (["X:i:1"] if i % 3 else [])))
    return ("\n".join(lines) + "\n").encode()


def bam(reads, quals=True):
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9)
    codes = {b: i for i, b in enumerate("=ACMGRSVTWYHKDBN")}
    for i, (n, s, q) in enumerate(reads):
        flag = 16 if i % 2 else 0
        s, q = (s.translate(TURN)[::-1], q[::-1]) if flag else (s, q)
        nibbles = [codes[b] for b in s] + [0] * (len(s) % 2)
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(n) + 1, 0, 0, 0, flag, len(s), -1, -1, 0) + n.encode() + b"\0"
        body += bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2])) + (bytes(ord(c) - 33 for c in q) if quals else b"\xff" * len(s))
        out += struct.pack("<i", len(body)) + body
    return bgzf.deflate(out, 500)


def members(data, n=3):
    step = len(data) // n + 1
    return b"".join(gzip.compress(data[i : i + step]) for i in range(0, len(data), step))


FORMS = {"x.fq": (fastq, "fastq"), "x.fq.gz": (lambda r: members(fastq(r)), "fastq_gz"), "b.fq.gz": (lambda r: bgzf.deflate(fastq(r), 700), "fastq_bgzf"), "x.sam": (sam, "sam"), "x.bam": (bam, "bam")}


@pytest.mark.parametrize("name", FORMS)
@pytest.mark.parametrize("split", [None, 777])
def test_every_format_gives_the_same_reads(spark, tmp_path, name, split):
    reads = some_reads()
    make, kind = FORMS[name]
    path = tmp_path / name
    path.write_bytes(make(reads))
    assert sniff.detect(str(path)) == kind
    rows = sorted(read_files(spark, [str(path)], split_bytes=split).collect(), key=lambda r: int(r.name.rpartition(":")[2]))
    assert [(r.name, r.seq, r.qual or "") for r in rows] == reads
    index = iter(range(len(reads)))
    assert [r.read_idx for r in rows if r.seq] == [next(index) for r in rows if r.seq]


@pytest.mark.parametrize("split", [1, 10, 37, 100])
def test_tiny_splits_lose_and_repeat_nothing(spark, tmp_path, split):
    reads = some_reads(40)
    path = tmp_path / "x.fq"
    path.write_bytes(fastq(reads))
    assert sorted(r.name for r in read_files(spark, [str(path)], split_bytes=max(split, len(fastq(reads)) // 60), index=False).collect()) == sorted(n for n, _, _ in reads)


def test_last_record_without_newline_and_cut_record(spark, tmp_path):
    a, b, c = tmp_path / "a.fq", tmp_path / "b.fq", tmp_path / "c.fq"
    a.write_bytes(b"@x\nAC\n+\nII\n@y\nGG\n+\nII")
    b.write_bytes(b"@x\r\nAC\r\n+\r\nII\r\n@y\nGG\n")
    c.write_bytes(b"")
    rows = read_files(spark, [str(a), str(b), str(c)]).collect()
    assert sorted((r.file_id, r.name, r.seq) for r in rows) == [(0, "x", "AC"), (0, "y", "GG"), (1, "x", "AC")]


def test_bad_records(spark, tmp_path):
    path = tmp_path / "bad.fq"
    path.write_bytes(b"@x\nACG\n+\nII\n@y\nGG\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        read_files(spark, [str(path)], index=False).collect()
    assert [r.name for r in read_files(spark, [str(path)], mode="DROPMALFORMED").collect()] == ["y"]
    odd = tmp_path / "odd.txt"
    odd.write_bytes(b"hello\nworld\n")
    with pytest.raises(ValueError, match="neither"):
        sniff.detect(str(odd))


def test_bam_without_qualities(spark, tmp_path):
    path = tmp_path / "n.bam"
    path.write_bytes(bam([("r", "ACGTA", "IIIII")], quals=False))
    r = read_files(spark, [str(path)]).first()
    assert (r.seq, r.qual) == ("ACGTA", None)


def test_reports(spark, tmp_path):
    paths = []
    for name in ("one.fq", "two.bam", "three.fq"):
        p = tmp_path / name
        p.write_bytes(b"" if name == "three.fq" else FORMS["x.fq" if name == "one.fq" else "x.bam"][0](some_reads(120)))
        paths.append(str(p))
    folders = run(spark, paths, str(tmp_path / "out"))
    one, two, three = ([open(f"{f}/{n}").read() for n in ("fastqc_data.txt", "summary.txt", "preseq_hist.txt", "fastqc_report.html")] for f in folders)
    assert one[0].replace("one.fq", "two.bam").replace("FASTQ", "BAM") == two[0]
    assert one[0].count(">>END_MODULE") == 11 and "Total Sequences\t120" in one[0] and len(one[1].splitlines()) == 11
    assert one[3].count("<section>") == 11 and "Total Sequences\t0" in three[0]


def test_modes(spark, tmp_path):
    from readqc.config import MODULES, RunMode

    path = tmp_path / "one.fq"
    path.write_bytes(fastq(some_reads(150)))
    plain = RunMode()
    every = frozenset(MODULES)
    texts = {}
    for name, mode in {"plain": plain, "orig": RunMode(original_duplicates=True), "preseq": RunMode(preseq=True), "all": RunMode(enabled=every, groups=True, bisulfite=True)}.items():
        (folder,) = run(spark, [str(path)], str(tmp_path / name), mode)
        texts[name] = open(f"{folder}/fastqc_data.txt").read()
    assert texts["plain"] == texts["orig"] == texts["preseq"]
    assert texts["all"].count(">>END_MODULE") == 12 and "\n10-11\t" in texts["all"]


def test_gzip_that_is_cut_short_is_an_error(spark, tmp_path):
    data = members(fastq(some_reads()))
    for name, part in (("a.fq.gz", data[:-20]), ("b.fq.gz", data[: len(data) // 2]), ("c.fq.gz", gzip.compress(fastq(some_reads()))[:-4])):
        path = tmp_path / name
        path.write_bytes(part)
        with pytest.raises(Exception, match="cut short"):
            read_files(spark, [str(path)], index=False).collect()


def test_a_gzip_file_is_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from readqc.sources import fastq as source

    reads = [(f"r{i}:{i}", "ACGT" * (i % 7), "IIII" * (i % 7)) for i in range(30_000)]
    path = tmp_path / "x.fq.gz"
    path.write_bytes(gzip.compress(fastq(reads), 1))
    one = source.BlockReader({"files": f'[[0, "{path}", "fastq_gz"]]'})
    monkeypatch.setattr(source, "BLOCK", 1 << 12)
    assert len([b for p in one.partitions() for b in one.read(p)]) > 20
    rows = read_files(spark, [str(path)])
    assert [(r.name, r.seq, r.qual) for r in sorted(rows.collect(), key=lambda r: int(r.name.rpartition(":")[2]))] == reads
    some = rows.where("seq <> ''").orderBy(F.split("name", ":")[1].cast("int")).select("read_idx").collect()
    assert [r.read_idx for r in some] == list(range(len(some)))


@pytest.mark.parametrize("split", [300, 1500, 10_000])
def test_bam_splits_lose_and_repeat_nothing(spark, tmp_path, split):
    reads = some_reads(300) + [("long:0", "ACGT" * 900, "IIII" * 900)] + some_reads(50, 9)
    path = tmp_path / "x.bam"
    path.write_bytes(bam(reads))
    rows = read_files(spark, [str(path)], split_bytes=split).collect()
    assert sorted((r.name, r.seq, r.qual or "") for r in rows) == sorted(reads)
    index = iter(range(len(reads)))
    want = {i: next(index) for i, (_, s, _) in enumerate(reads) if s}
    assert sorted(r.read_idx for r in rows if r.seq) == sorted(want.values())


def test_bam_that_is_cut_short_is_an_error(spark, tmp_path):
    whole = bam(some_reads(60))
    inner = b"".join(d for _, d in bgzf.blocks(io.BytesIO(whole), 0, len(whole), True))
    for cut in (1, 5, 40, 70):
        path = tmp_path / f"cut{cut}.bam"
        path.write_bytes(bgzf.deflate(inner[:-cut], 500))
        with pytest.raises(Exception, match="ends inside a record"):
            read_files(spark, [str(path)], index=False).collect()


@pytest.mark.parametrize("piece", [64, 5000])
def test_bam_by_pieces(spark, tmp_path, monkeypatch, piece):
    from readqc.sources.bam import BamReader
    from readqc.sources import bam as source

    monkeypatch.setattr(source, "PIECE", piece)
    reads = some_reads(200) + [("long:0", "ACGTN" * 900, "I#@J?" * 900)] + some_reads(30, 9)
    path = tmp_path / "x.bam"
    path.write_bytes(bam(reads))
    for split in (700, 10**6):
        reader = BamReader({"files": f'[[0, "{path}", "bam"]]', "splitbytes": str(split)})
        got = [(r["name"], r["seq"], r["qual"] or "") for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert got == reads


def test_sam_reads_are_numbered_without_an_exchange(spark, tmp_path):
    paths = []
    for i in range(2):
        path = tmp_path / f"s{i}.sam"
        path.write_bytes(sam(some_reads(300, i)))
        paths.append(str(path))
    rows = read_files(spark, paths, index=False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        for i in range(2):
            got = [r.read_idx for r in sorted(read_files(spark, paths).where(f"file_id = {i}").collect(), key=lambda r: int(r.name.rpartition(":")[2])) if r.seq]
            assert got == list(range(len(got)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_many_sam_files_are_one_scan(spark, tmp_path):
    paths = []
    for i in range(3):
        path = tmp_path / f"s {i}.sam"
        path.write_bytes(sam(some_reads(20 + i, i)))
        paths.append(str(path))
    rows = read_files(spark, paths)
    got = sorted((r.file_id, r.file_name, r.name, r.seq) for r in rows.collect())
    assert got == sorted((i, f"s {i}.sam", n, s) for i in range(3) for n, s, _ in some_reads(20 + i, i))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 2  # for the rows, and for the totals of splits


def test_reads_stay_where_they_are_when_numbered(spark, tmp_path):
    path = tmp_path / "x.fq"
    path.write_bytes(fastq(some_reads()))
    plan = read_files(spark, [str(path)])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_reports_are_the_same_for_any_partitions(spark, tmp_path):
    path = tmp_path / "one.fq"
    path.write_bytes(fastq(some_reads(300)))
    texts = set()
    for i, split in enumerate((None, 5000, 900)):
        (folder,) = run(spark, [str(path)], str(tmp_path / f"out{i}"), split_bytes=split)
        texts.add(open(f"{folder}/fastqc_data.txt").read())
    assert len(texts) == 1


def test_strides_of_several_files(spark, monkeypatch):
    from readqc.operators import duplicates
    from readqc.plans.analysis import Analysis
    from readqc.schema import READS

    monkeypatch.setattr(duplicates, "FULL", 50)
    rows = [(f, "f", i, "r", "ACGT"[i % 4] * 5, "IIIII") for f, n in ((0, 20), (1, 60), (2, 170)) for i in range(n)]
    got = {(r.file_id, r.seq): r.n for r in Analysis(spark.createDataFrame(rows, READS)).key_counts.collect()}
    want = {}
    for f, _, i, _, s, _ in rows:
        if i % {0: 1, 1: 2, 2: 4}[f] == 0:
            want[f, s] = want.get((f, s), 0) + 1
    assert got == want

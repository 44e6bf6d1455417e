"""FASTQ with bad places: no record is lost but those that are broken, for any split."""

import gzip

import pytest

from readqc.sources import bgzf
from readqc.sources.fastq import Records, Split, FastqReader, COLUMNS
from readqc.sources.files import read_files, read_malformed

RECORDS = [(f"r{i}", "ACGTN"[: 1 + i % 5] * (1 + i % 3), "@+IF#"[: 1 + i % 5] * (1 + i % 3)) for i in range(24)]
TEXTS = [f"@{n}\n{s}\n+\n{q}\n" for n, s, q in RECORDS]


def damaged(k, how):
    """The text with record k damaged, and the names that must be left."""
    lines = TEXTS[k].splitlines(keepends=True)
    if how == "blank before":
        return "".join([*TEXTS[:k], "\n", *TEXTS[k:]]), set(range(24))
    if how == "extra line":
        return "".join([*TEXTS[:k], "what is this\n", *TEXTS[k:]]), set(range(24))
    if how.startswith("missing"):
        del lines[int(how[-1])]
    elif how == "short qualities":
        lines[3] = "I" * (len(lines[3]) + 1) + "\n"
    elif how == "no plus":
        lines[2] = "x\n"
    return "".join([*TEXTS[:k], "".join(lines), *TEXTS[k + 1 :]]), set(range(24)) - {k}


HOWS = ["blank before", "extra line", "missing 0", "missing 1", "missing 2", "missing 3", "short qualities", "no plus"]


def names(data, kind, split, tmp_path, mode="DROPMALFORMED"):
    path = tmp_path / "x"
    path.write_bytes(data)
    reader = FastqReader({"files": f'[[0, "{path}", "{kind}"]]', "splitbytes": str(split), "mode": mode}, list(COLUMNS))
    return [(r["name"], r["seq"], r["qual"], r["local"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("how", HOWS)
def test_every_place_and_split(tmp_path, how):
    for k in (0, 1, 7, 12, 22, 23):
        text, left = damaged(k, how)
        for split in [*range(9, 60, 5), 97, 200, 10_000]:
            got = [x[:3] for x in names(text.encode(), "fastq", split, tmp_path)]
            # an end without enough lines is a bad place, too
            assert got == [RECORDS[i] for i in sorted(left)], (k, split)


@pytest.mark.parametrize("how", HOWS)
def test_compressed(tmp_path, how):
    from readqc.sources import fastq

    text, left = damaged(9, how)
    want = [RECORDS[i] for i in sorted(left)]
    for split in (60, 150, 10_000):
        assert [x[:3] for x in names(bgzf.deflate(text.encode(), 50), "fastq_bgzf", split, tmp_path)] == want
    assert [x[:3] for x in names(gzip.compress(text.encode()), "fastq_gz", 1, tmp_path)] == want
    one = fastq.gunzip
    for step in (1, 7, 40):  # pieces that end anywhere
        fastq.gunzip = lambda f, step=step: (d[i : i + step] for d in [b"".join(one(f))] for i in range(0, len(d), step))
        try:
            assert [x[:3] for x in names(gzip.compress(text.encode()), "fastq_gz", 1, tmp_path)] == want
        finally:
            fastq.gunzip = one


def test_what_was_left_out(spark, tmp_path):
    text, _ = damaged(5, "missing 1")
    text = text[: text.index("@r15")] + "two odd\nlines\n" + text[text.index("@r15") :] + "@cut\nACG\n"
    path = tmp_path / "x.fq"
    path.write_text(text)
    for split in (None, 40, 77):
        rows = read_malformed(spark, [str(path)], split).collect()
        assert sorted((r.lines, r.text) for r in rows) == [(2, "@cut\nACG\n"), (2, "two odd\nlines\n"), (3, "".join(TEXTS[5].splitlines(keepends=True)[i] for i in (0, 2, 3)))]
        assert read_files(spark, [str(path)], split, mode="DROPMALFORMED").count() == 23


def test_whole_files_read_as_before(tmp_path):
    text = "".join(TEXTS).encode()
    for split in (10, 33, 1000):
        assert names(text, "fastq", split, tmp_path) == names(text, "fastq", split, tmp_path, "FAILFAST")
    found, bad, at, _ = Records.found(text)
    assert not bad and at == len(text) and len(found.starts) == 24 and found.good().all()
    assert Records.found(b"")[1:] == ([], 0, False)
    with pytest.raises(ValueError, match="mode"):
        FastqReader({"files": "[]", "mode": "ODD"}, list(COLUMNS))
    assert isinstance(Split(0, "a", "b", "fastq", 0, 1, 1), Split)

"""BAM in splits of all sizes against the rows that were written, and tags that keep their codes."""

import random
import struct
from contextlib import contextmanager

import pytest

from strandloom.sources import bam, sam

KIND = ", ".join(f"{c} {k}" for c, k in zip(bam.COLUMNS, bam.KINDS)) + ", tags map<string, struct<code: string, value: string>>"
TYPED = [("BC", "Z", "0012"), ("XI", "i", "-70000"), ("XU", "i", "4000000000"), ("XF", "f", "1.5"), ("XG", "f", "0.1"), ("XE", "f", "1e-20"), ("XA", "A", "c"), ("XB", "B", "c,1,-2"), ("XS", "B", "S,65535"), ("XR", "B", "f,0.25,3"), ("XH", "H", "1AFF"), ("XZ", "Z", ""), ("RG", "Z", "12345"), ("CO", "Z", "é: a:b")]


@contextmanager
def splits(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.set(k, str(size))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def some(n, r, contigs, extra=()):
    out = []
    for i in range(n):
        k = r.randint(0, 90)
        t = r.choice([c for c, _ in contigs] + ["*"])
        out.append({"qname": f"read/{i}", "flag": r.choice([0, 16, 99]), "rname": t, "pos": r.randint(1, 500) if t != "*" else 0, "mapq": r.randint(0, 60), "cigar": f"{k}M" if k else "*", "rnext": "=" if t != "*" and r.random() < 0.5 else "*", "pnext": 0, "tlen": r.randint(-9, 9), "seq": "".join(r.choice("ACGTN") for _ in range(k)) or "*", "qual": "".join(chr(33 + r.randint(0, 60)) for _ in range(k)) or "*", "tags": {"NM": ("C", str(r.randint(0, 255))), "RG": ("Z", f"group {i}")} | dict(extra)})
    return out


def plain(row):
    return {k: tuple(sorted((t, *((v["code"], v["value"]) if isinstance(v, dict) else v)) for t, v in x.items())) if k == "tags" else x for k, x in row.items()}


def told(df):
    return sorted((plain(r.asDict(True)) for r in df.collect()), key=lambda r: r["qname"])


def chain(data, size):
    """Blocks of `size` bytes, wherever records end."""
    return b"".join(bam.blocks(data[i : i + size]) for i in range(0, len(data), size)) + bam.END_BLOCK


CONTIGS = [(f"contig{i}", 1000 + i) for i in range(40)]


@pytest.mark.parametrize("size", [20_001, 60_000])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, size):
    r = random.Random(4)
    rows = some(4000, r, CONTIGS)
    tid = {n: i for i, (n, _) in enumerate(CONTIGS)}
    data = bam.bam_header(CONTIGS, "@CO\tnaïve\n") + b"".join(bam.bam_record(x, tid) for x in rows)
    (tmp_path / "x.bam").write_bytes(chain(data, 3000))
    with splits(spark, size):
        found = sam.read_bam(spark, f"{tmp_path}/x.bam")
    want = sorted(map(plain, rows), key=lambda x: x["qname"])
    assert told(found) == want


def test_a_header_longer_than_a_split_and_several_files(spark, tmp_path):
    r = random.Random(5)
    for i, names in enumerate(([f"a{j}" * 9 for j in range(3000)], ["b"], [])):
        contigs = [(n, 7) for n in names]
        rows = [x | {"qname": f"{i}/{x['qname']}"} for x in some(30, r, contigs)]
        (tmp_path / f"{i}.bam").write_bytes(bam.bam_bytes(rows, contigs, "@CO\tlong\n" * 5000))
        (tmp_path / f"{i}.rows").write_text(repr(rows))
    want = sorted((plain(x) for i in range(3) for x in eval((tmp_path / f"{i}.rows").read_text())), key=lambda x: x["qname"])
    with splits(spark, 9000):
        assert told(sam.read_bam(spark, f"{tmp_path}/*.bam")) == want


@pytest.mark.parametrize("size", [4001, 9000])
def test_the_mark_of_a_block_inside_one_and_records_of_many_blocks(spark, tmp_path, size):
    r = random.Random(6)
    mark = ",".join(map(str, bam.MARK))
    rows = some(60, r, CONTIGS, [("XB", ("B", f"C,{mark},1,2,{mark}")), ("XL", ("Z", "long " * 300))])
    rows += [some(1, r, CONTIGS, [("XL", ("Z", "x" * 30_000))])[0] | {"qname": "zz"}]
    tid = {n: i for i, (n, _) in enumerate(CONTIGS)}
    data = bam.bam_header(CONTIGS) + b"".join(bam.bam_record(x, tid) for x in rows)
    stored = b"".join(bam.blocks(data[i : i + 900], 0) for i in range(0, len(data), 900)) + bam.END_BLOCK
    assert stored.count(bam.MARK) > len(data) // 900 + 100
    (tmp_path / "x.bam").write_bytes(stored)
    with splits(spark, size):
        assert told(sam.read_bam(spark, f"{tmp_path}/x.bam")) == sorted(map(plain, rows), key=lambda x: x["qname"])


def test_damage_is_an_error(spark, tmp_path):
    data = bytearray(bam.bam_bytes(some(500, random.Random(7), CONTIGS), CONTIGS))
    (tmp_path / "cut.bam").write_bytes(data[: len(data) - 400])
    data[len(data) // 2] ^= 1
    (tmp_path / "bad.bam").write_bytes(data)
    (tmp_path / "no.bam").write_bytes(b"BAM\1 in plain bytes")
    with splits(spark, 9000):
        for name in ("cut", "bad", "no"):
            with pytest.raises(Exception):
                sam.read_bam(spark, f"{tmp_path}/{name}.bam").collect()


def test_tags_and_headers_survive_text_and_bam(spark, tmp_path):
    line = "r1\t0\tc1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\t" + "\t".join(":".join(t) for t in TYPED)
    records = sam.records_of(spark.createDataFrame([(line,)], "value string"))
    header = sam.header_text(spark, [("c1", 100), ("ç2", 5)], "own", comments=("é ü 漢",))
    for mode in ("wb", "wu", "wh"):
        sam.write(records, header, [("c1", 100), ("ç2", 5)], f"{tmp_path}/{mode}", mode)
        back = sam.read_sam(spark, f"{tmp_path}/{mode}") if mode == "wh" else sam.read_bam(spark, f"{tmp_path}/{mode}")
        assert [r.value for r in sam.text_of(back).collect()] == [line]
    with splits(spark, 150):
        assert [r.value for r in sam.text_of(sam.read_bam(spark, f"{tmp_path}/wb")).collect()] == [line]
    typed = {"qname": "r", "flag": 0, "rname": "*", "pos": 0, "mapq": 0, "cigar": "*", "rnext": "*", "pnext": 0, "tlen": 0, "seq": "*", "qual": "*", "tags": {"a" + c: (c, "7") for c in "cCsSiI"}}
    (tmp_path / "codes.bam").write_bytes(bam.bam_bytes([typed], []))
    assert told(sam.read_bam(spark, f"{tmp_path}/codes.bam")) == [plain(typed)]
    assert "aI:i:7" in sam.text_of(sam.read_bam(spark, f"{tmp_path}/codes.bam")).first().value


def test_plain_tags_keep_leading_zeros(spark):
    rows = [("r", {"BC": "0012", "NM": "3", "N0": "0", "NN": "-5", "XX": "-0"})]
    df = spark.createDataFrame(rows, "qname string, tags map<string,string>")
    text = sam.text_of(df.selectExpr("qname", *(f"cast(null as string) as {c}" for c in bam.COLUMNS[2:]), "0 as flag", "tags")).first().value
    assert text.split("\t")[11:] == ["BC:Z:0012", "N0:i:0", "NM:i:3", "NN:i:-5", "XX:Z:-0"]


def test_first_record_is_found_among_noise():
    r = random.Random(8)
    rows = some(12, r, CONTIGS)
    tid = {n: i for i, (n, _) in enumerate(CONTIGS)}
    parts = [bam.bam_record(x, tid) for x in rows]
    data = b"".join(parts)
    for cut in (1, 17, len(parts[0]) - 1):
        assert bam.first_record(data[cut:], True) == len(parts[0]) - cut
    assert bam.first_record(struct.pack("<i", 5) * 50, True) is None

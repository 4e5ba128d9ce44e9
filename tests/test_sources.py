"""Files written and read again."""

import bz2
import gzip
import random

import pytest

from strandloom.sources import fasta, fastq, sam
from strandloom.streaming import reads as streaming


def test_fasta(spark, tmp_path):
    text = "\n>c1 first one\nACgt\nNN\r\n\n>c2\tx\nTTTT\n>c3\n\n"
    for name, opened in (("a.fa", open), ("b.fa.gz", gzip.open), ("c.fa.bz2", bz2.open)):
        with opened(f"{tmp_path}/{name}", "wt", newline="") as f:
            f.write(text)
        got = [tuple(r) for r in fasta.read_fasta(spark, f"{tmp_path}/{name}").collect()]
        assert got == [("c1", "first one", "ACGTNN"), ("c2", "x", "TTTT"), ("c3", "", "")]
    assert fasta.read_fasta(spark, f"{tmp_path}/a.fa", mask_lower=True).first().seq == "ACNNNN"
    long = spark.createDataFrame([("n", "c", "ACGT" * 40), ("m", "", "A")], "name string, comment string, seq string")
    fasta.write_fasta(long, f"{tmp_path}/out", compression="gzip")
    assert sorted(map(tuple, fasta.read_fasta(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, long.collect()))
    (tmp_path / "bad.fa").write_text(">x\nAC1T\n")
    with pytest.raises(Exception, match="not a sequence"):
        fasta.read_fasta(spark, f"{tmp_path}/bad.fa").collect()


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 note\nACGT\nAC\n+r1\n@III\nII\n\n@r2\nA\n+\n5\n")
    got = [tuple(r)[1:] for r in fastq.read_fastq(spark, f"{tmp_path}/a.fastq").collect()]
    assert got == [(0, "r1", "note", "ACGTAC", "@IIIII"), (1, "r2", "", "A", "5")]
    df = fastq.read_fastq(spark, f"{tmp_path}/a.fastq")
    assert fastq.encoding(df, ["file", "ordinal"]).first().encoding == "standard"
    fastq.write_fastq(df, f"{tmp_path}/out", illumina=True, compression="bzip2")
    back = fastq.read_fastq(spark, f"{tmp_path}/out/*.bz2", illumina=True)
    assert sorted((r.id, r.seq, r.qual) for r in back.collect()) == [("r1", "ACGTAC", "@IIIII"), ("r2", "A", "5")]
    with pytest.raises(Exception, match="read too long"):
        fastq.read_fastq(spark, f"{tmp_path}/a.fastq", longest=3).collect()
    for broken in ("@r\nACGT\n+\nII\n", "r\nA\n+\nI\n", "@r\nACGT\n"):
        (tmp_path / "bad.fastq").write_text(broken)
        with pytest.raises(Exception):
            fastq.read_fastq(spark, f"{tmp_path}/bad.fastq").collect()


ROWS = [{"qname": "a", "flag": 0, "rname": "c1", "pos": 5, "mapq": 60, "cigar": "4M", "rnext": "*", "pnext": 0, "tlen": 0, "seq": "ACGT", "qual": "IIII", "tags": {"NH": {"code": "i", "value": "1"}, "RG": {"code": "Z", "value": "x"}}}, {"qname": "b", "flag": 4, "rname": "*", "pos": 0, "mapq": 0, "cigar": "*", "rnext": "*", "pnext": 0, "tlen": 0, "seq": "ACN", "qual": "*", "tags": {}}]
KIND = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string, struct<code: string, value: string>>"


def test_sam(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KIND)
    header = sam.header_text(spark, [("c1", 100)], "own", "g", "s", ("a:b\tc",))
    sam.write_sam(df, header, f"{tmp_path}/sam")
    assert sorted((r.asDict(True) for r in sam.read_sam(spark, f"{tmp_path}/sam").collect()), key=lambda r: r["qname"]) == ROWS
    h = sam.read_header(spark, f"{tmp_path}/sam")
    assert [tuple(r) for r in sam.targets(h).collect()] == [("c1", 100)] and not sam.is_sorted(h)
    assert sam.merged(h.unionByName(h)).count() == h.count()
    assert sam.kind("x.bam") == "bam" and sam.kind("-") == "stdin"
    with pytest.raises(ValueError):
        sam.kind("x.sam.gz")


def test_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(sam.bam_bytes(ROWS, [("c1", 100)], "@HD\tVN:1.0\n"))
    assert [r.asDict(True) for r in sam.read_bam(spark, f"{tmp_path}/x.bam").collect()] == ROWS


def test_stream_of_reads(spark, tmp_path):
    reads = spark.createDataFrame([(1, "ACGTACGTAC", "IIIIIIIIII"), (2, "ACGT", "!!!!")], "read_id long, seq string, qual string")
    reads.write.parquet(f"{tmp_path}/in")
    from strandloom.config import SearchConf, TrimConf

    stream = streaming.trimmed_stream(streaming.read_stream(spark, f"{tmp_path}/in", reads.schema.simpleString()[7:-1].replace(":", " ")), TrimConf(min_size=3))
    q = stream.writeStream.format("memory").queryName("trimmed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.read_id, r.discarded) for r in spark.table("trimmed").collect()} == {(1, False), (2, True)}
    got = []
    q = streaming.search_stream(streaming.read_stream(spark, f"{tmp_path}/in", "read_id long, seq string"), spark.createDataFrame([(5, "TTACGTACGTAC")], "contig_id long, seq string"), SearchConf(), lambda df, n: got.extend(df.collect()), f"{tmp_path}/state")
    q.awaitTermination(60)
    assert {(r.read_id, r.pos) for r in got} >= {(1, 2)}


def test_headers_and_regions(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KIND)
    lines = spark.createDataFrame([("@RG\tID:x\tLB:lib",), ("@HD\tVN:1.0\tSO:coordinate",), ("@SQ\tSN:c1\tLN:9",)], "value string")
    h = sam.header_of(lines)
    assert {r.qname: r.library for r in sam.with_library(df, h).collect()} == {"a": "lib", "b": None}
    assert sam.is_sorted(h) and not sam.is_sorted(sam.header_of(sam.unsorted(lines)))
    from pyspark.sql import functions as F

    assert {r.qname: tuple(r.tags["NH"]) for r in sam.with_tag(df, "NH", F.lit(7)).collect()} == {"a": ("i", "7"), "b": ("i", "7")}
    assert [tuple(r) for r in sam.targets(sam.retargeted(h, spark.createDataFrame([("z", 4)], "name string, length long"))).collect()] == [("z", 4)]
    assert [r.qname for r in sam.in_region(df, "c1", 7, 8).collect()] == ["a"] and sam.in_region(df, "c1", 8, 20).count() == 0
    sam.write_sorted(df, f"{tmp_path}/sorted", 2)
    assert spark.read.parquet(f"{tmp_path}/sorted").count() == 2


def test_routes_forms_and_dispatch(spark, tmp_path):
    reads = spark.createDataFrame([("a", "x", "ACGT", "IIII", "paired", 2, 3, False), ("b", None, "GG", "II", "unpaired", None, None, True), ("c", None, "T", "I", None, 1, 1, False)], "id string, comment string, seq string, qual string, route string, good_start int, good_stop int, discarded boolean")
    fastq.write_routed(reads, f"{tmp_path}/routed")
    assert sorted(p.name for p in (tmp_path / "routed").glob("route=*")) == ["route=paired", "route=unpaired"]
    assert [r.id for r in fastq.read_fastq(spark, f"{tmp_path}/routed/route=paired").collect()] == ["a"]
    fastq.write_routed(reads.drop("comment"), f"{tmp_path}/plain")
    assert {f: [(r.seq, r.qual) for r in fastq.record_of(reads, f).orderBy("id").collect()][0] for f in ("trimmed", "masked", "original")} == {"trimmed": ("CG", "II"), "masked": ("aCGt", "IIII"), "original": ("ACGT", "IIII")}
    with pytest.raises(ValueError):
        fastq.record_of(reads, "other")
    (tmp_path / "one.txt").write_text("junk\n@r x\nACGT\n+\nIIII\n".removeprefix("junk\n"))
    (tmp_path / "two.txt").write_text(">c some\nACG\nT\n")
    assert [tuple(r) for r in fastq.read_records(spark, f"{tmp_path}/one.txt").collect()] == [("r", "x", "ACGT", "IIII")]
    assert [tuple(r) for r in fastq.read_records(spark, f"{tmp_path}/two.txt").collect()] == [("c", "some", "ACGT", None)]
    # A folder of both: each file by its own first mark.
    (tmp_path / "both").mkdir()
    (tmp_path / "both" / "a b.txt").write_text("\n@r x\nACGT\n+\n>III\n")
    (tmp_path / "both" / "c.txt").write_text("\n>c some@\nACG\nT\n")
    (tmp_path / "both" / "d.txt").write_text("\n")
    assert sorted(tuple(r) for r in fastq.read_records(spark, f"{tmp_path}/both").collect()) == [("c", "some@", "ACGT", None), ("r", "x", "ACGT", ">III")]
    assert {(r.file[-5:], r.form) for r in fastq.forms(spark, f"{tmp_path}/both").collect()} == {("b.txt", "fastq"), ("c.txt", "fasta")}
    with pytest.raises(Exception, match="too long"):
        fastq.read_fastq(spark, f"{tmp_path}/one.txt", longest=3).collect()
    assert fastq.read_fastq(spark, f"{tmp_path}/one.txt", longest=4).count() == 1


def test_tables_and_header_checks(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("c1\t10\nc2\t20\n")
    assert {tuple(r) for r in sam.targets_of_table(spark, f"{tmp_path}/h.tsv").collect()} == {("c1", 10), ("c2", 20)}
    (tmp_path / "h2.tsv").write_text("c1\t10\nc1\t20\n")
    with pytest.raises(Exception, match="duplicate contig name"):
        sam.targets_of_table(spark, f"{tmp_path}/h2.tsv").collect()
    line = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    a, b = sam.header_of(line("@HD\tVN:1.0", "@SQ\tSN:c1\tLN:9")), sam.header_of(line("@SQ\tLN:8\tSN:c1", "@XX\tA:1", "@SQ\tSN:c2"))
    assert sam.problems(a).count() == 0 and {r.problem for r in sam.problems(b).collect()} == {"unknown type", "without LN"}
    with pytest.raises(Exception, match="headers differ at c1"):
        sam.merged(a.unionByName(b)).collect()
    assert sam.header_differences(a, a).count() == 0 and {r.only_in for r in sam.header_differences(a, b).collect()} == {1, 2}
    same = sam.header_of(line("@SQ\tLN:9\tSN:c1", "@HD\tVN:1.0"))
    assert sam.header_differences(a, same).count() == 0
    assert [r.value for r in sam.renamed(line("@SQ\tSN:chr1\tLN:9", "chr1"), "chr([0-9]+)", "$1").collect()] == ["@SQ\tSN:1\tLN:9", "chr1"]


def test_packed_bases():
    for seq in ("", "A", "ACGTN", "=ACMGRSVTWYHKDBN", "acgtx"):
        assert sam.unpacked_bases(sam.packed_bases(seq), len(seq)) == seq.upper().replace("X", "N")


@pytest.mark.parametrize("size", [37, 120, 1 << 20])
def test_one_file_read_by_many_tasks(spark, tmp_path, size):
    """Qualities that begin with @, splits of all kinds of places, against the reader of whole files."""
    r = random.Random(size)
    lines = []
    for i in range(60):
        n = r.randint(1, 12)
        lines.append(f"@read{i} c{i}\n{''.join(r.choice('ACGT') for _ in range(n))}\n+\n{''.join(r.choice('@@I+A') for _ in range(n))}\n")
    (tmp_path / "a.fastq").write_text("".join(lines))
    (tmp_path / "b.fastq").write_text("".join(lines[:7]).rstrip("\n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(size))
        got = fastq.read_split(spark, f"{tmp_path}/*.fastq")
        rows = {(x.file[-7:], x.ordinal, x.id, x.comment, x.seq, x.qual) for x in got.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {(x.file[-7:], x.ordinal, x.id, x.comment, x.seq, x.qual) for x in fastq.read_fastq(spark, f"{tmp_path}/*.fastq").collect()}
    assert rows == want and len(want) == 67
    (tmp_path / "c.fastq").write_text("@x\nAC\nGT\n+\nIIII\n")
    with pytest.raises(Exception, match="four lines"):
        fastq.read_split(spark, f"{tmp_path}/c.fastq").collect()

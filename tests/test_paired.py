"""Two files of mates to records and back."""

import random
import re

import pytest

from strandloom.config import PairConf, SearchConf, TrimConf
from strandloom.operators import paired, pairs
from strandloom.sources import bam, fastq, sam


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """Four contigs, and pairs: facing, repeated in two contigs, one mate lost, both lost, contaminated, of low quality."""
    folder = tmp_path_factory.mktemp("mates")
    r = random.Random(31)
    texts = {c: "".join(r.choice("ACGT") for _ in range(400)) for c in range(3)}
    texts[3] = texts[0][100:160] + "".join(r.choice("ACGT") for _ in range(200))
    bad = "".join(r.choice("ACGT") for _ in range(100))
    other = lambda: "".join(r.choice("ACGT") for _ in range(30))
    mates = [
        (texts[1][50:80], revcomp(texts[1][150:180])),
        (texts[0][20:50], revcomp(texts[0][110:140])),  # the second is in contig 3 too
        (texts[2][10:40], other()),
        (other(), revcomp(texts[2][300:330])),
        (other(), other()),
        (bad[20:50], revcomp(texts[1][200:230])),
        (texts[1][60:90], texts[1][100:130]),
    ]
    for i in (0, 1):
        lines = []
        for n, m in enumerate(mates):
            q = "!" * 30 if n == 6 and i else "I" * 28 + "##" if n == 0 and not i else "I" * 30
            lines.append(f"@pair{n}/{i + 1}\n{m[i]}\n+\n{q}\n")
        (folder / f"reads_{i + 1}.fastq").write_text("".join(lines))
    files = [fastq.read_fastq(spark, f"{folder}/reads_{i}.fastq").select("ordinal", "id", "seq", "qual") for i in (1, 2)]
    contigs = spark.createDataFrame([(c, f"chr{c}", t) for c, t in texts.items()], "contig_id long, name string, seq string")
    poison = spark.createDataFrame([(0, "phage", bad)], "contig_id long, name string, seq string")
    return pairs.zipped(*files), contigs, poison, texts, mates


def aligned(case, **more):
    zipped, contigs, poison, _, _ = case
    return paired.align(zipped, contigs, SearchConf(errors=2), TrimConf(min_size=20), PairConf(0, 300), poison, group="g", program="p", **more)


def test_records_of_pairs(case):
    texts = case[3]
    got = {}
    for x in aligned(case).collect():
        got[x.qname, 1 if x.flag & 64 else 2] = x
    assert len(got) == 14 and {n for n, _ in got} == {f"pair{i}" for i in range(7)}
    a, b = got["pair0", 1], got["pair0", 2]
    assert (a.flag, b.flag) == (1 + 2 + 32 + 64, 1 + 2 + 16 + 128) and (a.rname, a.pos, b.pos) == ("chr1", 51, 151) and (a.rnext, a.pnext, b.pnext) == ("=", 151, 51)
    assert a.tlen == -b.tlen == 180 - 51 and a.cigar == "28M2S" and b.cigar == "30M" and b.seq == texts[1][150:180] and (a.mapq, b.mapq) == (60, 60)
    assert {k: v.value for k, v in a.tags.items()} == {"RG": "g", "PG": "p", "NM": "0", "NH": "1", "IH": "1", "HI": "1"}
    second = got["pair1", 2]  # of two hits the one near the mate, whatever comes first
    assert (second.rname, second.pos, second.mapq, second.tags["NH"].value, second.tags["IH"].value) == ("chr0", 111, 0, "2", "1")
    lost = got["pair2", 2]
    assert lost.flag == 1 + 4 + 128 and (lost.rname, lost.pos, lost.cigar, lost.mapq) == ("chr2", 11, "*", 0) and got["pair2", 1].flag == 1 + 8 + 64 and (got["pair2", 1].rnext, got["pair2", 1].pnext) == ("=", 11)
    assert got["pair3", 1].flag == 1 + 4 + 32 + 64 and got["pair3", 1].pos == 301
    for i in (1, 2):
        assert got["pair4", i].flag == 1 + 4 + 8 + 64 * i and (got["pair4", i].rname, got["pair4", i].pos, got["pair4", i].rnext, got["pair4", i].pnext) == ("*", 0, "*", 0)
    assert got["pair5", 1].tags["XC"].value == "phage" and got["pair5", 1].flag & 4 and got["pair5", 2].flag == 1 + 8 + 16 + 128
    assert got["pair6", 2].flag == 1 + 4 + 128 + 512 and got["pair6", 1].flag == 1 + 8 + 64  # its own state decides about each mate


def test_methods_and_secondary_records(case):
    zipped, contigs, _, _, _ = case
    for method, n in (("none", 0), ("first", 7), ("second", 7), ("both", 14)):
        assert aligned(case, method=method).count() == n
    with pytest.raises(ValueError):
        aligned(case, method="all")
    every = paired.align(zipped, contigs, SearchConf(errors=2, print_first=None), TrimConf(min_size=20)).where("qname = 'pair1' and flag & 128 > 0").orderBy("flag").collect()
    assert [(x.rname, x.flag & 256, x.tags["HI"].value, x.tags["IH"].value) for x in every] == [("chr0", 0, "1", "2"), ("chr3", 256, "2", "2")]


def test_mates_with_indels(spark, case):
    zipped, contigs, _, texts, _ = case
    from pyspark.sql import functions as F

    read = texts[1][50:65] + texts[1][67:82]
    changed = zipped.where("ordinal = 0").withColumn("seq1", F.lit(read)).withColumn("qual1", F.lit("I" * 30))
    rows = {x.flag & 64: x for x in paired.align(changed, contigs, SearchConf(errors=1, indels=True, indels_max=3), TrimConf(min_size=20)).collect()}
    assert rows[64].pos == 51 and sum(int(n) for n, o in re.findall(r"(\d+)([MD])", rows[64].cigar) if o == "D") == 2 and rows[64].tags["NM"].value == "2" and rows[0].cigar == "30M"


def test_to_sam_and_bam_and_back(spark, case, tmp_path):
    rows = aligned(case).cache()
    contigs = [(f"chr{c}", len(t)) for c, t in case[3].items()]
    header = sam.header_text(spark, contigs, "p", "g")
    want = sorted(map(repr, ({**x.asDict(True), "tags": sorted((k, *v) for k, v in x.tags.items())} for x in rows.collect())))
    back = lambda df: sorted(map(repr, ({**x.asDict(True), "tags": sorted((k, *v) for k, v in x.tags.items())} for x in df.collect())))
    sam.write(rows, header, contigs, f"{tmp_path}/out.sam", "wh")
    assert back(sam.read(spark, f"{tmp_path}/out.sam")) == want and sam.targets(sam.read_header(spark, f"{tmp_path}/out.sam")).count() == 4
    for mode in ("wb", "wu"):
        path = f"{tmp_path}/{mode}.bam"
        sam.write(rows.repartition(3), header, contigs, path, mode)
        assert back(sam.read(spark, path)) == want
        # The files in order of their paths are one BAM file.
        parts = sorted((tmp_path / f"{mode}.bam").glob("*/part-*"))
        one = b"".join(p.read_bytes() for p in parts)
        assert one.endswith(bam.END_BLOCK) and len(parts) >= 2
        (tmp_path / f"one_{mode}.bam").write_bytes(one)
        assert back(sam.read_bam(spark, f"{tmp_path}/one_{mode}.bam")) == want
    sam.write(rows, header, contigs, f"{tmp_path}/hex.sam", "wx")
    lines = [x.value for x in spark.read.option("recursiveFileLookup", "true").text(f"{tmp_path}/hex.sam").collect()]
    assert len(lines) == 14 and all(re.fullmatch("0x[0-9a-f]+", x.split("\t")[1]) for x in lines)
    with pytest.raises(ValueError):
        sam.write(rows, header, contigs, f"{tmp_path}/no", "r")


def test_records_turned_round(spark, case):
    rows = aligned(case)
    twice = sam.reversed_records(sam.reversed_records(rows))
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, rows.collect()))
    one = sam.reversed_records(rows.where("qname = 'pair0' and flag & 64 > 0")).first()
    assert (one.cigar, one.flag, one.seq) == ("2S28M", 99 ^ 16, revcomp(case[4][0][0])) and one.qual == "##" + "I" * 28

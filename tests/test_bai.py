"""The index of BAM files against its form read plainly, and regions against a scan."""

import random
import re
import struct

import pytest

from strandloom.sources import bai, bam
from strandloom.sources.ranged import Ranged
from tests.test_bam import chain

CONTIGS = [("a", 400_000), ("empty", 50), ("b", 70_000), ("last", 9)]


def ends(row):
    span = sum(int(n) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"]) if o in "MDN=X") or 1
    return row["pos"] - 1, row["pos"] - 1 + span


def records(n, r):
    """Sorted records: many at one place, long skips, lost ones with and without a place."""
    out = []
    for i in range(n):
        name, size = r.choice([CONTIGS[0], CONTIGS[0], CONTIGS[2]])
        k = r.randint(1, 60)
        row = {"qname": f"q{i}", "flag": r.choice([0, 16]), "rname": name, "pos": 20_000 if r.random() < 0.3 else r.randint(1, size - 200), "mapq": 3, "cigar": f"{k}M", "rnext": r.choice(["=", "*", "b"]), "pnext": 7, "tlen": 0, "seq": "".join(r.choice("ACGT") for _ in range(k)), "qual": "*", "tags": {"NM": ("C", "1")}}
        if r.random() < 0.05:
            row |= {"cigar": f"{k}M{r.randint(1, 60_000)}N1M", "seq": row["seq"] + "A"}
        if r.random() < 0.03:
            row |= {"flag": 4, "cigar": "*"}
        out.append(row)
    order = {n: i for i, (n, _) in enumerate(CONTIGS)}
    out.sort(key=lambda x: (order[x["rname"]], x["pos"]))
    return out + [out[0] | {"qname": f"lost{i}", "flag": 4, "rname": "*", "pos": 0, "cigar": "*"} for i in range(11)]


def made(tmp_path, rows, block):
    tid = {n: i for i, (n, _) in enumerate(CONTIGS)}
    path = tmp_path / "x.bam"
    path.write_bytes(chain(bam.bam_header(CONTIGS) + b"".join(bam.bam_record(x, tid) for x in rows), block))
    return f"file://{path}"


def places(path):
    """(tid, bin, begin, end, lost, place, place of what follows) of each record, read from one end to the other."""
    data = open(path.removeprefix("file://"), "rb").read()
    text, begins, at = b"", [], 0
    while at < len(data):
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        held = bam.block_of(data[at : at + size])
        if held:
            begins.append((len(text), at))
        text, at = text + held, at + size
    begins.append((len(text), len(data)))

    def place(x):
        b, p = max(y for y in begins if y[0] <= x)
        return p << 16 | x - b

    at, out = bam.header_end(text), []
    while at < len(text):
        n, tid, pos, name, more = struct.unpack_from("<iiiII", text, at)
        ops = struct.unpack_from(f"<{more & 0xFFFF}I", text, at + 36 + (name & 0xFF))
        out.append((tid, name >> 16, pos, pos + (sum(o >> 4 for o in ops if (o & 15) in (0, 2, 3, 7, 8)) or 1), more >> 18 & 1, place(at), place(at + 4 + n)))
        at += 4 + n
    return out


def parsed(path):
    data = open(path.removeprefix("file://"), "rb").read()
    assert data[:4] == b"BAI\1"
    n_ref, at, out = struct.unpack_from("<i", data, 4)[0], 8, []
    for _ in range(n_ref):
        n, at = struct.unpack_from("<i", data, at)[0], at + 4
        bins = {}
        for _ in range(n):
            key, m = struct.unpack_from("<Ii", data, at)
            bins[key] = list(struct.iter_unpack("<QQ", data[at + 8 : at + 8 + 16 * m]))
            at += 8 + 16 * m
        n = struct.unpack_from("<i", data, at)[0]
        out.append((bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    assert len(data) == at + 8
    return out, struct.unpack_from("<Q", data, at)[0]


@pytest.mark.parametrize("block, size", [(3000, 20_001), (700, 9_000), (60_000, 1 << 27)])
def test_index_has_the_form_and_regions_equal_a_scan(spark, tmp_path, block, size):
    r = random.Random(block)
    rows = records(3000, r)
    path = made(tmp_path, rows, block)
    index = bai.index_of(spark, path, size)
    bai.write_bai(index, path, f"{path}.bai")
    contigs, lost = parsed(f"{path}.bai")
    all_ = places(path)
    assert lost == 11 and len(contigs) == len(CONTIGS) and contigs[1] == contigs[3] == ({}, [])
    for tid in (0, 2):
        bins, windows = contigs[tid]
        own = [x for x in all_ if x[0] == tid]
        counts = bins.pop(37450)
        assert counts == [(own[0][5], own[-1][6]), (sum(not x[4] for x in own), sum(x[4] for x in own))]
        assert set(bins) == {x[1] for x in own}
        for _, b, _, _, _, lo, hi in own:
            assert any(c <= lo and hi <= d for c, d in bins[b])
        for b, chunks in bins.items():
            assert {c for c, _ in chunks} <= {x[5] for x in own if x[1] == b} and {d for _, d in chunks} <= {x[6] for x in own if x[1] == b}
            assert all(d >> 16 < c >> 16 for (_, d), (c, _) in zip(chunks, chunks[1:]))
        before = 0
        for w, place in enumerate(windows):
            before = min((x[5] for x in own if x[2] >> 14 <= w <= x[3] - 1 >> 14), default=before)
            assert place == before
        assert len(windows) == max(x[3] - 1 >> 14 for x in own) + 1
    regions = [(n, b := r.randint(-5, s), b + r.choice([0, 1, 50, 20_000, s])) for n, s in r.choices(CONTIGS, k=500)] + [("a", 19_999, 20_000)]
    found = bai.in_regions(spark, path, f"{path}.bai", regions)
    want = sorted((i, x["qname"]) for i, (n, b, e) in enumerate(regions) for x in rows if x["rname"] == n and max(b, 0) < e and ends(x)[0] < e and ends(x)[1] > max(b, 0))
    assert sorted((x.region, x.qname) for x in found.select("region", "qname").collect()) == want
    one = {x["qname"]: x for x in rows}
    for x in found.limit(50).collect():
        y = one[x.qname]
        assert (x.rname, x.pos, x.cigar, x.seq, x.flag) == (y["rname"], y["pos"], y["cigar"], y["seq"], y["flag"])
        assert x.rnext == ("=" if y["rnext"] == y["rname"] else y["rnext"]) and x.tags["NM"] == ("C", "1")


def test_a_region_reads_its_chunks_only(spark, tmp_path):
    rows = records(20_000, random.Random(1))
    path = made(tmp_path, rows, 4000)
    index = bai.index_of(spark, path, 100_000)
    bai.write_bai(index, path, f"{path}.bai")
    where = (0, 200_000, 200_500)
    with Ranged(path, 1 << 12) as file:
        n = 0
        for i, lo, hi in bai.chunks(f"{path}.bai", [where]):
            n += sum(b.num_rows for b in bai.found_in(file, i, lo, hi, [c for c, _ in CONTIGS], where, {}))
        assert n == sum(x["rname"] == "a" and ends(x)[0] < 200_500 and ends(x)[1] > 200_000 for x in rows) > 0
        assert file.taken < file.size / 4


def test_what_cannot_be_indexed_is_an_error(spark, tmp_path):
    rows = records(800, random.Random(2))
    with pytest.raises(Exception, match="order"):
        bai.index_of(spark, made(tmp_path, rows[::-1], 900))
    swapped = rows[400:] + rows[:400]
    with pytest.raises(Exception, match="order"):
        bai.index_of(spark, made(tmp_path, swapped, 900), 5000)
    path = made(tmp_path, rows, 900)
    data = open(path.removeprefix("file://"), "rb").read()
    open(path.removeprefix("file://"), "wb").write(data[: len(data) // 2])
    with pytest.raises(Exception):
        bai.index_of(spark, path, 5000)
    (tmp_path / "x.bam").write_bytes(b"plain text")
    with pytest.raises(Exception):
        bai.index_of(spark, path)


def test_an_empty_file_and_an_unknown_contig(spark, tmp_path):
    path = made(tmp_path, [], 900)
    index = bai.index_of(spark, path)
    assert index.count() == 0
    bai.write_bai(index, path, f"{path}.bai")
    assert parsed(f"{path}.bai") == ([({}, [])] * len(CONTIGS), 0)
    assert bai.in_regions(spark, path, f"{path}.bai", [("a", 0, 100)]).count() == 0
    with pytest.raises(ValueError, match="no such contig"):
        bai.in_regions(spark, path, f"{path}.bai", [("zz", 0, 100)])

"""The index of FASTA files against plain reading, in ranges of all sizes; fetched bases against slices."""

import random

import pytest

from strandloom.sources import fai
from strandloom.sources.ranged import Ranged


def some(r, n):
    """Text of records and (name, sequence) of each: one or many lines, \\r\\n or \\n, blank lines around, empty ones."""
    text, want = [r.choice(["", "\n", "\r\n\n"])], []
    for i in range(n):
        seq = "".join(r.choice("ACGTacgtN") for _ in range(r.choice([0, 1, 7, 60, 61, 300, 2000])))
        width, end = r.choice([1, 7, 60, 5000]), r.choice(["\n", "\r\n"])
        head = f">n{i}" + r.choice(["", " a comment > with marks", "\ttab"])
        lines = [seq[j : j + width] for j in range(0, len(seq), width)]
        text.append(end.join([head, *lines]) + end + r.choice(["", "", end, "\n\n"]))
        want.append((f"n{i}", seq))
    return "".join(text), want


@pytest.mark.parametrize("size, window", [(1, 1), (7, 3), (50, 11), (333, 64), (10**6, 10**6)])
def test_ranges_of_all_sizes_tell_the_same(tmp_path, size, window):
    for seed in range(12):
        r = random.Random(seed)
        text, want = some(r, 12)
        if seed % 3 == 0:
            text = text.rstrip("\r\n")
        path = tmp_path / "x.fa"
        path.write_bytes(text.encode())
        rows, cut = [], []
        for start in range(0, len(text), size):
            with Ranged(str(path), window) as file:
                for x in fai.pieces_of(file, str(path), start, min(len(text), start + size)):
                    (rows if x[7] is None else cut).append(x)
        rows += [tuple(x.values()) for x in fai._stitched(None, fai.pa.Table.from_batches([fai._rows(cut)])).to_pylist()] if cut else []
        assert sorted((x[1], x[2]) for x in rows) == sorted((n, len(s)) for n, s in want)
        for _, name, length, offset, bases, width, *_ in rows:
            seq = dict(want)[name]
            for i in {0, length // 2, length - 1} if length else ():
                assert text[offset + i // bases * width + i % bases] == seq[i]


def test_index_file_and_regions(spark, tmp_path):
    r = random.Random(77)
    text, want = some(r, 200)
    path = f"{tmp_path}/x.fa"
    with open(path, "w", newline="") as out:
        out.write(text)
    index = fai.index_of(spark, path, 1000)
    fai.write_fai(index, path, f"{path}.fai")
    lines = [x.split("\t") for x in open(f"{path}.fai").read().splitlines()]
    assert [(x[0], int(x[1])) for x in lines] == [(n, len(s)) for n, s in want]
    back = fai.read_fai(spark, f"{path}.fai", path)
    seqs = dict(want)
    regions = {(n, b := r.randint(-3, len(s) + 3), b + r.randint(0, 200)) for n, s in want} | {("unknown", 0, 5)}
    asked = spark.createDataFrame(sorted(regions), "name string, begin long, end long")
    for each in (index, back):
        found = {(x["name"], x.begin, x.end): x.seq for x in fai.fetch(each, asked).collect()}
        assert found == {(n, b, e): seqs[n].upper()[max(b, 0) : max(e, 0)] for n, b, e in regions if n in seqs}
    long = max(want, key=lambda x: len(x[1]))
    parts = fai.pieces(index, spark.createDataFrame([(long[0], 5, 1500)], "name string, begin long, end long"), 100).orderBy("start").collect()
    assert len(parts) == 15 and "".join(x.seq for x in parts) == long[1].upper()[5:1500]


@pytest.mark.parametrize("text", [">a\nACGT\nAC\nACGT\n", ">a\nAC\nACGT\n", ">a\nACGT\n\nACGT\n", "ACGT\n>a\nAC\n", ">a\nACGT\nACGT\r\nACGT\n"])
@pytest.mark.parametrize("size", [3, 1000])
def test_uneven_lines_are_an_error(spark, tmp_path, text, size):
    (tmp_path / "x.fa").write_text(text, newline="")
    with pytest.raises(Exception, match="one length|begin with"):
        fai.index_of(spark, f"{tmp_path}/x.fa", size).collect()


def test_only_a_region_is_read(tmp_path):
    (tmp_path / "x.fa").write_text(">a\n" + ("A" * 60 + "\n") * 10_000)
    with Ranged(f"{tmp_path}/x.fa", 1) as file:
        file.bytes(300_000, 500)
        assert file.taken == 500


def test_compressed_and_changed_files_are_errors(spark, tmp_path):
    (tmp_path / "x.fa.gz").write_bytes(b"\x1f\x8b\n")
    with pytest.raises(Exception, match="compressed"):
        fai.index_of(spark, f"{tmp_path}/x.fa.gz").collect()
    (tmp_path / "y.fa").write_text(">a\nACGT\nACGT\n")
    from strandloom.operators.kept import kept

    index = kept(fai.index_of(spark, f"{tmp_path}/y.fa"), "index")
    (tmp_path / "y.fa").write_text(">a\nA\nC\nGTACGT\n")
    with pytest.raises(Exception, match="isn't the file"):
        fai.fetch(index, spark.createDataFrame([("a", 0, 6)], "name string, begin long, end long")).collect()

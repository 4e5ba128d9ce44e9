"""Few records of a BAM file are objects at once, whatever a split or a batch holds."""

import pyarrow as pa

from strandloom.sources import bam


def test_records_are_decoded_in_portions():
    row = {"flag": 4, "rname": "*", "pos": 0, "mapq": 0, "cigar": "*", "rnext": "*", "pnext": 0, "tlen": 0, "seq": "ACGTN", "qual": "*"}
    rows = [{"qname": f"q{i}", **row, "tags": {"XA": ("A", "O"), "XB": ("B", f"S,{i % 65536},7")} if i % 3 else {}} for i in range(20000)]
    parts = bam.bam_bytes(rows, []).split(bam.MARK)
    batch = pa.RecordBatch.from_pydict({"path": ["f"] * len(parts), "start": [0] * len(parts), "value": parts})
    found = [b for b in bam._parsed(iter([batch])) if b.column("qname")[0].is_valid]
    most = bam.PORTION // min(len(bam.bam_record(r, {})) for r in rows)
    assert len(found) > 2 and all(b.num_rows <= most + 1 for b in found)
    got = [(r["qname"], dict(r["tags"])) for b in found for r in b.select(["qname", "tags"]).to_pylist()]
    assert got == [(r["qname"], {k: {"code": c, "value": v} for k, (c, v) in r["tags"].items()}) for r in rows]


def test_portions_leave_out_nothing():
    starts = [0, 10, bam.PORTION, bam.PORTION + 5, 3 * bam.PORTION]
    parts = list(bam._portions(starts))
    assert sum(parts, []) == starts and len(parts) == 3 and not list(bam._portions([]))

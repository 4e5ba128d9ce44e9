"""Entries of a pileup against a plain walk along each record; budgets carried from shard to shard against search over all contigs."""

import random

from pyspark.sql import functions as F

from strandloom.config import SearchConf
from strandloom.operators import pileup, search, shards


def walked(name, pos, ops, seq):
    """Rows of one record, position by position: stretches are what lies between clips and skips."""
    out, stretch, ref, query = [], [], pos, 0

    def close():
        matches = [i for i, x in enumerate(stretch) if x[0] == "M"]
        if matches:
            stretch[matches[0]][1]["is_head"] = stretch[matches[-1]][2]["is_tail"] = True
        for a, b in zip(matches, matches[1:]):
            between = [x for x in stretch[a + 1 : b] if x[0] in "ID"]
            padded = stretch[a + 1][0] == "P"
            if between and stretch[a + 1 + padded][0] in "ID":
                stretch[a][2]["indel"] = between[0][3] * (1 if between[0][0] == "I" else -1)
        stretch.clear()

    for n, op in ops:
        if op in "NSH":
            close()
        rows = []
        if op in "M=XD":
            for i in range(n):
                rows.append({"qname": name, "ref": ref + i, "qpos": None if op == "D" else query + i, "is_del": op == "D", "base": None if op == "D" else seq[query + i], "indel": 0, "is_head": False, "is_tail": False})
        if op not in "NSH":
            stretch.append(("M" if op in "=X" else op, rows[0] if rows else None, rows[-1] if rows else None, n))
        out += rows
        ref += n if op in "M=XDN" else 0
        query += n if op in "M=XIS" else 0
    close()
    return out


def test_entries_equal_a_plain_walk(spark):
    r = random.Random(3)
    rows, want = [], []
    for i in range(400):
        ops = [(r.randint(1, 3), "H")] * r.randint(0, 1) + [(r.randint(1, 4), "S")] * r.randint(0, 1)
        for _ in range(r.randint(1, 5)):
            ops += [(r.randint(1, 5), r.choice("MMM=X")), *r.choice([[], [(r.randint(1, 3), "I")], [(r.randint(1, 3), "D")], [(9, "N")]])]
        ops += [(r.randint(1, 5), "M")] + [(2, "S")] * r.randint(0, 1)
        seq = "".join(r.choice("ACGT") for _ in range(sum(n for n, o in ops if o in "M=XIS")))
        rows.append((f"q{i}", 0, 1, 100 + i % 7, "".join(f"{n}{o}" for n, o in ops), seq))
        want += walked(f"q{i}", 100 + i % 7, ops, seq)
    rows += [("none", 0, 1, 5, "*", "ACGT"), ("lost", 4, 1, 5, "4M", "ACGT"), ("null", 0, 1, 5, None, None)]
    df = spark.createDataFrame(rows, "qname string, flag int, contig_id long, pos long, cigar string, seq string")
    found = [x.asDict() for x in pileup.columns(df).drop("flag", "contig_id", "pos").collect()]
    key = lambda x: (x["ref"], x["qname"], x["qpos"] or -1)
    assert sorted(found, key=key) == sorted(want, key=key)
    order = [(x["ref"], x["qname"]) for x in found]
    assert order == sorted(order)


def test_an_insertion_behind_padding(spark):
    df = spark.createDataFrame([("a", 0, 1, 0, "2M1P2I2M", "ACGTAC")], "qname string, flag int, contig_id long, pos long, cigar string, seq string")
    assert [(x.ref, x.qpos, x.indel, x.is_head, x.is_tail) for x in pileup.columns(df).collect()] == [(0, 0, 0, True, False), (1, 1, 2, False, False), (2, 4, 0, False, False), (3, 5, 0, False, True)]


def test_very_many_records_at_one_place_are_dealt_to_tasks(spark):
    rows = spark.range(120_000).select(F.concat(F.lit("q"), "id").alias("qname"), F.lit(0).alias("flag"), F.lit(1).cast("long").alias("contig_id"), F.lit(7).cast("long").alias("pos"), F.lit("1M").alias("cigar"), F.lit("A").alias("seq"))
    sizes = [x["n"] for x in pileup.columns(rows, partitions=8).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 120_000 and max(sizes) < 60_000


def data(spark, r):
    contigs = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 3000))) for _ in range(12)]
    reads = []
    for i in range(80):
        c = r.choice([c for c in contigs if len(c) > 60])
        at = r.randint(0, len(c) - 48)
        seq = list(c[at : at + 48])
        for _ in range(r.randint(0, 4)):
            seq[r.randint(0, 47)] = r.choice("ACGTN")
        reads.append((i, "".join(seq)))
        other = r.randint(0, 11)  # the same place again, with fewer or more differences, in another contig
        contigs[other] += "".join(x if r.random() < 0.95 else r.choice("ACGT") for x in reads[-1][1])
    reads += [(900, ""), (901, "N" * 48), (902, "ACGT" * 12), (900, "")]
    return spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(list(enumerate(contigs)), "contig_id long, seq string").withColumn("shard", F.col("contig_id") % 4)


def test_budgets_carried_over_shards(spark):
    reads, contigs = data(spark, random.Random(9))
    for conf in (SearchConf(errors=4), SearchConf(errors=3, delta=1)):
        cols = ["read_id", "contig_id", "pos", "strand", "nm"]
        want = sorted(map(tuple, search.search(reads, contigs, conf).select(*cols).collect()))
        whole = [search.candidates(search.budget(reads, conf).withColumn("max_errors", F.col("max_errors") + conf.delta), contigs.where(F.col("shard") == s), 48 // (conf.errors + conf.delta + 1)).count() for s in range(4)]
        for order in (None, [3, 1, 0, 2]):
            found, compared = shards.carried(reads, contigs, conf, order)
            assert sorted(map(tuple, found.select(*cols).collect())) == want
            assert len(compared) == 4 and sum(compared) < sum(whole)
            assert compared[0] == whole[0 if order is None else 3]


def test_no_shards_and_no_reads(spark):
    reads, contigs = data(spark, random.Random(10))
    assert shards.carried(reads, contigs.limit(0))[0].count() == 0
    assert shards.carried(reads.limit(0), contigs)[0].count() == 0

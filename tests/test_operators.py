"""Hand-made cases and comparisons with brute force for the operators that SQL can't state."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import MethylConf, PairConf, SearchConf, TrimConf
from strandloom.functions import cigar, sam
from strandloom.functions import seq as S
from strandloom.operators import contigs, dp, methyl, pairs, pileup, search, seeds, shards, trim


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def trimmed(seq, q, m, mean, size):
    first = next((i for i, x in enumerate(q) if x >= m), None)
    if first is None:
        return None
    a, best, at = 0, -1, first
    for i in range(first, len(q)):
        a = max(0, a + q[i] - m)
        if a >= best:
            best, at = a, i
    left, right = first, at
    while left <= right and seq[left] == "N":
        left += 1
    while right >= left and seq[right] == "N":
        right -= 1
    n = right - left + 1
    return (left + 1, right + 1) if n >= size and n > 0 and sum(q[left : at + 1]) // n >= mean else None


def test_trimming_equals_the_recursion(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        n = r.randint(1, 40)
        rows.append((i, "".join(r.choice("ACGTNN") for _ in range(n)), "".join(chr(33 + r.choice([2, 15, 19, 20, 21, 25, 40])) for _ in range(n))))
    rows += [(300, "", ""), (301, "NNNN", "IIII"), (302, "A" * 25, "5" * 25), (303, "A" * 24, "5" * 24)]
    got = {x.id: (x.good_start, x.good_stop) if not x.discarded else None for x in trim.trim(spark.createDataFrame(rows, "id long, seq string, qual string"), TrimConf(20, 20, 5)).collect()}
    assert got == {i: trimmed(s, [ord(c) - 33 for c in q], 20, 20, 5) for i, s, q in rows}


def brute(reads, texts, errors):
    out = set()
    for i, read in reads:
        for strand, p in (("+", read), ("-", revcomp(read))):
            for c, t in texts:
                for pos in range(len(t) - len(p) + 1):
                    nm = sum(a != b for a, b in zip(p, t[pos : pos + len(p)]))
                    if nm <= errors:
                        out.add((i, c, pos, strand, nm))
    return out


@pytest.mark.parametrize("errors", [0, 2, 3])
def test_search_equals_brute_force(spark, errors):
    r = random.Random(errors)
    texts = [(c, "".join(r.choice("ACGT") for _ in range(r.randint(3, 120)))) for c in range(12)] + [(50, "ACGT" * 3), (51, "AC"), (52, "ACGTNACGTACGTTGCANNACGT")]
    reads = []
    for i in range(15):
        c, t = r.choice([x for x in texts if len(x[1]) > 30])
        at = r.randrange(len(t) - 24)
        read = list(t[at : at + r.randint(20, 24)])
        for _ in range(r.randint(0, errors + 1)):
            read[r.randrange(len(read))] = r.choice("ACGT")
        reads.append((i, "".join(read) if i % 2 else revcomp("".join(read))))
    reads += [(90, texts[0][1][:20] if len(texts[0][1]) >= 20 else "ACGTACGTACGTACGTACGT"), (91, "ACGTACGTACGT")]
    got = search.hits(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(texts, "contig_id long, seq string"), SearchConf(errors=errors)).collect()
    assert {(x.read_id, x.contig_id, x.pos, x.strand, x.nm) for x in got} == brute(reads, texts, errors)


def test_bisulfite_differences_are_free_one_way(spark):
    row = spark.createDataFrame([("ATTG", "ACTG", "ACTG", "ATTG", "GAAC", "GGAC")], "a string, b string, c string, d string, e string, f string")
    d = S.bisulfite_distance
    got = row.select(d(F.col("a"), F.col("b"), F.lit("+")), d(F.col("c"), F.col("d"), F.lit("+")), d(F.col("e"), F.col("f"), F.lit("-")), d(F.col("f"), F.col("e"), F.lit("-"))).first()
    assert tuple(got) == (0, 1, 0, 1)


def aligned(read, part, band, **more):
    b = lambda x: np.frombuffer(x.encode(), np.uint8)[None, :]
    score, first, ops = dp.banded(b(read), b(part.ljust(len(read) + 2 * band, "\0")), band, **more)
    return int(score[0]), int(first[0]), dp.cigar(ops[0])


def best_score(read, text):
    """The best score of the whole read against any stretch of a text, by the plain recursion."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(read, 1):
        new = [-2 * i]
        for j, t in enumerate(text, 1):
            new.append(max(row[j - 1] + (1 if c == t else -1), row[j] - 2, new[-1] - 2))
        row = new
    return max(row)


def test_alignment_with_indels():
    assert aligned("ACGTACGT", "ACGTACGTTT", 3, fixed=False)[2] == [(8, "M")]
    text = "ACGTTGCAAGCTTACGGATC"
    score, first, ops = aligned(text[:10] + text[12:], "\0\0\0" + text, 3)
    assert (score, first, sum(n for n, o in ops if o == "D")) == (14, 3, 2)
    assert aligned(text[:9] + "G" + text[9:], "\0\0\0" + text + "AAA", 3)[0] == 18
    assert aligned("TTT", "CCC", 0, free=np.array([[ord("T"), ord("C")]], np.uint8))[0] == 3


def test_indels_anywhere_in_a_read(spark):
    r = random.Random(21)
    texts = {c: "".join(r.choice("ACGT") for _ in range(r.randint(150, 400))) for c in range(6)}
    reads, where = [], {}
    for i in range(60):
        c = r.randrange(6)
        at, gap, cut, n = r.choice([0, len(texts[c]) - 66, r.randrange(len(texts[c]) - 66)]), r.randint(1, 3), r.randint(3, 57), 60
        t = texts[c]
        read = t[at : at + cut] + t[at + cut + gap : at + n + gap] if i % 2 else t[at : at + cut] + "".join(r.choice("ACGT") for _ in range(gap)) + t[at + cut : at + n - gap]
        if i % 3 == 0:
            j = r.randrange(len(read))
            read = read[:j] + r.choice("ACGT") + read[j + 1 :]
        reads.append((i, revcomp(read) if i % 5 == 0 else read))
        where[i] = (c, at, "-" if i % 5 == 0 else "+")
    rd, ct = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame([*texts.items()], "contig_id long, seq string")
    conf = SearchConf(errors=1, indels=True, indels_max=3)
    found = dp.indel_search(rd, ct, conf).collect()
    ungapped = {x.read_id for x in search.hits(rd, ct, conf).collect()}
    by = {i: [x for x in found if x.read_id == i] for i, _ in reads}
    for i, read in reads:
        if i in ungapped:
            assert not by[i]
            continue
        c, at, strand = where[i]
        want = max(best_score(p, t) for t in texts.values() for p in (read, revcomp(read)))
        assert by[i] and {x.score for x in by[i]} == {want}, (i, where[i], by[i], want)
        near = [x for x in by[i] if x.contig_id == c and x.strand == strand]
        assert near and min(abs(x.pos - at) for x in near) <= 3
        for x in by[i]:  # the operations give what is told of them
            p, t, j, k, score, wrong, gaps = read if x.strand == "+" else revcomp(read), texts[x.contig_id], 0, x.pos, 0, 0, 0
            for size, op in re.findall(r"(\d+)([MID])", x.cigar):
                size = int(size)
                if op == "M":
                    same = sum(a == b for a, b in zip(p[j : j + size], t[k : k + size]))
                    score, wrong, j, k = score + 2 * same - size, wrong + size - same, j + size, k + size
                else:
                    score, gaps, j, k = score - 2 * size, gaps + size, j + size * (op == "I"), k + size * (op == "D")
            assert (j, score, wrong, gaps) == (len(p), x.score, x.mismatches, x.indels)


def test_scores_without_operations_are_the_same():
    r = np.random.default_rng(3)
    for n, band in ((1, 0), (7, 2), (40, 5), (60, 3)):
        reads = r.choice(np.frombuffer(b"ACGT", np.uint8), (300, n))
        parts = r.choice(np.frombuffer(b"ACGT", np.uint8), (300, n + 2 * band))
        parts[::3, band : band + n] = reads[::3]
        for i in range(300):  # beyond either end of a contig
            parts[i, : i % (band + 1)] = 0
            parts[i, parts.shape[1] - i % 4 :] = 0 if i % 4 else parts[i, parts.shape[1] - i % 4 :]
        free = np.array([[ord("T"), ord("C")]] * 150 + [[ord("A"), ord("G")]] * 150, np.uint8)
        for f in (None, free):
            assert (np.maximum(dp.scores(reads, parts, band, f), -1000) == np.maximum(dp.banded(reads, parts, band, f)[0], -1000)).all()


@pytest.mark.parametrize("errors, k", [(2, 20), (3, 12), (5, 15)])
def test_index_of_wide_seeds_serves_reads_by_balls(spark, tmp_path, errors, k):
    """Radius 1 and 2, differences anywhere, an N, both strands: the same hits as the search that cuts pieces to fit."""
    r = random.Random(41 + errors)
    texts = [(c, "".join(r.choice("ACGT") for _ in range(700))) for c in range(3)]
    reads = []
    for i in range(60):
        at = r.randrange(660)
        read = list(texts[i % 3][1][at : at + 40])
        for j in r.sample(range(len(read)), r.randint(0, errors)):
            read[j] = r.choice("ACGT") if i % 6 else "N"
        read = "".join(read)
        reads.append((i, revcomp(read) if i % 4 == 0 else read))
    rd, ct = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(texts, "contig_id long, seq string")
    conf = SearchConf(errors=errors)
    seeds.write_search_index(ct, f"{tmp_path}/own", k, partitions=8)
    index = seeds.read_search_index(spark, f"{tmp_path}/own")
    found = search.indexed(rd, index, conf)
    got, want = ({tuple(x) for x in f.collect()} for f in (found, search.search(rd, ct, conf)))
    assert got == want and len(got) > 40
    plan = search.indexed(rd, index, conf)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in above and "seeds_" in below for above, below in zip(plan.splitlines(), plan.splitlines()[1:]))


def test_every_read_within_the_bounds_is_found(spark):
    """One substitution or deleted base in almost every piece: seven differences in 60 bases, where nine are allowed."""
    r = random.Random(31)
    text = "".join(r.choice("ACGT") for _ in range(4000))
    reads = []
    for i in range(200):
        at = r.randrange(20, 3900)
        part, places = list(text[at : at + 63]), [4 + 8 * j + r.randint(0, 3) for j in range(7)]
        for j, k in enumerate(r.sample(places, 7)):
            part[k] = "" if j < 3 else r.choice([c for c in "ACGT" if c != part[k]])
        reads.append((i, "".join(part)))
    reads += [(300, text[500:506]), (301, text[700:712]), (302, "A")]
    found = dp.indel_search(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame([(1, text)], "contig_id long, seq string"), SearchConf(errors=4, indels=True, indels_max=5))
    by = {x.read_id: x.score for x in found.collect()}
    for i, read in reads[:200]:
        assert by[i] == max(best_score(p, text) for p in (read, revcomp(read)))


def test_indel_after_ten_bases(spark):
    r = random.Random(2)
    text = "".join(r.choice("ACGT") for _ in range(300))
    reads = [(1, text[100:110] + text[112:160]), (2, text[100:110] + "".join({"A": "C", "C": "A", "G": "T", "T": "G"}[c] for c in text[110:112]) + text[110:160])]
    conf = SearchConf(errors=1, indels=True, indels_max=5)
    got = {x.read_id: (x.pos, x.cigar, x.indels) for x in dp.indel_search(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame([(1, text)], "contig_id long, seq string"), conf).collect()}
    assert {i: (p, n) for i, (p, _, n) in got.items()} == {1: (100, 2), 2: (100, 2)}
    assert re.fullmatch(r"(9|10|11)M2D(49|48|47)M", got[1][1]) and re.fullmatch(r"\d+M2I\d+M", got[2][1])


def test_searches_of_a_stored_index_and_of_tiles(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    texts = [(c, "".join(r.choice("ACGT") for _ in range(500))) for c in range(4)]
    reads = [(i, texts[i % 4][1][at : at + 40]) for i, at in enumerate([0, 10, 63, 64, 100, 255, 300, 460])]
    reads = [(i, s[:20] + ("A" if s[20] != "A" else "C") + s[21:]) for i, s in reads]
    rd, ct = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(texts, "contig_id long, seq string")
    conf = SearchConf(errors=2)
    want = {tuple(x) for x in search.search(rd, ct, conf).collect()}
    seeds.write_search_index(ct, f"{tmp_path}/own", 10, partitions=3)
    index = seeds.read_search_index(spark, f"{tmp_path}/own")
    assert {tuple(x) for x in search.indexed(rd, index, conf).collect()} == want and len(want) >= 8
    assert {tuple(x) for x in dp.indel_search(rd, None, SearchConf(errors=0, indels=True, indels_max=2), index).collect()} == {tuple(x) for x in dp.indel_search(rd, ct, SearchConf(errors=0, indels=True, indels_max=2)).collect()}
    with pytest.raises(Exception, match="doesn't fit"):
        search.indexed(spark.createDataFrame([(1, "ACGTACGT")], "read_id long, seq string"), index, conf).collect()
    cut = contigs.tiled(ct, 5, 3, 64)
    parts = contigs.with_parts(ct.crossJoin(spark.range(0, 520, 7)).drop("seq"), cut, F.col("id"), F.lit(5), size=64).collect()
    assert {(x.contig_id, x.id): x.part for x in parts} == {(c, i): t[i : i + 5] for c, t in texts for i in range(0, 512, 7) if i < 500 or t[i : i + 5] or i // 64 == 499 // 64}
    named = ct.select(F.concat(F.lit("c"), "contig_id").alias("name"), "seq")
    contigs.write_indexed(named, f"{tmp_path}/fai", 64, 3)
    for lo, hi in ((-5, 9), (60, 70), (0, 500), (490, 900), (128, 192)):
        assert contigs.fetch_indexed(spark, f"{tmp_path}/fai", "c2", lo, hi, 64).first().seq == texts[2][1][max(0, lo) : hi]


def test_counts_of_seeds(spark):
    r = random.Random(8)
    ct = spark.createDataFrame([(c, "".join(r.choice("ACGTN") for _ in range(r.randint(0, 90)))) for c in range(9)] + [(9, None)], "contig_id long, seq string")
    for k, two in ((1, False), (3, False), (5, True), (7, False), (20, True)):
        assert {tuple(x) for x in seeds.seed_counts(ct, k, two).collect()} == {tuple(x) for x in seeds.histogram(seeds.seed_table(ct, k, two)).collect()}
    assert [int(x) for x in seeds.packed(b"ACGTTGCA", 3)[0]] == [int("".join(f"{'ACGT'.index(c):02b}" for c in "ACGTTGCA"[i : i + 3]), 2) for i in range(6)]


def test_gapped_search(spark):
    r = random.Random(9)
    text = "".join(r.choice("ACGT") for _ in range(300))
    reads = [(1, text[50:80] + text[120:150]), (2, revcomp(text[50:80] + text[120:150])), (3, text[50:80] + text[181:211]), (4, text[10:70])]
    got = {x.read_id: x for x in search.gapped(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame([(7, text)], "contig_id long, seq string"), SearchConf(errors=2, gap=True)).collect()}
    assert (got[1].pos, got[1].gap, got[1].nm + got[1].nm2) == (50, 40, 0) and got[1].pos2 - got[1].pos - got[1].len1 == 40
    assert got[2].strand == "-" and 3 not in got and got[4].gap == 0


def test_strata_and_histogram(spark):
    found = spark.createDataFrame([(1, 1, 5, "+", 1, 3), (1, 1, 9, "+", 3, 3), (1, 2, 9, "-", 1, 3), (2, 1, 1, "+", 4, 3)], "read_id long, contig_id long, pos long, strand string, nm int, max_errors int")
    assert search.strata(found).count() == 2 and search.strata(found, 2).count() == 3
    assert {x.read_id: [(s.nm, s.n) for s in x.strata] for x in search.histogram(found).collect()} == {1: [(1, 2), (2, 0), (3, 1)], 2: [(4, 1)]}
    assert search.chosen(found).collect() == search.chosen(found).collect() and search.numbered(found, 1).count() == 2


def test_index_round_trip_and_neighbours(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ACGTNACGTT"), (2, "AC")], "contig_id long, seq string")
    seeds.write_index(seeds.seed_table(texts, 4), f"{tmp_path}/index", 2)
    got = {(x.contig_id, x.pos) for x in seeds.read_index(spark, f"{tmp_path}/index").collect()}
    assert got == {(1, 0), (1, 5), (1, 6)} and seeds.key_of("ACGN", 4) is None
    assert [len(seeds.neighbours(k, 2)) for k in (10, 12, 15)] == [436, 631, 991] and [len(seeds.neighbours(k, 2, 2)) for k in (20, 30)] == [211, 466]


def test_nearest_mates(spark):
    u = spark.createDataFrame([(1, 100, "+")], "pair long, pos long, strand string")
    m = spark.createDataFrame([(1, 90, "-"), (1, 110, "+"), (1, 110, "-")], "pair long, pos long, strand string")
    assert pairs.nearest(u, m, ["pair"]).first().mate_pos == 90
    assert pairs.nearest(u, m, ["pair"], same_strand=True).first().mate_pos == 110
    with pytest.raises(ValueError):
        PairConf(insert_min=5)


def test_mates_with_other_names_fail(spark):
    a = spark.createDataFrame([(0, "x/1")], "ordinal long, id string")
    assert pairs.zipped(a, spark.createDataFrame([(0, "x/2")], "ordinal long, id string")).count() == 1
    with pytest.raises(Exception, match="mates differ"):
        pairs.zipped(a, spark.createDataFrame([(0, "y/2")], "ordinal long, id string")).collect()


def test_pileup_walks_the_cigar(spark):
    rec = spark.createDataFrame([("r1", 0, 1, 10, "2S3M1I2D2M3N1M", "SSABCIDEF"), ("r2", 4, 1, 10, "3M", "AAA")], "qname string, flag int, contig_id long, pos long, cigar string, seq string")
    got = {(x.ref, x.base) for x in pileup.bases(rec).collect()}
    assert got == {(10, "A"), (11, "B"), (12, "C"), (13, None), (14, None), (15, "D"), (16, "E"), (20, "F")}
    assert {x.ref: x.depth for x in pileup.depth(rec).collect()}[13] == 1
    assert pileup.pileup(rec).count() == 8
    assert {r.a for r in pileup.pileup_of_files({"a": rec, "b": rec.where("flag = 4")}).collect()} == {1}


def test_cigar_functions(spark):
    row = spark.createDataFrame([("1H2S5M",), ("*",), ("3S4M1S2H",)], "c string").select(cigar.left_clip(cigar.operations(F.col("c"))), cigar.right_clip(cigar.operations(F.col("c"))), cigar.text(cigar.operations(F.col("c")))).collect()
    assert [tuple(r) for r in row] == [(2, 0, "1H2S5M"), (0, 0, "*"), (3, 1, "3S4M1S2H")]
    assert spark.range(1).select(cigar.mismatch_text(F.lit("ACGT"), F.lit("AGGT"))).first()[0] == "1G2"


def test_duplicate_names_fail(spark):
    df = spark.createDataFrame([("a", "A"), ("a", "C")], "name string, seq string")
    assert contigs.duplicate_names(df).count() == 1
    with pytest.raises(Exception, match="duplicate contig name"):
        contigs.unique_names(df).collect()
    assert contigs.fetch(df.where("seq = 'C'"), "a", -5, 9).first().seq == "C"


def test_shards(spark):
    assert shards.assignment({1: 5, 2: 4, 3: 3, 4: 3}, 2) == {1: 0, 2: 1, 3: 1, 4: 0}
    hits = spark.createDataFrame([(s, r, n) for s in range(4) for r in range(5) for n in (s % 3, r)], "shard int, read_id long, nm int")
    want = {x.read_id: (x.nm, x.n) for x in shards.final(shards.partial(hits.withColumn("shard", F.lit(0)))).collect()}
    assert {x.read_id: (x.nm, x.n) for x in shards.final(shards.partial(hits)).collect()} == want


def test_simulated_methylation_is_found(spark, tmp_path):
    r = random.Random(3)
    text = "".join(r.choice("ACGT") for _ in range(400))
    repeat = text[:120] + "".join(r.choice("ACGT") for _ in range(60))
    marked = {i for i, c in enumerate(text) if c == "C" and r.random() < 0.5}
    treat = lambda lo, hi: "".join("T" if c == "C" and i not in marked else c for i, c in zip(range(lo, hi), text[lo:hi]))
    reads = [(n, treat(lo, lo + 40)) for n, lo in enumerate(range(0, 361, 3))]
    rd, ct = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame([(1, text), (2, repeat)], "contig_id long, seq string")
    found = search.search(rd, ct, SearchConf(errors=1, bisulfite=True))
    done = methyl.resolve(found, rd, ct, MethylConf(min_cov=1, max_cov=3), f"file://{tmp_path}")
    assert done.groupBy("read_id").count().where("count > 1").count() == 0
    profile = methyl.profile(methyl.observed(done, rd, ct))
    calls = {x.ref: x.level for x in profile.where("contig_id = 1 and strand = '+'").withColumn("level", methyl.level(F.col("c_cnt"), F.col("t_cnt"))).collect()}
    sure = {i: v for i, v in calls.items() if i > 160}
    assert sure and all((v > 0.5) == (i in marked) for i, v in sure.items())
    report = methyl.report(profile, ct)
    assert methyl.summary(report).count() > 0 and methyl.report(profile, ct, dense=True).count() == sum(c in "CG" for c in text + repeat)
    truth = methyl.truth_sites(spark.createDataFrame([(1, "ACMGL")], "contig_id long, seq string"))
    assert {(x.ref, x.strand, x.methylated) for x in truth.collect()} == {(1, "+", False), (2, "+", True), (3, "-", False), (4, "-", True)}


def test_reads_that_are_decided_after_many_cycles(spark, tmp_path):
    """The coverage asked for falls from 60 to that of a read with two sites, which takes more than 50 cycles."""
    one, two = "AATTCAATTCAA", "GGTTCAATTCGG"
    ct = spark.createDataFrame([(1, one), (2, two)], "contig_id long, seq string")
    rd = spark.createDataFrame([(1, one), (2, two), (3, "TTCAATTC")], "read_id long, seq string")
    hits = spark.createDataFrame([(1, 1, 0, "+"), (2, 2, 0, "+"), (3, 1, 2, "+"), (3, 2, 2, "+")], "read_id long, contig_id long, pos long, strand string")
    done = methyl.resolve(hits, rd, ct, MethylConf(min_cov=1, max_cov=60), f"file://{tmp_path}")
    assert sorted(x.read_id for x in done.collect()) == [1, 2, 3]


def test_record_functions(spark):
    row = spark.range(1).select(sam.pair_name(F.lit("read/1")), sam.flag_letters(F.lit(1 + 16 + 128)), sam.alignment_class(F.lit(4), F.lit(None).cast("int"), F.lit(False)), sam.region(F.lit("chr1:1,001-2,000")), sam.strand_char(F.lit(None).cast("boolean")), sam.tag_map(F.lit("NM:i:3\tRG:Z:a:b"))).first()
    assert row[0] == "read" and row[1] == "pr2" and row[2] == "not_found" and tuple(row[3]) == ("chr1", 1000, 2000) and row[4] == "." and row[5] == {"NM": "3", "RG": "a:b"}


def test_dealing_by_counts_of_lengths(spark):
    r = random.Random(6)
    for _ in range(200):
        shards_ = r.randint(1, 6)
        lengths = {i: r.choice([0, 1, 1, 2, 3, 5, 5, 5, 8, 40, r.randint(1, 60)]) for i in range(r.randint(0, 40))}
        want = shards.assignment(lengths, shards_)
        by = {}
        for c, s in want.items():
            by.setdefault(s, []).append(lengths[c])
        counts = {}
        for n in lengths.values():
            counts[n] = counts.get(n, 0) + 1
        got = {}
        for n, lo, hi, s in shards.shares(counts, shards_):
            got.setdefault(s, []).extend([n] * (hi - lo))
        assert {s: sorted(x) for s, x in got.items()} == {s: sorted(x) for s, x in by.items()}
    rows = [(i, "A" * (i * 7 % 13)) for i in range(60)]
    found = shards.dealt(spark.createDataFrame(rows, "contig_id long, seq string"), 4).collect()
    want = shards.assignment({i: len(s) for i, s in rows}, 4)
    load = lambda pairs: sorted((s, sum(len(rows[c][1]) for c, t in pairs if t == s)) for s in range(4))
    assert sorted(x.contig_id for x in found) == [*range(60)] and load([(x.contig_id, x.shard) for x in found]) == load([*want.items()])


def test_shard_files_and_links(spark, tmp_path):
    ct = spark.createDataFrame([(1, "c1", "ACGT"), (2, "c2", "AC"), (3, "c3", "A")], "contig_id long, name string, seq string")
    shards.write_shards(ct, 2, f"{tmp_path}/shards")
    n, header, back = shards.read_shards(spark, f"{tmp_path}/shards")
    assert n == 2 and {tuple(x) for x in header.collect()} == {("c1", 4), ("c2", 2), ("c3", 1)} and back.count() == 3
    ids = spark.createDataFrame([("c1", 0), ("c2", 1)], "name string, tid int")
    rows = spark.createDataFrame([("c2",), ("*",), (None,)], "rname string")
    assert {(x.rname, x.tid) for x in shards.linked(rows, ids).collect()} == {("c2", 1), ("*", None), (None, None)}
    with pytest.raises(Exception, match="no such contig"):
        shards.linked(spark.createDataFrame([("c9",)], "rname string"), ids).collect()


def test_ranks_of_any_group(spark):
    from strandloom.operators.ranks import ranked

    rows = spark.createDataFrame([(i % 3 if i < 200 else 7, i) for i in range(500)], "g int, i long")
    got = ranked(rows, "g", ["i"], 8).collect()
    for g in (0, 1, 2, 7):
        assert sorted(x["rank"] for x in got if x.g == g) == [*range(sum(x.g == g for x in got))]


def site_profile(hits, reads, texts, saturation=255):
    out = {}
    for i, c, pos, strand in hits:
        p = reads[i] if strand == "+" else revcomp(reads[i])
        own, changed = ("C", "T") if strand == "+" else ("G", "A")
        for j, b in enumerate(p):
            if texts[c][pos + j] == own and b in (own, changed):
                k = out.setdefault((c, pos + j, strand), [0, 0])
                k[b != own] += 1
    return {k: (min(saturation, a), min(saturation, b)) for k, (a, b) in out.items()}


def resolved(hits, reads, texts, conf):
    """The cycles by hand, for single reads."""
    by = {}
    for h in hits:
        by.setdefault(h[0], []).append(h)
    done = [h[0] for h in by.values() if len(h) == 1]
    left, required = {i: h for i, h in by.items() if len(h) > 1}, conf.max_cov
    while required >= conf.min_cov and left:
        profile = site_profile(done, reads, texts, conf.saturation)
        new = []
        for i, own in left.items():
            told = []
            for _, c, pos, strand in own:
                p = reads[i] if strand == "+" else revcomp(reads[i])
                base, changed = ("C", "T") if strand == "+" else ("G", "A")
                distance, cov, n = 0.0, 0, 0
                for j, b in enumerate(p):
                    if texts[c][pos + j] == base and (c, pos + j, strand) in profile:
                        m, u = profile[c, pos + j, strand]
                        level = m / (m + u)
                        distance += level if b == changed else 1 - level if b == base else 0
                        cov, n = cov + m + u, n + 1
                told.append((int(distance), cov / n if n else float("inf"), -c, -pos, strand == "+", distance, n, (i, c, pos, strand)))
            if min(t[6] for t in told) >= required:
                best = min(told, key=lambda t: t[:4])
                if (best[5] / best[6] if best[6] else 0) <= conf.error_threshold:
                    new.append(best[7])
        if new:
            done += new
            for h in new:
                del left[h[0]]
        else:
            required -= 1
    return done


def test_methylation_cycles_against_the_plain_loop(spark, tmp_path):
    r = random.Random(12)
    flank = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    unit = flank(30)
    texts = {1: flank(20) + unit + flank(25), 2: flank(30) + unit + flank(15)}
    reads = {}
    for i in range(70):
        c = r.choice([1, 2])
        at = r.randrange(len(texts[c]) - 24)
        reads[i] = "".join("T" if b == "C" and r.random() < (0.8 if c == 1 else 0.2) else b for b in texts[c][at : at + 24])
    rd = spark.createDataFrame([*reads.items()], "read_id long, seq string")
    ct = spark.createDataFrame([*texts.items()], "contig_id long, seq string")
    found = search.search(rd, ct, SearchConf(errors=0, bisulfite=True)).select("read_id", "contig_id", "pos", "strand").collect()
    conf = MethylConf(min_cov=1, max_cov=3, error_threshold=0.6)
    done = methyl.resolve(spark.createDataFrame(found), rd, ct, conf, f"file://{tmp_path}")
    want = resolved([tuple(x) for x in found], reads, texts, conf)
    assert {tuple(x) for x in done.collect()} == {*want}
    assert len(want) > len({x.read_id for x in found if sum(y.read_id == x.read_id for y in found) == 1})


def test_pairs_of_reads_in_the_cycles(spark, tmp_path):
    """A pair with a unique and an ambiguous mate takes the near hit on its strand; mates on two strands go; one alone stays."""
    one, two = "AATTCAATTCAAGGTTAACC", "GGTTCAATTCGGAGAGTTCC"
    ct = spark.createDataFrame([(1, one), (2, two)], "contig_id long, seq string")
    hit = "read_id long, contig_id long, pos long, strand string"
    first = spark.createDataFrame([(1, 1, 0, "+"), (2, 1, 0, "+"), (3, 1, 0, "+"), (4, 1, 2, "+"), (4, 2, 2, "+")], hit)
    second = spark.createDataFrame([(1, 1, 2, "+"), (1, 1, 12, "+"), (1, 2, 2, "+"), (2, 1, 12, "-"), (5, 2, 0, "+")], hit)
    r1 = spark.createDataFrame([(1, one[:8]), (2, one[:8]), (3, one[:8]), (4, "TTCAATTC")], "read_id long, seq string")
    r2 = spark.createDataFrame([(1, "TTCAATTC"), (2, "GGTTAACC"), (5, two[:8])], "read_id long, seq string")
    done = methyl.resolve_pairs(first, second, r1, r2, ct, MethylConf(min_cov=1, max_cov=2), f"file://{tmp_path}")
    got = {(x.read_id, x.mate, x.contig_id, x.pos): x.cycle for x in done.collect()}
    assert {k: v for k, v in got.items() if k[0] != 4} == {(1, 1, 1, 0): 0, (1, 2, 1, 2): 0, (3, 1, 1, 0): 0, (5, 2, 2, 0): 0}
    hits = first.withColumn("mate", F.lit(1)).unionByName(second.withColumn("mate", F.lit(2)))
    assert methyl.cycle_counters(done, hits).orderBy("cycle").first()["decided"] == 4


def test_validation_and_statistics(spark, tmp_path):
    truth = methyl.truth_sites(spark.createDataFrame([(1, "ACMGL")], "contig_id long, seq string"))
    calls = spark.createDataFrame([(1, 1, "+", 0.2, 5), (1, 2, "+", 0.4, 5), (1, 3, "-", 0.9, 5), (1, 4, "-", 0.9, 0)], "contig_id long, ref long, strand string, level double, coverage int")
    met = methyl.validated(calls, truth)
    assert {(x.ref, x.truth, x.call, round(x.error, 6)) for x in met.collect()} == {(1, 0, 0, 0.2), (2, 1, 0, 0.6), (3, 0, 1, 0.9)}
    total = methyl.confusion(met, ["strand"]).where("strand is null").first()
    assert (total.tp, total.tn, total.fp, total.fn) == (0, 1, 1, 1)
    methyl.write_table(methyl.error_histogram(met, "error"), f"{tmp_path}/errors")
    lines = spark.read.text(f"{tmp_path}/errors").collect()
    assert len(lines) == 51 and sorted(x.value for x in lines)[:2] == ["0.0\t0", "0.02\t0"]
    report = spark.createDataFrame([("CG:2", 1.0, "+"), ("CG:4", 0.0, "-"), ("CHH:3", 0.6, "+")], "ctx_cov string, level double, strand string")
    row = methyl.statistics(methyl.summary(report), spark.createDataFrame([("unique",), ("none",), ("multiple",), ("unique",)], "kind string")).first()
    assert (row.reads, row.unique, row.multiple, row["none"], row.covered, row.methylated, row.mean_coverage, row.covered_CG, row.methylated_CG, row.methylated_CHG) == (4, 0.5, 0.25, 0.25, 3, 2, 3.0, 0.666667, 0.5, None)
    scores = methyl.candidate_scores(
        spark.createDataFrame([(1, 1, 0, "+", 4, "m"), (1, 1, 0, "+", 5, "u"), (2, 1, 9, "+", 9, None)], "read_id long, contig_id long, pos long, strand string, ref long, state string"),
        spark.createDataFrame([(1, 4, "+", 3, 1), (1, 5, "+", 1, 1)], "contig_id long, ref long, strand string, c_cnt long, t_cnt long"),
    )
    assert {x.read_id: (x.distance, x.cov_avg, x.n_covered) for x in scores.collect()} == {1: (0.75, 3.0, 2), 2: (0.0, None, 0)}
    assert [r_[0] for r_ in spark.createDataFrame([("u", 0.3), ("m", 0.3), (None, 0.3)], "s string, l double").select(methyl.alpha(F.col("s"), F.col("l"))).collect()] == [0.3, 0.7, 0.0]


def test_depth_equals_a_row_for_each_base(spark):
    r = random.Random(4)
    rows = [("r", 0, c, r.choice([0, 16380, 16384, 40000]) + r.randint(0, 40), f"{r.randint(1, 30)}M{r.randint(1, 4)}D{r.randint(1, 30)}M{r.randint(1, 9)}N{r.randint(1, 20)}M") for c in (1, 2) for _ in range(60)]
    rec = spark.createDataFrame([(*x, "A" * 90) for x in rows], "qname string, flag int, contig_id long, pos long, cigar string, seq string")
    want = {}
    for x in pileup.bases(rec).collect():
        n = want.setdefault((x.contig_id, x.ref), [0, 0])
        n[0], n[1] = n[0] + 1, n[1] + (not x.is_del)
    assert {(x.contig_id, x.ref): [x.depth, x.n_bases] for x in pileup.depth(rec).collect()} == want


def test_letters_of_reads(spark):
    row = spark.createDataFrame([("r", "ACGTNRA", "IIIIIII", "r1/1", "r1/2", 2, 4, False)], "n string, s string, q string, a string, b string, lo int, hi int, d boolean")
    c = F.col
    got = row.select(S.revcomp_strict(c("s")), S.description(c("n"), c("s"), 3), S.debug_text(c("n"), c("s"), c("q"), c("lo"), c("hi"), c("d")), S.colours(c("s")), S.bases_of_colours(S.colours(F.lit("ACGTT"))), S.bases_of_colours(F.lit("A1.0")), S.missing_colours(F.lit("A1.0")), sam.common_name(c("a"), c("b")), sam.flag_text(F.lit(83), "hex"), sam.flag_text(F.lit(83), "letters"), cigar.reversed_text(F.lit("2S3M1D4M")), sam.strand_char(F.lit(True))).first()
    assert tuple(got) == ("TNNACGT", "r: ACG (7)", "r [7] 2-4 aCGTnra IIIIIII", "A131$$$", "ACGTT", "ACNN", "A1$0", "r1", "0x53", "pPr1", "4M1D3M2S", "-")
    assert seq_width(spark) == [(20, 10), (30, 15), (24, 12)]


def seq_width(spark):
    rows = spark.createDataFrame([(10,), (10**12,), (1 << 24,)], "n long")
    return [tuple(x) for x in rows.select(S.index_width(F.col("n"), True), S.index_width(F.col("n"))).collect()]


def test_formatting():
    from strandloom import formatting as f

    assert [f.duration(s) for s in (0.5, 7, 61, 3600, 90061)] == ["0.50s", "7s", "1m 1s", "1h 0s", "1d 1h 1m 1s"]
    assert [f.amount(n) for n in (5, 1500, 2.5e6, 3e15)] == ["5 B", "1.5 KB", "2.5 MB", "3000.0 TB"]
    numbers = [0, 1, 255, 256, 1 << 40]
    assert f.unpacked_ints(f.packed_ints(numbers)) == numbers and len(f.packed_ints(numbers)) == 1 + 2 + 2 + 3 + 7
    with pytest.raises(ValueError):
        f.packed_ints([-1])
    assert f.mismatch_combinations(3, 2) == [(0, 0), (0, 1), (0, 2), (1, 0), (0, 3), (1, 1)]


def test_admission_and_screens(spark):
    rows = spark.createDataFrame([(1, "ACNNACGT", 1, 8, False), (2, "ACGTACGT", None, None, True), (3, "NNNNACGT", 5, 8, False)], "id long, seq string, good_start int, good_stop int, discarded boolean")
    assert {x.id: (x.low_quality, x.searchable) for x in trim.admitted(rows, F.lit(1)).collect()} == {1: (False, False), 2: (True, False), 3: (False, True)}
    reads = spark.createDataFrame([(1, "ACGTACGTTTGC"), (2, "GGGGGCCCAATT")], "read_id long, seq string")
    bad = spark.createDataFrame([(7, "TTACGTACGTTTGCAA")], "contig_id long, seq string")
    rest, found = search.screened(reads, bad, SearchConf(errors=1))
    assert [x.read_id for x in rest.collect()] == [2] and [(x.read_id, x.contaminant) for x in found.collect()] == [(1, 7)]
    assert pairs.placed(spark.createDataFrame([(1, None, 5, None)], "contig1 long, contig2 long, pos1 long, pos2 long")).first().asDict() == {"contig1": 1, "contig2": 1, "pos1": 5, "pos2": 5}


def test_offsets_of_sparse_ids(spark):
    """Ids far apart, in any order of rows, and no contig at all."""
    r = random.Random(51)
    ids = r.sample(range(-(2**60), 2**60), 300) + [0, 1, 2]
    rows = [(i, "A" * r.randint(1, 50)) for i in ids]
    found = {x.contig_id: (x.length, x.global_start) for x in contigs.with_offsets(spark.createDataFrame(rows, "contig_id long, seq string").repartition(7)).collect()}
    at, want = 0, {}
    for i, s in sorted(rows):
        want[i], at = (len(s), at), at + len(s) + 1
    assert found == want
    assert contigs.with_offsets(spark.createDataFrame([], "contig_id long, seq string")).count() == 0

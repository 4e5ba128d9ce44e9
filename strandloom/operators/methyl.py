"""Methylation from bisulfite hits: profile, levels, contexts, report, candidate scores, resolution of ambiguous reads, validation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import MethylConf
from strandloom.functions import seq as S
from strandloom.operators.contigs import TILE, of_rows, tiled, with_parts
from strandloom.operators.kept import kept
from strandloom.operators.pairs import nearest


def observed(hits: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Hits to a row for each C (on +) or G (on -) of the contig that the read covers: methylated if the read has the base itself, unmethylated if the changed one."""
    pattern = F.when(F.col("strand") == "+", F.col("seq")).otherwise(S.revcomp(F.col("seq")))
    n = F.length("pattern")
    hits = kept(hits, "hits")
    met = hits.join(reads.select("read_id", "seq"), "read_id").withColumn("pattern", pattern).drop("seq")
    longest = reads.agg(F.max(F.length("seq"))).first()[0] or 0
    rows = with_parts(met, tiled(of_rows(contigs, hits), longest), F.col("pos"), n).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    at = lambda c: F.substr(c, F.col("i"), F.lit(1))
    rows = rows.withColumns({"ref_base": at("part"), "base": at("pattern"), "ref": F.col("pos") + F.col("i") - 1})
    own, changed = F.when(F.col("strand") == "+", "C").otherwise("G"), F.when(F.col("strand") == "+", "T").otherwise("A")
    seen = rows.where(F.col("ref_base") == own).withColumn("state", F.when(F.col("base") == own, "m").when(F.col("base") == changed, "u"))
    return seen.drop("pattern", "part", "i")


def profile(observations: DataFrame, saturation: int = 255) -> DataFrame:
    """contig_id, ref, strand with counts of methylated (c_cnt) and unmethylated (t_cnt) observations, each saturating."""
    count = lambda s: F.least(F.lit(saturation).cast("long"), F.count_if(F.col("state") == s))
    return observations.where("state is not null").groupBy("contig_id", "ref", "strand").agg(count("m").alias("c_cnt"), count("u").alias("t_cnt"))


def level(c: Column, t: Column) -> Column:
    return F.coalesce(F.try_divide(c, c + t), F.lit(0.0))


def covered(profile_: DataFrame, threshold: int) -> DataFrame:
    return profile_.where(F.col("c_cnt") + F.col("t_cnt") >= threshold)


def alpha(state: Column, level_: Column) -> Column:
    """How far an observation is from a position's level."""
    return F.when(state == "u", level_).when(state == "m", 1 - level_).otherwise(0.0)


def sites(contigs: DataFrame) -> DataFrame:
    """Every C and G of the contigs: contig_id, ref, strand, context. Tiles have the two bases on either side that a context needs."""
    cut = tiled(contigs, 2, 2)
    bases = cut.select("contig_id", "tile", "start", "seq", F.posexplode(F.split("seq", "")).alias("i", "base")).where(F.col("base").isin("C", "G"))
    own = bases.withColumn("ref", F.col("start") + F.col("i")).where(F.floor(F.col("ref") / TILE) == F.col("tile"))
    return own.select("contig_id", "ref", F.when(F.col("base") == "C", "+").otherwise("-").alias("strand"), S.cytosine_context(F.col("seq"), F.col("i")).alias("context"))


def context_counts(contigs: DataFrame) -> DataFrame:
    """Numbers of sites by context and strand, with subtotals. Motifs are counted within each contig; nothing is exploded."""
    seq = F.col("seq")
    count = lambda pattern: F.regexp_count(seq, F.lit(pattern)).cast("long")
    cs, gs = F.length(seq) - F.length(F.replace(seq, F.lit("C"), F.lit(""))), F.length(seq) - F.length(F.replace(seq, F.lit("G"), F.lit("")))
    cg = count("CG")
    chg_f, chg_b = count("C(?=[^G]G)"), count("(?<=C[^C])G")
    rows = F.array(*(F.struct(F.lit(k).alias("context"), F.lit(s).alias("strand"), n.cast("long").alias("n")) for k, s, n in (("CG", "+", cg), ("CG", "-", cg), ("CHG", "+", chg_f), ("CHG", "-", chg_b), ("CHH", "+", cs - cg - chg_f), ("CHH", "-", gs - cg - chg_b))))
    return contigs.select(F.explode(rows).alias("r")).select("r.*").rollup("context", "strand").agg(F.sum("n").alias("n"))


def report(profile_: DataFrame, contigs: DataFrame, dense: bool = False, threshold: int = 1) -> DataFrame:
    """A row for each covered site (each site if dense): contig_id, start and end (1-based), context with coverage, level, strand."""
    known = covered(profile_, threshold)
    if dense:
        rows = sites(contigs).join(known, ["contig_id", "ref", "strand"], "left")
    else:
        begin = F.greatest(F.col("ref") - 2, F.lit(0))
        known = kept(known, "covered")
        rows = with_parts(known, tiled(of_rows(contigs, known), 4), begin, F.lit(5)).withColumn("context", S.cytosine_context(F.col("part"), (F.col("ref") - begin).cast("int"))).drop("part")
    n = F.coalesce(F.col("c_cnt") + F.col("t_cnt"), F.lit(0))
    return rows.select("contig_id", (F.col("ref") + 1).alias("start"), (F.col("ref") + 1).alias("end"), F.concat_ws(":", "context", n.cast("string")).alias("ctx_cov"), F.round(level(F.col("c_cnt"), F.col("t_cnt")), 6).alias("level"), "strand")


def summary(report_: DataFrame) -> DataFrame:
    """By context and strand, with subtotals: covered and methylated (level over one half) sites."""
    rows = report_.withColumn("context", F.substring_index("ctx_cov", ":", 1)).withColumn("n", F.substring_index("ctx_cov", ":", -1).cast("long"))
    return rows.rollup("context", "strand").agg(F.count_if(F.col("n") > 0).alias("covered"), F.count_if(F.col("level") > 0.5).alias("methylated"), F.sum("n").alias("coverage"))


def candidate_scores(observations: DataFrame, profile_: DataFrame) -> DataFrame:
    """Of each hit: distance (sum of alpha), cov_avg over covered sites (null without one), n_covered; 1000 is added if it spans no site."""
    key = ["read_id", "contig_id", "pos", "strand"]
    met = observations.join(profile_, ["contig_id", "ref", "strand"], "left").withColumn("cov", F.coalesce(F.col("c_cnt") + F.col("t_cnt"), F.lit(0)))
    value = F.when(F.col("cov") > 0, alpha(F.col("state"), level(F.col("c_cnt"), F.col("t_cnt")))).otherwise(0.0)
    found = met.groupBy(*key).agg(F.sum(value).alias("distance"), F.try_divide(F.sum("cov"), F.count_if(F.col("cov") > 0)).alias("cov_avg"), F.count_if(F.col("cov") > 0).alias("n_covered"), F.count("*").alias("n_sites"))
    return found.select(*key, (F.col("distance") + F.when(F.col("n_sites") == 0, 1000.0).otherwise(0.0)).alias("distance"), "cov_avg", "n_covered")


def decided(scores: DataFrame, required: int, threshold: float = 1.0) -> DataFrame:
    """Reads all of whose hits have `required` covered sites: the hit of least whole distance, then of lower mean coverage, then the last; if its mean distance is within the threshold."""
    own = Window.partitionBy("read_id")
    ready = scores.withColumn("least", F.min("n_covered").over(own)).where(F.col("least") >= required)
    order = own.orderBy(F.floor("distance"), F.col("cov_avg").asc_nulls_last(), F.desc("contig_id"), F.desc("pos"), F.desc("strand"))
    best = ready.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return best.where(F.coalesce(F.try_divide(F.col("distance"), F.col("n_covered")), F.lit(0.0)) <= threshold).select("read_id", "contig_id", "pos", "strand")


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cycles(hits: DataFrame, reads: DataFrame, contigs: DataFrame, conf: MethylConf, folder: str) -> DataFrame:
    """Decided hits of mates (read_id is 2 * pair for first and single ones, and one more for second ones) with the cycle that decided them."""
    n = F.count("*").over(Window.partitionBy("read_id"))
    pair, second = F.shiftright("read_id", 1), F.col("read_id") % 2 == 1
    left = _written(hits.select("read_id", "contig_id", "pos", "strand").withColumn("n", n).withColumn("pair", pair), folder)
    every = left
    done, cycle, required, seen = None, 0, conf.max_cov, None
    key = ["pair", "read_id", "contig_id", "pos", "strand"]
    place = key[1:]
    while cycle == 0 or required >= conf.min_cov and left.limit(1).count():
        if cycle == 0:
            new = left.where("n = 1").select(*key)
        else:
            # Contigs are read once: what a cycle decides are hits that are there from the start.
            seen = seen if seen is not None else _written(observed(every.select(*place), reads, contigs), folder)
            of = lambda rows: seen.join(rows.select(*place).distinct(), place, "left_semi")
            known = covered(profile(of(done), conf.saturation), conf.coverage_threshold)
            new = decided(candidate_scores(of(left), known), required, conf.error_threshold).withColumn("pair", pair).select(*key)
        new = _written(new, folder)
        side = lambda rows, own: F.max(F.when(own, F.struct(*rows)))
        own = ["contig_id", "pos", "strand"]
        found = new.groupBy("pair").agg(side(own, ~second).alias("one"), side(own, second).alias("two"))
        kinds = left.groupBy("pair").agg(F.max(~second).alias("has_one"), F.max(second).alias("has_two")).join(found, "pair")
        kind = lambda d, has: F.when(F.col(d).isNotNull(), "unique").when(F.col(has), "multiple").otherwise("none")
        told = _written(kinds.withColumn("decision", pair_decision(kind("one", "has_one"), kind("two", "has_two"), F.col("one.strand") == F.col("two.strand"))).where("decision <> 'wait'"), folder)
        alone = new.join(told.select("pair", "decision"), "pair").where(F.col("decision").isin("both", "first", "second", "second_near_first", "first_near_second")).select(*key)
        # The undecided mate's hit nearest to the decided one, on its contig and strand.
        near = told.where(F.col("decision").isin("second_near_first", "first_near_second")).withColumn("at", F.coalesce("one", "two")).select("pair", "at.*")
        others = left.join(told.where(F.col("decision").isin("second_near_first", "first_near_second")).select("pair", F.col("one").isNotNull().alias("first_known")), "pair").where(second == F.col("first_known"))
        mate = nearest(near, others.select("pair", "contig_id", "pos", "strand", "read_id"), ["pair", "contig_id"], same_strand=True, keep=["read_id"])
        chosen = mate.select("pair", "read_id", "contig_id", F.col("mate_pos").alias("pos"), F.col("mate_strand").alias("strand"))
        now = alone.unionByName(chosen).withColumn("cycle", F.lit(cycle))
        done = _written(now if done is None else done.unionByName(now), folder)
        if told.limit(1).count():
            left = _written(left.join(told.select("pair"), "pair", "left_anti"), folder)
        elif cycle:
            required -= 1
        cycle += 1
    return done.drop("pair")


def resolve(hits: DataFrame, reads: DataFrame, contigs: DataFrame, conf: MethylConf, folder: str) -> DataFrame:
    """Hits that are decided: unique ones, then in cycles those of ambiguous reads that the profile so far decides.

    The coverage asked for begins at max_cov and falls by one after a cycle that decided nothing, down to min_cov; every other cycle decides a read, so it ends. A cycle sees the profile
    at its start, so its result doesn't depend on order. Each cycle is written to `folder`, which all executors share."""
    doubled = lambda df: df.withColumn("read_id", F.col("read_id").cast("long") * 2)
    return _cycles(doubled(hits), doubled(reads), contigs, conf, folder).select(F.shiftright("read_id", 1).alias("read_id"), "contig_id", "pos", "strand")


def resolve_pairs(first: DataFrame, second: DataFrame, reads1: DataFrame, reads2: DataFrame, contigs: DataFrame, conf: MethylConf, folder: str) -> DataFrame:
    """The same for pairs, whose mates have one read_id: read_id, mate, contig_id, pos, strand and the cycle that decided. What becomes of a pair is as pair_decision says."""
    joined = lambda a, b, *c: a.select((F.col("read_id").cast("long") * 2).alias("read_id"), *c).unionByName(b.select((F.col("read_id").cast("long") * 2 + 1).alias("read_id"), *c))
    done = _cycles(joined(first, second, "contig_id", "pos", "strand"), joined(reads1, reads2, "seq"), contigs, conf, folder)
    return done.select(F.shiftright("read_id", 1).alias("read_id"), (F.col("read_id") % 2 + 1).cast("int").alias("mate"), "contig_id", "pos", "strand", "cycle")


def pair_decision(first: Column, second: Column, same_strand: Column | None = None) -> Column:
    """What to do with two mates by their kinds (none, unique, multiple): use both (drop them if they are on different strands), use one, choose the other's hit near it, or wait."""
    both = F.when(F.coalesce(same_strand, F.lit(False)), "both").otherwise("drop") if same_strand is not None else F.lit("both")
    return F.when((first == "none") & (second == "none"), "drop").when((first == "unique") & (second == "unique"), both).when((first == "unique") & (second == "none"), "first").when((first == "none") & (second == "unique"), "second").when((first == "unique") & (second == "multiple"), "second_near_first").when((first == "multiple") & (second == "unique"), "first_near_second").otherwise("wait")


def cycle_counters(done: DataFrame, hits: DataFrame) -> DataFrame:
    """By cycle: reads (rows of done: read_id, mate, cycle) that it decided, and reads with hits that are left after it."""
    total = hits.select("read_id", "mate").distinct().agg(F.count("*").alias("all"))
    counts = done.groupBy("cycle").agg(F.count("*").alias("decided"))
    upto = Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)  # a row for each cycle
    return counts.withColumn("so_far", F.sum("decided").over(upto)).crossJoin(total).select("cycle", "decided", (F.col("all") - F.col("so_far")).alias("left"))  # one row on the other side


def truth_sites(truth: DataFrame) -> DataFrame:
    """Contigs whose sequence marks methylated C by M and, on the other strand, by L: contig_id, ref, strand, methylated."""
    rows = truth.select("contig_id", F.posexplode(F.split("seq", "")).alias("ref", "base")).where(F.col("base").isin("C", "G", "M", "L"))
    return rows.select("contig_id", F.col("ref").cast("long").alias("ref"), F.when(F.col("base").isin("C", "M"), "+").otherwise("-").alias("strand"), F.col("base").isin("M", "L").alias("methylated"))


def validated(calls: DataFrame, truth: DataFrame, threshold: int = 1) -> DataFrame:
    """Called sites (contig_id, ref, strand, level, coverage) beside the truth (truth_sites): contig_id, ref, strand, truth and call (0 or 1: level over one half) and error, the distance of the level from the truth. Sites under the coverage are left out."""
    met = calls.where(F.col("coverage") >= threshold).join(truth.select("contig_id", "ref", "strand", "methylated"), ["contig_id", "ref", "strand"])
    return met.withColumns({"truth": F.col("methylated").cast("int"), "call": (F.col("level") > 0.5).cast("int"), "error": F.abs(F.col("level") - F.col("methylated").cast("double"))}).drop("methylated")


def confusion(called: DataFrame, groups: list[str], truth: str = "truth", call: str = "call") -> DataFrame:
    """tp, tn, fp, fn, sensitivity and specificity over all rows and by each of the groups (grouping sets)."""
    sets = ", ".join(["()", *(f"({g})" for g in groups)])
    t, p = F.col(truth) == 1, F.col(call) == 1
    called = called.withColumns({"_tp": (t & p).cast("long"), "_tn": (~t & ~p).cast("long"), "_fp": (~t & p).cast("long"), "_fn": (t & ~p).cast("long")})
    called.createOrReplaceTempView(view := "calls_" + uuid.uuid4().hex)
    names = "".join(f"{g}, " for g in groups)
    out = called.sparkSession.sql(f"SELECT {names} sum(_tp) AS tp, sum(_tn) AS tn, sum(_fp) AS fp, sum(_fn) AS fn FROM {view} GROUP BY GROUPING SETS ({sets})")
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return out.withColumns({"sensitivity": rate("tp", "fn"), "specificity": rate("tn", "fp")})


def error_histogram(errors: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Numbers of values of 0..1 in bins of 1/bins; every bin is there (the last one holds 1)."""
    counts = errors.groupBy(F.floor(F.col(column) * bins).cast("int").alias("k")).agg(F.count("*").alias("n"))
    all_ = errors.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("k"))
    return all_.join(counts, "k", "left").select(F.round(F.col("k") / bins, 6).alias("bin"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def write_table(rows: DataFrame, path: str) -> None:
    """A report or histogram as text with a tab between columns."""
    rows.write.csv(path, sep="\t")


def statistics(summary_: DataFrame, reads: DataFrame) -> DataFrame:
    """One row: reads, shares of them with a kind of "unique", "multiple" and "none", covered and methylated sites, mean coverage, and by context the share of all covered sites and the share of the context's covered sites that are methylated (reads: kind; summary_: of `summary`)."""
    share = lambda k: F.round(F.try_divide(F.count_if(F.col("kind") == k), F.count("*")), 6)
    mapped = reads.agg(F.count("*").alias("reads"), *(share(k).alias(k) for k in ("unique", "multiple", "none")))
    of = lambda value, context: F.sum(F.when((F.col("context") == context) & F.col("strand").isNull() if context else F.col("context").isNull() & F.col("strand").isNull(), F.col(value)))
    by = [c for k in ("CG", "CHG", "CHH") for c in (F.round(F.try_divide(of("covered", k), of("covered", None)), 6).alias(f"covered_{k}"), F.round(F.try_divide(of("methylated", k), of("covered", k)), 6).alias(f"methylated_{k}"))]
    total = summary_.agg(of("covered", None).alias("covered"), of("methylated", None).alias("methylated"), F.round(F.try_divide(of("coverage", None), of("covered", None)), 6).alias("mean_coverage"), *by)
    return mapped.crossJoin(total)  # one row with one row

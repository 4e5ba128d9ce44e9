"""Quality trimming and the admission of reads to a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import TrimConf
from strandloom.functions import seq as S


def trim(reads: DataFrame, conf: TrimConf = TrimConf()) -> DataFrame:
    """Adds good_start and good_stop (1-based, inclusive; null if discarded) and discarded to reads (seq, qual as text).

    From the first good quality on a sum of quality less threshold runs, never below zero; the region ends at the last place of its maximum. Then
    N bases leave both ends. The region stands if it is long enough and its qualities, summed to the maximum and divided by its length, are high enough.
    Each step is a column of its own, so that none is worked out twice."""
    if not conf.enabled:
        return reads.withColumns({"good_start": F.lit(1), "good_stop": F.length("seq"), "discarded": F.lit(False)})
    m, c = conf.min_phred, F.col
    start = F.struct(F.lit(0).alias("a"), F.lit(-1).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("i"))

    def step(s: Column, q: Column) -> Column:
        a, i = F.greatest(F.lit(0), s["a"] + q - m), s["i"] + 1
        better = a >= s["best"]
        return F.struct(a.alias("a"), F.when(better, a).otherwise(s["best"]).alias("best"), F.when(better, i).otherwise(s["at"]).alias("at"), i.alias("i"))

    rows = reads.withColumn("_q", F.filter(S.phred(F.col("qual")), lambda q: q.isNotNull()))
    rows = rows.withColumn("_first", F.coalesce(F.array_position(F.transform("_q", lambda q: q >= m), F.lit(True)).cast("int"), F.lit(0)))
    rows = rows.withColumn("_from", F.slice("_q", F.greatest(c("_first"), F.lit(1)), F.size("_q") + 1))
    rows = rows.withColumn("_top", F.aggregate("_from", start, step, lambda s: s["at"]) + c("_first") - 1)
    rows = rows.withColumn("_inner", F.translate(F.substr("seq", c("_first"), c("_top") - c("_first") + 1), "N ", " "))
    rows = rows.withColumn("_left", c("_first") + F.length("_inner") - F.length(F.ltrim("_inner"))).withColumn("_right", c("_top") - F.length("_inner") + F.length(F.rtrim("_inner")))
    rows = rows.withColumn("_n", c("_right") - c("_left") + 1)
    rows = rows.withColumn("_sum", F.aggregate(F.slice("_q", F.greatest(c("_left"), F.lit(1)), F.greatest(c("_top") - c("_left") + 1, F.lit(0))), F.lit(0), lambda t, q: t + q))
    good = (c("_first") > 0) & (c("_n") >= max(1, conf.min_size)) & (F.floor(F.try_divide("_sum", "_n")) >= conf.min_mean)
    rows = rows.withColumn("discarded", ~F.coalesce(good, F.lit(False)))
    rows = rows.withColumns({"good_start": F.when(~c("discarded"), c("_left").cast("int")), "good_stop": F.when(~c("discarded"), c("_right").cast("int"))})
    return rows.select(*reads.columns, "good_start", "good_stop", "discarded")


def trimmed(reads: DataFrame) -> DataFrame:
    """Sequence and quality of the good regions; discarded reads keep neither."""
    part = lambda c: S.good_part(F.col(c), F.col("good_start"), F.col("good_stop"), F.col("discarded"))
    return reads.withColumns({"seq": part("seq"), "qual": part("qual")})


def region_of_rows(rows: DataFrame, key: str, order: list[str], quality: str, min_phred: int) -> DataFrame:
    """The same region where each quality is a row of its own, by windows: key, first and last ordinal, and the sum between."""
    own = Window.partitionBy(key)
    seen = rows.withColumn("i", F.row_number().over(own.orderBy(*order))).withColumn("first", F.min(F.when(F.col(quality) >= min_phred, F.col("i"))).over(own)).where("i >= first")
    upto = own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    summed = seen.withColumn("s", F.sum(F.col(quality) - min_phred).over(upto))
    a = summed.withColumn("a", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    last = a.withColumn("last", F.max(F.struct("a", "i")).over(own)["i"])
    return last.where("i <= last").groupBy(key).agg(F.min("i").alias("first_pos"), F.max("i").alias("last_pos"), F.sum(quality).alias("total"))


def admitted(reads: DataFrame, max_errors: Column) -> DataFrame:
    """Adds low_quality (discarded) and searchable: neither discarded nor with more N than errors in its good part."""
    good = S.good_part(F.col("seq"), F.col("good_start"), F.col("good_stop"), F.col("discarded"))
    return reads.withColumn("low_quality", F.col("discarded")).withColumn("searchable", ~F.col("discarded") & (S.n_count(good) <= max_errors))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows with their columns worked out once: a generator stands after them, through which filters and projections aren't pushed, so what comes later doesn't repeat long expressions."""
    return rows.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))))

"""Headers of several files as one, and their records with the names that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sam import TAGS
from strandloom.operators.kept import kept

#: A chain of programs longer than this is taken for a circle.
LONGEST = 1000


def _content(attrs: Column, without: tuple[str, ...]) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(attrs, lambda k, v: ~k.isin(*without))))))


def _chains(programs: DataFrame) -> DataFrame:
    """Adds content to program lines (file, id, attrs): what the line says and what all programs before it are called and say, so that equal lines behind different programs differ. One join for each program of the longest chain."""
    own = programs.select("*", _content(F.col("attrs"), ("ID", "PP")).alias("content"), F.col("attrs")["PP"].alias("_next"))
    by_id = kept(programs.select("file", F.col("id").alias("_next"), _content(F.col("attrs"), ("PP",)).alias("_more"), F.col("attrs")["PP"].alias("_after")), "programs")
    own = kept(own, "programs")
    for _ in range(LONGEST):
        if not own.where("_next is not null").limit(1).count():
            return own.drop("_next")
        met = own.join(by_id, ["file", "_next"], "left")
        step = F.when(F.col("_next").isNotNull(), F.concat("content", F.lit(">"), F.md5(F.coalesce("_more", F.concat(F.lit("?"), "_next"))))).otherwise(F.col("content"))
        own = kept(met.select(*programs.columns, step.alias("content"), F.col("_after").alias("_next")), "programs")
    raise ValueError("a chain of programs has no end")


def renames(headers: DataFrame) -> DataFrame:
    """Read groups and programs of several files (file, rec_type, attrs) with the ID that each has in the merged header: file, rec_type, id, new_id, attrs. Lines that say the same share an ID; of others with one ID the first file's keeps it, each other one gets a part of its digest behind it.

    Programs are told apart by the chain that they end; a read group's program (PG) by that one's new ID."""
    lines = headers.where("rec_type in ('RG', 'PG')").select("file", "rec_type", F.col("attrs")["ID"].alias("id"), "attrs").dropDuplicates(["file", "rec_type", "id"])

    def named(own: DataFrame) -> DataFrame:
        first = own.groupBy("rec_type", "id", "content").agg(F.min("file").alias("_file"))
        rank = F.row_number().over(Window.partitionBy("rec_type", "id").orderBy("_file", "content"))
        new = F.when(rank == 1, F.col("id")).otherwise(F.concat("id", F.lit("."), F.left(F.md5("content"), F.lit(16))))
        return own.join(first.withColumn("new_id", new).drop("_file"), ["rec_type", "id", "content"])

    programs = named(_chains(lines.where("rec_type = 'PG'")))
    new = programs.select("file", F.col("id").alias("_pg"), F.col("new_id").alias("_new"))

    def pointed(own: DataFrame, key: str) -> DataFrame:
        """The attribute `key` as the ID that its program has now."""
        met = own.withColumn("_pg", F.col("attrs")[key]).join(new, ["file", "_pg"], "left")
        others = F.map_filter("attrs", lambda k, v: k != key)
        return met.withColumn("attrs", F.when(F.col("_new").isNull(), F.col("attrs")).otherwise(F.map_concat(others, F.create_map(F.lit(key), F.col("_new"))))).drop("_pg", "_new")

    groups = pointed(lines.where("rec_type = 'RG'"), "PG")
    groups = named(groups.withColumn("content", _content(F.col("attrs"), ("ID",))))
    cols = ["file", "rec_type", "id", "new_id", "attrs"]
    return pointed(programs, "PP").select(*cols).unionByName(groups.select(*cols))


def merged(headers: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """One header of several files' lines (file, ordinal, rec_type, attrs): ordinal, rec_type, attrs, by kind, file and place. Nothing that a file says is lost: lines that say the same are one, contigs of one name join their attributes, other clashes are renamed.

    The plan fails where contigs of one name have different attributes. The order of sorting (SO) stays where all files have the same, else it is unsorted; the version is the greatest."""
    renamed = renames(headers) if renamed is None else renamed
    kinds = F.array(*map(F.lit, ("HD", "SQ", "RG", "PG", "CO")))
    rank = F.when(F.array_position(kinds, F.col("rec_type")) > 0, F.array_position(kinds, F.col("rec_type"))).otherwise(9)
    place = F.min(F.struct("file", "ordinal")).alias("at")
    # Attributes of contigs, one by one.
    each = headers.where("rec_type = 'SQ'").select("file", "ordinal", F.col("attrs")["SN"].alias("name"), F.explode("attrs").alias("k", "v"))
    one = each.groupBy("name", "k").agg(F.min("v").alias("v"), F.max("v").alias("w"), place)
    same = F.when(F.col("v") == F.col("w"), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("headers differ at "), "name", F.lit(" "), "k")))
    contigs = one.withColumn("v", same).groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"), F.min("at").alias("at")).select(F.lit("SQ").alias("rec_type"), "attrs", "at")
    head = headers.where("rec_type = 'HD'").agg(F.count("*").alias("n"), F.max(F.col("attrs")["VN"]).alias("vn"), F.collect_set(F.coalesce(F.col("attrs")["SO"], F.lit("unknown"))).alias("so"), place).where("n > 0")
    order = F.when(F.size("so") == 1, F.col("so")[0]).otherwise("unsorted")
    head = head.select(F.lit("HD").alias("rec_type"), F.create_map(F.lit("VN"), F.coalesce("vn", F.lit("1.0")), F.lit("SO"), order).alias("attrs"), "at")
    where = headers.select("file", "ordinal", "rec_type", F.col("attrs")["ID"].alias("id"))
    named = renamed.join(where, ["file", "rec_type", "id"]).withColumn("attrs", F.map_concat(F.create_map(F.lit("ID"), "new_id"), F.map_filter("attrs", lambda k, v: k != "ID")))
    named = named.groupBy("rec_type", "new_id").agg(F.min_by("attrs", F.struct("file", "ordinal")).alias("attrs"), place).select("rec_type", "attrs", "at")
    rest = headers.where("rec_type not in ('HD', 'SQ', 'RG', 'PG')").withColumn("_c", _content(F.col("attrs"), ())).groupBy("rec_type", "_c").agg(F.first("attrs").alias("attrs"), place).drop("_c")
    lines = head.unionByName(contigs).unionByName(named).unionByName(rest)
    return lines.select((F.row_number().over(Window.orderBy(rank, "at", F.to_json("attrs"))) - 1).alias("ordinal"), "rec_type", "attrs")  # the lines of one header


def rewritten(records: DataFrame, renamed: DataFrame) -> DataFrame:
    """Records (file, typed tags and more) whose RG and PG tags name what the merged header has. Only changed names are joined; tags keep their codes and order."""
    changed = renamed.where("id <> new_id").select("file", "rec_type", "id", "new_id")
    for kind in ("RG", "PG"):
        own = changed.where(F.col("rec_type") == kind).select("file", F.col("id").alias("_old"), F.col("new_id").alias("_new"))
        met = records.withColumn("_old", F.col("tags")[kind]["value"]).join(own, ["file", "_old"], "left")
        tags = F.transform_values("tags", lambda k, v: F.when((k == kind) & F.col("_new").isNotNull(), F.struct(v["code"].alias("code"), F.col("_new").alias("value"))).otherwise(v))
        records = met.withColumn("tags", tags.cast(TAGS)).select(*records.columns)
    return records

"""The trie of conversations by families: rebuilt conversations, nodes merged within families first, then over all.

A conversation's rows in order of turn (null first; ties by a hash of role and text) are its turns; a null role or text is empty. Ids that share a base (the id less its remainder by `family`) are a
family: each conversation is rebuilt from the first h turns of its base and its own turns after its first h, h being a hash of its id modulo `heads`. A node of the trie is a distinct sequence of first turns.

1. A row keeps two hashes of its turn (128 bits) and the length of its text; texts are never shuffled. All rows are placed in one order of (base, base's own rows first, conversation, turn) by ranges, so that a
   conversation with any share of all rows is split, and runs of `BLOCK` places are blocks. A family is thus in one block, or in a few.
2. Rows meet what is known of their conversation (first place, h, turns taken from the base) by (base, block). A node's key is the exclusive or of hashes of (turn, depth) over its turns: running within a block, and
   carried over the blocks of a long conversation from a sum for each block.
3. In the same tasks nodes are first merged within their family and block, and only these go on to the merging of all families: smallest member, members.
4. A conversation owns the nodes whose smallest member it is, which are those from some depth on. Sums over a node's subtree are sums over its members of what each owns from that depth on: for the
   owner a sum from the deep end (by blocks of depth), for other members the sum of all they own. No step goes down the trie level by level.
5. The ids of a node's ends are cut into pieces in order of (node, id), and the pieces hashed in order: no task holds them all.

Rows with a null conv_id are left out; rows that repeat are turns like any other. A conversation without turns (its base is absent and it has at most h of its own) ends at the root. Other columns are
ignored. An empty table has no members and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.places import numbered
from strandloom.llm.shared import discard, partitions, prepare, table, written

FAMILY, HEADS = 100, 6
#: Places of a block at least, and blocks at most: what has rows in more than one block is twice as many rows at most.
BLOCK, BLOCKS = 1 << 16, 1 << 14
#: Ids in a piece of text that is hashed; a parent is hot if it has one in so many chains.
PIECE, HOT = 4096, 1000
_KEY = ["depth", "k1", "k2"]
_INFO = ["start", "n", "h", "t", "k1", "k2"]


def _terms(a: Column, b: Column, depth: Column) -> tuple[Column, Column]:
    """What a turn (its two hashes) at a depth adds to the two halves of a key."""
    return F.xxhash64(a, b, depth), F.xxhash64(F.lit(1), depth, b, a)


def _fold(heads: Column, upto: Column, half: int) -> Column:
    """Half a key of the first `upto` of a family's head turns."""
    add = lambda k, t: F.when(t["pos"] <= upto, k.bitwiseXOR(_terms(t["a"], t["b"], t["pos"])[half])).otherwise(k)
    return F.coalesce(F.aggregate(heads, F.lit(0).cast("long"), add), F.lit(0).cast("long"))


def _turns(conversations: DataFrame, family: int) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), F.length(text).alias("chars"))
    return rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)


def _added(met: DataFrame) -> DataFrame:
    """A conversation's own rows after its first h, with their depth and what they add to keys."""
    x1, x2 = _terms(F.col("a"), F.col("b"), F.col("depth"))
    return met.where("place - start >= h").withColumn("depth", F.expr("cast(place - start + 1 - h + t as int)")).withColumn("x1", x1).withColumn("x2", x2)


def _known(turns: DataFrame, heads: int, block: int) -> DataFrame:
    """A row for each conversation and block where it has rows: its first place, rows, h, the number (t) of its base's first turns (heads) that it takes, and its key before the block."""
    convs = turns.groupBy("base", "conv_id").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    convs = written(convs.withColumn("h", F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {heads} as int)")), "convs")
    spread = lambda df: df.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + n - 1) div {block}"))))
    first = spread(convs.where("conv_id = base").select("base", "start", F.least(F.lit(heads - 1), "n").alias("n")))
    own = turns.where("conv_id = base").join(first, ["base", "block"]).where("place < start + n")
    taken = own.groupBy("base").agg(F.sort_array(F.collect_list(F.struct((F.col("place") - F.col("start") + 1).cast("int").alias("pos"), "a", "b", "chars"))).alias("heads"))  # fewer than `heads` turns
    known = convs.join(taken, "base", "left").withColumn("t", F.least("h", F.coalesce(F.size("heads"), F.lit(0))))
    known = spread(known).withColumn("t1", _fold(F.col("heads"), F.col("t"), 0)).withColumn("t2", _fold(F.col("heads"), F.col("t"), 1))
    long = known.where(f"start div {block} < (start + n - 1) div {block}").select("base", "block", "conv_id", "start", "h", "t")  # at most two rows for each block
    sums = _added(turns.join(F.broadcast(long), ["base", "block", "conv_id"])).groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    carried = sums.select("conv_id", (F.col("block") + 1).alias("block"), F.bit_xor("x1").over(upto).alias("c1"), F.bit_xor("x2").over(upto).alias("c2"))
    key = lambda i: F.col(f"t{i}").bitwiseXOR(F.coalesce(F.col(f"c{i}"), F.lit(0).cast("long"))).alias(f"k{i}")
    found = written(known.join(carried, ["conv_id", "block"], "left").select("base", "block", "conv_id", "start", "n", "h", "t", "heads", key(1), key(2)), "known")
    discard(convs)
    return found


def _paths(turns: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """A row for each node on each rebuilt conversation's path: conv_id, depth, k1, k2, the key of the node above (p1, p2), chars of the last turn, and whether the path ends there.

    Turns and what is known of conversations meet by (base, block): in each conversation's rows the known row is first."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("b", "long"), ("chars", "int"))]
    rows = turns.select("base", "block", "conv_id", "place", "a", "b", "chars", F.lit(None).cast("struct<start: long, n: long, h: int, t: int, k1: long, k2: long>").alias("info"))
    heads = known.select("base", "block", "conv_id", F.lit(-1).cast("long").alias("place"), *none, F.struct(*_INFO).alias("info"))
    met = rows.unionByName(heads).repartition(max(1, partitions(turns.sparkSession)), "base", "block")
    run = Window.partitionBy("base", "block", "conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("info", F.first("info").over(run)).select("conv_id", "base", "block", "place", "a", "b", "chars", "info.*")
    met = met.where("place < 0 or place - start >= h").withColumn("depth", F.expr("cast(place - start + 1 - h + t as int)"))
    x1, x2 = _terms(F.col("a"), F.col("b"), F.col("depth"))
    met = met.withColumn("x1", F.when(F.col("place") < 0, F.col("k1")).otherwise(x1)).withColumn("x2", F.when(F.col("place") < 0, F.col("k2")).otherwise(x2))
    met = met.drop("k1", "k2").withColumn("k1", F.bit_xor("x1").over(run)).withColumn("k2", F.bit_xor("x2").over(run)).where("place >= 0")
    own = met.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "chars", F.expr("place - start + 1 = n").alias("ends"))
    # The root and the turns that are taken from the base, for each conversation once.
    each = known.where(f"block = start div {block}").select("conv_id", "heads", "t", F.expr("n <= h").alias("bare"), F.explode(F.sequence(F.lit(0), F.col("t"))).alias("depth"))
    fold = [_fold(F.col("heads"), F.col("depth") - above, half).alias(f"{name}{half + 1}") for name, above in (("k", 0), ("p", 1)) for half in (0, 1)]
    chars = F.coalesce(F.get("heads", F.col("depth") - 1)["chars"], F.lit(0)).alias("chars")
    return own.unionByName(each.select("conv_id", "depth", *fold, chars, F.expr("bare and depth = t").alias("ends")))


def _piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends in order of (node, id) to pieces of a node's ids joined by commas: the node, the piece's first id, the text."""
    names = [*_KEY, "first", "ids"]
    held: list[int] = []
    key = None

    def out():
        return [*key, held[0], ",".join(map(str, held))]

    rows: list[list] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for d, a, b, conv in zip(*columns):
            if held and ((d, a, b) != key or len(held) >= PIECE):
                rows.append(out())
                held = []
            key = (d, a, b)
            held.append(conv)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)
        rows = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out(), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (node, first id) to a SHA-256 of each node's ids."""
    key, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for d, a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if (d, a, b) != key:
                if state is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (d, a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string()))], [*_KEY, "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), (pa.int32(), pa.int64(), pa.int64(), pa.string()))], [*_KEY, "ends_sha256"])


def _ends(paths: DataFrame) -> DataFrame:
    n = max(1, partitions(paths.sparkSession))
    order = [*_KEY, "conv_id"]
    pieces = paths.where("ends").select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_piece, "depth int, k1 long, k2 long, first long, ids string")
    return pieces.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digest, "depth int, k1 long, k2 long, ends_sha256 string")


def _merged(paths: DataFrame) -> DataFrame:
    """Nodes: key, key above, smallest member, members, chars, and whether the smallest member ends there. A task reads families whole or in part and merges their nodes before any are shuffled."""
    least = F.min(F.struct("conv_id", "ends", "p1", "p2")).alias("least")
    nodes = paths.groupBy(*_KEY).agg(least, F.count("*").alias("n_convs"), F.min("chars").alias("chars"))
    return nodes.select(*_KEY, "least.*", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))


def _parents(chains: DataFrame, attached: DataFrame, nodes: DataFrame) -> DataFrame:
    """The owner of the node above each chain. Parents of more than 1 in `HOT` of all chains are fewer than `HOT`, so they are broadcast; no other has more."""
    starts = chains.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    most = attached.agg(F.coalesce(F.sum("attached"), F.lit(0))).first()[0] // HOT
    hot = F.broadcast(attached.where(F.col("attached") > most).select(*_KEY))
    owners = nodes.select(*_KEY, F.col("conv_id").alias("parent_conv_id"))
    few = F.broadcast(owners.join(hot, _KEY, "left_semi"))
    return starts.join(few, _KEY).unionByName(starts.join(hot, _KEY, "left_anti").join(owners, _KEY)).select("conv_id", "parent_conv_id")


def trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, block: int | None = None) -> DataFrame:
    """Conversations (conv_id, turn, role, text) to a row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prepare(conversations.sparkSession)
    order = [F.col("base"), F.col("conv_id") != F.col("base"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    placed, n, _ = numbered(_turns(conversations, family), order, "turns")
    block = block or max(BLOCK, -(-n // BLOCKS))
    turns = placed.withColumn("block", F.expr(f"place div {block}"))
    known = _known(turns, heads, block)
    paths = written(_paths(turns, known, block), "paths")
    discard(placed, known)
    nodes = written(_merged(paths), "nodes").withColumn("block", F.expr(f"depth div {block}"))
    # Chains: what each conversation owns, by blocks of depth.
    unit = ["conv_id", "block"]
    parts = written(nodes.groupBy(*unit).agg(F.sum("saved").alias("saved"), F.min(F.struct("depth", "p1", "p2")).alias("top")), "chains")
    chains = parts.groupBy("conv_id").agg(F.min("top").alias("top"), F.sum("saved").alias("total")).select("conv_id", "top.*", "total")
    attached = written(chains.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("attached")), "attached")
    counted = nodes.join(attached, _KEY, "left").withColumn("n_children", F.coalesce("attached", F.lit(0)) + F.when(F.col("ends"), 0).otherwise(1))
    counted = written(counted.drop("attached", "p1", "p2"), "counted")
    leaves = counted.where("n_children = 0").select("conv_id", F.lit(1).alias("leaf"))
    above = _parents(chains, attached, nodes)
    known = written(chains.join(leaves, "conv_id", "left").join(above, "conv_id", "left").select("conv_id", "depth", "total", F.coalesce("leaf", F.lit(0)).alias("leaf"), "parent_conv_id"), "owners")
    # What other members than the owner add to a node: all that they own lies below it.
    spread = known.where("depth > 0").select("conv_id", F.col("depth").alias("from"), "total", "leaf", F.explode(F.expr(f"sequence(0, (depth - 1) div {block})")).alias("block"))
    below = paths.select(*_KEY, "conv_id", F.expr(f"depth div {block}").alias("block")).join(spread, unit).where("depth < from")
    below = below.groupBy(*_KEY).agg(F.sum("total").alias("more"), F.sum("leaf").alias("leaves"))
    # What the owner adds: a sum from the deep end.
    deeper = F.coalesce(F.sum("saved").over(Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("deeper")
    info = parts.select(*unit, deeper).join(known.select("conv_id", F.col("depth").alias("from"), "leaf", "parent_conv_id"), "conv_id")
    run = F.sum("saved").over(Window.partitionBy(*unit).orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0))
    own = counted.withColumn("run", run).join(info, unit)
    parent = F.when(F.col("depth") > F.col("from"), F.col("conv_id")).otherwise(F.col("parent_conv_id"))
    own = own.select(*_KEY, "conv_id", parent.alias("parent_conv_id"), "n_convs", "n_children", "leaf", (F.col("run") + F.col("deeper")).alias("saved"))
    empty = hashlib.sha256(b"").hexdigest()
    out = own.join(below, _KEY, "left").join(_ends(paths), _KEY, "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), (F.col("leaf") + F.coalesce("leaves", F.lit(0))).cast("long").alias("n_leaves"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def op11_family_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of an id's digits byte by byte; a path is a list of a conversation's rebuilt turns.
_SQL = """WITH steps AS (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i)),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM steps),
o AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
d AS (SELECT conv_id, own, list_transform(range(length(CAST(conv_id AS VARCHAR))), lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i + 1, 1))) AS b FROM o),
h AS (SELECT conv_id, own, CAST(xor(list_reduce(b, lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1]), 4294967295), 4294967295) % 6 AS INT) AS h FROM d, tab),
p AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(o.own[1:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100),
m AS MATERIALIZED (SELECT conv_id, d, path[1:d] AS node, length(path) = d AS ends, CASE WHEN d > 0 THEN length(path[d].t) ELSE 0 END AS chars FROM p, lateral (SELECT unnest(range(length(path) + 1)) AS d) x),
n AS MATERIALIZED (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, min(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY node, d),
c AS MATERIALIZED (SELECT node[1:d - 1] AS above, count(*) AS k FROM n WHERE d > 0 GROUP BY 1),
l AS MATERIALIZED (SELECT n.*, coalesce(c.k, 0) AS n_children FROM n LEFT JOIN c ON c.above = n.node),
s AS (SELECT node[1:x] AS top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n - 1) * chars) AS saved FROM l, lateral (SELECT unnest(range(d + 1)) AS x) y GROUP BY 1)
SELECT l.conv_id, CAST(l.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(l.n AS BIGINT) AS n_convs, CAST(l.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, l.ends_sha256
FROM l JOIN s ON s.top = l.node LEFT JOIN n u ON l.d > 0 AND u.node = l.node[1:l.d - 1]"""
SQL = {"op11_family_trie": _SQL}
QUERIES = {"op11_family_trie": op11_family_trie}

"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets, and union-find grouping.

A document's set holds its distinct shingles of five words (tokens.words); with one to four words it holds the whole
sequence; without words it is empty and linked with nothing. Two documents are linked if 100 * |A and B| >= 85 * |A or B|.

SuperMinHash gives the elements of a set values r + j for the j-th place of a permutation of the signature's slots that
each element draws by itself; a slot keeps its least value. The step from j to j + 1 is left out as soon as all slots
are below j + 1, so large sets need the first place only. Steps run over all elements of many documents at once.

Signatures are cut into bands; documents with an equal band share a bucket. Equal sets are one document from the start,
so exact copies make no pairs. Buckets of at most `small` documents give all their pairs. Larger ones give each member
with each of the centres of the bucket, which are its least documents under several orders, so that their number of
pairs is in proportion to their members; these pairs are checked on the full sets. Where the members of a larger bucket
are then in more than one component, each of those outside the largest is compared with all other members of another
component: the bucket is cut into blocks, and a pair of blocks is one product of matrices over their shingles' 64-bit
hashes, that returns joined components and no pairs. Members of one component needn't be compared, as components are
all that is asked for. So each two documents that share a band are compared or in one component already; there is no cap.

What may be missed: a pair exactly at 0.85 shares none of 25 bands of 5 with a chance of 4e-7.

A node is a set, whatever documents have it, so two texts under one doc_id are two nodes, and one text under two is one.

Nulls in any column: a null text is an empty one; rows with a null doc_id take part by their text, count for no component_id
(null where no row of a component has an id) and are never `kept`; `unique` keeps one row of each component, with an id or not. Columns other than doc_id and
text are ignored whatever their names are. Rows that repeat a doc_id are reported each. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import tokens
from strandloom.llm.components import components
from strandloom.llm.shared import discard, partitions, prepare, table, written
from strandloom.llm.tokens import U, mix

BANDS, ROWS, WORDS, SMALL, CENTRES = 25, 5, 5, 8, 3
#: Documents and shingles of a block, and columns of a block's matrix.
BLOCK, SHINGLES, COLUMNS = 256, 1 << 20, 4096
_WEIGHTS = mix(np.arange(1, WORDS + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)


def shingles(hashed: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each row, sorted, from word hashes and their rows."""
    n, counts = len(hashed), np.bincount(row, minlength=rows)
    ends = np.cumsum(counts)
    if n >= WORDS:
        all_ = np.zeros(n - WORDS + 1, U)
        for k in range(WORDS):
            all_ += hashed[k : n - WORDS + 1 + k] * _WEIGHTS[k]
        all_ = mix(all_)
    found = []
    for c, end in zip(counts.tolist(), ends.tolist()):
        if c >= WORDS:
            s = np.sort(all_[end - c : end - WORDS + 1])
            found.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            found.append(mix(np.array([sum(int(h) * int(w) for h, w in zip(hashed[end - c : end], _WEIGHTS)) + c & 0xFFFFFFFFFFFFFFFF], U)))
        else:
            found.append(np.zeros(0, U))
    return found


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """A row of `slots` values for each set; an empty set has infinities."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full(len(sets) * slots, np.inf)
    elements = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    moved = None  # the part of each element's permutation that its swaps have touched
    for j in range(slots):
        if not len(elements):
            break
        drawn = mix(elements + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (drawn >> U(11)).astype(np.float64) * 2.0**-53 + j
        k = j + (mix(drawn ^ U(0x6A09E667F3BCC909)) % U(slots - j)).astype(np.int64)
        if moved is None and j == 0:
            slot, first = k, k
        else:
            if moved is None:  # few elements reach the second step; only these need their permutations
                moved = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                each = np.arange(len(elements))
                moved[each, first] = 0
                moved[:, 0] = first
            each = np.arange(len(elements))
            slot = moved[each, k].astype(np.int64)
            moved[each, k] = moved[:, j]
            moved[:, j] = slot
        np.minimum.at(least, owner * slots + slot, value)
        open_ = least.reshape(len(sets), slots).max(axis=1) > j + 1
        keep = open_[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
            first = first[keep]
            moved = moved[keep] if moved is not None else None
    return least.reshape(len(sets), slots)


def _signed(bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, bands * rows + 1, dtype=U)).reshape(bands, rows) | U(1)
        for batch in batches:
            ids, copies = batch.column(0), batch.column(2)
            for lo, hi, data, at in tokens.slices(batch.column(1), 1 << 19):
                hashed, row, _, _ = tokens.words(data, at)
                sets = shingles(hashed, row, hi - lo)
                sizes = np.array([len(s) for s in sets], np.int64)
                bits = superminhash(sets, bands * rows).view(U).reshape(len(sets), bands, rows)
                band = mix((mix(bits) * weights).sum(axis=2, dtype=U)).view(np.int64)
                twice = [np.array([int(f(s).sum(dtype=U)) for s in sets], U).view(np.int64) for f in (mix, lambda s: mix(s ^ U(0x510E527FADE682D1)))]
                some = sizes > 0
                offsets = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[some].ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), copies.slice(lo, hi - lo), pa.array(sizes), *(pa.array(x) for x in twice), lists], schema=schema)

    return run


def word_sets(text: str) -> set:
    """The set of a text, of tuples of words, without hashing to a number."""
    w = text.encode().lower().split()
    return {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)} if len(w) >= WORDS else ({tuple(w)} if w else set())


def _confirmed(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            out: list = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if last[0] != a:
                    last = (a, word_sets(x))
                mine, other = last[1], word_sets(y)
                if min(len(mine), len(other)) * 100 >= percent * max(len(mine), len(other)):
                    both = len(mine & other)
                    if both and 100 * both >= percent * (len(mine) + len(other) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], schema=schema)

    return run


def _orders(keys: list[str]) -> list:
    """The centres of a bucket: its least node, its greatest, and the least by a hash that differs from bucket to bucket."""
    return [F.min("node").alias("c0"), F.max("node").alias("c1"), *(F.min(F.struct(F.xxhash64("node", *keys, F.lit(i)).alias("h"), "node")).getField("node").alias(f"c{i}") for i in range(2, CENTRES))]


def _pairs(members: DataFrame, keys: list[str], small: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) from buckets of members (node and keys), and the members of large buckets: these have pairs with the centres only."""
    buckets = written(members.groupBy(*keys).agg(F.count("*").alias("n"), *_orders(keys)).where("n > 1"), "buckets")
    joined = members.join(buckets, keys)
    star = joined.select("node", F.explode(F.array_distinct(F.array(*(f"c{i}" for i in range(CENTRES))))).alias("c"))
    few = written(joined.where((F.col("n") > 3) & (F.col("n") <= small)).select("node", *keys), "few")
    pairs = few.join(few.withColumnRenamed("node", "c"), keys).select("node", "c")
    both = star.unionByName(pairs).where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    both, large = written(both, "pairs"), written(joined.where(F.col("n") > small).select("node", *keys), "large")
    discard(buckets, few)
    return both, large


def _linked(texts: list, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Components, and the least component that each is joined with by links between the texts at left and those at right. Components that stay alone are left out."""
    data = pa.array(texts, pa.string())
    sets: list = []
    for lo, hi, raw, at in tokens.slices(data, 1 << 19):
        hashed, row, _, _ = tokens.words(raw, at)
        sets += shingles(hashed, row, hi - lo)
    sizes = np.array([len(x) for x in sets], np.int64)
    one, two = (np.concatenate([sets[i] for i in side]) for side in (left, right))
    shared = np.intersect1d(one, two)
    both = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2**24 are exact
    held = []
    for side, all_ in ((left, one), (right, two)):
        at = np.searchsorted(shared, all_)
        known = at < len(shared)
        known[known] = shared[at[known]] == all_[known]
        order = np.argsort(at[known], kind="stable")
        held.append((at[known][order], np.repeat(np.arange(len(side)), sizes[side])[known][order], len(side)))
    for lo in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - lo)
        parts = []
        for at, row, n in held:
            i, j = np.searchsorted(at, [lo, lo + width])
            x = np.zeros((n, width), np.float32)
            x[row[i:j], at[i:j] - lo] = 1
            parts.append(x)
        both += parts[0] @ parts[1].T
    k = both.astype(np.int64)
    i, j = np.nonzero((100 * k >= percent * (sizes[left][:, None] + sizes[right][None, :] - k)) & (component[left][:, None] != component[right][None, :]))
    ids, place = np.unique(component, return_inverse=True)
    u, v = place[left[i]], place[right[j]]
    label = np.arange(len(ids))
    while True:  # least label over links, until it stays
        old = label.copy()
        np.minimum.at(label, u, old[v])
        np.minimum.at(label, v, old[u])
        label = label[label]
        if (label == old).all():
            break
    some = label != np.arange(len(ids))
    return ids[some], ids[label[some]]


def _crossed(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys = ("band", "code", "a", "b")

    def work(unit: pa.Table) -> pa.RecordBatch:
        a, b = unit.column("a")[0].as_py(), unit.column("b")[0].as_py()
        chunk, component = unit.column("chunk").to_numpy(), unit.column("component").to_numpy()
        left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
        if not len(left) or not len(right):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema=schema)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _linked(unit.column("text").to_pylist(), component, left, right, percent)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # batches of the unit that is open
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                own = tuple(key[:, lo].tolist())
                if held and own != last:
                    yield work(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = own
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").sortWithinPartitions("a")
    return written(both.mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")


def grouped(documents: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Documents (doc_id, text) to one row each: doc_id, text_id (a hash of the text), n_shingles, group (a number of the component, null for empty sets) and component_id (the least doc_id reached by links)."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_id"))
    signed = written(docs.mapInArrow(_signed(bands, rows), "doc_id long, text_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signed")
    key = ["set_a", "set_b", "n_shingles"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_id"))
    sets = written(signed.where("n_shingles > 0").groupBy(*key).agg(first.alias("first"), F.first("bands").alias("bands")).withColumn("node", F.col("set_a")), "sets")
    nodes = sets.select("node", F.col("n_shingles").alias("size"), "first.doc_id", "first.text_id")
    pairs, large = _pairs(sets.select("node", F.posexplode("bands").alias("band", "code")), ["band", "code"], small)
    touched = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", F.col("doc_id").alias("_doc_id"), F.col("text_id").alias("_text_id"))
    texts = docs.join(touched, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_id") == F.col("_text_id")))
    texts = written(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")
    links = _verify(pairs, texts, percent)
    found = components(links)
    discard(pairs, links)
    # Large buckets that hold several components: each member outside the largest one meets all members, in blocks.
    bucket = ["band", "code"]
    labelled = written(large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(nodes.select("node", "size"), "node"), "labelled")
    discard(large)
    parts = labelled.groupBy(*bucket, "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    chunks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / SHINGLES)).cast("int")
    mixed = parts.groupBy(*bucket).agg(F.max(F.struct("n", "size", "component")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    mixed = written(mixed.select(*bucket, F.col("top.component").alias("largest"), chunks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("p"), chunks(F.col("top.n"), F.col("top.size")).alias("q")), "mixed")
    inside = F.col("component") == F.col("largest")
    dealt = F.xxhash64("node", *bucket)
    member = labelled.join(mixed, bucket).withColumn("chunk", F.when(inside, F.col("p") + F.pmod(dealt, F.col("q"))).otherwise(F.pmod(dealt, F.col("p"))).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("p")).otherwise(F.col("p") + F.col("q")) - 1)))
    units = written(member.select("node", "component", *bucket, "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")), "units")
    discard(labelled, mixed)
    if units.limit(1).count():
        order = [*bucket, "a", "b"]
        full = units.join(texts, "node").select(*order, "chunk", "component", "text").repartition(max(partitions(documents.sparkSession), 1), *order).sortWithinPartitions(*order)
        more = written(full.mapInArrow(_crossed(percent), "a long, b long"), "crossed")
        before, found = found, components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        discard(before, more)
    discard(units, texts)
    # Components by their least doc_id.
    named = found.join(nodes.select("node", "doc_id"), "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = found.join(least, "component").select("node", "component", "component_id")
    classes = nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    classes = written(classes, "classes")
    discard(sets, found)
    met = signed.select("doc_id", "text_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("node")).join(classes, "node", "left")
    return met.select("doc_id", "text_id", "n_shingles", "group", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(documents: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Documents (doc_id, text) to one row each: doc_id, n_shingles, component_id (the least doc_id reached by links) and kept."""
    found = grouped(documents, percent, bands, rows, small, block)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def unique(documents: DataFrame, **settings) -> DataFrame:
    """The documents, with all their columns, of which one row of each component stays: the one with the least doc_id (null after all others), of several the one with the least hash of its text, of equal ones any. Rows without words stay."""
    found = written(grouped(documents, **settings), "grouped")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_id")).alias("one")
    heads = found.where("group is not null").groupBy("group").agg(one).select(F.col("one.doc_id").alias("_doc_id"), F.col("one.text_id").alias("_text_id"), F.lit(True).alias("_head"))
    empty = found.where("group is null").select(F.col("doc_id").alias("_doc_id"), F.col("text_id").alias("_text_id"), F.lit(False).alias("_head")).distinct()
    keys = written(heads.unionByName(empty), "heads")
    text_id = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (text_id == F.col("_text_id"))
    met = documents.join(keys, same)
    repeats = written(found.where("group is not null").groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_doc_id"), F.col("text_id").alias("_text_id"), F.lit(True).alias("_again")), "repeats")
    discard(found)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    if not repeats.limit(1).count():
        return met.select(*columns)
    # Equal rows under one id: one of them stays.
    told = met.join(repeats, (F.col("_head")) & met["_doc_id"].eqNullSafe(repeats["_doc_id"]) & (met["_text_id"] == repeats["_text_id"]), "left").select(*columns, met["_doc_id"].alias("_a"), met["_text_id"].alias("_b"), "_again")
    alone = told.where("_again is null").select(*columns)
    return alone.unionByName(told.where("_again").dropDuplicates(["_a", "_b"]).select(*columns))


def op2_superminhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN length(w) >= 5 THEN list_distinct(list_transform(range(1, length(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN length(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, CAST(length(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.c) AS component_id, min(r.c) = n.doc_id AS kept FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id"""
SQL = {"op2_superminhash_dedup": _SQL}
QUERIES = {"op2_superminhash_dedup": op2_superminhash_dedup}

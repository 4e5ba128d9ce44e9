"""Language-model scores from a hidden Markov model over word classes, trained by Baum-Welch on all training documents.

Tokens are words (tokens.words) and one end per text. The base model is the unigram one of all training tokens: a word of count c has
probability (c + 0.5) / (N + 0.5 (V + 1)), an unseen one 0.5 / (N + 0.5 (V + 1)). The `own` most frequent words and the end are classes by themselves; other words
go to one of `suffixes` classes by their last three bytes. In state s a word w of class k has probability
e_s(k) * base(w) / base(k), where base(k) is the class's share; an unseen word has the same probability in each state as in the base. So each state
is a distribution over seen words and the unseen event, and the log probability of a text is its base score plus the log of the forward recursion over
the ratios e_s(k) / base(k), which is scaled at each token and exact.

Jobs: (1) counts of all words of training documents, summed where they are read, then over the cluster; (2) texts become chunks of class numbers, written once,
with the hashes of words outside the `top` most frequent, whose counts are broadcast (at most `top` numbers); (3) `rounds` of Baum-Welch over the chunks:
each task sums expected counts of its passages, a pass's sums (states times classes, at most) come to the driver, which sets the next parameters; training passages are
cut after `passage` tokens, and each token of each training document is in one of them; (4) the counts of rarer words meet the hashes of the
chunks by a join, and (5) each chunk is scored, documents whole. Nothing that grows with the corpus is broadcast or collected.

A word is known by a 64-bit hash: in a vocabulary of V words two share one with a chance of about V**2 / 2**65, which is 3e-6 at ten million.
Null text is empty (the end only); rows with a null doc_id train nothing and are scored, with held_out null (inside, the least long stands for a missing id); repeated rows each count and are each scored; other columns are ignored; an empty table gives no rows. Without training documents N and V are 0 and
every score equals the base score.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import tokens
from strandloom.llm.shared import prepare, table, written
from strandloom.llm.tokens import U, mix

STATES, OWN, SUFFIXES, TOP, ROUNDS, PASSAGE, CHUNK = 6, 8192, 1024, 1 << 18, 4, 512, 1 << 21
END = np.int64(0x7E57E4D0FACADE5)
#: Tokens that are handled side by side.
_GROUP = 3_000_000


def _read(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and suffix classes of the tokens of texts side by side, an end after each text, and numbers of tokens."""
    hashed, row, start, end = tokens.words(data, at)
    texts = len(at) - 1
    tail = np.zeros(len(end), np.int64)
    for i in (1, 2, 3):
        tail = tail * 256 + np.where(end - i >= start, data[np.maximum(end - i, 0)], 0)
    suffix = (mix(tail.astype(U)) % U(SUFFIXES)).astype(np.int32)
    sizes = np.bincount(row, minlength=texts) + 1
    place = np.arange(len(hashed)) + row  # one end before for each text before
    all_, classes = np.full(len(hashed) + texts, END), np.zeros(len(hashed) + texts, np.int32)
    all_[place], classes[place] = hashed.view(np.int64), suffix
    return all_, classes, sizes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, suffix class and count of the words of training texts."""
    held: list[tuple] = []

    def out():
        h, s, c = (np.concatenate(x) for x in zip(*held))
        word, first, back = np.unique(h, return_index=True, return_inverse=True)
        held.clear()
        return word, s[first], np.bincount(back, c, len(word)).astype(np.int64)

    size = 0
    for batch in batches:
        for _, _, data, at in tokens.slices(batch.column(0)):
            h, s, _ = _read(data, at)
            word, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((word, s[first], n))
            size += len(word)
        if size > 2_000_000:
            held.append(out())
            size = len(held[0][0])
            if size > 1_500_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["word", "suffix", "n"])
                size = 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out()], ["word", "suffix", "n"])


#: Stands for a missing id.
WITHOUT = -(1 << 63)
_CHUNK = "chunk long, doc_ids binary, train binary, sizes binary, base binary, known binary, classes binary, rare_at binary, rare_of binary, rare array<long>"


def _chunked(common, total: float):
    """Texts to chunks. common: broadcast sorted hashes of the most frequent words, their counts and classes (-1: by suffix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, count, own = common.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in tokens.slices(batch.column(2), CHUNK):
                h, suffix, sizes = _read(data, at)
                place = np.minimum(np.searchsorted(word, h), len(word) - 1) if len(word) else np.zeros(len(h), np.int64)
                hit = word[place] == h if len(word) else np.zeros(len(h), bool)
                cls = np.where(hit, own[place], -1) if len(word) else np.full(len(h), -1)
                cls = np.where(cls < 0, np.where(h == END, OWN + SUFFIXES, OWN + suffix), cls).astype(np.uint16)
                owner = np.repeat(np.arange(hi - lo), sizes)
                base = np.bincount(owner[hit], np.log10((count[place[hit]] + 0.5) / total), hi - lo).astype(float)
                known = np.bincount(owner[hit], minlength=hi - lo)
                rare_at = np.flatnonzero(~hit)
                rare, rare_of = np.unique(h[rare_at], return_inverse=True)
                parts = [ids[lo:hi].astype(np.int64), train[lo:hi].astype(np.uint8), sizes.astype(np.int64), base, known.astype(np.int64), cls, rare_at.astype(np.int32), rare_of.astype(np.int32)]
                key = int.from_bytes(os.urandom(8), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([key]), *(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([rare], pa.list_(pa.int64()))], [x.split()[0] for x in _CHUNK.split(", ")])

    return run


def forward_backward(cls: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, move: np.ndarray, ratio: np.ndarray):
    """Expected counts of sequences (start and size in cls): of first states, of moves, and of states by class; and the log likelihood ratio."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    k, steps = len(first), int(size[0])
    live = len(size) - np.searchsorted(size[::-1], np.arange(steps), "right")
    edge = np.concatenate(([0], np.cumsum(live)))
    alpha, scale, seen = np.empty((edge[-1], k)), np.empty(edge[-1]), np.empty(edge[-1], cls.dtype)
    for t, n in enumerate(live.tolist()):
        seen[edge[t] : edge[t + 1]] = c = cls[start[:n] + t]
        a = alpha[edge[t] : edge[t + 1]]
        if t:
            np.matmul(alpha[edge[t - 1] : edge[t - 1] + n], move, out=a)
        else:
            a[:] = first
        a *= ratio[c]
        s = scale[edge[t] : edge[t + 1]]
        a.sum(axis=1, out=s)
        a /= s[:, None]
    moves, beta = np.zeros((k, k)), np.ones((int(live[-1]), k))
    for t in range(steps - 1, 0, -1):
        n = int(live[t])
        a = alpha[edge[t] : edge[t + 1]]
        ahead = ratio[seen[edge[t] : edge[t + 1]]] * beta
        ahead /= scale[edge[t] : edge[t + 1], None]
        a *= beta  # now the state probabilities given the whole sequence
        before = alpha[edge[t - 1] : edge[t - 1] + n]
        moves += before.T @ ahead
        beta = np.ones((int(live[t - 1]), k))
        np.matmul(ahead, move.T, out=beta[:n])
    alpha[: edge[1]] *= beta
    by_class = np.stack([np.bincount(seen, alpha[:, s], len(ratio)) for s in range(k)])
    return alpha[: edge[1]].sum(axis=0), moves * move, by_class, float(np.log10(scale).sum())


def forward(cls: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, move: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """log10 of the likelihood ratio of each sequence."""
    order = np.argsort(-size, kind="stable")
    begins, sizes = start[order], size[order]
    found, live = np.zeros(len(size)), len(size) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")
    a = np.tile(first, (len(size), 1))
    for t, n in enumerate(live.tolist()):
        a = a[:n] @ move if t else a
        a *= ratio[cls[begins[:n] + t]]
        s = a.sum(axis=1)
        a /= s[:, None]
        found[:n] += np.log10(s)
    out = np.empty_like(found)
    out[order] = found
    return out


def _expected(model):
    """Rows (state, what, n) of expected counts of a task: what is -1 for first states, -2 - j for moves to j, else a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, move, ratio = model.value
        k = len(first)
        sums: list | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def work():
            cls = np.concatenate([h[0] for h in held])
            size = np.concatenate([h[1] for h in held])
            held.clear()
            start = np.cumsum(size) - size
            pieces = -(-size // PASSAGE)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.repeat(start, pieces) + nth * PASSAGE
            length = np.minimum(np.repeat(start + size, pieces) - begin, PASSAGE)
            return forward_backward(cls, begin, length, first, move, ratio)

        def add(got):
            nonlocal sums
            sums = list(got) if sums is None else [x + y for x, y in zip(sums, got)]

        n = 0
        for batch in batches:
            for train, sizes, classes in zip(*(c.to_pylist() for c in batch.columns)):
                size = np.frombuffer(sizes, np.int64)
                mine = np.frombuffer(train, np.uint8).astype(bool)
                if mine.any():
                    held.append((np.frombuffer(classes, np.uint16)[np.repeat(mine, size)], size[mine]))
                    n += int(held[-1][1].sum())
                if n > _GROUP // 3:
                    add(work())
                    n = 0
        if held:
            add(work())
        if sums is not None:
            state, what = np.nonzero(sums[2])
            values = [(np.arange(k), np.full(k, -1), sums[0]), *((np.arange(k), np.full(k, -2 - j), sums[1][:, j]) for j in range(k)), (state, what, sums[2][state, what]), (np.array([-1]), np.array([0]), np.array([sums[3]]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v[i] for v in values]).astype(t)) for i, t in enumerate((np.int32, np.int32, np.float64))], ["state", "what", "n"])

    return run


def _scored(model, total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, move, ratio = model.value
        ratio = np.vstack([ratio, np.ones(len(first))])  # an unseen word
        unseen = len(ratio) - 1
        for batch in batches:
            held: list[tuple] = []

            def out():
                ids, size, base, known, cls = (np.concatenate([h[i] for h in held]) for i in range(5))
                held.clear()
                score = base + forward(cls, np.cumsum(size) - size, size, first, move, ratio)
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, size, known, base, score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

            for row in range(batch.num_rows):
                part = {n: batch.column(n)[row] for n in batch.schema.names}
                take = lambda n, t: np.frombuffer(part[n].as_py(), t)
                size, base, known = take("sizes", np.int64), take("base", np.float64).copy(), take("known", np.int64).copy()
                cls, at, of = take("classes", np.uint16).copy(), take("rare_at", np.int32), take("rare_of", np.int32)
                if len(at):
                    words = part["rare"].values.to_numpy()
                    count = np.zeros(len(words), np.int64)
                    if part["counts"].is_valid:
                        told = part["counts"].values
                        count[np.searchsorted(words, told.field("word").to_numpy())] = told.field("n").to_numpy()
                    c = count[of]
                    owner = np.repeat(np.arange(len(size)), size)[at]
                    base += np.bincount(owner, np.log10((c + 0.5) / total), len(size))
                    known += np.bincount(owner[c > 0], minlength=len(size))
                    cls[at[c == 0]] = unseen
                held.append((take("doc_ids", np.int64), size, base, known, cls))
                if sum(len(h[4]) for h in held) > _GROUP:
                    yield out()
            if held:
                yield out()

    return run


def _start(share: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First parameters: states that tend to stay, with ratios drawn by state and class."""
    ratio = np.exp(np.random.default_rng(11).uniform(-1, 1, (len(share), states)))
    ratio /= np.maximum((ratio * share[:, None]).sum(axis=0), 1e-300)
    move = np.full((states, states), 0.02 / max(states - 1, 1))
    np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
    return np.full(states, 1 / states), move, ratio


def scores(documents: DataFrame, states: int = STATES, rounds: int = ROUNDS, top: int = TOP) -> DataFrame:
    """Documents (doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Training documents are those whose crc32(doc_id as text) mod 5 is not 1."""
    spark = documents.sparkSession
    prepare(spark)
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(WITHOUT)).alias("doc_id"), F.col("text").cast("string"))
    train = (F.col("doc_id") != WITHOUT) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    counts = written(docs.where(train).select("text").mapInArrow(_counted, "word long, suffix int, n long").groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n")), "counts")
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total = known.n + 0.5 * (known.v + 1)
    size = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.size, r.words) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()), reverse=True)  # a thousand rows at most
    least = next((sizes[i][0] + 1 for i in range(len(sizes)) if sum(x[1] for x in sizes[: i + 1]) > top), 0)  # all words from this size on are no more than `top`
    frequent = counts.where(size >= least).select("word", "suffix", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])  # at most `top` rows
    word, suffix, n = frequent["word"].to_numpy(np.int64), frequent["suffix"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)
    own = np.where(np.arange(len(word)) < OWN, np.arange(len(word)), -1)
    own[word == END] = -1
    mass = np.zeros(OWN + SUFFIXES + 1)
    for r in counts.where(F.col("word") != int(END)).groupBy("suffix").agg(F.sum(F.col("n") + 0.5).alias("m")).collect():  # at most SUFFIXES rows
        mass[OWN + r.suffix] = r.m
    np.subtract.at(mass, OWN + suffix[own >= 0], n[own >= 0] + 0.5)
    mass[own[own >= 0]] = n[own >= 0] + 0.5
    mass[-1] = (n[word == END] + 0.5).sum()
    if known.v and not (word == END).any():
        mass[-1] = counts.where(F.col("word") == int(END)).first().n + 0.5
    share = np.maximum(mass, 0) / total
    order = np.argsort(word)
    common = spark.sparkContext.broadcast((word[order], n[order], own[order]))
    chunks = written(docs.select("doc_id", train.alias("train"), "text").mapInArrow(_chunked(common, total), _CHUNK), "chunks")
    first, move, ratio = _start(share, states)
    for _ in range(rounds if known.n else 0):
        model = spark.sparkContext.broadcast((first, move, ratio))
        told = chunks.select("train", "sizes", "classes").mapInArrow(_expected(model), "state int, what int, n double").groupBy("state", "what").agg(F.sum("n").alias("n")).where("state >= 0").toPandas()  # states times classes rows at most
        begin, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((len(share), states))
        s, w, v = (told[c].to_numpy() for c in ("state", "what", "n"))
        begin[s[w == -1]] = v[w == -1]
        moves[s[w < -1], -2 - w[w < -1]] = v[w < -1]
        emitted[w[w >= 0], s[w >= 0]] = v[w >= 0]
        first = (begin + 1) / (begin + 1).sum()
        move = (moves + 1) / (moves + 1).sum(axis=1, keepdims=True)
        # Each state's emissions with a prior of 100 tokens spread as in the base; unseen words keep what the base gives them.
        emitted += 100 * share[:, None]
        emitted *= (1 - 0.5 / total) / emitted.sum(axis=0)
        ratio = np.where(share[:, None] > 0, emitted / np.maximum(share[:, None], 1e-300), 1.0)
    if not known.n:
        ratio = np.ones((len(share), states))
    model = spark.sparkContext.broadcast((first, move, ratio))
    wanted = chunks.select("chunk", F.explode("rare").alias("word"))
    met = wanted.join(counts.select("word", "n"), "word").groupBy("chunk").agg(F.collect_list(F.struct("word", "n")).alias("counts"))  # as many as the chunk has words, by its bounded size
    ready = chunks.drop("train").join(met, "chunk", "left").drop("chunk")
    scored = ready.mapInArrow(_scored(model, total), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    own = F.nullif(F.col("doc_id"), F.lit(WITHOUT))
    return scored.select(own.alias("doc_id"), (F.crc32(own.cast("string")) % 5 == 1).alias("held_out"), "n_tokens", "n_known", F.lit(int(known.n)).cast("long").alias("train_tokens"), "base_score", "score")


def op1_hmm_scores(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op1_hmm_scores": op1_hmm_scores}

"""Toxicity of documents: a learned lexicon in a trie, met by Levenshtein automata, with scores of context windows.

Learning uses labelled rows only whose crc32(doc_id as text) mod 5 is not 0, at most `sample` of each label, those with
the least xxhash64 of their id. Where that leaves rows of a label out, those that are read stand for them: each counts as all rows of its label divided by those read,
in the lexicon's rates and in the regression. Equal texts count once. The lexicon: words and stems
(beginnings of words) that stand in at least `support` toxic texts, after as many different words (so that near copies of
one text don't count as support), whose log odds are high, and that aren't there by accident (a test on the rows read, as weights are no evidence).
The weights are those of a logistic regression over what the lexicon finds, cross-fitted at every size: the texts are cut into `FOLDS` by a hash,
and the features of each come from a lexicon of all others. The lexicon that scores is one of all texts.

A word of a text meets the lexicon exactly, by a stem, or within one edit: the rows of the edit-distance automaton of the
word are carried down the trie and a branch is left when no state is alive. A word can only be within one edit of a term
if it shares the term's first or second half, so others never enter the trie. Each hit is weighed in a window of
`WINDOW` words to each side: a hit between quotation marks is a quoted one, and counts as a feature of its own.

Score: probability of label 1. Null and empty texts score as texts without a hit. No labels, or labels of one kind:
every score is the prior with one row of each kind added. Labels of ids that are absent, null labels and null ids are ignored in learning;
a null doc_id is scored, with held_out null. A doc_id with several labels counts as toxic if any is. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import partitions, prepare, table, written

SAMPLE, SUPPORT, TERMS, WINDOW, CACHE, FOLDS = 10_000, 3, 20_000, 8, 300_000, 5
#: Least exponent of the bound on the chance that a word stands in as many toxic texts by accident: one in e**12, for many words are tried.
SURPRISE = 12.0
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_OPEN, _CLOSE = "«“„‘", "»”“’"
STEMS = range(4, 9)


def word_of(raw: str) -> str:
    return _EDGE.sub("", raw)


class Lexicon:
    """Terms (term, is_stem, weight) in a trie of dicts; under "" a node holds its (weight, is_stem, length)."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.root: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for term, stem, weight in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (weight, stem, len(term))
            self.heads.add(term[: len(term) // 2])
            if not stem:
                self.tails.add(term[len(term) // 2 :])
            elif len(term) >= 6:
                self.heads.add(term[: len(term) // 2])
                for shift in (-1, 0, 1):  # where the second half of a stem may stand
                    self.tails.add((len(term) // 2 + shift, term[len(term) // 2 :]))
        self.head_sizes = sorted({len(x) for x in self.heads})
        self.tail_sizes = sorted({len(x) for x in self.tails if isinstance(x, str)})
        self.inner = sorted({(x[0], len(x[1])) for x in self.tails if not isinstance(x, str)})

    def near(self, word: str) -> bool:
        return any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes if n) or any((at, word[at : at + n]) in self.tails for at, n in self.inner)

    def exact(self, word: str) -> float:
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if "" in node and node[""][1]:
                best = max(best, node[""][0])
        return max(best, node[""][0]) if "" in node else best

    def fuzzy(self, word: str) -> float:
        """The largest weight of a term within one edit; of a stem within one edit of a beginning. Terms of fewer than five characters, and stems of fewer than six, only match exactly."""
        best, n = 0.0, len(word)
        stack = [(self.root, {0: 0, 1: 1})]  # offset in word: edits so far, at most 1
        while stack:
            node, states = stack.pop()
            if "" in node:
                weight, stem, size = node[""]
                if size >= (6 if stem else 5) and (stem or any(n - i + e <= 1 for i, e in states.items())):
                    best = max(best, weight)
            for c, child in node.items():
                if c == "":
                    continue
                new: dict[int, int] = {}
                for i, e in states.items():
                    if i < n and word[i] == c:
                        new[i + 1] = min(e, new.get(i + 1, 2))
                    if e == 0:  # the term's character stands in for one of the word, or is left out of it
                        new[i + 1] = min(1, new.get(i + 1, 2))
                        new[i] = min(1, new.get(i, 2))
                for i in [i for i, e in new.items() if e == 0 and i < n]:  # the word has one character more
                    new.setdefault(i + 1, 1)
                new = {i: e for i, e in new.items() if i <= n}
                if new:
                    stack.append((child, new))
        return best

    def match(self, raw: str) -> tuple[float, bool] | None:
        word = word_of(raw)
        if not word or not self.near(word):
            return None
        if weight := self.exact(word):
            return weight, True
        weight = self.fuzzy(word)
        return (weight, False) if weight else None


class Matcher(dict):
    """Raw words to their hits, kept up to a bound."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str):
        if len(self) > CACHE:
            self.clear()
        found = self[raw] = self.lexicon.match(raw)
        return found


def quoted(words: list[str], i: int) -> bool:
    """Whether word i stands between quotation marks that open and close within the window."""
    before = " ".join(words[max(0, i - WINDOW) : i]) + " " + words[i][: len(words[i]) - len(words[i].lstrip("\"'«“„‘("))]
    after = words[i][len(words[i].rstrip("\"'»”“’.,;:!?)")) :] + " " + " ".join(words[i + 1 : i + 1 + WINDOW])
    straight = before.count('"') % 2 == 1 and '"' in after
    curly = max(before.rfind(c) for c in _OPEN) > max(before.rfind(c) for c in "»”") and any(c in after for c in _CLOSE)
    return straight or curly


def features(text: str | None, matcher: Matcher) -> list[float]:
    """Sums of hits that are exact, within an edit, and quoted; the densest window; and whether one hit stands alone."""
    words = (text or "").lower().split()
    hits = [(i, h) for i, h in enumerate(map(matcher.__getitem__, words)) if h is not None]
    if not hits:
        return [0.0] * 5
    exact = fuzzy = quote = 0.0
    at = []
    for i, (weight, is_exact) in hits:
        if quoted(words, i):
            quote += weight
        else:
            at.append(i)
            if is_exact:
                exact += weight
            else:
                fuzzy += weight
    dense = max((sum(1 for j in at[k : k + 32] if j - i <= 2 * WINDOW) for k, i in enumerate(at)), default=0)
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quote), float(min(dense, 4)), float(min(len(at), 3))]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems of labelled texts: a row for each toxic text with the word that stands before, and counts of clean texts by fold."""
    clean: Counter = Counter()
    names = ["term", "stem", "fold", "before", "toxic", "clean"]

    def rows(keys, before, toxic, n):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array(before, pa.string()), pa.array(toxic, pa.int64()), pa.array(n, pa.int64())], names)

    for batch in batches:
        found: list[tuple[tuple[str, bool, int], str]] = []
        for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = [word_of(w) for w in (text or "").lower().split()]
            before: dict[tuple[str, bool, int], str] = {}
            for i, w in enumerate(own):
                if w:
                    for key in ((w, False, fold), *((w[:n], True, fold) for n in STEMS if len(w) >= n)):
                        before.setdefault(key, own[i - 1] if i else "")
            if toxic:
                found.extend(before.items())
            else:
                clean.update(before.keys())
        yield rows([k for k, _ in found], [x for _, x in found], [1] * len(found), [0] * len(found))
        if len(clean) > 1_000_000:
            yield rows([*clean], [None] * len(clean), [0] * len(clean), [*clean.values()])
            clean.clear()
    yield rows([*clean], [None] * len(clean), [0] * len(clean), [*clean.values()])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, times: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps, with rows that count so many times; the last weight is the intercept."""
    times = np.ones(len(x)) if times is None else times
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log(((times * y).sum() + 1) / ((times * (1 - y)).sum() + 1))
    if not 0 < y.sum() < len(y):
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (times * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lexicon(counted: DataFrame, total: list[int], times: list[float], support: int) -> list[tuple[str, bool, float]]:
    """Terms from counts (term, stem, toxic, clean, places) over total clean and toxic texts read, each of which stands for `times` of its label."""
    t, c = F.col("toxic") * times[1], F.col("clean") * times[0]
    odds = F.log((t + 0.5) / (total[1] * times[1] - t + 0.5)) - F.log((c + 0.5) / (total[0] * times[0] - c + 0.5))
    least = F.when(F.col("stem"), 3 * support).otherwise(support)
    share = max(total[1], 1) / max(sum(total), 2)
    n = F.greatest(F.col("toxic") + F.col("clean"), F.lit(1))
    surprise = F.col("toxic") * F.log(F.col("toxic") / n / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - share if share < 1 else 1.0))).otherwise(0.0)
    found = counted.where((F.col("toxic") >= least) & (F.col("places") >= least)).withColumn("odds", odds).where("odds > 3").where(t >= 20 * c).where(surprise > SURPRISE).orderBy(F.desc("toxic"), "term", "stem").limit(TERMS).collect()  # bounded by TERMS
    stems: list[str] = []
    for r in sorted((r for r in found if r.stem), key=lambda r: len(r.term)):
        if not r.term.startswith(tuple(stems)):
            stems.append(r.term)
    weight = {(r.term, r.stem): r.odds for r in found}
    # A stem that stands for one word only is that word; one for several words covers them.
    whole = {r.term: r.toxic for r in found if not r.stem}
    kept = [s for s in stems if sum(1 for w in whole if w.startswith(s)) >= 3 or s in whole]
    terms = [(s, True, weight[s, True]) for s in kept if s not in whole or any(w != s and w.startswith(s) for w in whole)]
    terms += [(w, False, weight[w, False]) for w in whole if not w.startswith(tuple(t[0] for t in terms)) or len(w) < 4]
    return [(t, s, round(float(x), 6)) for t, s, x in sorted(terms)]


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, support: int = SUPPORT) -> tuple[list[tuple[str, bool, float]], list[float]]:
    """The lexicon (at most `TERMS` entries) and the weights. At most 2 * sample labelled rows are read for learning."""
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    known = written(known.select("doc_id", (F.col("toxic") == 1).alias("toxic")), "known")
    labelled = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    times = [max(1.0, labelled.get(toxic, 0) / sample) for toxic in (False, True)]
    order = F.xxhash64("doc_id")
    rows = known.where("toxic").orderBy(order, "doc_id").limit(sample).unionByName(known.where("not toxic").orderBy(order, "doc_id").limit(sample))
    texts = documents.select("doc_id", F.col("text").cast("string")).join(F.broadcast(rows), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))  # bounded by `sample`
    texts = written(texts.select("text", "toxic", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")).repartition(partitions(documents.sparkSession)), "labelled")
    totals = {(r.toxic, r.fold): r.n for r in texts.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}  # two rows for each fold at most
    folds = range(FOLDS)
    met = texts.select("text", "toxic", "fold").mapInArrow(_terms, "term string, stem boolean, fold int, before string, toxic long, clean long")
    sums = [F.sum(F.when(F.col("fold") == k, F.col(n)).otherwise(0)).alias(f"{n}{k}") for k in folds for n in ("toxic", "clean")]
    met = met.groupBy("term", "stem", "before").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *sums)
    places = [F.count_if(F.col("before").isNotNull() & (F.col("toxic") > F.col(f"toxic{k}"))).alias(f"places{k}") for k in folds]
    met = met.groupBy("term", "stem").agg(*(F.sum(f"{n}{k}").alias(f"{n}{k}") for k in ("", *folds) for n in ("toxic", "clean")), F.count("before").alias("places"), *places)
    counted = written(met.where(F.col("toxic") >= support), "terms")
    total = lambda out: [sum(n for (t, k), n in totals.items() if t == toxic and k != out) for toxic in (False, True)]
    terms = _lexicon(counted, total(None), times, support)
    others = [_lexicon(counted.select("term", "stem", (F.col("toxic") - F.col(f"toxic{k}")).alias("toxic"), (F.col("clean") - F.col(f"clean{k}")).alias("clean"), F.col(f"places{k}").alias("places")), total(k), times, support) for k in folds]
    told = texts.select("text", "toxic", "fold").mapInArrow(_featured(others), "f array<double>, toxic boolean").collect()  # bounded by 2 * sample rows of five numbers
    x, y = np.array([r.f for r in told], float).reshape(-1, 5), np.array([r.toxic for r in told], float)
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows came in
    return terms, [float(v) for v in np.round(_fit(x[order], y[order], times=np.where(y[order] > 0, times[1], times[0])), 9)]


def _featured(lexicons: list[list[tuple[str, bool, float]]]):
    """Features of texts by the lexicon of each one's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(Lexicon(terms)) for terms in lexicons]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t, matchers[k]) for t, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())], pa.list_(pa.float64())), batch.column(1)], ["f", "toxic"])

    return run


def _scored(terms: list[tuple[str, bool, float]], weights: list[float], text_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, w = Matcher(Lexicon(terms)), np.array(weights)
        for batch in batches:
            x = np.array([features(t, matcher) for t in batch.column(text_at).to_pylist()], float).reshape(-1, 5)
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            kept = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array(x[:, 4])], schema=schema)

    return run


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score in 0..1, predicted (1 if score >= 0.5) and hits (unquoted lexicon hits, 3 for more) of each row."""
    prepare(documents.sparkSession)
    terms, weights = train(documents, labels, sample)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.float64())])
    scored = docs.mapInArrow(_scored(terms, weights, 1, schema), "doc_id long, score double, hits double")
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("hits").cast("int").alias("hits"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic."""
    prepare(documents.sparkSession)
    terms, weights = train(documents, labels)
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, w = Matcher(Lexicon(terms)), np.array(weights)
        for batch in batches:
            x = np.array([features(t, matcher) for t in batch.column(at).to_pylist()], float).reshape(-1, 5)
            yield batch.filter(pa.array(x @ w[:-1] + w[-1] < 0))

    return documents.mapInArrow(keep, documents.schema)


def op7_toxicity_lexicon(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_toxicity_lexicon": op7_toxicity_lexicon}

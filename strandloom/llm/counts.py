"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word, ending by ending. For each end the search keeps the best score and
the number of pieces on its way, no pieces. Ties go as in the tokenizer: an end keeps the first best way in the order of starts, so the longest
piece wins. A character that no piece of one character covers may stand alone as unknown, at the least score less ten, and then counts as its bytes,
which the vocabulary has as pieces; without byte pieces neighbouring unknown characters count as one.

The public files hold no unigram model, and tokenizers aren't trained here: the pieces are those of the public file, in its order, and a piece of rank r has the log probability that Zipf's law gives it, -log(r) less a constant. So counts are those of the library's
unigram model over these pieces and scores (which the tests hold them against), not those of the merges that the file was made for. Control pieces and the unknown one match no text.

Text is cut before each space; a space is written as the mark U+2581, and one is put before the text if it doesn't begin so.
Words are looked up in a bounded memory, so each is searched about once in a task.

Null and empty texts have no tokens. Texts are counted whole. Repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.recent import Recent
from strandloom.llm.shared import prepare, table

_BYTE = re.compile("<0x[0-9A-F]{2}>")
MARK, UNKNOWN_PENALTY, WORDS, TEXTS = "▁", 10.0, 192 << 20, 512


class Counter:
    """Pieces (string, score) in the order of their ids."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and not _BYTE.fullmatch(piece) and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.words = Recent(WORDS)

    def search(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of a word, mark included."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(word):
            ends[last + 1].append(match)
        best, count, alone = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, pieces, single, unknown = None, 0, False, False
            here = ends[end]
            if len(here) > 1:
                here.sort(reverse=True)  # the longest first: starts in order
            for size, score in here:
                score += best[end - size]
                if top is None or score > top:
                    top, pieces = score, count[end - size] + 1
                single = single or size == 1
            if not single:
                score = self.unknown + best[end - 1]
                if top is None or score > top:
                    if self.bytes:
                        top, pieces = score, count[end - 1] + len(word[end - 1].encode())
                    else:
                        top, pieces, unknown = score, count[end - 1] + (not alone[end - 1]), True
            best[end], count[end], alone[end] = top, pieces, unknown
        return count[n], best[n]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, words and scores of texts."""
        split = []
        for t in texts:
            if not t:
                split.append([])
                continue
            t = t.replace(" ", MARK) if MARK in t else t
            mark = MARK if MARK in t else " "
            split.append((t[1:] if t[0] == mark else t).split(mark))
        needed = set().union(*split)
        missing = self.words.missing(needed)
        if missing:
            self.words.keep({w: self.search(MARK + w) for w in missing}, lambda: needed)
        number = {w: i for i, w in enumerate(needed)}
        values = np.array([*map(self.words.__getitem__, needed)], float).reshape(-1, 2)
        rows = np.fromiter((number[w] for words in split for w in words), np.int64, sum(map(len, split)))
        sizes = np.array([len(s) for s in split], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        total = lambda i: np.bincount(owner, values[rows, i], len(texts)).astype(float)  # noqa: E731 - of nothing it has whole zeros
        return total(0).astype(np.int64), sizes, total(1)


_held: dict[str, Counter] = {}


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model file that may stand for text, with the log probabilities of a unigram model: by Zipf's law of their rank. Byte pieces have the least one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    kept.sort(key=lambda i: (-model.get_score(i), i))
    norm = math.log(sum(1 / r for r in range(1, len(kept) + 1)))
    found = [(model.id_to_piece(i), -math.log(r) - norm) for r, i in enumerate(kept, 1)]
    least = found[-1][1] if found else 0.0
    return found + [(model.id_to_piece(i), least) for i in range(model.get_piece_size()) if model.is_byte(i)]


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _held:
            _held[path] = Counter(pieces_of(path))
        for batch in batches:
            tokens, words, scores = _held[path].texts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(words), pa.array(scores)], ["doc_id", "n_tokens", "n_words", "score"])

    return run


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_words and score (the sum of the words' best scores) of each row."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_run(path), "doc_id long, n_tokens long, n_words long, score double")


def op4_viterbi_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return token_counts(table(spark, sf_dir, "documents"), public.path("piece_bpe_32k.model"))


QUERIES = {"op4_viterbi_token_counts": op4_viterbi_token_counts}

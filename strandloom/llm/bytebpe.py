"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece of text has one valid encoding, and so one last token. For each end of a prefix the tokens that
end there are tried from the longest on; a token is the last one if the prefix before it is empty, or if that prefix's last token and it
are a pair that merging by rank would leave alone. Two tokens are such a pair if no merge across their border would have come before the
merges that made them; that needs only the two tokens and how each was made from two smaller ones. The array of last tokens
gives appends that never change what stands before, and a replacement in the middle is encoded anew only until the last tokens are
the old ones over as many bytes as the longest token has.

A text is split by the pattern first; each piece is encoded by itself, in parts from one white space to the next, which no match crosses.
Parts that were met before are looked up in a bounded memory.

Null text is empty: no tokens. Texts are encoded whole, however long. Repeated rows give repeated results; a null doc_id is kept. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import tokens
from strandloom.llm.recent import Recent
from strandloom.llm.shared import prepare, table, together

#: Bytes of parts and of pieces that a Python worker remembers, bytes of text that are looked at together, and parts that are matched together.
PARTS, PIECES, SLICE, TOLD = 160 << 20, 64 << 20, 4 << 20, 1 << 15
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same beyond ASCII, as bytes.
_WIDE = [int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]


class Ranks:
    """A vocabulary of byte strings by rank: tokens, how each was made, and which pairs stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.ids: dict[bytes, int] = {}
        self.made: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.made[i] = (i, i)
                self.ids[token] = i
                continue
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None and self.stays(a, b):
                    self.made[i], self.merged[a, b], self.ids[token] = (a, b), i, i
                    break  # a token that merging never makes is left out
        self.apart = {}
        self.longest = max(map(len, self.ids))
        self.sizes = {i: len(t) for t, i in self.ids.items()}
        #: The greatest size of a token by its last three bytes; where these end no token only two bytes or one can.
        self.reach: dict[bytes, int] = {}
        for t in self.ids:
            if len(t) > 2 and self.reach.get(t[-3:], 0) < len(t):
                self.reach[t[-3:]] = len(t)

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are what merging by rank ends with."""
        limit = 1 << 60
        made, merged = self.made, self.merged
        while True:
            whole = merged.get((a, b))
            if whole is not None and whole < limit:
                return False
            # Undo the later of the two merges that made a and b; what is then at the border must not merge before it.
            if made[a] == (a, a) and made[b] == (b, b):
                return True
            if made[b] == (b, b) or made[a] != (a, a) and a > b:
                limit, a = a, made[a][1]
            else:
                limit, b = b + 1, made[b][0]

    def pair(self, a: int, b: int) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            found = self.apart[a, b] = self.stays(a, b)
        return found


class Prefixes:
    """The last token of every prefix of some bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def _fill(self, data: bytes, last: list[int], old: tuple[list[int], int, int] | None = None) -> list[int]:
        get, pair, longest = self.ranks.ids.get, self.ranks.pair, self.ranks.longest
        same = 0
        for end in range(len(last), len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is not None and (not start or last[start] >= 0 and pair(last[start], token)):
                    last.append(token)
                    break
            else:
                last.append(-1)
            if old is not None:
                before = end - old[1]
                same = same + 1 if 0 <= before < len(old[0]) and before > old[2] and old[0][before] == last[end] else 0
                if same >= longest:
                    return last + old[0][before + 1 :]
        return last

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(self.data, self.last)

    def replace(self, lo: int, hi: int, new: bytes) -> None:
        """Bytes lo to hi become `new`."""
        data = self.data[:lo] + new + self.data[hi:]
        self.last = self._fill(data, self.last[: lo + 1], (self.last, len(new) - (hi - lo), hi))
        self.data = data

    def ids(self) -> list[int]:
        found, at = [], len(self.data)
        while at:
            token = self.last[at]
            found.append(token)
            at -= self.ranks.sizes[token]
        return found[::-1]


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Where white space of more than one byte begins."""
    at = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    one, two, three = (np.append(data, [0, 0])[at + i].astype(np.int64) for i in range(3))
    code = np.where(one == 0xC2, one << 8 | two, one << 16 | two << 8 | three)
    return at[np.isin(code, _WIDE)]


class Codec:
    """Texts to ids written as decimal numbers with a space between, and back to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = Ranks(ranks)
        self.pattern = regex.compile(pattern)
        self.cut = regex.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
        self.parts, self.pieces = Recent(PARTS), Recent(PIECES)
        self.shown = {i: b"%d" % i for i in self.ranks.tokens}
        self.bytes_of = {str(i).encode(): t for i, t in self.ranks.tokens.items()}

    def encoded(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces. In sorted order each begins with what it shares with the one before, whose prefixes stay as they are: it is an append."""
        get, pair, reach, sizes, shown = self.ranks.ids.get, self.ranks.pair, self.ranks.reach.get, self.ranks.sizes, self.shown
        found, before, last = {}, b"", [-1]
        for data, piece in sorted((p.encode(), p) for p in pieces):
            shared, n = 0, len(data)
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                most = reach(data[end - 3 : end], 2) if end > 3 else end
                for start in range(end - most if end > most else 0, end):
                    token = get(data[start:end])
                    if token is not None and (not start or pair(last[start], token)):
                        last.append(token)
                        break
            out, at = [], n
            while at:
                token = last[at]
                out.append(shown[token])
                at -= sizes[token]
            found[piece] = b" ".join(out[::-1])
            before = data
        return found

    def told(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of parts that aren't known; each run of ids is decoded and held against its part."""
        pieces = {p: self.pattern.findall(p.decode()) for p in parts}
        all_ = set().union(*pieces.values())
        self.pieces.keep(self.encoded(self.pieces.missing(all_)), lambda: all_)
        known = self.pieces.__getitem__
        out = {p: b" ".join(map(known, xs)) for p, xs in pieces.items()}
        for part, ids in out.items():
            if self.decode(ids) != part:
                raise ValueError("ids that don't decode to their text")
        return out

    def known(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        found = [*map(self.parts.get, parts)]
        if None in found:
            missing, new = [p for p, x in zip(parts, found) if x is None], {}
            for lo in range(0, len(missing), TOLD):
                new.update(self.told(missing[lo : lo + TOLD]))
            self.parts.keep(new, lambda: {*parts})
            found = [new[p] if x is None else x for p, x in zip(parts, found)]
        return found

    def texts(self, column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each text, and the bytes that they decode to. Texts are cut before each run of white space, over which no match of the pattern goes; distinct parts of many texts are told apart by array operations.

        Where white space isn't all ASCII, a text is cut by the pattern of all white space."""
        for lo, hi, data, at in tokens.slices(column, SLICE):
            space = tokens.SPACE[data]
            begins = space.copy()
            begins[1:] &= ~space[:-1]
            begins[at[:-1][at[1:] > at[:-1]]] = True
            cuts = np.flatnonzero(begins)
            offsets = np.append(cuts, len(data)).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            one = pa.LargeListArray.from_arrays([0, len(words.dictionary)], words.dictionary)  # no text holds a byte 255, so one string of all is cut quickly
            parts = pc.binary_join(one, pa.scalar(b"\xff", pa.large_binary()))[0].as_buffer().to_pybytes().split(b"\xff") if len(words) else []
            found, of = self.known(parts), words.indices.to_numpy()
            edge = np.searchsorted(cuts, at).tolist()
            odd = _wide_space(data)
            wide = {*(np.searchsorted(at, odd, "right") - 1).tolist()}
            for row in range(hi - lo):
                if row in wide:
                    own = [p.encode() for p in self.cut.findall(data[at[row] : at[row + 1]].tobytes().decode())]
                    ids = dict(zip(distinct := [*{*own}], self.known(distinct)))
                    yield b" ".join(map(ids.__getitem__, own)), b"".join(own)
                else:
                    mine = of[edge[row] : edge[row + 1]].tolist()
                    yield b" ".join(map(found.__getitem__, mine)), b"".join(map(parts.__getitem__, mine))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for ids, _ in self.texts(pa.array(texts, pa.large_string())):
            yield ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(b" "))) if ids else b""


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_held: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _held:
        _held[path, pattern] = Codec(load(path), pattern)
    return _held[path, pattern]


def _run(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in together(batches, SLICE):
            rows: list[tuple] = []
            for ids, data in own.texts(batch.column(1)):
                rows.append((ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()) + (([int(i) for i in ids.split()], data) if with_ids else ()))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            n = 5 if with_ids else 3
            yield pa.RecordBatch.from_arrays([batch.column(0).combine_chunks(), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(n))], names[: n + 1])

    return run


def encoded(documents: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids with a space between) and decoded_sha256; with `ids` also ids and decoded."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_run(path, pattern, ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * ids)


def op6_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return encoded(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


QUERIES = {"op6_prefix_bpe": op6_prefix_bpe}

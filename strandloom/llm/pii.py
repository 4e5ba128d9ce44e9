"""Personal data replaced by keyed surrogates of the same type, script and format.

Found by patterns: e-mail addresses, international and North American telephone numbers, IPv4 addresses, payment card numbers (13 to 19 digits that begin with 2 to 6 and
whose Luhn digit is right), access keys that begin with AKIA or ASIA, values of token, secret, api_key and password assignments (with a letter or digit), and names after
a title (Mr, Mrs, Ms, Miss, Dr, Herr, Frau, Monsieur, Madame, Senor, Senora and their short forms). A family name that a title has shown is also found where it stands alone
with a capital in the same text.

An entity is known by its normal form: digits of a number (with the country code 1 where a North American number has none), lower case of an address or name. The surrogate is made from
the normal form and then laid over what is written, so every spelling of an entity gets the same surrogate (coreference) and keeps its own separators and case.

Numbers, addresses and keys: the places of the normal form that may change, each with the range of values that its format allows, make a number; a keyed permutation of all numbers of
that format (a Feistel network of HMAC-SHA-256 over two halves of the places, with a turn in between, so that none stays as it is) gives the surrogate. Fixed parts stay: country codes, 555,
AKIA, the last labels of a domain, the number of digits of each part of an IPv4 address, a card's first digit; a card's Luhn digit is worked out. Two entities of one format can't share a surrogate.
Names: each word is drawn by itself, so a family name is the same with every title and given name. Given names have the ending of the title's gender where it shows one, Latin, Cyrillic and
Greek words are made of syllables of their script, and other scripts have each letter drawn from its own block.

Collision check: over the distinct entities of all documents, surrogates that two of them share, or that equal another original, are found by a join on hashes; such an entity is made again
with the next attempt (another permutation, a longer name), in rounds. A format that has no room for that (more originals than can be avoided) goes back to its first permutation, in which all its
entities are distinct, though some surrogates then equal other originals. Nothing raises for data.
The exceptions (entity hash, attempt) are broadcast if there are at most `exceptions` of them, else they join the texts' entities as a table.

Key: the argument, or the setting `spark.strandloom.surrogates.key`, or the environment's SURROGATES_KEY; without any a random key of the session, so that surrogates can't be searched back but differ from run to run.

Null text stays null; empty stays empty. Other columns are kept as they are, whatever their names and nulls. Repeated rows give repeated results.
Texts are processed whole. A table without entities, or without rows, comes back as it is.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.shared import partitions, prepare, table, written

EXCEPTIONS, CACHE, ROUNDS = 100_000, 200_000, 12
SETTING, VARIABLE = "spark.strandloom.surrogates.key", "SURROGATES_KEY"

# Titles with the gender that they show.
TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "dr": "", "prof": "", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "mme": "f", "sr": "m", "sra": "f", "señor": "m", "señora": "f"}
# Syllables of names by script, endings of given names by gender, and endings of family names.
SYLLABLES = {
    "latin": "al ber cor dar el fer gar hel ir jor kal lor mar nor or per ras sel tar ur val wil yor zel".split(),
    "cyrillic": "ал бер вор гар дан ер жан зар ир кол лар мар нор ор пет рас сел тар ур фед хар цар шар яр".split(),
    "greek": "αλ βερ γορ δαρ ελ ζαν ηρ θεο ιρ καλ λορ μαρ νορ ορ περ ρασ σελ ταρ υρ φιλ χαρ ψαλ".split(),
}
GIVEN = {
    "latin": {"m": "us o an in or el".split(), "f": "a ia ina ette elle ea".split()},
    "cyrillic": {"m": "ан ий ей ор ил ин".split(), "f": "а ия ина ея ьяна ица".split()},
    "greek": {"m": "ος ης ας ων ιος ευς".split(), "f": "α η ια ινα ω ουλα".split()},
}
FAMILY = {"latin": "son berg mann dale er ins ley ford".split(), "cyrillic": "ов ин енко ич ский як ук ян".split(), "greek": "ου ιδης ακης οπουλος ας ατος ελης ινος".split()}
# Telephone country codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = {"1", "7"}, {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")
SECRET = re.compile(r"\b(?:token|secret|api[_-]?key|passw(?:or)?d)\b[\"']?\s?[=:]\s?[\"']?(?P<secret>(?=[/+_-]*[A-Za-z0-9])[A-Za-z0-9/+_-]{8,})", re.I)
ACCESS = re.compile(r"\b(?P<access>A(?:KIA|SIA)[A-Z0-9]{16})\b")
#: Each begins with a character that is rare in prose, so that a scan passes over the rest quickly.
NUMBER = re.compile(
    r"(?=[+(0-9])(?:"
    r"(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9.-]))"
    r"|(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9]))"
    r"|(?P<card>(?<![0-9-])[2-6](?:[ -]?[0-9]){12,18}(?![0-9-])))"
)
NAME = re.compile(r"\b(?P<title>Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Sr|Sra|Señor|Señora)\.? (?P<name>[^\W\d_a-z][^\W\d_]+(?: [^\W\d_a-z][^\W\d_]+)?)")
_TITLES = tuple(f"{t}{end}" for t in ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Sr", "Sra", "Señor", "Señora") for end in (" ", ". "))
_LONG = re.compile(r"[0-9][0-9 ().-]{6}")

Entity = tuple[int, int, str, str]


def luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10


def _digits(raw: str) -> str:
    return "".join(c for c in raw if c in "0123456789")


def _names(text: str) -> Iterator[Entity]:
    """Words of names after titles, and family names that stand alone. A given name's normal form begins with its gender."""
    families: set[str] = set()
    after: list[Entity] = []
    for m in NAME.finditer(text):
        at, words = m.start("name"), m.group("name").split(" ")
        if len(words) == 2:
            after.append((at, at + len(words[0]), "given", f"{TITLES[m.group('title').lower()]} {words[0].lower()}"))
            at += len(words[0]) + 1
        after.append((at, m.end("name"), "family", words[-1].lower()))
        families.add(words[-1].lower())
    yield from after
    if families:
        alone = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(families, key=lambda w: (-len(w), w)))) + r")\b", re.I)
        for m in alone.finditer(text):
            if not m.group()[0].islower() and m.group().lower() in families:
                yield *m.span(), "family", m.group().lower()


def find(text: str) -> list[Entity]:
    """The entities of a text in order: start, end, type, normal form. Where two overlap, the type that is named first here stays."""
    found: list[Entity] = []
    lower = text if text.islower() else text.lower()
    if "@" in text:
        found += [(*m.span(), "email", m.group().lower()) for m in EMAIL.finditer(text)]
    if "token" in lower or "secret" in lower or "api" in lower and "key" in lower or "passw" in lower:
        found += [(*m.span("secret"), "secret", m.group("secret")) for m in SECRET.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [(*m.span(), "access", m.group()) for m in ACCESS.finditer(text)]
    if _LONG.search(text):
        for m in NUMBER.finditer(text):
            kind, raw = m.lastgroup, m.group()
            if kind == "phone":
                found.append((*m.span(), kind, _digits(raw) if raw[0] == "+" else "1" + _digits(raw)))
            elif kind == "ip":
                found.append((*m.span(), kind, raw))
            elif luhn([int(c) for c in _digits(raw)]) == 0:
                found.append((*m.span(), kind, _digits(raw)))
    if any(t in text for t in _TITLES):
        found += _names(text)
    kept: list[Entity] = []
    starts: list[int] = []
    for x in found:
        i = bisect_left(starts, x[0])
        if (not i or kept[i - 1][1] <= x[0]) and (i == len(kept) or kept[i][0] >= x[1]):
            kept.insert(i, x)
            starts.insert(i, x[0])
    return kept


# Formats: the characters that a place of a normal form may have.
_D, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _of_kind(c: str) -> str:
    return next((a for a in (_D, _LOWER, _UPPER) if c in a), c)


def _phone_places(normal: str) -> list[str]:
    code = 1 if normal[0] in ONE_DIGIT else 2 if normal[:2] in TWO_DIGITS else 3
    code = min(code, len(normal) - 1)
    rest = normal[code:]
    if normal[:code] == "1" and len(rest) == 10:
        first = lambda c: "23456789" if c in "23456789" else "01"
        exchange = [*"555"] if rest[3:6] == "555" else [first(rest[3]), _D, _D]
        return ["1", first(rest[0]), _D, _D, *exchange, *[_D] * 4]
    return [*normal[:code], rest[0] if rest[0] == "0" else "123456789", *[_D] * (len(rest) - 1)]


def places(kind: str, normal: str) -> list[list[str] | str]:
    """The values that each place of a normal form can take; a place with one value is fixed."""
    if kind == "phone":
        return _phone_places(normal)
    if kind == "card":
        return [normal[0], *[_D] * (len(normal) - 2), "0"]
    if kind == "ip":
        of = {1: [*_D], 2: [f"{i:02d}" for i in range(100)], 3: [str(i) for i in range(100, 256)]}
        return [of[len(x)] for x in normal.split(".")]
    if kind == "access":
        return [*normal[:4], *[_UPPER + _D] * 16]
    if kind == "email":
        local, _, domain = normal.partition("@")
        labels = domain.split(".")
        keep = 2 if len(labels) > 1 and labels[-2] == "example" else 1
        fixed = "." + ".".join(labels[-keep:])
        free = normal[: len(normal) - len(fixed)] if len(labels) > keep else local + "@"
        return [*map(_of_kind, free), *normal[len(free) :]]
    hexadecimal = next((a for a in ("0123456789abcdef", "0123456789ABCDEF") if all(c in a for c in normal)), None)
    return [hexadecimal] * len(normal) if hexadecimal and not normal.isdigit() else [*map(_of_kind, normal)]


def _cut(kind: str, normal: str) -> list[str]:
    return normal.split(".") if kind == "ip" else [*normal]


def format_of(kind: str, normal: str) -> str:
    """A name of the set of normal forms that a permutation covers."""
    if kind in ("given", "family"):
        return kind
    shape = places(kind, normal)
    return kind + "\0" + "\0".join(x if len(x) == 1 else f"{len(x)}{x[0]}" for x in shape)


def _prf(key: bytes, *parts: object) -> int:
    """512 bits or more, as many as `more` asks for."""
    told = "\0".join(map(str, parts)).encode()
    return int.from_bytes(hmac.new(key, told, hashlib.sha512).digest(), "big")


def _wide(key: bytes, bits: int, *parts: object) -> int:
    found = _prf(key, *parts)
    for i in range(bits // 448):
        found = found << 512 | _prf(key, i, *parts)
    return found


def permuted(kind: str, normal: str, key: bytes, attempt: int, rounds: int = 5) -> str:
    """The surrogate's normal form: a permutation of the format's forms in which none stays, if it has more than one."""
    cut, shape = _cut(kind, normal), places(kind, normal)
    free = [i for i, values in enumerate(shape) if len(values) > 1]
    sizes = [len(shape[i]) for i in free]
    half = len(free) // 2
    na, nb = prod(sizes[:half]), prod(sizes[half:])
    if na * nb < 2:
        return normal
    number = lambda lo, hi: sum(shape[i].index(cut[i]) * prod(sizes[lo:k]) for k, i in enumerate(free[lo:hi], lo))
    a, b = number(0, half), number(half, len(free))
    tweak = f"{format_of(kind, normal)}\0{attempt}"
    bits_a, bits_b = na.bit_length() + 64, nb.bit_length() + 64
    for r in range(rounds):
        a = (a + _wide(key, bits_a, tweak, r, "a", b)) % na
        b = (b + _wide(key, bits_b, tweak, r, "b", a)) % nb
    turn = 1 + _wide(key, bits_a + bits_b, tweak, "turn") % (na * nb - 1)
    a, b = divmod((a * nb + b + turn) % (na * nb), nb)
    for r in reversed(range(rounds)):
        b = (b - _wide(key, bits_b, tweak, r, "b", a)) % nb
        a = (a - _wide(key, bits_a, tweak, r, "a", b)) % na
    out = [values if len(values) == 1 and isinstance(values, str) else cut[i] for i, values in enumerate(shape)]
    for number, lo, hi in ((a, 0, half), (b, half, len(free))):
        for k in range(lo, hi):
            number, at = divmod(number, sizes[k])
            out[free[k]] = shape[free[k]][at]
    if kind == "card":
        out[-1] = str(-luhn([int(c) for c in out]) % 10)
    return (".".join if kind == "ip" else "".join)(out)


def script_of(word: str) -> str:
    """latin, cyrillic or greek, or the name of another script's first letter."""
    for c in word:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0].lower()
            return name
    return "latin"


def _block(c: str) -> list[str]:
    """Letters beside c in its script and case, c among them: all of the 256 codes around it that have the same kind."""
    return _blocks(ord(c) >> 8, unicodedata.category(c), unicodedata.name(c, "").split(" ")[0])


@lru_cache(512)
def _blocks(row: int, category: str, script: str) -> list[str]:
    return [x for x in map(chr, range(row << 8, row + 1 << 8)) if unicodedata.category(x) == category and unicodedata.name(x, "").split(" ")[0] == script]


def named(kind: str, normal: str, key: bytes, attempt: int) -> str:
    """The surrogate's normal form of a word of a name, without the gender. Later attempts are longer, so there is always room."""
    gender, _, word = normal.partition(" ") if kind == "given" else ("", "", normal)
    n = _wide(key, 2048, kind, gender, word, attempt)
    script = script_of(word)
    if script in SYLLABLES:
        parts = []
        for _ in range((2 if kind == "given" else 3) + attempt // 2):
            n, i = divmod(n, len(SYLLABLES[script]))
            parts.append(SYLLABLES[script][i])
        ends = FAMILY[script] if kind == "family" else GIVEN[script][gender] if gender else GIVEN[script]["m"] + GIVEN[script]["f"]
        return "".join(parts) + ends[n % len(ends)]
    out = []
    for c in word + word[-1] * (attempt // 2):
        block = _block(c) if c.isalpha() else [c]
        n, i = divmod(n, len(block))
        out.append(block[i])
    return "".join(out)


def replaced_normal(kind: str, normal: str, attempt: int, key: bytes) -> str:
    """The surrogate's normal form: never the entity's own, unless its format has no other."""
    if kind in ("given", "family"):
        own = normal.partition(" ")[2] if kind == "given" else normal
        for more in range(16):
            new = named(kind, normal, key, attempt + 32 * more)
            if new != own:
                break
        return normal.partition(" ")[0] + " " + new if kind == "given" else new
    return permuted(kind, normal, key, attempt)


def laid(kind: str, raw: str, new: str) -> str:
    """A surrogate's normal form in the spelling of `raw`."""
    if kind in ("phone", "card"):
        at = iter(new[len(new) - len(_digits(raw)) :])
        return "".join(next(at) if c in "0123456789" else c for c in raw)
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(raw, new))
    if kind in ("given", "family"):
        word = new.partition(" ")[2] if kind == "given" else new
        return word.upper() if len(raw) > 1 and raw.isupper() else word[0].upper() + word[1:]
    return new


def surrogate(kind: str, raw: str, normal: str, attempt: int = 0, key: bytes = b"") -> str:
    """The replacement of `raw`, an entity of that normal form."""
    return laid(kind, raw, replaced_normal(kind, normal, attempt, key))


def digest(kind: str, normal: str) -> int:
    """Surrogates of given names are compared without their gender, as a text shows none."""
    shown = normal.partition(" ")[2] if kind == "given" else normal
    return int.from_bytes(hashlib.blake2b(f"{kind}\0{shown}".encode(), digest_size=8).digest(), "little", signed=True)


def identity(kind: str, normal: str) -> int:
    """An entity's own hash; given names of one spelling and different genders are different entities."""
    return int.from_bytes(hashlib.blake2b(f"{kind}\0{normal}\0own".encode(), digest_size=8).digest(), "little", signed=True)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(kind, normal) for text in batch.column(0).to_pylist() if text for _, _, kind, normal in find(text)}
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["kind", "normal"])


def _drawn(key: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, of, was, form = [], [], [], []
            for kind, normal, attempt in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own.append(identity(kind, normal))
                of.append(digest(kind, replaced_normal(kind, normal, attempt, key)))
                was.append(digest(kind, normal))
                form.append(int.from_bytes(hashlib.blake2b(format_of(kind, normal).encode(), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x, pa.int64()) for x in (own, of, was, form))], ["kind", "normal", "attempt", "settled", "own", "of", "was", "form"])

    return run


def entities(documents: DataFrame) -> DataFrame:
    """Distinct entities of all documents: kind and normal form."""
    return documents.select(F.col("text").cast("string")).mapInArrow(_entities, "kind string, normal string").distinct()


def collisions(found: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """Exceptions (own, attempt): entities whose first surrogate collides, with the attempt that doesn't.

    Of the entities that share a surrogate the one with the least hash keeps it, unless it equals another entity's original;
    the others are made again. Formats with entities left after `rounds` are settled: all of their entities take the first permutation, where they differ
    from each other, and only shared surrogates count for the others from then on."""
    schema = "kind string, normal string, attempt int, settled boolean, own long, of long, was long, form long"
    some = partitions(found.sparkSession)
    made = lambda rows: written(rows.select("kind", "normal", "attempt", "settled").repartition(some, "kind", "normal").mapInArrow(_drawn(key), schema), "drawn")
    drawn = made(found.select("kind", "normal", F.lit(0).alias("attempt"), F.lit(False).alias("settled")))
    for turn in range(3 * rounds):
        # The settled come first, so they keep theirs; a name never settles, for its later attempts are longer.
        taken = drawn.groupBy("of").agg(F.min(F.struct(~F.col("settled"), F.col("own"))).getField("own").alias("first"), F.count("*").alias("n"))
        original = drawn.select(F.col("was").alias("of")).distinct().withColumn("is_original", F.lit(True))
        taken = written(taken.join(original, "of", "left").where("n > 1 or is_original"), "taken")
        again = ~F.col("settled") & (F.coalesce("is_original", F.lit(False)) | (F.coalesce("first", "own") != F.col("own")))
        met = drawn.join(taken, "of", "left").withColumn("again", again)
        if not taken.limit(1).count() or not met.where("again").limit(1).count():
            break
        if turn % rounds == rounds - 1:
            dense = met.where("again and kind not in ('given', 'family')").select("form").distinct().withColumn("dense", F.lit(True))
            met = met.join(dense, "form", "left").withColumn("settled", F.col("settled") | F.coalesce("dense", F.lit(False)))
        step = F.when(F.col("settled"), 0).when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        drawn = made(met.withColumn("attempt", step.cast("int")))
    return drawn.where("attempt > 0").select("own", "attempt")


def _replaced(text_at: int, schema: pa.Schema, exceptions: dict[int, int], key: bytes, counts: bool, own_at: int | None) -> Callable:
    """`own_at` is the column with the exceptions of a row's own text as [hash, attempt] pairs, where they aren't broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}

        def drawn(kind: str, normal: str, own: dict[int, int]) -> str:
            attempt = own.get(identity(kind, normal), 0) if own else 0
            new = memo.get((kind, normal, attempt))
            if new is None:
                if len(memo) > CACHE:
                    memo.clear()
                new = memo[kind, normal, attempt] = replaced_normal(kind, normal, attempt, key)
            return new

        for batch in batches:
            texts, found = [], []
            owns = batch.column(own_at).to_pylist() if own_at is not None else None
            for row, text in enumerate(batch.column(text_at).to_pylist()):
                here = find(text) if text else []
                if here:
                    own = {e["own"]: e["attempt"] for e in owns[row] or ()} if owns is not None else exceptions
                    parts, at = [], 0
                    for lo, hi, kind, normal in here:
                        parts += (text[at:lo], laid(kind, text[lo:hi], drawn(kind, normal, own)))
                        at = hi
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                found.append(len(here))
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != own_at]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found, pa.int64())] * counts, schema=schema)

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the entities of each text."""
    for batch in batches:
        rows = [(of, own) for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for own in {identity(kind, normal) for _, _, kind, normal in find(text)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if not i else pa.int64()) for i in (0, 1)], ["of", "own"])


def secret_key(spark: SparkSession) -> bytes:
    """The key that is set, or a random one for the session."""
    found = spark.conf.get(SETTING, None) or os.environ.get(VARIABLE)
    return found.encode() if found else _session_key()


@lru_cache(1)
def _session_key() -> bytes:
    return secrets.token_bytes(32)


def surrogates(documents: DataFrame, key: bytes | None = None, exceptions: int = EXCEPTIONS, counts: bool = False) -> DataFrame:
    """The documents with every entity replaced; with `counts` also n_entities, the number of replacements."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    spark = documents.sparkSession
    prepare(spark)
    key = key or secret_key(spark)
    clash = written(collisions(written(entities(documents), "entities"), key), "exceptions")
    schema = StructType([*documents.schema.fields, *([StructField("n_entities", LongType())] if counts else [])])
    at = documents.columns.index("text")
    if clash.count() <= exceptions:
        attempts = {r.own: r.attempt for r in clash.collect()}  # at most `exceptions` rows
        return documents.mapInArrow(_replaced(at, to_arrow_schema(schema), attempts, key, counts, None), schema)
    # The exceptions of a text meet it by the text's hash.
    name = next(f"_exceptions{i}" for i in range(len(documents.columns) + 1) if f"_exceptions{i}" not in documents.columns)
    of = F.sha2(F.col("text").cast("binary"), 256)
    own = documents.select(of.alias("of"), F.col("text").cast("string").alias("text")).mapInArrow(_held, "of string, own long").distinct()
    lists = own.join(clash, "own").groupBy("of").agg(F.collect_list(F.struct("own", "attempt")).alias(name))  # as many as a text has entities
    met = documents.withColumn(f"{name}_of", of).join(lists.withColumnRenamed("of", f"{name}_of"), f"{name}_of", "left").select(*(F.col(f"`{c}`") for c in documents.columns), name)
    return met.mapInArrow(_replaced(at, to_arrow_schema(schema), {}, key, counts, len(documents.columns)), schema)


def op10_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return surrogates(table(spark, sf_dir, "documents"), counts=True)


QUERIES = {"op10_pii_surrogates": op10_pii_surrogates}

"""Operators over documents, against brute force, the tokenizers' own results and round trips."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from strandloom.llm import bytebpe, counts, flac, hmm, licenses, neardup, packing, toxicity


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def components(links, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_near_duplicates(spark, documents, texts, nothing, repeated):
    sets = {i: neardup.word_sets(t or "") for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = rows(neardup.near_duplicates(documents))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert want[40] == want[41] == want[42] == 20 and want[35] == 34 and want[30] == 30
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.near_duplicates(repeated).count() == len(texts) + 35


def test_near_duplicates_of_a_large_bucket(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    docs = {}
    for i in range(60):  # copies with one change, chains, and strangers that share much of it
        w = list(base)
        w[r.randrange(150)] = f"c{i}"
        docs[i] = " ".join(w)
    for i in range(60, 90):
        docs[i] = " ".join(base[:110] + [f"s{i}.{j}" for j in range(40)])
    sets = {i: neardup.word_sets(t) for i, t in docs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = rows(neardup.near_duplicates(spark.createDataFrame([*docs.items()], "doc_id long, text string"), small=4))
    assert {i: r.component_id for i, r in got.items()} == components(links, sets)


@pytest.mark.parametrize("block", [16, 256])
def test_near_duplicates_whose_only_link_is_an_ordinary_member(spark, block):
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]

    def changed(words, places, name):
        return [f"{name}.{i}" if i in places else w for i, w in enumerate(words)]

    docs = {i: changed(base, [5 + i % 190], f"m{i}") for i in [*range(60), *range(1000, 1060)]}
    for i in range(40):  # each has three changes more than one member, so it is linked with no other
        y = changed(base, [5], f"y{i}")
        docs[100 + i] = y
        docs[200 + i] = changed(y, [x + r.randrange(20) for x in (30, 80, 140)], f"x{i}")
    docs = {i: " ".join(w) for i, w in docs.items()}
    sets = {i: neardup.word_sets(t) for i, t in docs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert all([a for a, b in links if b == 200 + i] == [100 + i] for i in range(40))
    got = rows(neardup.near_duplicates(spark.createDataFrame([*docs.items()], "doc_id long, text string"), block=block))
    assert {i: r.component_id for i, r in got.items()} == components(links, sets)


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 900).astype(np.uint64)
    a, b = x[:600], x[100:]
    s = neardup.superminhash([a, b, a[:3], a[:0]], 125)
    assert abs((s[0] == s[1]).mean() - 500 / 900) < 0.15
    assert np.isinf(s[3]).all() and len({*s[2].astype(int)}) > 1
    assert sorted(s[2].astype(int).tolist())[-1] >= 1  # few elements need later places
    assert (neardup.superminhash([a], 125) == neardup.superminhash([np.sort(a)], 125)).all()


def test_packing(spark, documents, texts, nothing, repeated):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    for df, times in ((documents, 1), (repeated, None)):
        got = packing.pack(df, packing.tokenizer_path()).collect()
        by_sequence = defaultdict(list)
        for r in got:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert r.start == 4096 * r.piece and len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r.length == 4096 or r.start + r.length == len(ids[r.doc_id])
            by_sequence[r.sequence_id].append((r.offset, r.length))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        if times:
            assert Counter(r.doc_id for r in got) == Counter({i: -(-len(x) // 4096) for i, x in ids.items()})
        assert len(by_sequence) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(nothing, packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_fills_without_gaps(seed):
    r = random.Random(seed)
    capacity = r.choice([8, 64, 4096])
    want = {}
    for _ in range(r.randint(1, 60)):
        want[r.randint(1, capacity)] = r.choice([1, 2, 5, 1000])
    fill, seen = defaultdict(list), Counter()
    for length, lo, hi, first, per, offset in packing.plan(want, capacity):
        assert lo == seen[length]
        seen[length] = hi
        for j in range(hi - lo):
            fill[first + j // per].append((offset + j % per * length, length))
    assert seen == want
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    r, letters = random.Random(1), "aAbZ'sdtrevml '\".,!<|>0129éÉßÖİıſŸ ŉÅÅ½²_-\n\x1c ﬁ漢字ẞ"
    told = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    t = Tokenizer.from_file(packing.tokenizer_path())
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordIds(packing.tokenizer_path()).of(pa.array(told, pa.string()))]
    assert got == [e.ids for e in t.encode_batch(told, add_special_tokens=False)]


def test_known_runs_are_not_told_again():
    from tokenizers import Tokenizer

    stems = ["".join(x) for x in itertools.product("abst", "aeé", "lnr", ["", "ou", "ñi"])]
    plain = " ".join([*stems, ". , ( ) 12 !"])
    other = " ".join(f"{x.capitalize()}, ({x}) {x}12! ({x}.{x})12" for x in stems)
    whole = " ".join(f"{x}'s '{x} <|endoftext|>{x} {x}×{x} {x}\u0301{x} İ{x}" for x in stems)
    t, ids, told = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path()), []
    tell = ids.told
    ids.told = lambda words: told.extend(words) or tell(words)
    for text, new in ((plain, len(stems) + 6), (other, 0), (whole, 5 * len(stems) + len(stems))):
        told.clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.of(pa.array([text]))] == [t.encode(text, add_special_tokens=False).ids]
        assert len(told) == len({*told}) == new


def test_token_counts(spark, documents, texts, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    # The library must have an unknown piece; here one that no text holds.
    own = counts.pieces_of(public.path("piece_bpe_32k.model"))
    pieces = [("\0", own[-1][1]), *own]
    assert len({p for p, _ in own}) == len(own) and not {"<s>", "</s>", "<unk>"} & {p for p, _ in own}
    t = Tokenizer(models.Unigram(pieces, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    got = rows(counts.token_counts(documents, public.path("piece_bpe_32k.model")))
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in texts.items()}
    assert counts.token_counts(nothing, public.path("piece_bpe_32k.model")).count() == 0


def test_token_count_ties():
    from tokenizers import Tokenizer, models, pre_tokenizers

    r = random.Random(2)
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("ba", -2.0), ("aba", -3.0), ("c", -2.5)]
    t = Tokenizer(models.Unigram(vocabulary, 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    told = ["".join(r.choice("abcxé ") for _ in range(r.randint(0, 20))) for _ in range(2000)]
    assert counts.Counter(vocabulary).texts(told)[0].tolist() == [len(e.ids) for e in t.encode_batch(told)]


def test_prefix_bpe(spark, documents, texts, nothing):
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bytebpe.load(path), special_tokens={})
    got = rows(bytebpe.encoded(documents, path, public.PATTERN, ids=True))
    for i, x in texts.items():
        ids = e.encode_ordinary(x or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and bytes(got[i].decoded) == (x or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bytebpe.encoded(nothing, path, public.PATTERN).count() == 0
    own = bytebpe.Ranks(bytebpe.load(path))
    for seed in range(300):
        r = random.Random(seed)
        text = lambda n: bytes(r.choice(b"aethinos ") for _ in range(r.randint(0, n)))
        a, b, new = text(60), text(30), text(6)
        p = bytebpe.Prefixes(own, a)
        p.append(b)
        assert p.last == bytebpe.Prefixes(own, a + b).last
        lo = r.randint(0, len(a + b))
        hi = r.randint(lo, len(a + b))
        p.replace(lo, hi, new)
        assert p.last == bytebpe.Prefixes(own, (a + b)[:lo] + new + (a + b)[hi:]).last


def test_flac(spark, documents, texts, nothing):
    got = rows(flac.media(documents, stored=True))
    for i, x in texts.items():
        payload = flac.padded((x or "").encode())
        r = got[i]
        assert flac.decode([bytes(r.media)]) == [payload] and len(payload) % 576 == 0 and r.n_bytes == len((x or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert got[30].feature == got[31].feature and got[20].media_sha256 == got[42].media_sha256
    assert flac.media(nothing).count() == 0


def test_flac_streams():
    r = random.Random(2)
    told = [b"", b"a" * 576, bytes(r.randrange(256) for _ in range(5000)), b"ab" * 600, bytes(i // 3 % 256 for i in range(3000)), bytes(r.choice([0, 255]) for _ in range(1200)), bytes([128] * 500 + [0] * 3 + [255] * 3 + [128] * 646)]
    payloads = [flac.padded(x) for x in told]
    medias = flac.encode(payloads)
    assert flac.decode(medias) == payloads
    assert flac.samples(medias, [(5, len(x)) for x in payloads]) == [x[5:] for x in payloads]
    for at in (-100, -1):
        broken = bytearray(medias[2])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_hmm_scores(spark, documents, texts, nothing, repeated):
    got = rows(hmm.scores(documents, rounds=2))
    words = {i: [*(x or "").encode().lower().split(), "end"] for i, x in texts.items()}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, total = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for i, ws in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / total) for w in ws), rel_tol=1e-9)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert hmm.scores(nothing).count() == 0
    assert hmm.scores(repeated, rounds=1).count() == len(texts) + 35


def test_forward_is_the_sum_over_paths():
    from itertools import product

    r = np.random.default_rng(3)
    first, move, ratio = r.dirichlet([1, 1]), r.dirichlet([1, 1], 2), r.uniform(0.2, 3, (5, 2))
    cls, size = r.integers(0, 5, 11), np.array([4, 1, 6])
    start = np.cumsum(size) - size
    got = hmm.forward(cls, start, size, first, move, ratio)
    for s, n, g in zip(start, size, got):
        total = sum(first[p[0]] * ratio[cls[s], p[0]] * math.prod(move[p[t - 1], p[t]] * ratio[cls[s + t], p[t]] for t in range(1, n)) for p in product(range(2), repeat=int(n)))
        assert math.isclose(10**g, total)
    begin, moves, by_class, value = hmm.forward_backward(cls, start, size, first, move, ratio)
    assert math.isclose(begin.sum(), 3) and math.isclose(moves.sum(), 8) and math.isclose(by_class.sum(), 11) and math.isclose(value, got.sum())


def test_toxicity_of_a_sample_keeps_the_shares_of_labels(spark):
    r = random.Random(4)
    data, labels = [], []
    for i in range(2000):
        w = [f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.choice('nprst')}{r.randrange(400)}" for _ in range(30)]
        toxic = i % 10 == 0
        if toxic and i % 40:  # one in four toxic texts shows nothing
            w[r.randrange(30)] = r.choice(["vexorin", "quaffled", "zumbrick"])
        data.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, part = (toxicity.train(docs, marks, sample)[1] for sample in (10_000, 150))
    assert abs(whole[-1] - math.log(0.025 / 0.9)) < 0.5
    assert abs(whole[-1] - part[-1]) < 0.8  # without weights it rises by about 2.2


def test_toxicity(spark, nothing, documents):
    r = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    data, labels = [], []
    for i in range(900):
        w = [r.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w.insert(r.randrange(40), r.choice(["blighter", "scoundrel", "wretchedly"]))
        if toxic and i % 5 == 0:
            w = [x.replace("blighter", "blightar").replace("scoundrel", "scoundrell").replace("wretchedly", "wretchdly") for x in w]
        data.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows(toxicity.toxicity(docs, marks))
    held = [i for i, r_ in got.items() if r_.held_out]
    assert all(r_.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r_.predicted == (r_.score >= 0.5) for i, r_ in got.items())
    assert sum(got[i].predicted == labels[i][2] for i in held) / len(held) > 0.97
    assert {r_.doc_id for r_ in toxicity.accepted(docs, marks).collect()} == {i for i, r_ in got.items() if not r_.predicted}
    assert toxicity.toxicity(nothing, marks).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r_.predicted for r_ in toxicity.toxicity(documents, empty).collect()} <= {0, 1}


def test_lexicon_is_one_edit():
    def edits(a, b):
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            before = now
        return before[-1]

    terms = ["abcab", "cabbac", "aaaaaa"]
    lexicon = toxicity.Lexicon([(t, False, 1.0) for t in terms])
    r = random.Random(6)
    for _ in range(4000):
        w = "".join(r.choice("abc") for _ in range(r.randint(1, 8)))
        want = min(edits(w, t) for t in terms) <= 1
        assert (lexicon.match(w) is not None) == want, w
    assert toxicity.quoted('he said "you abcab" again'.split(), 3) and not toxicity.quoted("you abcab again".split(), 1)


def test_licenses(spark, nothing):
    told = {1: "Licensed under CC BY-NC 4.0.\nhello", 2: "x\nThis work is licensed under the GNU General Public License, version 3.", 3: "Released under the MIT License.\nAll rights reserved.", 4: "The license plate was red.\nlicensed drivers only", 5: None, 6: "", 7: "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", 8: "prose " * 5000 + "\nAll rights reserved.", 9: "Licensed under terms nobody knows, version 9."}
    df = spark.createDataFrame([*told.items(), (1, told[1]), (None, told[1])], "doc_id long, text string").selectExpr("*", "'x' AS family", "'y' AS gram", "'z' AS words")
    got = licenses.per_document(df).collect()
    assert len(got) == len(told) + 2
    by = {r.doc_id: (r.families, r.n_paragraphs) for r in got}
    assert by == {1: ("cc-by-nc", 1), 2: ("gpl", 1), 3: ("mit,reserved", 2), 4: ("", 0), 5: ("", 0), 6: ("", 0), 7: ("apache-2.0", 1), 8: ("reserved", 1), 9: ("", 0), None: ("cc-by-nc", 1)}
    assert licenses.per_document(nothing).count() == 0


def test_licenses_that_are_wrapped_or_without_an_anchor(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this"
    narrow = "\n".join(licenses.TEMPLATES["gpl"][1].split())  # a word in each line
    told = {1: mit, 2: f"prose here\n\n{bsd}\n\nmore", 3: gpl, 4: mpl, 5: "Available under CC BY 4.0", 6: narrow, 7: f"{mit}\n\n{bsd}\n\nAll rights\nreserved.", 8: "All rights\n\nreserved."}
    got = rows(licenses.per_document(spark.createDataFrame([*told.items()], "doc_id long, text string")))
    assert {i: (r.families, r.n_paragraphs) for i, r in got.items()} == {1: ("mit", 1), 2: ("bsd", 1), 3: ("gpl", 1), 4: ("mpl", 1), 5: ("cc-by", 1), 6: ("gpl", 1), 7: ("bsd,mit,reserved", 3), 8: ("", 0)}


def test_no_paragraph_that_reaches_the_share_is_without_an_anchor():
    r = random.Random(2)
    for _, words, k in licenses._forms(licenses.SHARE):
        assert k / len(words) >= licenses.SHARE > (k - 1) / len(words)
        assert all({*r.sample(words, k)} & {*licenses.ANCHORS} for _ in range(200))


def test_every_template_has_an_anchor():
    import re

    anchor = re.compile("|".join(licenses.ANCHORS).replace(" ", "[^A-Za-z0-9]+"), re.I)
    assert all(anchor.search(t) for texts_ in licenses.TEMPLATES.values() for t in texts_)
    assert all(licenses.grams(t) == licenses.grams(t.upper()) for texts_ in licenses.TEMPLATES.values() for t in texts_)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """Two texts under one id are two nodes; rows without an id are linked by their text."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    v, w, x = ([word() for _ in range(100)] for _ in range(3))
    near = lambda t, i: [*t[:i], "changed", *t[i + 1 :]]
    rows = [(7, v), (7, w), (9, near(w, 0)), (5, near(v, 99)), (None, x), (None, x), (None, near(x, 0)), (3, near(w, 99)), (8, ["a"]), (None, None), (None, None), (8, ["a"])]
    df = spark.createDataFrame([(i, None if t is None else " ".join(t), "g") for i, t in rows], "doc_id long, text string, group string")
    got = sorted(((r_.doc_id or 0, r_.n_shingles, r_.component_id or 0, r_.kept) for r_ in neardup.near_duplicates(df).collect()))
    assert got == sorted([(7, 96, 5, False), (7, 96, 3, False), (9, 96, 3, False), (5, 96, 5, True), (0, 96, 0, False), (0, 96, 0, False), (0, 96, 0, False), (3, 96, 3, True), (8, 1, 8, True), (8, 1, 8, True), (0, 0, 0, False), (0, 0, 0, False)])
    one = neardup.unique(df)
    assert one.columns == df.columns
    assert sorted((r_.doc_id or 0, len((r_.text or "").split())) for r_ in one.collect()) == [(0, 0), (0, 0), (0, 100), (3, 100), (5, 100), (8, 1)]


def test_links_in_a_large_bucket_without_a_common_centre(spark):
    """A chain of texts, each near to the next only, all in one bucket of shared bands, held against all pairs."""
    r = random.Random(10)
    base = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = {}
    for i in range(120):
        t = list(base)
        for j in range(i, i + 60, 6):
            t[j % 400] = f"x{j}"
        texts[i] = " ".join(t)
    for i in range(120, 150):
        texts[i] = " ".join([*base[: 200 + i], *(f"y{i}_{k}" for k in range(i % 40))])
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    sets = {i: neardup.word_sets(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(links, sets)
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(df, small=4, block=16).collect()} == want


def test_licences_of_more_families(spark):
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    agpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above"
    epl = "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at"
    told = {1: lgpl, 2: agpl, 3: isc, 4: epl, 5: "# SPDX-License-Identifier: GPL-3.0-only", 6: "// SPDX-License-Identifier: MIT", 7: "SPDX-License-Identifier: LGPL-2.1-or-later", 8: "/* SPDX-License-Identifier: Apache-2.0 */", 9: "Distributed under the Boost Software License, Version 1.0.", 10: "The identifier of the license plate was written on the box."}
    got = rows(licenses.per_document(spark.createDataFrame([*told.items()], "doc_id long, text string")))
    assert {i: r_.families for i, r_ in got.items()} == {1: "lgpl", 2: "agpl", 3: "isc", 4: "epl", 5: "gpl", 6: "mit", 7: "lgpl", 8: "apache-2.0", 9: "boost", 10: ""}


def test_rows_without_an_id_repeats_and_long_words(spark):
    """Every row comes back, and equal texts have equal values, whatever their ids and whatever other columns are called."""
    told = [(None, "one two a.b@c.org"), (None, "one two a.b@c.org"), (5, "one two a.b@c.org"), (5, "one two a.b@c.org"), (6, None), (7, ""), (8, "x7" * 20000), (9, " one  two　\n"), (9, "the end")]
    df = spark.createDataFrame(told, "doc_id long, text string").selectExpr("*", "1 AS score", "'a' AS ids", "2 AS n_tokens", "'b' AS feature", "'c' AS family", "3 AS chunk")
    marks = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    operators = [
        lambda d: counts.token_counts(d, public.path("piece_bpe_32k.model")), lambda d: bytebpe.encoded(d, public.path("byte_bpe_50k.tiktoken"), public.PATTERN), lambda d: flac.media(d), lambda d: hmm.scores(d, rounds=1),
        lambda d: toxicity.toxicity(d, marks), lambda d: licenses.per_document(d),
    ]
    for operator in operators:
        got = operator(df).collect()
        assert sorted(r_.doc_id or 0 for r_ in got) == sorted(i or 0 for i, _ in told)
        same = {tuple(v for k, v in r_.asDict().items() if k not in ("doc_id", "held_out")) for r_ in got if r_.doc_id in (None, 5)}
        assert len(same) == 1
        assert operator(df.where("false")).count() == 0
    lone = spark.createDataFrame([(9, " one  two　\n")], "doc_id long, text string")
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bytebpe.load(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert bytebpe.encoded(lone, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, ids=True).first().ids == e.encode_ordinary(" one  two　\n")

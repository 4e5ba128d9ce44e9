import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from strandloom.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, place long, block string, base string"


def plainly(rows):
    """The contract on whole lists: sorted rows of the trie."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    trunc = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(trunc(c), [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node in members:
        subtree, todo = [], [node]
        while todo:
            subtree.append(todo.pop())
            todo += children[subtree[-1]]
        saved = sum((len(members[u]) - 1) * (len(u[-1][1]) if u else 0) for u in subtree)
        ends = ",".join(str(c) for c in members[node] if paths[c] == node)
        parent = members[node[:-1]][0] if node else None
        out.append((members[node][0], len(node), parent, len(members[node]), len(children[node]), sum(not children[u] for u in subtree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = []
    for c in [*range(-130, 260, 3), *range(300, 420), 1007, 2**40 + 5]:
        same = r.random() < 0.3
        for t in range(r.choice([1, 2, 3, 6, 9])):
            text = f"turn {t}" if same or r.random() < 0.5 else r.choice(["", "é🙂", "other words", f"{c}"])
            out.append((c, t, r.choice(["user", "user", None, "bot"]) if not same else "user", text))
    for c in (300, 305, 999, 1250):  # long conversations, two of them the same but for their ends
        out += [(c, 1000 + t, "user", f"{t}") for t in range(90 if c < 999 else 120)]
    out += [(305, 5000, "user", "end"), (42, None, "user", "no turn"), (None, 1, "user", "no conversation"), (77, 3, "bot", None), (77, 3, "bot", None), (77, 4, None, None)]
    return out


@pytest.mark.parametrize("block", [None, 4, 50, 333])
def test_trie_equals_the_contract_on_whole_lists(spark, rows, block):
    assert told(prefixes.trie(table(spark, rows), block=block)) == plainly(rows)


def test_copies_of_one_conversation_and_a_chain_of_branches(spark):
    copies = [(c, t, "user", f"text {t}") for c in range(0, 900, 2) for t in range(8)]
    branches = [(10_000 + 100 * i, t, "user", f"{t}" if t < i else f"own {i}") for i in range(30) for t in range(i + 1)]  # each leaves the one before a turn later
    assert told(prefixes.trie(table(spark, copies + branches), block=40)) == plainly(copies + branches)


def test_hot_parents_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "HOT", 3)
    monkeypatch.setattr(prefixes, "PIECE", 2)
    rows = [(c, t, "user", "hello" if t == 0 else f"{c % 7}") for c in range(150) for t in range(2)]
    assert told(prefixes.trie(table(spark, rows))) == plainly(rows)


def test_a_long_text_and_an_empty_table(spark):
    rows = [(1, 0, "user", "x" * 5_000_000), (2, 0, "user", "x" * 5_000_000), (3, 0, "user", "y")]
    assert told(prefixes.trie(table(spark, rows))) == plainly(rows)
    assert prefixes.trie(table(spark, [])).count() == 0
    assert prefixes.trie(table(spark, [(None, 1, "a", "b")])).count() == 0

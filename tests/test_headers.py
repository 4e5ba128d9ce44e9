"""Merged headers against a plain merge: every file's lines are found again behind the new names."""

import random

import pytest

from strandloom.operators import headers
from strandloom.operators.kept import kept

DDL = "file string, ordinal int, rec_type string, attrs map<string,string>"
TAGGED = "file string, qname string, tags map<string, struct<code: string, value: string>>"


def some(r, files):
    rows = []
    for i in range(files):
        lines = [("HD", {"VN": r.choice(["1.0", "1.6"]), "SO": r.choice(["coordinate", "unsorted"])})]
        lines += [("SQ", {"SN": f"c{j}", "LN": str(100 + j)} | ({"M5": f"m{j}"} if r.random() < 0.5 else {})) for j in range(4) if r.random() < 0.8]
        programs = r.sample(["p", "q", "s"], r.randint(1, 3))
        for j, p in enumerate(programs):
            lines.append(("PG", {"ID": p, "VN": str(r.randint(1, 2))} | ({"PP": programs[j - 1]} if j else {})))
        lines += [("RG", {"ID": g, "SM": r.choice("xy"), "PG": r.choice(programs)}) for g in "gh" if r.random() < 0.8]
        lines += [("CO", {"text": r.choice(["one", "two"])})]
        rows += [(f"f{i}", n, k, a) for n, (k, a) in enumerate(lines)]
    return rows


def meaning(lines, kind, name):
    """What a name says: its line without names, and the same of what it points to."""
    line = next((a for k, a in lines if k == kind and a.get("ID") == name), None)
    if line is None:
        return name
    return tuple(sorted((k, (v.split(".")[0], meaning(lines, "PG", v)) if k in ("PP", "PG") else v) for k, v in line.items() if k != "ID"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nothing_is_lost_or_mixed(spark, seed):
    rows = some(random.Random(seed), 6)
    df = spark.createDataFrame(rows, DDL)
    renamed = kept(headers.renames(df), "renames")
    out = headers.merged(df, renamed).orderBy("ordinal").collect()
    lines = [(x.rec_type, x.attrs) for x in out]
    ids = [(k, a["ID"]) for k, a in lines if k in ("RG", "PG")]
    assert len(ids) == len(set(ids)) and [x.ordinal for x in out] == list(range(len(out)))
    new = {(x.file, x.rec_type, x.id): x.new_id for x in renamed.collect()}
    said = {}
    for file in {x[0] for x in rows}:
        own = [(k, a) for f, _, k, a in rows if f == file]
        for kind, attrs in own:
            if kind in ("RG", "PG"):
                say = (kind, attrs["ID"], meaning(own, kind, attrs["ID"]))
                assert meaning(lines, kind, new[file, kind, attrs["ID"]]) == say[2]
                said.setdefault(say, set()).add(new[file, kind, attrs["ID"]])
    assert all(len(x) == 1 for x in said.values()) and len(said) == len(ids)
    for name in {a["SN"] for _, _, k, a in rows if k == "SQ"}:
        want = {k: v for _, _, kind, a in rows if kind == "SQ" and a["SN"] == name for k, v in a.items()}
        assert [a for k, a in lines if k == "SQ" and a["SN"] == name] == [want]
    sorts = {a["SO"] for _, _, k, a in rows if k == "HD"}
    assert lines[0] == ("HD", {"VN": max(a["VN"] for _, _, k, a in rows if k == "HD"), "SO": sorts.pop() if len(sorts) == 1 else "unsorted"})
    assert sorted(a["text"] for k, a in lines if k == "CO") == sorted({a["text"] for _, _, k, a in rows if k == "CO"})
    records = [(f, f"{f}/{a['ID']}/{k}", {"NM": ("C", "3"), k: ("Z", a["ID"]), "XX": ("A", "z")}) for f, _, k, a in rows if k in ("RG", "PG")] + [("f0", "plain", None), ("f0", "none", {"NM": ("i", "0")}), (None, "nowhere", {"RG": ("Z", "g")})]
    found = {x.qname: x.tags for x in headers.rewritten(spark.createDataFrame(records, TAGGED), renamed).collect()}
    assert len(found) == len(records) and found["plain"] is None and found["none"]["NM"] == ("i", "0") and found["nowhere"]["RG"] == ("Z", "g")
    for f, q, tags in records[:-3]:
        kind = q.split("/")[2]
        assert found[q] == {"NM": ("C", "3"), kind: ("Z", new[f, kind, tags[kind][1]]), "XX": ("A", "z")}


def test_contigs_that_differ_and_chains_without_an_end(spark):
    a = spark.createDataFrame([("f0", 0, "SQ", {"SN": "c", "LN": "5"}), ("f1", 0, "SQ", {"SN": "c", "LN": "6"})], DDL)
    with pytest.raises(Exception, match="headers differ at c LN"):
        headers.merged(a).collect()
    assert headers.merged(a.limit(0)).count() == 0


def test_a_circle_of_programs(spark, monkeypatch):
    monkeypatch.setattr(headers, "LONGEST", 5)
    df = spark.createDataFrame([("f", 0, "PG", {"ID": "a", "PP": "b"}), ("f", 1, "PG", {"ID": "b", "PP": "a"})], DDL)
    with pytest.raises(ValueError, match="no end"):
        headers.renames(df)

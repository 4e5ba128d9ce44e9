import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, n_tokens string, score string, node string, length string, band string"


@pytest.fixture(scope="session")
def texts():
    """Texts of all awkward kinds by id; 40 and 41 are near copies of 20, 42 is an exact one."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aetinosrlé") for _ in range(r.randint(1, 9)))
    out = {i: " ".join(word() for _ in range(r.randint(1, 120))) for i in range(30)}
    out |= {30: None, 31: "", 32: " \n\t ", 33: "a", 34: "one two three", 35: "One TWO three", 36: "x" * 3000, 37: "many words " * 9000, 38: "\x1c\x85 é 漢字 🙂 <|endoftext|> don't", 39: "a b c d e"}
    long = [word() for _ in range(200)]
    out[20] = " ".join(long)
    out[40] = " ".join([*long[:100], "CHANGED", *long[101:]])
    out[41] = " ".join(["NEW", *long])
    out[42] = out[20]
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, None if i % 3 else "en", "s", len(t or ""), 7, "x", "y", "z", "l", "b") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(documents):
    return documents.unionByName(documents.where("doc_id < 35"))

from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in "ba re tin sol mar du".split() for b in "ka lo mi nes tor".split()]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h long, cls long, o long, k string, size long, taken long, position double, kept boolean, path string, __id long, rank int, class int, id string, label int, good int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def rows() -> list[tuple]:
    """Documents of every odd kind, with copies, near copies, repeated rows and nulls."""
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    long = prose(2, 30_000)
    texts: list[tuple] = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (3, near, "en", "s2"), (4, None, None, None), (5, "", "en", "s1"), (6, " \n\t ", "de", "s2"),
        (7, "one two", "en", "s1"), (8, "ONE two", "en", "s1"), (9, long, "en", "s2"), (10, prose(3, 80) + " " + " ".join(words[10:50]), None, "s3"),
        (11, "In. " * 400, "en", "s3"), (12, "é😀 ß " * 40, "fr", "s2"), (13, "a" * 5000, "en", None), (13, "a" * 5000, "en", None), (None, prose(4, 50), "en", "s1"),
        (None, None, None, "s1"), (14, "mail x.y@mail.example.com now, call +1 (988) 555-2485", "en", "s1"), (15, "###" + prose(5, 30), "en", "s9"), (16, "\x00\x1c\x85 odd marks here", "en", "s9"),
    ]
    texts += [(20 + i, prose(100 + i, 40 + i), "en", f"s{i % 4}") for i in range(20)]
    return [(i, t, lang, source, len(t) if t else None, i, 1, 2, "k", 3, 4, 0.5, True, "p", 7, 1, 2, "i", 1, 0) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < -1")


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in rows()]

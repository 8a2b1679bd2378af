"""Substring removal and the n-gram join against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ngram_join, substring
from tessera.llm.components import components

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def brute_removal(texts):
    """(id, words, removed, sha) of each row; rows of one id and text are one document, texts of one id ordered by their hash."""
    import functools

    hashed = functools.cache(lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42))
    place = lambda i, t: (LAST if i is None else i, 0 if t is None else hashed(t))
    firsts: dict[tuple, tuple] = {}
    for i, t in sorted(set(texts), key=lambda x: place(*x)):
        w = WORD.findall(t or "")
        for s in range(len(w) - 19):
            firsts.setdefault(tuple(w[s : s + 20]), (place(i, t), s))
    out = []
    for i, t in texts:
        w = WORD.findall(t or "")
        gone = {k for s in range(len(w) - 19) if firsts[tuple(w[s : s + 20])] < (place(i, t), s) for k in range(s, s + 20)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def removal(df):
    return sorted(map(tuple, substring.digests(df).collect()), key=repr)


def test_removal_on_odd_documents(docs, texts, empty):
    assert removal(docs) == brute_removal(texts)
    assert substring.digests(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_removal_on_shared_passages(spark, seed):
    r = random.Random(seed)
    passages = [prose(1000 + i, r.randrange(15, 70)) for i in range(6)]
    texts = [(i, " ".join(r.choice(passages) if r.random() < 0.5 else prose(r.randrange(10**6), r.randrange(1, 40)) for _ in range(r.randrange(6)))) for i in range(60)]
    texts += [(100 + i, texts[i][1]) for i in range(0, 60, 7)] + [(200, "go " * 300), (201, "go " * 30 + "stop " + "go " * 30), (202, "a b " * 40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert removal(df) == brute_removal(texts)


def test_one_id_with_several_texts(spark):
    """What no other document has stays, whatever stands under the same id or under none."""
    a, b, c, d = (prose(60 + i, 40) for i in range(4))
    texts = [(1, a), (None, a), (None, b), (2, c), (2, a), (2, None), (3, d + " " + b), (None, d), (None, d), (-5, c + " x"), (None, f"{d} {c} y"), (2, c)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = removal(df)
    assert got == brute_removal(texts)
    assert {(i, n) for i, w, n, _ in got if w == 40} >= {(1, 0), (None, 40), (2, 40)} and removal(df.limit(0)) == []
    few = spark.createDataFrame([(1, a), (None, a), (None, b), (2, c), (2, a)], "doc_id long, text string")
    assert [(i, n) for i, _, n, _ in removal(few)] == [(1, 0), (2, 0), (2, 40), (None, 0), (None, 40)]
    gone = {(r["doc_id"], r["text_hash"]): r["kept"] for r in substring.remove_repeats(few).collect()}
    assert len(gone) == 2 and set(gone.values()) == {""}


def test_long_spans_and_texts(spark):
    shared = prose(7, 90)
    df = spark.createDataFrame([(1, prose(1, 30) + " " + shared), (2, shared + " " + prose(2, 30)), (3, "x")], "doc_id long, text string")
    _, found = substring.repeats(df.withColumnRenamed("doc_id", "o"))
    (span,) = substring.spans(found).collect()
    assert (span["o"], span["start"], span["words"], span["source"], span["source_start"]) == (2, 0, 90, 1, 30)
    (kept,) = substring.remove_repeats(df).collect()
    assert kept["doc_id"] == 2 and kept["kept"] == " ".join(WORD.findall(prose(2, 30)))


def sets(texts):
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        yield i, ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) if w else set()


def brute_components(texts):
    s = list(sets(texts))
    of = list(range(len(s)))

    def root(a):
        while of[a] != a:
            a = of[a]
        return a

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                of[root(a)] = root(b)
    least: dict[int, int] = {}
    for a, (i, _) in enumerate(s):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return sorted(((i, len(x), least.get(root(a), i)) for a, (i, x) in enumerate(s)), key=repr)


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()), key=repr)


def test_join_on_odd_documents(docs, texts, empty):
    assert joined(docs) == brute_components(texts)
    assert ngram_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_join_on_near_copies(spark, seed):
    """Chains and stars of copies, with as many edits as bring pairs to both sides of the threshold."""
    r = random.Random(seed)
    texts = []
    for g in range(4):
        base = prose(50 + g + 10 * seed, r.randrange(30, 200)).split(" ")
        for _ in range(r.randrange(5, 30)):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 25))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}" if r.random() < 0.7 else "same"
            if r.random() < 0.2:
                w = w[: int(len(w) * 0.8)]
            texts.append((len(texts), " ".join(w)))
            if r.random() < 0.3:
                base = w
    texts += [(len(texts) + i, prose(9000 + i, 60) + " " + prose(5, 20)) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert joined(df) == brute_components(texts)


def test_links_are_exact(spark):
    texts = [(i, prose(3, 100).replace(" ", f" x{i} ", 1) if i else prose(3, 100)) for i in range(5)]
    pairs = ngram_join.links(spark.createDataFrame(texts, "doc_id long, text string")).pairs
    by = dict(sets(texts))
    sizes = {tuple(sorted((len(x & y)) for _ in "a")) for i, x in by.items() for j, y in by.items() if i < j}
    assert {(p["shared"],) for p in pairs.collect()} <= sizes and pairs.count() >= 4


def brute_choice(texts):
    """The (id, text) pairs that stay: the first of each component, by id, then by the text's hash."""
    pairs = sorted(set(texts), key=lambda x: (x[0] is None, x[0] or 0, 0 if x[1] is None else (xxhash.xxh64_intdigest(x[1].encode(), seed=42) ^ 1 << 63)))
    s = [x for _, x in sets(pairs)]
    of = list(range(len(s)))
    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                old, new = sorted((of[a], of[b]), reverse=True)
                of = [new if x == old else x for x in of]
    return sorted((pairs[k] for k in set(of)), key=repr)


def test_one_of_each(docs, texts):
    left = ngram_join.one_of_each(docs)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == brute_choice(texts) and left.columns == docs.columns


def test_one_of_each_keeps_unique_texts(spark):
    a, c, x, y, z = (prose(80 + i, 40) for i in range(5))
    texts = [(1, a), (2, c), (2, a), (3, x), (3, y), (None, z), (None, z), (None, a), (None, c + " more"), (4, None), (4, ""), (4, ""), (None, None), (5, z + " end")]
    df = spark.createDataFrame([(i, t, "clash", k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, id string, component int")
    first = sorted(map(tuple, ngram_join.one_of_each(df).collect()), key=repr)
    assert sorted(((i, t) for i, t, _, _ in first), key=repr) == brute_choice(texts)
    assert first == sorted(map(tuple, ngram_join.one_of_each(df.repartition(5)).collect()), key=repr)
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, 1000)] + [(2000 + i, 2001 + i) for i in range(40)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert got == {a: c for a, c in of.items() if a != 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_in_a_large_group_stay_few(spark):
    """A star of 150 copies of one text: comparisons grow with the group, not with its square."""
    base = prose(77, 150).split(" ")
    texts = []
    for i in range(150):
        r = random.Random(i)
        w = list(base)
        for k in r.sample(range(len(w)), 3 if i else 0):
            w[k] = f"y{i}_{k}"
        texts.append((i, " ".join(w)))
    _, pairs, labels, compared = ngram_join.links(spark.createDataFrame(texts, "doc_id long, text string"))
    assert labels.select(F.count_distinct("component")).first()[0] == 1 and labels.count() == 150 and pairs.count() <= compared.count() < 1000


def test_common_passages_cost_few_pairs(spark):
    """Documents of passages from one pool, none linked: twice the documents may not cost many more pairs."""
    pool = [prose(700 + i, 20).replace("\n", " ") for i in range(40)]
    seen = []
    for n in (400, 800):
        r = random.Random(2)
        texts = [(i, " ".join(r.sample(pool, 5))) for i in range(n)]
        found = ngram_join.links(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
        by = [s for _, s in sets(texts)]
        want = {(i, j) for i in range(n) for j in range(i) if 100 * len(by[i] & by[j]) >= 80 * len(by[i] | by[j])}
        assert found.pairs.count() <= len(want)
        seen.append(found.compared.count())
    assert seen[1] <= 3 * seen[0] and seen[1] < 8 * 800, seen


def test_parities_bound_the_difference():
    import numpy as np

    r = np.random.default_rng(5)
    for size in (3, 50, 400, 3000):
        a, b = (np.unique(r.integers(0, 1 << 64, size, np.uint64)) for _ in "ab")
        b = np.unique(np.r_[b[: size // 4], a])
        h, at = np.r_[a, b], np.array([0, len(a), len(a) + len(b)])
        odd = ngram_join.parities(h, at)
        assert odd.shape == (2, ngram_join.PARITIES // 64) and 0 < np.bitwise_count(odd[0] ^ odd[1]).sum() <= len(np.setxor1d(a, b)) or size < 8

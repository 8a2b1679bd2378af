"""Mixing, packing and the pipeline."""

from __future__ import annotations

import collections
import functools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, packing, pii, quality

from .conftest import prose
from .test_dedup import brute_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes):
    """Targets by repeated resharing of what is above the limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    fixed: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        shares = sum(weight[s] for s in order if s not in fixed)
        target = {s: 3.0 * sizes[s] if s in fixed else rest * weight[s] / shares for s in order}
        over = {s for s in order if s not in fixed and target[s] > 3 * sizes[s]}
        if not over:
            return target
        fixed |= over


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    r = random.Random(seed)
    sizes = {(None if i == 3 else f"s{i}"): int(10 ** r.uniform(0, 5)) * (r.random() > 0.1) for i in range(r.randrange(1, 9))}
    got, want = mixing.capped_targets(sizes), reshared(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in got)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 * max(1, sum(sizes.values()))


def test_shares_integrate_to_targets():
    sizes = {"a": 700, "b": 200, None: 100}
    targets = mixing.capped_targets(sizes)
    knots = mixing.drifting_shares(sizes, targets)
    assert all(abs(sum(k.values()) - 1) < 1e-9 and min(k.values()) >= -1e-12 for _, k in knots)
    for s, ((t0, length, share, bend, before),) in mixing.integrated(knots, 1000.0).items():
        assert abs(before + 1000 * (share * length + bend * length**2) - targets[s]) < 1e-6 and t0 == 0


@pytest.fixture(scope="module")
def mixed(docs):
    return mixing.curriculum(docs).cache()


def test_mix(docs, texts, mixed):
    rows = mixed.collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    targets = reshared(size)
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["positions"]) == -(-r["taken"] // r["size"]) if r["size"] else r["taken"] == 0
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
    assert len(rows) == len(texts) and all(abs(taken[s] - targets[s]) <= 0.5 for s in targets)
    again = mixing.curriculum(docs.repartition(7)).select("doc_id", "taken", "size").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed.select("doc_id", "taken", "size").collect()))


def test_training_order(docs, mixed):
    got = mixing.in_training_order(docs, mixed).collect()
    assert got[0].__fields__ == docs.columns
    words = collections.Counter()
    for r in got:
        words[r["source"]] += len(WORD.findall(r["text"]))
    want = {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum("taken").alias("t")).where("t > 0").collect()}
    assert words == want


def test_positions_invert_demand(docs, mixed):
    """Up to any position, each source has given about what its schedule asks for."""
    rows = mixed.collect()
    sizes = {r["source"]: r["source_size"] for r in rows}
    targets = {r["source"]: r["target"] for r in rows}
    total = sum(targets.values())
    pieces = mixing.integrated(mixing.drifting_shares(sizes, targets), total)
    for t in (0.2, 0.5, 0.9):
        for s, ((_, _, share, bend, _),) in pieces.items():
            asked = total * (share * t + bend * t * t)
            began = sum(min(r["size"], r["taken"] - k * r["size"]) for r in rows if r["source"] == s for k, p in enumerate(r["positions"]) if p < t)
            most = max([r["size"] for r in rows if r["source"] == s])
            assert -1 <= began - asked <= most + 1


def test_repeated_rows_are_taken_as_often_as_they_count(spark):
    """Of two equal rows only the first is within its source's demand; other sources have rows of their own."""
    words = lambda n, w: " ".join([w] * n)
    rows = [(1, words(100, "a"), "s1"), (1, words(100, "a"), "s1"), (2, words(100, "b"), "s2"), (3, words(100, "c"), "s3"), (None, words(7, "d"), "s3"), (None, words(7, "d"), "s3"), (4, "", "s3")]
    for some in (rows, [r for k, r in enumerate(rows) if k not in (1, 5)]):
        docs = spark.createDataFrame(some, "doc_id long, text string, source string")
        mixed = mixing.curriculum(docs)
        got = collections.Counter()
        for r in mixing.in_training_order(docs, mixed).collect():
            got[r["source"]] += len(WORD.findall(r["text"]))
        assert got == {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum("taken").alias("t")).collect()}


def test_mix_of_nothing(empty):
    m = mixing.curriculum(empty)
    assert m.count() == 0 and mixing.in_training_order(empty, m).count() == 0


# ---- packing


@pytest.mark.parametrize("seed", range(6))
def test_cutting_stock(seed):
    r = random.Random(seed)
    room = r.choice([16, 64, 256])
    sizes = sorted(r.sample(range(1, room + 1), r.randrange(1, min(room, 90))))
    demand = [int(10 ** r.uniform(0, 4)) for _ in sizes]
    patterns = packing.cutting_stock(sizes, demand, room)
    held = collections.Counter()
    for p, times in patterns:
        assert sum(s * k for s, k in p.items()) <= room and times > 0
        for s, k in p.items():
            held[s] += k * times
    assert all(held[s] >= d for s, d in zip(sizes, demand, strict=True))
    # no more than first-fit decreasing needs, a few for rounding aside
    bins = collections.Counter()
    count = 0
    for s, d in sorted(zip(sizes, demand, strict=True), reverse=True):
        for _ in range(d):
            fit = min((b for b in bins if b >= s), default=None)
            if fit is None:
                fit, count = room, count + 1
            else:
                bins[fit] -= 1
                if not bins[fit]:
                    del bins[fit]
            if fit - s:
                bins[fit - s] += 1
    assert sum(t for _, t in patterns) <= count * 1.001 + len(sizes) / 2 + 1


def test_knapsack():
    r = np.random.default_rng(0)
    for _ in range(20):
        size, value = np.unique(r.integers(1, 20, 6)), r.random(20)
        value = value[: len(size)]
        best = {0: 0.0}
        for room in range(1, 41):
            best[room] = max([best[room - 1], *(best[room - s] + v for s, v in zip(size, value, strict=True) if s <= room)])
        took = packing.best_pattern(value, size, 40)
        assert (took * size).sum() <= 40 and abs((took * value).sum() - best[40]) < 1e-9


@functools.cache
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.VOCABULARY)


def reference_ids(text):
    return np.array([*reference_tokenizer().encode(text, add_special_tokens=False).ids, packing.END], "<u4")


def test_both_vocabulary_files_agree():
    odd = ["", " ", "a<|endoftext|>b", "é😀 ß", " x y", "tab\tand\r\nline\x0b\x0c\x1c\x85", "'s 're 'LL", "日本語 text", "x" * 3000, " " * 700, "١٢٣ 123", "á", "ſ ǅ ß"]
    r = random.Random(0)
    odd += ["".join(r.choice("aé ß'\n\t0.,!€–—‘’ñ  ") for _ in range(r.randrange(60))) for _ in range(400)] + ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x2000, 0x2070)])) for _ in range(30)) for _ in range(400)]
    for t in odd:
        assert (packing.token_ids(t) == reference_ids(t)).all(), t


def check_packed(rows, texts):
    ids = collections.defaultdict(list)
    for i, t in texts:
        ids[i].append(reference_ids(t or ""))
    by_sequence = collections.defaultdict(list)
    for r in rows:
        assert any(r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    return len(by_sequence)


def test_packing(docs, texts, empty):
    rows = packing.packed(docs).collect()
    total = sum(r["length"] for r in rows)
    assert check_packed(rows, texts) <= 1.05 * total / packing.LENGTH + 2
    assert packing.packed(empty).count() == 0


def test_padding_is_little(spark):
    texts = [(i, prose(i, random.Random(i).randrange(1, 900))) for i in range(500)]
    rows = packing.packed(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sequences = check_packed(rows, texts)
    assert sum(r["length"] for r in rows) / (sequences * packing.LENGTH) > 0.98


def test_short_texts_are_packed_tightly(spark):
    """Texts of a few tokens, empty ones too, fill sequences, beside long ones or alone."""
    for n, more in ((6000, []), (2500, [(9000 + i, prose(i, 1200)) for i in range(20)])):
        texts = [(i, [None, "", "go", "go on then", prose(i, 1 + i % 9)][i % 5]) for i in range(n)] + more
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        for order in (None, F.col("doc_id")):
            rows = packing.packed(df, **({"order": order} if order is not None else {})).collect()
            sequences = check_packed(rows, texts)
            assert sum(r["length"] for r in rows) / (sequences * packing.LENGTH) > 0.94
    one = packing.packed(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["length"], r["offset"]) for r in one] == [(1, 0)]


def test_plan_holds_every_rank():
    """Ranks of all bands and classes go to sequences with room for them, in order of their bands."""
    r = random.Random(3)
    demand = {(b, c): r.randrange(1, 300) for b in range(3) for c in r.sample(range(1, 65), 20)}
    plan = packing.Plan(demand, 64, 8)
    room, last = collections.Counter(), -1
    for b in range(3):
        band = np.concatenate([np.full(n, c) for (x, c), n in demand.items() if x == b])
        rank = np.concatenate([np.arange(n) for (x, _), n in demand.items() if x == b])
        sequence, place = plan.find(np.full(len(band), b), band, rank)
        for q, c in zip(sequence.tolist(), band.tolist(), strict=True):
            room[q] += c
        assert sequence.min() > last and (np.diff(sequence[band == band[0]]) >= 0).all()
        last = sequence.max()
    alone = [packing.cutting_stock(*zip(*sorted((c, n) for (x, c), n in demand.items() if x == b), strict=True), 64) for b in range(3)]
    assert max(room.values()) <= 64 and len(room) <= sum(times for patterns in alone for _, times in patterns)


def test_sequences_follow_the_order(spark):
    """Short texts come first in training and long ones last: sequence_id rises with the place, and padding stays little."""
    n = 6000
    texts = [(i * 7919 % n, prose(i, random.Random(i).randrange(1, 60 + i // 20)), i) for i in range(n)]
    df = spark.createDataFrame(texts, "doc_id long, text string, at long").repartition(5)
    rows = packing.packed(df, order=F.col("at")).collect()
    sequences = check_packed(rows, [x[:2] for x in texts])
    assert sum(r["length"] for r in rows) / (sequences * packing.LENGTH) > 0.98
    at = {d: i for d, _, i in texts}
    x, y = np.array([at[r["doc_id"]] for r in rows]), np.array([r["sequence_id"] for r in rows])
    order = np.argsort(y, kind="stable")
    assert np.corrcoef(np.argsort(np.argsort(x, kind="stable")), np.argsort(np.argsort(y, kind="stable")))[0, 1] > 0.97
    ends = [x[order][k : k + len(x) // 5].mean() for k in range(0, len(x) - len(x) // 5 + 1, len(x) // 5)]
    assert ends == sorted(ends)


# ---- pipeline


def fails(t):
    w = WORD.findall(t or "")
    times = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w) < 10 or 100 * len(inside) > 20 * len(w)


def test_stages(spark, docs, texts, tmp_path):
    """Each stage on odd documents: columns kept, decisions in effect."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    first = corpus_pipeline.quality_rules(spark, docs, sf)
    kept = sorted(map(repr, ((r["doc_id"], r["text"]) for r in first.collect())))

    assert kept == sorted(map(repr, (x for x in texts if not fails(x[1]))))
    second = corpus_pipeline.near_duplicates(spark, docs, sf)
    of = {i: c for i, _, c in brute_components(texts) if i is not None}
    assert sorted(r["doc_id"] for r in second.where("doc_id IS NOT NULL").collect()) == sorted(i for i in of if of[i] == i)
    third = corpus_pipeline.personal_data(spark, docs, sf)
    assert third.count() == len(texts) and "[EMAIL] now, call [PHONE]" in third.where("doc_id = 14").first()["text"]
    fourth = corpus_pipeline.mix(spark, docs, sf)
    assert fourth.count() > 0
    assert all(d.columns == docs.columns for d in (first, second, third, fourth))
    assert corpus_pipeline.pack(spark, docs, sf).columns[:2] == ["doc_id", "start"]


def test_sequences_follow_training(spark, tmp_path):
    """What the mix puts early is in early sequences: positions are kept by the files between the stages."""
    rows = [(i, prose(i, random.Random(i).randrange(1, 400)), "en", f"s{i % 4 if i % 7 else 0}", 0) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    at = collections.defaultdict(list)
    for r in mixing.curriculum(docs).collect():
        at[r["doc_id"]] += r["positions"]
    corpus_pipeline.mix(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    order = [r["doc_id"] for r in mixed.select("doc_id", corpus_pipeline.written(mixed).alias("o")).orderBy("o").collect()]
    assert order == [d for _, d in sorted((p, d) for d, ps in at.items() for p in ps)]
    got = corpus_pipeline.pack(spark, mixed, "").collect()
    once = {d: ps[0] for d, ps in at.items() if len(ps) == 1}
    x, y = zip(*[(once[r["doc_id"]], r["sequence_id"]) for r in got if r["doc_id"] in once], strict=True)
    ranks = [np.argsort(np.argsort(np.array(v), kind="stable")) for v in (x, y)]
    assert len(x) > 500 and np.corrcoef(*ranks)[0, 1] > 0.95
    sequences = len({r["sequence_id"] for r in got})
    assert sum(r["length"] for r in got) / (sequences * packing.LENGTH) > 0.97
    assert corpus_pipeline.written(docs.select("doc_id").limit(3).union(docs.select("doc_id"))) is None


def test_stages_on_nothing(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def plain_mix(rows):
    """The texts that the mix takes of rows (id, text, source), copies and cut ones included, by position."""
    import hashlib

    words = {(i, s): WORD.findall(t) for i, t, s in rows}
    sizes = collections.Counter()
    for (_, s), w in words.items():
        sizes[s] += len(w)
    targets = reshared(sizes)
    total = sum(targets.values())
    pieces = mixing.integrated(mixing.drifting_shares(dict(sizes), targets), total)
    out = []
    for s, target in targets.items():
        whole, at = int(target + 0.5), 0
        order = sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        ((_, _, share, bend, _),) = pieces[s]
        while at < whole and sizes[s]:
            for i, t in order:
                w = words[i, s]
                left = min(len(w), whole - at)
                if left > 0:
                    need = at / total
                    position = 2 * need / (share + max(0.0, share * share + 4 * bend * need) ** 0.5) if need > 0 else 0.0
                    out.append((position, i, t if left == len(w) else " ".join(w[:left])))
                at += len(w)
    return sorted(out, key=lambda x: x[:2])


def test_run(spark, docs, tmp_path):
    """The whole, against plain versions of the stages one after another, down to every piece's token ids."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    r = random.Random(40)
    secret = lambda: "".join(r.choice("abcdef") + r.choice("0123456789") for _ in range(20))
    more = [(200 + i, f"{prose(600 + i, 30)} token = \"{secret()}\" {prose(700 + i, 5)} jo{i}@mail.example.org {prose(800 + i, 9)}", "en", f"s{i % 3}") for i in range(30)]
    chosen = docs.select("doc_id", "text", "lang", "source").where("doc_id IS NOT NULL AND doc_id <> 13").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    chosen.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = [(r["doc_id"], r["text"], r["source"]) for r in quality.keep(chosen, quality.fit(quality.measure(chosen), labels)).collect()]
    kept = {i for i, t, _ in [(r["doc_id"], r["text"], r["source"]) for r in chosen.collect()] if not fails(t)}
    assert {i for i, _, _ in rows} == kept  # too few labels for more than the base rules
    of = {i: c for i, _, c in brute_components([r[:2] for r in rows])}
    rows = [r for r in rows if of[r[0]] == r[0]]
    field = pii.fit(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    clean = []
    for i, t, s in rows:
        for kind, a, b in reversed(pii.all_spans(t, field)[1]):  # no two overlap here
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        clean.append((i, t, s))
    assert sum("[SECRET]" in t and "[EMAIL]" in t for _, t, _ in clean) == 30
    mixed = plain_mix(clean)
    want = collections.Counter()
    for _, i, t in mixed:
        ids = reference_ids(t)
        for start in range(0, len(ids), packing.LENGTH):
            part = ids[start : start + packing.LENGTH]
            want[i, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert collections.Counter(tuple(x[c] for c in packing.PIECE) for x in got) == want
    by_sequence = collections.defaultdict(list)
    for x in got:
        by_sequence[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for o, n in parts if o < at) for at, _ in sorted(parts)] and sum(n for _, n in parts) <= packing.LENGTH

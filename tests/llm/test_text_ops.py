"""Quality rules, personal data, toxicity, licences and quotes."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, pii, quality, quotes, toxicity

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    times = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_counts(docs, texts):
    lines = [(900, "a b\na b\r\na b\n\n \n \na b"), (901, "x\n" * 9), (902, "p q r s t p q r s t u"), (903, "p q r s t q r s t p q")]
    df = docs.select("doc_id", "text", "lang").union(docs.sparkSession.createDataFrame([(*x, "en") for x in lines], "doc_id long, text string, lang string"))
    got = sorted(((r["doc_id"], *[r[c] for c in quality.COUNTS[:5]]) for r in quality.measure(df).collect()), key=repr)
    assert got == sorted(((i, *brute_counts(t)) for i, t in [*texts, *lines]), key=repr)


@pytest.mark.parametrize(("k", "n"), [(0, 50), (1, 50), (7, 300), (50, 50)])
def test_binomial_bound_is_exact(k, n):
    p = quality.binomial_upper(k, n, 0.05)
    tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert p == 1.0 if k == n else abs(tail - 0.05) < 1e-6


@pytest.fixture(scope="module")
def judged(spark):
    """Good prose and junk with symbols, half of each labelled, in two strata; one stratum has few labels."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        junk = r.random() < 0.3
        t = prose(i, 60)
        t = " ".join(w + r.choice(["###", "$$$", "!!"]) for w in t.split()) if junk else t
        rows.append((i, t, "xx" if i < 20 else "en"))
        if i % 2:
            labels.append((i, int(not junk), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    return docs, spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"), {i: "#" in t or "$" in t or "!!" in t for i, t, _ in rows}


def test_cutoffs_reject_junk_and_keep_the_rest(judged):
    docs, labels, junk = judged
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert not [i for i in junk if i >= 20 and junk[i] and got[i]["kept"]]
    assert sum(not got[i]["kept"] for i in junk if i >= 20 and not junk[i]) <= 0.01 * len(junk)
    assert all(got[i]["kept"] for i in range(20))  # too few labels to reject any
    cutoffs = quality.fit(quality.measure(docs), labels)
    assert {r["doc_id"] for r in quality.keep(docs, cutoffs).collect()} == {i for i, r in got.items() if r["kept"]}


def test_cutoffs_reject_junk_without_symbols_despite_odd_labels(spark):
    r = random.Random(8)
    rows, bad = [], {}
    for i in range(1600):
        w = prose(1000 + i, 60).split()
        kind = r.choice(["good"] * 6 + ["shout", "repeat", "same"])
        odd = i % 400 == 7
        if odd or i % 40 == 9:
            kind = "good"
        if kind == "shout" or odd:
            w = [x.upper() for x in w]
        elif kind == "repeat":
            w[30:35] = w[10:15]
        elif kind == "same" or i % 400 == 8:
            w[10:30] = [w[10]] * 3 + w[11:14] + [w[14]] * 3 + w[15:18] + [w[18]] * 3 + w[19:24]
        elif i % 40 == 9:
            w = w[:10] * 6  # labelled good, but the base rules reject it
        rows.append((i, " ".join(w), "en"))
        if kind != "good":
            bad[i] = kind
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i, _, _ in rows if i % 8], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.judge(docs, labels).collect()}
    assert not [(i, k) for i, k in bad.items() if got[i]["kept"]]
    good = [i for i in got if i not in bad and not got[i]["base_failed"]]
    assert sum(not got[i]["kept"] for i in good) <= quality.RISK * len(good)


def plain_cutoffs(rows, labels, group_of):
    """The chosen cutoffs by the same protocol in plain Python; rows: id -> (text, stratum)."""
    def steps(t):
        w = WORD.findall(t)
        n_chars, lines = sum(map(len, w)), [x for x in t.split("\n") if WORD.search(x)]
        _, _, symbols, dup, repeat = brute_counts(t)
        ratio = {
            "symbols": (symbols, n_chars), "repeats": (repeat, len(w)), "lines": (dup, len(lines)), "upper": (sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t), n_chars),
            "marks": (t.count("!") + t.count("?"), n_chars), "same": (sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)),
        }
        return {r: -(-quality.GRID * a // b) if b else 0 for r, (a, b) in ratio.items()}

    import zlib

    first = {}
    for i in sorted(i for i in labels if not (len(WORD.findall(rows[i][0])) < 10 or 100 * brute_counts(rows[i][0])[4] > 20 * len(WORD.findall(rows[i][0])))):
        first.setdefault(group_of(i), i)
    sets, out = {}, {}
    strata = {rows[i][1] for i in first.values()}
    halves = {h: {s: [(labels[i], steps(rows[i][0])) for i in first.values() if rows[i][1] == s and zlib.crc32(f"half{i}".encode()) % 2 == h] for s in strata} for h in (0, 1)}
    proposing = {s: x for s, x in halves[0].items() if any(good for good, _ in x)}
    for s, x in proposing.items():
        good, bad = [v for g, v in x if g == 1], [v for g, v in x if g != 1]
        last, sets[s] = dict.fromkeys(quality.RULES, quality.GRID), []
        for level in quality.LEVELS:
            stricter = {r: min([last[r], *(c for c in range(quality.GRID + 1) if sum(v[r] > c for v in good) <= level * len(good))]) for r in quality.RULES}
            kept = [v for v in bad if all(v[r] <= last[r] for r in quality.RULES)]
            more = {r: sum(v[r] > stricter[r] for v in kept) for r in quality.RULES}
            for r in sorted(quality.RULES, key=lambda r: -more[r]):
                if more[r]:
                    last = last | {r: stricter[r]}
                    sets[s].append(last)
    for s in sets:
        out[s] = {}
        good = [v for g, v in halves[1][s] if g == 1]
        for cutoffs in sets[s]:
            k = sum(any(v[r] > c for r, c in cutoffs.items()) for v in good)
            if not good or quality.binomial_upper(k, len(good), quality.ERROR / len(sets)) > quality.RISK:
                break
            out[s] = cutoffs
    return out, steps


def test_kept_against_plain(spark):
    """Exact copies, near copies and repeated rows count once; the verdicts are those of a plain version."""
    r = random.Random(9)
    rows, labels, base = {}, {}, {}
    for i in range(1400):
        copy = i % 5 == 4 and i > 40
        if copy:
            base[i] = base[i - r.randrange(1, 30)]
            w = rows[base[i]][0].split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = f"x{i}"
            rows[i] = (" ".join(w), rows[base[i]][1])
            labels[i] = labels[base[i]]
            continue
        base[i] = i
        bad = r.random() < 0.3
        w = prose(3000 + i, 80).split(" ")
        if bad or r.random() < 0.02:
            for _ in range(r.randrange(1, 12)):
                k = r.randrange(len(w))
                w[k] = r.choice([w[k].upper(), w[k] + "#$", w[k - 1], w[k] + "!?", "\n" + w[k]])
        rows[i] = (" ".join(w), ["en", "de", None, "few"][0 if i % 3 else i % 4])
        labels[i] = int(not bad)
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in rows.items()], "doc_id long, text string, lang string")
    marked = spark.createDataFrame([x for x in labels.items() if x[0] % 9], "doc_id long, quality int")
    measured = quality.measure(docs.union(docs.limit(200)))
    found = {i: base[i] for i in labels}
    assert quality.trials(measured.where("doc_id > -1").select("doc_id", "copy_keys")).count() == len(set(found.values()))
    want, steps = plain_cutoffs(rows, {i: g for i, g in labels.items() if i % 9}, lambda i: found[i])
    assert quality.fit(measured, marked) == want and any(want.values())
    for x in quality.judge(docs, marked).collect():
        t, s = rows[x["doc_id"]]
        v = steps(t)
        assert x["kept"] == (not x["base_failed"] and all(v[k] <= c for k, c in want.get(s, {}).items()))


def test_no_labels_leave_the_base_rules(docs, empty, judged):
    none = judged[1].where("doc_id < -1")
    rows = quality.judge(docs, none).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert quality.judge(empty, judged[1]).count() == 0
    assert quality.keep(docs, {}).columns == docs.columns


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("12.@ab+- ()9_%4.@") for _ in range(r.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 100_000 + " " + "+1 " * 50_000) == []


CARDS = ["4556737586899855", "4716 5874 6122 3331", "5105105105105100", "4111-1111-1111-1111"]


@pytest.fixture(scope="module")
def private(spark):
    r = random.Random(2)
    rows = []
    for i in range(240):
        w = prose(i, 40).split()
        w[10:10] = [f"token = \"{r.randbytes(20).hex()}\""] if i % 3 == 0 else ["mail", f"jo{i}@mail.example.org"] if i % 3 == 1 else ["call", f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"]
        w[25:25] = [r.choice(CARDS)] if i % 4 == 0 else [f"10.0.{i}.7"] if i % 4 == 1 else ["version", "2.0"]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    return df, pii.fit(df), dict(rows)


def test_field_finds_what_patterns_lack(private):
    _, field, _ = private
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    base, every = pii.all_spans(f"and so token = \"{secret}\" was lost", field)
    assert base == [] and every == [("secret", 16, 56)]
    both = f"{CARDS[0]} {CARDS[2]}"
    base, every = pii.all_spans(f"see {both} ok", field)  # too many digits for one card: boundaries are chosen together
    assert base == [] and [s[0] for s in every] == ["card", "card"]
    assert pii.all_spans("the year 1999 and version 2.0 of 12,000 words", field) == ([], [])


def test_rare_secrets_teach_the_field(spark):
    r = random.Random(11)
    made = {i: r.randbytes(20).hex() for i in range(0, 2000, 100)}
    rows = [(i, f"{prose(i, 20)} in {1900 + i % 100} " + (f"token = \"{made[i]}\" {prose(i + 1, 9)}" if i in made else f"we had version {i}.0")) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(any(m in t for m in made.values()) for t in pii.samples(df, sample=30)) == len(made) and len(pii.samples(df, sample=30)) < 4 * 30
    got = {r["doc_id"]: r["spans"] for r in pii.find(df, pii.fit(df, sample=30)).collect()}
    assert {i for i in got if "secret:" in got[i]} == set(made)


def test_secrets_of_letters(spark):
    r = random.Random(12)
    word = lambda: "-".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3))
    made = {i: word() for i in range(300) if i % 3 == 0}
    key = ["password = {}", "password={}", "token: {}", "secret = \"{}\""]
    rows = [(i, f"{prose(i, 20)} " + (key[i % 4].format(made[i]) if i in made else ["they said: nothing", "a = tinlo", "about forgotten"][i // 3 % 3]) + f" {prose(i + 1, 9)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.fit(df)
    for x in pii.redact(df, field).collect():
        assert ("[SECRET]" in x["text"]) == (x["doc_id"] in made) and made.get(x["doc_id"], "[no]") not in x["text"]


def test_many_secrets_in_a_row(private):
    """Spans are found once each, however long the stretch that has them."""
    _, field, _ = private
    r = random.Random(13)
    for n in (1, 13, 60, 400):
        made = ["".join(r.choice("abcdef") + r.choice("0123456789") for _ in range(20)) for _ in range(n)]
        text = " ".join(f"token = \"{x}\"" for x in made)
        base, every = pii.all_spans(text, field)
        assert base == [] and [text[a:b] for _, a, b in every] == made and {k for k, _, _ in every} == {"secret"}
        mixed = f"{text} jo@mail.example.org " * 2
        assert len(set(pii.all_spans(mixed, field)[1])) == len(pii.all_spans(mixed, field)[1]) == 2 * n + 2


def test_labelling_is_linear(private):
    import time

    _, field, _ = private
    text = "jo@mail.example.org 10.0.0.7 " * 4000
    began = time.process_time()
    found = [(w.words[w.segments[k][0]], pii.KINDS[y]) for w, truth in pii.labelled(text) for k, y in truth.items()]
    assert len(found) == 8000 and time.process_time() - began < 10
    assert len(pii.snippets(text)) == pii.SNIPPETS and all(len(x.split()) == pii.SNIPPET_WORDS for x in pii.snippets(text)) and pii.snippets("see jo@mail.example.org " * 3 + "so " * 20 + "in 1999 it") == ["see jo@mail.example.org " * 2 + "see jo@mail.example.org so so so", "so so so in 1999 it"]


def labellings(w, at=0):
    """All ways to choose segments of a window that don't overlap: lists of (segment, kind)."""
    if at >= len(w.words):
        yield []
        return
    yield from labellings(w, at + 1)
    for k, (i, j) in enumerate(w.segments):
        if i == at:
            for y in range(len(pii.KINDS)):
                for rest in labellings(w, j):
                    yield [(k, y), *rest]


def test_programs_agree_with_enumeration(private):
    """The best labelling, the log of the sum over all and each segment's probability, against all labellings of short windows."""
    _, field, _ = private
    r = random.Random(14)
    for text in ("call +1 (988) 555-2485", "token = \"9f86d081884c7d65\" 10.0.0.7", "a=1 b@c.de", "4111 1111 x", "(5 6 ("):
        for _ in range(4):
            (w,) = pii.windows(text)
            scores = [[s + r.uniform(-2, 2) for s in row] for row in field.scores(w)]
            every = list(labellings(w))
            totals = [sum(scores[k][y] for k, y in x) for x in every]
            forward, sure = field.sums(w, scores)
            log = math.log(sum(math.exp(t - max(totals)) for t in totals)) + max(totals)
            assert abs(forward[-1] - log) < 1e-9
            for k in range(len(w.segments)):
                for y in range(len(pii.KINDS)):
                    assert abs(sure[k][y] - sum(math.exp(t - log) for t, x in zip(totals, every, strict=True) if (k, y) in x)) < 1e-9
        scores = field.scores(w)
        best = max(every, key=lambda x: sum(scores[k][y] for k, y in x))
        assert [(pii.KINDS[y], *w.segments[k]) for k, y in best] == [x[:3] for x in field.best(w)]


def test_windows_agree_with_one_window(private):
    """Segments of all windows of a text are those of the whole text as one window."""
    df, _, texts = private
    for text in [*list(texts.values())[:40], "1 a b c d e 2 a b c d e f 3 a b c d e f g h i j 4 (a b 5"]:
        words = [m.span() for m in WORD.finditer(text)]
        whole = pii.Window(text, words, "", pii._values(text, words))
        place = lambda w: [(w.words[i][0], w.words[j - 1][1]) for i, j in w.segments]
        parts = [x for w in pii.windows(text) for x in place(w)]
        assert len(parts) == len(set(parts)) and set(parts) == set(place(whole))


def test_spans(private):
    df, field, texts = private
    for r in pii.find(df, field).collect():
        base = brute_spans(texts[r["doc_id"]])
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert ("secret:" in r["spans"]) == ("token" in texts[r["doc_id"]])


def test_redaction(private, docs, empty):
    df, field, texts = private
    for r in pii.redact(df, field).collect():
        assert not brute_spans(r["text"]) and ("[SECRET]" in r["text"]) == ("token" in texts[r["doc_id"]])
    assert pii.redact(docs, field).columns == docs.columns and pii.redact(docs, field).count() == docs.count()
    rows = pii.find(docs, field).collect()
    assert len(rows) == docs.count() and pii.find(empty, pii.fit(empty)).count() == 0
    assert next(r for r in rows if r["doc_id"] == 4)["spans"] == "" and next(r for r in rows if r["doc_id"] == 14)["n_email"] == 1


# ---- toxicity


def brute_kernel(s, t):
    """All pairs of places of three letters."""
    import itertools

    total = 0.0
    for a in itertools.combinations(range(len(s)), toxicity.ORDER):
        for b in itertools.combinations(range(len(t)), toxicity.ORDER):
            if all(s[i] == t[j] and s[i] for i, j in zip(a, b, strict=True)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel():
    r = random.Random(4)
    words = toxicity.codes([bytes(r.choice(b"abc.") for _ in range(r.randrange(1, 8))) for _ in range(30)])
    other = toxicity.codes([b"abcab"])
    got = toxicity.kernel(words, other[:, :5])
    assert np.allclose(got, [brute_kernel(w[:8].tolist(), other[0, :5].tolist()) for w in words])
    assert np.allclose(toxicity.kernel(words, words), [brute_kernel(w[:8].tolist(), w[:8].tolist()) for w in words])


def insulted(n, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = prose(i, 60).split()
        bad = i % 3 == 0
        for _ in range(4 * bad):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "pathetic", "worthless"]))
        rows.append((i, bad, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fitted(spark.createDataFrame(insulted(300), "doc_id long, toxic boolean, text string"), toxicity.Settings())


def test_near_copies_teach_once(spark):
    rows = insulted(60)
    copies = [(1000 + i, bad, t + " and") for i, bad, t in rows[:20]] + [(2000, False, prose(1, 30)), (2001, True, "a b"), (2002, True, "a b"), (2003, False, "")]
    left = {r["doc_id"] for r in toxicity.apart(spark.createDataFrame(rows + copies, "doc_id long, toxic boolean, text string")).collect()}
    assert left == {i for i, _, _ in rows} | {2000, 2001, 2003} - {2000 if prose(1, 60).startswith(prose(1, 30)) else -1}


def test_cross_validation(spark):
    """The better settings come first; folds are judged by models that have not seen them."""
    texts = spark.createDataFrame(insulted(240), "doc_id long, toxic boolean, text string").cache()
    found = toxicity.cross_validated(texts, [toxicity.Settings(), toxicity.Settings(least=0.999), toxicity.Settings(landmarks=1)], 3)
    assert [x[1] for x in found] == sorted(x[1] for x in found) and found[0][2:] == (80, 0) and found[-1][0].landmarks == 1
    nothing = texts.withColumn("toxic", F.col("doc_id") % 2 == 0)
    assert toxicity.cross_validated(nothing, [toxicity.Settings()], 2)[0][3] <= 20


def test_what_is_in_sight():
    """Of words spoilt by gaps, insertions, losses and changes, hardly any that is like a landmark is out of sight of it."""
    r = random.Random(31)
    words = ["idiot", "moron", "pathetic", "worthless", "disgusting", "loser", "stupid", "garbage"]
    landmarks = toxicity.codes([toxicity.START + w.encode() for w in words])
    spoilt = []
    for _ in range(4000):
        w = list(r.choice(words) if r.random() < 0.8 else "".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randrange(3, 12))))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = [r.choice("._*-aeiox"), ""][r.random() < 0.3]
        spoilt.append(toxicity.START + "".join(w).encode()[:20] + toxicity.END)
    rows = toxicity.codes(spoilt)
    own, mine = toxicity.kernel(rows, rows), toxicity.kernel(landmarks, landmarks)
    every = np.stack([toxicity.kernel(rows, landmarks[k : k + 1]) / np.sqrt(np.maximum(own, 1e-300) * mine[k]) for k in range(len(words))], 1)
    like = every >= toxicity.Settings().least
    bits = np.bitwise_or.reduce(np.where(rows > toxicity.END[0], toxicity._BIT[rows], 0), 1)
    lost = like & ~(toxicity.in_sight(rows, landmarks) & toxicity.has_letters(bits, landmarks).T)
    assert like.sum() > 1500 and lost.sum() < 0.01 * like.sum()
    assert np.allclose(toxicity.likeness(rows, landmarks)[like & ~lost], every[like & ~lost])


def test_scores_against_plain(model):
    """Every word of a text against every landmark by the plain kernel, sentence by sentence."""
    r = random.Random(17)
    texts = [" ".join(r.choice(["idiot", "mo.ron", "patheticc", "the", "worthle-ss", "tin", "sol.", "mar!"]) for _ in range(r.randrange(1, 14))) for _ in range(12)]
    lands = [x.tolist() for x in model.landmarks]
    size = [brute_kernel(x[: max(np.flatnonzero(x)) + 1], x[: max(np.flatnonzero(x)) + 1]) for x in map(np.array, lands)]
    want = []
    for t in texts:
        cosine = {}
        place = 0
        for w in t.split():
            at = t.index(w, place)
            place = at + len(w)
            n = sum(c in ".!?\n" for c in t[: at + 1])
            letters = [int(toxicity._CODE[c]) for c in w.encode()]
            row = [1, *letters]
            row[len(row) - next(i for i, c in enumerate(reversed(row)) if c) :] = [2]
            own = brute_kernel(row, row)
            near = toxicity.in_sight(np.array([row + [0] * (toxicity.WIDTH + 2 - len(row))], np.uint8), model.landmarks)[0]
            for k, l in enumerate(lands):
                l = l[: max(np.flatnonzero(l)) + 1]
                if near[k] and own:
                    cosine.setdefault(n, np.zeros(len(lands)))[k] = max(cosine.get(n, np.zeros(len(lands)))[k], brute_kernel(row, l) / math.sqrt(own * size[k]))
        margins = sorted([float(model.settings.shaped(x) @ model.weights + model.bias) for x in cosine.values()] + [model.bias] * 2)[::-1][:2]
        want.append(1 / (1 + math.exp(-min(30, max(-30, float(np.array(margins) @ model.slopes + model.shift))))))
    assert np.allclose(score_of(model, texts), want)


def score_of(model, texts):
    import pyarrow as pa

    from tessera.llm.common import slices

    return np.concatenate([model.score(len(t), *toxicity.sentence_features(t, model.landmarks)) for t in slices(pa.array(texts))])


def test_insults_with_gaps(model):
    bad = ["tinlo idiot. balo moron sol.", "an i.d.i.o.t and a m-o-r-o-n.\nso i d i o t here", "you idi*ot. such a moronn. a pat-hetic one"]
    good = [prose(999, 60), "", "the closer notion of patients", "morning radio"]
    s = score_of(model, bad + good)
    assert (s[:3] > s[3:].max() + 0.1).all() and s[0] >= toxicity.TOXIC_FROM and (s[3:] < toxicity.TOXIC_FROM).all()
    assert (score_of(model, [good[0]] * 3 + [""] * 2)[:3] == s[3]).all()


def test_scores_of_odd_documents(docs, empty, model):
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0


def test_fit_holds_rows_out(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        w = prose(i, 30).split()
        if i % 2:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame([*rows, (None, "x"), (1000, None)], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score(docs, m).collect()}
    out = [i for i, _ in rows if got[i]["held_out"]]
    import zlib

    assert out == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2] and all(got[i]["predicted"] == i % 2 for i in out)
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None


# ---- licences


def test_notices(spark):
    rows = [(1, "Some text. " * 9 + "\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "Released under the MIT License."), (3, "a licence of another kind"), (4, None), (5, ""), (6, "x " * 20 + "\nThis work is licensed under CC BY-NC 4.0."), (7, "Released under the MIT License.\nAll rights reserved.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, path string")
    paths = F.element_at(F.create_map(*[x for k, v in {1: "r/a/1", 2: "r/LICENSE", 3: "r/a/b/3", 4: "q/4", 5: "r/5", 6: "r/a/b/6", 7: "q/z/7"}.items() for x in (F.lit(k), F.lit(v))]), F.col("doc_id").cast("int"))
    got = {r["doc_id"]: r for r in licenses.inherit(licenses.scan(df, paths)).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["Apache-2.0", "MIT", "MIT", None, "MIT", "CC-BY-NC-4.0", "MIT"]
    assert got[2]["license_file"] and not got[1]["license_file"] and got[3]["license_dir"] == "r" and got[1]["license_dir"] is None


def test_nearest_directory(spark):
    rows = [("a/L", "MIT", True), ("a/b/c/L", "ISC", True), ("a/b/c/d/x", None, False), ("a/b/x", None, False), ("z/x", None, False), (None, None, False), ("x", None, False)]
    df = spark.createDataFrame([(i, *r, 0.0) for i, r in enumerate(rows)], "doc_id long, path string, own_license string, license_file boolean, similarity double")
    assert {r["path"]: r["license"] for r in licenses.inherit(df).collect()} == {"a/L": "MIT", "a/b/c/L": "ISC", "a/b/c/d/x": "ISC", "a/b/x": "MIT", "z/x": None, None: None, "x": None}


def test_cosines_against_plain(spark):
    lines = ["Licensed under the Apache License, Version 2.0", "under the GNU General Public License", "all rights", "the the the license", "Released under CC BY 4.0 and more words here", "2.0"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    t = licenses.Templates(licenses.TEMPLATES)
    df, n = licenses.frequencies(docs, t)
    weight = t.weights(df, n)
    strip = lambda s: [w.lower().strip("\"'()*,.:;<>[]{}!?#/-_=+|&%$") or w for w in s.split()]
    idf = lambda w: math.log((1 + n) / (1 + sum(w in strip(x) for x in lines))) + 1
    known = {w for x in licenses.TEMPLATES.values() for y in x for w in strip(y)}

    def cosine(a, b):
        v, u = collections.Counter(strip(a)), collections.Counter(strip(b))
        top = sum(v[w] * u[w] * idf(w) ** 2 for w in v)
        size = sum((v[w] * idf(w)) ** 2 if w in known else v[w] * (math.log(1 + n) + 1) ** 2 for w in v)
        return top / math.sqrt(size * sum((u[w] * idf(w)) ** 2 for w in u))

    for line in lines:
        want = max(cosine(line, y) for x in licenses.TEMPLATES.values() for y in x)
        got = licenses.notices(licenses._of(line), t, weight)[1][0]
        assert got == 0 if want < licenses.LIKE else abs(got - want) < 1e-9


MARKS = "\"'()*,.:;<>[]{}!?#/-_=+|&%$"


def plain_words(text):
    """(term, line, sentence) of each word that is more than marks."""
    out, line, sentence = [], 0, 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+|\n", text):
        if m[0] == "\n":
            line += 1
            continue
        w = m[0]
        while len(w) > 1 and w[0] in MARKS:
            w = w[1:]
        while len(w) > 1 and w[-1] in MARKS:
            w = w[:-1]
        if len(w) > 1 or w not in MARKS:
            out.append((w.lower(), line, sentence))
        sentence += m[0][-1] in ".!?"
    return out


def plain_scan(texts, notices, bodies):
    """The best licence, its cosine and whether the text is a licence file, by comparing every stretch with every template."""
    flat = [(n, plain_words(x)) for d in (notices, bodies) for n in sorted(d) for x in d[n]]
    vectors = [(n, collections.Counter(w for w, _, _ in ws), len(ws)) for n, ws in flat]
    count = sum(map(len, notices.values()))
    known = {w for _, v, _ in vectors for w in v}
    has = [{w for w, _, _ in plain_words(t or "")} for t in texts]
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in h for h in has))) + 1 for w in known}
    rare = math.log(1 + len(texts)) + 1

    def cosine(words, k):
        v, u = collections.Counter(words), vectors[k][1]
        size = sum((c * idf[w]) ** 2 if w in known else c * rare**2 for w, c in v.items())
        return round(sum(c * u[w] * idf[w] ** 2 for w, c in v.items() if w in u) / math.sqrt(size * sum((c * idf[w]) ** 2 for w, c in u.items())), 9)

    out = []
    for t in texts:
        ws = plain_words(t or "")
        term = [w for w, _, _ in ws]
        spans = [(a, b, range(count)) for of in (1, 2) for a, b in ((min(x), max(x) + 1) for x in ([i for i, w in enumerate(ws) if w[of] == n] for n in {w[of] for w in ws}))]
        for n in {vectors[k][2] for k in range(count)}:
            spans += [(a, a + n, [k for k in range(count) if vectors[k][2] == n]) for a in range(len(ws) - n + 1)]
        for k in range(count, len(vectors)):
            n = vectors[k][2]
            spans += [(a, min(a + n, len(ws)), [k]) for a in sorted({*range(0, max(0, len(ws) - n) + 1, max(1, n // 16)), max(0, len(ws) - n)}) if ws]
        best, inside = (-1, 0.0, 0, None), set()
        for a, b, which in spans:
            like, k = max((cosine(term[a:b], k), -k) for k in which)
            if like >= licenses.LIKE:
                name = vectors[-k][0]
                inside |= set(range(a, b))
                best = max(best, (2 if -k >= count else int(name != "Proprietary"), like, -a, name), key=lambda x: x[:3])
        out.append((best[3], round(best[1], 6), bool(ws) and len(inside) >= licenses.MOSTLY * len(ws)))
    return out


def test_scan_against_plain(spark):
    """Random texts of pieces of notices and licence texts, whole, cut, commented and broken over lines, among other words."""
    r = random.Random(21)
    notices = {k: licenses.TEMPLATES[k] for k in ("MIT", "GPL-3.0", "GPL-2.0", "CC-BY-4.0", "Proprietary")}
    bodies = {"MIT": (licenses.HEADERS["MIT"],), "MPL-2.0": (licenses.HEADERS["MPL-2.0"],), "GPL-3.0": (licenses.HEADERS["GPL-3.0"],)}
    every = [x for d in (notices, bodies) for v in d.values() for x in v]
    texts = [None, "", "the license", "### // ..."]
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(every).split() if r.random() < 0.6 else prose(500 + i, r.randrange(1, 30)).split()
            if r.random() < 0.4:
                w = w[r.randrange(len(w)) :]
            if r.random() < 0.4:
                w.insert(r.randrange(len(w) + 1), r.choice(["any", "//", "the"]))
            parts.append(r.choice([" ", "\n", "\n# ", " * "]).join(w) if r.random() < 0.3 else " ".join(w))
        texts.append(r.choice(["\n", " ", ". "]).join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in licenses.scan(df, F.lit("a/b"), templates=notices, texts=bodies).collect()}
    want = plain_scan(texts, notices, bodies)
    assert [(got[i]["own_license"], got[i]["similarity"], got[i]["license_file"]) for i in range(len(texts))] == want
    assert len({w[0] for w in want}) >= 6 and {w[2] for w in want} == {True, False}


def test_inheritance_does_not_shuffle_files(spark):
    df = spark.range(200).selectExpr("id AS doc_id", "concat('r/d', id % 3, '/', id) AS path", "if(id = 0, 'MIT', null) AS own_license", "0.0 AS similarity", "id = 0 AS license_file")
    plan = licenses.inherit(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_licences_of_odd_documents(docs, empty):
    assert licenses.inherit(licenses.scan(docs, F.lit("a/b"))).count() == docs.count() and licenses.inherit(licenses.scan(empty, F.lit("a/b"))).count() == 0


def test_licence_files_headers_and_tags(spark):
    texts = licenses.licence_texts()
    files = [(k, "Copyright (c) 2021 Jane Roe. All rights reserved.\n\n" + v[0]) for k, v in texts.items()]
    heads = [(k, "# " + v.replace("\n", "\n# ") + "\n" + prose(7, 300)) for k, v in licenses.HEADERS.items()]
    tags = [(k, f"// SPDX-License-Identifier: {k}\n" + prose(8, 100)) for k in licenses.NAMES]
    rows = [*files, *heads, *tags]
    df = spark.createDataFrame([(i, t, f"r{i}/L") for i, (_, t) in enumerate(rows)] + [(1000 + i, prose(200 + i, 300), f"r{i}/a/b") for i in range(len(files))], "doc_id long, text string, path string")
    got = {r["doc_id"]: r for r in licenses.inherit(licenses.scan(df, F.col("path"))).collect()}
    assert [got[i]["license"] for i in range(len(rows))] == [k for k, _ in rows]
    assert [got[i]["license_file"] for i in range(len(rows))] == [i < len(files) for i in range(len(rows))]
    assert [got[1000 + i]["license"] for i in range(len(files))] == [k for k, _ in files]


def test_notices_inside_lines_comments_and_sentences(spark):
    words = prose(9, 60).replace("\n", " ")
    rows = [
        ("MIT", "# Licensed under the MIT License."), ("Apache-2.0", "// Licensed under the Apache License, Version 2.0."), ("MIT", "/* Licensed under the MIT License. */"),
        ("MIT", "Copyright 2021 Jane Roe. Licensed under the MIT License."), ("ISC", f"{words} Released under the ISC License. {words}"), ("GPL-3.0", f"{words} licensed under the GNU General\n * Public License, version 3 {words}"),
        ("MPL-2.0", "Copyright Jane Roe. All rights reserved. Licensed under the Mozilla Public License, version 2.0."), (None, words), (None, "the # // general * public"),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] + [(100 + i, prose(300 + i, 50)) for i in range(50)], "doc_id long, text string")
    got = {r["doc_id"]: r["own_license"] for r in licenses.scan(df, F.lit("a/b")).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in rows] and not any(got[100 + i] for i in range(50))


# ---- quotes

TALK = [
    (1, 0, "u", "Hello there. How are you?"), (1, 1, "a", "I am fine. Thanks for asking!"), (1, 2, "u", "Bob wrote:\n> I am fine.\n> Thanks for asking!\n>> Hello there. How\n>> are you?\nGood to know."),
    (1, 3, "a", "> Hello   there.\nYes?"), (1, 4, "u", ">> Good to know.\n> Yes?\nok > fine"), (1, 5, "a", None), (None, 0, "u", "> x"), (2, None, "u", "> y"), (2, 0, "u", ""), (2, 1, "u", "> nothing known."),
    (1, 6, "a", ">ok > fine\n \t>  \nsee"), (1, 6, "a", ">ok > fine\n \t>  \nsee"), (3, 0, "u", "a. b."), (3, 1, "u", "a. c."), (3, 2, "x", "> a. b. c.\n> c."), (4, 0, "u", "> me"), (4, 1, "u", "It wrote: this"),
]


def test_replies(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in TALK], "conv_id long, turn long, role string, text string, root string, level int")
    rows = quotes.reply_ordered(df).collect()
    got = {(r["conv_id"], r["turn"]): r for r in rows}
    assert [(got[1, t]["parent_turn"], got[1, t]["root_turn"], got[1, t]["level"]) for t in range(7)] == [(None, 0, 0), (None, 1, 0), (1, 1, 1), (0, 0, 1), (3, 0, 2), (None, 5, 0), (4, 0, 3)]
    assert got[1, 2]["text"] == "Good to know." and got[1, 2]["linked_passages"] == 2 and got[4, 1]["text"] == "It wrote: this" and got[1, 5]["text"] is None
    assert len(rows) == len(TALK) and [r["turn"] for r in rows if r["conv_id"] == 1] == [0, 3, 4, 6, 6, 1, 2, 5]
    assert quotes.reply_ordered(df.where("turn > 99")).count() == 0


def test_replies_agree_with_sql(spark):
    import duckdb
    import pandas as pd

    from tessera.llm.queries import ORACLES

    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(TALK, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(ORACLES["op7_quotation_linking"]).fetchall()
    columns = [d[0] for d in con.description]
    got = quotes.reply_ordered(spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_random_replies_agree_with_sql(spark):
    """Conversations that quote earlier messages, whole, in part, changed, wrapped and nested, against the SQL; most messages are linked."""
    import duckdb
    import pandas as pd

    from tessera.llm.queries import ORACLES

    r = random.Random(51)
    talk = []
    for conv in range(40):
        said: list[str] = []
        for turn in range(r.randrange(2, 9)):
            own = " ".join(f"{prose(r.randrange(60), r.randrange(3, 7)).replace(chr(10), ' ').rstrip('.')}{r.choice('.?!')}" for _ in range(r.randrange(1, 4)))
            lines = []
            for _ in range(r.randrange(0, 3) if said else 0):
                words = r.choice(said).replace("\n", " \n ").split(" ")
                if r.random() < 0.3:
                    words = words[: r.randrange(1, len(words) + 1)]
                if r.random() < 0.2:
                    words[r.randrange(len(words))] = "other"
                quoted = " ".join(words).replace(" \n ", "\n")
                mark = r.choice(["> ", ">", " > ", ">\t"])
                lines += r.choice([[], [], ["Ann wrote:"], ["On Monday Bob writes :"]])
                lines += [mark + x for part in quoted.split("\n") for x in ([part] if r.random() < 0.5 or len(part) < 30 else [part[:20].rsplit(" ", 1)[0], part[len(part[:20].rsplit(" ", 1)[0]) :].strip()])]
                if r.random() < 0.5:
                    lines.append(r.choice(["", "yes.", "so it is > that."]))
            text = "\n".join([*lines, own]) if r.random() < 0.7 else "\n".join([own, *lines])
            talk.append((conv, turn, r.choice("ua"), text))
            said.append(text)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(talk, columns=["conv_id", "turn", "role", "text"]))
    want = con.execute(ORACLES["op7_quotation_linking"]).fetchall()
    columns = [d[0] for d in con.description]
    got = quotes.reply_ordered(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(x["parent_turn"] is not None for x in got) > len(talk) / 3 and max(x["level"] for x in got) > 2 and max(x["linked_passages"] for x in got) > 1


def test_replies_run_no_python(spark):
    plan = quotes.reply_ordered(spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

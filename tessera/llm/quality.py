"""Quality rules whose cutoffs are chosen under a guarantee of few false rejections.

A rule rejects a document if a ratio measured on its text is above a cutoff.
Labelled documents that are copies or near copies of each other are one trial:
of each such group, found by bands of minimum hashes of its five-word windows,
the document with the least id counts, so that trials are independent and none
is in both halves. One half of the trials (by a hash of the id) proposes, for
each stratum, a sequence of ever stricter sets of cutoffs; the other half, never
used for that, tests them in this order. Documents that the base rules reject
are in neither half. A set is accepted if the exact binomial (Clopper-Pearson)
upper bound on the share of good documents it rejects is at most ``RISK``; the
first set that fails ends the sequence. From set to set one rule gets a stricter
cutoff, and only if that rejects bad documents of the proposing half which the
set before keeps.
Testing in a fixed order needs no correction within a stratum, and the error
rate ``ERROR`` is divided by the number of strata (Bonferroni), so that with
probability 1 - ERROR no stratum's cutoffs reject more than RISK of the good
documents that the base rules keep.
A stratum with too few labels keeps all that the base rules keep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, _OF_BYTE, SPACE, Texts, cut, lists, mix, signed, slices, small
from .components import components

#: Most good documents that may be rejected, as a share, and the probability that this fails in any stratum.
RISK, ERROR = 0.05, 0.05
#: Shares of good documents that each rule of the proposed sets may reject in the proposing half, in the order of testing.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.04, RISK)
#: Bands of minimum hashes, and hashes of a band: documents with a band in common count as copies. At a similarity
#: of 0.8 that misses one pair in 1300; at 0.3 it joins one in four, at 0.1 one in a hundred, which costs trials only.
COPY_BANDS, COPY_ROWS = 10, 3
#: Ratios are compared on this grid: cutoffs are multiples of 1 / GRID.
GRID = 256
#: Rules: a name and what is divided by what.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "same": ("n_same_as_last", "n_words"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_same_as_last")

_SYMBOL, _UPPER, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"!?"))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def counts(t: Texts) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    data, n = t.data, len(t)
    word = ~SPACE[data]
    out = {"n_words": np.diff(t.at), "word_chars": _per_text(word & ((data & 0xC0) != 0x80), t.offsets)}
    out |= {k: _per_text(of[data], t.offsets) for k, of in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK))}

    # lines: from each text's start or after a line end, to the next line end or the text's end
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.r_[t.offsets[:-1], breaks + 1])
    text = np.r_[np.arange(n), np.searchsorted(t.offsets, breaks, "right") - 1]
    text.sort()  # a line begins in the text of the break before it
    ends = np.append(starts[1:] - 1, len(data))
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    ends[last] = t.offsets[1:]
    has = np.searchsorted(t.starts, starts) < np.searchsorted(t.starts, ends)
    starts, ends, text = starts[has], ends[has], text[has]
    h = _BYTES[0].stretches(_OF_BYTE[0][data], starts, ends)
    first = np.unique(h ^ mix(text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    out["n_lines"] = np.bincount(text, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(text[first], minlength=n)

    words = t.word_hashes()
    h, at = t.windows(5, hashes=words)
    text = np.repeat(np.arange(n), np.diff(at))
    _, which, times = np.unique(h ^ mix(text.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    begins = (np.arange(len(h)) - at[text] + t.at[text])[times[which] > 1] if len(h) else np.zeros(0, np.int64)
    steps = np.bincount(begins, minlength=len(words) + 6) - np.bincount(begins + 5, minlength=len(words) + 6)
    out["n_repeat_words"] = _per_text(np.cumsum(steps)[: len(words)] > 0, t.at)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[t.at[:-1][t.at[:-1] < len(words)]] = False
    out["n_same_as_last"] = _per_text(same, t.at)
    return {k: out[k].astype(np.int64) for k in COUNTS}


_SEEDS = mix(np.arange(1, COPY_BANDS * COPY_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def copy_keys(t: Texts) -> pa.Array:
    """Of each text with five words the hashes of its bands; none of shorter texts."""
    h, at = t.windows(5)
    out = np.zeros((len(t), COPY_BANDS), np.uint64)
    long = np.flatnonzero(np.diff(at))
    if len(long):
        for k, seed in enumerate(_SEEDS):
            band = k // COPY_ROWS
            out[long, band] = mix(out[long, band] * np.uint64(31) ^ np.minimum.reduceat(h * seed, at[long]) ^ np.uint64(band))
    return lists(signed(out[long].ravel()), np.where(np.diff(at) > 0, COPY_BANDS, 0))


def _counted(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [counts(t) for t in slices(column)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COUNTS}


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the counts and the copy keys of each document, in one pass without a shuffle. Null texts count as empty."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b["text"]):
                part = b.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["stratum"], *map(pa.array, counts(t).values()), copy_keys(t)], ["doc_id", "stratum", *COUNTS, "copy_keys"])

    return chosen.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS) + ", copy_keys array<long>")


def _ratio(rule: str) -> Column:
    """The rule's ratio in whole steps of the grid, rounded up: above a cutoff if it is more steps than the cutoff."""
    a, b = RULES[rule]
    return F.when(F.col(b) > 0, F.ceil(F.lit(GRID) * F.col(a) / F.col(b))).otherwise(0).cast("int")


def binomial_upper(k: int, n: int, error: float) -> float:
    """The exact upper confidence bound on a probability after k of n: the p at which at most k has probability ``error``."""
    if k >= n:
        return 1.0
    choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(choose)) if p < 1 else 0.0
        low, high = (p, high) if tail > error else (low, p)
    return high


def trials(labelled: DataFrame) -> DataFrame:
    """One row of each group of copies among labelled rows (doc_id, copy_keys, ...), that with the least id, without the keys."""
    keyed = labelled.select("doc_id", F.explode("copy_keys").alias("key"))
    least = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").select("key", "least"))
    linked = keyed.join(small(least, least.count()), "key").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    groups = components(linked)
    of = labelled.join(small(groups, groups.count()), labelled["doc_id"] == groups["node"], "left").withColumn("group", F.coalesce("component", "doc_id"))
    columns = [c for c in labelled.columns if c != "copy_keys"]
    first = of.groupBy("group").agg(F.min(F.struct("doc_id", *[c for c in columns if c != "doc_id"])).alias("first"))
    return first.select(*[f"first.{c}" for c in columns])


def fit(measured: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", quality: str = "quality", risk: float = RISK, error: float = ERROR) -> dict[str | None, dict[str, int]]:
    """For each stratum the accepted cutoffs by rule, in steps of the grid; {} where no set was accepted.

    All labelled documents that pass the base rules count, copies of each other
    as one. Rows with a null id or label are left out; a document labelled twice
    counts with its lower label. Only counts by stratum, rule and step of the
    grid come to the driver.
    """
    known = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(quality).alias("good"))
    half = F.pmod(F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string")).cast("binary")), F.lit(2))
    labelled = cut(measured.where(~base_failed()).join(known, "doc_id").select("doc_id", "stratum", "good", "copy_keys", *[_ratio(r).alias(r) for r in RULES]))
    labelled = cut(trials(labelled).withColumn("half", half))

    long = labelled.where("half = 0 AND good = 1").select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("x"))
    tally: dict[tuple[str | None, str], dict[int, int]] = {}
    for r in long.groupBy("stratum", "x.rule", "x.step").count().collect():
        tally.setdefault((r["stratum"], r["rule"]), {})[r["step"]] = r["count"]

    def cutoff(steps: dict[int, int], level: float) -> int:
        """The least cutoff that rejects at most this share of the proposing half's good documents."""
        allowed, over = level * sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            over += steps[step]
            if over > allowed:
                return step
        return 0

    def rejects(cutoffs: dict[str, int]) -> Column:
        return F.greatest(*[F.col(r) > c for r, c in cutoffs.items()])

    def by_stratum(of: dict[str | None, Column]) -> Column:
        return F.coalesce(*[F.when(F.col("stratum").eqNullSafe(F.lit(s)), x) for s, x in of.items()], F.lit(False))

    last = {s: dict.fromkeys(RULES, GRID) for s, _ in tally}  # rejects none
    sets: dict[str | None, list[dict[str, int]]] = {s: [] for s in last}
    if not sets:
        return {}
    bad = labelled.where("half = 0 AND good <> 1")
    for level in LEVELS:
        stricter = {s: {r: min(now[r], cutoff(tally[s, r], level)) for r in RULES} for s, now in last.items()}
        kept = by_stratum({s: ~rejects(now) for s, now in last.items()})
        more = [F.count_if(kept & by_stratum({s: F.col(r) > x[r] for s, x in stricter.items()})).alias(r) for r in RULES]
        rows = bad.groupBy("stratum").agg(F.count_if(kept).alias("left"), *more).collect()
        if not any(row["left"] for row in rows):
            break
        for row in rows:
            for r in sorted(RULES, key=lambda r: -row[r]):  # noqa: B023
                if row[r]:
                    s = row["stratum"]
                    last[s] = last[s] | {r: stricter[s][r]}
                    sets[s].append(last[s])
    if not any(sets.values()):
        return {s: {} for s in sets}

    tests = [F.count_if(by_stratum({s: rejects(x[i]) for s, x in sets.items() if i < len(x)})).alias(f"k{i}") for i in range(max(map(len, sets.values())))]
    chosen: dict[str | None, dict[str, int]] = {s: {} for s in sets}
    for row in labelled.where("half = 1 AND good = 1").groupBy("stratum").agg(F.count("*").alias("n"), *tests).collect():
        for i, cutoffs in enumerate(sets.get(row["stratum"], [])):
            if binomial_upper(row[f"k{i}"], row["n"], error / len(sets)) > risk:
                break
            chosen[row["stratum"]] = cutoffs
    return chosen


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(cutoffs: dict[str | None, dict[str, int]]) -> Column:
    """True for measured rows that neither the base rules nor their stratum's cutoffs reject."""
    over = [F.when(F.col("stratum").eqNullSafe(F.lit(s)), F.greatest(*[_ratio(r) > c for r, c in x.items()])) for s, x in cutoffs.items() if x]
    return ~base_failed() & ~F.coalesce(*over, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """doc_id, stratum, counts, base_failed and kept for each document.

    Null and empty texts fail the base rules; repeated rows are judged alike;
    no documents give no rows, no labels leave the base rules alone; other
    columns are not read.
    """
    measured = cut(measure(docs, **names))
    cutoffs = fit(measured, labels)
    return measured.drop("copy_keys").withColumns({"base_failed": base_failed(), "kept": verdict(cutoffs)})


def keep(docs: DataFrame, cutoffs: dict[str | None, dict[str, int]], *, text: str = "text", stratum: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns, without a shuffle.

    Null and empty texts go, by the base rules; repeated rows are treated
    alike; a null stratum is one of its own; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _counted(b[text])
            steps = {r: np.where(c[d] > 0, -(-GRID * c[n] // np.maximum(c[d], 1)), 0) for r, (n, d) in RULES.items()}
            ok = (c["n_words"] >= 10) & (100 * c["n_repeat_words"] <= 20 * c["n_words"])
            strata = np.array(b[stratum].cast(pa.string()).to_pylist(), object)
            for s, x in cutoffs.items():
                for r, most in x.items():
                    ok &= ~((strata == s) & (steps[r] > most))
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)

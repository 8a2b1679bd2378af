"""Time-varying curriculum: which words of which source come when in training.

Each source has a share of the training stream at each knot of training time
(0 to 1), linear in between. The integral of that share is the source's
cumulative demand for words; inverting it turns a place in the source's own
stream of documents into a place in training. A source's stream repeats its
documents, in a fixed pseudo-random order, until its demand is met; the last
copy may be cut, so that the words taken match the demand.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, n_words, small


def capped_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str | None, float]:
    """Words of each source by weight, none above ``most`` times its size, the excess shared again by weight.

    Sources by code point, null last, take the weights in turn. One entry a source: this is small.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    out: dict[str | None, float] = {}
    free = list(order)
    while free:
        rest = total - sum(most * sizes[s] for s in order if s in out)
        shares = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rest > most * sizes[s] * shares]
        if not over:
            return out | {s: float(rest) / shares * weight[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        free = [s for s in free if s not in out]
    return out


def drifting_shares(sizes: dict[str | None, int], targets: dict[str | None, float]) -> list[tuple[float, dict[str | None, float]]]:
    """Two knots: training begins nearer to the sources' natural shares and ends as far on the other side of their targets."""
    natural, total = sum(sizes.values()) or 1, sum(targets.values()) or 1.0
    away = {s: sizes[s] / natural - targets[s] / total for s in sizes}
    step = min([1.0, *(targets[s] / total / abs(away[s]) for s in sizes if away[s])])
    return [(t, {s: targets[s] / total + sign * step * away[s] for s in sizes}) for t, sign in ((0.0, 1), (1.0, -1))]


def integrated(knots: list[tuple[float, dict[str | None, float]]], words: float) -> dict[str | None, list[tuple[float, ...]]]:
    """For each source its pieces (t0, length, share at t0, slope / 2, demand before t0)."""
    out: dict[str | None, list[tuple[float, ...]]] = {s: [] for s in knots[0][1]}
    for s, pieces in out.items():
        before = 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
            pieces.append((t0, t1 - t0, a[s], (b[s] - a[s]) / (2 * (t1 - t0)), before))
            before += words * (t1 - t0) * (a[s] + b[s]) / 2
    return out


def curriculum(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a document: size, source_size, target, taken, and ``positions`` in training, one for each copy taken.

    Null texts have no words and are never taken; a null source is a source of
    its own, last in order; repeated rows count as documents of their own; an
    empty table gives no rows. Only the three named columns are read, so others
    may have any name.

    Places within a source are found by two-level prefix sums, over about the
    square root of all rows in each level, so that a source with a third of all
    rows is no single task.
    """
    base = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("h"), F.xxhash64(F.col(text)).alias("x")))
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()  # one row a source
    sizes = {r["source"]: r["size"] for r in found}
    targets = capped_targets(sizes, weights, most)
    words = sum(targets.values())
    pieces = integrated(drifting_shares(sizes, targets), words) if sizes else {}
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = [("" if s is None else f"={s}", sizes[s], targets[s], math.floor(targets[s] + 0.5), pieces[s]) for s in sizes]
    plan = docs.sparkSession.createDataFrame(rows, "key string, source_size long, target double, whole long, pieces array<struct<t0:double,length:double,share:double,bend:double,before:double>>")

    digits = max(1, math.ceil(math.log2(max(2, sum(r["rows"] for r in found))) / 8))  # of the hash, 16 ** digits buckets a source
    placed = base.withColumn("key", key).withColumn("bucket", F.substring("h", 1, digits))
    within = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy("key", "bucket").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("key", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    placed = placed.withColumn("at", F.sum("size").over(within) - F.col("size")).join(before, ["key", "bucket"]).withColumn("at", F.col("at") + F.col("before"))

    mixed = placed.join(small(plan, len(rows)), "key")
    copies = F.when((F.col("size") > 0) & (F.col("whole") > F.col("at")), F.ceil((F.col("whole") - F.col("at")) / F.col("source_size"))).otherwise(0).cast("long")
    mixed = mixed.withColumn("copies", copies)
    last = F.least("size", F.col("whole") - (F.col("copies") - 1) * F.col("source_size") - F.col("at"))
    taken = F.when(F.col("copies") > 0, (F.col("copies") - 1) * F.col("size") + last).otherwise(0)

    def position(k):
        y = (k * F.col("source_size") + F.col("at")).cast("double")
        piece = F.element_at(F.filter("pieces", lambda p: p["before"] <= y), -1)
        need = (y - piece["before"]) / F.lit(max(words, 1.0))
        root = F.sqrt(F.greatest(piece["share"] * piece["share"] + F.lit(4.0) * piece["bend"] * need, F.lit(0.0)))
        return F.when(need <= 0, piece["t0"]).otherwise(piece["t0"] + F.lit(2.0) * need / (piece["share"] + root))

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), positions.alias("positions"), "x")


def in_training_order(docs: DataFrame, mixed: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' own columns, one row for each copy taken, range-sorted by position in training.

    A last copy that is cut has its first words, joined by spaces. Rows find
    their places by id and text, null ids and texts like others; of rows equal
    in both any may stand for the other. Ties in position go by id and copy.
    Texts without words are never taken, and no rows give no rows.
    """
    key, check = F.xxhash64("id", "x"), F.hash("id", "x")
    every = cut(mixed.select(F.col("doc_id").alias("id"), "x", "size", "taken", "positions").withColumns({"key": key, "check": check}))
    places = every.where("taken > 0")
    whole = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("x"), F.struct(*docs.columns).alias("row")).withColumns({"key": key, "check": check})
    if every.groupBy("key", "check").count().where("count > 1").isEmpty():  # texts need no shuffle to be numbered, nor to be joined with few places
        rows, same = places.count(), whole["key"] == places["key"]
        places = small(places, rows)
    else:  # one key for numbering and joining, so that texts are shuffled once for both; equal keys are told apart by another hash
        n = F.row_number().over(Window.partitionBy("key").orderBy("id", "x"))
        whole, places = whole.withColumn("n", n), places.withColumn("n", n)
        same = (whole["key"] == places["key"]) & (whole["n"] - places["n"] == 0)
    copies = whole.join(places, same & (whole["check"] - places["check"] == 0)).select("row", "size", "taken", F.posexplode("positions").alias("k", "position"))
    left = F.least("size", F.col("taken") - F.col("k") * F.col("size"))
    full = F.col("row")[text]
    part = F.when(left >= F.col("size"), full).otherwise(F.array_join(F.slice(F.regexp_extract_all(full, F.lit(WORD), F.lit(0)), 1, left.cast("int")), " "))
    ordered = copies.withColumn("part", part).orderBy("position", F.col("row")[doc_id], "k")
    return ordered.select(*[(F.col("part") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])

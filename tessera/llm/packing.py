"""Packing of tokenised documents into sequences as a cutting-stock problem.

A document's tokens are cut at multiples of the sequence length; what is left
over at its end is an item. Item lengths, rounded up to a grid, make a
histogram of bounded size, which is all that the driver sees. A linear program
over patterns (which lengths share a sequence) covers the histogram with as few
sequences as possible; new patterns are priced by a knapsack dynamic program
until none improves it (column generation). Patterns are used a whole number of
times; the few items left over are packed best-fit. Documents, ranked within
their length by distributed prefix sums, take the patterns' places in order.

Documents that come in an order, as in training, keep it: the order is cut into
bands, each with a histogram and patterns of its own, and in a band the
patterns take turns, so that documents of all lengths proceed together.
Sequences are numbered along the order.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Tokens of a sequence, and the grid on which lengths are compared.
LENGTH, GRID = 2048, 8
#: Column generation ends when its bound shows at most this share of sequences more than the program's least.
GAP = 1e-3
#: Ranges of the documents' order that are ranked on their own at most; bands of it with their own patterns at most,
#: the sequences that a band's pieces fill at least, and turns of a band's patterns.
RANGES, BANDS, BAND, TURNS = 1024, 16, 128, 8
#: The id that ends a document.
END = 1
#: What is told of a piece.
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
#: The tokenizer's file, and the same vocabulary as ranks, which encodes faster.
VOCABULARY, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
#: Texts with none of these have the same ids by either file: letters outside Latin and rare spaces may be classed by other Unicode tables, and special tokens be read as such.
_UNUSUAL = re.compile(r"[^\t\n\r -~¡-ɏ‐-…€]|<\||[\t\n\r ]{500}")


@cache
def _encoders(vocabulary: str, ranks: str):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), Tokenizer.from_file(vocabulary)


def token_ids(text: str, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> np.ndarray:
    """The ids of the tokenizer in ``vocabulary`` without special tokens, then END."""
    fast, full = _encoders(vocabulary, ranks)
    ids = full.encode(text, add_special_tokens=False).ids if _UNUSUAL.search(text) else fast.encode_ordinary(text)
    return np.array([*ids, END], "<u4")


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: Column | None = None, length: int = LENGTH, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, place) of the pieces of each document, cut at multiples of ``length``.

    ``place`` is the document's ``order``, a number; without one, documents are in the order of a hash of their pieces.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.lit(None) if order is None else order).cast("long").alias("place"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for d, text in enumerate(b["text"]):
                ids = token_ids(text.as_py() or "", vocabulary, ranks)
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    for column, x in zip(rows, (d, start, len(part), zlib.crc32(part), len(ids)), strict=True):
                        column.append(x)
            of = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(of), *(pa.array(x, pa.int64()) for x in rows[1:]), b["place"].take(of)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    found = chosen.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, place long")
    return found if order is not None else found.withColumn("place", F.xxhash64("doc_id", "start"))


def best_pattern(value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """How many of each item to take, for the greatest value within ``room`` (unbounded knapsack by dynamic programming); sizes ascend."""
    order = size.tolist()
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    for r in range(1, room + 1):
        k = bisect_right(order, r)  # sizes ascend
        best[r] = best[r - 1]
        if k:
            gain = best[r - size[:k]] + value[:k]
            i = int(gain.argmax())
            if gain[i] > best[r] + 1e-12:
                best[r], took[r] = gain[i], i
    out = np.zeros(len(size))
    r = room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            out[took[r]] += 1
            r -= size[took[r]]
    return out


class Pool:
    """Patterns found so far, for programs that come after with other numbers of the same sizes: trying them is cheaper than pricing new ones."""

    def __init__(self, room: int) -> None:
        self.count, self.rows = 0, np.zeros((64, room + 1))

    def add(self, size: np.ndarray, pattern: np.ndarray) -> None:
        if self.count == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.count, size] = pattern
        self.count += 1

    def of(self, size: np.ndarray) -> np.ndarray:
        """The patterns without the sizes that aren't there."""
        return np.ascontiguousarray(self.rows[: self.count, size])


def cutting_stock(sizes: list[int], demand: list[int], room: int, pool: Pool | None = None) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: number} and how often each is used; together they hold every item. Sizes are distinct, at most ``room``."""
    if not sizes:
        return []
    size, need = np.array(sizes), np.array(demand, float)
    m = len(size)
    columns = np.diag((room // size).astype(float))  # one column a basic variable; a surplus has cost 0
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.diag(columns))
    known = pool.of(size) if pool else np.zeros((0, m))
    for _ in range(50 * m + 100):
        dual = cost @ inverse
        if dual.min() < -1e-9:
            new, price = -(np.arange(m) == dual.argmin()).astype(float), 0.0
        elif len(known) and (worth := known @ dual).max() > 1 + 2 * GAP:
            new, price = known[worth.argmax()], 1.0
        else:
            new, price = best_pattern(np.maximum(dual, 0), size, room), 1.0
            if dual @ new <= 1 + GAP:  # no cover has less than 1 / (dual @ new) of this one's sequences
                break
            if pool:
                pool.add(size, new)
                known = np.concatenate([known, new[None]])
        x, way = inverse @ need, inverse @ new
        ratio = np.where(way > 1e-9, np.maximum(x, 0) / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out], cost[out] = new, price
        row = inverse[out] / way[out]
        inverse -= way[:, None] * row
        inverse[out] = row
    used = np.where(cost > 0, np.maximum(np.floor(inverse @ need + 1e-6), 0), 0).astype(np.int64)  # what rounding errors leave is counted exactly below
    chosen = [({int(size[i]): int(columns[i, p]) for i in range(m) if columns[i, p] > 0}, int(used[p])) for p in range(m) if used[p] > 0]
    left = [int(d) - sum(pattern.get(int(s), 0) * times for pattern, times in chosen) for s, d in zip(size, demand, strict=True)]
    rounded = chosen + _best_fit({int(s): n for s, n in zip(size, left, strict=True) if n > 0}, room)
    plain = _best_fit({int(s): int(n) for s, n in zip(size, demand, strict=True)}, room)  # with few items rounding may cost more than patterns save
    return min(rounded, plain, key=lambda x: sum(times for _, times in x))


def _best_fit(left: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """The items that rounding leaves, a few for each pattern, the largest first, each sequence filled with the largest that still fit."""
    out: list[tuple[dict[int, int], int]] = []
    left = dict(left)
    while left:
        pattern: dict[int, int] = {}
        free = room
        while fitting := [s for s in left if s <= free]:
            s = max(fitting)
            k = min(left[s], free // s)
            pattern[s] = pattern.get(s, 0) + k
            free -= k * s
            left[s] -= k
            if not left[s]:
                del left[s]
        times = 1 + min([left.get(s, 0) // k for s, k in pattern.items()])
        for s, k in pattern.items():
            if s in left:
                left[s] -= k * (times - 1)
                if not left[s]:
                    del left[s]
        out.append((pattern, times))
    return out


class Plan:
    """Which sequence the piece of a class and rank goes to, for all bands: blocks (first rank, pieces a sequence, first sequence, place in it)."""

    def __init__(self, demand: dict[tuple[int, int], int], room: int, turns: int) -> None:
        blocks: list[tuple[int, int, int, int]] = []
        sequence = 0
        self.classes = room + 1
        pool = Pool(room)
        for band in sorted({b for b, _ in demand}):
            need = {c: n for (b, c), n in sorted(demand.items()) if b == band}
            patterns = cutting_stock(list(need), list(need.values()), room, pool)
            filled = dict.fromkeys(need, 0)
            for turn in range(turns):
                for pattern, times in patterns:
                    times = times * (turn + 1) // turns - times * turn // turns
                    if times:
                        for place, (c, k) in enumerate(sorted(pattern.items(), reverse=True)):
                            blocks.append((self.key(band, c, filled[c]), k, sequence, place))
                            filled[c] += k * times
                        sequence += times
        self.first, self.each, self.sequence, self.place = (np.array(x, np.int64) for x in zip(*sorted(blocks), strict=True)) if blocks else (np.zeros(0, np.int64),) * 4

    def key(self, band, c, rank):
        """One number in the order of band, class and rank."""
        return (band * self.classes + c << 44) + rank

    def find(self, band: np.ndarray, c: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place in it) of pieces by their rank among those of a band and class."""
        key = self.key(band, c, rank)
        at = np.searchsorted(self.first, key, "right") - 1
        return self.sequence[at] + (key - self.first[at]) // self.each[at], self.place[at]


def bundled(short: DataFrame, width: int) -> DataFrame:
    """Short pieces (band, bucket, place, ...) with the number of their bundle in the band, and their place in the band's stretch of them.

    A bundle is the pieces that begin within ``width`` tokens of the stretch, so
    that it is less than a piece longer than that.
    """
    inside = Window.partitionBy("bucket").orderBy("place", *PIECE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = short.groupBy("band", "bucket").agg(F.sum("length").alias("sum"))
    before = sums.select("bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))  # at most RANGES rows
    found = short.withColumn("inside", F.sum("length").over(inside) - F.col("length")).join(F.broadcast(before), "bucket")
    return found.withColumn("inside", F.col("inside") + F.col("before")).withColumn("bundle", F.floor(F.col("inside") / width)).drop("before")


def pack(cut_pieces: DataFrame, *, ordered: bool = False, length: int = LENGTH, grid: int = GRID) -> DataFrame:
    """The pieces with their sequence_id and offset; if ``ordered``, sequence_id rises along ``place``, band by band.

    Pieces of at most a thirty-second of a sequence go in bundles, as items of
    their joint length, so that rounding up to the grid costs little. Pieces of
    equal length and content may stand for each other; no pieces give no rows.
    The driver sees a number for each band and length on the grid.
    """
    total, tokens = cut_pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    ranges = min(RANGES, max(1, math.isqrt(total)))
    cuts = np.array((cut_pieces.agg(F.percentile_approx("place", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10_000)).alias("c")).first()["c"] if ranges > 1 else None) or [], np.int64)
    bands = min(BANDS, max(1, tokens // (BAND * length))) if ordered else 1

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = np.searchsorted(cuts, b["place"].to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket.astype(np.int32)), pa.array((bucket * bands // ranges).astype(np.int32))], [*b.schema.names, "bucket", "band"])

    divided = cut_pieces.mapInArrow(divide, T.StructType([*cut_pieces.schema, T.StructField("bucket", T.IntegerType()), T.StructField("band", T.IntegerType())]))
    few = F.col("length") <= length // 32
    members = cut(bundled(divided.where(few), max(1, length // 8 - grid // 2)).select(*PIECE, "band", "bucket", "place", "bundle", "inside"))
    bundles = members.groupBy("band", "bundle").agg(F.sum("length").alias("length"), F.min(F.struct("bucket", "place")).alias("first")).select("band", "bundle", "length", "first.bucket", "first.place")
    items = divided.where(~few).unionByName(bundles, allowMissingColumns=True).withColumn("class", F.ceil(F.col("length") / grid).cast("int"))
    counts = cut(items.groupBy("band", "class", "bucket").agg(F.count("*").alias("n")))
    demand = {(r["band"], r["class"]): r["n"] for r in counts.groupBy("band", "class").agg(F.sum("n").alias("n")).collect()}  # at most BANDS * length / grid rows
    plan = Plan(demand, length // grid, TURNS if ordered else 1)

    within = Window.partitionBy("class", "bucket").orderBy("place", "bundle", *PIECE)
    earlier = Window.partitionBy("band", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    before = counts.select("class", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = items.withColumn("n", F.row_number().over(within) - 1).join(before, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("n"))
    named = [*PIECE, "band", "bundle", "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, at = plan.find(*(b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "class", "rank")))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in named), pa.array(sequence), pa.array(at)], [*named, "sequence_id", "at"])

    kind = cut_pieces.schema["doc_id"].dataType.simpleString()
    placed = cut(ranked.select(*named, "class").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, band int, bundle long, rank long, sequence_id long, at long"))
    own = [*PIECE, "sequence_id", "at", "rank"]
    inner = members.select(*PIECE, "band", "bundle", "inside").join(placed.where("bundle IS NOT NULL").select("band", "bundle", "sequence_id", "at", "rank"), ["band", "bundle"])
    every = placed.where("bundle IS NULL").select(*own, F.lit(0).cast("long").alias("inside")).union(inner.select(*own, "inside"))
    inside = Window.partitionBy("sequence_id").orderBy("at", "rank", "inside").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``length`` rows
    return every.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(*PIECE, "sequence_id", "offset")


def packed(docs: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their places, along ``order`` if it is given.

    Null and empty texts are one END token; long texts are cut into pieces;
    repeated rows are documents of their own, and where they are alike in all
    that is returned, may stand for each other; no documents give no rows;
    other columns are not read.
    """
    return pack(cut(pieces(docs, **options)), ordered=options.get("order") is not None, length=options.get("length", LENGTH))

"""Jaccard self-join of documents on word n-grams, by vertical partitioning.

The global order of n-grams is cut into fragments, the overlaps of two
documents are counted in each fragment on its own, and summed for the pair.

Steps (x, y are classes of documents with equal sets; n is a set's size):

1.  Of the order of hashes, the first fragments (``LONE_SHARE`` of all
    n-grams) show how many n-grams of x no other class has. If these alone
    are more than x may miss for any link, x has no link. This leaves the
    members of groups of near copies, whatever passages others share.
2.  For these the sets are made in full, ordered from rare to frequent.
    N-grams that only one has count as missing; of the rest, linked sets must
    share one among the rarest few (prefix filter).
3.  In the bucket of such an n-gram, all are compared with one leader, the one
    with the least missing. Overlaps are summed over fragments.
4.  Members whose link joins them to the leader's component need no further
    comparison with each other. Those left over are compared with the members
    of other components, unless their sizes, their missing n-grams, what each
    shares with the leader, or their parities leave too little for a link: of
    each of ``PARITIES`` parts of the order, whether the set has an odd number
    of n-grams there. Sets differ in at least as many n-grams as parities.

So a group of near copies costs comparisons in proportion to its size, documents
of the same common passages are hardly ever compared, and no link between
components is lost. 64-bit fingerprints stand for n-grams and sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _WORDS, Texts, cut, lists, mix, signed, slices, small, unused
from .components import components

#: Words of an n-gram; a link needs 100 * intersection >= PERCENT * union.
N, PERCENT = 5, 80
#: Step 1 looks at the n-grams whose hash is in the first so many sixteenths: clearly more than a set may miss.
LONE_SHARE = 5
#: Fragments of the order in which overlaps are counted, and parts of the order whose parities are compared first.
FRAGMENTS, PARITIES = 8, 1024


class Links(NamedTuple):
    """(doc_id, text_hash, n_shingles, cls) of each row, (a, b, shared) of the linked classes that were compared, (cls, component), and (a, b) of all that were compared."""

    members: DataFrame
    pairs: DataFrame
    labels: DataFrame
    compared: DataFrame


def shingles(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes, and where each text's begin. A shorter text has itself as one."""
    words = t.word_hashes(lower=True)
    h, at = t.windows(n, hashes=words)
    count = np.diff(t.at)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        one = _WORDS[0].stretches(words, t.at[short], t.at[short] + count[short])
        h = np.insert(h, at[short], one)
        at = np.r_[0, np.cumsum(np.where((count > 0) & (count < n), 1, np.diff(at)))]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][at[:-1] < len(h)]] = True
    sums = np.r_[0, np.cumsum(new)]
    return h[new], sums[at]


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A fingerprint of each set, whatever its order."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ (np.diff(at).astype(np.uint64) << np.uint64(40)))


def parities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each set has an odd number of n-grams in each part of the order, as bits of 64-bit numbers."""
    n = len(at) - 1
    part = np.repeat(np.arange(n) * PARITIES, np.diff(at)) + (h >> np.uint64(65 - PARITIES.bit_length())).astype(np.int64)
    odd = (np.bincount(part, minlength=n * PARITIES) & 1).astype(bool).reshape(n, PARITIES)
    return np.packbits(odd, axis=1, bitorder="little").view("<u8")


def _scan(docs: DataFrame, keep: list[str], schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b["text"]):
                h, at = shingles(t, N)
                yield make(h, at, [b[c].slice(t.first, len(t)) for c in keep])

    return docs.mapInArrow(run, schema)


def links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Links:
    """All links between documents, by classes and components.

    Empty and null texts have n_shingles 0 and cls null. Rows with equal sets,
    repeated rows too, are one class. Only the two named columns are read.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def stats(h, at, own):
        n = np.diff(at)
        return pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(signed(set_keys(h, at)), mask=n == 0)], ["doc_id", "text_hash", "n_shingles", "cls"])

    def first_fragments(h, at, _):
        cls = np.repeat(signed(set_keys(h, at)), np.diff(at))
        low = h < np.uint64(LONE_SHARE << 60)
        return pa.RecordBatch.from_arrays([pa.array(signed(h[low])), pa.array(cls[low])], ["h", "cls"])

    def whole_sets(h, at, _):
        odd = parities(h, at)
        return pa.RecordBatch.from_arrays([pa.array(signed(set_keys(h, at))), lists(signed(h), np.diff(at)), lists(signed(odd.ravel()), np.full(len(odd), odd.shape[1]))], ["cls", "hs", "odd"])

    members = cut(_scan(chosen.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"], f"doc_id {kind}, text_hash long, n_shingles long, cls long", stats))
    classes = members.where("cls IS NOT NULL").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("rep"))

    # 1: n-grams of a single class
    low = _scan(chosen.select("text"), [], "h long, cls long", first_fragments)
    lone = low.groupBy("h").agg(F.min("cls").alias("cls"), F.max("cls").alias("other")).where("cls = other").groupBy("cls").agg(F.count("*").alias("lone"))
    able = cut(classes.join(lone, "cls", "left").where(f"100 * coalesce(lone, 0) <= {100 - PERCENT} * n").select("cls", "n", "rep"), sweep=True)

    # 2: whole sets of the rest, in order of frequency
    rows = able.count()
    reps = able.select(F.coalesce(F.col("rep").cast("string"), F.lit("")).alias("id")).distinct()
    texts = chosen.join(small(reps, rows), F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == F.col("id"), "left_semi").select("text")
    sets = cut(_scan(texts, [], "cls long, hs array<long>, odd array<long>", whole_sets).join(small(able.select("cls", "n"), rows), "cls").dropDuplicates(["cls"]), sweep=True)
    tokens = sets.select("cls", F.explode("hs").alias("h"))
    shared = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(shared, "h").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("common"))  # as long as one text
    may_miss = F.floor(F.col("n") * (100 - PERCENT) / 100)
    known = cut(ordered.join(sets.select("cls", "n"), "cls").withColumn("miss", F.col("n") - F.size("common")).where(F.col("miss") <= may_miss), sweep=True)
    prefix = cut(known.select("cls", "n", "miss", F.explode(F.slice(F.col("common.h"), 1, (may_miss - F.col("miss") + 1).cast("int"))).alias("h")))

    def fragment(f: int) -> Column:
        inside = F.filter(F.col("common.h"), lambda x: F.shiftrightunsigned(x, 65 - FRAGMENTS.bit_length()) == f)
        return F.struct(F.lit(f).alias("f"), inside.alias("part"))

    segments = known.select("cls", F.explode(F.array(*map(fragment, range(FRAGMENTS)))).alias("s")).select("cls", "s.f", "s.part")

    def overlaps(pairs: DataFrame) -> DataFrame:
        """(a, b, shared, total) of pairs (a, b, total), the overlaps summed over fragments."""
        parts = pairs.join(segments.select(F.col("cls").alias("a"), "f", F.col("part").alias("x")), "a").join(segments.select(F.col("cls").alias("b"), "f", F.col("part").alias("y")), ["b", "f"])
        return parts.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("shared"), F.first("total").alias("total"))

    def most(a: str, b: str) -> Column:
        """The largest intersection that the missing n-grams leave."""
        return F.least(F.col(f"{a}.n") - F.col(f"{a}.miss"), F.col(f"{b}.n") - F.col(f"{b}.miss"))

    def total(a: str, b: str) -> Column:
        return F.col(f"{a}.n") + F.col(f"{b}.n")

    linked = (100 + PERCENT) * F.col("shared") >= PERCENT * F.col("total")

    # 3: everyone in a bucket with its leader
    lead = prefix.groupBy("h").agg(F.min(F.struct((F.col("miss") / F.col("n")).alias("part"), "cls", "n", "miss")).alias("l")).select("h", "l.cls", "l.n", "l.miss")
    led = cut(prefix.alias("x").join(lead.alias("l"), "h").select("h", F.col("x.cls").alias("cls"), F.col("x.n").alias("n"), F.col("x.miss").alias("miss"), F.col("l.cls").alias("lead"), most("x", "l").alias("most"), total("x", "l").alias("total")))
    first = led.where(F.col("cls") != F.col("lead")).where((100 + PERCENT) * F.col("most") >= PERCENT * F.col("total"))
    first = cut(overlaps(first.select(F.col("cls").alias("a"), F.col("lead").alias("b"), "total").distinct()), sweep=True)
    labels = components(first.where(linked).select("a", "b"))

    # 4: those that no leader's component has, with the others
    def labelled(df: DataFrame, of: str, name: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(of), F.col("component").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))

    known_shared = first.select(F.col("a").alias("cls"), F.col("b").alias("lead"), F.col("shared").alias("with_lead"))
    spread = led.where(F.col("cls") != F.col("lead")).join(known_shared, ["cls", "lead"], "left")
    spread = cut(labelled(labelled(spread, "cls", "own"), "lead", "led_by").select("h", "cls", "n", "miss", "with_lead", "own", (F.col("own") != F.col("led_by")).alias("out")))
    left_over = cut(spread.where("out").select("h").distinct())  # buckets with a member left over
    odd = sets.select("cls", *[F.col("odd")[i].alias(f"odd{i}") for i in range(PARITIES // 64)])
    spread = cut(spread.join(small(left_over, left_over.count()), "h", "left_semi").join(odd, "cls"), sweep=True)

    def inside(x: str) -> Column:
        return F.col(f"{x}.with_lead")

    def outside(x: str) -> Column:
        """Of x's n-grams that the leader hasn't, those that others have."""
        return F.col(f"{x}.n") - F.col(f"{x}.with_lead") - F.col(f"{x}.miss")

    loose = F.least(inside("x"), inside("y")) + F.least(outside("x"), outside("y"))
    enough = lambda i: (100 + PERCENT) * i >= PERCENT * total("x", "y")
    differ = sum((F.bit_count(F.col(f"x.odd{i}").bitwiseXOR(F.col(f"y.odd{i}"))) for i in range(PARITIES // 64)), F.lit(0))
    possible = ((100 + PERCENT) * differ <= (100 - PERCENT) * total("x", "y")) & F.when(inside("x").isNotNull() & inside("y").isNotNull(), enough(loose)).otherwise(enough(most("x", "y")))
    second = spread.where("out").alias("x").join(spread.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.own") != F.col("y.own")) & (~F.col("y.out") | (F.col("x.cls") < F.col("y.cls"))) & possible)
    second = second.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), total("x", "y").alias("total")).distinct()
    second = cut(overlaps(second))
    pairs = first.where(linked).select("a", "b", "shared").union(second.where(linked).select("a", "b", "shared"))
    compared = first.select("a", "b").union(second.select("a", "b"))
    more = second.where(linked).select("a", "b")
    if more.isEmpty():
        return Links(members, pairs, labels.select(F.col("node").alias("cls"), "component"), compared)
    return Links(members, pairs, components(pairs.select("a", "b")).select(F.col("node").alias("cls"), "component"), compared)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs; component_id is the least id that links lead to.

    Texts without words are components of their own; so are rows whose id is
    null unless linked. Repeated rows and ties are one class and get equal
    values; long texts count whole; an empty table gives no rows; other columns
    are not read.
    """
    members, _, labels, _ = links(docs, doc_id=doc_id, text=text)
    known = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    groups = known.join(labels, "cls", "left").where("rows > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "cls"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    of = groups.select("cls", "component").join(least, "component").select("cls", "component_id")
    return members.join(of, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that with the least id, of equal ids the least text hash.

    Rows without an id come last. Documents are told apart by id and text, so a
    text that is like no other stays whatever its id. Rows without words are
    like no other. Of rows that repeat id and text one stays, that whose other
    columns hash lowest. No rows give no rows. Texts are shuffled only if the
    rows that go are too many to be broadcast.
    """
    members, _, labels, _ = links(docs, doc_id=doc_id, text=text)
    found = cut(members.join(labels, "cls", "left").select("doc_id", "text_hash", F.coalesce("component", "cls").alias("component")))
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first"), F.count("*").alias("rows"))
    first = cut(first.where("rows > 1").select("component", "first"))  # so that a large component is no single task where they are few
    gone = found.join(small(first, first.count()), "component").where("NOT (doc_id <=> first.doc_id AND text_hash = first.text_hash)")
    key, seen = unused(docs, "id"), unused(docs, "seen")

    def among(rows: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        pairs = pairs.select(F.col("doc_id").alias(key), F.col("text_hash").alias(seen))
        return rows.join(small(pairs, pairs.count()), rows[doc_id].eqNullSafe(F.col(key)) & (F.xxhash64(rows[text]) == F.col(seen)), how)

    stay = among(docs, cut(gone.select("doc_id", "text_hash").distinct()), "left_anti")
    again = cut(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1"))
    if again.isEmpty():
        return stay
    lowest = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")])
    one = among(stay, again, "left_semi").groupBy(F.col(doc_id).alias(key), F.xxhash64(text).alias(seen)).agg(F.min_by(F.struct(*docs.columns), lowest).alias("row"))
    return among(stay, again, "left_anti").unionByName(one.select("row.*"))

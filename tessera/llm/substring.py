"""Exact removal of repeated passages by a compacted de Bruijn graph of words.

Windows of ``WINDOW`` words are the edges of a de Bruijn graph. A window's
minimizer, the least hash of the shorter stretches of ``STEP`` words in it,
cuts each text into paths of consecutive windows with one minimizer place
(super-k-mers). Equal windows have equal minimizers, so only paths whose
minimizer is found at two places can hold a repeated edge; the others are
never looked at again.

Paths with the same words are compacted into one node by a join, which knows
its source: the first place (document, word) of all. Any later place repeats
it as a whole. Only the windows of sources, one path for each node, are
compared one by one, and only where nodes share a minimizer: paths of different
length, at the ends of a shared passage, can still share windows. Two independent 64-bit fingerprints and the
place in the source verify each repeat; adjoining repeats from adjoining places
of one source make up the long spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _WORDS, WORD, Texts, cut, signed, slices, small

#: Words of a window, and of the stretches of which the least marks it.
WINDOW, STEP = 20, 6
#: Order of rows without an id: after all others.
LAST = (1 << 63) - 1


def paths(t: Texts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each path: its text, first word (counted in the slice), number of windows, and minimizer."""
    h, at = t.windows(STEP, hashes=hashes)
    span = WINDOW - STEP + 1
    if len(h) < span:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    least = np.lib.stride_tricks.sliding_window_view(h, span).argmin(1) + np.arange(len(h) - span + 1)
    n = np.maximum(np.diff(at) - span + 1, 0)
    of = np.repeat(np.arange(len(t)), n)
    window = np.repeat(at[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    place = least[window]
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    return of[new], window[new] - at[of[new]] + t.at[of[new]], np.diff(np.r_[new, len(place)]), h[place[new]]


def _scan(docs: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b["text"]):
                yield make(t, b.slice(t.first, len(t)))

    return docs.mapInArrow(run, schema)


def _minimizer_counts(t: Texts, _: pa.RecordBatch) -> pa.RecordBatch:
    h, n = np.unique(paths(t, t.word_hashes())[3], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], ["h", "n"])


def _minimizers(t: Texts, b: pa.RecordBatch) -> pa.RecordBatch:
    of, _, _, h = paths(t, t.word_hashes())
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])] if len(of) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([b["o"].take(pa.array(of[new])), pa.array(signed(h[new]))], ["o", "h"])


def _found(t: Texts, b: pa.RecordBatch):
    """The paths whose minimizer is in the row's list hs, with the minimizers and both word hashes of the slice."""
    hashes = [t.word_hashes(which=w) for w in (0, 1)]
    of, start, n, h = paths(t, hashes[0])
    wanted = b["hs"]
    texts = np.repeat(np.arange(len(t), dtype=np.uint64), wanted.value_lengths().to_numpy())
    rows = np.empty(len(texts), [("t", np.uint64), ("h", np.uint64)])
    rows["t"], rows["h"] = texts, wanted.flatten().to_numpy().view(np.uint64)
    own = np.empty(len(of), rows.dtype)
    own["t"], own["h"] = of, h
    hit = np.isin(own, rows)
    return hashes, of[hit], start[hit], n[hit], h[hit]


def _path_rows(t: Texts, b: pa.RecordBatch) -> pa.RecordBatch:
    hashes, of, start, n, h = _found(t, b)
    keys = [signed(_WORDS[w].stretches(hashes[w], start, start + n + WINDOW - 1)) for w in (0, 1)]
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), b["o"].take(pa.array(of)), pa.array((start - t.at[of]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(h))], ["c1", "c2", "o", "start", "n", "h"])


def _source_windows(t: Texts, b: pa.RecordBatch) -> pa.RecordBatch:
    """The windows of the row's listed paths (start, n)."""
    sizes = b["source"].value_lengths().to_numpy()
    flat = b["source"].flatten()
    of = np.repeat(np.arange(len(t)), sizes)
    n = flat.field("n").to_numpy().astype(np.int64)
    start = flat.field("start").to_numpy() + t.at[of]
    at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    of = np.repeat(of, n)
    keys = [signed(_WORDS[w].stretches(t.word_hashes(which=w), at, at + WINDOW)) for w in (0, 1)]
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), b["o"].take(pa.array(of)), pa.array((at - t.at[of]).astype(np.int32))], ["w1", "w2", "o", "pos"])


def repeats(docs: DataFrame, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(later copies, repeats) of docs (o, text): ``copies`` (o, first) of whole texts, ``repeats`` (o, start, words, source, source_start) in the others.

    Rows with one o are one document: they have equal texts. ``keys`` are
    ``text_keys(docs)`` unless given.
    """
    kind = docs.schema["o"].dataType.simpleString()
    keyed = (text_keys(docs) if keys is None else keys).where("k3 IS NOT NULL")
    same = cut(keyed.groupBy("k1", "k2", "k3").agg(F.min("o").alias("first"), F.count("*").alias("rows")).where("rows > 1"))
    copies = cut(keyed.join(same, ["k1", "k2", "k3"]).where("o > first").select("o", "first").distinct())
    texts = docs.where("text IS NOT NULL").join(small(copies.select("o"), copies.count()), "o", "left_anti").select("o", "text")

    often = cut(_scan(texts.select("text"), "h long, n long", _minimizer_counts).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))  # so that the join below is of two plain exchanges, which Spark can split
    marked = cut(_scan(texts, f"o {kind}, h long", _minimizers).join(often, "h", "left_semi").groupBy("o").agg(F.collect_set("h").alias("hs")))  # as many as a text has at most
    rows = marked.count()
    looked = texts.join(small(marked.select("o"), rows), "o", "left_semi").join(marked, "o")
    found = cut(_scan(looked, f"c1 long, c2 long, o {kind}, start int, n int, h long", _path_rows))
    nodes = found.groupBy("c1", "c2").agg(F.min(F.struct("o", "start", "n")).alias("source"), F.count("*").alias("times"), F.min("h").alias("h"))
    nodes = cut(nodes.select("c1", "c2", "h", F.col("source.o").alias("so"), F.col("source.start").alias("ss"), F.col("source.n").alias("n"), "times"))

    known = found.join(nodes.where("times > 1").drop("n", "h"), ["c1", "c2"]).where("o <> so OR start <> ss")
    known = known.select("o", "start", (F.col("n") + F.lit(WINDOW - 1)).alias("words"), F.col("so").alias("source"), F.col("ss").alias("source_start"))

    several = nodes.groupBy("h").agg(F.count("*").alias("nodes")).where("nodes > 1").select("h")  # a window lies in one node only unless its minimizer has more
    listed = nodes.join(several, "h", "left_semi").groupBy(F.col("so").alias("o")).agg(F.collect_list(F.struct(F.col("ss").alias("start"), "n")).alias("source"))
    windows = cut(_scan(texts.join(small(marked.select("o"), rows), "o", "left_semi").join(listed, "o"), f"w1 long, w2 long, o {kind}, pos int", _source_windows))
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("o", "pos")).alias("f"), F.count("*").alias("times")).where("times > 1").select("w1", "w2", "f")
    single = windows.join(first, ["w1", "w2"]).where("o <> f.o OR pos <> f.pos").select("o", F.col("pos").alias("start"), F.lit(WINDOW).alias("words"), F.col("f.o").alias("source"), F.col("f.pos").alias("source_start"))
    return copies, known.union(single)


def spans(found: DataFrame) -> DataFrame:
    """Long spans (o, start, words, source, source_start): repeats that adjoin or overlap, from adjoining places of one source, joined.

    One document's repeats are as many as its words at most.
    """
    from pyspark.sql import Window

    line = Window.partitionBy("o", "source", "shift").orderBy("start")
    runs = found.withColumn("shift", F.col("start") - F.col("source_start")).withColumn("reach", F.max(F.col("start") + F.col("words")).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("o", "source", "shift", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("words")).alias("end"), F.min("source_start").alias("source_start")).select("o", "start", (F.col("end") - F.col("start")).alias("words"), "source", "source_start")


def _all_words(t: Texts, b: pa.RecordBatch) -> pa.RecordBatch:
    joined = [b" ".join(t.text(d).split()) for d in range(len(t))]
    return pa.RecordBatch.from_arrays([b["o"], b["k"], b["id"], pa.array(np.diff(t.at).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in joined])], ["o", "k", "id", "n_words", "all_sha256"])


def _kept_words(t: Texts, b: pa.RecordBatch) -> Iterator[list[bytes]]:
    for d, runs in enumerate(b["runs"].to_pylist()):
        words = t.text(d).split()
        gone = np.zeros(len(words) + 1, np.int64)
        for r in runs:
            gone[min(r["start"], len(words))] += 1
            gone[min(r["start"] + r["words"], len(words))] -= 1
        stay = np.cumsum(gone)[: len(words)] == 0
        yield [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def _without(t: Texts, b: pa.RecordBatch) -> pa.RecordBatch:
    kept = list(_kept_words(t, b))
    n = np.diff(t.at) - np.array([len(x) for x in kept], np.int64)
    return pa.RecordBatch.from_arrays([b["o"], b["k"], b["id"], pa.array(n), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in kept]), pa.array([b" ".join(x).decode() for x in kept])], ["o", "k", "id", "n_removed", "kept_sha256", "kept"])


def text_keys(docs: DataFrame) -> DataFrame:
    """(o, k1, k2, k3) of each row: two fingerprints of its text and its length, null without a text."""
    return cut(docs.select("o", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), F.length("text").alias("k3")))


def _ordered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(o, id, text) of each row, and its text keys. Documents are told apart and ordered by o.

    That is the id as it is, rows without one last. Only if an id has several
    texts, o is wider: the id, and in its lower bits a fingerprint of the text.
    """
    base = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST)).cast("long").alias("o"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    keys = text_keys(base)
    if keys.groupBy("o").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").isEmpty():
        return base, keys

    def wide(k: Column) -> Column:
        return (F.col("o").cast("decimal(38,0)") * F.lit(Decimal(1 << 62)) + F.shiftrightunsigned(k, 2)).cast("decimal(38,0)")

    return base.withColumn("o", wide(F.xxhash64("text"))), keys.withColumn("o", wide(F.col("k1")))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, kept): of the rows that lose words, the id, xxhash64 of the text, and the words left, joined by one space.

    Ids are longs or null. See ``digests`` for odd rows.
    """
    base, keys = _ordered(docs, doc_id, text)
    copies, changed = _changed(base, keys)
    later = base.join(copies, "o", "left_semi").where(F.regexp_count("text", F.lit(WORD)) >= WINDOW).select("id", F.xxhash64("text"), F.lit(""))
    return changed.select(F.col("id").alias("doc_id"), F.col("k").alias("text_hash"), "kept").union(later)


def _changed(base: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    copies, found = repeats(base.select("o", "text"), keys)
    runs = cut(spans(found).groupBy("o").agg(F.collect_list(F.struct("start", "words")).alias("runs")))
    texts = base.where("text IS NOT NULL").join(small(copies.select("o"), copies.count()), "o", "left_anti").join(small(runs.select("o"), runs.count()), "o", "left_semi")
    rows = texts.select("o", F.xxhash64("text").alias("k"), "id", "text").join(runs, "o")
    return copies, _scan(rows, f"o {base.schema['o'].dataType.simpleString()}, k long, id long, n_removed long, kept_sha256 string, kept string", _without)


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each row of docs.

    A word goes if a window over it starts earlier too: in a document with a
    smaller id, or before in the same. Null and empty texts have no words. Rows
    without an id come after all others. Rows repeated with id and text are one
    document and lose the same words. Texts under one id, or under none, are
    documents of their own, in the order of their fingerprints: what only one of
    them has stays. No rows give no rows. Only the two named columns are read.
    """
    base, keys = _ordered(docs, doc_id, text)
    copies, changed = _changed(base, keys)
    kind = base.schema["o"].dataType.simpleString()
    whole = _scan(base.select("o", F.xxhash64("text").alias("k"), "id", "text"), f"o {kind}, k long, id long, n_words long, all_sha256 string", _all_words)
    out = whole.join(changed.select("o", "k", "n_removed", "kept_sha256").dropDuplicates(["o", "k"]), ["o", "k"], "left").join(copies.withColumn("copy", F.lit(True)), "o", "left")
    gone = F.col("copy") & (F.col("n_words") >= WINDOW)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )

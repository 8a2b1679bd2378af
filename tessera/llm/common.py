"""Shared parts: word scanning over Arrow buffers, rolling fingerprints, lineage cuts.

Words are maximal runs of characters other than space and ``\\t\\n\\v\\f\\r``.
All of these separators are single ASCII bytes, so words can be found in the
UTF-8 bytes of a whole Arrow batch at once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are scanned together; a single longer text is scanned alone.
SLICE_BYTES = 500_000
#: Most rows of a batch that a Python worker gets.
BATCH_ROWS = 1000
#: Most rows of a side (of a few numbers a row) that is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Rolling:
    """Fingerprints of stretches of a sequence: differences of prefix sums of powers modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            self.up, self.down = (np.multiply.accumulate(np.r_[U(1), np.full(size - 1, b, U)]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    def stretches(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


_BYTES = (_Rolling(0x9E3779B97F4A7C15), _Rolling(0xD1342543DE82EF95))
_WORDS = (_Rolling(0xA0761D6478BD642F), _Rolling(0xE7037ED1A0B428DB))
_OF_BYTE = tuple(mix(np.arange(1, 257, dtype=U) * U(odd)) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


class Texts:
    """Consecutive texts of a batch with the places of their words.

    ``at[d] : at[d + 1]`` are the words of text d; ``starts`` and ``ends`` are
    byte places in ``data``.
    """

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets = first, data, offsets
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.r_[False, word[:-1]] if len(data) else word
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.r_[word[1:], False] if len(data) else word
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def word_hashes(self, lower: bool = False, which: int = 0) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return _BYTES[which].stretches(_OF_BYTE[which][data], self.starts, self.ends)

    def windows(self, k: int, lower: bool = False, which: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of k words, and as ``at`` the places where each text's windows begin."""
        hashes = self.word_hashes(lower, which) if hashes is None else hashes
        n = np.maximum(np.diff(self.at) - k + 1, 0)
        at = np.r_[0, np.cumsum(n)]
        starts = np.repeat(self.at[:-1] - at[:-1], n) + np.arange(at[-1])
        return _WORDS[which].stretches(hashes, starts, starts + k), at

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow string column in slices of bounded size; nulls count as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from flat values and each row's number of them."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, kind or pa.int64()))


def n_words(text: Column | str) -> Column:
    """Number of words, inside the JVM; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir`` of the session.

    Only on a single machine, where none is set, as in tests, a temporary
    folder is used; on a cluster that would lose data, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and go on from there.

    With ``sweep`` the driver collects its garbage first, upon which Spark
    deletes the shuffle files of steps before that nothing needs any more.

    The files go with the DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if sweep:
        context._jvm.System.gc()
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if its counted rows are at most ``limit``; Spark shuffles both sides otherwise."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """At most n rows of df, those whose key hashes lowest: the same ones in every run.

    A share that is sure to hold n rows is taken by the hash first, so that
    what is sorted is about n rows however many partitions df has.
    """
    share = min(1.0, (n + 6 * n**0.5 + 20) / max(1, df.count()))
    h = F.shiftrightunsigned(F.xxhash64(key), 33)
    low = df.where(F.lit(share >= 1.0) | (h < F.lit(int(share * (1 << 31)))))
    return low.orderBy(h, *[c for c, kind in df.dtypes if not kind.startswith("map")]).limit(n)


def with_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, and hand them few rows at a time.

    Executors fetch a zip file from Spark, once a session, and need no path of
    the driver's. A batch is in memory several times, in the executor and in
    the worker, and texts may be long; so the session's batches of Arrow rows
    are made smaller, and stay so.
    """
    context = spark.sparkContext
    if not getattr(context, "_tessera_sent", False):
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="tessera-")
        made = f"{folder}/tessera_package.zip"
        with zipfile.ZipFile(made, "w") as z:
            for f in sorted(package.rglob("*")):
                if f.suffix in (".py", ".txt"):
                    z.write(f, f.relative_to(package.parent))
        context.addPyFile(made)  # the driver serves it from here
        atexit.register(shutil.rmtree, folder, True)
        context._tessera_sent = True
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

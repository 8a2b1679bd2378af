"""The files of a table that grows batch by batch: which of them count, and how old ones are merged and dropped.

Each batch is a folder of Parquet files. A manifest names the folders that make
up the table after a batch; readers take the newest, so that they see a batch
whole or not at all. Folders that a manifest leaves out are deleted only after
``GRACE`` seconds, when no reader of an older manifest needs them any more.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Seconds for which dropped folders stay, folders before small ones are merged, rows of a small one, manifests kept.
GRACE, MANY, SMALL, MANIFESTS = 60.0, 32, 100_000, 3


@dataclass
class Part:
    """A folder: its rows, the times of its oldest and latest event, its last batch."""

    folder: str
    rows: int
    oldest: float
    latest: float
    last: int


@dataclass
class Manifest:
    batch: int = -1
    ingested: int = 0
    parts: list[Part] = field(default_factory=list)
    dropped: list[tuple[str, float]] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)


class Files:
    """Reads and writes the small files beside a table, on whatever file system its path is on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.system = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def delete(self, name: str) -> None:
        self.system.delete(self._at(name), True)

    def newest(self, before: int | None = None) -> Manifest:
        """The manifest of the latest batch, or of the latest before a batch that is tried again; an empty one if there is none."""
        if not self.system.exists(self._at("_manifests")):
            return Manifest()
        numbers = [int(f.getPath().getName()[:-5]) for f in self.system.listStatus(self._at("_manifests")) if f.getPath().getName()[:-5].isdigit()]
        numbers = [n for n in numbers if before is None or n < before]
        if not numbers:
            return Manifest()
        stream = self.system.open(self._at(f"_manifests/{max(numbers)}.json"))
        try:
            d = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(d["batch"], d["ingested"], [Part(**p) for p in d["parts"]], [tuple(x) for x in d["dropped"]])

    def commit(self, manifest: Manifest) -> None:
        """Make a manifest the newest: written beside, then renamed."""
        name, beside = f"_manifests/{manifest.batch}.json", f"_manifests/_{manifest.batch}.writing"
        out = self.system.create(self._at(beside), True)
        try:
            out.write(bytearray(json.dumps(asdict(manifest)), "utf-8"))
        finally:
            out.close()
        self.delete(name)
        self.system.rename(self._at(beside), self._at(name))
        self.delete(f"_manifests/{manifest.batch - MANIFESTS}.json")

    def read(self, manifest: Manifest, schema: str) -> DataFrame:
        if not manifest.parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p.folder}" for p in manifest.parts])


def retained(manifest: Manifest, now: float, age: float | None, rows: int | None) -> Manifest:
    """Without the folders whose events are all too old, and without the oldest beyond the number of rows."""
    keep = [p for p in manifest.parts if age is None or p.latest >= now - age]
    over = sum(p.rows for p in keep) - (rows if rows is not None else 1 << 62)
    while keep and over >= keep[0].rows:
        over -= keep.pop(0).rows
    gone = [p.folder for p in manifest.parts if p not in keep]
    return Manifest(manifest.batch, manifest.ingested, keep, manifest.dropped + [(f, now) for f in gone])


def merged(files: Files, manifest: Manifest, now: float, schema: str) -> Manifest:
    """With the small folders written as one, once there are many of them; large ones stay as they are."""
    small = [p for p in manifest.parts if p.rows < SMALL]
    if len(manifest.parts) <= MANY or len(small) < 2:
        return manifest
    folder = f"merged={manifest.batch}"
    files.read(Manifest(parts=small), schema).coalesce(1).write.mode("overwrite").parquet(f"{files.path}/{folder}")
    one = Part(folder, sum(p.rows for p in small), min(p.oldest for p in small), max(p.latest for p in small), max(p.last for p in small))
    parts = sorted([p for p in manifest.parts if p not in small] + [one], key=lambda p: p.last)
    return Manifest(manifest.batch, manifest.ingested, parts, manifest.dropped + [(p.folder, now) for p in small])


def swept(files: Files, manifest: Manifest, now: float) -> Manifest:
    """With folders deleted that were dropped long enough ago."""
    for folder, at in manifest.dropped:
        if at < now - GRACE:
            files.delete(folder)
    return Manifest(manifest.batch, manifest.ingested, manifest.parts, [(f, at) for f, at in manifest.dropped if at >= now - GRACE])

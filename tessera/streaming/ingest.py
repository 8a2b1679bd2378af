"""From raw lines to a growing table of edits, with figures on the way."""

from __future__ import annotations

import statistics
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.store import MOST_ROWS, RETENTION
from ..sources import edits
from ..sources.catalog import Table
from ..sources.edits import decode, normalised
from . import rollup
from .parts import Files, Manifest, Part, merged, retained, swept

#: Between two batches, how long an id is remembered, lags that the median is of, and the lag below which the past is caught up with.
FLUSH, REMEMBER, LAGS, CAUGHT_UP = "400 milliseconds", "30 minutes", 400, 5.0
#: Columns of the files: the edit, its id, and its place in the order of arrival.
STORED = f"id string, {edits.schema()}, _arrival bigint"


@dataclass
class Stats:
    """Figures since the start of an ingestion; those of lines are added up from what each batch reports, once a batch."""

    received: int = 0
    kept: int = 0
    parse_errors: int = 0
    reconnects: int = 0
    backfilling: bool = True
    lags: deque = field(default_factory=lambda: deque(maxlen=LAGS))
    last_batch: int = -1
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    @property
    def median_lag(self) -> float | None:
        return round(statistics.median_high(self.lags), 2) if self.lags else None

    def add(self, batch: int, lines) -> None:
        with self.lock:
            if batch > self.last_batch:
                self.last_batch = batch
                self.received += lines["received"] or 0
                self.parse_errors += lines["parse_errors"] or 0
                self.reconnects += lines["reconnects"] or 0


class Totals(StreamingQueryListener):
    """Adds each finished batch's figures to ``stats``, however many batches there have been."""

    def __init__(self, stats: Stats) -> None:
        self.stats, self.query = stats, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.query is not None and str(p.id) == self.query and "lines" in (p.observedMetrics or {}):
            self.stats.add(p.batchId, p.observedMetrics["lines"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def deduplicated(events: DataFrame, streaming: bool) -> DataFrame:
    """Events without those whose id came before; events without an id all stay.

    In a stream an id is remembered for ``REMEMBER`` after its arrival. Arrival
    counts, not the event's own time, so that none is late, whatever its time is.
    """
    keyed = events.withColumn("_key", F.coalesce("id", F.concat(F.lit("\x00"), F.uuid())))
    if streaming:
        seen = keyed.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", REMEMBER)
        return seen.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_arrived")
    return keyed.dropDuplicates(["_key"]).drop("_key")


def ingest(
    lines: DataFrame, path: str, checkpoint: str, *, rollups: str | None = None, stats: Stats | None = None, trigger: dict | None = None,
    age: float | None = RETENTION, rows: int | None = MOST_ROWS, clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Append the edits in a stream of JSON lines to a Parquet table, and their rollups to another.

    Of the table, rows older than ``age`` seconds and all but the latest
    ``rows`` are dropped, as whole folders of files; None keeps them. A batch
    that is tried again after a failure writes to the folder of its own number
    and starts from the table as it was before, so that no edit is there twice.
    A column ``reconnects`` of the lines counts lost connections; rows without a
    line are there for it alone.
    """
    stats = stats if stats is not None else Stats()
    drops = F.sum("reconnects") if "reconnects" in lines.columns else F.lit(0).cast("long") + F.sum(F.lit(0))
    events = decode(lines.withColumn("line", F.col("value").isNotNull()))
    events = events.observe("lines", F.count_if("line").alias("received"), F.count_if(F.col("line") & F.col("bad")).alias("parse_errors"), drops.alias("reconnects"))
    # ids are remembered before anything is left out by kind; arrival is the batch and a number within
    fresh = normalised(deduplicated(events.where("line AND NOT bad").select("e", "id"), True))

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files, seen, now = Files(spark, path), Observation(), clock()
        t = F.unix_micros("ts") / 1e6
        lag = F.lit(now) - t
        shares = F.percentile_approx(F.when(lag >= 0, lag), F.array(*[F.lit((i + 0.5) / LAGS) for i in range(LAGS)]), F.lit(1000))
        arriving = batch.withColumn("_arrival", F.lit(number).cast("long") * F.lit(1 << 33) + F.monotonically_increasing_id())
        arriving = arriving.observe(seen, F.count(F.lit(1)).alias("n"), F.min(t).alias("oldest"), F.max(t).alias("latest"), F.min(lag).alias("least"), F.count_if(lag >= 0).alias("lagging"), shares.alias("lags"))
        folder = f"batch={number}"
        arriving.write.mode("overwrite").parquet(f"{path}/{folder}")
        found = seen.get
        n = found.get("n") or 0
        stats.kept += n
        if n:
            lags, k = found.get("lags") or [], min(LAGS, found["lagging"])
            stats.lags.extend(lags[int((i + 0.5) * len(lags) / k)] for i in range(k))
            stats.backfilling = stats.backfilling and found["least"] >= CAUGHT_UP
        table = files.newest(before=number)
        new = [Part(folder, n, found["oldest"], found["latest"], number)] if n else []
        table = Manifest(number, table.ingested + n, table.parts + new, table.dropped + ([] if n else [(folder, now)]))
        table = merged(files, retained(table, now, age, rows), now, STORED)
        files.commit(swept(files, table, now))
        if rollups is not None and n:
            rollup.rollup(spark.read.schema(STORED).parquet(f"{path}/{folder}")).write.mode("overwrite").parquet(f"{rollups}/batch={number}")

    spark = lines.sparkSession
    totals = Totals(stats)
    spark.streams.addListener(totals)
    query = fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": FLUSH})).start()
    totals.query = str(query.id)
    return query


def status(query: StreamingQuery, stats: Stats) -> dict:
    """The figures of an ingestion so far. Batches that the listener has not heard of yet are added from the query's own progress."""
    for p in query.recentProgress:
        if "lines" in (p["observedMetrics"] or {}):
            stats.add(p["batchId"], p["observedMetrics"]["lines"])
    error = query.exception()
    return {
        "connected": query.isActive,
        "backfilling": stats.backfilling,
        "received": stats.received,
        "kept": stats.kept,
        "parse_errors": stats.parse_errors,
        "reconnects": stats.reconnects,
        "last_error": str(error) if error else None,
        "median_lag": stats.median_lag,
    }


def line_figures(lines: DataFrame) -> DataFrame:
    """How many lines there are and how many are no JSON."""
    return decode(lines).agg(F.count(F.lit(1)).alias("received"), F.count_if("bad").alias("parse_errors"))


def live_table(spark: SparkSession, path: str, clock: Callable[[], float] = time.time, age: int = RETENTION, rows: int = MOST_ROWS) -> Table:
    """The table that ``ingest`` writes, of the last ``age`` seconds and at most its latest ``rows``; each query sees it as it is by then."""
    files = Files(spark, path)
    first: dict[int, int] = {}

    def load(now: float) -> DataFrame:
        now_on = files.newest()
        df = files.read(now_on, STORED)
        over = now_on.rows - rows
        if over > 0:  # the rows to skip are all in the oldest folders
            if now_on.batch not in first:
                first.clear()
                first[now_on.batch] = df.select("_arrival").orderBy("_arrival").offset(over).first()[0] if over < now_on.rows else 0
            df = df.where(F.col("_arrival") >= first[now_on.batch])
        table.ingested = now_on.ingested
        return df.where(F.col("ts") >= F.timestamp_micros(F.lit(round((now - age) * 1e6)))).drop("id")

    table = Table(files.read(Manifest(), STORED).drop("id"), "ts", "_arrival", age, clock, ("_arrival",), load)
    table.refresh()
    return table

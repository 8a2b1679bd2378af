"""What is asked of a table of recent events besides queries: retention, the latest rows, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Table, seconds

#: Seconds and rows of raw events that are kept.
RETENTION, MOST_ROWS = 900, 80_000


def retained(table: Table, now: float, age: int = RETENTION, rows: int = MOST_ROWS) -> DataFrame:
    """The rows of the last ``age`` seconds, of these the ``rows`` that arrived last."""
    recent = table.since(now, age)
    return recent.orderBy(F.col(table.order).desc()).limit(rows)


def human() -> Column:
    """An article edit by a person."""
    return ~F.col("is_bot") & (F.col("project") == "wikipedia") & (F.col("namespace") == 0)


def recent(table: Table, limit: int = 20, human_only: bool = False) -> DataFrame:
    """The latest rows, newest first."""
    df = table.df.where(human()) if human_only else table.df
    return df.orderBy(F.col(table.order).desc()).limit(limit)


def stats(table: Table, now: float, started: float | None = None, ingested: int | None = None) -> DataFrame:
    """One row: rows kept and ever ingested, events a second over the last minute, ages of the oldest and the latest event, uptime."""
    total = ingested if ingested is not None else table.ingested
    t = seconds(table.df, table.time)
    df = table.df.select(t.alias("t"))
    last = F.col("t") >= F.lit(now - 60)
    span = F.least(F.greatest(F.lit(now) - F.min(F.when(last, F.col("t"))), F.lit(1.0)), F.lit(60.0))
    return df.agg(
        F.count(F.lit(1)).alias("buffered_rows"),
        (F.lit(total).cast("long") if total is not None else F.count(F.lit(1))).alias("total_ingested"),
        F.coalesce(F.round(F.count_if(last) / span, 2), F.lit(0.0)).alias("events_per_second"),
        F.coalesce(F.round(F.lit(now) - F.min("t"), 1), F.lit(0.0)).alias("oldest_age"),
        F.coalesce(F.round(F.lit(now) - F.max("t"), 2), F.lit(0.0)).alias("last_event_age"),
        F.lit(round(now - started, 1) if started is not None else 0.0).alias("uptime"),
    )

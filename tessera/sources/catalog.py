"""Tables that queries can name."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Table:
    """A DataFrame with the column of its event time, the one of its arrival order, and what is kept of it.

    ``retention`` is the longest window in seconds, None for static data. The
    clock gives seconds since 1970; without one, static data end at their
    latest event, and live data at the present. ``load`` makes the DataFrame of
    a table that grows, as of a time; queries and the feed call for it anew.
    """

    df: DataFrame
    time: str | None = None
    order: str | None = None
    retention: int | None = None
    clock: Callable[[], float] | None = None
    hidden: tuple[str, ...] = ()
    load: Callable[[float], DataFrame] | None = field(default=None, repr=False)
    ingested: int | None = None
    _latest: float | None = field(default=None, repr=False)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.hidden]

    def refresh(self, now: float | None = None) -> None:
        """See what has been added to a growing table."""
        if self.load is not None:
            self.df = self.load(self.now() if now is None else now)

    def now(self) -> float:
        if self.clock:
            return self.clock()
        if self.retention is not None or self.time is None:
            return time.time()
        if self._latest is None:  # one scan of one column, once a table
            latest = self.df.agg(F.max(self.time).alias(self.time))
            self._latest = latest.select(seconds(latest, self.time)).first()[0] or 0.0
        return self._latest

    def since(self, now: float, window: int) -> DataFrame:
        """The rows of the last ``window`` seconds and later ones, by a plain comparison that Parquet can use."""
        kind = self.df.schema[self.time].dataType
        micros = F.lit(round((now - window) * 1e6))
        if isinstance(kind, T.TimestampNTZType):
            bound = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))
        elif isinstance(kind, T.TimestampType):
            bound = F.timestamp_micros(micros)
        else:
            bound = F.lit(now - window)
        return self.df.where(self.df[self.time] >= bound)


def seconds(df: DataFrame, column: str):
    """A time column as seconds since 1970; numbers are that already."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(df[column]) / F.lit(1e6)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(df[column].cast("timestamp"), F.current_timezone())) / F.lit(1e6)
    return df[column].cast("double")

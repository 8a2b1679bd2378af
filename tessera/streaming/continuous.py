"""Continuous queries: a query is asked again and again, and only what changed is passed on."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store
from ..operators.engine import Engine
from ..plans.errors import QueryError
from ..plans.presets import preset

#: Seconds between two runs, after an error, and at most; a run that takes longer than SLOW waits ten times as long.
TICK, AFTER_ERROR, MOST, SLOW = 1.0, 2.0, 5.0, 0.25


@dataclass
class Change:
    """A row that is new or has changed (``op`` set, with its place) or is gone (``op`` remove)."""

    op: str
    key: tuple
    index: int | None = None
    row: tuple | None = None


@dataclass
class Message:
    """All rows, or the changes since the last message; ``order`` lists all keys if their order changed."""

    id: str
    columns: list[str]
    rows: list[tuple] | None = None
    keys: list[tuple] | None = None
    changes: list[Change] | None = None
    order: list[tuple] | None = None
    notes: list[str] = field(default_factory=list)
    truncated: bool = False
    elapsed_ms: float = 0.0


@dataclass
class Failure:
    id: str
    message: str
    start: int = 0
    end: int = 0
    hint: str | None = None


@dataclass
class Feed:
    """The latest rows, figures of the table, and the headline query's row (None if it failed)."""

    rows: list[tuple]
    stats: dict
    headline: dict | None


def difference(old: dict[tuple, tuple], new: dict[tuple, tuple]) -> tuple[list[Change], list[tuple] | None]:
    """The changes that make new of old, and the order of all keys if the shared ones moved or any came or went."""
    changes = [Change("set", k, i, row) for i, (k, row) in enumerate(new.items()) if k not in old or old[k] != row]
    changes += [Change("remove", k) for k in old if k not in new]
    return changes, None if list(old) == list(new) else list(new)


def applied(rows: dict[tuple, tuple], message: Message) -> dict[tuple, tuple]:
    """The rows a receiver has after a message, in order."""
    if message.rows is not None:
        return dict(zip(message.keys or [], message.rows, strict=True))
    out = dict(rows)
    for c in message.changes or []:
        if c.op == "remove":
            out.pop(c.key, None)
        else:
            out[c.key] = c.row
    return {k: out[k] for k in message.order} if message.order is not None else out


def changes_between(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The same difference of two large results as a DataFrame: keys, new values, ``op``."""
    values = [c for c in new.columns if c not in keys]
    a = old.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*values).alias("a"), F.lit(True).alias("in_a"))
    b = new.select(*[F.col(k).alias(f"j{i}") for i, k in enumerate(keys)], F.struct(*values).alias("b"), F.lit(True).alias("in_b"))
    same = None
    for i in range(len(keys)):
        equal = a[f"k{i}"].eqNullSafe(b[f"j{i}"])
        same = equal if same is None else same & equal
    both = a.join(b, same, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")) | F.col("in_a").isNull() | F.col("in_b").isNull())
    gone = F.col("in_b").isNull()
    return both.select(*[F.when(gone, F.col(f"k{i}")).otherwise(F.col(f"j{i}")).alias(k) for i, k in enumerate(keys)], *[F.col("b")[v].alias(v) for v in values], F.when(gone, "remove").otherwise("set").alias("op"))


class ContinuousQuery:
    """One query, when it is due, and the rows it gave last."""

    def __init__(self, id: str, sql: str, engine: Engine) -> None:
        self.id, self.sql, self.engine = id, sql, engine
        self.due_at = 0.0
        self.columns: list[str] | None = None
        self.rows: dict[tuple, tuple] = {}

    def due(self, now: float) -> bool:
        return now >= self.due_at

    def evaluate(self, now: float, at: float | None = None) -> Message | Failure | None:
        """Run the query, as of ``at`` if given; None if nothing changed."""
        try:
            found = self.engine.run(self.sql, at).collect()
        except QueryError as e:
            self.due_at = now + AFTER_ERROR
            return Failure(self.id, e.message, e.start, e.end, e.hint)
        except Exception as e:  # the query stays and is tried again
            self.due_at = now + AFTER_ERROR
            return Failure(self.id, f"The query failed: {e}")
        took = found.elapsed_ms / 1000
        self.due_at = now + (TICK if took < SLOW else min(MOST, 10 * took))
        keys = found.keys if found.keys and found.keys[0] else [(i,) for i in range(len(found.rows))]
        rows = dict(zip([_plain(k) for k in keys], [_plain(r) for r in found.rows], strict=True))
        head = {"notes": found.notes, "truncated": found.truncated, "elapsed_ms": found.elapsed_ms}
        if self.columns != found.columns:
            self.columns, self.rows = found.columns, rows
            return Message(self.id, found.columns, rows=list(rows.values()), keys=list(rows), **head)
        changes, order = difference(self.rows, rows)
        self.rows = rows
        return Message(self.id, found.columns, changes=changes, order=order, **head) if changes or order is not None else None


def _plain(x):
    """Rows and lists as tuples, so that they can be keys."""
    return tuple(_plain(y) for y in x) if isinstance(x, (list, tuple)) else x


class Session:
    """Subscriptions to one engine; ``send`` gets each message. With ``table`` a feed of its latest rows is sent each second."""

    def __init__(self, engine: Engine, send: Callable[[Message | Failure | Feed], None], clock: Callable[[], float] = time.monotonic, table: str | None = None) -> None:
        self.engine, self.send, self.clock, self.table = engine, send, clock, table
        self.queries: dict[str, ContinuousQuery] = {}
        self.feed_rows, self.feed_human_only, self.feed_at = 14, False, 0.0
        self.started = time.time()

    def subscribe(self, id: str, sql: str) -> bool:
        """Take up a query, in place of one with the same id; a wrong one is answered at once."""
        try:
            self.engine.check(sql)
        except QueryError as e:
            self.queries.pop(id, None)
            self.send(Failure(id, e.message, e.start, e.end, e.hint))
            return False
        self.queries[id] = ContinuousQuery(id, sql, self.engine)
        return True

    def unsubscribe(self, id: str) -> None:
        self.queries.pop(id, None)

    def set_feed(self, human_only: bool, rows: int = 14) -> None:
        self.feed_human_only, self.feed_rows, self.feed_at = human_only, rows, 0.0

    def tick(self, at: float | None = None) -> int:
        """Run what is due; how many ran."""
        ran = 0
        for q in list(self.queries.values()):
            if q.due(self.clock()):
                ran += 1
                if (message := q.evaluate(self.clock(), at)) is not None:
                    self.send(message)
        if self.table is not None and self.clock() >= self.feed_at:
            self.feed_at = self.clock() + TICK
            self.send(self.feed(at))
        return ran

    def feed(self, at: float | None = None) -> Feed:
        table = self.engine.tables[self.table]
        table.refresh(at)
        now = at if at is not None else table.now()
        rows = store.recent(table, self.feed_rows, self.feed_human_only).select(*table.columns).collect()
        figures = store.stats(table, now, min(self.started, now)).first().asDict()
        try:
            found = self.engine.run(preset("headline", table=self.table), now).collect()
            headline = dict(zip(found.columns, found.rows[0], strict=True))
        except QueryError:
            headline = None
        return Feed([tuple(r) for r in rows], figures, headline)

    def run(self, seconds: float, pause: float = 0.15) -> None:
        end = self.clock() + seconds
        while self.clock() < end:
            self.tick()
            time.sleep(pause)

"""A server-sent-events source for Structured Streaming.

``spark.readStream.format("sse").option("url", ...)`` gives one row a message:
its data as ``value``, and as ``reconnects`` how many connections were lost
since the row before. Offsets are times: a batch is a range of time, cut into
parts that tasks read on their own, each from its connection. A restart or a
failed task reads its range again. A part goes on a little into the next, since
messages come only nearly in order of time; ingestion takes out what is there
twice by its id.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Seconds before now at which a first read starts, without a message that end a read, of a part, that a part goes on into the next.
BACKFILL, READ, PART, BEYOND = 90, 2.0, 60, 2.0
#: Lost connections in a row, without a message between, after which a task fails.
TRIES = 6


def messages(lines: Iterator[bytes]) -> Iterator[str]:
    """The data of each message of an event stream; comments, ids and other fields are left out, and a message that the end cuts off."""
    data: list[str] = []
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line:
            if data:
                yield "\n".join(data)
            data = []
        elif line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))


def wait(failures: int, chance: float) -> float:
    """Seconds before the next try: doubling from one half to 16, at most 30, times 0.5 to 1."""
    return min(30.0, 0.5 * 2 ** min(failures, 5)) * (0.5 + chance / 2)


def seen_at(data: str, before: float) -> float:
    """The time of a message, or the one before where it has none."""
    try:
        event = json.loads(data)
        t = event.get("timestamp")
        return float(t) if isinstance(t, (int, float)) else datetime.fromisoformat(event["meta"]["dt"]).timestamp()
    except (ValueError, KeyError, TypeError, AttributeError):
        return before


class Span(InputPartition):
    """A range of time, in milliseconds."""

    def __init__(self, since: int, until: int) -> None:
        self.since, self.until = since, until


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"]
        self.seconds = float(options.get("readseconds", READ))
        self.backfill = float(options.get("backfillseconds", BACKFILL))
        self.part = int(float(options.get("partseconds", PART)) * 1000)

    def initialOffset(self) -> dict:
        return {"ms": int((time.time() - self.backfill) * 1000)}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(a, min(a + self.part, end["ms"])) for a in range(start["ms"], end["ms"], self.part)]

    def commit(self, end: dict) -> None:
        """Nothing to do: the server keeps the past."""

    def read(self, partition: Span) -> Iterator[tuple[str | None, int]]:
        """The messages from the range's start to a little after its end, or until none comes any more."""
        since, until = partition.since / 1000, partition.until / 1000 + BEYOND
        failures = lost = 0
        while True:
            got, ended, last = False, False, time.monotonic()
            try:
                with urllib.request.urlopen(self._request(since), timeout=self.seconds) as response:
                    for data in messages(response):
                        t = seen_at(data, since)
                        if t >= until:
                            ended = True
                            break
                        got = got or t > since
                        since = max(since, t)
                        yield data, lost
                        lost, last = 0, time.monotonic()
            except TimeoutError:
                ended = time.monotonic() - last >= self.seconds / 2  # quiet, not lost
            except (urllib.error.URLError, ConnectionError) as e:
                if failures >= TRIES:
                    raise ConnectionError(f"lost the connection {failures + 1} times in a row") from e
            else:
                ended = ended or not got  # the server has no more
            if ended:
                break
            lost += 1
            failures = 0 if got else failures + 1
            time.sleep(wait(failures, random.random()))
        if lost:
            yield None, lost

    def _request(self, since: float) -> urllib.request.Request:
        at = datetime.fromtimestamp(since, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        joint = "&" if "?" in self.url else "?"
        return urllib.request.Request(f"{self.url}{joint}since={urllib.parse.quote(at)}", headers={"Accept": "text/event-stream"})


class Sse(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return "value string, reconnects int"

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.sources.edits import decode, filled, looks_like_address, normalised
from tessera.sources.sse import Reader, Span, Sse, messages, seen_at, wait


def raw(**more):
    event = {
        "type": "edit", "server_name": "en.wikipedia.org", "title": "Berlin", "user": "Alice", "bot": False, "minor": True, "namespace": 0, "timestamp": 1700000000,
        "length": {"old": 100, "new": 250}, "comment": "words", "meta": {"uri": "https://x", "dt": "2023-11-14T22:13:20Z", "id": "abc"},
    }
    return {k: v for k, v in {**event, **more}.items() if v != "-gone-"}


def made(spark, *events):
    df = spark.createDataFrame([(json.dumps(e) if isinstance(e, dict) else e,) for e in events], "value string")
    return [r.asDict() for r in normalised(decode(df).where("NOT bad"), F.timestamp_seconds(F.lit(5))).collect()]


def test_an_edit(spark):
    (r,) = made(spark, raw())
    assert (r["lang"], r["project"], r["delta"], r["new_len"], r["is_minor"], r["id"], r["uri"]) == ("en", "wikipedia", 150, 250, True, "abc", "https://x")
    assert r["ts"].timestamp() == 1700000000


@pytest.mark.parametrize(
    ("server", "expected"),
    [("ja.wiktionary.org", ("ja", "wiktionary")), ("www.wikidata.org", ("-", "wikidata")), ("commons.wikimedia.org", ("-", "wikimedia")), ("wikidata.org", ("-", "org")), ("localhost", ("-", "localhost"))],
)
def test_servers(spark, server, expected):
    (r,) = made(spark, raw(server_name=server))
    assert (r["lang"], r["project"]) == expected


def test_lengths_times_and_missing_fields(spark):
    new, none, old0, text, bare = made(
        spark, raw(type="new", length={"old": None, "new": 900}), raw(length=None), raw(length={"old": 0, "new": 7}), raw(timestamp="-gone-"),
        {"type": "log", "server_name": "de.wikipedia.org"},
    )
    assert (new["delta"], none["delta"], none["new_len"], old0["delta"]) == (900, 0, 0, 7)
    assert text["ts"].timestamp() == 1700000000 and bare["ts"].timestamp() == 5
    assert all(v is not None for k, v in bare.items() if k != "id") and bare["title"] == "" and bare["is_bot"] is False


def test_what_is_left_out(spark):
    assert made(spark, raw(type="categorize"), raw(server_name=""), raw(server_name="-gone-"), "{ no", "") == []


def test_fields_of_other_types_are_converted(spark):
    a, b, c = made(
        spark, raw(title=5, namespace="4", bot=1, minor="", length="x", comment=None, meta={"id": 7}), raw(user=True, bot="yes", minor=0, timestamp="1700000000", length={"old": "100", "new": 250.0}, namespace="none"),
        raw(timestamp=True, meta="none"),
    )
    assert (a["title"], a["namespace"], a["is_bot"], a["is_minor"], a["delta"], a["comment"], a["id"]) == ("5", 4, True, False, 0, "", "7")
    assert (b["user"], b["is_bot"], b["is_minor"], b["delta"], b["namespace"], b["ts"].timestamp()) == ("true", True, False, 150, 0, 1700000000)
    assert c["id"] is None and c["uri"] == ""
    bad = {r["value"]: r["bad"] for r in decode(spark.createDataFrame([("{",), ("[1]",), ("{}",), ("null",), ("",)], "value string").withColumn("line", F.col("value")), "line").select("value", "bad").collect()}
    assert bad == {"{": True, "[1]": False, "{}": False, "null": False, "": True}


def test_long_comment(spark):
    assert len(made(spark, raw(comment="x" * 1000))[0]["comment"]) == 280


def test_addresses(spark):
    users = {"192.168.1.1": True, "2001:db8::1": True, "Alice": False, "": False, "1.2.3": False, "999.1.1.1": True, "abc": False, None: False}
    rows = spark.createDataFrame([(u,) for u in users], "u string").select("u", looks_like_address(F.col("u")).alias("a")).collect()
    assert {r["u"]: r["a"] for r in rows} == users


def test_zero_fill(spark):
    (r,) = filled(spark.createDataFrame([("x", None)], "title string, delta bigint")).collect()
    assert (r["title"], r["delta"], r["user"], r["is_bot"], r["ts"].timestamp()) == ("x", 0, "", False, 0)


def test_messages():
    lines = [b": hello\n", b"event: message\n", b"id: 1\n", b"data: a\n", b"data:b\n", b"\n", b"\n", b"data: c\r\n", b"\r\n", b"data: end"]
    assert list(messages(iter(lines))) == ["a\nb", "c"]  # what the end cuts off is no message


def test_waits_grow_to_half_a_minute():
    assert [wait(n, 1.0) for n in (0, 1, 5, 50)] == [0.5, 1.0, 16.0, 16.0] and wait(3, 0.0) == 2.0


def test_times_of_messages():
    assert seen_at('{"timestamp": 12}', 3) == 12 and seen_at('{"meta": {"dt": "1970-01-01T00:01:00+00:00"}}', 3) == 60 and seen_at("{", 3) == 3


class Feed(BaseHTTPRequestHandler):
    asked: list[str] = []
    breaks = 0

    def do_GET(self):
        Feed.asked.append(self.path)
        if Feed.breaks > 0:
            Feed.breaks -= 1
            self.connection.close()
            return
        self.send_response(200)
        self.send_header("Content-Type", "text/event-stream")
        self.end_headers()
        for i in range(3):
            self.wfile.write(f"data: {json.dumps(raw(timestamp=1700000000 + i))}\n\n".encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def feed(monkeypatch):
    monkeypatch.setattr("tessera.sources.sse.wait", lambda failures, chance: 0.01)
    server = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/stream"
    server.shutdown()


def test_ranges_are_read_in_parts():
    r = Reader({"url": "u", "partseconds": "60"})
    spans = [(x.since, x.until) for x in r.partitions({"ms": 0}, {"ms": 150_000})]
    assert spans == [(0, 60_000), (60_000, 120_000), (120_000, 150_000)] and r.partitions({"ms": 5}, {"ms": 5}) == []
    assert 80_000 < r.latestOffset()["ms"] - r.initialOffset()["ms"] < 100_000


def test_reader_goes_on_from_the_last_time(feed):
    r = Reader({"url": feed, "readseconds": "1"})
    rows = list(r.read(Span(1_600_000_000_000, 1_800_000_000_000)))
    assert len({x for x, _ in rows}) == 4 and rows[-1] == (None, 1) or len({x for x, _ in rows if x}) == 3
    assert "since=2020-09-13T12%3A26%3A40.000Z" in Feed.asked[0] and "since=2023-11-14T22%3A13%3A22.000Z" in Feed.asked[-1]
    assert len(list(r.read(Span(1_600_000_000_000, 1_699_999_999_000)))) == 1  # a little beyond the end


def test_lost_connections_are_counted_and_tried_again(feed):
    r = Reader({"url": feed, "readseconds": "1"})
    Feed.breaks = 2
    rows = list(r.read(Span(1_600_000_000_000, 1_800_000_000_000)))
    assert rows[0][1] == 2 and sum(n for _, n in rows) >= 2
    Feed.breaks = 100
    with pytest.raises(ConnectionError):
        list(r.read(Span(1_600_000_000_000, 1_800_000_000_000)))
    Feed.breaks = 0


def test_stream_of_messages(spark, feed, tmp_path):
    spark.dataSource.register(Sse)
    q = spark.readStream.format("sse").option("url", feed).option("readSeconds", "1").load().writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path)).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            if spark.sql("SELECT count(*) FROM feed").first()[0] >= 3:
                break
            q.awaitTermination(0.5)
        assert spark.sql("SELECT count(*) FROM feed").first()[0] >= 3
    finally:
        q.stop()

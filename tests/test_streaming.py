from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from tessera import Engine, Table
from tessera.functions import sketches as S
from tessera.operators import store
from tessera.plans.presets import PRESETS, preset
from tessera.sources.edits import decode, filled, from_events
from tessera.streaming import rollup
from tessera.streaming.continuous import AFTER_ERROR, ContinuousQuery, Failure, Feed, Message, Session, applied, changes_between, difference
from tessera.streaming.ingest import Stats, deduplicated, ingest, line_figures, live_table, status

from .test_sources import Feed as Server
from .test_sources import feed, raw  # noqa: F401

NOW = 1_700_000_000.0


def edits(spark, rows):
    """rows: dicts with t, seconds before now."""
    full = [{**{"lang": "en", "title": "Page", "user": "alice", "is_bot": False, "delta": 10, "project": "wikipedia", "namespace": 0}, **r, "ts": dt.datetime.fromtimestamp(NOW - r.get("t", 0), dt.timezone.utc), "seq": i} for i, r in enumerate(rows)]
    kept = [{k: v for k, v in r.items() if k != "t"} for r in full]
    return filled(spark.createDataFrame(kept, "ts timestamp, lang string, title string, user string, is_bot boolean, delta bigint, project string, namespace bigint, seq bigint"))


def table(df, now=NOW):
    return Table(df, "ts", "seq", 900, lambda: now, ("seq",))


def test_retention(spark):
    df = edits(spark, [{"t": 1000}, {"t": 800}, {"t": 0}])
    assert store.retained(table(df), NOW).count() == 2
    many = edits(spark, [{"t": 0}] * 50)
    kept = store.retained(table(many), NOW, rows=10)
    assert kept.count() == 10 and kept.agg(F.min("seq")).first()[0] == 40


def test_feed(spark):
    df = edits(spark, [{"title": "a"}, {"is_bot": True}, {"project": "commons"}, {"namespace": 1}, {"title": "b"}])
    assert [r["title"] for r in store.recent(table(df), human_only=True).collect()] == ["b", "a"]


def test_stats(spark):
    r = store.stats(table(edits(spark, [{"t": 10 - i / 10} for i in range(100)])), NOW, started=NOW - 12.34, ingested=500).first()
    assert (r["buffered_rows"], r["total_ingested"], r["uptime"], r["oldest_age"]) == (100, 500, 12.3, 10.0) and 9.5 <= r["events_per_second"] <= 10.5
    assert store.stats(table(edits(spark, [{"t": 9}]).where("seq < 0")), NOW).first()["events_per_second"] == 0


def test_rollup(spark):
    df = edits(spark, [{"delta": 100, "t": 1}, {"delta": -40, "t": 2, "is_bot": True}, {"delta": 5, "t": 700, "user": ""}])
    got = rollup.series(rollup.rollup(df)).collect()
    assert [(r["events"], r["bots"], r["bytes_added"], r["bytes_removed"], r["distinct_users"]) for r in got] == [(1, 0, 5, 0, 0), (2, 1, 100, 40, 1)]
    assert len(rollup.series(rollup.rollup(edits(spark, [{"t": 60 * i} for i in range(30)])), 5).collect()) == 5
    whole = rollup.merged(rollup.rollup(df), 86400)
    assert whole.agg(F.sum("events")).first()[0] == 3


def test_rollup_titles(spark):
    df = edits(spark, [{"title": t, "t": 60 * i} for i, t in enumerate("aaabbc")] + [{"title": ""}] * 9 + [{"title": "b", "t": 700}])
    day = rollup.merged(rollup.rollup(df), 86400)
    assert [(r["title"], r["estimate"], r["rank"]) for r in rollup.top_titles(day, 2).orderBy("rank").collect()] == [("a", 3, 1), ("b", 3, 2)]
    assert rollup.top_titles(rollup.rollup(df.where("title = ''"))).count() == 0


def test_candidates_recover_the_top(spark):
    skewed = spark.range(50_000).select(F.concat(F.lit("page"), F.floor(F.pow(F.rand(11), 3) * 2000)).alias("x"))
    true = {r["x"] for r in S.heavy_hitters(skewed, "x", 10).collect()}
    got = S.candidates(skewed, "x", 10, 256).collect()
    assert len(true & {r["x"] for r in got}) >= 8 and [r["estimate"] for r in got] == sorted((r["estimate"] for r in got), reverse=True)


def test_distinct_sketch(spark):
    for n in (100, 10_000):
        ids = spark.range(n).select(F.concat(F.lit("item"), "id").alias("x"))
        assert abs(ids.agg(S.distinct_estimate(S.distinct_sketch("x"))).first()[0] / n - 1) < 0.03
    halves = spark.range(10_000).select((F.col("id") % 7500).alias("x"), (F.col("id") < 5000).alias("h")).groupBy("h").agg(S.distinct_sketch("x").alias("s"))
    assert abs(halves.agg(S.distinct_estimate(S.merged_distinct("s"))).first()[0] / 7500 - 1) < 0.05
    with pytest.raises(ValueError):
        S.distinct_sketch("x", 3)
    sizes = spark.range(100).agg(S.distinct_sketch("id", 10).alias("s")).union(spark.range(100).agg(S.distinct_sketch("id", 12).alias("s")))
    with pytest.raises(Exception, match="(?i)hll"):
        sizes.agg(S.merged_distinct("s")).collect()


def test_count_min(spark):
    df = spark.range(20_000).select(F.pmod(F.col("id") * F.col("id"), F.lit(503)).cast("string").alias("x"))
    true = {r["x"]: r["count"] for r in df.groupBy("x").count().collect()}
    got = {r["x"]: r["estimate"] for r in S.estimates(S.count_min(df, "x"), df, "x").collect()}
    assert got.keys() == true.keys() and all(got[k] >= true[k] for k in true)
    skewed = spark.range(15_000).select(F.when(F.col("id") < 10_000, "dominant").otherwise(F.concat(F.lit("rare"), "id")).alias("x"))
    assert tuple(S.heavy_hitters(skewed, "x", 1).first()) == ("dominant", 10_000)


def test_quantile_sketch(spark):
    df = spark.range(20_000).select((F.randn(3) * 15 + 100).alias("x"))
    exact = df.agg(F.percentile("x", F.array(*[F.lit(q) for q in (0.5, 0.9, 0.99)]))).first()[0]
    s = df.agg(S.quantile_sketch("x").alias("s"))
    assert all(abs(s.select(S.quantile("s", q)).first()[0] / e - 1) < 0.05 for q, e in zip((0.5, 0.9, 0.99), exact, strict=True))
    assert df.where("x < -1e9").agg(S.quantile_sketch("x").alias("s")).select(S.quantile("s", 0.5)).first()[0] == 0


def test_difference():
    old, new = {("a",): (1,), ("b",): (2,), ("c",): (3,)}, {("b",): (2,), ("a",): (9,), ("d",): (4,)}
    changes, order = difference(old, new)
    assert {(c.op, c.key) for c in changes} == {("set", ("a",)), ("set", ("d",)), ("remove", ("c",))} and order == list(new)
    assert applied(old, Message("q", [], changes=changes, order=order)) == new
    assert difference(new, dict(new)) == ([], None)


def test_difference_of_tables(spark):
    a, b = (spark.createDataFrame(rows, "k string, n long") for rows in ([("x", 1), ("y", 2), (None, 3)], [("x", 1), ("y", 5), ("z", 6)]))
    assert {tuple(r) for r in changes_between(a, b, ["k"]).collect()} == {("y", 5, "set"), ("z", 6, "set"), (None, None, "remove")}


def test_subscription(spark):
    rows = [{"lang": ["en", "de", "fr"][i % 3], "t": 400 - i} for i in range(60)]
    e = Engine({"edits": table(edits(spark, rows))})
    q = ContinuousQuery("q", "SELECT lang, count(*) AS n FROM edits GROUP BY lang ORDER BY n DESC", e)
    first = q.evaluate(0.0)
    assert first.rows and first.changes is None and not q.due(0.5) and q.due(60)
    assert q.evaluate(1.0) is None
    e.register("edits", table(edits(spark, [*rows, {"lang": "fr", "t": 1}, {"lang": "ja", "t": 1}])))
    second = q.evaluate(2.0)
    assert second.rows is None and {c.row for c in second.changes} == {("fr", 21), ("ja", 1)} and second.order[0] == ("fr",)
    state = applied(applied({}, first), second)
    assert list(state.values()) == [tuple(r) for r in e.run(q.sql).collect().rows]
    e.register("edits", table(edits(spark, rows), NOW + 10_000))
    q.sql += " WINDOW 5m"
    assert {c.op for c in q.evaluate(3.0).changes} == {"remove"}


def test_keys_not_shown_still_tell_rows_apart(spark):
    e = Engine({"edits": table(edits(spark, [{"lang": "en", "title": "Berlin"}, {"lang": "de", "title": "Berlin"}]))})
    m = ContinuousQuery("q", "SELECT title, count(*) AS n FROM edits GROUP BY title, lang", e).evaluate(0.0)
    assert len(m.rows) == 2 and len(set(m.keys)) == 2


def test_session(spark):
    sent = []
    now = [0.0]
    s = Session(Engine({"edits": table(edits(spark, [{}]))}), sent.append, lambda: now[0])
    assert not s.subscribe("bad", "SELECT nothing FROM edits") and isinstance(sent.pop(), Failure)
    assert s.subscribe("a", "SELECT count(*) FROM edits") and s.tick() == 1 and sent.pop().rows == [(1,)]
    assert s.tick() == 0
    now[0] = 100.0
    assert s.tick() == 1 and not sent
    s.engine.tables.clear()
    now[0] = 200.0
    s.tick()
    assert isinstance(sent[-1], Failure) and s.queries["a"].due_at == 200 + AFTER_ERROR
    s.unsubscribe("a")
    now[0] = 300.0
    assert s.tick() == 0


def test_feed_messages(spark):
    sent = []
    now = [0.0]
    s = Session(Engine({"edits": table(edits(spark, [{"title": "a"}, {"title": "b", "is_bot": True}]))}), sent.append, lambda: now[0], "edits")
    s.tick()
    (f,) = sent
    assert isinstance(f, Feed) and len(f.rows) == 2 and f.headline["edits"] == 2 and f.stats["buffered_rows"] == 2
    s.set_feed(True)
    s.tick()
    assert len(sent[1].rows) == 1
    s.tick()
    assert len(sent) == 2


def test_presets_run(spark):
    df = from_events(spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i % 9, "click", float(i), "{}") for i in range(200)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    e = Engine({"edits": Table(df, "ts", "event_id", hidden=("event_id",))})
    for name, sql in PRESETS.items():
        rows = e.run(sql).collect()
        assert rows.elapsed_ms < 10_000 and rows.columns, name
    assert preset("headline", "7d", "t").split()[-4:] == ["FROM", "t", "WINDOW", "7d"] and len(PRESETS) == 12


def test_ids_bring_duplicates_out(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "id string, n long")
    assert deduplicated(df, False).count() == 3 and deduplicated(df, False).columns == ["id", "n"]
    lines = spark.createDataFrame([(json.dumps(raw(meta={"id": i})),) for i in ("", "", "x", "x")], "value string")
    assert deduplicated(decode(lines), False).count() == 3


def test_line_figures(spark):
    df = spark.createDataFrame([(json.dumps(raw()),), ("{",), ("[1]",)], "value string")
    assert line_figures(df).first()["received"] == 3 and decode(df).where("bad").count() >= 1


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in events))


def run(spark, tmp_path, figures, **more):
    q = ingest(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), str(tmp_path / "edits"), str(tmp_path / "cp"), rollups=str(tmp_path / "rollups"), stats=figures, trigger={"availableNow": True}, **more)
    q.awaitTermination(120)
    return status(q, figures)


def test_ingest(spark, tmp_path):
    now = time.time()
    events = [raw(timestamp=now - i, meta={"id": f"e{i % 40}", "uri": "u"}) for i in range(50)] + [raw(timestamp=now, meta={"uri": "u"}), raw(timestamp=now, meta={"uri": "u", "id": ""})] + [raw(type="categorize", meta={"id": "c"})]
    write(tmp_path / "in", "a.json", [*events, "{ no JSON"])
    figures = Stats()
    seen = run(spark, tmp_path, figures)
    assert (seen["received"], seen["parse_errors"], seen["kept"], seen["connected"], seen["last_error"], seen["reconnects"]) == (54, 1, 42, False, None, 0)
    # an id counts as seen whatever kind of event had it; late and future events stay
    ids = ["e1", "c", "new", "late", "future"]
    write(tmp_path / "in", "b.json", [raw(timestamp={"late": now - 800, "future": now + 99999}.get(i, now), meta={"id": i, "uri": "u"}) for i in ids])
    write(tmp_path / "in", "c.json", [raw(timestamp=now, meta={"id": "after"})])
    seen = run(spark, tmp_path, figures)
    assert figures.kept == 46 and seen["received"] == 60 and seen["median_lag"] < 60 and not seen["backfilling"]
    e = Engine({"edits": live_table(spark, str(tmp_path / "edits"), lambda: now)})
    assert e.run("SELECT count(*) FROM edits WINDOW 15m").collect().rows == [(46,)]
    assert rollup.read(spark, str(tmp_path / "rollups")).agg(F.sum("events")).first()[0] == 46
    assert store.stats(e.tables["edits"], now).first()["total_ingested"] == 46


def test_subscriptions_see_what_is_ingested_later(spark, tmp_path):
    now, clock, sent = time.time(), [0.0], []
    table = live_table(spark, str(tmp_path / "edits"), lambda: now)
    s = Session(Engine({"edits": table}), sent.append, lambda: clock[0], "edits")
    assert s.subscribe("n", "SELECT lang, count(*) AS n FROM edits GROUP BY lang")
    s.tick()
    assert sent[0].rows == [] and sent[1].rows == []
    figures = Stats()
    for k, name in enumerate(("a.json", "b.json")):
        write(tmp_path / "in", name, [raw(timestamp=now - i, meta={"id": f"{name}{i}"}) for i in range(5)])
        run(spark, tmp_path, figures)
        clock[0] += 100
        sent.clear()
        s.tick()
        change, feed = sent
        assert change.changes[0].row == ("en", 5 * (k + 1)) and len(feed.rows) == 5 * (k + 1) and feed.stats["total_ingested"] == 5 * (k + 1)


def test_old_rows_and_files_are_dropped(spark, tmp_path, monkeypatch):
    from tessera.streaming import parts

    monkeypatch.setattr(parts, "MANY", 4)
    now, figures = time.time(), Stats()
    at = [now]
    table = live_table(spark, str(tmp_path / "edits"), lambda: at[0], rows=50)
    for k in range(8):
        write(tmp_path / "in", f"{k}.json", [raw(timestamp=at[0] - 1, meta={"id": f"{k}-{i}"}) for i in range(20)])
        run(spark, tmp_path, figures, rows=70, clock=lambda: at[0])
        at[0] += 100
    files = parts.Files(spark, str(tmp_path / "edits"))
    newest = files.newest()
    assert 70 <= newest.rows < 160 and newest.ingested == 160 and len(newest.parts) <= 5
    table.refresh()
    assert table.df.count() == 50 and table.df.agg(F.min("_arrival") > 0).first()[0] and table.ingested == 160
    assert len([x for x in (tmp_path / "edits").iterdir() if not x.name.startswith("_")]) <= len(newest.parts) + len(newest.dropped) < 9
    write(tmp_path / "in", "z.json", [raw(timestamp=now + 10_000, meta={"id": "z"})])
    at[0] = now + 10_000
    run(spark, tmp_path, figures, clock=lambda: at[0])
    table.refresh()
    assert table.df.count() == 1 and files.newest().rows == 1


def test_from_the_event_stream_to_a_query(spark, feed, tmp_path):  # noqa: F811
    """Messages of a server that breaks off are ingested once, lost connections are counted, and a query sees the edits."""
    from tessera.sources.sse import Sse

    spark.dataSource.register(Sse)
    Server.breaks, figures = 2, Stats()
    lines = spark.readStream.format("sse").option("url", feed).option("readSeconds", "1").load()
    q = ingest(lines, str(tmp_path / "edits"), str(tmp_path / "cp"), stats=figures, trigger={"processingTime": "1 second"}, age=None, rows=None)
    try:
        for _ in range(60):
            if figures.kept and status(q, figures)["reconnects"] >= 2:
                break
            q.awaitTermination(0.5)
        seen = status(q, figures)
    finally:
        q.stop()
        Server.breaks = 0
    assert seen["kept"] == 1 and seen["received"] >= 3 and seen["reconnects"] >= 2 and seen["parse_errors"] == 0 and seen["connected"]
    e = Engine({"edits": live_table(spark, str(tmp_path / "edits"), lambda: 1_700_000_005.0)})
    assert e.run("SELECT lang, title, delta FROM edits WINDOW 1m").collect().rows == [("en", "Berlin", 150)]


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    from tessera.streaming.parts import Files, Manifest, Part

    files = Files(spark, str(tmp_path / "t"))
    files.commit(Manifest(3, 10, [Part("batch=3", 10, 0.0, 1.0, 3)]))
    files.commit(Manifest(4, 15, [Part("batch=3", 10, 0.0, 1.0, 3), Part("batch=4", 5, 1.0, 2.0, 4)]))
    assert files.newest().ingested == 15 and files.newest(before=4).ingested == 10 and files.newest(before=3).rows == 0


def test_groups_brought_to_the_driver_are_bounded(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    r = Engine({"t": Table(df, None, "k")}).run("SELECT k, sum(v) AS s FROM t GROUP BY k ORDER BY k DESC")
    few = r.collect(most=10)
    assert [x for x, _ in few.rows] == list(range(999, 989, -1)) and few.truncated and "10 groups" in few.notes[-1]
    assert len(r.collect().rows) == 1000 and not r.collect().notes

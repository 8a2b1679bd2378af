"""Named queries over the test tables and, where SQL can express them, the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sketches
from .operators import store
from .operators.engine import Engine
from .plans.errors import QueryError
from .plans.presets import PRESETS, preset
from .sources.catalog import Table
from .sources.edits import decode, from_events, normalised
from .streaming import rollup
from .streaming.continuous import Failure, Session, applied, changes_between
from .streaming.ingest import deduplicated

#: Arrival order of each table, and its time where it has one.
ORDERS = {"events": ("event_id", "ts"), "lineitem": (None, "l_shipdate"), "orders": ("o_orderkey", "o_orderdate"), "customer": ("c_custkey", None), "part": ("p_partkey", None), "supplier": ("s_suppkey", None), "nation": ("n_nationkey", None), "region": ("r_regionkey", None)}


#: Tables registered so far, by application, folder and name: files are listed and the latest event is sought once, as in a service that registers its tables at the start.
_TABLES: dict[tuple[str, str, str], Table] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        source = "events" if name == "edits" else name
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        order, time = ORDERS[source]
        _TABLES[key] = Table(from_events(df), "ts", "event_id", hidden=("event_id",)) if name == "edits" else Table(df, time, order)
    return _TABLES[key]


def engine(spark: SparkSession, sf_dir: str, *names: str, approximate: bool | None = False) -> Engine:
    """An engine over the test tables; percentiles are exact, so that they can be compared, unless told otherwise."""
    return Engine({n: table(spark, sf_dir, n) for n in names}, approximate)


#: The edits table of tessera.sources.edits.from_events in SQL.
EDITS = """edits AS (SELECT event_id, ts, w AS wiki, CASE WHEN event_id % 5 < 3 THEN split_part(w, '.', 1) ELSE '-' END AS lang, split_part(w, '.', 2) AS project,
  CASE WHEN event_id % 10 = 0 THEN 'new' WHEN event_id % 10 = 1 THEN 'log' ELSE 'edit' END AS type, 'Page' || (event_id % 50) AS title, 'user' || user_id AS "user",
  event_id % 4 = 0 AS is_bot, event_id % 7 = 0 AS is_anon, event_id % 3 = 0 AS is_minor, CASE WHEN event_id % 3 = 0 THEN 14 ELSE 0 END::BIGINT AS namespace,
  d AS delta, abs(d) + 1000 AS new_len, CASE WHEN event_id % 11 = 0 THEN 'Reverted vandalism' ELSE 'copyedit' END AS comment, '' AS uri
  FROM (SELECT *, ['en.wikipedia.org', 'de.wikipedia.org', 'fr.wikipedia.org', 'www.wikidata.org', 'commons.wikimedia.org'][event_id % 5 + 1] AS w,
    floor(value * 10)::BIGINT * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS d FROM events))"""
SINCE = "ts >= (SELECT max(ts) FROM events) - INTERVAL {}"
HUMAN = "NOT is_bot AND project = 'wikipedia' AND namespace = 0"
EPOCH = "epoch_us(ts) / 1e6"

#: Name: (tables, query of the dialect, the same for DuckDB).
DIALECT: dict[str, tuple[str, str, str]] = {
    "q_flagship": ("events", "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type ORDER BY n DESC LIMIT 3 WINDOW 7d", f"SELECT event_type, count(*) AS n FROM events WHERE value > 10 AND {SINCE.format('7 DAY')} GROUP BY event_type ORDER BY n DESC, min(event_id) LIMIT 3"),
    "q_scan_star": ("events", "SELECT * FROM events", f"SELECT * REPLACE ({EPOCH} AS ts) FROM events ORDER BY event_id DESC LIMIT 200"),
    "q_project_alias": ("orders", "SELECT o_orderkey AS id, o_totalprice * 2 doubled, o_orderstatus FROM orders ORDER BY o_totalprice DESC", "SELECT o_orderkey AS id, o_totalprice * 2 AS doubled, o_orderstatus FROM orders"),
    "q_where_compare": ("lineitem", "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity >= 25 AND l_discount < 0.05 AND l_returnflag != 'R'", "SELECT count(*) AS n, round(sum(l_quantity), 6) AS q FROM lineitem WHERE l_quantity >= 25 AND l_discount < 0.05 AND l_returnflag <> 'R'"),
    "q_where_in": ("events", "SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'none') AND user_id IN (1, 2, 3, 5, 8)", "SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'none') AND user_id IN (1, 2, 3, 5, 8)"),
    "q_where_not_in": ("events", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type"),
    "q_where_bool": ("edits", "SELECT is_bot, count(*) AS n FROM edits WHERE is_anon OR NOT is_minor GROUP BY is_bot", f"WITH {EDITS} SELECT is_bot, count(*) AS n FROM edits WHERE is_anon OR NOT is_minor GROUP BY is_bot"),
    "q_where_two_valued": ("edits", "SELECT count(*) AS n FROM edits WHERE (NOT uri) AND null = null AND 'x' AND NOT 0 AND 1 != '1'", f"WITH {EDITS} SELECT count(*) AS n FROM edits"),
    "q_where_like": ("part", "SELECT p_brand, count(*) AS n FROM part WHERE p_name LIKE '%A%' OR p_type LIKE 's____%' GROUP BY p_brand", "SELECT p_brand, count(*) AS n FROM part WHERE p_name ILIKE '%A%' OR p_type ILIKE 's____%' GROUP BY p_brand"),
    "q_where_like_backslash": ("events", "SELECT count(*) AS n FROM events WHERE props NOT LIKE '%\\_%' AND props LIKE '{\"K\": %'", "SELECT count(*) AS n FROM events WHERE NOT contains(props, '\\') AND props ILIKE '{\"K\": %'"),
    "q_where_is_empty": ("edits", "SELECT count(*) AS n, sum(CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END) AS titled FROM edits WHERE uri IS NULL", f"WITH {EDITS} SELECT count(*) AS n, sum(CASE WHEN title <> '' THEN 1 ELSE 0 END)::BIGINT AS titled FROM edits WHERE uri IS NULL OR uri = ''"),
    "q_arith_div0": ("events", "SELECT event_id, value / (event_id % 3) AS d, (value + 1) * 2 - event_id AS e FROM events", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value / (event_id % 3) END AS d, (value + 1) * 2 - event_id AS e FROM events"),
    "q_mod": ("edits", "SELECT delta % 7 AS m, count(*) AS n, max(delta % 0) AS z FROM edits GROUP BY delta % 7", f"WITH {EDITS} SELECT delta % 7 AS m, count(*) AS n, 0::BIGINT AS z FROM edits GROUP BY delta % 7"),
    "q_concat": ("events", "SELECT event_type || '-' || user_id || '/' || null AS s, count(*) AS n FROM events GROUP BY s", "SELECT event_type || '-' || user_id || '/null' AS s, count(*) AS n FROM events GROUP BY s"),
    "q_case": ("events", "SELECT CASE WHEN value > 300 THEN 'high' WHEN value > 100 THEN 'middle' ELSE 'low' END AS level, count(*) AS n, max(value) AS most FROM events GROUP BY level ORDER BY n DESC", "SELECT CASE WHEN value > 300 THEN 'high' WHEN value > 100 THEN 'middle' ELSE 'low' END AS level, count(*) AS n, max(value) AS most FROM events GROUP BY level"),
    "q_case_mixed": ("events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_type END AS v FROM events ORDER BY v DESC", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE event_type END AS v FROM events"),
    "q_str_funcs": ("customer", "SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u, length(c_name) AS n FROM customer", "SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u, length(c_name) AS n FROM customer"),
    "q_substr": ("customer", "SELECT c_custkey, substr(c_name, 2, 3) AS a, substr(c_name, -4) AS b, substr(c_name, -3, 2) AS c, substr(c_name, -3, 3) AS d FROM customer", "SELECT c_custkey, substr(c_name, 3, 3) AS a, c_name[greatest(length(c_name) - 3, 1):] AS b, c_name[greatest(length(c_name) - 2, 1):length(c_name) - 1] AS c, '' AS d FROM customer"),
    "q_substr_units": ("customer", "SELECT c_custkey, length('😀' || c_name) AS n, substr('😀' || c_name, 2, 5) AS a, substr(c_name || '😀é', -3) AS b, substr('😀' || c_name, 1, 2) AS half FROM customer", "SELECT c_custkey, length(c_name) + 2 AS n, c_name[:5] AS a, '😀é' AS b, chr(65533) || c_name[:1] AS half FROM customer"),
    "q_coalesce_empty": ("edits", "SELECT coalesce(uri, null, title) AS t, count(*) AS n FROM edits GROUP BY t ORDER BY n DESC", f"WITH {EDITS} SELECT title AS t, count(*) AS n FROM edits GROUP BY t"),
    "q_round_half_up": ("events", "SELECT event_id, round(value) AS a, round(0 - value, 1) AS b, round(value, -2) AS c FROM events", "SELECT event_id, floor(value + 0.5) AS a, floor((0 - value) * 10.0 + 0.5) / 10.0 AS b, floor(value * 0.01::DOUBLE + 0.5) / 0.01::DOUBLE AS c FROM events"),
    "q_abs": ("edits", "SELECT abs(delta) AS a, count(*) AS n FROM edits GROUP BY a ORDER BY a DESC", f"WITH {EDITS} SELECT abs(delta) AS a, count(*) AS n FROM edits GROUP BY a ORDER BY a DESC"),
    "q_unary_minus": ("events", "SELECT event_id, -value AS a, -(event_id % 5) AS b, - -event_id AS c, 2 - -3 AS d FROM events", "SELECT event_id, -value AS a, -(event_id % 5) AS b, event_id AS c, 5::BIGINT AS d FROM events"),
    "q_postfix_precedence": ("events", "SELECT sum(2 + 3 IN (3)) AS s, count(*) AS n FROM events WHERE NOT event_type = 'click' AND value", "SELECT 3 * count(*)::BIGINT AS s, count(*) AS n FROM events WHERE event_type <> 'click' AND value <> 0"),
    "q_group_count": ("events", "SELECT event_type, count(*) FROM events GROUP BY event_type", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type"),
    "q_group_multi": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS q, round(avg(l_extendedprice), 3) AS p FROM lineitem GROUP BY ALL"),
    "q_group_alias_case": ("edits", "SELECT CASE WHEN is_bot THEN 'bot' ELSE 'human' END AS who, count(*) AS n FROM edits GROUP BY who", f"WITH {EDITS} SELECT CASE WHEN is_bot THEN 'bot' ELSE 'human' END AS who, count(*) AS n FROM edits GROUP BY who"),
    "q_group_no_agg": ("edits", "SELECT lang, project FROM edits GROUP BY lang, project", f"WITH {EDITS} SELECT DISTINCT lang, project FROM edits"),
    "q_group_order_first_row": ("events", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY value DESC LIMIT 2", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY min_by(value, event_id) DESC, min(event_id) LIMIT 2"),
    "q_first_appearance": ("events", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id LIMIT 25", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY min(event_id) LIMIT 25"),
    "q_count_expr": ("edits", "SELECT lang, count(uri) AS n, count() AS m FROM edits GROUP BY lang", f"WITH {EDITS} SELECT lang, count(*) AS n, count(*) AS m FROM edits GROUP BY lang"),
    "q_count_distinct": ("events", "SELECT event_type, count(distinct user_id) AS users, count_distinct(value > 100) AS two FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT value > 100) AS two FROM events GROUP BY event_type"),
    "q_sum_avg_min_max": ("events", "SELECT event_type, sum(value) AS s, avg(value) AS a, min(value) AS low, max(value) AS high, sum(value > 250) AS above FROM events GROUP BY event_type", "SELECT event_type, round(sum(value), 6) AS s, round(avg(value), 3) AS a, min(value) AS low, max(value) AS high, count(*) FILTER (value > 250) AS above FROM events GROUP BY event_type"),
    "q_empty_agg": ("events", "SELECT count(*) AS n, sum(user_id) AS s, avg(value) AS a, min(user_id) AS low, count(distinct user_id) AS d, percentile(value, 50) AS p FROM events WHERE value < 0", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, 0::DOUBLE AS a, NULL::BIGINT AS low, 0::BIGINT AS d, 0::DOUBLE AS p"),
    "q_empty_groups": ("events", "SELECT event_type, count(*) AS n FROM events WHERE value < 0 GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events WHERE value < 0 GROUP BY event_type"),
    "q_percentile": ("events", "SELECT event_type, percentile(value, 50) AS p50, percentile(value, 90) AS p90, percentile(value, 99) AS p99 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.9), 2) AS p90, round(quantile_cont(value, 0.99), 2) AS p99 FROM events GROUP BY event_type"),
    "q_agg_expr": ("events", "SELECT event_type, count(*) / 60 AS per_minute, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS size, sum(value) / count(*) AS mean FROM events GROUP BY event_type", "SELECT event_type, count(*) / 60 AS per_minute, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS size, round(sum(value), 6) / count(*) AS mean FROM events GROUP BY event_type"),
    "q_aggregate_reuse": ("events", "SELECT event_type, sum(value) / sum(value) AS one, count(*) + count() AS twice, sum(value) FROM events GROUP BY event_type ORDER BY sum(value) DESC", "SELECT event_type, 1.0::DOUBLE AS one, 2 * count(*) AS twice, round(sum(value), 6) AS sum_value FROM events GROUP BY event_type"),
    "q_order_by_agg": ("orders", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY max(o_totalprice) DESC, o_orderpriority LIMIT 3", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY max(o_totalprice) DESC, o_orderpriority LIMIT 3"),
    "q_limit_topk": ("events", "SELECT event_id, value FROM events ORDER BY value DESC LIMIT 10", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10"),
    "q_order_by_constant": ("events", "SELECT event_id FROM events ORDER BY 1, value LIMIT 10", "SELECT event_id FROM events ORDER BY value, event_id LIMIT 10"),
    "q_window_7d": ("events", "SELECT count(*) AS n, sum(value) AS s FROM events WINDOW 7d", f"SELECT count(*) AS n, round(sum(value), 6) AS s FROM events WHERE {SINCE.format('7 DAY')}"),
    "q_window_1d": ("events", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type WINDOW 1d", f"SELECT event_type, count(*) AS n FROM events WHERE {SINCE.format('1 DAY')} GROUP BY event_type"),
    "q_now": ("events", "SELECT count(*) AS n FROM events WHERE ts > now() - 5d AND ts <= now()", f"SELECT count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 5 DAY"),
}
_PRESET_SQL = {
    "hot_pages": "SELECT title, lang, count(*) AS edits, count(DISTINCT \"user\") AS editors FROM e WHERE {h} GROUP BY title, lang ORDER BY edits DESC, min(event_id) LIMIT 15",
    "busiest_langs": "SELECT lang, count(*) AS edits FROM e WHERE {h} GROUP BY lang ORDER BY edits DESC, min(event_id) LIMIT 12",
    "new_pages": "SELECT title, lang, \"user\", new_len AS bytes FROM e WHERE type = 'new' AND {h} ORDER BY ts DESC, event_id LIMIT 20",
    "big_removals": "SELECT title, lang, \"user\", delta, comment FROM e WHERE {h} AND delta < -1000 ORDER BY delta, event_id LIMIT 15",
    "reverts": "SELECT title, lang, \"user\", comment FROM e WHERE {h} AND (comment ILIKE '%revert%' OR comment ILIKE '%undo%' OR comment ILIKE '%rvv%') ORDER BY ts DESC, event_id LIMIT 15",
    "busiest_editors": "SELECT \"user\", count(*) AS edits, count(DISTINCT title) AS pages, sum(delta)::BIGINT AS net_bytes FROM e WHERE {h} GROUP BY \"user\" ORDER BY edits DESC, min(event_id) LIMIT 15",
    "anon_activity": "SELECT lang, count(*) AS anon_edits FROM e WHERE {h} AND is_anon GROUP BY lang ORDER BY anon_edits DESC, min(event_id) LIMIT 10",
    "edit_size": "SELECT count(*) AS edits, round(quantile_cont(delta, 0.5), 2) AS typical_bytes, round(quantile_cont(delta, 0.95), 2) AS large_bytes, round(quantile_cont(delta, 0.99), 2) AS huge_bytes, max(delta) AS largest FROM e WHERE {h} AND type = 'edit'",
    "bots_vs_humans": "SELECT CASE WHEN is_bot THEN 'bot' ELSE 'human' END AS editor, count(*) AS edits, count(DISTINCT \"user\") AS accounts FROM e GROUP BY editor",
    "projects": "SELECT project, count(*) AS edits FROM e GROUP BY project ORDER BY edits DESC, min(event_id) LIMIT 10",
    "headline": "SELECT count(*) AS edits, count(DISTINCT \"user\") AS editors, count(DISTINCT title) AS pages, sum(delta)::BIGINT AS net_bytes FROM e",
    "languages": "SELECT lang, count(*) AS edits FROM e WHERE lang <> '-' GROUP BY lang ORDER BY edits DESC, min(event_id) LIMIT 12",
}
#: Presets ask for minutes; the test events are sparse, so they are asked over a week.
PRESET_WINDOW = "7d"
for _id in PRESETS:
    _sql = _PRESET_SQL[_id]
    DIALECT[f"q_preset_{_id}"] = ("edits", preset(_id, PRESET_WINDOW), f"WITH {EDITS}, e AS (SELECT * FROM edits WHERE {SINCE.format('7 DAY')}) " + _sql.format(h=HUMAN))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _dialect(tables: str, sql: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir, *tables.split()).sql(sql)


for _name, (_tables, _query, _oracle) in DIALECT.items():
    QUERIES[_name], ORACLES[_name] = _dialect(_tables, _query), _oracle

#: Queries that are not about a limit or the rows usually shown: they return all rows.
WHOLE = ("q_arith_div0", "q_round_half_up", "q_str_funcs", "q_substr", "q_substr_units", "q_case_mixed", "q_project_alias", "q_unary_minus")


def _whole(tables: str, sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = engine(spark, sf_dir, *tables.split()).run(sql)
        return result.unlimited.select(*result.columns)

    return run


for _name in WHOLE:
    QUERIES[_name] = _whole(*DIALECT[_name][:2])


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("""SELECT event_type, u AS user_id, n, r AS rank FROM (SELECT event_type, user_id::VARCHAR AS u, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id::VARCHAR) AS r
FROM events GROUP BY event_type, user_id) WHERE r <= 5""")
def q_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = engine(spark, sf_dir, "events").sql("SELECT event_type, top_k(user_id, 5) AS best FROM events GROUP BY event_type")
    return lists.select("event_type", F.posexplode("best").alias("i", "x")).select("event_type", F.col("x.value").alias("user_id"), F.col("x.count").alias("n"), (F.col("i") + 1).cast("long").alias("rank"))


@query(f"WITH {EDITS} SELECT title, \"user\", delta, {EPOCH} AS ts FROM edits WHERE {HUMAN} ORDER BY event_id DESC LIMIT 20")
def q_feed_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.recent(table(spark, sf_dir, "edits"), 20, human_only=True)
    return rows.select("title", "user", "delta", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


@query("""WITH n AS (SELECT epoch_us(max(ts)) / 1e6 AS now FROM events), t AS (SELECT epoch_us(ts) / 1e6 AS t FROM events)
SELECT count(*) AS buffered_rows, count(*) AS total_ingested, round(count(*) FILTER (t >= now - 60) / least(greatest(any_value(now) - min(t) FILTER (t >= now - 60), 1.0), 60.0), 2) AS events_per_second,
round(any_value(now) - min(t), 1) AS oldest_age, round(any_value(now) - max(t), 2) AS last_event_age, 0::DOUBLE AS uptime FROM t, n""")
def q_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return store.stats(events, events.now())


@query(f"SELECT event_id FROM (SELECT event_id FROM events WHERE {SINCE.format('3 DAY')} ORDER BY event_id DESC LIMIT 500)")
def q_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return store.retained(events, events.now(), 3 * 86400, 500).select("event_id")


@query(f"""WITH {EDITS} SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS events, count(*) FILTER (is_bot) AS bots, count(*) FILTER (is_anon) AS anons,
sum(greatest(delta, 0))::BIGINT AS bytes_added, sum(greatest(-delta, 0))::BIGINT AS bytes_removed FROM edits GROUP BY 1""")
def q_rollup_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes rolled up, then merged to hours."""
    hours = rollup.merged(rollup.rollup(_edits(spark, sf_dir)), 3600)
    return hours.select(F.unix_seconds("bucket").alias("hour"), "events", "bots", "anons", "bytes_added", "bytes_removed")


@query(f"""WITH {EDITS}, b AS (SELECT epoch(date_trunc('minute', ts))::BIGINT AS minute, * FROM edits)
SELECT minute, count(*) AS events, count(*) FILTER (is_bot) AS bots, count(*) FILTER (is_anon) AS anons, sum(greatest(delta, 0))::BIGINT AS bytes_added, sum(greatest(-delta, 0))::BIGINT AS bytes_removed,
true AS users_near, true AS p50_near, true AS p99_near FROM b GROUP BY minute ORDER BY minute DESC LIMIT 180""")
def q_rollup_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 180 buckets of a minute; what their sketches say is held against the exact figures."""
    edits = _edits(spark, sf_dir)
    said = rollup.series(rollup.rollup(edits))
    exact = edits.groupBy(F.window(F.col("ts").cast("timestamp"), "60 seconds")["start"].alias("bucket")).agg(F.count_distinct(F.nullif("user", F.lit(""))).alias("users"), F.sort_array(F.collect_list("delta")).alias("deltas"))  # as long as a minute has edits

    def rank(q: float, of: str):
        below, upto = F.size(F.filter("deltas", lambda d: d < F.col(of))), F.size(F.filter("deltas", lambda d: d <= F.col(of)))
        n = F.size("deltas")
        return (below <= (q + 0.02) * n + 1) & (upto >= (q - 0.02) * n - 1)

    near = said.join(exact, "bucket").withColumn("users_near", F.abs(F.col("distinct_users") - F.col("users")) <= 0.07 * F.col("users"))
    return near.select(F.unix_seconds("bucket").alias("minute"), "events", "bots", "anons", "bytes_added", "bytes_removed", "users_near", rank(0.5, "p50_delta").alias("p50_near"), rank(0.99, "p99_delta").alias("p99_near"))


@query(f"""WITH {EDITS}, c AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS day, title, count(*) AS n FROM edits GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, title) AS rank FROM c) SELECT day, title, n AS estimate, rank FROM r WHERE rank <= 5""")
def q_rollup_title_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles that the sketches of minutes, merged to days, put first; exact where a day has fewer titles than a sketch follows."""
    days = rollup.merged(rollup.rollup(_edits(spark, sf_dir)), 86400)
    return rollup.top_titles(days, 100).where("rank <= 5").select(F.unix_seconds("bucket").alias("day"), "title", "estimate", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {EDITS}, c AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS day, title, count(*) AS n FROM edits GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, title) AS rank FROM c) SELECT day, title, n, rank FROM r WHERE rank <= 3""")
def q_rollup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rollup.titles(_edits(spark, sf_dir), bucket=86400, n=3)
    return best.select(F.unix_seconds("bucket").alias("day"), "title", F.col("count").alias("n"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 8 DAY AND ts <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY user_id),
b AS (SELECT user_id, count(*) AS n FROM events WHERE {SINCE.format('7 DAY')} GROUP BY user_id)
SELECT coalesce(b.user_id, a.user_id) AS user_id, b.n, CASE WHEN b.user_id IS NULL THEN 'remove' ELSE 'set' END AS op FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.n IS DISTINCT FROM b.n""")
def q_delta_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber is told when a day has passed."""
    e = engine(spark, sf_dir, "events")
    sql = "SELECT user_id, count(*) AS n FROM events{} GROUP BY user_id WINDOW 7d"
    now = e.tables["events"].now()
    return changes_between(e.sql(sql.format(f" WHERE ts <= {now - 86400:.6f}"), now - 86400), e.sql(sql.format("")), ["user_id"])


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, true AS near FROM lineitem GROUP BY l_returnflag")
def q_hll_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts by sketch against the exact ones: within five per cent."""
    sql = "SELECT l_returnflag, count(distinct l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag"
    near, exact = (engine(spark, sf_dir, "lineitem", approximate=a).sql(sql) for a in (True, False))
    return exact.join(near.withColumnRenamed("orders", "estimate"), "l_returnflag").select("l_returnflag", "orders", (F.abs(F.col("estimate") - F.col("orders")) <= 0.05 * F.col("orders")).alias("near"))


@query("SELECT l_returnflag, true AS p50_near, true AS p99_near FROM lineitem GROUP BY l_returnflag")
def q_percentile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by sketch, as the engine takes them unless told otherwise, against the exact ones: within half a per cent of the values' rank."""
    asked = engine(spark, sf_dir, "lineitem", approximate=None).sql("SELECT l_returnflag, percentile(l_extendedprice, 50) AS p50, percentile(l_extendedprice, 99) AS p99 FROM lineitem GROUP BY l_returnflag")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice").join(asked, "l_returnflag")
    share = lambda p: F.avg((F.col("l_extendedprice") <= F.col(p)).cast("double"))
    return rows.groupBy("l_returnflag").agg((F.abs(share("p50") - 0.5) <= 0.005).alias("p50_near"), (F.abs(share("p99") - 0.99) <= 0.005).alias("p99_near"))


@query("SELECT l_suppkey, count(*) AS n, true AS never_below, true AS near FROM lineitem GROUP BY l_suppkey")
def q_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's count by a Count-Min table of five rows against the exact one: never below it, above it by e / width of all rows at most."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    said = sketches.estimates(sketches.count_min(df, "l_suppkey"), exact, "l_suppkey").join(exact, "l_suppkey")
    return said.select("l_suppkey", "n", (F.col("estimate") >= F.col("n")).alias("never_below"), (F.col("estimate") - F.col("n") <= F.lit(2.718281828 / sketches.WIDTH * df.count())).alias("near"))


@query("SELECT true AS recovered")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether candidates of bounded memory hold at least eight of the ten most frequent users' places."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.sqrt("value")).alias("v"))
    best = sketches.heavy_hitters(df, "v", 10).select("v")
    return sketches.candidates(df, "v", 10, tracked=64).select("v").join(best, "v").agg((F.count(F.lit(1)) >= 8).alias("recovered"))


@query("SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY l_suppkey ORDER BY count DESC, l_suppkey LIMIT 10")
def q_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.heavy_hitters(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", 10)


#: Raw events made of edits: every seventh is an address's, in one of two forms.
_RAW_SQL = f"""WITH {EDITS} SELECT wiki, lang, project, type, title, CASE WHEN event_id % 14 = 0 THEN '10.0.0.' || (event_id % 250) WHEN event_id % 14 = 7 THEN '2001:db8::' || (event_id % 250) ELSE "user" END AS "user",
is_bot, event_id % 7 = 0 AS is_anon, is_minor, namespace, delta, new_len, comment, 'https://' || wiki || '/' || title AS uri, event_id::VARCHAR AS id, {EPOCH} AS ts FROM edits"""


def _raw_lines(edits: DataFrame) -> DataFrame:
    """Edits written as raw JSON events, each twice, with lines that are no JSON, and events of a kind that isn't kept."""
    i = F.col("event_id")
    user = F.when(i % 14 == 0, F.concat(F.lit("10.0.0."), (i % 250).cast("string"))).when(i % 14 == 7, F.concat(F.lit("2001:db8::"), (i % 250).cast("string"))).otherwise(F.col("user"))

    def line(kind, id):
        return F.to_json(F.struct(
            kind.alias("type"), F.col("wiki").alias("server_name"), "title", user.alias("user"), F.col("is_bot").alias("bot"), F.col("is_minor").alias("minor"), "namespace",
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
            F.struct((F.col("new_len") - F.col("delta")).alias("old"), F.col("new_len").alias("new")).alias("length"), "comment",
            F.struct(F.concat(F.lit("https://"), "wiki", F.lit("/"), "title").alias("uri"), id.alias("id")).alias("meta"),
        ))

    raw = line(F.col("type"), i.cast("string"))
    return edits.select(F.explode(F.array(raw, raw, F.lit("{ no JSON"), line(F.lit("categorize"), F.concat(F.lit("c"), i.cast("string"))))).alias("value"))


@query(_RAW_SQL)
def q_normalise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events decoded, deduplicated and normalised."""
    made = normalised(deduplicated(decode(_raw_lines(_edits(spark, sf_dir))).where("NOT bad"), False))
    return made.withColumn("ts", F.unix_micros("ts") / 1e6)


@query(f"SELECT * EXCLUDE (id) FROM ({_RAW_SQL})")
def q_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream: lines are ingested into a live table's files, and the table is read."""
    import tempfile
    import uuid

    from .streaming.ingest import ingest, live_table

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"{(shared or tempfile.mkdtemp(prefix='ingest-')).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ingest(_raw_lines(from_events(events)), f"{folder}/edits", f"{folder}/state", trigger={"availableNow": True}, age=None, rows=None).awaitTermination()
    live = live_table(spark, f"{folder}/edits", lambda: 2e9, age=2_000_000_000, rows=1 << 60)
    return live.df.drop("_arrival").withColumn("ts", F.unix_micros("ts") / 1e6)


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type ORDER BY n DESC, min(event_id)")
def q_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber has after a full message and the changes of four days, an unknown column answered on the way."""
    events = table(spark, sf_dir, "events")
    at, ticks, rows = [events.now() - 4 * 86400], [0.0], {}
    moving = Table(events.df, events.time, events.order, clock=lambda: at[0])
    session = Session(Engine({"events": moving}), lambda m: kept.append(m), lambda: ticks[0])
    kept: list = []
    session.subscribe("bad", "SELECT event_typ FROM events")
    session.subscribe("q", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC WINDOW 7d")
    for _ in range(5):
        session.tick()
        at[0] += 86400
        ticks[0] += 100
    failed, first, *later = kept
    if not isinstance(failed, Failure) or first.rows is None or any(m.rows is not None for m in later):
        raise AssertionError("one error, one full message, and changes are expected")
    for message in (first, *later):
        rows = applied(rows, message)
    return spark.createDataFrame(list(rows.values()), "event_type string, n long")


@query("WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, (SELECT count(*) > 20 FROM g) AS truncated, (SELECT count(*) > 20 FROM g) AS noted FROM g ORDER BY user_id LIMIT 20")
def q_group_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes to the driver of more groups than are allowed, and that it is said."""
    found = engine(spark, sf_dir, "events").run("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY user_id").collect(most=20)
    return spark.createDataFrame([(*r, found.truncated, any("more than 20 groups" in x for x in found.notes)) for r in found.rows], "user_id long, n long, truncated boolean, noted boolean")


#: Queries that can't be run, and the text at the place that their error points to.
ERRORS = {
    "SELECT titel FROM edits": "titel",
    "SELECT a FROM nowhere": "nowhere",
    "SELECT lang, count(*) FROM edits GROUP BY title": "lang",
    "SELECT title FROM edits WHERE count(*) > 1": "count(*)",
    "SELECT max(sum(delta)) FROM edits": "sum(delta)",
    "SELECT percentile(delta, 101) FROM edits": "101",
    "SELECT top_k(lang, 2.5) FROM edits": "2.5",
    "SELECT substr(lang) FROM edits": "substr(lang)",
    "SELECT sum() FROM edits": "sum()",
    "SELECT sum(lang) FROM edits": "sum(lang)",
    "SELECT lang > 5 FROM edits": "lang > 5",
    "SELECT lang LIKE title FROM edits": "title",
    "SELECT median(delta) FROM edits": "median",
    "SELECT lower(DISTINCT lang) FROM edits": "DISTINCT",
    "SELECT lang FROM edits; SELECT 1": ";",
    "SELECT count(*) FROM edits WINDOW 30d": "SELECT count(*) FROM edits WINDOW 30d",
}


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in ERRORS.items()) + ") AS t(sql, place)")
def q_error_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the errors of wrong queries point to; edits are kept for a week."""
    edits = table(spark, sf_dir, "edits")
    e = Engine({"edits": Table(edits.df, "ts", "event_id", 7 * 86400, edits.now, ("event_id",))})
    rows = []
    for sql in ERRORS:
        try:
            e.check(sql)
            rows.append((sql, "no error"))
        except QueryError as x:
            rows.append((sql, sql[x.start : x.end]))
    return spark.createDataFrame(rows, "sql string, place string")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_flagship"](spark, sf_dir)

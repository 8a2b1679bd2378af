"""The wiki edits table: its schema, the normaliser of raw change events, and a stand-in made of test events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns with what they mean and whether they suit grouping, the kinds of events kept, sites without a language.
COLUMNS = (
    ("ts", "timestamp", "when it was saved", False),
    ("wiki", "string", "domain of the wiki", True),
    ("lang", "string", "language, - where there is none", True),
    ("project", "string", "wikipedia, wikidata and so on", True),
    ("type", "string", "edit, new or log", True),
    ("title", "string", "title of the page", False),
    ("user", "string", "name or address of who saved it", False),
    ("is_bot", "boolean", "marked as a bot's", True),
    ("is_anon", "boolean", "the name is an address", True),
    ("is_minor", "boolean", "marked as minor", True),
    ("namespace", "bigint", "0 is an article", True),
    ("delta", "bigint", "bytes added, negative if removed", False),
    ("new_len", "bigint", "bytes afterwards", False),
    ("comment", "string", "the summary, at most 280 characters", False),
    ("uri", "string", "address of the page", False),
)
KINDS = ("edit", "new", "log")
NO_LANGUAGE = ("www", "commons", "meta", "species", "incubator")
COMMENT = 280
RAW = {
    "type": "string", "server_name": "string", "title": "string", "user": "string", "namespace": "bigint", "timestamp": "double", "comment": "string",
    "length": {"old": "bigint", "new": "bigint"}, "meta": {"uri": "string", "dt": "string", "id": "string"},
}
FLAGS = ("bot", "minor")



def schema() -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind, _, _ in COLUMNS)


def looks_like_address(user: Column) -> Column:
    """Four groups of digits, or hexadecimal digits with colons."""
    return F.coalesce(user.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | (user.rlike("^[0-9a-fA-F:]+$") & F.contains(user, F.lit(":"))), F.lit(False))


def decode(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw events of JSON lines as column ``e``, with their ``id``, null if it is empty; ``bad`` marks lines that are no JSON.

    A field of another JSON type is converted, or null where that can't be:
    flags are true unless they are false, 0 or empty.
    """
    v = F.col("_json")

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{path}", kind)

    def flag(name: str) -> Column:
        return F.coalesce(get(name, "boolean"), get(name, "double") != 0, get(name, "string") != "")

    fields = [F.struct(*[get(f"{n}.{x}", t).alias(x) for x, t in kind.items()]).alias(n) if isinstance(kind, dict) else get(n, kind).alias(n) for n, kind in RAW.items()]
    parsed = lines.withColumn("_json", F.try_parse_json(F.col(column)))
    rows = parsed.select(F.struct(*fields, *[flag(n).alias(n) for n in FLAGS]).alias("e"), v.isNull().alias("bad"), *[c for c in lines.columns if c not in (column, "e", "bad", "id", "_json")])
    return rows.withColumn("id", F.nullif(F.col("e.meta.id"), F.lit("")))


def normalised(events: DataFrame, now: Column | None = None) -> DataFrame:
    """One row for each kept event, ``id`` and the 15 columns; none is null but id.

    Kept are edits, new pages and log entries of a named server. A length
    without an old one counts as all new. A missing time is taken from the
    event's text, else from ``now``.
    """
    e = {name: F.col(f"e.{name}") for name in ("type", "server_name", "title", "user", "bot", "minor", "namespace", "timestamp", "length", "comment", "meta")}
    parts = F.split(e["server_name"], r"\.")
    n = F.size(parts)
    spoken = (n >= 3) & ~F.get(parts, F.lit(0)).isin(*NO_LANGUAGE)
    old, new = F.coalesce(e["length"]["old"], F.lit(0)), F.coalesce(e["length"]["new"], F.lit(0))
    when = F.coalesce(F.timestamp_micros((e["timestamp"] * 1e6).cast("long")), F.try_to_timestamp(e["meta"]["dt"]), now if now is not None else F.current_timestamp())
    made = {
        "ts": when,
        "wiki": e["server_name"],
        "lang": F.when(spoken, F.get(parts, F.lit(0))).otherwise("-"),
        "project": F.when(n >= 2, F.get(parts, F.lit(1))).otherwise(e["server_name"]),
        "type": e["type"],
        "title": F.coalesce(e["title"], F.lit("")),
        "user": F.coalesce(e["user"], F.lit("")),
        "is_bot": F.coalesce(e["bot"], F.lit(False)),
        "is_anon": looks_like_address(e["user"]),
        "is_minor": F.coalesce(e["minor"], F.lit(False)),
        "namespace": F.coalesce(e["namespace"], F.lit(0)),
        "delta": F.when(old != 0, new - old).otherwise(new),
        "new_len": new,
        "comment": F.substring(F.coalesce(e["comment"], F.lit("")), 1, COMMENT),
        "uri": F.coalesce(e["meta"]["uri"], F.lit("")),
    }
    kept = events.where(e["type"].isin(*KINDS) & (F.coalesce(e["server_name"], F.lit("")) != ""))
    return kept.select("id", *[c.alias(name) for name, c in made.items()])


def filled(rows: DataFrame) -> DataFrame:
    """Rows with all 15 columns: what is missing or null becomes '', 0 or false."""
    zero = {"string": F.lit(""), "boolean": F.lit(False), "bigint": F.lit(0).cast("long"), "timestamp": F.timestamp_micros(F.lit(0))}
    return rows.select(*[(F.coalesce(F.col(f"`{n}`").cast(k), zero[k]) if n in rows.columns else zero[k]).alias(n) for n, k, _, _ in COLUMNS], *[c for c in rows.columns if c not in {n for n, *_ in COLUMNS}])


def from_events(events: DataFrame) -> DataFrame:
    """An edits table made of the test events, with ``event_id`` as order of arrival."""
    i = F.col("event_id")
    wiki = F.element_at(F.array(*[F.lit(x) for x in ("en.wikipedia.org", "de.wikipedia.org", "fr.wikipedia.org", "www.wikidata.org", "commons.wikimedia.org")]), (i % 5 + 1).cast("int"))
    delta = F.floor(F.col("value") * 10).cast("long") * F.when(i % 2 == 0, 1).otherwise(-1)
    return events.select(
        i, F.col("ts"), wiki.alias("wiki"),
        F.when(i % 5 < 3, F.substring_index(wiki, ".", 1)).otherwise("-").alias("lang"),
        F.element_at(F.split(wiki, r"\."), 2).alias("project"),
        F.when(i % 10 == 0, "new").when(i % 10 == 1, "log").otherwise("edit").alias("type"),
        F.concat(F.lit("Page"), (i % 50).cast("string")).alias("title"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
        (i % 4 == 0).alias("is_bot"), (i % 7 == 0).alias("is_anon"), (i % 3 == 0).alias("is_minor"),
        F.when(i % 3 == 0, 14).otherwise(0).cast("long").alias("namespace"),
        delta.alias("delta"), (F.abs(delta) + 1000).alias("new_len"),
        F.when(i % 11 == 0, "Reverted vandalism").otherwise("copyedit").alias("comment"), F.lit("").alias("uri"),
    )

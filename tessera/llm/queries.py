"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, with_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


#: SQL for the words of a text.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query
def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import curriculum

    mixed = curriculum(read(spark, sf_dir, "documents"))
    first, last = (F.round(F.when(F.size("positions") > 0, F.element_at("positions", k)), 6) for k in (1, -1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), last.alias("last_position")).orderBy("first_position", "doc_id")


ORACLES["op4_curriculum_mix"] = rf"""
WITH d AS (SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source),
r AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER up::BIGINT AS w_up, (sum(source_size) OVER up)::BIGINT AS s_up, sum(w) OVER ()::BIGINT AS w_all
      FROM s WINDOW up AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
-- in order of size a weight, sources are at their limit until the rest, shared by weight, is within theirs
m AS (SELECT *, total - 3 * coalesce(s_up, 0) AS rest, w_all - coalesce(w_up, 0) AS shares FROM r),
l AS (SELECT max_by(rest, shares) AS rest, max(shares) AS shares FROM m WHERE w * rest <= 3 * source_size * shares),
t AS (SELECT m.source, m.source_size, m.total, m.w,
        CASE WHEN m.w * l.rest > 3 * m.source_size * l.shares THEN (3 * m.source_size)::DOUBLE ELSE l.rest::DOUBLE / l.shares * m.w END AS target FROM m, l),
c AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS whole,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN size > 0 AND whole > place THEN ceil((whole - place)::DOUBLE / source_size)::BIGINT ELSE 0 END AS copies FROM c),
-- shares go in a straight line from a to 2 * share - a, a being nearer to the natural share, both at least 0
a AS (SELECT source, source_size::DOUBLE / sum(source_size) OVER () - target / sum(target) OVER () AS away, target / sum(target) OVER () AS share, sum(target) OVER () AS words FROM t),
k AS (SELECT *, least(1.0, min(CASE WHEN away <> 0 THEN share / abs(away) END) OVER ()) AS step FROM a),
z AS (SELECT source, words, share + step * away AS a, ((share - step * away) - (share + step * away)) / 2 AS bend FROM k),
y AS (SELECT n.*, z.a, z.bend, place / greatest(z.words, 1.0) AS need1, ((copies - 1) * n.source_size + place) / greatest(z.words, 1.0) AS need2 FROM n JOIN z ON n.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN copies > 0 THEN (copies - 1) * size + least(size, whole - (copies - 1) * source_size - place) ELSE 0 END AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN need1 <= 0 THEN 0 ELSE 2 * need1 / (a + sqrt(greatest(a * a + 4 * bend * need1, 0))) END, 6) END AS first_position,
  CASE WHEN copies > 0 THEN round(CASE WHEN need2 <= 0 THEN 0 ELSE 2 * need2 / (a + sqrt(greatest(a * a + 4 * bend * need2, 0))) END, 6) END AS last_position
FROM y"""


@query
def op3_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    judged = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLES["op6_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
c AS (SELECT x FROM g GROUP BY x HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN c USING (x) JOIN g b USING (x) WHERE a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)),
reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN least ON doc_id = a"""


@query
def op2_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import digests

    return digests(read(spark, sf_dir, "documents"))


ORACLES["op2_debruijn_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM v),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1 AS again FROM k),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT x.*, coalesce(bool_or(f.again) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
      FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.s = x.i),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""


@query
def op9_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(read(spark, sf_dir, "documents"))


@query
def op10_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


@query
def op8_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find, fit

    docs = read(spark, sf_dir, "documents")
    return find(docs, fit(docs))


@query
def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import load, store

    read_back = load(store(read(spark, sf_dir, "documents")))
    return read_back.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import inherit, scan

    # documents have no paths: a source is a repository with a directory for each language
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(".txt")))
    return inherit(scan(read(spark, sf_dir, "documents"), path))


@query
def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import reply_ordered

    return reply_ordered(read(spark, sf_dir, "conversations"))


_OWN = r"""(list_filter(lines, lambda x, i: len(regexp_replace(regexp_extract(x, '^(?:[\x20\t]*>)+'), '[^>]', '', 'g')) = 0
  AND NOT (regexp_matches(x, '(?i)(?:wrote|writes|schrieb|a écrit|écrit|escribió)[\x20\t]*:[\x20\t\r]*$') AND regexp_matches(coalesce(lines[i + 1], ''), '^(?:[\x20\t]*>)+'))))"""
_NORMAL = r"trim(regexp_replace(lower(TEXT), '[\x20\x09-\x0D]+', ' ', 'g'))"
# no lookbehind there: a mark and the space after it become a mark and a line end, at which is split
_SENTENCES = r"list_distinct(list_filter(string_split(regexp_replace(" + _NORMAL + r", '([.!?])[\x20]', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '[\p{L}\p{N}]')))"
ORACLES["op7_quotation_linking"] = rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS lines FROM conversations),
o AS (SELECT conv_id, turn, role, CASE WHEN contains(text, '>') THEN trim(array_to_string({_OWN}, chr(10)), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE text END AS own FROM m),
l AS (SELECT conv_id, turn, md5(text) AS k, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT DISTINCT conv_id, turn, text, lines FROM m WHERE contains(text, '>'))),
d AS (SELECT *, len(regexp_replace(regexp_extract(line, '^(?:[\x20\t]*>)+'), '[^>]', '', 'g')) AS depth FROM l),
n AS (SELECT *, (lag(depth, 1, -1) OVER w <> depth)::INT AS fresh FROM d WINDOW w AS (PARTITION BY conv_id, turn, k ORDER BY i)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn, k ORDER BY i) AS passage FROM n),
p AS (SELECT conv_id, turn, k, passage, depth, string_agg(regexp_replace(line, '^(?:[\x20\t]*>)+', ''), chr(10) ORDER BY i) AS said FROM r WHERE depth > 0 GROUP BY ALL),
q AS (SELECT conv_id, turn, k, passage, depth, unnest({_SENTENCES.replace("TEXT", "said")}) AS s FROM p),
f AS (SELECT conv_id, s, min(turn) AS source FROM (SELECT conv_id, turn, unnest({_SENTENCES.replace("TEXT", "own")}) AS s FROM o WHERE own IS NOT NULL) GROUP BY ALL),
v AS (SELECT q.conv_id, turn, k, passage, depth, source, count(*) AS votes FROM q JOIN f ON q.conv_id = f.conv_id AND q.s = f.s WHERE source < turn GROUP BY ALL),
b AS (SELECT conv_id, turn, k, passage, depth, max([votes, source]) AS best FROM v GROUP BY ALL),
t AS (SELECT conv_id, turn, max([-depth, best[1], best[2]])[3] AS parent, count(*) AS linked FROM b GROUP BY ALL),
up AS (SELECT conv_id, turn, parent AS root, 1 AS level FROM t UNION ALL SELECT up.conv_id, up.turn, t.parent, level + 1 FROM up JOIN t ON t.conv_id = up.conv_id AND t.turn = up.root),
h AS (SELECT conv_id, turn, min(root) AS root, max(level) AS level FROM up GROUP BY ALL)
SELECT o.conv_id, o.turn, o.role, o.own AS text, t.parent::BIGINT AS parent_turn, coalesce(h.root, o.turn)::BIGINT AS root_turn, coalesce(h.level, 0)::BIGINT AS level, coalesce(t.linked, 0)::BIGINT AS linked_passages
FROM o LEFT JOIN t ON o.conv_id = t.conv_id AND o.turn = t.turn LEFT JOIN h ON o.conv_id = h.conv_id AND o.turn = h.turn"""

"""Per-minute rollups of edits with mergeable sketches, in batches and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sketches as S

#: Seconds of a bucket, buckets kept, registers of the users' sketch, titles that a bucket's sketch follows.
BUCKET, KEPT, USERS_P, TITLES = 60, 180, 11, 1024


def rollup(edits: DataFrame, time: str = "ts", bucket: int = BUCKET) -> DataFrame:
    """One row a bucket of event time; empty users and titles don't count. Works on streams in update mode as well."""
    start = F.window(F.col(time).cast("timestamp"), f"{bucket} seconds")["start"]
    user = F.when(F.col("user") != "", F.col("user"))
    return edits.groupBy(start.alias("bucket")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("is_bot").alias("bots"),
        F.count_if("is_anon").alias("anons"),
        F.sum(F.greatest(F.col("delta"), F.lit(0))).alias("bytes_added"),
        F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("bytes_removed"),
        S.distinct_sketch(user, USERS_P).alias("users"),
        S.quantile_sketch(F.col("delta").cast("double")).alias("deltas"),
        S.frequent_sketch("nullif(title, '')", TITLES).alias("titles"),
    )


def top_titles(rollups: DataFrame, n: int = 40) -> DataFrame:
    """(bucket, title, estimate, rank): the n titles of each bucket that its sketch puts first, ties by title."""
    found = rollups.select("bucket", F.explode(S.frequent("titles", n)).alias("t")).select("bucket", F.col("t.item").alias("title"), F.col("t.count").alias("estimate"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("estimate"), F.asc("title"))))


def titles(edits: DataFrame, time: str = "ts", bucket: int = BUCKET, n: int = 40) -> DataFrame:
    """The n most edited titles of each bucket, exactly: (bucket, title, count, rank)."""
    start = F.window(F.col(time).cast("timestamp"), f"{bucket} seconds")["start"]
    counts = edits.where("title <> ''").groupBy(start.alias("bucket"), "title").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("count"), F.asc("title")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def series(rollups: DataFrame, buckets: int = KEPT) -> DataFrame:
    """The latest buckets in order, with figures in place of sketches."""
    latest = rollups.orderBy(F.desc("bucket")).limit(buckets)
    return latest.select(
        "bucket", "events", "bots", "anons", "bytes_added", "bytes_removed",
        S.distinct_estimate("users").alias("distinct_users"),
        F.round(S.quantile("deltas", 0.5), 1).alias("p50_delta"),
        F.round(S.quantile("deltas", 0.99), 1).alias("p99_delta"),
    ).orderBy("bucket")


def merged(rollups: DataFrame, seconds: int) -> DataFrame:
    """Rollups of longer buckets made of shorter ones."""
    start = F.window("bucket", f"{seconds} seconds")["start"]
    return rollups.groupBy(start.alias("longer")).agg(
        *[F.sum(c).alias(c) for c in ("events", "bots", "anons", "bytes_added", "bytes_removed")],
        S.merged_distinct("users").alias("users"),
        S.merged_quantiles("deltas").alias("deltas"),
        S.merged_frequent("titles", TITLES).alias("titles"),
    ).withColumnRenamed("longer", "bucket")


def upsert(path: str, batch: DataFrame) -> None:
    """For ``foreachBatch``: buckets of a batch join those of before. A bucket's parts lie side by side and are merged when read."""
    batch.write.mode("append").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Rollups written by ``upsert``, their parts merged."""
    return merged(spark.read.parquet(path), BUCKET)

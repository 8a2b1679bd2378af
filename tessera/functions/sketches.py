"""Mergeable sketches of distinct values, frequencies and quantiles, made by Spark's aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch (as a power of two): least, most, usual; rows and columns of a frequency sketch.
LEAST_P, MOST_P, USUAL_P = 4, 16, 12
DEPTH, WIDTH = 5, 2048


def distinct_sketch(column: Column | str, p: int = USUAL_P) -> Column:
    """A HyperLogLog sketch of 2**p registers; nulls don't count."""
    if not LEAST_P <= p <= MOST_P:
        raise ValueError(f"p must be from {LEAST_P} to {MOST_P}, not {p}")
    return F.hll_sketch_agg(column, p)


def merged_distinct(sketches: Column | str) -> Column:
    """The union of sketches; Spark refuses to join those of different size."""
    return F.hll_union_agg(sketches, False)


def distinct_estimate(sketch: Column | str) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_sketch(column: Column | str) -> Column:
    """A KLL sketch of numbers."""
    return F.kll_sketch_agg_double(column)


def merged_quantiles(sketches: Column | str) -> Column:
    return F.kll_merge_agg_double(sketches)


def quantile(sketch: Column | str, q: float) -> Column:
    """The value at share q, 0 for an empty sketch."""
    n = F.kll_sketch_get_n_double(sketch)
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))).otherwise(0.0)


def count_min(df: DataFrame, column: str, depth: int = DEPTH, width: int = WIDTH, by: tuple[str, ...] = ()) -> DataFrame:
    """A Count-Min sketch as a table (row, cell, n) for each group: adding tables up merges them."""
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: F.struct(r.alias("row"), _cell(F.col(column), r, width).alias("cell"))))
    return df.where(F.col(column).isNotNull()).select(*by, cells.alias("c")).groupBy(*by, "c.row", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def _cell(value: Column, row: Column, width: int) -> Column:
    return F.pmod(F.xxhash64(value, row), F.lit(width))


def estimates(sketch: DataFrame, values: DataFrame, column: str, width: int = WIDTH) -> DataFrame:
    """Each value's count by the sketch: never below the truth."""
    asked = values.select(column).distinct().join(sketch, _cell(F.col(column), F.col("row"), width) == F.col("cell"))
    return asked.groupBy(column).agg(F.min("n").alias("estimate"))


def frequent_sketch(expression: str, tracked: int) -> Column:
    """A sketch of the most frequent values: at most so many candidates with their counts; nulls don't count."""
    return F.expr(f"approx_top_k_accumulate({expression}, {tracked}) FILTER (WHERE ({expression}) IS NOT NULL)")


def merged_frequent(sketches: str, tracked: int) -> Column:
    return F.expr(f"approx_top_k_combine({sketches}, {tracked})")


def frequent(sketch: str, n: int) -> Column:
    """The n candidates with the highest counts, as an array of (item, count)."""
    return F.expr(f"approx_top_k_estimate({sketch}, {n})")


def candidates(df: DataFrame, column: str, n: int, tracked: int = 4096, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(value, estimate): the n heaviest values of bounded memory. Candidates come from a sketch of the most frequent, their counts from a Count-Min table."""
    sketch = df.agg(frequent_sketch(f"`{column}`", tracked).alias("s"))
    found = sketch.select(F.explode(frequent("s", min(2 * n, tracked))).alias("t")).select(F.col("t.item").alias(column))
    return estimates(count_min(df, column, depth, width), found, column, width).orderBy(F.desc("estimate"), F.asc(column)).limit(n)


def heavy_hitters(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values and their exact counts, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(column)).limit(n)

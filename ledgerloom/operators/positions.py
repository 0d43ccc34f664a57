"""Ordinals and running totals over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is dealt into: one for each so many bytes of the files behind it, within these numbers. Their
#: sums are a table of so many rows.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 256 << 20, 256, 20_000

#: What the optimizer says of the size of a table that it knows nothing of, at least.
UNKNOWN = 1 << 60

#: Ranges that null keys are dealt into.
NULL_RANGES = 64


def size_in_bytes(df: DataFrame) -> int:
    """Of the tables that df reads, as the optimizer knows them; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)


def bounds_of(df: DataFrame, key: str) -> Column:
    """An array of the numeric key's approximate quantiles: bounds of ranges of similar numbers of rows."""
    ranges = min(max(LEAST_RANGES, size_in_bytes(df) // RANGE_BYTES), MOST_RANGES)
    cuts = df.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    return F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")


def range_of(bounds: Column, key: Column) -> Column:
    return F.size(F.filter(bounds, lambda c: c <= key))


def with_positions(df: DataFrame, key: str, ties: Sequence[str] = (), ordinal: str | None = "ordinal", before: Mapping[str, Column] | None = None) -> DataFrame:
    """df with its 0-based place in the order of (key, ties) and, for each name in `before`, the sum over all earlier rows.

    The numeric key's approximate quantiles cut the table into ranges of similar size, the more the larger it is. Each
    range is numbered by a window of its own, and starts where the ranges before it end. Null keys come first; unless ties
    order them, they are dealt by a hash of the row.
    """
    before = dict(before or {})
    null = F.lit(-1) if ties else -1 - F.pmod(F.xxhash64(*df.columns), F.lit(NULL_RANGES)).cast("int")
    dealt = df.withColumn("_range", F.when(F.col(key).isNull(), null).otherwise(range_of(bounds_of(df, key), F.col(key))))
    window = Window.partitionBy("_range").orderBy(key, *ties)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("_at", (F.row_number().over(window) - 1).cast("long"))
    for i, value in enumerate(before.values()):
        numbered = numbered.withColumn(f"_sum{i}", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_t{i}") for i, v in enumerate(before.values())])
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(ranges), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_t{i}").over(ranges), F.lit(0)).alias(f"_s{i}") for i in range(len(before))]
    )
    joined = numbered.join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    out = {ordinal: F.col("_at") + F.col("_n0")} if ordinal else {}
    out |= {name: F.col(f"_sum{i}") + F.col(f"_s{i}") for i, name in enumerate(before)}
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])

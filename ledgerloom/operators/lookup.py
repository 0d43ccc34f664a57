"""Index lookups as joins: by ordinal, key, two layers, order and interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import bounds_of, range_of


def build_index(df: DataFrame, key: str, ordinal: str = "ordinal", offset: str = "offset") -> DataFrame:
    """(key, ordinal, offset), with an error where a key stands twice."""
    once = Window.partitionBy(key)
    checked = df.withColumn("_n", F.count("*").over(once))
    return checked.select(F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key"))).otherwise(F.col(key)).alias(key), ordinal, offset)


def newest(df: DataFrame, *key: str, by: list[Column]) -> DataFrame:
    """The first row of each key in the order `by`."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("_rank = 1").drop("_rank")


def hot_or_cold(probes: DataFrame, hot: DataFrame, cold: DataFrame, on: str, value: str) -> DataFrame:
    """probes with `value` from hot where it has the key, else from cold, else null."""
    h, c = hot.select(on, F.col(value).alias("_hot")), cold.select(on, F.col(value).alias("_cold"))
    return probes.join(h, on, "left").join(c, on, "left").withColumn(value, F.coalesce("_hot", "_cold")).drop("_hot", "_cold")


def forward_asof(probes: DataFrame, table: DataFrame, probe: str, key: str, value: str) -> DataFrame:
    """probes with the `value` of the first row of table whose key is at least the probe; null beyond the last.

    Keys and probes are integers. Both are dealt by ranges of keys, as many as the table's size asks for; within a range
    the next key comes from a window over keys and probes together, and a probe beyond its range's last key takes the
    first key of the ranges after it, from a table of one row per range.
    """
    bounds = bounds_of(table.select(F.col(key).cast("long").alias("_k")), "_k")
    hit = F.struct(F.col(key).cast("long").alias("k"), F.col(value).alias("v"))
    rows = table.select(F.col(key).cast("long").alias("_k"), F.lit(1).alias("_side"), hit.alias("_hit"))
    asked = probes.withColumn("_k", F.col(probe).cast("long")).withColumn("_side", F.lit(0))
    both = asked.unionByName(rows, allowMissingColumns=True).withColumn("_range", range_of(bounds, F.col("_k")))
    # From the largest key down: a frame that grows costs one step a row, one that shrinks would start anew for each.
    ahead = Window.partitionBy("_range").orderBy(F.col("_k").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_next", F.last("_hit", ignorenulls=True).over(ahead)).where("_side = 0")
    # A range's bound is its smallest key, so that the first key after range r is the bound r itself; its value is looked up.
    firsts = rows.withColumn("_range", range_of(bounds, F.col("_k"))).groupBy("_range").agg(F.min("_hit").alias("_first"))
    later = firsts.select((F.col("_range") - 1).alias("_of"), F.col("_first").alias("_later"))
    found = near.join(F.broadcast(later), F.col("_range") == F.col("_of"), "left")
    return found.select(*probes.columns, F.coalesce("_next", "_later")["v"].alias(value))


def ancestor_by_parents(probes: DataFrame, headers: DataFrame, distance: str, most_non_canonical: int, number: str = "number", hash_: str = "hash", parent: str = "parent_hash", canonical: str = "canonical") -> DataFrame:
    """probes (number, hash, distance) with ancestor_number and ancestor_hash; null where there is none.

    From a canonical header the ancestor is a subtraction and a join on the canonical chain. From another one the walk goes
    to the parent, at most most_non_canonical times: each turn is one equi-join of all probes that are still off the chain,
    so that turns are as many as the longest side chain, not as probes. headers: number, hash, parent_hash, canonical.
    """
    names = probes.columns
    chain = headers.where(F.col(canonical)).select(F.col(number).alias("_number"), F.col(hash_).alias("_hash"))
    known = headers.select(F.col(number).alias("_n"), F.col(hash_).alias("_h"), F.col(parent).alias("_p"), F.col(canonical).alias("_on"))
    walk = probes.withColumns({"_at": F.col(number), "_by": F.col(hash_), "_left": F.col(distance), "_done": F.col(distance) > F.col(number)})
    for turn in range(most_non_canonical + 1):
        met = walk.join(known, (F.col("_at") == F.col("_n")) & (F.col("_by") == F.col("_h")), "left")
        still = ~F.col("_done") & (F.col("_left") > 0)
        lost = still & F.col("_n").isNull()
        step = still & F.col("_n").isNotNull() & ~F.col("_on")
        stop = F.col("_done") | lost | (step & F.lit(turn == most_non_canonical))
        walk = met.select(
            *names,
            F.when(step, F.col("_at") - 1).otherwise(F.col("_at")).alias("_at"),
            F.when(step, F.col("_p")).otherwise(F.col("_by")).alias("_by"),
            F.when(step, F.col("_left") - 1).otherwise(F.col("_left")).alias("_left"),
            stop.alias("_done"),
        )
    on = walk.withColumn("_target", F.when(~F.col("_done"), F.col("_at") - F.col("_left")))
    found = on.join(chain, F.col("_target") == F.col("_number"), "left")
    # Without steps left the walk itself has arrived, on the chain or off it.
    hash_found = F.when(F.col("_target").isNotNull(), F.when(F.col("_left") == 0, F.col("_by")).otherwise(F.col("_hash")))
    return found.select(*names, F.when(hash_found.isNotNull(), F.col("_target")).alias("ancestor_number"), hash_found.alias("ancestor_hash"))


def ancestor(probes: DataFrame, headers: DataFrame, distance: str, number: str = "number") -> DataFrame:
    """On the canonical chain an ancestor is a subtraction and a join."""
    back = headers.select(F.col(number).alias("ancestor_number"), F.col("hash").alias("ancestor_hash"))
    return probes.withColumn("ancestor_number", F.col(number) - F.col(distance)).join(back, "ancestor_number", "left")

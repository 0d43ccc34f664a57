"""Versioned key/value state: changes (key, tx, step, value), an empty value being a deletion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import newest
from .positions import with_positions

#: A change at transaction t is seen by reads at later transactions only: as of ts, changes of tx < ts count.
AS_OF_INCLUDES_OWN = False


def latest(changes: DataFrame) -> DataFrame:
    """The newest change of each key: partial maxima in every task, one row per key."""
    return changes.groupBy("key").agg(F.max(F.struct("tx", "step", "value")).alias("c")).select("key", "c.*")


def visible_hot(hot: DataFrame, cold_end: int, step_size: int) -> DataFrame:
    """The newest hot change of each key, if the last transaction of its step is not before the end of the files."""
    return latest(hot).where((F.col("step") + 1) * step_size - 1 >= cold_end)


def get_latest(hot: DataFrame, cold: DataFrame, cold_end: int, step_size: int) -> DataFrame:
    """(key, tx, step, value): from the hot store where it is visible, else from files; deletions are left out."""
    h, c = visible_hot(hot, cold_end, step_size), latest(cold)
    both = h.withColumn("_first", F.lit(1)).unionByName(c.withColumn("_first", F.lit(0)))
    best = both.groupBy("key").agg(F.max(F.struct("_first", "tx", "step", "value")).alias("c"))
    return best.select("key", "c.tx", "c.step", "c.value").where(F.col("value") != "")


def as_of(changes: DataFrame, tx: int) -> DataFrame:
    """The state before transaction tx; keys created later or deleted are absent."""
    before = F.col("tx") <= tx if AS_OF_INCLUDES_OWN else F.col("tx") < tx
    return latest(changes.where(before)).where(F.col("value") != "")


def history(changes: DataFrame) -> DataFrame:
    """Each change with the value before it; empty if there was none."""
    return changes.withColumn("previous", F.coalesce(F.lag("value").over(Window.partitionBy("key").orderBy("tx")), F.lit("")))


def upsert(changes: DataFrame) -> DataFrame:
    """What a flush stores: of each key and step the last value."""
    return newest(changes, "key", "step", by=[F.col("tx").desc()])


def collate(changes: DataFrame, step: int) -> DataFrame:
    return newest(changes.where(F.col("step") == step), "key", by=[F.col("tx").desc()])


def collate_large(changes: DataFrame, start: int, end: int, value: Callable[[Column, int, int], Column] | None = None) -> DataFrame:
    """(key, value) of the changes of [start, end), for values too large to be kept in versions: a key that stands twice is
    an error. `value` transforms each value, given the range."""
    rows = changes.where((F.col("tx") >= start) & (F.col("tx") < end))
    grouped = rows.groupBy("key").agg(F.count("*").alias("_n"), F.max("value").alias("value"))
    key = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col("key").cast("string")))).otherwise(F.col("key"))
    return grouped.select(key.alias("key"), (value(F.col("value"), start, end) if value else F.col("value")).alias("value"))


def prune(changes: DataFrame, step: int, limit: int = 0, resume: int | None = None) -> tuple[DataFrame, int | None]:
    """The rows that pruning deletes, and the key to resume from (None: nothing is left): changes of steps up to `step`, in
    the order of keys, a key's newest first, from the key `resume` on; as many as `limit`, 0 being no limit.

    Places in that order come from ranges of keys, so no task sorts more than its range.
    """
    old = changes.where(F.col("step") <= step)
    if resume is not None:
        old = old.where(F.col("key") >= resume)
    if not limit:
        return old, None
    dated = old.withColumns({"_step": -F.col("step"), "_tx": -F.col("tx")})
    placed = with_positions(dated, "key", ties=("_step", "_tx"), ordinal="_place")
    after = placed.where(F.col("_place") == limit).select("key").first()
    return placed.where(F.col("_place") < limit).select(*changes.columns), after and after[0]


def unwind(changes: DataFrame, tx: int) -> DataFrame:
    """Keys changed at tx or later, with the value to put back; empty: delete."""
    first = history(changes).where(F.col("tx") >= tx).groupBy("key").agg(F.min(F.struct("tx", "previous")).alias("f"))
    return first.select("key", F.col("f.tx").alias("tx"), F.col("f.previous").alias("restored"))

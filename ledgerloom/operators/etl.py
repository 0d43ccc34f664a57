"""Collect, sort and merge: the policies for equal keys, and sorted loads into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract_range(df: DataFrame, key: str, start, end=None) -> DataFrame:
    """Rows of [start, end); no end, no bound."""
    found = df.where(F.col(key) >= start)
    return found if end is None else found.where(F.col(key) < end)


def append_values(df: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """All values of a key joined in order of arrival."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["v"]), "").alias("value"))


def oldest(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias("value"))


def last(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias("value"))


def load_merge(target: DataFrame, changes: DataFrame, key: str, value: str, empty_values: bool = False) -> DataFrame:
    """target after changes: new keys come, present ones get the new value. A null value deletes, or with
    empty_values puts an empty one."""
    new = changes.select(key, F.col(value).alias("_new"), F.lit(True).alias("_changed"))
    merged = target.join(new, key, "full")
    put = F.coalesce("_new", F.lit("")) if empty_values else F.col("_new")
    result = merged.withColumn(value, F.when(F.col("_changed"), put).otherwise(F.col(value))).drop("_new", "_changed")
    return result if empty_values else result.where(F.col(value).isNotNull())


def transform(df: DataFrame, key: str, extract: Callable[[], Column], load: Callable[[DataFrame], DataFrame], start=None, end=None) -> DataFrame:
    """Extract, sort and load with the user's functions: of the rows of a range, `extract` gives an array of entries (any
    number for each row) as a column; `load` gets the entries as a table, and its result comes in the order of the keys."""
    rows = df if start is None else extract_range(df, key, start, end)
    entries = rows.select(F.explode(extract()).alias("e")).select("e.*")
    loaded = load(entries)
    return loaded.repartitionByRange(loaded.columns[0]).sortWithinPartitions(loaded.columns[0])


def identity(entries: DataFrame) -> DataFrame:
    """The load function that changes nothing."""
    return entries


def walk(words: DataFrame, visit: Callable[[bytes, bool], list[tuple]], schema: str, word: str = "word", compressed: str = "compressed") -> DataFrame:
    """What a user's function gives for each (word, compressed): any number of rows. It runs in tasks, a batch at a time."""

    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(",")]
        for pdf in batches:
            rows = [r for w, c in zip(pdf[word], pdf[compressed], strict=True) for r in visit(bytes(w), bool(c))]
            yield pd.DataFrame(rows, columns=names)

    return words.select(word, compressed).mapInPandas(visited, schema)

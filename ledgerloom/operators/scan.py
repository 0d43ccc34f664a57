"""Segments as DataFrames: words by ordinal and offset, key/value pairs, pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import with_positions


def segment(df: DataFrame, key: str, word: Column) -> DataFrame:
    """df as a segment: word (binary, never null), length, ordinal and offset in the order of key."""
    words = df.withColumn("word", F.coalesce(word, F.lit(b""))).withColumn("length", F.octet_length("word").cast("long"))
    return with_positions(words, key, before={"offset": F.col("length")})


def from_offset(words: DataFrame, offset: int) -> DataFrame:
    return words.where(F.col("offset") >= offset)


def segment_stats(words: DataFrame, *by: str) -> DataFrame:
    sizes = [F.count("*").alias("n_words"), F.count_if(F.col("length") == 0).alias("n_empty"), F.sum("length").alias("n_bytes"), F.max("length").alias("longest")]
    return words.groupBy(*by).agg(*sizes)


def pairs(words: DataFrame) -> DataFrame:
    """Words of even ordinal as keys, each with the word after it as value. A last key without a value has null."""
    halves = words.select(F.floor(F.col("ordinal") / 2).alias("pair"), (F.col("ordinal") % 2).alias("half"), "word")
    return halves.groupBy("pair").agg(F.max(F.when(F.col("half") == 0, F.col("word"))).alias("key"), F.max(F.when(F.col("half") == 1, F.col("word"))).alias("value"))


def pages(entries: DataFrame, size: int, ordinal: str = "ordinal", *fields: str) -> DataFrame:
    """Entries gathered into pages of `size`, in order; a page is an array of structs."""
    entry = F.struct(ordinal, *fields)
    return entries.groupBy(F.floor(F.col(ordinal) / size).alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def paged_scan(paged: DataFrame) -> DataFrame:
    return paged.select("page", F.posexplode("entries").alias("at", "entry")).select("page", "at", "entry.*")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once, with the count of rows beyond the first."""
    return df.groupBy(*key).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def visible_files(manifest: DataFrame) -> DataFrame:
    """Files not contained in another: in order of (start, end descending), those that end beyond all before them."""
    window = Window.partitionBy("kind").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("_reach", F.max("end").over(window)).where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def checked_files(files: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The files that a user's check against other kinds of files keeps: a function of the table of files, so a join or a
    predicate, which must not change its columns."""
    kept = check(files)
    if kept.columns != files.columns:
        raise ValueError("a check of files keeps their columns")
    return kept

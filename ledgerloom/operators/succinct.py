"""Monotone sequences: split as Elias-Fano stores them, and searched as tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Fixed values of the stored form: the count less one and the largest value plus one, big-endian, then words of 64 bits,
# little-endian: lower bits (and a word besides), upper bits, and a directory of the upper part, which has for every
# SUPER values the place of the first one's bit in a word, and the distance from it for every BLOCK in half a word.
PAIR = struct.Struct(">QQ")
BLOCK, SUPER = 1 << 8, 1 << 14


def stats(values: DataFrame, value: str = "value", *by: str) -> DataFrame:
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def low_bits(n: Column, most: Column) -> Column:
    """Width of the stored lower parts: the whole logarithm of (largest + 1) / count; 0 for a dense sequence."""
    ratio = F.floor((most + 1) / n)
    return F.when(ratio <= 1, 0).otherwise(F.length(F.bin(ratio)) - 1)


def split(values: DataFrame, *by: str) -> DataFrame:
    """values (by, i, value) with low, the lower bits, and high, the place of the one bit of the unary upper part."""
    sized = values.join(stats(values, "value", *by), list(by))
    width = sized.withColumn("width", low_bits(F.col("n"), F.col("most")).cast("int"))
    power = F.expr("shiftleft(1L, width)")
    return width.select(*by, "i", "value", "width", (F.col("value") % power).alias("low"), (F.floor(F.col("value") / power) + F.col("i")).alias("high"))


def neighbours(values: DataFrame, *by: str) -> DataFrame:
    """Each value with the one after it (null after the last) and what it is above the one before."""
    window = Window.partitionBy(*by).orderBy("i")
    return values.withColumn("following", F.lead("value").over(window)).withColumn("delta", F.col("value") - F.lag("value").over(window))


def seek(values: DataFrame, probes: DataFrame, by: list[str], reverse: bool = False) -> DataFrame:
    """For each probe x the first value of at least x; reverse: the last of at most x; null if there is none.

    Values and probes of a sequence are sorted together once; no pair of them is made.
    """
    rows = values.select(*by, F.col("value").alias("_k"), F.lit(0 if reverse else 1).alias("_side"), F.col("value").alias("_hit"))
    both = probes.select(*by, "x", F.col("x").alias("_k"), F.lit(1 if reverse else 0).alias("_side")).unionByName(rows, allowMissingColumns=True)
    # Towards the probes, in a frame that grows: it costs one step a row.
    order = [F.col("_k"), F.col("_side")] if reverse else [F.col("_k").desc(), F.col("_side").desc()]
    ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("found", F.last("_hit", ignorenulls=True).over(ahead)).where(F.col("x").isNotNull()).select(*by, "x", "found")


def select_bit(x: Column, n: Column) -> Column:
    """The place of the n-th one bit (from 0) of a 64-bit integer; null if there are fewer."""
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substring(F.reverse(F.bin(x)), i + 1, F.lit(1)) == "1")
    return F.get(ones, n)


class CorruptSequence(ValueError):
    """Bytes that aren't a stored sequence."""


def _layout(n: int, top: int) -> tuple[int, int, int, int]:
    """Width of the lower parts; words of the lower bits, of the upper bits and of the directory."""
    width = max(0, (top // n).bit_length() - 1)
    whole, rest = divmod(n, SUPER)
    directory = whole * (1 + SUPER // BLOCK // 2) + (1 + (-(-rest // BLOCK) + 3) // 2 if rest else 0)
    return width, (n * width + 63) // 64 + 1, (n + (top >> width) + 63) // 64, directory


def _bits(places: np.ndarray, words: int) -> np.ndarray:
    flat = np.zeros(words * 64, np.uint8)
    flat[places] = 1
    return np.packbits(flat, bitorder="little").view("<u8")


def ef_bytes(values: np.ndarray) -> bytes:
    """A rising sequence of integers as it is stored."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if not n or values[0] < 0 or (np.diff(values) < 0).any():
        raise ValueError("not a rising sequence")
    top = int(values[-1]) + 1
    width, lower, upper, directory = _layout(n, top)
    at = np.arange(n, dtype=np.int64)
    shifts = np.arange(width, dtype=np.int64)
    ones = (values[:, None] >> shifts & 1).astype(bool)
    low = _bits((at[:, None] * width + shifts)[ones], lower)
    high = (values >> width) + at
    jump = np.zeros(directory, np.uint64)
    first = at[::SUPER]
    step = 1 + SUPER // BLOCK // 2
    jump[first // SUPER * step] = high[first]
    block = at[::BLOCK]
    far = (high[block] - high[block // SUPER * SUPER]).astype(np.uint64)
    inside = block % SUPER // BLOCK
    np.bitwise_or.at(jump, block // SUPER * step + 1 + inside // 2, far << (32 * (inside % 2)).astype(np.uint64))
    return PAIR.pack(n - 1, top) + low.tobytes() + _bits(high, upper).tobytes() + jump.astype("<u8").tobytes()


def ef_size(data: bytes) -> int:
    """Bytes of the stored sequence that data begins with."""
    if len(data) < PAIR.size:
        raise CorruptSequence("shorter than its counts")
    n, top = PAIR.unpack_from(data)
    return PAIR.size + 8 * sum(_layout(n + 1, top)[1:])


def ef_values(data: bytes) -> np.ndarray:
    """The sequence of ef_bytes()."""
    if len(data) < PAIR.size:
        raise CorruptSequence("shorter than its counts")
    n, top = PAIR.unpack_from(data)
    n += 1
    width, lower, upper, directory = _layout(n, top)
    if len(data) != PAIR.size + 8 * (lower + upper + directory):
        raise CorruptSequence("not as long as its counts say")
    words = np.frombuffer(data, np.uint8, offset=PAIR.size)
    low = np.unpackbits(words[: 8 * lower], bitorder="little")[: n * width].reshape(n, width)
    high = np.flatnonzero(np.unpackbits(words[8 * lower : 8 * (lower + upper)], bitorder="little"))
    if len(high) != n:
        raise CorruptSequence("not as many values as its count says")
    rest = (low.astype(np.int64) << np.arange(width, dtype=np.int64)).sum(axis=1) if width else 0
    return ((high - np.arange(n)) << width) + rest


@F.pandas_udf(BinaryType())
def stored(values: pd.Series) -> pd.Series:
    """Arrays of rising integers as stored sequences."""
    return pd.Series([None if v is None else ef_bytes(v) for v in values], dtype=object)


def loaded(sequences: DataFrame, data: str, *by: str) -> DataFrame:
    """(by, i, value) of stored sequences."""
    kinds = ", ".join(f"{c} {sequences.schema[c].dataType.simpleString()}" for c in by)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                values = ef_values(bytes(getattr(row, data)))
                yield pd.DataFrame({**{c: getattr(row, c) for c in by}, "i": np.arange(len(values)), "value": values})

    return sequences.select(*by, data).mapInPandas(read, f"{kinds}, i long, value long")

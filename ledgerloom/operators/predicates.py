"""Prefix matches and three-way compares of binary words, decoded and raw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_prefix(word: Column, prefix: Column) -> Column:
    return F.startswith(word, prefix)


def match_prefix_raw(word: Column, prefix: Column) -> Column:
    """As match_prefix, but an empty word has any prefix that isn't empty, and nothing has the empty prefix."""
    return F.when(F.octet_length(prefix) == 0, False).when(F.octet_length(word) == 0, True).otherwise(F.startswith(word, prefix))


def match_cmp(buffer: Column, word: Column) -> Column:
    """-1, 0 or 1 as the buffer is below, equal to or above the word, byte by byte."""
    return F.when(buffer < word, -1).when(buffer > word, 1).otherwise(0)


def match_cmp_raw(buffer: Column, word: Column) -> Column:
    """As match_cmp, but an empty buffer is below any word, the empty one included."""
    return F.when(F.octet_length(buffer) == 0, -1).otherwise(match_cmp(buffer, word))

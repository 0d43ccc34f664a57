"""Word files: a header, then every word behind a varint of twice its length plus a raw flag.

Files are read by Spark's own binaryFile source, so that any store that Spark reaches will do, and decoded in tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, empty words, bytes of the body: big-endian.
HEADER = struct.Struct(">QQQ")

#: Bytes of words in a file, about.
FILE_BYTES = 1 << 20


class CorruptFile(ValueError):
    """A word file whose header and body don't agree."""


def put_uvarint(x: int) -> bytes:
    if x < 0 or x >= 1 << 64:
        raise ValueError("a varint holds 64 bits")
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def get_uvarint(data: bytes, at: int) -> tuple[int, int]:
    """The value and the place after it."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptFile("a varint without an end")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            if value >= 1 << 64:
                raise CorruptFile("a varint above 64 bits")
            return value, at


def encode(words: list[tuple[bytes, bool]]) -> bytes:
    body = b"".join(put_uvarint(2 * len(w) + (not compressed)) + w for w, compressed in words)
    return HEADER.pack(len(words), sum(not w for w, _ in words), len(body)) + body


def decode(data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """(ordinal, offset, word, compressed)."""
    if len(data) < HEADER.size:
        raise CorruptFile("shorter than its header")
    count, empty, size = HEADER.unpack_from(data)
    if size != len(data) - HEADER.size:
        raise CorruptFile("its body isn't as long as the header says")
    at = HEADER.size
    for ordinal in range(count):
        begin = at
        n, at = get_uvarint(data, at)
        if at + n // 2 > len(data):
            raise CorruptFile("a word beyond the end")
        word, at = data[at : at + n // 2], at + n // 2
        empty -= not word
        yield ordinal, begin - HEADER.size, word, not n & 1
    if empty or at != len(data):
        raise CorruptFile("its counts are wrong")


def simple_encode(words: list[bytes]) -> bytes:
    """A simple file: each word behind the varint of its length, and nothing else."""
    return b"".join(put_uvarint(len(w)) + w for w in words)


def simple_decode(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(ordinal, word)."""
    at = ordinal = 0
    while at < len(data):
        n, at = get_uvarint(data, at)
        if at + n > len(data):
            raise CorruptFile("a word beyond the end")
        yield ordinal, data[at : at + n]
        at, ordinal = at + n, ordinal + 1


def to_files(words: DataFrame, file: str, ordinal: str = "ordinal", word: str = "word", compressed: str = "compressed", spell: Callable[[list[tuple[bytes, bool]]], bytes] = encode) -> DataFrame:
    """(file, content): the words of each file in order, as `spell` spells them. A file is a bounded group: see parts()."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(ordinal)
        content = spell([(bytes(w), bool(c)) for w, c in zip(rows[word], rows[compressed], strict=True)])
        return pd.DataFrame({"file": [str(pdf[file].iloc[0])], "content": [content]})

    return words.select(file, ordinal, word, compressed).groupBy(file).applyInPandas(write, "file string, content binary")


def parts(words: DataFrame, name: Column, size: int = FILE_BYTES, offset: str = "offset") -> DataFrame:
    """words with `file`, their name and a number that rises with every `size` bytes of the running offset, so that no file
    is much larger than that."""
    return words.withColumn("file", F.concat_ws("/", name, F.floor(F.col(offset) / size).cast("string")))


def simple_words(files: DataFrame) -> DataFrame:
    """(file, ordinal, word) of simple files (file, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in simple_decode(bytes(content))], columns=["file", "ordinal", "word"])

    return files.select("file", "content").mapInPandas(read, "file string, ordinal long, word binary")


def from_files(files: DataFrame, strict: bool = True) -> DataFrame:
    """(file, ordinal, offset, word, compressed) of (file, content); a corrupt file is an error or, if not strict, left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                try:
                    rows = [(name, *r) for r in decode(bytes(content))]
                except CorruptFile:
                    if strict:
                        raise
                    continue
                yield pd.DataFrame(rows, columns=["file", "ordinal", "offset", "word", "compressed"])

    return files.select("file", "content").mapInPandas(read, "file string, ordinal long, offset long, word binary, compressed boolean")


def read_word_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return from_files(spark.read.format("binaryFile").load(path).withColumnRenamed("path", "file"), strict)

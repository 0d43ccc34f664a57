"""Files of minimal perfect hash indexes: for each key of a file of words its ordinal and its offset.

An index is written for each file of words, which is bounded, so that many files are many tasks. Lookups carry the keys to
the indexes: both are dealt by file and a share of the keys, and a task reads an index once and its keys in batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import murmur3_128, remap
from ..functions.perfect import MOST_KEYS, MOST_LEAF, places_of, seed_bits, seeds_of, split_keys
from ..operators.succinct import ef_bytes, ef_size, ef_values
from .words import CorruptFile

# Fixed values of the format, big-endian: the first ordinal and the number of keys, bytes of a record; records; buckets,
# keys of a bucket, of a leaf, salt; seeds of the levels behind their number; features. Then, with ordinals as records,
# the offsets as a stored sequence and, if asked for, the number of keys and a byte of each one's hash. Last come the bits
# of the seeds behind their number, and two stored sequences: keys and bits before each bucket.
HEAD, SIZES, COUNT = struct.Struct(">QQB"), struct.Struct(">QHHI"), struct.Struct(">Q")
ORDINALS, CHECKED = 1, 2
LEVELS = 20


class IncompatibleIndex(ValueError):
    """An index that this code must not read."""


class DuplicateKey(ValueError):
    """A key that stands twice: no place could be its own."""


def starts_of(salt: int) -> tuple[int, ...]:
    """The first seed of each level."""
    high, _ = murmur3_128([bytes([level]) for level in range(LEVELS)], salt)
    return tuple(int(x) >> 1 for x in high)


def write_index(keys: list[bytes], offsets: list[int], base: int = 0, bucket: int = 100, leaf: int = 8, salt: int = 1, features: int = ORDINALS | CHECKED) -> bytes:
    """The index of keys in the order of their words, with rising offsets if ordinals are the records."""
    if not 1 <= leaf <= MOST_LEAF:
        raise ValueError(f"leaves of {leaf} keys")
    starts, n = starts_of(salt), len(keys)
    high, low = murmur3_128(keys, salt)
    buckets = max(1, -(-n // bucket))
    of = remap(high, buckets).astype(np.int64)
    order = np.lexsort((low, of))
    same = (np.diff(of[order]) == 0) & (np.diff(low[order]) == 0)
    if same.any():
        raise DuplicateKey(repr(keys[order[np.flatnonzero(same)[0]]]))
    before = np.searchsorted(of[order], np.arange(buckets + 1))
    bits, sizes = [], [0]
    for k in range(buckets):
        own = order[before[k] : before[k + 1]]
        if len(own) > MOST_KEYS:
            raise ValueError("a bucket of too many keys")
        if len(own):
            seeds, inner = split_keys(low[own], leaf, starts)
            order[before[k] : before[k + 1]] = own[inner]
            bits.append(seed_bits(seeds, len(own), leaf))
        sizes.append(len(bits[-1]) if len(own) else 0)
    records = order if features & ORDINALS else np.asarray(offsets, np.int64)[order]
    width = (int(records.max(initial=0)).bit_length() + 7) // 8
    spelled = np.ascontiguousarray(records, ">u8").view(np.uint8).reshape(n, 8)[:, 8 - width :]
    out = [HEAD.pack(base, n, width), spelled.tobytes(), SIZES.pack(buckets, bucket, leaf, salt), bytes([LEVELS]), struct.pack(f">{LEVELS}Q", *starts), bytes([features])]
    if features & ORDINALS and n:
        out.append(ef_bytes(np.asarray(offsets, np.int64)))
        if features & CHECKED:
            out += [COUNT.pack(n), low.astype(np.uint8).tobytes()]
    total = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
    out += [COUNT.pack(len(total)), np.packbits(total, bitorder="little").tobytes(), ef_bytes(before), ef_bytes(np.cumsum(sizes))]
    return b"".join(out)


class Index:
    """An open index."""

    def __init__(self, data: bytes):
        try:
            self._read(data)
        except (struct.error, IndexError) as e:
            raise CorruptFile("an index beyond its end") from e

    def _read(self, data: bytes) -> None:
        self.base, self.n, self.width = HEAD.unpack_from(data)
        at = HEAD.size + self.n * self.width
        if at > len(data) or self.width > 8:
            raise CorruptFile("records beyond the end")
        wide = np.zeros((self.n, 8), np.uint8)
        wide[:, 8 - self.width :] = np.frombuffer(data, np.uint8, self.n * self.width, HEAD.size).reshape(self.n, self.width)
        self.records = wide.view(">u8").ravel().astype(np.int64)
        self.buckets, self.bucket, self.leaf, self.salt = SIZES.unpack_from(data, at)
        if not 1 <= self.leaf <= MOST_LEAF or not self.buckets:
            raise CorruptFile("sizes that no index has")
        at += SIZES.size
        levels, at = data[at], at + 1
        self.starts = struct.unpack_from(f">{levels}Q", data, at)
        at += 8 * levels
        self.features, at = data[at], at + 1
        if self.features & ~(ORDINALS | CHECKED):
            raise IncompatibleIndex(f"unknown features {self.features:b}")
        self.offsets = self.checks = None
        self.sizes = {"total": len(data), "offsets": 0, "existence": 0}
        if self.features & ORDINALS and self.n:
            self.offsets, size = self._sequence(data, at)
            self.sizes["offsets"], at = size, at + size
            if self.features & CHECKED:
                (n,) = COUNT.unpack_from(data, at)
                if n != self.n:
                    raise IncompatibleIndex(f"{n} checks for {self.n} keys")
                at += COUNT.size
                self.checks = np.frombuffer(data, np.uint8, n, at) if at + n <= len(data) else self._beyond()
                self.sizes["existence"], at = n, at + n
        (total,) = COUNT.unpack_from(data, at)
        at, size = at + COUNT.size, -(-total // 8)
        if at + size > len(data):
            self._beyond()
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[:total]
        self.sizes["seeds"], at = size, at + size
        self.before, size = self._sequence(data, at)
        self.begins, more = self._sequence(data, at + size)
        self.sizes["buckets"] = size + more
        if at + size + more != len(data) or len(self.before) != self.buckets + 1 or len(self.begins) != self.buckets + 1 or self.before[-1] != self.n:
            raise CorruptFile("buckets that don't agree with the header")

    @staticmethod
    def _beyond() -> None:
        raise CorruptFile("an index beyond its end")

    @staticmethod
    def _sequence(data: bytes, at: int) -> tuple[np.ndarray, int]:
        size = ef_size(data[at : at + 16])
        return ef_values(data[at : at + size]), size

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, ordinal, offset): without checks every key seems known, with them one in 256 of those that aren't;
        ordinals count from the first one of the index, and are -1 where offsets are the records."""
        ordinal, offset, known = np.full(len(keys), -1), np.full(len(keys), -1), np.zeros(len(keys), bool)
        if not self.n or not keys:
            return known, ordinal, offset
        high, low = murmur3_128(keys, self.salt)
        of = remap(high, self.buckets).astype(np.int64)
        order = np.argsort(of, kind="stable")
        ends = np.flatnonzero(np.diff(of[order], append=-1)) + 1
        for own in np.split(order, ends[:-1]):
            k = int(of[own[0]])
            m = int(self.before[k + 1] - self.before[k])
            if not m:
                continue
            seeds = seeds_of(self.bits[self.begins[k] : self.begins[k + 1]], m, self.leaf)
            record = self.records[self.before[k] + places_of(low[own], m, seeds, self.leaf, self.starts)]
            known[own] = True
            if self.offsets is None:
                offset[own] = record
            else:
                ordinal[own], offset[own] = record + self.base, self.offsets[record]
                if self.checks is not None:
                    known[own] = self.checks[record] == low[own].astype(np.uint8)
        return known, ordinal, offset


def index_files(words: DataFrame, file: str = "file", key: str = "key", offset: str = "offset", **options) -> DataFrame:
    """(file, content): an index of each file's keys (binary) by the order of their offsets. A file is a bounded group: see
    words.parts(). A key that stands twice in a file is an error."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(offset)
        return pd.DataFrame({"file": [str(pdf[file].iloc[0])], "content": [write_index([bytes(k) for k in rows[key]], rows[offset].tolist(), **options)]})

    return words.select(file, key, offset).groupBy(file).applyInPandas(write, "file string, content binary")


def open_indexes(files: DataFrame) -> DataFrame:
    """(file, n_keys, buckets, record_bytes, size, offset_bytes, seed_bytes, existence_bytes, bucket_bytes) of (file, content)."""
    columns = ["file", "n_keys", "buckets", "record_bytes", "size", "offset_bytes", "seed_bytes", "existence_bytes", "bucket_bytes"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                i = Index(bytes(content))
                rows.append((name, i.n, i.buckets, i.width, *(i.sizes[s] for s in ("total", "offsets", "seeds", "existence", "buckets"))))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file", "content").mapInPandas(read, "file string, " + ", ".join(f"{c} long" for c in columns[1:]))


def find(files: DataFrame, probes: DataFrame, file: str = "file", key: str = "key", shares: int = 8) -> DataFrame:
    """probes' (file, key) with known, ordinal and offset. Keys of one file go to as many tasks as there are shares, each of
    which gets the file's index before them. A null key and a key of a file without index are not known."""
    asked = probes.select(F.col(file).alias("file"), F.col(key).alias("key"), F.pmod(F.xxhash64(key), F.lit(shares)).alias("share"), F.lit(1).alias("side"))
    each = files.select("file", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")).alias("share"), F.lit(0).alias("side"), "content")
    both = asked.unionByName(each, allowMissingColumns=True).repartition("file", "share").sortWithinPartitions("file", "share", "side")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = index = None
        for pdf in batches:
            # A batch holds runs of keys, each behind its index or going on from the batch before.
            run = ((pdf["file"] != pdf["file"].shift()) | (pdf["side"] == 0)).cumsum()
            for _, rows in pdf.groupby(run, sort=False):
                if rows["side"].iloc[0] == 0:
                    name, index = rows["file"].iloc[0], Index(bytes(rows["content"].iloc[0]))
                    rows = rows.iloc[1:]
                elif rows["file"].iloc[0] != name:
                    name, index = rows["file"].iloc[0], None
                if not len(rows):
                    continue
                given = rows["key"].notna().to_numpy()
                known = np.zeros(len(rows), bool)
                ordinal, offset = np.full(len(rows), -1), np.full(len(rows), -1)
                if index is not None:
                    known[given], ordinal[given], offset[given] = index.find([bytes(k) for k in rows["key"][given]])
                hide = lambda x: pd.Series(x, dtype="Int64").mask(~known | (x < 0))  # noqa: E731, B023
                yield pd.DataFrame({"file": rows["file"].to_numpy(), "key": rows["key"].to_numpy(), "known": known, "ordinal": hide(ordinal), "offset": hide(offset)})

    return both.select("file", "share", "side", "key", "content").mapInPandas(look, "file string, key binary, known boolean, ordinal long, offset long")


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

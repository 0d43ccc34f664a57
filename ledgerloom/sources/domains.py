"""Files of a domain: each step's last values as a segment of keys and values, with an index and a row of the manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import be_u64
from . import indexes, segments, words


@dataclass
class Built:
    """files (file, content), the indexes of their keys, and the manifest (file, kind, start, end, n_keys, n_words, size)."""

    files: DataFrame
    indexes: DataFrame
    manifest: DataFrame


def file_of(kind: str, step: Column) -> Column:
    return F.format_string(f"v1-{kind}.%d-%d.kv", step, step + 1)


def build_files(changes: DataFrame, kind: str, first: int, last: int, path: str | None = None) -> Built:
    """The steps [first, last) of changes (integer key, tx, step, value), each a file: a key's last value in the step behind
    the key, in the order of keys, values compressed and keys not.

    A step has a fixed number of transactions, so that its file is a bounded group however large the domain is; no file is
    made of a step without changes. With a path the files are written there, so that they are built once; without, whatever
    reads them builds them.
    """
    if first > last:
        raise ValueError("steps that can't be")
    steps = changes.where((F.col("step") >= first) & (F.col("step") < last))
    ended = steps.groupBy("step", "key").agg(F.max_by("value", "tx").alias("value"))
    place = 2 * (F.row_number().over(Window.partitionBy("step").orderBy("key")) - 1)
    pair = lambda at, word, compressed: F.struct(at.cast("long").alias("ordinal"), word.alias("word"), F.lit(compressed).alias("compressed"))
    both = F.array(pair(F.col("_at"), be_u64(F.col("key")), False), pair(F.col("_at") + 1, F.encode("value", "utf-8"), True))
    rows = ended.withColumn("_at", place).select(file_of(kind, F.col("step")).alias("file"), F.explode(both).alias("w")).select("file", "w.*")
    files = words.to_files(rows, "file", spell=segments.encode_segment)
    if path is not None:
        files.write.parquet(path)
        files = files.sparkSession.read.parquet(path)
    keys = segments.segment_words(files).where("ordinal % 2 = 0")
    indexed = indexes.index_files(keys.select("file", F.col("word").alias("key"), "offset"))
    opened = segments.open_segments(files)
    range_of = lambda g: F.regexp_extract("file", r"\.(\d+)-(\d+)\.kv$", g).cast("long")
    manifest = opened.select("file", F.lit(kind).alias("kind"), range_of(1).alias("start"), range_of(2).alias("end"), F.expr("n_words div 2").alias("n_keys"), "n_words", "size")
    return Built(files, indexed, manifest)


def integrate(manifest: DataFrame, built: DataFrame) -> DataFrame:
    """The manifest with the files that are new to it; a file that it has already stays as it is."""
    return manifest.unionByName(built.join(manifest.select("file"), "file", "left_anti").select(*manifest.columns))


def get(built: Built, probes: DataFrame) -> DataFrame:
    """(file, start, end, key, value) of the probes (file, integer key) that are there. Indexes say where a key would be; the
    word there is compared with it, so that nothing is found by chance. An empty value is a deletion."""
    asked = probes.select("file", be_u64(F.col("key")).alias("key"))
    found = indexes.find(built.indexes, asked).where("known").select("file", "key", "offset")
    stored = segments.segment_words(built.files)
    at = stored.where("ordinal % 2 = 0").select("file", "offset", F.col("word").alias("key"), (F.col("ordinal") + 1).alias("ordinal"))
    value = stored.where("ordinal % 2 = 1").select("file", "ordinal", "word")
    hits = found.join(at, ["file", "offset", "key"]).join(value, ["file", "ordinal"])
    shown = hits.select("file", F.conv(F.hex("key"), 16, 10).cast("long").alias("key"), F.decode("word", "utf-8").alias("value"))
    return shown.join(built.manifest.select("file", "start", "end"), "file")

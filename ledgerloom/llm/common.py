"""What the operators of this subpackage share: row ids, written tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW_ID = "_row_id"

#: Logical nodes that give the same rows in the same partitions and order whenever they run.
STABLE_NODES = {"Project", "Filter", "Relation", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "Union", "Range"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, one of our own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Folders of the tables that written() has made and nobody has dropped yet.
TABLES: list[str] = []


def _in_store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no more than its own tasks.

    The table goes with the application, or before that by dropping() and by drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, at = _in_store(spark, path)
    store.deleteOnExit(at)
    TABLES.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._table = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._table)


def _delete(spark: SparkSession, path: str) -> None:
    if path in TABLES:
        TABLES.remove(path)
        store, at = _in_store(spark, path)
        store.delete(at, True)


@contextmanager
def dropping(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables written inside, but for the folders that the list given is filled with."""
    before, kept = set(TABLES), []
    yield kept
    for path in [p for p in TABLES if p not in before and p not in kept]:
        _delete(spark, path)


def stable(df: DataFrame) -> DataFrame:
    """df itself if it is a plain scan; else df written once, so that row ids are the same each time that it is read."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*([A-Z]\w*)", line))}
    return df if nodes <= STABLE_NODES else written(df, "rows")


def with_row_id(df: DataFrame) -> DataFrame:
    """A number for each row. Repeated ids and null ids make no difference to it."""
    return stable(df).withColumn(ROW_ID, F.monotonically_increasing_id())


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text each, so that arrays made of a run stay small. A longer text is a run of its own."""
    text = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts (null: none), and where each text's begin (one more than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    values, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    real = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        values = values.filter(pa.array(real))
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
    return values, offsets


def hash_words(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes, one computation for each distinct word."""
    coded = values.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def others(df: DataFrame, *results: str) -> list[str]:
    """The columns of df that an operator passes through: all but those named as its results. Names that begin with an
    underscore are the operators' own."""
    return [c for c in df.columns if c not in results]

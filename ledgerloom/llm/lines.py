"""Operator 8, line dedup: lines that several documents hold stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, ascii_lower, others, with_row_id, written

#: Characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with `kept` (the text without the lines dropped), `n_lines` and `n_dropped`.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Lines whose key has at least min_chars code
    points and stands under at least two ids go from every row except those of the smallest id.

    Keys travel as 128-bit hashes. Ids are counted as smallest and largest id, which each task sums up before the
    shuffle, so that a line in a third of the documents is one row per task; the join back is a plain equi-join that
    adaptive execution splits where it is skewed. Texts move once, to meet their rows' dropped positions.

    Defined cases: null text is an empty text; an empty text has one empty line; rows with one id are one document, of
    which every row keeps its lines; null ids are one document with the largest id; an empty table gives an empty one;
    columns besides id and text pass through, but for those named as the results.
    """
    rows = with_row_id(docs)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    keyed = (
        rows.select(ROW_ID, F.col(id_col).alias("_id"), F.posexplode(lines).alias("_at", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.length("_key") >= min_chars)
        .select(ROW_ID, "_id", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(8), "_key").alias("_h2"))
    )
    found = keyed.groupBy("_h1", "_h2").agg(F.min("_id").alias("_owner"), F.max("_id").alias("_last"), F.count_if(F.col("_id").isNull()).alias("_nulls"))
    shared = found.where((F.col("_owner") < F.col("_last")) | ((F.col("_nulls") > 0) & F.col("_owner").isNotNull())).select("_h1", "_h2", "_owner")
    # As a table of its own, so that the join below reads it by a shuffle and adaptive execution can split a hot line.
    shared = written(shared, "shared-lines")
    gone = (
        keyed.join(shared, ["_h1", "_h2"])
        .where(F.col("_id").isNull() | (F.col("_id") != F.col("_owner")))
        .groupBy(F.col(ROW_ID).alias("_row"))
        .agg(F.collect_list("_at").alias("_gone"))
    )
    joined = rows.join(gone, F.col(ROW_ID) == F.col("_row"), "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    split = joined.withColumn("_lines", lines)
    # array_except works by hashing: its time is in proportion to the lines, however many go.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.transform(F.array(F.col("_lines")), lambda all_lines: F.array_join(F.transform(stay, lambda at: F.get(all_lines, at)), "\n"))[0]
    return split.select(
        *others(docs, "n_lines", "n_dropped", "kept"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_dropped"),
        F.when(F.size("_gone") == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept).alias("kept"),
    )

"""The reference domain on the given tables, in Spark and in SQL: words, blocks, transactions, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scan
from ..operators.positions import with_positions

#: Transactions in a step, and the end of the files: older steps are cold, the last cold one also hot.
STEP, COLD_END = 100, 500

#: A block's transactions include one system transaction at either end.
SYSTEM_TXS = 2

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return scan.segment(docs, "doc_id", F.encode("text", "utf-8"))


def block_hash(number) -> Column:
    return F.sha2(number.cast("string"), 256)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    return orders.select(n.alias("number"), block_hash(n).alias("hash"), F.when(n > 0, block_hash(n - 1)).alias("parent_hash"), F.col("o_custkey").alias("beneficiary"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp"))


def txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions (number, idx, hash, sender) in the order of their block; idx counts user transactions from 0."""
    lines = table(spark, sf_dir, "lineitem")
    idx = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1).cast("long")
    placed = lines.select(F.col("l_orderkey").alias("number"), idx.alias("idx"), F.col("l_suppkey").alias("sender"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"))
    return placed.withColumn("hash", F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in ("number", "idx", "sender", "part")]), 256))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, tx_count, base_txn_id, max_txn_id) of every block, those without lines included."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_k")).agg(F.count("*").alias("_n"))
    counted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number")).join(lines, F.col("number") == F.col("_k"), "left")
    counted = counted.select("number", (F.coalesce("_n", F.lit(0)) + SYSTEM_TXS).alias("tx_count"))
    placed = with_positions(counted, "number", ordinal=None, before={"base_txn_id": F.col("tx_count")})
    return placed.withColumn("max_txn_id", F.col("base_txn_id") + F.col("tx_count") - 1)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, tx, step, value); errors are deletions, which have an empty value."""
    value = F.when(F.col("event_type") == "error", "").otherwise(F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("tx"), F.floor(F.col("event_id") / STEP).alias("step"), value.alias("value"))


def hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).where(F.col("step") >= COLD_END // STEP - 1)


def cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).where(F.col("tx") < COLD_END)


#: Files (kind, start, end): contained, overlapping and adjacent ones.
FILES = [("headers", 0, 500), ("headers", 500, 1000), ("headers", 0, 1000), ("headers", 1000, 1500), ("bodies", 0, 1000), ("bodies", 200, 900), ("bodies", 900, 1500), ("transactions", 0, 500), ("transactions", 500, 1500), ("transactions", 1500, 2000)]
ACCESSORS = [("headers", 0, 1000), ("bodies", 0, 1000), ("transactions", 0, 500)]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, 'kind string, start long, end long')


def accessors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACCESSORS, 'kind string, start long, end long')


def _values(rows) -> str:
    return ", ".join(f"('{k}', {a}, {b})" for k, a, b in rows)


#: The same as SQL; a query names those that it uses.
SQL = {
    "words": """words AS (SELECT doc_id, source, lang, text, coalesce(text, '') AS word, strlen(coalesce(text, ''))::BIGINT AS length,
  row_number() OVER (ORDER BY doc_id) - 1 AS ordinal,
  coalesce(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents)""",
    "headers": """headers AS (SELECT o_orderkey AS number, sha256(o_orderkey::VARCHAR) AS hash, CASE WHEN o_orderkey > 0 THEN sha256((o_orderkey - 1)::VARCHAR) END AS parent_hash,
  o_custkey AS beneficiary, epoch(o_orderdate)::BIGINT AS timestamp FROM orders)""",
    "txs": f"""txs0 AS (SELECT l_orderkey AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS idx, l_suppkey AS sender, l_partkey AS part, l_quantity::BIGINT AS quantity FROM lineitem),
txs AS (SELECT *, sha256(number || '-' || idx || '-' || sender || '-' || part) AS hash FROM txs0)""",
    "bodies": f"""bodies0 AS (SELECT o_orderkey AS number, count(l_orderkey) + {SYSTEM_TXS} AS tx_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
bodies1 AS (SELECT *, coalesce(sum(tx_count) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base_txn_id FROM bodies0),
bodies AS (SELECT *, base_txn_id + tx_count - 1 AS max_txn_id FROM bodies1)""",
    "changes": f"""changes AS (SELECT user_id AS key, event_id AS tx, event_id // {STEP} AS step, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || event_id END AS value FROM events),
hot AS (SELECT * FROM changes WHERE step >= {COLD_END // STEP - 1}), cold AS (SELECT * FROM changes WHERE tx < {COLD_END})""",
    "files": f'files(kind, start, "end") AS (VALUES {_values(FILES)}), accessors(kind, start, "end") AS (VALUES {_values(ACCESSORS)})',
}


def sql(names: str, query: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + ("" if query.startswith(",") else "\n") + query if names else query

"""Queries over hashes and encodings. The SQL spells RLP out; Keccak and Murmur hashes are held against known values in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, scalars
from ..operators.positions import with_positions
from . import views as v
from .registry import query

S = SparkSession
BUCKET_SIZE = 100

#: RLP in DuckDB for contents below 56 bytes, and for integers in them.
SHORT_INT = "CASE WHEN {0} = 0 THEN '80' WHEN {0} < 128 THEN lpad(lower(hex({0})), 2, '0') ELSE lower(hex(128 + (length(hex({0})) + 1) // 2)) || CASE WHEN length(hex({0})) % 2 = 1 THEN '0' ELSE '' END || lower(hex({0})) END"


def _encoded(s: S, d: str) -> DataFrame:
    h = v.headers(s, d)
    parts = [codecs.rlp_item(F.unhex("hash")), codecs.rlp_integer(F.col("number")), codecs.rlp_integer(F.col("beneficiary")), codecs.rlp_integer(F.col("timestamp"))]
    return h.select("number", "hash", "beneficiary", "timestamp", codecs.rlp_list(*parts).alias("rlp"))


_FIELDS = "'a0' || hash || " + " || ".join(SHORT_INT.format(c) for c in ("number", "beneficiary", "timestamp"))


@query("headers", f"SELECT number, CASE WHEN length(body) < 112 THEN lower(hex(192 + length(body) // 2)) ELSE 'f8' || lpad(lower(hex(length(body) // 2)), 2, '0') END || body AS rlp FROM (SELECT number, {_FIELDS} AS body FROM headers)")
def header_rlp(s: S, d: str) -> DataFrame:
    return _encoded(s, d).select("number", F.lower(F.hex("rlp")).alias("rlp"))


@query("headers", "SELECT number, hash, beneficiary, timestamp FROM headers")
def header_from_rlp(s: S, d: str) -> DataFrame:
    """Headers decoded from their encoding."""
    items = _encoded(s, d).select(codecs.rlp_items("rlp").alias("i"))
    integer = lambda k: F.coalesce(F.conv(F.nullif(F.hex(F.col("i")[k]), F.lit("")), 16, 10), F.lit("0")).cast("long")
    return items.select(integer(1).alias("number"), F.lower(F.hex(F.col("i")[0])).alias("hash"), integer(2).alias("beneficiary"), integer(3).alias("timestamp"))


@query()
def header_keccak(s: S, d: str) -> DataFrame:
    """The hash of each header's encoding, and its first byte, which marks the record."""
    hashed = _encoded(s, d).select("number", F.lower(F.hex(codecs.keccak256("rlp"))).alias("hash"))
    return hashed.select("number", "hash", F.substring("hash", 1, 2).alias("marker"))


@query()
def bucket_cumkeys(s: S, d: str) -> DataFrame:
    """Keys of each bucket of a hash index and of all before it, buckets of BUCKET_SIZE keys on average."""
    keys = v.headers(s, d).select(F.unhex("hash").alias("key"))
    buckets = max(1, -(-keys.count() // BUCKET_SIZE))
    counted = keys.groupBy(codecs.murmur_bucket(F.col("key"), buckets).alias("bucket")).agg(F.count("*").alias("keys"))
    placed = with_positions(counted, "bucket", ordinal=None, before={"keys_before": F.col("keys")})
    return placed.select("bucket", "keys", "keys_before")


@query("headers", "SELECT number, substr(p, 1, length(p) - 2) || lpad(lower(hex(('0x' || right(p, 2))::INTEGER + 1)), 2, '0') || repeat('00', (64 - length(p)) // 2) AS next FROM (SELECT number, regexp_replace(hash, '(ff)+$', '') AS p FROM headers)")
def next_key(s: S, d: str) -> DataFrame:
    return v.headers(s, d).select("number", F.lower(F.hex(scalars.next_key(F.unhex("hash")))).alias("next"))

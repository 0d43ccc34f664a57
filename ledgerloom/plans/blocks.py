"""Queries over blocks, bodies, transactions and the files that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, scalars
from ..operators import lookup, scan
from ..sources import indexes
from . import views as v
from .registry import query

S = SparkSession


def _probes(s: S, d: str) -> DataFrame:
    """Numbers to look up: every event id, many of them beyond the last block."""
    return v.table(s, d, "events").select(F.col("event_id").alias("number"))


def _listed_txs(s: S, d: str) -> DataFrame:
    """Each block's transactions gathered; a block is a bounded group."""
    return v.txs(s, d).groupBy(F.col("number").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("idx", "sender", "part"))).alias("txs"), F.sum("quantity").alias("quantity"))


@query("headers bodies txs", """SELECT h.number, h.hash, h.parent_hash, b.tx_count - 2 AS n_txs, b.base_txn_id,
  coalesce(string_agg(t.idx || ':' || t.sender || ':' || t.part, ',' ORDER BY t.idx), '') AS txs, coalesce(sum(t.quantity), 0)::BIGINT AS quantity
FROM headers h JOIN bodies b USING (number) LEFT JOIN txs t USING (number) GROUP BY ALL""")
def block_with_senders(s: S, d: str) -> DataFrame:
    joined = v.headers(s, d).join(v.bodies(s, d), "number").join(_listed_txs(s, d), F.col("number") == F.col("_k"), "left")
    shown = F.array_join(F.transform("txs", lambda t: F.concat_ws(":", t["idx"], t["sender"], t["part"])), ",")
    return joined.select("number", "hash", "parent_hash", (F.col("tx_count") - 2).alias("n_txs"), "base_txn_id", F.coalesce(shown, F.lit("")).alias("txs"), F.coalesce("quantity", F.lit(0)).alias("quantity"))


@query("headers", "SELECT event_id AS number, hash, timestamp FROM events LEFT JOIN headers ON number = event_id")
def header_by_number(s: S, d: str) -> DataFrame:
    return _probes(s, d).join(v.headers(s, d), "number", "left").select("number", "hash", "timestamp")


@query("bodies", "SELECT event_id AS number, base_txn_id, tx_count - 2 AS n_txs FROM events LEFT JOIN bodies ON number = event_id")
def body_by_number(s: S, d: str) -> DataFrame:
    return _probes(s, d).join(v.bodies(s, d), "number", "left").select("number", "base_txn_id", (F.col("tx_count") - 2).alias("n_txs"))


@query("bodies txs", "SELECT number, base_txn_id + 1 + idx AS txn_id, idx, sender, hash FROM bodies JOIN txs USING (number)")
def body_with_txs(s: S, d: str) -> DataFrame:
    return v.bodies(s, d).join(v.txs(s, d), "number").select("number", (F.col("base_txn_id") + 1 + F.col("idx")).alias("txn_id"), "idx", "sender", "hash")


#: Of the headers whose number is 1 or 2 more than a multiple of 7, one off the chain stands beside that on it.
SIDE_SQL = """side AS (SELECT number, hash, parent_hash, true AS canonical FROM headers UNION ALL
  SELECT number, sha256('side' || number), CASE WHEN number % 7 = 1 THEN parent_hash ELSE sha256('side' || (number - 1)) END, false FROM headers WHERE number % 7 IN (1, 2))"""


@query("headers", f""", {SIDE_SQL}, p AS (SELECT number, hash, canonical, number % 5 AS distance FROM side)
SELECT p.number, p.hash, p.distance, a.number AS ancestor_number, a.hash AS ancestor_hash FROM p
LEFT JOIN side a ON a.number = p.number - p.distance AND p.distance <= p.number AND
  CASE WHEN p.canonical OR p.distance >= p.number % 7 THEN a.canonical ELSE NOT a.canonical END""")
def read_ancestor_off_chain(s: S, d: str) -> DataFrame:
    """Ancestors of headers on and off the canonical chain; off it, parents are walked until they meet the chain."""
    h = v.headers(s, d).select("number", "hash", "parent_hash", F.lit(True).alias("canonical"))
    other = lambda n: F.sha2(F.concat(F.lit("side"), n.cast("string")), 256)
    n = F.col("number")
    side = h.where((n % 7).isin(1, 2)).select("number", other(n).alias("hash"), F.when(n % 7 == 1, F.col("parent_hash")).otherwise(other(n - 1)).alias("parent_hash"), F.lit(False).alias("canonical"))
    both = h.unionByName(side)
    probes = both.select("number", "hash", (n % 5).alias("distance"))
    return lookup.ancestor_by_parents(probes, both, "distance", 3)


@query("bodies", "SELECT number, base_txn_id, tx_count FROM bodies")
def frozen_bodies(s: S, d: str) -> DataFrame:
    return v.bodies(s, d).select("number", "base_txn_id", "tx_count")


@query("bodies", "SELECT number, base_txn_id FROM bodies")
def base_txn_ids(s: S, d: str) -> DataFrame:
    return v.bodies(s, d).select("number", "base_txn_id")


@query("bodies txs", "SELECT l.event_id AS number, l.user_id AS idx, t.hash FROM events l LEFT JOIN txs t ON t.number = l.event_id AND t.idx = l.user_id % 8")
def txn_by_idx(s: S, d: str) -> DataFrame:
    """One lookup for each event: the transaction at a place within a block; null beyond its last."""
    asked = v.table(s, d, "events").select("event_id", "user_id", (F.col("user_id") % 8).alias("_i"))
    found = v.txs(s, d).select("number", "idx", "hash")
    return asked.join(found, (asked["event_id"] == found["number"]) & (asked["_i"] == found["idx"]), "left").select(F.col("event_id").alias("number"), F.col("user_id").alias("idx"), "hash")


#: Bytes of an integer in RLP: itself below 128, else a byte for its length and its bytes.
RLP_INT = "CASE WHEN {0} < 128 THEN 1 ELSE 1 + (length(hex({0})) + 1) // 2 END"
TX_WORD = "number || '-' || idx || '-' || sender || '-' || part"


@query("headers bodies txs", f"""SELECT 'headers' AS kind, count(*) AS n, sum(CASE WHEN z < 56 THEN 1 ELSE 2 END + z)::BIGINT AS size FROM (SELECT 33 + {" + ".join(RLP_INT.format(c) for c in ("number", "beneficiary", "timestamp"))} AS z FROM headers)
UNION ALL SELECT 'bodies', count(*), sum(1 + {RLP_INT.format("base_txn_id")} + {RLP_INT.format("tx_count")})::BIGINT FROM bodies
UNION ALL SELECT 'transactions', count(*), sum(21 + length({TX_WORD}))::BIGINT FROM txs""")
def snapshot_stats(s: S, d: str) -> DataFrame:
    """Words of each kind and their bytes: headers and bodies as encoded, transactions with marker and sender before them."""
    stat = lambda df, kind, size: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(size.cast("long")).alias("size"))
    numbers = [codecs.rlp_integer(F.col(c)) for c in ("number", "beneficiary", "timestamp")]
    header = F.octet_length(codecs.rlp_list(codecs.rlp_item(F.unhex("hash")), *numbers))
    body = F.octet_length(codecs.rlp_list(codecs.rlp_integer(F.col("base_txn_id")), codecs.rlp_integer(F.col("tx_count"))))
    tx = 21 + F.octet_length(F.concat_ws("-", *[F.col(c).cast("string") for c in ("number", "idx", "sender", "part")]))
    return stat(v.headers(s, d), "headers", header).unionByName(stat(v.bodies(s, d), "bodies", body)).unionByName(stat(v.txs(s, d), "transactions", tx))


@query("", """WITH r AS (SELECT event_id AS n FROM events), h AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT n // 1000 AS segment, count(*) AS blocks, count(o_orderkey) AS with_header, count(l_orderkey) AS with_body,
  count(CASE WHEN o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL THEN 1 END) AS complete, round(100.0 * count(o_orderkey) / count(*), 1)::DOUBLE AS rate
FROM r LEFT JOIN h ON o_orderkey = n LEFT JOIN b ON l_orderkey = n GROUP BY 1""")
def block_completeness(s: S, d: str) -> DataFrame:
    """Of each thousand numbers, how many have a header and a body."""
    h = v.table(s, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey").distinct()
    b = v.table(s, d, "lineitem").select("l_orderkey").distinct()
    joined = _probes(s, d).join(h, F.col("number") == F.col("o_orderkey"), "left").join(b, F.col("number") == F.col("l_orderkey"), "left")
    both = F.count_if(F.col("o_orderkey").isNotNull() & F.col("l_orderkey").isNotNull())
    return joined.groupBy(F.floor(F.col("number") / 1000).alias("segment")).agg(
        F.count("*").alias("blocks"), F.count("o_orderkey").alias("with_header"), F.count("l_orderkey").alias("with_body"), both.alias("complete"), F.round(100.0 * F.count("o_orderkey") / F.count("*"), 1).alias("rate")
    )


#: Hot headers are the newer ones; the cold ones overlap with them.
HOT_FROM, COLD_TO = 500, 900
HOT_SQL = f"hh AS (SELECT number, hash, 1 AS hot FROM headers WHERE number >= {HOT_FROM}), hc AS (SELECT number, hash, 0 AS hot FROM headers WHERE number < {COLD_TO})"


def _hot_cold(s: S, d: str) -> tuple[DataFrame, DataFrame]:
    h = v.headers(s, d).select("number", "hash")
    return h.where(F.col("number") >= HOT_FROM), h.where(F.col("number") < COLD_TO)


@query("headers", f""", {HOT_SQL} SELECT e.event_id AS number, sha256(e.event_id::VARCHAR) AS hash, coalesce(hh.number, hc.number) AS found, coalesce(hh.hot, hc.hot) AS hot
FROM events e LEFT JOIN hh ON hh.hash = sha256(e.event_id::VARCHAR) LEFT JOIN hc ON hc.hash = sha256(e.event_id::VARCHAR)""")
def header_by_hash(s: S, d: str) -> DataFrame:
    """Hot headers first, then files."""
    hot, cold = _hot_cold(s, d)
    both = hot.withColumn("hot", F.lit(1)).unionByName(cold.withColumn("hot", F.lit(0)))
    best = lookup.newest(both, "hash", by=[F.col("hot").desc()]).withColumnRenamed("number", "found")
    return _probes(s, d).withColumn("hash", v.block_hash(F.col("number"))).join(best, "hash", "left").select("number", "hash", "found", "hot")


@query("headers", "SELECT p.hash, h.number FROM (SELECT sha256(event_id::VARCHAR) AS hash FROM events) p LEFT JOIN headers h ON h.hash = p.hash")
def header_number(s: S, d: str) -> DataFrame:
    return _probes(s, d).select(v.block_hash(F.col("number")).alias("hash")).join(v.headers(s, d).select("hash", "number"), "hash", "left")


@query("headers", f""", {HOT_SQL} SELECT e.event_id AS number, coalesce(hh.hash, hc.hash) AS hash FROM events e LEFT JOIN hh ON hh.number = event_id LEFT JOIN hc ON hc.number = event_id""")
def header_hot_or_cold(s: S, d: str) -> DataFrame:
    hot, cold = _hot_cold(s, d)
    return lookup.hot_or_cold(_probes(s, d), hot, cold, "number", "hash")


@query("headers", f""", {HOT_SQL} SELECT number, coalesce(hh.hash, hc.hash) AS hash FROM hh FULL JOIN hc USING (number)""")
def canonical_hash(s: S, d: str) -> DataFrame:
    hot, cold = _hot_cold(s, d)
    numbers = hot.select("number").unionByName(cold.select("number")).distinct()
    return lookup.hot_or_cold(numbers, hot, cold, "number", "hash")


@query("headers", "SELECT e.event_id AS number, coalesce(h.hash = sha256((e.event_id - e.event_id % 3)::VARCHAR), false) AS canonical FROM events e LEFT JOIN headers h ON h.number = e.event_id")
def is_canonical(s: S, d: str) -> DataFrame:
    asked = _probes(s, d).withColumn("asked", v.block_hash(F.col("number") - F.col("number") % 3))
    return asked.join(v.headers(s, d), "number", "left").select("number", F.coalesce(F.col("hash") == F.col("asked"), F.lit(False)).alias("canonical"))


@query("txs bodies", "SELECT t.hash, t.number, b.base_txn_id + 1 + t.idx AS txn_id FROM txs t JOIN bodies b USING (number)")
def txn_lookup(s: S, d: str) -> DataFrame:
    """Block and transaction number of every transaction hash: the place in its block is one after the system transaction."""
    found = v.txs(s, d).join(v.bodies(s, d), "number").select("hash", "number", (F.col("base_txn_id") + 1 + F.col("idx")).alias("txn_id"))
    return v.txs(s, d).select("hash").join(found, "hash")


@query("bodies", "SELECT e.event_id AS tx, min(b.number) AS number FROM events e LEFT JOIN bodies b ON b.max_txn_id >= e.event_id AND b.base_txn_id <= e.event_id GROUP BY 1")
def txnum_to_block(s: S, d: str) -> DataFrame:
    """The first block whose last transaction is at or after each transaction number."""
    return lookup.forward_asof(v.table(s, d, "events").select(F.col("event_id").alias("tx")), v.bodies(s, d), "tx", "max_txn_id", "number")


@query("bodies", "SELECT number, max_txn_id FROM bodies")
def max_txnum(s: S, d: str) -> DataFrame:
    return v.bodies(s, d).select("number", "max_txn_id")


@query("headers", "SELECT h.number, h.number % 7 AS distance, a.number AS ancestor_number, a.hash AS ancestor_hash FROM headers h LEFT JOIN headers a ON a.number = h.number - h.number % 7")
def read_ancestor(s: S, d: str) -> DataFrame:
    probes = v.headers(s, d).select("number", (F.col("number") % 7).alias("distance"))
    return lookup.ancestor(probes, v.headers(s, d), "distance").select("number", "distance", "ancestor_number", "ancestor_hash")


@query("bodies", "SELECT number, coalesce(lag(max_txn_id) OVER (ORDER BY number) + 1 = base_txn_id, base_txn_id = 0) AS contiguous FROM bodies")
def integrity_txn_ids(s: S, d: str) -> DataFrame:
    """Whether each block's first id follows the last of the block before."""
    b = v.bodies(s, d)
    before = b.select((F.col("number") + 1).alias("number"), F.col("max_txn_id").alias("_last"))
    return b.join(before, "number", "left").select("number", F.coalesce(F.col("_last") + 1 == F.col("base_txn_id"), F.col("base_txn_id") == 0).alias("contiguous"))


@query("headers", "SELECT number // 1000 AS segment, min(number) AS first, max(number) AS last, min(number) = (number // 1000) * 1000 AND max(number) - min(number) + 1 = count(*) AS whole FROM headers GROUP BY number // 1000")
def integrity_headers(s: S, d: str) -> DataFrame:
    seg = F.floor(F.col("number") / 1000).alias("segment")
    g = v.headers(s, d).groupBy(seg).agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("n"))
    return g.select("segment", "first", "last", ((F.col("first") == F.col("segment") * 1000) & (F.col("last") - F.col("first") + 1 == F.col("n"))).alias("whole"))


@query("headers", "SELECT number, parent_hash, hash, beneficiary, timestamp FROM headers")
def headers_scan(s: S, d: str) -> DataFrame:
    return v.headers(s, d).select("number", "parent_hash", "hash", "beneficiary", "timestamp")


@query("headers", "SELECT number, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS at, beneficiary // 1000 AS gwei FROM headers")
def header_render(s: S, d: str) -> DataFrame:
    return v.headers(s, d).select("number", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.floor(F.col("beneficiary") / 1000).alias("gwei"))


@query("txs", "SELECT e.event_id AS number, sha256('' || (e.event_id - e.event_id % 3)) AS asked, substr(t.hash, 1, 2) AS h0, substr(t.hash, 1, 2) = substr(sha256('' || (e.event_id - e.event_id % 3)), 1, 2) AS fits FROM events e JOIN txs t ON t.number = e.event_id AND t.idx = 0")
def hash0_check(s: S, d: str) -> DataFrame:
    """An index without keys gives some record for any hash: the first byte of the hash asked for against the record's
    marker byte tells most that aren't meant. Asked for are hashes that are mostly of no transaction."""
    asked = _probes(s, d).withColumn("asked", v.block_hash(F.col("number") - F.col("number") % 3))
    records = v.txs(s, d).where("idx = 0").select("number", F.substring("hash", 1, 2).alias("h0"))
    return asked.join(records, "number").select("number", "asked", "h0", (F.col("h0") == F.substring("asked", 1, 2)).alias("fits"))


@query("txs", "SELECT number, idx, substr(hash, 3, 40) AS sender, substr(hash, 43) AS rlp FROM txs")
def strip_marker(s: S, d: str) -> DataFrame:
    """A transaction word is a marker byte, a sender of 20 bytes and the rest."""
    word = F.unhex("hash")
    return v.txs(s, d).select("number", "idx", F.lower(F.hex(F.substring(word, 2, 20))).alias("sender"), F.lower(F.hex(F.substring(word, 22, 11))).alias("rlp"))


@query("txs", "SELECT e.event_id AS number, count(t.idx) > 0 AS has_senders FROM events e LEFT JOIN txs t ON t.number = e.event_id GROUP BY 1")
def has_senders(s: S, d: str) -> DataFrame:
    known = v.txs(s, d).select("number").distinct().withColumn("_has", F.lit(True))
    return _probes(s, d).join(known, "number", "left").select("number", F.coalesce("_has", F.lit(False)).alias("has_senders"))


@query("txs", "SELECT number, idx, sender, part FROM txs WHERE number >= 100 AND number < 400")
def raw_transactions(s: S, d: str) -> DataFrame:
    return v.txs(s, d).where("number >= 100 and number < 400").select("number", "idx", "sender", "part")


def _enveloped(s: S, d: str) -> DataFrame:
    """Transactions as they are stored: of five types in turn."""
    numbers = {"nonce": F.col("idx"), "gas": F.col("quantity") + 21000, "value": F.col("part"), "chain_id": F.lit(1), "gas_price": F.col("sender"), "tip": F.lit(7), "blob_fee": F.lit(3), "v": F.when(F.col("kind") == 0, 37).otherwise(1), "r": F.col("number") + 1, "s": F.col("number") + 2}
    texts = {"to": F.unhex(F.substring("hash", 1, 40)), "data": F.unhex("hash")}
    fields = {n: codecs.rlp_integer(c) for n, c in numbers.items()} | {n: codecs.rlp_item(c) for n, c in texts.items()} | {n: F.unhex(F.lit("c0")) for n in codecs.LISTS}
    # Items, then lists of them, then envelopes: an expression that stands in the next one many times is a column first.
    items = v.txs(s, d).withColumn("kind", F.col("idx") % 5).select("number", "idx", "kind", *[c.alias(f"_{n}") for n, c in fields.items()])
    body = F.lit(None)
    for kind, names in {0: codecs.LEGACY, **codecs.TYPED}.items():
        body = F.when(F.col("kind") == kind, F.concat(*[F.col(f"_{n}") for n in names])).otherwise(body)
    lists = items.select("number", "idx", "kind", body.alias("_body"))
    envelope = F.when(F.col("kind") == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.lpad(F.hex("kind"), 2, "0")))
    return lists.select("number", "idx", F.concat(envelope, codecs.rlp_list(F.col("_body"))).alias("data"))


@query("txs", """SELECT number, idx, (idx % 5)::INT AS type, 1::BIGINT AS chain_id, idx AS nonce, quantity + 21000 AS gas, substr(hash, 1, 40) AS "to",
CASE WHEN length(hex(part)) % 2 = 1 THEN '0' ELSE '' END || lower(hex(part)) AS value, CASE WHEN idx % 5 > 1 THEN '07' END AS tip, hash AS data FROM (SELECT * REPLACE (nullif(part, 0) AS part) FROM txs) WHERE part IS NOT NULL
UNION ALL SELECT number, idx, (idx % 5)::INT, 1::BIGINT, idx, quantity + 21000, substr(hash, 1, 40), '', CASE WHEN idx % 5 > 1 THEN '07' END, hash FROM txs WHERE part = 0""")
def typed_transactions(s: S, d: str) -> DataFrame:
    """Transactions decoded from their envelopes."""
    shown = lambda c: F.lower(F.hex(f"t.{c}")).alias(c)
    found = _enveloped(s, d).select("number", "idx", codecs.transactions("data").alias("t"))
    return found.select("number", "idx", "t.type", "t.chain_id", "t.nonce", "t.gas", shown("to"), shown("value"), shown("tip"), shown("data"))


@query("", "SELECT sha256(e.event_id::VARCHAR) AS hash, o.o_orderkey AS number FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id AND o.o_orderstatus = 'P'")
def bad_header_number(s: S, d: str) -> DataFrame:
    """The number of a header marked as bad, by its hash; null for any other hash. Marked are those of status P."""
    bad = v.table(s, d, "orders").where("o_orderstatus = 'P'").select(v.block_hash(F.col("o_orderkey")).alias("hash"), F.col("o_orderkey").alias("number"))
    return _probes(s, d).select(v.block_hash(F.col("number")).alias("hash")).join(bad, "hash", "left")


INDEXED = 1 << 12


def _indexed(s: S, d: str) -> DataFrame:
    """Headers in files of so many numbers, with the offset of each in its file."""
    return v.headers(s, d).select(F.floor(F.col("number") / INDEXED).cast("string").alias("file"), F.unhex("hash").alias("key"), (F.col("number") % INDEXED * 17).alias("offset"))


@query("headers", f"SELECT number // {INDEXED} AS file, hash, number % {INDEXED} AS ordinal, number % {INDEXED} * 17 AS \"offset\" FROM headers")
def perfect_lookup(s: S, d: str) -> DataFrame:
    """Every header's hash found by the minimal perfect hash index of its file."""
    rows = _indexed(s, d)
    found = indexes.find(indexes.index_files(rows), rows).where("known")
    return found.select(F.col("file").cast("long").alias("file"), F.lower(F.hex("key")).alias("hash"), "ordinal", "offset")


@query("headers", f"SELECT number // {INDEXED} AS file, count(*) AS n_keys, (count(*) + 99) // 100 AS buckets, 2 AS record_bytes, count(*) AS existence_bytes FROM headers GROUP BY 1 HAVING count(*) > 256")
def perfect_open(s: S, d: str) -> DataFrame:
    """What the headers of indexes say, of those with more than 256 keys."""
    found = indexes.open_indexes(indexes.index_files(_indexed(s, d))).where("n_keys > 256")
    return found.select(F.col("file").cast("long").alias("file"), "n_keys", "buckets", F.col("record_bytes").cast("int").alias("record_bytes"), "existence_bytes")


@query()
def perfect_sizes(s: S, d: str) -> DataFrame:
    """Bytes of each index by its sections, and bits of seeds a key."""
    found = indexes.open_indexes(indexes.index_files(_indexed(s, d)))
    rest = F.col("size") - F.col("offset_bytes") - F.col("seed_bytes") - F.col("existence_bytes") - F.col("bucket_bytes")
    return found.select("file", "n_keys", "size", "offset_bytes", "seed_bytes", "existence_bytes", "bucket_bytes", rest.alias("record_bytes"), (8.0 * F.col("seed_bytes") / F.col("n_keys")).alias("bits_per_key"))


@query("files", 'SELECT kind, start, "end" FROM files f WHERE (SELECT count(DISTINCT kind) FROM files g WHERE g.start = f.start AND g."end" = f."end") > 1')
def cross_domain_files(s: S, d: str) -> DataFrame:
    """Files that pass a check of the user's against the other kinds: here, that one of them has the same range."""
    files = v.files(s)

    def matched(own: DataFrame) -> DataFrame:
        other = files.select(F.col("kind").alias("_kind"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        return own.join(other, (F.col("kind") != F.col("_kind")) & (F.col("start") == F.col("_start")) & (F.col("end") == F.col("_end")), "left_semi")

    return scan.checked_files(files, matched)


@query("files", 'SELECT kind, start, "end" FROM (SELECT *, max("end") OVER (PARTITION BY kind ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM files) WHERE r IS NULL OR "end" > r')
def visible_files(s: S, d: str) -> DataFrame:
    return scan.visible_files(v.files(s))


@query("files", 'SELECT kind, start, "end" FROM files WHERE start < 1000')
def files_below_step(s: S, d: str) -> DataFrame:
    return v.files(s).where("start < 1000")


@query("files", 'SELECT kind, start, "end" FROM files EXCEPT SELECT * FROM accessors')
def files_not_in_list(s: S, d: str) -> DataFrame:
    return v.files(s).join(v.accessors(s), ["kind", "start", "end"], "left_anti")


@query("files", 'SELECT kind, start, "end" FROM files f WHERE "end" - start >= 500 AND NOT EXISTS (SELECT 1 FROM accessors a WHERE a.kind = f.kind AND a.start = f.start AND a."end" = f."end")')
def missed_accessors(s: S, d: str) -> DataFrame:
    return v.files(s).where(F.col("end") - F.col("start") >= 500).join(v.accessors(s), ["kind", "start", "end"], "left_anti")


@query("files", 'SELECT kind, max("end") - 1 AS frozen, max("end") AS prune_to FROM files GROUP BY kind')
def frozen_boundaries(s: S, d: str) -> DataFrame:
    return v.files(s).groupBy("kind").agg((F.max("end") - 1).alias("frozen"), F.max("end").alias("prune_to"))


@query("files", 'SELECT kind, count(*) AS files, min(start) AS first, max("end") AS last FROM files GROUP BY kind')
def manifest_open(s: S, d: str) -> DataFrame:
    return v.files(s).groupBy("kind").agg(F.count("*").alias("files"), F.min("start").alias("first"), F.max("end").alias("last"))


@query("files", """SELECT kind, printf('v1-%06d-%06d-%s.seg', start // 1000, "end" // 1000, kind) AS name FROM files""")
def file_names(s: S, d: str) -> DataFrame:
    return v.files(s).select("kind", scalars.file_name(F.col("start"), F.col("end"), F.col("kind")).alias("name"))


@query("files", """SELECT kind, name, total - 5 AS more FROM (SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name) AS place, count(*) OVER (PARTITION BY kind) AS total
FROM (SELECT kind, printf('v1-%06d-%06d-%s.seg', start // 1000, "end" // 1000, kind) AS name FROM files)) WHERE place <= 5""")
def list_files(s: S, d: str) -> DataFrame:
    """The first five names of each kind, and how many more there are (negative: so many fewer than five)."""
    names = file_names(s, d)
    kinds = names.groupBy("kind").agg(F.count("*").alias("total"))
    at = F.row_number().over(Window.partitionBy("kind").orderBy("name"))
    return names.withColumn("at", at).where("at <= 5").join(kinds, "kind").select("kind", "name", (F.col("total") - 5).alias("more"))


@query("", "SELECT e.event_id AS id, s.s_name AS name FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.event_id")
def entity_by_id(s: S, d: str) -> DataFrame:
    known = v.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return v.table(s, d, "events").select(F.col("event_id").alias("id")).join(known, "id", "left")


@query("", "SELECT event_type AS kind, max(event_id) AS last FROM events GROUP BY 1")
def last_entity_id(s: S, d: str) -> DataFrame:
    return v.table(s, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.max("event_id").alias("last"))


@query("", """SELECT event_id AS id, (SELECT count(*) FROM events WHERE event_id >= 50 AND ts < TIMESTAMP '2024-01-02') > 20 AS limited
FROM events WHERE event_id >= 50 AND ts < TIMESTAMP '2024-01-02' ORDER BY event_id LIMIT 20""")
def events_from_id(s: S, d: str) -> DataFrame:
    """The first 20 events from an id up to a time, and whether the limit cut any off: one more row is looked at."""
    found = v.table(s, d, "events").where("event_id >= 50 and ts < timestamp_ntz '2024-01-02'").select(F.col("event_id").alias("id")).orderBy("id").limit(21)
    numbered = found.withColumn("_n", F.row_number().over(Window.orderBy("id"))).withColumn("limited", F.count("*").over(Window.partitionBy()) > 20)
    return numbered.where("_n <= 20").select("id", "limited")

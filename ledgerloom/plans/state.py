"""Queries over versioned state, ETL policies, sequences and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import etl, succinct, temporal
from ..sources import domains
from . import views as v
from .registry import query

S = SparkSession
LAST_STEP = v.COLD_END // v.STEP

LATEST = "SELECT key, arg_max(tx, tx) AS tx, arg_max(step, tx) AS step, arg_max(value, tx) AS value FROM {} GROUP BY key"


@query("changes", f"SELECT * FROM ({LATEST.format('hot')}) WHERE (step + 1) * {v.STEP} - 1 >= {v.COLD_END}")
def latest_hot(s: S, d: str) -> DataFrame:
    return temporal.visible_hot(v.hot(s, d), v.COLD_END, v.STEP)


@query("changes", LATEST.format("cold"))
def latest_cold(s: S, d: str) -> DataFrame:
    return temporal.latest(v.cold(s, d))


GET_LATEST = f""", h AS (SELECT * FROM ({LATEST.format('hot')}) WHERE (step + 1) * {v.STEP} - 1 >= {v.COLD_END}), c AS ({LATEST.format('cold')}),
g AS (SELECT key, coalesce(h.tx, c.tx) AS tx, coalesce(h.step, c.step) AS step, coalesce(h.value, c.value) AS value FROM h FULL JOIN c USING (key)) """


@query("changes", GET_LATEST + "SELECT * FROM g WHERE value <> ''")
def get_latest(s: S, d: str) -> DataFrame:
    return temporal.get_latest(v.hot(s, d), v.cold(s, d), v.COLD_END, v.STEP)


@query("changes", GET_LATEST + "SELECT key, value FROM g WHERE value <> '' AND key >= 20 AND key < 90")
def range_latest(s: S, d: str) -> DataFrame:
    return etl.extract_range(get_latest(s, d).select("key", "value"), "key", 20, 90)


@query("changes", f"SELECT * FROM ({LATEST.format('(SELECT * FROM changes WHERE tx < 300)')}) WHERE value <> ''")
def get_as_of(s: S, d: str) -> DataFrame:
    return temporal.as_of(v.changes(s, d), 300)


@query("changes", LATEST.format("(SELECT * FROM cold WHERE (step + 1) * 100 <= 400)"))
def get_as_of_file(s: S, d: str) -> DataFrame:
    """Only files that end by the transaction count."""
    return temporal.latest(v.cold(s, d).where((F.col("step") + 1) * v.STEP <= 400))


@query("changes", f"SELECT key, value FROM ({LATEST.format('(SELECT * FROM changes WHERE tx < 300)')}) WHERE value <> '' AND key >= 10 AND key < 120 ORDER BY key LIMIT 50")
def range_as_of(s: S, d: str) -> DataFrame:
    """The first fifty keys of a range as of a transaction."""
    return etl.extract_range(temporal.as_of(v.changes(s, d), 300).select("key", "value"), "key", 10, 120).orderBy("key").limit(50)


@query("changes", "SELECT key, min(tx) AS first, max(tx) AS last, count(*) AS n FROM changes GROUP BY key")
def history_bounds(s: S, d: str) -> DataFrame:
    return v.changes(s, d).groupBy("key").agg(F.min("tx").alias("first"), F.max("tx").alias("last"), F.count("*").alias("n"))


@query("changes", "SELECT min(step) AS first, max(step) AS last, count(DISTINCT step) AS n, max(step) > 5 AS can_build FROM changes")
def step_bounds(s: S, d: str) -> DataFrame:
    steps = v.changes(s, d).groupBy("step").agg(F.lit(1).alias("one"))
    return steps.agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count("*").alias("n"), (F.max("step") > LAST_STEP).alias("can_build"))


@query("changes", "SELECT key, arg_max(tx, tx) AS tx, 3 AS step, arg_max(value, tx) AS value FROM changes WHERE step = 3 GROUP BY key")
def collate_step(s: S, d: str) -> DataFrame:
    return temporal.collate(v.changes(s, d), 3)


@query("changes", "SELECT key, tx, upper(value) AS value FROM (SELECT key, max(tx) AS tx, arg_max(value, tx) AS value FROM changes WHERE tx >= 200 AND tx < 600 GROUP BY key)")
def collate_range(s: S, d: str) -> DataFrame:
    """The last change of each key in a range of transactions, through a value transformer."""
    found = temporal.latest(etl.extract_range(v.changes(s, d), "tx", 200, 600))
    return found.select("key", "tx", F.upper("value").alias("value"))


@query("changes", "SELECT key, step, max(tx) AS tx, arg_max(value, tx) AS value FROM changes GROUP BY key, step")
def domain_upsert(s: S, d: str) -> DataFrame:
    return temporal.upsert(v.changes(s, d))


@query("changes", "SELECT key, tx FROM changes WHERE step <= 3 ORDER BY key, tx LIMIT 200")
def prune_plan(s: S, d: str) -> DataFrame:
    """The next two hundred rows that pruning takes, in key order; it goes on from the last of them."""
    return v.changes(s, d).where("step <= 3").orderBy("key", "tx").select("key", "tx").limit(200)


PRUNED = 150


@query("changes", f"SELECT (place - 1) // {PRUNED} + 1 AS run, key, step, tx FROM (SELECT *, row_number() OVER (ORDER BY key, step DESC, tx DESC) AS place FROM changes WHERE step <= 3) WHERE place <= 2 * {PRUNED}")
def prune_resumed(s: S, d: str) -> DataFrame:
    """Two runs of pruning: the second one starts at the key that the first one has saved, without what that one deleted."""
    changes = v.changes(s, d)
    first, resume = temporal.prune(changes, 3, PRUNED)
    first = first.select(F.lit(1).cast("long").alias("run"), "key", "step", "tx")
    if resume is None:
        return first
    left = changes.join(first.select("key", "step", "tx"), ["key", "step", "tx"], "left_anti").select(*changes.columns)
    second, _ = temporal.prune(left, 3, PRUNED, resume)
    return first.unionByName(second.select(F.lit(2).cast("long").alias("run"), "key", "step", "tx"))


def _built(s: S, d: str) -> domains.Built:
    return domains.build_files(v.changes(s, d), "accounts", 0, LAST_STEP)


STEP_KEYS = f"(SELECT step, key, arg_max(value, tx) AS value FROM changes WHERE step < {LAST_STEP} GROUP BY step, key)"


@query("changes", f"SELECT 'accounts' AS kind, step AS start, step + 1 AS \"end\", count(*) AS n_keys, 2 * count(*) AS n_words FROM {STEP_KEYS} GROUP BY step")
def build_files(s: S, d: str) -> DataFrame:
    """The cold steps as segments of keys and values with their indexes, and what the manifest says of them."""
    return _built(s, d).manifest.select("kind", "start", "end", "n_keys", "n_words")


@query("changes", f"SELECT p.step AS start, p.key, k.value FROM (SELECT DISTINCT user_id AS key, event_id * 7 % {LAST_STEP} AS step FROM events) p JOIN {STEP_KEYS} k USING (step, key)")
def file_get(s: S, d: str) -> DataFrame:
    """Values of keys asked for in files that may have them, by the files' indexes."""
    asked = v.table(s, d, "events").select(domains.file_of("accounts", F.col("event_id") * 7 % LAST_STEP).alias("file"), F.col("user_id").alias("key")).distinct()
    return domains.get(_built(s, d), asked).select("start", "key", "value")


@query("changes", "SELECT step, min(tx) AS first, max(tx) AS last, count(*) AS n, count(*) FILTER (WHERE value = '') AS deletions FROM changes GROUP BY step")
def prune_stats(s: S, d: str) -> DataFrame:
    return v.changes(s, d).groupBy("step").agg(F.min("tx").alias("first"), F.max("tx").alias("last"), F.count("*").alias("n"), F.count_if(F.col("value") == "").alias("deletions"))


@query("changes", """SELECT key, min(tx) AS tx, arg_min(p, tx) AS restored FROM (SELECT *, coalesce(lag(value) OVER (PARTITION BY key ORDER BY tx), '') AS p FROM changes) WHERE tx >= 700 GROUP BY key""")
def unwind(s: S, d: str) -> DataFrame:
    return temporal.unwind(v.changes(s, d), 700)


@query("", "SELECT o_custkey AS key, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS at FROM orders")
def etl_sort(s: S, d: str) -> DataFrame:
    """Rows in key order, arrival order within a key: a range shuffle and a sort in each range."""
    rows = v.table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"))
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("seq")).cast("long"))
    return placed.repartitionByRange("key", "seq").sortWithinPartitions("key", "seq")


@query("", "SELECT o_custkey AS key, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS value FROM orders GROUP BY 1")
def etl_append(s: S, d: str) -> DataFrame:
    rows = v.table(s, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderstatus")
    return etl.append_values(rows, "key", F.col("o_orderstatus"), "o_orderkey")


@query("", "SELECT o_custkey AS key, arg_min(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1")
def etl_oldest(s: S, d: str) -> DataFrame:
    return etl.oldest(v.table(s, d, "orders").withColumnRenamed("o_custkey", "key"), "key", "o_orderstatus", "o_orderkey")


@query("", "SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1")
def etl_last(s: S, d: str) -> DataFrame:
    return etl.last(v.table(s, d, "orders").withColumnRenamed("o_custkey", "key"), "key", "o_orderstatus", "o_orderkey")


@query("", "SELECT o_custkey AS key, o_orderkey AS tx FROM orders WHERE o_custkey >= 100 AND o_custkey < 300")
def etl_extract_range(s: S, d: str) -> DataFrame:
    return etl.extract_range(v.table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("tx")), "key", 100, 300)


@query("", """SELECT key, sum(n)::BIGINT AS total FROM (SELECT l_suppkey AS key, l_quantity::BIGINT AS n FROM lineitem WHERE l_orderkey >= 10
UNION ALL SELECT l_partkey, 1 FROM lineitem WHERE l_orderkey >= 10) GROUP BY key""")
def etl_transform(s: S, d: str) -> DataFrame:
    """A range is extracted, each row becomes two entries, and equal keys are summed on load."""
    entry = lambda k, n: F.struct(F.col(k).alias("key"), n.cast("long").alias("n"))
    both = lambda: F.array(entry("l_suppkey", F.col("l_quantity")), entry("l_partkey", F.lit(1)))
    return etl.transform(v.table(s, d, "lineitem"), "l_orderkey", both, lambda e: e.groupBy("key").agg(F.sum("n").alias("total")), 10)


@query("", "SELECT event_id AS key, '[0,1000000) ' || event_type AS value FROM events WHERE event_id < 1000000")
def collate_large(s: S, d: str) -> DataFrame:
    """Values of keys that may stand once only, through a transformer that is told of the range."""
    rows = v.table(s, d, "events").select(F.col("event_id").alias("key"), F.col("event_id").alias("tx"), F.col("event_type").alias("value"))
    return temporal.collate_large(rows, 0, 1_000_000, lambda value, start, end: F.concat(F.lit(f"[{start},{end}) "), value))


@query("", """SELECT coalesce(c.key, s.key) AS key, CASE WHEN s.key IS NULL THEN c.value ELSE s.value END AS value
FROM (SELECT c_custkey AS key, c_mktsegment AS value FROM customer) c FULL JOIN (SELECT s_suppkey * 3 AS key, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END AS value FROM supplier) s USING (key)
WHERE CASE WHEN s.key IS NULL THEN c.value ELSE s.value END IS NOT NULL""")
def etl_load_merge(s: S, d: str) -> DataFrame:
    target = v.table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    new = v.table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("key"), F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("value"))
    return etl.load_merge(target, new, "key", "value")


@query("words", "SELECT ordinal, doc_id FROM words")
def reorder(s: S, d: str) -> DataFrame:
    """Results that came in any order, back in theirs."""
    return v.words(s, d).select("ordinal", "doc_id").repartition("doc_id").repartitionByRange("ordinal").sortWithinPartitions("ordinal")


def _sequences(s: S, d: str) -> DataFrame:
    """A monotone sequence for each customer: its order numbers, with their place."""
    rows = v.table(s, d, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("value"))
    return rows.withColumn("i", (F.row_number().over(Window.partitionBy("seq").orderBy("value")) - 1).cast("long"))


SEQ = "WITH s AS (SELECT o_custkey AS seq, o_orderkey AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) "
SEEKS = ", p AS (SELECT DISTINCT o_custkey AS seq, (o_custkey * 37) % 15000 AS x FROM orders) "


def _seeks(s: S, d: str) -> DataFrame:
    return v.table(s, d, "orders").select(F.col("o_custkey").alias("seq"), ((F.col("o_custkey") * 37) % 15000).alias("x")).distinct()


@query("", SEQ + "SELECT seq, i, value FROM s")
def ef_get(s: S, d: str) -> DataFrame:
    return _sequences(s, d)


@query("", SEQ + "SELECT seq, i, value FROM s")
def ef_stored(s: S, d: str) -> DataFrame:
    """Each customer's sequence as bytes, and read back. A sequence is a bounded group."""
    listed = _sequences(s, d).groupBy("seq").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return succinct.loaded(listed.select("seq", succinct.stored("values").alias("data")), "data", "seq")


@query("", SEQ + "SELECT seq, i, value, lead(value) OVER (PARTITION BY seq ORDER BY i) AS following FROM s")
def ef_get2(s: S, d: str) -> DataFrame:
    return succinct.neighbours(_sequences(s, d), "seq").drop("delta")


@query("", SEQ + SEEKS + "SELECT p.seq, x, min(value) AS found FROM p LEFT JOIN s ON s.seq = p.seq AND value >= x GROUP BY ALL")
def ef_seek(s: S, d: str) -> DataFrame:
    return succinct.seek(_sequences(s, d), _seeks(s, d), ["seq"])


@query("", SEQ + SEEKS + "SELECT p.seq, x, max(value) AS found FROM p LEFT JOIN s ON s.seq = p.seq AND value <= x GROUP BY ALL")
def ef_seek_reverse(s: S, d: str) -> DataFrame:
    return succinct.seek(_sequences(s, d), _seeks(s, d), ["seq"], reverse=True)


@query("", SEQ + """, w AS (SELECT seq, CASE WHEN (max(value) + 1) // count(*) <= 1 THEN 0 ELSE floor(log2((max(value) + 1) // count(*)))::INT END AS width FROM s GROUP BY 1)
SELECT seq, i, value, width, value % (1 << width) AS low, value // (1 << width) + i AS high FROM s JOIN w USING (seq)""")
def ef_split(s: S, d: str) -> DataFrame:
    return succinct.split(_sequences(s, d), "seq")


@query("", SEQ + "SELECT seq, count(*) AS n, min(value) AS least, max(value) AS most FROM s GROUP BY 1")
def ef_stats(s: S, d: str) -> DataFrame:
    return succinct.stats(_sequences(s, d), "value", "seq")


@query("", SEQ + "SELECT seq, i, value FROM s WHERE value >= 500")
def ef_iterate(s: S, d: str) -> DataFrame:
    """Each sequence from a place on, in falling order."""
    return _sequences(s, d).where("value >= 500").repartition("seq").sortWithinPartitions("seq", F.col("i").desc())


@query("bodies", "SELECT number AS i, base_txn_id AS cum_keys, lead(base_txn_id) OVER (ORDER BY number) AS next_cum_keys, max_txn_id AS position FROM bodies")
def double_ef_get3(s: S, d: str) -> DataFrame:
    """Two interleaved sequences: a cumulative count, the next one, and a position."""
    b = v.bodies(s, d)
    after = b.select((F.col("number") - 1).alias("number"), F.col("base_txn_id").alias("next_cum_keys"))
    return b.join(after, "number", "left").select(F.col("number").alias("i"), F.col("base_txn_id").alias("cum_keys"), "next_cum_keys", F.col("max_txn_id").alias("position"))


@query("", SEQ + "SELECT seq, min(x) AS min_delta FROM (SELECT seq, value - lag(value) OVER (PARTITION BY seq ORDER BY i) AS x FROM s) GROUP BY 1")
def min_delta(s: S, d: str) -> DataFrame:
    return succinct.neighbours(_sequences(s, d), "seq").groupBy("seq").agg(F.min("delta").alias("min_delta"))


@query("", SEQ + """, m AS (SELECT seq, coalesce(min(x), 0) AS m FROM (SELECT seq, value - lag(value) OVER (PARTITION BY seq ORDER BY i) AS x FROM s) GROUP BY 1)
SELECT seq, i, value - i * m AS rest FROM s JOIN m USING (seq)""")
def ef_min_delta(s: S, d: str) -> DataFrame:
    """Sequences with their least step taken out, as they are stored."""
    least = min_delta(s, d).select(F.col("seq").alias("_s"), F.coalesce("min_delta", F.lit(0)).alias("m"))
    return _sequences(s, d).join(least, F.col("seq") == F.col("_s")).select("seq", "i", (F.col("value") - F.col("i") * F.col("m")).alias("rest"))


@query("", """SELECT o_orderkey AS key, (o_custkey % 4)::INT AS n, list_filter(range(0, 64), lambda b: (o_orderkey >> b) & 1 = 1)[o_custkey % 4 + 1]::INT AS at FROM orders""")
def select64(s: S, d: str) -> DataFrame:
    n = (F.col("o_custkey") % 4).cast("int")
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("key"), n.alias("n"), succinct.select_bit(F.col("o_orderkey"), n).alias("at"))


BITS = "CASE WHEN {0} = 0 THEN 0 ELSE length(ltrim(bin({0}), '0')) END"


@query("", f"SELECT l_orderkey * l_partkey AS x, greatest(1, ceil({BITS.format('(l_orderkey * l_partkey)')} / 7.0))::INT AS n FROM lineitem")
def uvarint_len(s: S, d: str) -> DataFrame:
    x = F.col("l_orderkey") * F.col("l_partkey")
    return v.table(s, d, "lineitem").select(x.alias("x"), scalars.uvarint_length(x).alias("n"))


@query("", "SELECT o_orderkey AS x, reverse(lpad(bin(o_orderkey), 64, '0')) AS bits FROM orders")
def reverse_bits(s: S, d: str) -> DataFrame:
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("x"), scalars.reverse_bits(F.col("o_orderkey")).alias("bits"))


@query("", "SELECT o_orderkey AS x, lpad(lower(hex(o_orderkey)), 16, '0') AS bytes FROM orders")
def be_u64(s: S, d: str) -> DataFrame:
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("x"), F.lower(F.hex(scalars.be_u64(F.col("o_orderkey")))).alias("bytes"))


@query("changes", "SELECT DISTINCT step, lower(hex((18446744073709551615::HUGEINT - step)::UBIGINT)) AS bytes FROM changes")
def inverted_step(s: S, d: str) -> DataFrame:
    return v.changes(s, d).select("step").distinct().select("step", F.lower(F.hex(scalars.inverted_step(F.col("step")))).alias("bytes"))


@query("", f"SELECT o_orderkey AS x, ceil({BITS.format('o_orderkey')} / 8.0)::INT AS n FROM orders")
def bytes_per_rec(s: S, d: str) -> DataFrame:
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("x"), scalars.bytes_per_record(F.col("o_orderkey")).alias("n"))


@query("", "SELECT o_orderkey AS x, ['none', 'k', 'v', 'kv'][o_orderkey % 4 + 1] AS flag FROM orders")
def compression_flags(s: S, d: str) -> DataFrame:
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("x"), scalars.compression_flag(F.col("o_orderkey") % 4).alias("flag"))


KEYS = "CASE p_partkey % 4 WHEN 0 THEN lower(hex(p_name)) WHEN 1 THEN lpad(lower(hex(p_partkey)), 16, '0') || '0a' WHEN 2 THEN lpad(lower(hex(p_partkey)), 8, '0') ELSE lpad(lower(hex(p_partkey % 256)), 2, '0') END"


@query("", f"SELECT x, CASE WHEN length(k) < 8 THEN k WHEN length(k) >= 16 AND left(k, 8) = '00000000' THEN k ELSE left(k, 8) END AS key FROM (SELECT p_partkey AS x, {KEYS} AS k FROM part)")
def key_str(s: S, d: str) -> DataFrame:
    """Keys of names, of numbers in nine and in four bytes, so with leading zeros, and of one byte."""
    number = lambda n: F.lpad(F.hex("p_partkey"), n, "0")
    kind = F.col("p_partkey") % 4
    key = F.when(kind == 0, F.encode("p_name", "utf-8")).when(kind == 1, F.unhex(F.concat(number(16), F.lit("0a")))).when(kind == 2, F.unhex(number(8))).otherwise(F.unhex(F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0")))
    return v.table(s, d, "part").select(F.col("p_partkey").alias("x"), scalars.key_string(key).alias("key"))


@query("", """SELECT p_partkey AS x, CASE WHEN m > 240 THEN 2 WHEN m > 48 THEN (m + 47) // 48 ELSE (m + 7) // 8 END AS fanout,
  CASE WHEN m > 240 THEN (((m + 1) // 2 + 239) // 240) * 240 WHEN m > 48 THEN 48 ELSE 8 END AS unit FROM (SELECT p_partkey, (p_partkey % 2000 + 1)::INT AS m FROM part)""")
def split_params(s: S, d: str) -> DataFrame:
    """How a hash index would divide groups of up to 2000 keys, for leaves of 8 and bounds of 48 and 240."""
    found = v.table(s, d, "part").select("p_partkey", scalars.split_parameters((F.col("p_partkey") % 2000 + 1).cast("int"), 8, 48, 240).alias("p"))
    return found.select(F.col("p_partkey").alias("x"), "p.fanout", "p.unit")

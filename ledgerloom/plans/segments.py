"""Queries over word segments: scans, predicates, pages, indexes, dictionaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import dictionary, lookup, predicates, scan
from ..operators.positions import with_positions
from ..sources import segments as compressed
from ..sources import words as files
from . import views as v
from .registry import query

S = SparkSession

#: A prefix and a buffer that words are held against.
PREFIX, BUFFER = "Th", "The the"


def hexed(c) -> Column:
    return F.lower(F.hex(c))


@query("words", "SELECT ordinal, \"offset\", \"offset\" + length AS next_offset, sha256(word) AS digest FROM words")
def word_scan(s: S, d: str) -> DataFrame:
    return v.words(s, d).select("ordinal", "offset", (F.col("offset") + F.col("length")).alias("next_offset"), F.sha2("word", 256).alias("digest"))


@query("words", "SELECT ordinal, text AS word, length FROM words")
def word_scan_raw(s: S, d: str) -> DataFrame:
    """Whole words as they are."""
    return v.words(s, d).select("ordinal", F.col("text").alias("word"), "length")


@query("words", "SELECT ordinal, text AS word, length FROM words WHERE ordinal % 3 = 0")
def word_scan_uncompressed(s: S, d: str) -> DataFrame:
    """The whole words of those that raw_words marks to stay as they are."""
    return v.words(s, d).where(F.col("ordinal") % 3 == 0).select("ordinal", F.col("text").alias("word"), "length")


@query("words", "SELECT ordinal, length FROM words")
def word_skip_lengths(s: S, d: str) -> DataFrame:
    return v.words(s, d).select("ordinal", "length")


@query("words", "SELECT ordinal, \"offset\" FROM words WHERE \"offset\" >= 100000")
def scan_from_offset(s: S, d: str) -> DataFrame:
    return scan.from_offset(v.words(s, d), 100_000).select("ordinal", "offset")


@query("words", "SELECT lang, count(*) AS n_words, count(*) FILTER (WHERE length = 0) AS n_empty, sum(length)::BIGINT AS n_bytes, max(length) AS longest FROM words GROUP BY lang")
def segment_stats(s: S, d: str) -> DataFrame:
    return scan.segment_stats(v.words(s, d), "lang")


@query("words", "SELECT a.ordinal // 2 AS pair, sha256(a.word) AS key, CASE WHEN b.word IS NOT NULL THEN sha256(b.word) END AS value FROM words a LEFT JOIN words b ON b.ordinal = a.ordinal + 1 WHERE a.ordinal % 2 = 0")
def kv_scan(s: S, d: str) -> DataFrame:
    return scan.pairs(v.words(s, d)).select("pair", F.sha2("key", 256).alias("key"), F.sha2("value", 256).alias("value"))


@query("words", "SELECT a.ordinal // 2 AS pair, a.length AS key_length, b.length AS value_length FROM words a JOIN words b ON b.ordinal = a.ordinal + 1 WHERE a.ordinal % 2 = 0 ORDER BY 1 LIMIT 100")
def kv_stream_limit(s: S, d: str) -> DataFrame:
    """The first hundred whole pairs, as the limit of the stream says."""
    whole = scan.pairs(v.words(s, d)).where(F.col("value").isNotNull()).orderBy("pair").limit(100)
    return whole.select("pair", F.octet_length("key").cast("long").alias("key_length"), F.octet_length("value").cast("long").alias("value_length"))


@query("", """WITH o AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ordinal FROM conversations)
SELECT ordinal // 16 AS page, (ordinal % 16)::INT AS at, ordinal, conv_id, turn, role FROM o""")
def paged_scan(s: S, d: str) -> DataFrame:
    entries = with_positions(v.table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"])
    return scan.paged_scan(scan.pages(entries, 16, "ordinal", "conv_id", "turn", "role"))


@query("words", f"SELECT ordinal, starts_with(word, '{PREFIX}') AS hit FROM words")
def match_prefix(s: S, d: str) -> DataFrame:
    return v.words(s, d).select("ordinal", predicates.match_prefix(F.col("word"), F.lit(PREFIX.encode())).alias("hit"))


@query("words", f"SELECT ordinal, length = 0 OR starts_with(word, '{PREFIX}') AS hit, false AS hit_empty FROM words")
def match_prefix_raw(s: S, d: str) -> DataFrame:
    word = F.col("word")
    return v.words(s, d).select("ordinal", predicates.match_prefix_raw(word, F.lit(PREFIX.encode())).alias("hit"), predicates.match_prefix_raw(word, F.lit(b"")).alias("hit_empty"))


@query("words", f"SELECT ordinal, CASE WHEN encode('{BUFFER}') < encode(word) THEN -1 WHEN encode('{BUFFER}') > encode(word) THEN 1 ELSE 0 END AS cmp FROM words")
def match_cmp(s: S, d: str) -> DataFrame:
    return v.words(s, d).select("ordinal", predicates.match_cmp(F.lit(BUFFER.encode()), F.col("word")).alias("cmp"))


@query("words", f"SELECT ordinal, CASE WHEN encode('{BUFFER}') < encode(word) THEN -1 WHEN encode('{BUFFER}') > encode(word) THEN 1 ELSE 0 END AS cmp, -1 AS cmp_empty FROM words")
def match_cmp_raw(s: S, d: str) -> DataFrame:
    word = F.col("word")
    return v.words(s, d).select("ordinal", predicates.match_cmp_raw(F.lit(BUFFER.encode()), word).alias("cmp"), predicates.match_cmp_raw(F.lit(b""), word).alias("cmp_empty"))


@query("words", "SELECT ordinal, length FROM words WHERE starts_with(word, 'The')")
def cat_pick(s: S, d: str) -> DataFrame:
    """Words with a prefix given in hexadecimal."""
    return v.words(s, d).where(F.startswith("word", F.unhex(F.lit("546865")))).select("ordinal", "length")


@query("words", "SELECT sha256(word) AS digest, count(*) - 1 AS extra FROM words GROUP BY word HAVING count(*) > 1")
def cat_duplicates(s: S, d: str) -> DataFrame:
    return scan.duplicates(v.words(s, d).select(F.sha2("word", 256).alias("digest")), "digest")


@query("words", "SELECT ordinal AS \"order\", length, ordinal % 3 <> 0 AS compressed FROM words")
def raw_words(s: S, d: str) -> DataFrame:
    """The spool of a writer: words in order, some marked to stay as they are."""
    return v.words(s, d).select(F.col("ordinal").alias("order"), "length", (F.col("ordinal") % 3 != 0).alias("compressed"))


@query("words", "SELECT doc_id AS key, ordinal, \"offset\" FROM words")
def build_index(s: S, d: str) -> DataFrame:
    return lookup.build_index(v.words(s, d).withColumnRenamed("doc_id", "key"), "key")


@query("words", "SELECT a.doc_id AS key, a.\"offset\" AS key_offset, b.\"offset\" AS value_offset FROM words a JOIN words b ON b.ordinal = a.ordinal + 1 WHERE a.ordinal % 2 = 0")
def build_kv_index(s: S, d: str) -> DataFrame:
    """For words as pairs: where each key and its value stand."""
    halves = v.words(s, d).select(F.floor(F.col("ordinal") / 2).alias("pair"), (F.col("ordinal") % 2).alias("half"), "doc_id", "offset")
    first = lambda c: F.max(F.when(F.col("half") == 0, F.col(c)))
    pairs = halves.groupBy("pair").agg(first("doc_id").alias("key"), first("offset").alias("key_offset"), F.max(F.when(F.col("half") == 1, F.col("offset"))).alias("value_offset"))
    return pairs.where(F.col("value_offset").isNotNull()).drop("pair")


@query("words", "SELECT doc_id AS key, \"offset\" * 3965 // 17 AS \"offset\" FROM words")
def index_rewrite(s: S, d: str) -> DataFrame:
    """Offsets replaced by those of a mapping table."""
    index = v.words(s, d).select(F.col("doc_id").alias("key"), "offset")
    mapping = index.select(F.col("offset").alias("_old"), F.floor(F.col("offset") * 3965 / 17).alias("_new")).distinct()
    return index.join(mapping, F.col("offset") == F.col("_old")).select("key", F.col("_new").alias("offset"))


@query("words", "SELECT e.event_id AS ordinal, w.\"offset\", w.length FROM events e LEFT JOIN words w ON w.ordinal = e.event_id")
def ordinal_lookup(s: S, d: str) -> DataFrame:
    asked = v.table(s, d, "events").select(F.col("event_id").alias("ordinal"))
    return asked.join(v.words(s, d).select("ordinal", "offset", "length"), "ordinal", "left")


@query("words", "SELECT w.doc_id AS key, l.quality, l.toxic FROM words w LEFT JOIN labels l USING (doc_id)")
def hash_lookup(s: S, d: str) -> DataFrame:
    """Lookups with misses: the key is compared in full, so nothing is found by chance."""
    asked = v.table(s, d, "documents").select(F.col("doc_id").alias("key"))
    index = v.table(s, d, "labels").select(F.col("doc_id").alias("key"), "quality", "toxic")
    return asked.join(index, "key", "left")


@query("", "SELECT c_custkey AS k1, c_nationkey AS k2, n_name AS name FROM customer LEFT JOIN (SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
def hash_lookup2(s: S, d: str) -> DataFrame:
    """A key of two parts."""
    nation = v.table(s, d, "nation").select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("name"))
    index = v.table(s, d, "supplier").select(F.col("s_suppkey").alias("k1"), F.col("s_nationkey").alias("k2")).join(nation, "k2")
    return v.table(s, d, "customer").select(F.col("c_custkey").alias("k1"), F.col("c_nationkey").alias("k2")).join(index, ["k1", "k2"], "left")


@query("words", "SELECT l.doc_id AS key, w.ordinal, w.\"offset\" FROM labels l JOIN words w ON w.doc_id = l.doc_id")
def two_layer_lookup(s: S, d: str) -> DataFrame:
    """Key to ordinal, then ordinal to offset."""
    words = v.words(s, d)
    keys, offsets = words.select(F.col("doc_id").alias("key"), "ordinal"), words.select("ordinal", "offset")
    return v.table(s, d, "labels").select(F.col("doc_id").alias("key")).join(keys, "key").join(offsets, "ordinal").select("key", "ordinal", "offset")


@query("", "SELECT e.event_id AS seek, min(l.doc_id) AS key FROM events e LEFT JOIN labels l ON l.doc_id >= e.event_id GROUP BY 1")
def binary_search(s: S, d: str) -> DataFrame:
    """The first key at or after each seek; null beyond the last."""
    keys = v.table(s, d, "labels").select(F.col("doc_id").alias("_key"))
    return lookup.forward_asof(v.table(s, d, "events").select(F.col("event_id").alias("seek")), keys, "seek", "_key", "_key").withColumnRenamed("_key", "key")


@query("", "SELECT p_name AS word, sum(p_size)::BIGINT AS score FROM part GROUP BY 1")
def dict_aggregate(s: S, d: str) -> DataFrame:
    return dictionary.aggregate(v.table(s, d, "part").select(F.col("p_name").alias("word"), F.col("p_size").cast("long").alias("score")))


@query("", "SELECT p_name AS word, sum(p_size)::BIGINT AS score FROM part GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 20")
def dict_topk(s: S, d: str) -> DataFrame:
    """The dictionary's hard limit: the twenty best patterns."""
    return dictionary.top(dict_aggregate(s, d), 20)


@query("", "SELECT (sum(p_size)::BIGINT)::VARCHAR || ' ' || lower(hex(p_name)) AS line FROM part GROUP BY p_name")
def dict_dump(s: S, d: str) -> DataFrame:
    return dict_aggregate(s, d).select(F.concat_ws(" ", F.col("score").cast("string"), hexed("word")).alias("line"))


@query("", "SELECT p_partkey AS key, s.score FROM part p JOIN (SELECT p_name AS w, sum(p_size)::BIGINT AS score FROM part GROUP BY 1) s ON s.w = p.p_name")
def dict_get(s: S, d: str) -> DataFrame:
    return v.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("word")).join(dict_aggregate(s, d), "word").select("key", "score")


@query("words", "SELECT length, count(*) AS n FROM words GROUP BY 1")
def length_distribution(s: S, d: str) -> DataFrame:
    return v.words(s, d).groupBy("length").agg(F.count("*").alias("n"))


#: The dictionary of longest_matches as SQL: the benchmark's distinct words of five characters and more; h has all matches,
#: r those that aren't within one before.
MATCHES = """p AS (SELECT DISTINCT pattern FROM (SELECT unnest(string_split(text, ' ')) AS pattern FROM benchmark) WHERE length(pattern) >= 5),
c AS (SELECT doc_id, text, i, substr(text, i, 5) AS head FROM (SELECT doc_id, text, unnest(range(1, length(text) - 3)) AS i FROM documents)),
h AS (SELECT doc_id, i - 1 AS pos, max(i - 1 + length(pattern)) AS until FROM c JOIN p ON head = left(pattern, 5) AND substr(text, i, length(pattern)) = pattern GROUP BY 1, 2),
r0 AS (SELECT *, max(until) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
r AS (SELECT doc_id, pos, until FROM r0 WHERE reach IS NULL OR until > reach)"""


@query("words", f""", {MATCHES} SELECT pos, count(*) AS uses FROM (SELECT length + 1 AS pos FROM words UNION ALL SELECT 0 FROM words
UNION ALL SELECT pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), 0) + 1 FROM r) GROUP BY 1""")
def position_histogram(s: S, d: str) -> DataFrame:
    """Uses of the position symbols: each word's length plus one, the end mark, and every longest match's start relative to
    the one before, plus one."""
    words = v.words(s, d).select(F.explode(F.array(F.col("length") + 1, F.lit(0).cast("long"))).alias("pos"))
    before = F.lag("at").over(Window.partitionBy("doc_id").orderBy("at"))
    starts = longest_matches(s, d).select((F.col("at") - F.coalesce(before, F.lit(0)) + 1).alias("pos"))
    return words.unionByName(starts).groupBy("pos").agg(F.count("*").alias("uses"))


@query()
def cover_position_histogram(s: S, d: str) -> DataFrame:
    """Uses of the position symbols when whole texts are covered by the words of the benchmark: all matches count."""
    tokens = v.table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).where(F.octet_length("word").between(dictionary.SHORTEST, dictionary.LONGEST))
    best = tokens.groupBy("word").agg(F.count("*").alias("score"))
    patterns = {r["word"].encode(): int(math.log2(1 + r["score"])) for r in best.collect()}
    return dictionary.position_uses(v.table(s, d, "documents").select(F.encode("text", "utf-8").alias("word")), "word", patterns)


@query("words", """SELECT gram, sum(n)::BIGINT AS repeats, count(*) AS holders FROM (
  SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) AS gram FROM (SELECT doc_id, string_split(text, ' ') AS t FROM words)) GROUP BY 1, 2)
GROUP BY gram HAVING sum(n) > 1""")
def ngram_repeats(s: S, d: str) -> DataFrame:
    return dictionary.ngrams(v.table(s, d, "documents"), "text", 4)


@query("", f"""WITH {MATCHES} SELECT doc_id, pos AS "at", until FROM r""")
def longest_matches(s: S, d: str) -> DataFrame:
    """The benchmark's words in all documents."""
    patterns = v.table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("pattern")).where(F.length("pattern") >= dictionary.SHORTEST)
    return dictionary.matches(v.table(s, d, "documents"), patterns, "doc_id", "text")


@query("", """WITH u AS (SELECT p_type AS symbol, count(*) AS n FROM part GROUP BY 1), t AS (SELECT sum(n) AS t FROM u)
SELECT round(sum(-n * log2(n / t)), 6) AS bits, sum(n)::BIGINT AS uses FROM u, t""")
def huffman_cost(s: S, d: str) -> DataFrame:
    """Bits that the symbols' uses need at least."""
    uses = v.table(s, d, "part").groupBy(F.col("p_type").alias("symbol")).agg(F.count("*").alias("n"))
    total = uses.agg(F.sum("n").alias("t"))
    return uses.crossJoin(F.broadcast(total)).agg(F.round(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("t"))), 6).alias("bits"), F.sum("n").alias("uses"))


VARINT = "greatest(1, ceil(length(ltrim(bin({0}), '0')) / 7.0))::BIGINT"


@query("words", f"""SELECT lang, printf('%.2f', sum({VARINT.format('length')} + length) / (24 + sum({VARINT.format('2 * length + (ordinal % 3 = 0)::INT')} + length))) AS ratio FROM words GROUP BY lang""")
def compression_ratio(s: S, d: str) -> DataFrame:
    """The size of one file of each language's words over that of another: a simple file over a word file. Sizes are summed
    up as the files would have them."""
    n = F.col("length")
    spelled = lambda x: scalars.uvarint_length(x) + n
    simple, marked = F.sum(spelled(n)), F.sum(spelled(2 * n + (F.col("ordinal") % 3 == 0).cast("int"))) + files.HEADER.size
    return v.words(s, d).groupBy("lang").agg(F.format_string("%.2f", simple / marked).alias("ratio"))


@query()
def segment_ratio(s: S, d: str) -> DataFrame:
    """Of each segment file, the size of a simple file of its words over its own."""
    raw = files.to_files(_in_files(s, d), "file", spell=lambda words: files.simple_encode([w for w, _ in words]))
    sizes = lambda df, name: df.select("file", F.octet_length("content").alias(name))
    return sizes(raw, "raw").join(sizes(_segments(s, d), "packed"), "file").select("file", F.format_string("%.2f", F.col("raw") / F.col("packed")).alias("ratio"))


@query("", """SELECT p_name AS word, i AS "at", substr(p_name, i) AS suffix, row_number() OVER (PARTITION BY p_name ORDER BY encode(substr(p_name, i))) - 1 AS rank
FROM (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS i FROM (SELECT DISTINCT p_name FROM part))""")
def suffix_array(s: S, d: str) -> DataFrame:
    """Suffixes of each word in order; a word is a bounded group."""
    words = v.table(s, d, "part").select(F.col("p_name").alias("word")).distinct()
    each = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")).withColumn("suffix", F.expr("substring(word, at)")).withColumn("at", F.col("at").cast("long"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.encode("suffix", "utf-8"))) - 1
    return each.withColumn("rank", rank.cast("long"))


@query("", """SELECT word, rank, coalesce(len(list_filter(range(1, least(length(suffix), length(before)) + 1), lambda k: substr(suffix, 1, k) = substr(before, 1, k))), 0) AS common
FROM (SELECT *, lag(suffix) OVER (PARTITION BY word ORDER BY rank) AS before FROM (SELECT p_name AS word, substr(p_name, i) AS suffix, row_number() OVER (PARTITION BY p_name ORDER BY encode(substr(p_name, i))) - 1 AS rank
FROM (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS i FROM (SELECT DISTINCT p_name FROM part))))""")
def lcp(s: S, d: str) -> DataFrame:
    """What each suffix has in common with the one before it in order; a word is a bounded group."""
    before = F.lag("suffix").over(Window.partitionBy("word").orderBy("rank"))
    both = suffix_array(s, d).withColumn("before", before)
    same = F.filter(F.sequence(F.lit(1), F.least(F.length("suffix"), F.length("before"))), lambda k: F.left("suffix", k) == F.left("before", k))
    return both.select("word", "rank", F.when(F.col("before").isNull(), 0).otherwise(F.size(same)).cast("long").alias("common"))


SUPERSTRING_BYTES, SAMPLED = 16 << 20, 4


@query("words", f""", w AS (SELECT ordinal, 2 * "offset" + 2 * ordinal AS b, 2 * "offset" + 2 * ordinal + 2 * length + 2 AS e FROM words),
s AS (SELECT * FROM (WITH RECURSIVE s(n, first, b) AS (SELECT 0::BIGINT, 0::BIGINT, 0::HUGEINT UNION ALL
  SELECT s.n + 1, min(w.ordinal), min(w.b)::HUGEINT FROM s JOIN w ON w.ordinal > s.first AND w.e - s.b > {SUPERSTRING_BYTES} GROUP BY s.n) SELECT * FROM s))
SELECT ordinal, max(n) AS superstring, max(n) % {SAMPLED} = 0 AS sampled FROM w JOIN s ON s.first <= w.ordinal GROUP BY ordinal""")
def superstring_sampling(s: S, d: str) -> DataFrame:
    """Words fill superstrings of 16 MiB one after another; every fourth is sampled."""
    return dictionary.superstrings(v.words(s, d), SUPERSTRING_BYTES, SAMPLED)


@query()
def huffman_depths(s: S, d: str) -> DataFrame:
    """Code lengths of the part types within each brand."""
    uses = v.table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return dictionary.huffman_depths(uses, "p_type", "n", "p_brand")


@query()
def cover_words(s: S, d: str) -> DataFrame:
    """The cover of all part names by a dictionary of a thousand patterns at most, taken from anywhere in the names."""
    best = dictionary.top(dictionary.pieces(dict_aggregate(s, d)), 1000)
    patterns = {r["word"].encode(): int(math.log2(1 + r["score"])) for r in best.collect()}
    return dictionary.cover_words(v.table(s, d, "part").select("p_partkey", F.encode("p_name", "utf-8").alias("word")), "p_partkey", "word", patterns)


@query()
def pattern_uses(s: S, d: str) -> DataFrame:
    return cover_words(s, d).groupBy("pattern").agg(F.count("*").alias("uses"))


FILE_SQL = f"""SELECT lang || '/' || ("offset" // {files.FILE_BYTES}) AS file, row_number() OVER (PARTITION BY lang, "offset" // {files.FILE_BYTES} ORDER BY doc_id) - 1 AS ordinal, length, word FROM words"""


def _in_files(s: S, d: str) -> DataFrame:
    """The words of each language in files of bounded size, every third not to be compressed."""
    words = files.parts(v.words(s, d), F.col("lang"))
    return words.select("file", "ordinal", "word", (F.col("ordinal") % 3 != 0).alias("compressed"))


def _segments(s: S, d: str) -> DataFrame:
    return files.to_files(_in_files(s, d), "file", spell=compressed.encode_segment)


@query("words", f"SELECT file, ordinal, length, sha256(word) AS digest FROM ({FILE_SQL})")
def segment_roundtrip(s: S, d: str) -> DataFrame:
    """Words written to word files and read back."""
    back = files.from_files(files.to_files(_in_files(s, d), "file"))
    return back.select("file", "ordinal", F.octet_length("word").cast("long").alias("length"), F.sha2("word", 256).alias("digest"))


@query("words", f"SELECT file, ordinal, length, sha256(word) AS digest FROM ({FILE_SQL})")
def simple_roundtrip(s: S, d: str) -> DataFrame:
    """Words written to simple files and read back."""
    back = files.simple_words(files.to_files(_in_files(s, d), "file", spell=lambda words: files.simple_encode([w for w, _ in words])))
    return back.select("file", "ordinal", F.octet_length("word").cast("long").alias("length"), F.sha2("word", 256).alias("digest"))


@query("words", f"SELECT file, count(*) AS n_words, count(*) FILTER (WHERE length = 0) AS n_empty FROM ({FILE_SQL}) GROUP BY file")
def segment_open(s: S, d: str) -> DataFrame:
    """What the headers of compressed segments say, once their dictionaries are checked."""
    return compressed.open_segments(_segments(s, d)).select("file", "n_words", "n_empty")


@query("words", f"SELECT file, ordinal, length, sha256(word) AS digest FROM ({FILE_SQL})")
def segment_decode(s: S, d: str) -> DataFrame:
    """Words compressed into segments, by dictionary and prefix codes, and decoded."""
    return compressed.segment_words(_segments(s, d)).select("file", "ordinal", "length", F.sha2("word", 256).alias("digest"))


@query("words", f"SELECT file, ordinal, length FROM ({FILE_SQL})")
def segment_skip(s: S, d: str) -> DataFrame:
    """Lengths of compressed words, without putting a word together."""
    return compressed.segment_words(_segments(s, d), decode=False).select("file", "ordinal", "length")

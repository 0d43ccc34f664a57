"""Operator 2, document fingerprints: closed syncmers over words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_ID, with_row_id

#: What stands between words, and the longest run that is a word: each character of a longer one is a token, so that in
#: scripts without blanks, too, an edit moves no anchor elsewhere.
BLANKS, MOST_CHARS = r"[\x20\x09-\x0D]+", 32

#: Tokens of a k-mer, and of its inner substrings.
KMER, INNER = 5, 2

#: Code points of the texts in a range of ids, about.
RANGE_CHARS = 256_000_000

ANCHORS = "array<struct<h:bigint,at:int>>"


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once for the row however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def _shift(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def anchors(tokens: Column) -> Column:
    """All anchors of a token array, in its order: the hash of a k-mer and where it starts.

    K-mers have KMER tokens, their inner substrings INNER. A k-mer is a closed syncmer if the smallest hash of its inner
    substrings is that of the first or the last. That depends on the k-mer alone, so an edit elsewhere never moves an
    anchor relative to its neighbours. Tokens without any syncmer have one anchor for the whole.
    """
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    least = lambda n: lambda a: F.zip_with(a, _shift(a, n), lambda x, y: F.least(x, y))

    def picked(hashes: Column, twos: Column) -> Column:
        fives = pair(pair(twos, _shift(twos, 2)), _shift(hashes, 4))
        lowest = _bind(_bind(twos, least(1)), least(2))
        zipped = F.slice(F.arrays_zip(fives.alias("k"), lowest.alias("m"), twos.alias("a"), _shift(twos, KMER - INNER).alias("z")), F.lit(1), F.greatest(F.size(twos) - KMER + 1, F.lit(0)))
        found = F.transform(zipped, lambda z, i: F.when((z["m"] == z["a"]) | (z["m"] == z["z"]), F.struct(z["k"].alias("h"), i.alias("at"))))
        return F.array_compact(found).cast(ANCHORS)

    def of(t: Column) -> Column:
        found = _bind(F.transform(t, lambda x: F.xxhash64(x)), lambda h: _bind(pair(h, _shift(h, 1)), lambda p: picked(h, p)))
        whole = F.array(F.struct(F.xxhash64(F.array_join(t, " ")).alias("h"), F.lit(0).alias("at"))).cast(ANCHORS)
        return F.when(F.size(t) == 0, F.array().cast(ANCHORS)).otherwise(_bind(found, lambda a: F.when(F.size(a) == 0, whole).otherwise(a)))

    return _bind(tokens, of)


def fingerprint(text: Column) -> Column:
    """The anchors of a text; see anchors(). Null is empty, and an empty text has none."""
    letters = lambda x: F.array_remove(F.split(x, "", -1), "")
    long = lambda x: F.length(x) > MOST_CHARS
    tokens = lambda w: F.flatten(F.transform(w, lambda x: F.when(long(x), letters(x)).otherwise(F.array(x))))
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")
    return anchors(_bind(words, lambda w: F.when(F.exists(w, long), tokens(w)).otherwise(w)))


def as_string(anchors_: Column) -> Column:
    """The fingerprint as text: for each anchor 16 hexadecimal digits of hash and its place."""
    return F.array_join(F.transform(anchors_, lambda x: F.concat(F.lpad(F.lower(F.hex(x["h"])), 16, "0"), F.lit("@"), x["at"].cast("string"))), " ")


def hashes(anchors_: Column) -> Column:
    return F.transform(anchors_, lambda x: x["h"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of two fingerprints' anchor hashes (0 to 1), over all of them; 1 if both are empty."""
    both, either = F.size(F.array_intersect(hashes(a), hashes(b))), F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1))).cast("double")


def aligned(a: Column, b: Column) -> Column:
    """Of the anchor hashes that both fingerprints have, the share that both have at the same place; 0 without any."""
    placed = lambda v: F.transform(v, lambda x: F.xxhash64(x["h"], x["at"]))
    shared = F.size(F.array_intersect(hashes(a), hashes(b)))
    return F.least(F.size(F.array_intersect(placed(a), placed(b))) / F.greatest(shared, F.lit(1)), F.lit(1.0))


def with_next(rows: DataFrame, id_col: str, text_col: str, derive) -> DataFrame:
    """Each row with `_own` and `_next`: struct(text, derived) of the row itself and of the one after it by descending id
    (null last), then by a hash of the text and by row; the first comes after the last. rows have row ids, no null text.

    Rows are dealt by ranges of that order, as many as the text needs (RANGE_CHARS) and a few for each task. A narrow
    sort of the keys alone gives each range's bounds and first row: all that the driver gets. Row ids make every key
    distinct, so that null ids, one id or one text of very many rows are split like all others. Each text is then moved
    once; within a range the next row comes from a window, and the last row of a range takes the first of the next.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(ROW_ID).alias("r")))
    chars = rows.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / RANGE_CHARS))
    sorted_keys = keyed.select("_key").repartitionByRange(ranges, "_key").groupBy(F.spark_partition_id().alias("_p")).agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"))
    edges = sorted_keys.orderBy("lo").select("lo", "hi").collect()
    kind = keyed.schema["_key"].dataType
    literal = lambda k: F.struct(F.lit(k["i"]).cast(kind["i"].dataType).alias("i"), F.lit(k["h"]).cast("long").alias("h"), F.lit(k["r"]).cast("long").alias("r"))
    bounds = F.array(*[literal(e["lo"]) for e in edges[1:]]) if len(edges) > 1 else F.array().cast(f"array<{kind.simpleString()}>")
    dealt = keyed.withColumn("_range", F.size(F.filter(bounds, lambda c: c <= F.col("_key")))).repartition("_range")
    value = F.struct(F.col(text_col).alias("text"), derive(F.col(text_col)).alias("derived"))
    window = Window.partitionBy("_range").orderBy(F.col("_key").desc())
    led = dealt.withColumn("_own", value).withColumn("_led", F.lead("_own").over(window))
    # The first row of the range below is what follows a range's last; the topmost range follows the lowest.
    heads = [F.struct(F.lit(edges[k - 1]["hi"]["r"]).cast("long").alias("_head"), F.lit(k).alias("_of")) for k in range(len(edges))]
    heads = spark.range(1).select(F.inline(F.array(*heads))) if heads else spark.range(0).select(F.col("id").alias("_head"), F.lit(0).alias("_of"))
    firsts = rows.select(ROW_ID, text_col).join(F.broadcast(heads), F.col(ROW_ID) == F.col("_head")).select("_of", value.alias("_first"))
    met = led.join(firsts, (F.col("_range") == F.col("_of")) & F.col("_led").isNull(), "left")
    return met.withColumn("_next", F.coalesce("_led", "_first")).drop("_key", "_range", "_led", "_of", "_first")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited (the text whose last third is the next document's beginning), the fingerprints of both
    and of the next document: see fingerprint().

    One rule holds at all lengths: a text's tokens are its words, or the characters of runs that are too long for words;
    all its anchors are kept; hashes have 64 bits and places are not bounded but by an array's size. Likeness is exact
    on them.

    Defined cases: null text is an empty text, and two empty texts are alike; a text of fewer than KMER tokens has one
    anchor; a very long text is fingerprinted whole, in time in proportion to it, in one row of memory; null ids come last;
    rows with one id are ordered by a hash of their text, repeated rows by their place; a single document is its own next;
    ids are of any type that can be ordered; an empty table gives an empty one; columns besides id and text are left out.
    """
    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    paired = with_next(rows, "doc_id", "_text", fingerprint)
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - third), F.substring(F.col("_next.text"), F.lit(1), third))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("_own.derived").alias("print"), F.col("_next.derived").alias("next_print"))
    return paired.withColumn("edited_print", fingerprint(F.col("edited")))

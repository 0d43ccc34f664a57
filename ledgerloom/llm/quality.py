"""Operator 9, quality classifier: document evidence combined with what is known of its host and path."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import ROW_ID, drop, others, slices, split_words, with_row_id, written

#: The sample that the classifier is fitted on: so many labelled documents at most, those with the smallest hashes of
#: their ids, as far as they have so many features together (distinct within each document; four bytes each).
MOST_LABELLED, MOST_ENTRIES = 12_000, 20_000_000

#: Hashed features, and those of a word: the word, its first characters, its shape.
FEATURES = 1 << 18
PREFIXES = (4, 5, 6)

#: Documents are kept up to this probability of being bad.
MOST_BAD = 0.3

#: A feature is used if it stands in so many labelled documents at least, and if the log odds of bad with it differ
#: from those without it by so many standard errors.
LEAST_SEEN, LEAST_ERRORS = 5, 4.0

#: Passes of the fit, its step and the weight of its penalty.
PASSES, STEP, PENALTY = 150, 0.3, 1e-4


#: Bytes of text that are looked at at a time, and words whose features a worker keeps, at most.
RUN, MOST_WORDS = 1 << 20, 200_000


def feature_id(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) % FEATURES


def word_features(word: bytes) -> tuple[int, ...]:
    text = word.decode("utf-8", "replace")
    low = text.lower().strip(".,;:!?\"'()[]{}")
    tail = "".join(c for c in text if not c.isalnum())[-4:]
    case = "U" if len(text) > 1 and text.isupper() else "L"
    names = ["w" + low, *(f"p{n}{low[:n]}" for n in PREFIXES if len(low) > n), f"s{case}{tail}"]
    return tuple(map(feature_id, names))


def present_features(text: pa.Array, of_word) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), distinct and sorted: what of_word gives for each word, the share of words that repeat the
    one before in steps of a twentieth, and the length in powers of two."""
    values, offsets = split_words(text)
    coded = values.dictionary_encode()
    each = [of_word(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    n, at = np.diff(offsets), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    # Words without features go first; most have none once the features are chosen.
    some = np.array([bool(e) for e in each], bool)[at] if len(at) else np.zeros(0, bool)
    pair = np.unique(row[some] * max(1, len(each)) + at[some])
    of, word = pair // max(1, len(each)), pair % max(1, len(each))
    times = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter((f for e in each for f in e), np.int64)
    begin = np.concatenate(([0], np.cumsum(times)))[:-1]
    count = times[word] if len(word) else word
    feature = flat[np.repeat(begin[word] - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(count.sum())] if len(word) else flat[:0]
    again = np.bincount(row[1:][(at[1:] == at[:-1]) & (row[1:] == row[:-1])], minlength=len(n)) / np.maximum(1, n) if len(at) else np.zeros(len(n))
    whole = [(i, feature_id(f"again{k}")) for i, a in enumerate(again) for k in range(1, int(20 * a) + 1)]
    whole += [(i, feature_id(f"length{int(k).bit_length()}")) for i, k in enumerate(n)]
    codes = np.unique(np.concatenate([np.repeat(of, count) * FEATURES + feature, np.array([i * FEATURES + f for i, f in whole], np.int64)]))
    return codes // FEATURES, codes % FEATURES


def fit(rows: np.ndarray, features: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logistic regression over the present features that tell the classes apart, by AdaGrad on all rows.

    One weight for each feature, 0 for those not used; the last is the constant.
    """
    n, bad = len(target), target.sum()
    weights = np.zeros(FEATURES + 1)
    # Without a feature that tells the classes apart nothing speaks against a document, whatever the labels' shares.
    weights[-1] = -5.0
    with_bad, with_good = np.bincount(features, target[rows], FEATURES), np.bincount(features, 1 - target[rows], FEATURES)
    apart = np.log((with_bad + 0.5) / (bad + 1)) - np.log((with_good + 0.5) / (n - bad + 1))
    used = (with_bad + with_good >= LEAST_SEEN) & (np.abs(apart) >= LEAST_ERRORS * np.sqrt(1 / (with_bad + 0.5) + 1 / (with_good + 0.5)))
    if not used.any() or bad in (0, n):
        return weights
    names = np.flatnonzero(used)
    mine = used[features]
    row, at = rows[mine], np.searchsorted(names, features[mine])
    w, c, seen, seen_c = np.zeros(len(names)), 0.0, np.full(len(names), 1e-3), 1e-3
    for _ in range(PASSES):
        z = np.bincount(row, w[at], n) + c
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g, g_c = np.bincount(at, error[row], len(names)) / n + PENALTY * w, error.mean()
        seen, seen_c = seen + g * g, seen_c + g_c * g_c
        w, c = w - STEP * g / np.sqrt(seen), c - STEP * g_c / math.sqrt(seen_c)
    weights[names], weights[-1] = w, c
    return weights


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Weights for "bad": toxic, or of quality 0. The sample is bounded in documents and in features, so the driver gets
    80 MB of them at most; of several texts with one id it takes one, the least of their features."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("_bad")
    known = labels.where(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col(id_col).alias("_id")).agg(bad)
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELLED)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    kind = joined.schema["_id"].dataType

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", RUN):
                row, feature = present_features(part.column("_text"), word_features)
                starts = np.searchsorted(row, np.arange(part.num_rows + 1))
                ids = [feature[a:b].astype("<i4").tobytes() for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_bad"), pa.array(ids, pa.binary())], ["_id", "_bad", "_features"])

    each = joined.mapInArrow(featured, StructType([StructField("_id", kind), StructField("_bad", IntegerType()), StructField("_features", BinaryType())]))
    each = written(each.groupBy("_id").agg(F.max("_bad").alias("_bad"), F.min("_features").alias("_features")), "labelled")
    # At most MOST_LABELLED rows: their running total decides how many come.
    sizes = each.select(F.xxhash64("_id").alias("_h"), "_id", F.octet_length("_features").alias("_n")).orderBy("_h", "_id").collect()
    total = np.cumsum([r["_n"] for r in sizes]) if sizes else np.zeros(0)
    last = int(np.searchsorted(total, 4 * MOST_ENTRIES, "right"))
    last_hash = sizes[last - 1]["_h"] if last else 0
    got = each.where(F.xxhash64("_id") <= last_hash).toLocalIterator() if last else ()
    got = sorted((str(r["_id"]), r["_bad"], bytes(r["_features"])) for r in got)
    drop(each)
    features = [np.frombuffer(f, "<i4") for _, _, f in got]
    rows = np.repeat(np.arange(len(got)), [len(f) for f in features]) if got else np.zeros(0, np.int64)
    return fit(rows, np.concatenate(features) if got else np.zeros(0, np.int32), np.array([float(b) for _, b, _ in got]))


def score(rows: DataFrame, weights: np.ndarray, text_col: str) -> DataFrame:
    """rows without the text, with `evidence`: the classifier's log odds of bad."""
    names = [c for c in rows.columns if c != text_col]
    schema = rows.select(*names).schema.add("evidence", "double")
    packed = weights.astype(np.float32).tobytes()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(packed, np.float32)
        known: dict[bytes, tuple[int, ...]] = {}

        def used(word: bytes) -> tuple[int, ...]:
            if word not in known:
                known[word] = tuple(f for f in word_features(word) if w[f])
            return known[word]

        for batch in batches:
            for part in slices(batch, text_col, RUN):
                if len(known) > MOST_WORDS:
                    known.clear()
                row, feature = present_features(part.column(text_col), used)
                z = np.bincount(row, w[feature], part.num_rows) + w[-1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(z, pa.float64())], [*names, "evidence"])

    return rows.select(*names, text_col).mapInArrow(scored, schema)


def shrinkage(total: float, n: int, k: int, squares: float, sizes: float, mean: float) -> float:
    """How many documents the prior counts for: a beta prior's strength by moments, from how much more k groups differ in
    their shares than chance explains. squares: sum of bad * bad / n over the groups; sizes: sum of n * n."""
    if k < 2 or n <= k:
        return 1e6
    between = (squares - total * total / n) / (k - 1)
    spread = (between - mean * (1 - mean)) / max((n - sizes / n) / (k - 1), 1e-9)
    return min(max(mean * (1 - mean) / spread - 1, 10.0), 1e6) if spread > 0 else 1e6


def with_site(scored: DataFrame) -> DataFrame:
    """scored (_host, _path, _p) with `site`, the posterior log odds of bad at the row's host and path, and `_world`, those
    of all rows. A row's own probability is left out of both, so that site is evidence besides its text.

    Each document counts by its probability. A host's share is shrunk towards the global one and a path's towards its
    host's; how strongly is itself estimated, for hosts from how they differ, for paths from how they do. All of it is
    sums by path, then by host, then over all, that each task makes before any shuffle. The sums are a written table, so
    that the join back splits a host of very many rows.
    """
    paths = written(scored.groupBy("_host", "_path").agg(F.sum("_p").alias("_bad"), F.count("*").alias("_n")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_bad").alias("_h_bad"), F.sum("_n").alias("_h_n"))
    sums = lambda df, bad, n: df.agg(F.sum(bad).alias("b"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(bad) * F.col(bad) / F.col(n)).alias("s"), F.sum(F.col(n) * F.col(n)).alias("n2")).first()
    by_host, by_path = sums(hosts, "_h_bad", "_h_n"), sums(paths, "_bad", "_n")
    total, n = by_host["b"] or 0.0, by_host["n"] or 0
    mean = min(max(total / max(n, 1), 1e-6), 1 - 1e-6)
    of_hosts, of_paths = (shrinkage(total, n, r["k"], r["s"] or 0.0, r["n2"] or 0, mean) for r in (by_host, by_path))
    sites = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).select(F.col("_host").alias("_s_host"), F.col("_path").alias("_s_path"), "_bad", "_n", "_h_bad", "_h_n")
    sites = written(sites, "sites")
    joined = scored.join(sites, F.col("_host").eqNullSafe(F.col("_s_host")) & F.col("_path").eqNullSafe(F.col("_s_path")))
    world = (F.lit(total) - F.col("_p") + F.lit(mean)) / (F.lit(float(n)))
    host = (F.col("_h_bad") - F.col("_p") + F.lit(of_hosts) * world) / (F.col("_h_n") - 1 + F.lit(of_hosts))
    path = (F.col("_bad") - F.col("_p") + F.lit(of_paths) * host) / (F.col("_n") - 1 + F.lit(of_paths))
    odds = lambda c: F.log(F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))) - F.log(1 - F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6)))
    return joined.withColumn("site", odds(path)).withColumn("_world", odds(world)).drop("_s_host", "_s_path", "_bad", "_n", "_h_bad", "_h_n")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """All rows of docs without the text, with evidence, site (posterior log odds of host and path), p_bad and keep.

    p_bad joins the document's own log odds with what the other documents of its path are above or below the global log
    odds. Rows up to MOST_BAD are kept. The classifier is fitted on a bounded sample (MOST_LABELLED, MOST_ENTRIES);
    everything else is over all rows.

    Defined cases: null and empty texts have the constant alone as evidence; a very long text is scored whole, by its
    distinct features; null hosts are one host, null paths one path of each host; without labels, or with none that any
    feature tells apart, all documents are kept; ids are of any type; repeated rows are each judged;
    labels of unknown or null ids count for nothing, and of several labels of an id the worst holds; an empty table gives
    an empty one; columns named as the results are left out.
    """
    docs = docs.select(*others(docs, "evidence", "site", "p_bad", "keep"))
    return _classified(with_row_id(docs), docs, labels, id_col, text_col, host_col, path_col).drop(ROW_ID)


def _classified(rows: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    weights = train(docs, labels, id_col, text_col)
    rows = rows.withColumn("_host", F.col(host_col)).withColumn("_path", F.col(path_col))
    scored = score(rows, weights, text_col).withColumn("_p", 1 / (1 + F.exp(-F.col("evidence"))))
    joined = with_site(written(scored, "scores"))
    odds = F.col("evidence") + F.col("site") - F.col("_world")
    return joined.withColumn("p_bad", 1 / (1 + F.exp(-odds))).withColumn("keep", F.col("p_bad") <= MOST_BAD).drop("_host", "_path", "_p", "_world")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of docs that classify() keeps, unchanged, whatever their columns are named. Texts move once, to meet the
    decisions. Its cases are those of classify()."""
    rows = with_row_id(docs)
    own = [c for c in dict.fromkeys((id_col, text_col, host_col, path_col)) if c is not None]
    judged = _classified(rows.select(ROW_ID, *own), docs, labels, id_col, text_col, host_col, path_col)
    gone = written(judged.where(~F.col("keep")).select(F.col(ROW_ID).alias("_gone")), "rejected")
    return rows.join(gone, F.col(ROW_ID) == F.col("_gone"), "left_anti").select(*docs.columns)

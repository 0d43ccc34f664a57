"""Operator 5, substring dedup: repeated word windows, found by super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, drop, hash_words, mix, slices, split_words, with_row_id, written

WINDOW = 35

#: Words of an m-mer; a window's minimiser is its m-mer of the smallest hash.
MMER = 8

#: Windows that travel in one string at most, and that one bucket of a minimiser holds; beyond, its windows are counted
#: one by one.
MOST_IN_STRING, MOST_IN_BUCKET = 512, 20_000

#: The base of the rolling hash, odd, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _ahead(a: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate((a[n:], np.zeros(min(n, len(a)), a.dtype)))


def super_kmers(words: np.ndarray, offsets: np.ndarray, window: int = WINDOW, mmer: int = MMER):
    """Runs of consecutive windows with one minimiser: (text, start, windows, minimiser, digest, repeats).

    words are hashes of all texts' words, offsets where texts begin. The digest is a hash of all words of the run;
    repeats tells whether a window occurs twice within the run.
    """
    n = len(words)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(n, dtype=np.int64)
    valid = starts + window <= offsets[1:][text] if n else np.zeros(0, bool)
    if not valid.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    grams, size = words, 1
    while size < mmer:  # hashes of 2, 4, 8 words
        grams = mix(grams * np.uint64(0xD6E8FEB86659FD93) + _ahead(grams, size) + np.uint64(size))
        size *= 2
    least, size, span = grams, 1, window - mmer + 1
    while size < span:  # minima of 2, 4, 8, ... and the last overlapping
        step = min(size, span - size)
        least = np.minimum(least, _ahead(least, step))
        size += step
    begins = valid & np.concatenate(([True], ~valid[:-1] | (least[1:] != least[:-1])))
    run = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    inside = starts - first[np.maximum(run, 0)]
    begins |= valid & (inside % MOST_IN_STRING == 0)
    run, first = np.cumsum(begins) - 1, np.flatnonzero(begins)
    count = np.bincount(run[valid], minlength=len(first))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(BASE, n), dtype=np.uint64)))
    back = _powers(INVERSE, n)
    digest = mix((sums[first + count + window - 1] - sums[first]) * back[first] + count.astype(np.uint64))
    at = np.flatnonzero(valid)
    each = mix((sums[at + window] - sums[at]) * back[at] + mix(run[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(each, kind="stable")
    again = order[1:][each[order][1:] == each[order][:-1]]
    repeats = np.zeros(len(first), bool)
    repeats[run[at[again]]] = True
    return text[first], first - offsets[text[first]], count, least[first], digest, repeats


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _window_key(words: list[bytes]) -> bytes:
    joined = b" ".join(words)
    return joined if len(joined) < 4096 else b" " + hashlib.blake2b(joined, digest_size=32).digest()


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[dict]]]:
    for batch in batches:
        for row, text, cuts in zip(batch.column(ROW_ID).to_pylist(), batch.column("_text"), batch.column("cuts").to_pylist(), strict=True):
            yield row, (text.as_py() or "").encode().split(), cuts


def _in_batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 5_000) -> Iterator[pa.RecordBatch]:
    got: list[tuple] = []
    for r in rows:
        got.append(r)
        if len(got) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), types, strict=True)], names)
            got = []
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), types, strict=True)], names)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cut of a row: the words of its windows as one string."""
    rows = ((c["mini"], row, c["start"], c["single"], b" ".join(words[c["start"] : c["start"] + c["n"] + WINDOW - 1])) for row, words, cuts in _cuts(batches) for c in cuts)
    return _in_batches(rows, ["mini", "row", "start", "single", "packed"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each window of a row's cuts: where it starts and a digest of 128 bits."""

    def rows() -> Iterator[tuple]:
        for row, words, cuts in _cuts(batches):
            for c in cuts:
                for i in range(c["start"], c["start"] + c["n"]):
                    digest = hashlib.blake2b(b" ".join(words[i : i + WINDOW]), digest_size=16).digest()
                    yield row, i, c["single"], int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True)

    return _in_batches(rows(), [ROW_ID, "_s", "single", "w1", "w2"], [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come one after another. A bucket's windows are sorted; those that stand next to an equal one are found."""

    def ranges(bucket) -> list[tuple[int, int, int]]:
        windows = sorted((_window_key(words[i : i + WINDOW]), k, i) for k, (_, _, _, words) in enumerate(bucket) for i in range(len(words) - WINDOW + 1))
        same = [a[0] == b[0] for a, b in zip(windows, windows[1:], strict=False)]
        found = sorted((k, i) for (_, k, i), before, after in zip(windows, [False, *same], [*same, False], strict=True) if (before or after) and bucket[k][2])
        return [(bucket[k][0], bucket[k][1] + i, bucket[k][1] + i + WINDOW) for k, i in found]

    bucket, own = [], None
    for batch in batches:
        got = []
        for mini, row, start, single, packed in zip(*(batch.column(c).to_pylist() for c in ("mini", "row", "start", "single", "packed")), strict=True):
            if mini != own and bucket:
                got += ranges(bucket)
                bucket = []
            own = mini
            bucket.append((row, start, single, packed.split(b" ")))
        yield _range_batch(got)
    yield _range_batch(ranges(bucket))


def _range_batch(got) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(3)], [ROW_ID, "_s", "_e"])


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """(row id, _s, _e): ranges of words covered by windows that start more than once. rows: row id and _text, no more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                values, offsets = split_words(part.column("_text"))
                text, start, n, mini, digest, repeats = super_kmers(hash_words(values), offsets)
                yield pa.RecordBatch.from_arrays([part.column(ROW_ID).take(pa.array(text)), pa.array(start), pa.array(n), _signed(mini), _signed(digest), pa.array(repeats)], [ROW_ID, "start", "n", "mini", "digest", "repeats"])

    runs = written(rows.mapInArrow(cut, f"{ROW_ID} long, start long, n long, mini long, digest long, repeats boolean"), "runs")
    held = runs.groupBy("mini").agg(F.count("*").alias("times"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max("repeats").alias("any"))
    held = held.where((F.col("times") > 1) | F.col("any")).select("mini", ((F.col("times") > 1) & (F.col("lo") == F.col("hi"))).alias("alike"))
    # Both sides of the joins here are written tables: adaptive execution splits a hot minimiser or digest.
    held = written(held, "minimisers")
    again = written(runs.join(held, "mini").drop("repeats"), "runs")
    drop(runs, held)
    end = F.col("start") + F.col("n") + (WINDOW - 1)
    whole = again.where("alike").select(ROW_ID, F.col("start").alias("_s"), end.alias("_e"))

    mixed = again.where(~F.col("alike"))
    strings = written(mixed.groupBy("mini", "digest").agg(F.count("*").alias("times"), F.min(F.struct(ROW_ID, "start", "n")).alias("first")), "strings")
    copied = mixed.join(strings.where("times > 1").select("mini", "digest").hint("merge"), ["mini", "digest"]).select(ROW_ID, F.col("start").alias("_s"), end.alias("_e"))
    large = strings.groupBy("mini").agg(F.sum("first.n").alias("windows")).where(F.col("windows") > MOST_IN_BUCKET)
    large = written(large.select(F.col("mini").alias("_mini")), "large-buckets")
    cuts = strings.join(large, F.col("mini") == F.col("_mini"), "left").select(
        F.col(f"first.{ROW_ID}").alias("_row"), F.col("_mini").isNotNull().alias("large"), F.struct("mini", F.col("first.start").alias("start"), F.col("first.n").alias("n"), (F.col("times") == 1).alias("single")).alias("cut")
    )
    cuts = written(cuts.groupBy("large", "_row").agg(F.collect_list("cut").alias("cuts")), "cuts")
    in_rows = lambda large_ones: rows.join(cuts.where("large" if large_ones else "NOT large").select("_row", "cuts"), F.col(ROW_ID) == F.col("_row"))
    packed = in_rows(False).mapInArrow(_packed, "mini long, row long, start long, single boolean, packed binary")
    counted = packed.repartition("mini").sortWithinPartitions("mini").mapInArrow(_counted, f"{ROW_ID} long, _s long, _e long")
    # Of a large bucket each window is a row: counted by digest in every task, then by an aggregate that meets them again.
    apart = written(in_rows(True).mapInArrow(_apart, f"{ROW_ID} long, _s long, single boolean, w1 long, w2 long"), "windows")
    twice = written(apart.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2"), "repeated-windows")
    repeated = apart.where("single").join(twice.hint("merge"), ["w1", "w2"]).select(ROW_ID, "_s", (F.col("_s") + WINDOW).alias("_e"))
    return whole.unionByName(copied).unionByName(counted).unionByName(repeated)


def drop_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept: the words that no repeated window covers, joined by one blank.

    A window is WINDOW consecutive words of one row; it is repeated if its words also start anywhere else, in the same
    row or another. Consecutive windows with one minimiser make a run (super-k-mer). Runs first travel as position,
    minimiser and digest alone:

    - a run whose minimiser stands nowhere else can't hold a repeated window;
    - where all runs of a minimiser are alike, every window is repeated;
    - of the rest, runs with the same digest are repeated in whole, and one of each kind travels as a packed string of
      its words to its minimiser's bucket, where its windows are sorted and equal ones found, word for word.

    Minimisers are counted in each task before the shuffle. The windows of a bucket of more than MOST_IN_BUCKET are rows of
    their own, by a digest of 128 bits that each task counts before the shuffle: so no task holds more, and a window that
    stands in a third of the documents is split. Runs longer than MOST_IN_STRING are cut. Texts are dealt by row once.

    Defined cases: null and empty texts have no words; texts of fewer than WINDOW words lose nothing; repeated rows are
    repeats of each other; ids play no part, so null and repeated ones pass through; a very long text is a run of its own
    in memory and its windows are dealt like all others; an empty table gives an empty one; other columns pass through,
    but for n_words, n_removed and kept.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    rows = with_row_id(docs)
    texts = rows.select(ROW_ID, F.col(text_col).alias("_text"))
    found = repeated_ranges(texts).groupBy(F.col(ROW_ID).alias("_row")).agg(F.collect_list("_s").alias("_s"), F.collect_list("_e").alias("_e"))
    joined = rows.select(ROW_ID, *names).join(found, F.col(ROW_ID) == F.col("_row"), "left").drop(ROW_ID, "_row")
    schema = docs.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                total, removed, kept = [], [], []
                for text, s, e in zip(part.column(text_col), part.column("_s"), part.column("_e"), strict=True):
                    words = (text.as_py() or "").encode().split()
                    total.append(len(words))
                    gone = 0
                    if s.is_valid:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, s.values.to_numpy(), 1)
                        np.add.at(change, e.values.to_numpy(), -1)
                        stay = np.cumsum(change[:-1]) == 0
                        gone = int(len(words) - stay.sum())
                        words = [words[i] for i in np.flatnonzero(stay)]
                    removed.append(gone)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(remove, schema)

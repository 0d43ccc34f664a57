"""Statistics for dictionary compression: repeats, scores, code lengths."""

from __future__ import annotations

import bisect
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A pattern of the dictionary has so many bytes at least, and at most.
SHORTEST, LONGEST = 5, 128


def aggregate(patterns: DataFrame, word: str = "word", score: str = "score") -> DataFrame:
    return patterns.groupBy(word).agg(F.sum(score).alias("score"))


def pieces(words: DataFrame) -> DataFrame:
    """(word, score): every piece of SHORTEST to LONGEST bytes of the words, with its bytes times the scores of the words
    that hold it, once for each place."""
    def ends(at: Column) -> Column:
        most = F.least(F.length("word") - at + 1, F.lit(LONGEST))
        return F.transform(F.sequence(F.lit(1), most), lambda n: F.substring(F.col("word"), at, n))

    each = words.where(F.length("word") > 0).select("score", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), ends))).alias("word"))
    each = each.where(F.octet_length("word").between(SHORTEST, LONGEST))
    return each.groupBy("word").agg((F.sum("score") * F.octet_length(F.col("word"))).alias("score"))


def top(patterns: DataFrame, n: int) -> DataFrame:
    """The n patterns of the highest scores; of equal scores the larger word first."""
    return patterns.orderBy(F.col("score").desc(), F.col("word").desc()).limit(n)


def ngrams(words: DataFrame, text: str, size: int) -> DataFrame:
    """n-grams of tokens that stand more than once, with their count and the rows that hold them."""
    def grams(tokens: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.array_join(F.slice(tokens, i, size), " "))

    # Sorted within its row, a gram's first place there counts the row; so grams are shuffled once, summed up by each task.
    def listed(t: Column) -> Column:
        return F.when(F.size(t) >= size, F.transform(F.array(F.sort_array(grams(t))), lambda g: F.transform(g, lambda x, i: F.struct(x.alias("gram"), ((i == 0) | (F.get(g, i - 1) != x)).cast("int").alias("new"))))[0])

    # Split once, as a lambda's argument: inside it the text would be split again for every n-gram.
    tokens = F.split(F.col(text), " ")
    each = words.select(F.explode(F.transform(F.array(tokens), listed)[0]).alias("g")).select("g.gram", "g.new")
    return each.groupBy("gram").agg(F.count("*").alias("repeats"), F.sum("new").alias("holders")).where("repeats > 1")


#: Characters of all patterns together that matches() sends to every task, at most.
MOST_PATTERN_CHARS = 4_000_000


def matches(words: DataFrame, patterns: DataFrame, key: str = "ordinal", text: str = "text", pattern: str = "pattern") -> DataFrame:
    """(key, at, until): where dictionary patterns stand in texts: of each start the longest, without those within an
    earlier one.

    All patterns are searched for at once, by an automaton that each task builds; texts never move. The dictionary is a
    bounded one: beyond MOST_PATTERN_CHARS it is an error.
    """
    wanted = patterns.select(F.col(pattern).alias("p")).where(F.length("p") > 0).distinct()
    chars = wanted.agg(F.sum(F.length("p"))).first()[0] or 0
    if chars > MOST_PATTERN_CHARS:
        raise ValueError(f"{chars} characters of patterns, more than {MOST_PATTERN_CHARS}")
    known = sorted(r["p"] for r in wanted.collect())
    kind = to_arrow_type(words.schema[key].dataType)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in known:
            machine.add_word(p, len(p))
        if known:
            machine.make_automaton()
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                longest: dict[int, int] = {}
                for last, n in machine.iter(t.as_py() or "") if known else ():
                    longest[last + 1 - n] = max(last + 1, longest.get(last + 1 - n, 0))
                reach = 0
                for at in sorted(longest):
                    if longest[at] > reach:
                        reach = longest[at]
                        keys.append(k)
                        starts.append(at)
                        ends.append(reach)
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [key, "at", "until"])

    return words.select(key, text).mapInArrow(found, f"{key} {words.schema[key].dataType.simpleString()}, at long, until long")


def code_lengths(uses: dict) -> dict:
    """Depth of each symbol in a Huffman tree: the least used two are joined first, a symbol before a joined node of
    equal uses. A single symbol has depth 0."""
    heap = [(n, 0, i, [s]) for i, (s, n) in enumerate(sorted(uses.items(), key=lambda x: (x[1], x[0])))]
    heapq.heapify(heap)
    depth = dict.fromkeys(uses, 0)
    made = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[3] + b[3]:
            depth[s] += 1
        made += 1
        heapq.heappush(heap, (a[0] + b[0], 1, made, a[3] + b[3]))
    return depth


def huffman_depths(counts: DataFrame, symbol: str, count: str, group: str) -> DataFrame:
    """(group, symbol, depth): a tree per group, of at most one dictionary's symbols."""

    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = code_lengths(dict(zip(pdf[symbol], pdf[count], strict=True)))
        return pd.DataFrame({group: pdf[group], symbol: pdf[symbol], "depth": [depth[s] for s in pdf[symbol]]})

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    return counts.groupBy(group).applyInPandas(trees, f"{group} {kinds[group]}, {symbol} {kinds[symbol]}, depth int")


def cover(text: bytes, dictionary: dict[bytes, int]) -> list[tuple[int, bytes]]:
    """Places and patterns that cover most of a word, each pattern costing four bytes; from the right, best first."""
    n, lengths = len(text), sorted({len(p) for p in dictionary})
    best: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    choice: list[int] = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i], choice[i] = best[i + 1], 0
        for k in lengths:
            if i + k <= n and (score := dictionary.get(text[i : i + k])) is not None:
                gain = (best[i + k][0] + k - 4, best[i + k][1] + score)
                if gain > best[i]:
                    best[i], choice[i] = gain, k
    found, i = [], 0
    while i < n:
        if choice[i]:
            found.append((i, text[i : i + choice[i]]))
            i += choice[i]
        else:
            i += 1
    return found


def cover_words(words: DataFrame, key: str, word: str, dictionary: dict[bytes, int]) -> DataFrame:
    """(key, at, pattern): the cover of each word. The dictionary is of bounded size and sent to every task."""
    kind = words.schema[key].dataType.simpleString()

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, at, p) for k, w in zip(pdf[key], pdf[word], strict=True) for at, p in cover(bytes(w), dictionary)]
            yield pd.DataFrame(rows, columns=[key, "at", "pattern"])

    return words.select(key, word).mapInPandas(covered, f"{key} {kind}, at int, pattern binary")


def places(text: bytes, dictionary: dict[bytes, int], heads: dict[bytes, list[int]], known: np.ndarray) -> list[tuple[int, int]]:
    """Where the patterns of cover(text, dictionary) start and how long they are, for patterns of SHORTEST bytes or more: only places that
    begin like a pattern are looked at. heads and known are those of heads_of(dictionary)."""
    if len(text) < SHORTEST:
        return []
    starts = np.flatnonzero(known[_codes(np.frombuffer(text, np.uint8))]).tolist()
    best: list[tuple[int, int]] = [(0, 0)] * (len(starts) + 1)
    choice: list[int] = [0] * len(starts)
    for j in range(len(starts) - 1, -1, -1):
        i, best[j] = starts[j], best[j + 1]
        for k in heads.get(text[i : i + SHORTEST], ()):
            if (score := dictionary.get(text[i : i + k])) is not None and i + k <= len(text):
                after = best[bisect.bisect_left(starts, i + k, j + 1)]
                gain = (after[0] + k - 4, after[1] + score)
                if gain > best[j]:
                    best[j], choice[j] = gain, k
    found, reach = [], 0
    for i, k in zip(starts, choice, strict=True):
        if k and i >= reach:
            found.append((i, k))
            reach = i + k
    return found


def _codes(chars: np.ndarray) -> np.ndarray:
    """16 bits for each run of SHORTEST bytes."""
    n = len(chars) - SHORTEST + 1
    code = np.zeros(n, np.uint32)
    for k in range(SHORTEST):
        code = code * np.uint32(0x9E3779B1) + chars[k : k + n]
    return code * np.uint32(0x85EBCA6B) >> np.uint32(16)


def heads_of(dictionary: dict[bytes, int]) -> tuple[dict[bytes, list[int]], np.ndarray]:
    """The lengths of the patterns that begin with the same bytes; a table of the codes of such beginnings."""
    heads: dict[bytes, list[int]] = {}
    known = np.zeros(1 << 16, bool)
    for p in dictionary:
        lengths = heads.setdefault(p[:SHORTEST], [])
        if len(p) not in lengths:
            lengths.append(len(p))
            lengths.sort()
        known[_codes(np.frombuffer(p[:SHORTEST], np.uint8))] = True
    return heads, known


def position_uses(words: DataFrame, word: str, dictionary: dict[bytes, int]) -> DataFrame:
    """(pos, uses): of each word its bytes plus one, the end mark 0, and for every pattern of its cover the start
    relative to the one before, plus one. Patterns have SHORTEST bytes at least; a task counts before the shuffle."""
    heads, known = heads_of(dictionary)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uses: Counter[int] = Counter()
        for pdf in batches:
            for w in pdf[word]:
                w, last = bytes(w), 0
                uses[len(w) + 1] += 1
                uses[0] += 1
                for at, _ in places(w, dictionary, heads, known):
                    uses[at - last + 1] += 1
                    last = at
        yield pd.DataFrame({"pos": list(uses), "uses": list(uses.values())}, dtype="int64")

    return words.select(word).mapInPandas(counted, "pos long, uses long").groupBy("pos").agg(F.sum("uses").alias("uses"))


def superstrings(words: DataFrame, limit: int, factor: int) -> DataFrame:
    """(ordinal, superstring, sampled) of words (ordinal, length): a word of n bytes takes 2n + 2, and a superstring ends
    before the word that would bring it beyond the limit; every factor-th is sampled.

    Where one ends depends on where the one before did, so this is a fold by definition: two numbers for each word go
    through one task in order, a batch at a time, and no text does.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        for batch in batches:
            cost = 2 * batch.column("length").to_numpy() + 2
            ends = np.cumsum(cost)
            own, at = np.empty(len(cost), np.int64), 0
            while at < len(cost):
                before = ends[at - 1] if at else 0
                stop = max(at, int(np.searchsorted(ends, limit - size + before, "right")))
                own[at:stop] = number
                size += (ends[stop - 1] if stop else 0) - before if stop > at else 0
                if stop < len(cost):  # this word begins a superstring, however large it is itself
                    number, size = number + 1, int(cost[stop])
                    own[stop] = number
                    stop += 1
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column("ordinal"), pa.array(own), pa.array(own % factor == 0)], ["ordinal", "superstring", "sampled"])

    ordered = words.select(F.col("ordinal").cast("long"), F.col("length").cast("long")).coalesce(1).sortWithinPartitions("ordinal")
    return ordered.mapInArrow(fold, "ordinal long, superstring long, sampled boolean")

"""Segments: words compressed by a dictionary of patterns and two prefix codes, one for patterns and one for positions.

A file is read by Spark's own binaryFile source and is one row; many files are many tasks.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.dictionary import LONGEST, SHORTEST, code_lengths, heads_of, places
from .words import CorruptFile, get_uvarint, put_uvarint

# Fixed values of the format. Numbers in headers are big-endian; codes are read from the lowest bit of a byte on; a word
# is its length plus one, for each pattern its start relative to the one before plus one and the pattern, and 0, all
# coded; then, from a whole byte on, what no pattern covers. An empty word is its length alone.
LEAST_SIZE = 32
DEEPEST = 50
COUNTS, SIZE = struct.Struct(">QQ"), struct.Struct(">Q")
END = 0


class Code:
    """A prefix code: symbols in the order of the leaves of its tree, with their depths."""

    def __init__(self, leaves: list[tuple[int, object]]):
        self.leaves = leaves
        self.of: dict[object, tuple[int, int]] = {}
        self.symbols: dict[tuple[int, int], object] = {}
        # Read as a binary fraction, each leaf's path begins where the one before ends.
        at = 0
        for depth, symbol in leaves:
            path = at >> (DEEPEST - depth)
            if path << (DEEPEST - depth) != at or at >= 1 << DEEPEST:
                raise CorruptFile("depths that no tree has")
            bits = int(format(path, f"0{depth}b")[::-1], 2) if depth else 0
            self.of[symbol] = (bits, depth)
            self.symbols[depth, bits] = symbol
            at += 1 << (DEEPEST - depth)
        if leaves and at != 1 << DEEPEST:
            raise CorruptFile("depths that no tree has")
        self.depths = sorted({d for d, _ in leaves})

    @classmethod
    def for_uses(cls, uses: Counter) -> Code:
        depths = code_lengths(dict(uses))
        if depths and max(depths.values()) > DEEPEST:
            raise ValueError("a code deeper than the format allows")
        return cls(sorted((d, s) for s, d in depths.items()))

    def read(self, window: int) -> tuple[int, object]:
        for depth in self.depths:
            symbol = self.symbols.get((depth, window & ((1 << depth) - 1)))
            if symbol is not None:
                return depth, symbol
        raise CorruptFile("a code that stands for nothing")


def dictionary_of(words: list[bytes], most: int = 4096) -> dict[bytes, int]:
    """Patterns for words: their runs between blanks, with the blank after them, that save most; a score for each."""
    seen: Counter[bytes] = Counter()
    for w in words:
        seen.update(t + b" " for t in w.split(b" "))
    saved = {t[:LONGEST]: n * len(t) for t, n in seen.items() if n > 1 and SHORTEST <= len(t) <= LONGEST}
    best = sorted(saved.items(), key=lambda x: (-x[1], x[0]))[:most]
    return {t: max(1, n.bit_length()) for t, n in best}


def encode_segment(words: list[tuple[bytes, bool]], dictionary: dict[bytes, int] | None = None) -> bytes:
    """A segment of (word, compressed): words not to be compressed are coded without patterns."""
    if dictionary is None:
        dictionary = dictionary_of([w for w, c in words if c])
    heads, known = heads_of(dictionary)
    plans, positions, uses = [], Counter(), Counter()
    for w, compressed in words:
        found = places(w, dictionary, heads, known) if compressed and dictionary else []
        plan, last = [(len(w) + 1, None)], 0
        for at, n in found:
            plan.append((at - last + 1, w[at : at + n]))
            last = at
        if w:
            plan.append((END, None))
        plans.append((plan, found))
        positions.update(p for p, _ in plan)
        uses.update(p for _, p in plan if p is not None)
    of_pattern, of_position = Code.for_uses(uses), Code.for_uses(positions)
    patterns = b"".join(put_uvarint(d) + put_uvarint(len(p)) + p for d, p in of_pattern.leaves)
    starts = b"".join(put_uvarint(d) + put_uvarint(p) for d, p in of_position.leaves)
    out = [COUNTS.pack(len(words), sum(not w for w, _ in words)), SIZE.pack(len(patterns)), patterns, SIZE.pack(len(starts)), starts]
    for (w, _), (plan, found) in zip(words, plans, strict=True):
        bits = size = 0
        for position, pattern in plan:
            code, depth = of_position.of[position]
            bits, size = bits | code << size, size + depth
            if pattern is not None:
                code, depth = of_pattern.of[pattern]
                bits, size = bits | code << size, size + depth
        out.append(bits.to_bytes(-(-size // 8), "little"))
        reach = 0
        for at, n in found:
            out.append(w[reach:at])
            reach = at + n
        out.append(w[reach:])
    data = b"".join(out)
    return data + bytes(max(0, LEAST_SIZE - len(data)))


class Segment:
    """An open segment: its counts and dictionaries, checked, and its words."""

    def __init__(self, data: bytes):
        if len(data) < LEAST_SIZE:
            raise CorruptFile(f"{len(data)} bytes, less than any segment has")
        self.data = data
        self.count, self.empty = COUNTS.unpack_from(data)
        patterns, at = self._dictionary(COUNTS.size, True)
        positions, at = self._dictionary(at, False)
        if not self.count and not positions and len(data) > LEAST_SIZE:
            raise CorruptFile("a body without words")
        self.patterns, self.positions, self.start = Code(patterns), Code(positions), at

    def _dictionary(self, at: int, spelled: bool) -> tuple[list[tuple[int, object]], int]:
        if at + SIZE.size > len(self.data):
            raise CorruptFile("a dictionary beyond the end")
        (size,) = SIZE.unpack_from(self.data, at)
        at, leaves = at + SIZE.size, []
        end = at + size
        if end > len(self.data):
            raise CorruptFile("a dictionary larger than the file")
        while at < end:
            depth, at = get_uvarint(self.data, at)
            if depth > DEEPEST:
                raise CorruptFile(f"a code of depth {depth}")
            value, at = get_uvarint(self.data, at)
            if spelled:
                value, at = self.data[at : at + value], at + value
            leaves.append((depth, value))
        if at != end:
            raise CorruptFile("a dictionary entry beyond its end")
        return leaves, end

    def words(self, decode: bool = True) -> Iterator[tuple[int, int, int, bytes | None]]:
        """(ordinal, offset, length, word); without decode only places and lengths, and no word is put together."""
        at = self.start
        for ordinal in range(self.count):
            begin, bit = at, at * 8

            def symbol(code: Code) -> object:
                nonlocal bit
                window = int.from_bytes(self.data[bit // 8 : bit // 8 + 8], "little") >> bit % 8
                depth, found = code.read(window)
                bit += depth
                if bit > 8 * len(self.data):
                    raise CorruptFile("a word beyond the end")
                return found

            length = symbol(self.positions) - 1
            if length < 0:
                raise CorruptFile("a word without a length")
            put, last = [], 0
            while length and (position := symbol(self.positions)) != END:
                last += position - 1
                put.append((last, symbol(self.patterns)))
                if last + len(put[-1][1]) > length:
                    raise CorruptFile("a pattern beyond its word")
            at, reach = -(-bit // 8), 0
            whole = bytearray(length if decode else 0)
            for start, pattern in [*put, (length, b"")]:
                if start > reach:
                    if decode:
                        whole[reach:start] = self.data[at : at + start - reach]
                    at += start - reach
                if decode:
                    whole[start : start + len(pattern)] = pattern
                reach = start + len(pattern)
            if at > len(self.data):
                raise CorruptFile("a word beyond the end")
            yield ordinal, begin - self.start, length, bytes(whole) if decode else None


def open_segments(files: DataFrame, strict: bool = True) -> DataFrame:
    """(file, n_words, n_empty, n_patterns, n_positions, size, corrupt) of (file, content); a corrupt file is an error or,
    if not strict, a row that says why."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                try:
                    s = Segment(bytes(content))
                    rows.append((name, s.count, s.empty, len(s.patterns.leaves), len(s.positions.leaves), len(content), None))
                except CorruptFile as e:
                    if strict:
                        raise
                    rows.append((name, None, None, None, None, len(content), str(e)))
            yield pd.DataFrame(rows, columns=["file", "n_words", "n_empty", "n_patterns", "n_positions", "size", "corrupt"])

    return files.select("file", "content").mapInPandas(read, "file string, n_words long, n_empty long, n_patterns long, n_positions long, size long, corrupt string")


def segment_words(files: DataFrame, decode: bool = True) -> DataFrame:
    """(file, ordinal, offset, length, word) of (file, content); without decode word is null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in Segment(bytes(content)).words(decode)], columns=["file", "ordinal", "offset", "length", "word"])

    return files.select("file", "content").mapInPandas(read, "file string, ordinal long, offset long, length long, word binary")


def read_segments(spark: SparkSession, path: str, decode: bool = True) -> DataFrame:
    return segment_words(spark.read.format("binaryFile").load(path).withColumnRenamed("path", "file"), decode)

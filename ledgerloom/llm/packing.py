"""Operator 6, packing: documents in Hilbert order of their vectors, cut into sequences without padding."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ROW_ID, mix, slices, split_words, with_row_id, written

END_OF_DOCUMENT = 2
SEQUENCE = 4096

#: A document's vector is projected to so many dimensions, each of so many bits on the curve.
DIMENSIONS, BITS = 3, 12

#: Bytes of ids in a range of the curve, about.
RANGE_BYTES = 64 << 20

#: Bytes of text that are encoded at a time.
RUN = 4 << 20

#: Distinct words whose ids a worker keeps at most.
MOST_WORDS = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of plain letters and the marks after it. The tokenizer takes the letters, lower-cased, as one piece and the
#: marks as another.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", ".,;:!?"
PLAIN = re.compile(f"({LETTERS})([{MARKS}]*)")

#: Plain words that are encoded in one call.
JOINED = 64


class Encoder:
    """Token ids of whole texts, through a cache of distinct words.

    The tokenizer drops blanks and never merges across them, so ids of a text are those of its words in order. A plain
    word's ids are those of its lower-cased letters and of its marks; letters are encoded many words at a time and told
    apart by the tokens that end a word. A tokenizer for which a probe shows otherwise gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()
        probe = ["Some", "wordés", "stand...", "here,", "it's", "x2", "über!?", "sometimes", "UPPER"]
        whole = self._ids(["  ".join(probe) + "\n" + "\t".join(probe)])[0]
        self.by_word = whole == [i for p in probe * 2 for i in self._ids([p])[0]]
        self.plain = self.by_word and all(self._ids([p])[0] == self._ids([m[1].lower()])[0] + (self._ids([m[2]])[0] if m[2] else []) and self.ends[self._ids([m[1].lower()])[0]].sum() == 1 for p in probe if (m := PLAIN.fullmatch(p)))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.place[""] = 0

    def _hold(self, words: list[str], ids: list[np.ndarray], size: list[np.ndarray]) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.flat, self.size = np.concatenate((self.flat, *ids)), np.concatenate((self.size, *size))

    def _learn(self, new: list[str]) -> None:
        joined, single, order, ids, size = [], [], [], [], []
        for w in new:
            (joined if self.plain and PLAIN.fullmatch(w) else single).append(w)
        for k in range(0, len(joined), JOINED):
            part = joined[k : k + JOINED]
            got = np.array(self._ids([" ".join(part)])[0], np.uint32)
            last = np.flatnonzero(self.ends[got])
            if len(last) == len(part) and last[-1] == len(got) - 1:
                order += part
                ids.append(got)
                size.append(np.diff(last, prepend=-1))
            else:
                single += part
        if single:
            got = self._ids(single)
            order += single
            ids.append(np.fromiter((i for x in got for i in x), np.uint32))
            size.append(np.fromiter(map(len, got), np.int64, len(got)))
        if order:
            self._hold(order, ids, size)

    def _parts(self, words: pa.Array) -> np.ndarray:
        """For each word, the places of its letters and of its marks; of a word that isn't plain, of itself and of none."""
        plain = pc.match_substring_regex(words, f"^{LETTERS}[{MARKS}]*$") if self.plain else pa.array(np.zeros(len(words), bool))
        letters = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, MARKS)), words)
        marks = pc.if_else(plain, pc.replace_substring_regex(words, f"^{LETTERS}", ""), "")
        places = []
        for part in (letters, marks):
            coded = part.dictionary_encode()
            known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            at = list(map(self.place.get, known))
            new = [i for i, x in enumerate(at) if x is None]
            self._learn([known[i] for i in new])
            for i in new:
                at[i] = self.place[known[i]]
            places.append(np.array(at, np.int64)[coded.indices.to_numpy(zero_copy_only=False)])
        return np.stack(places, axis=1)

    def _expand(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of held words in order, and where each word's begin (one more than words)."""
        begin = np.cumsum(self.size) - self.size
        count = self.size[at]
        ends = np.concatenate(([0], np.cumsum(count)))
        return self.flat[np.repeat(begin[at] - ends[:-1], count) + np.arange(ends[-1])], ends

    def __call__(self, text: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's begin (one more than texts), and each text's sum of its ids' vectors."""
        if not self.by_word:
            ids = self._ids(pc.fill_null(text, "").to_pylist())
            flat, offsets = np.fromiter((i for x in ids for i in x), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
            return flat, offsets, between(vectors[flat], offsets)
        values, offsets = split_words(text)
        coded = values.dictionary_encode()
        if len(self.place) > MOST_WORDS:
            self.clear()
        own = self._parts(coded.dictionary) if len(values) else np.zeros((0, 2), np.int64)
        flat, starts = self._expand(own.ravel())
        starts = starts[::2]  # of each distinct word
        at = coded.indices.to_numpy(zero_copy_only=False)
        count = np.diff(starts)[at]
        ends = np.concatenate(([0], np.cumsum(count)))
        ids = flat[np.repeat(starts[:-1][at] - ends[:-1], count) + np.arange(ends[-1])]
        return ids, ends[offsets], between(between(vectors[flat], starts)[at], offsets)


def between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows from each offset to the next."""
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)))
    return np.diff(total[offsets], axis=0)


def projection(size: int) -> np.ndarray:
    """A fixed vector for each token id: each coordinate +1 or -1 by hash."""
    codes = mix(np.arange(size, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.stack([((codes >> np.uint64(7 * d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(DIMENSIONS)], axis=1)


def hilbert_key(cells: np.ndarray) -> np.ndarray:
    """Positions on the Hilbert curve of points whose coordinates (columns) have BITS bits each (Skilling's transform)."""
    x = [cells[:, d].astype(np.int64).copy() for d in range(cells.shape[1])]
    n, bit = len(x), 1 << (BITS - 1)
    while bit > 1:
        low = bit - 1
        for d in range(n):
            flip = (x[d] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    mask, bit = np.zeros_like(x[0]), 1 << (BITS - 1)
    while bit > 1:
        mask ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for d in range(n):
            key = key << 1 | ((x[d] ^ mask) >> b & 1)
    return key


def cells_of(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cells of the documents' mean vectors: a mean of n signs is about normal with deviation 1/sqrt(n)."""
    z = sums / np.sqrt(np.maximum(1, n))[:, None]
    share = 1 / (1 + np.exp(-np.clip(z * 1.6, -40, 40) / np.maximum(1, np.sqrt(np.maximum(1, n)) / 8)[:, None]))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def pieces(docs: Iterator[tuple[int, np.ndarray]], sequence: int = SEQUENCE):
    """Cuts documents in their order into sequences: (row, start, length, crc, doc_tokens, sequence, offset).

    Sequences are full; what is left after the last full one is cut into sequences whose lengths are powers of two.
    """
    held: list[tuple[int, int, np.ndarray, int]] = []  # of the open sequence: row, start, ids, tokens of the document
    size = number = 0

    def emit(parts, number):
        offset = 0
        for row, start, ids, tokens in parts:
            yield row, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, number, offset
            offset += len(ids)

    for row, ids in docs:
        start = 0
        while start < len(ids):
            part = ids[start : start + sequence - size]
            held.append((row, start, part, len(ids)))
            start, size = start + len(part), size + len(part)
            if size == sequence:
                yield from emit(held, number)
                held, size, number = [], 0, number + 1
    while size:
        room, full = 1 << (size.bit_length() - 1), []
        size -= room
        while room:
            row, start, ids, tokens = held[0]
            full.append((row, start, ids[:room], tokens))
            if len(ids) <= room:
                held.pop(0)
            else:
                held[0] = (row, start + room, ids[room:], tokens)
            room -= min(room, len(ids))
        yield from emit(full, number)
        number += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert.

    Documents are tokenized once, into a written table of 16-bit ids (32-bit, if there are more); with the table comes each document's place on a
    Hilbert curve through the space of its hashed, projected token vector. The table is then dealt by ranges of that
    key (rows of one key are dealt by row, so equal documents spread) and sorted within; each range is packed in order
    as a stream that holds one open sequence. Only the last sequences of a range can be shorter than SEQUENCE, and
    their lengths are powers of two: nothing is padded.

    Defined cases: a null or empty text is the end-of-document token alone; repeated rows are packed each; null ids
    stay; a very long document runs through as many sequences as it needs; documents of one key follow each other by
    row; an empty table gives an empty one; columns besides id and text are left out.
    """
    path = tokenizer or default_tokenizer()
    vocabulary = Encoder(path).tokenizer.get_vocab_size()
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = with_row_id(docs).select(ROW_ID, F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        vectors = projection(vocabulary)
        for batch in batches:
            for part in slices(batch, "_text", RUN):
                ids, at, sums = encode(part.column("_text"), vectors)
                key = hilbert_key(cells_of(sums, np.diff(at)))
                ids = ids.astype(width)
                packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(at * ids.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(ROW_ID), part.column("doc_id"), pa.array(key, pa.int64()), pa.array(np.diff(at)), packed.cast(pa.binary())], [ROW_ID, "doc_id", "hilbert", "n", "ids"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    table = written(rows.mapInArrow(encoded, f"{ROW_ID} long, doc_id {id_type}, hilbert long, n long, ids binary"), "tokens")
    # Ranges grow with the data: a task packs about RANGE_BYTES of ids, however large the table.
    held = (table.agg(F.sum("n")).first()[0] or 0) * np.dtype(width).itemsize
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(held / RANGE_BYTES))
    dealt = table.drop("n").repartitionByRange(ranges, "hilbert", ROW_ID).sortWithinPartitions("hilbert", ROW_ID).withColumn("_range", F.spark_partition_id())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, tuple] = {}
        first = 0

        def stream():
            nonlocal first
            n = 0
            for batch in batches:
                first = batch.column("_range")[0].as_py() << 32 if batch.num_rows else first
                for doc, key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("hilbert").to_pylist(), batch.column("ids"), strict=True):
                    place[n] = (doc, key)
                    yield n, np.append(np.frombuffer(ids.as_buffer(), width).astype(np.uint32), np.uint32(END_OF_DOCUMENT))
                    n += 1

        def batch_of(got):
            docs_, keys = zip(*(place[g[0]] for g in got), strict=True)
            cols = [pa.array(c, pa.int64()) for c in list(zip(*got, strict=True))[1:]]
            cols[4] = pc.add(cols[4], first)
            for done in [r for r in place if r < got[-1][0]]:
                del place[done]
            return pa.RecordBatch.from_arrays([pa.array(docs_, doc_type), *cols, pa.array(keys, pa.int64())], names)

        got = []
        for piece in pieces(stream()):
            got.append(piece)
            if len(got) >= 20_000:
                yield batch_of(got)
                got = []
        if got:
            yield batch_of(got)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "hilbert"]
    doc_type = to_arrow_type(rows.schema["doc_id"].dataType)
    return dealt.mapInArrow(packed, f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names[1:]))

"""Operator 10, n-gram Jaccard join: parity sketches, joined part by part, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, drop, hash_words, mix, slices, split_words, with_row_id, written
from .components import components

SHINGLE = 5

#: Linked: 100 * common >= LEAST_PERCENT * all. The bounds below hold for this value: |A ^ B| <= (|A| + |B|) / 9.
LEAST_PERCENT = 80

#: Of the pairs that the sketches allow, how many of each row are verified in the turns of step 2.
LIKELIEST = (2, 16)

#: Members of a part's group that are compared at a time, and bytes of their sketches.
BLOCK, BLOCK_BYTES = 2048, 16 << 20

#: Blocks up to this size are compared pair by pair, larger ones row by row against arrays.
SMALL = 32

#: Pairs that a task remembers, so that it tells of each but once.
REMEMBERED = 500_000

#: Shingles of texts that are held against each other at a time, about, where all links are counted and where a group's
#: pairs are verified: larger components and groups are cut in parts.
TILE, GROUP_TILE = 1 << 17, 1 << 20

#: Bytes of text hashed at a time; the arrays made of them are about forty times as large.
RUN = 1 << 20


def grouped_order(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Positions sorted by group and value. Groups of a run of texts are few, and 16 bits sort by counting."""
    order = np.argsort(value)
    group = group[order]
    if len(group) and group.max() < 1 << 16:
        group = group.astype(np.uint16)
    return order[np.argsort(group, kind="stable")]


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' distinct shingles, sorted within each text, and where each text's begin.

    Words are lower-cased in A-Z. A text of fewer words than a shingle has one shingle of all its words, or none.
    """
    values, offsets = split_words(text)
    words = hash_words(pc.ascii_lower(values))
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    at = np.arange(len(words)) - offsets[:-1][row]
    length = np.minimum(n, SHINGLE)[row].astype(np.uint64)
    code = mix(length)
    for k in range(SHINGLE):
        ahead = np.concatenate((words[k:], np.zeros(min(k, len(words)), np.uint64)))
        code = np.where(length > k, mix(code * np.uint64(0x9E3779B97F4A7C15) + ahead), code)
    begins = at <= np.maximum(n - SHINGLE, 0)[row]
    code, row = code[begins], row[begins]
    order = grouped_order(row, code)
    code, row = code[order], row[order]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])))[: len(code)]
    return code[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(n)))))


def most_apart(n: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of a set of n and any set linked to it, which has n * 5 / 4 at most."""
    return (n + n * 5 // 4) // 9


def sketches(codes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set, two to four bits for each member: member after member flips one. The bits in which two sketches
    differ are at most the members in which the sets do. Folding neighbours halves a sketch."""
    n = np.diff(offsets)
    power = np.clip(np.ceil(np.log2(np.maximum(n, 1) * 2)), 6, 20).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(1 << power)))
    row = np.repeat(np.arange(len(n)), n)
    bit = (mix(codes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> (64 - power[row]).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(starts[row] + bit, minlength=starts[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd)  # sketches begin at whole bytes
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(starts, starts[1:], strict=False)]


def fold(sketch: bytes, size: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(sketch, np.uint8))
    while len(bits) > size * 8:
        bits = bits[::2] ^ bits[1::2]
    return np.packbits(bits).view(np.uint64)


def part_keys(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): for each set, keys of enough parts of its sketch that any two linked sets have one in common.

    A size band b holds sets of 2^b to 2^(b+1) - 1 members. In a band's layout every member belongs to one of so many
    parts, and a part's parity bits are the XOR of its members' hashes. Linked sets differ in at most d = most_apart
    parts of a layout that both have: a set uses that of its band, and that of the next if a partner may be there.
    Pigeonhole with an order: if a set has more than d parts with members, the first of the common parts is within the
    first d + 1 parts of both, in any order that depends on the parts alone. The order is by falling number of members,
    so that keys of several members, which are rarely common by chance, come first. A set with d or fewer such parts
    also gives keys of a layout in which each member is a part; two linked sets without a common key in the first
    layout are both such.
    """
    n = np.diff(offsets)
    d = most_apart(n)
    band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    found_set, found_key = [], []

    def give(own: np.ndarray, layout: np.ndarray, single: bool) -> np.ndarray:
        """Keys of the sets `own` in their layouts; the sets with too few parts."""
        size = n[own]
        row = np.repeat(np.arange(len(own)), size)
        code = codes[np.repeat(offsets[own], size) + np.arange(size.sum()) - np.repeat(np.concatenate(([0], np.cumsum(size)))[:-1], size)]
        if single:
            part, first = code, np.arange(len(code))
        else:
            parts = np.where(layout < 5, 2 << layout, 3 << np.maximum(layout - 2, 0)).astype(np.uint64)
            part = ((code >> np.uint64(32)) * parts[row]) >> np.uint64(32)  # rises with the hash, so parts are in order
            first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])))[: len(code)])
        if not len(first):
            return own[:0]
        members = np.diff(np.append(first, len(code)))
        parity = np.bitwise_xor.reduceat(code, first)
        where = row[first]
        salt = mix((layout[where] * 2 + single).astype(np.uint64) + np.uint64(77))
        key = mix(parity ^ mix(part[first] + salt) ^ mix(members.astype(np.uint64)))
        order = np.lexsort((key, where * 256 + 255 - np.minimum(members, 255)))
        where, key = where[order], key[order]
        held = np.bincount(where, minlength=len(own))
        rank = np.arange(len(where)) - np.concatenate(([0], np.cumsum(held)))[:-1][where]
        use = rank <= d[own][where]
        found_set.append(own[where[use]])
        found_key.append(key[use])
        return np.flatnonzero(held <= d[own])

    several = np.flatnonzero(d > 0)
    for own in (several, several[(n[several] * 5 // 4) >= (2 << band[several])]):
        layout = band[own] + (own is not several)
        few = give(own, layout, False)
        if len(few):
            give(own[few], layout[few], True)
    if not found_set:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found_set), np.concatenate(found_key)


def _digests(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = lambda x: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))[offsets])
    return total(mix(codes)), total(mix(codes ^ np.uint64(0x5555555555555555)))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text", RUN):
            codes, offsets = shingle_sets(part.column("_text"))
            d1, d2 = _digests(codes, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(ROW_ID), part.column("_id"), pa.array(np.diff(offsets)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sketches(codes, offsets), pa.binary())],
                [ROW_ID, "_id", "n", "d1", "d2", "sketch"],
            )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row, more): a key's sets within a run of rows are one row. Of equal sets in a task only the first counts."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for part in slices(batch, "_text", RUN):
            codes, offsets = shingle_sets(part.column("_text"))
            ids = part.column(ROW_ID).to_numpy(zero_copy_only=False)
            digests = list(zip(*(x.tolist() for x in _digests(codes, offsets)), strict=True))
            fresh = np.zeros(len(ids), bool)
            for i, own in enumerate(digests):
                if own not in seen:
                    seen.add(own)
                    fresh[i] = True
            if len(seen) > 1_000_000:
                seen.clear()
            held, key = part_keys(codes, offsets)
            held, key = held[fresh[held]], key[fresh[held]]
            order = np.argsort(key)
            held, key = held[order], key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
            rest = np.ones(len(key), bool)
            rest[first] = False
            ends = np.concatenate(([0], np.cumsum(rest)))[np.append(first, len(key))]
            more = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[held[rest]], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(ids[held[first]]), more], ["key", "row", "more"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: (key, row, first row) of keys with several rows. Holds no group, only its first row."""
    own = head = None
    told = True
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        row = batch.column("row").to_numpy(zero_copy_only=False)
        more = batch.column("more")
        sizes = np.diff(np.asarray(more.offsets))
        flat = more.flatten().to_numpy(zero_copy_only=False)
        new = np.concatenate(([own is None or key[0] != own], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        heads = np.where(start >= 0, row[np.maximum(start, 0)], -1 if head is None else head)
        # A row counts if its key stands before or after it, or if it holds several rows itself. A head that was the
        # last of its batch is told of with the next row of its key.
        after = np.concatenate((~new[1:], [False]))
        counts = ~new | after | (sizes > 0)
        lead = [(own, head)] if own is not None and not told and not new[0] else []
        keys = np.concatenate(([k for k, _ in lead], key[counts], np.repeat(key, sizes))).astype(np.int64)
        rows = np.concatenate(([r for _, r in lead], row[counts], flat)).astype(np.int64)
        firsts = np.concatenate(([r for _, r in lead], heads[counts], np.repeat(heads, sizes))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows), pa.array(firsts)], ["key", "row", "first"])
        own, head = key[-1], heads[-1]
        told = bool(counts[-1])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b) with sizes and sketches, those whose sizes and sketches allow a link."""
    for batch in batches:
        keep = []
        for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True):
            fits = min(m, n) * 100 >= max(m, n) * LEAST_PERCENT
            if fits:
                size = min(len(x), len(y))
                apart = int.from_bytes(x) ^ int.from_bytes(y) if len(x) == len(y) else int.from_bytes((fold(x, size) ^ fold(y, size)).tobytes())
                fits = apart.bit_count() <= (m + n) // 9
            keep.append(fits)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _meetings(block: list[list], most: int) -> tuple[list[np.ndarray], bool]:
    """Of a block's rows (side, row, comp, n, sketch), the pairs that _crossing wants, as arrays of lower and higher row;
    whether some row had more than `most` of them."""
    if len({b[2] for b in block}) < 2:
        return [], False
    size = min(len(b[4]) for b in block)
    near: list[list[tuple[int, int]]] = [[] for _ in block]
    if len(block) <= SMALL:
        bits = [int.from_bytes(b[4] if len(b[4]) == size else fold(b[4], size).tobytes()) for b in block]
        for i, (side, row, comp, n, _) in enumerate(block):
            for j in range(i):
                side_j, row_j, comp_j, n_j, _ = block[j]
                if comp != comp_j and (side < 0 or side != side_j) and min(n, n_j) * 100 >= max(n, n_j) * LEAST_PERCENT:
                    apart = (bits[i] ^ bits[j]).bit_count()
                    if apart <= (n + n_j) // 9:
                        near[i].append((apart, row_j))
                        near[j].append((apart, row))
        over = any(len(x) > most for x in near)
        found = [(min(b[1], r), max(b[1], r)) for b, x in zip(block, near, strict=True) for _, r in (sorted(x)[:most] if over else x)]
        return [np.array(sorted(set(found)), np.int64)] if found else [], over
    side, row, comp, n = (np.array([b[i] for b in block], np.int64) for i in range(4))
    bits = np.stack([fold(b[4], size) for b in block])
    found, over = [], False
    for i in range(len(block)):
        ok = (comp != comp[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * LEAST_PERCENT)
        if side[i] >= 0:
            ok &= side != side[i]
        at = np.flatnonzero(ok)
        if len(at):
            apart = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
            fits = apart <= (n[at] + n[i]) // 9
            at, apart = at[fits], apart[fits]
            if len(at) > most:
                at, over = at[np.lexsort((row[at], apart))[:most]], True
            found.append(np.stack((np.minimum(row[at], row[i]), np.maximum(row[at], row[i])), axis=1))
    return found, over


def _crossing(most: int):
    """From rows (key, part_a, part_b, side, row, comp, n, sketch) sorted by the first three: pairs (a, b) of rows of
    different components whose sizes and sketches allow a link, for each row the `most` likeliest. Of two blocks, rows of
    the one meet those of the other. A row with a key alone says that this key has more pairs than that."""

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pair of near copies meets under many keys; of those in a task it is told of once, as far as memory goes.
        told: set[int] = set()

        def tell(block: list[list], key: int) -> Iterator[tuple[int | None, int | None, int | None]]:
            found, over = _meetings(block, most)
            if over:
                yield None, None, key
            for run in found:
                for lo, hi in run.tolist():
                    pair = lo << 64 | hi
                    if pair not in told:
                        if len(told) >= REMEMBERED:
                            told.clear()
                        told.add(pair)
                        yield lo, hi, None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "b", "key"])

        block, own, got = [], None, []
        for batch in batches:
            for key, a, b, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "part_a", "part_b", "side", "row", "comp", "n", "sketch")), strict=True):
                if (key, a, b) != own:
                    for row in tell(block, own[0]) if block else ():
                        got.append(row)
                        if len(got) >= 50_000:
                            yield packed(got)
                            got = []
                    block = []
                own = (key, a, b)
                block.append(member)
        for row in tell(block, own[0]) if block else ():
            got.append(row)
            if len(got) >= 50_000:
                yield packed(got)
                got = []
        yield packed(got)

    return crossing


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = np.intersect1d(x, y, assume_unique=True).size
            keep.append(100 * common >= LEAST_PERCENT * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Sets:
    """Shingle sets of the rows that take part in some candidate pair, as written tables."""

    def __init__(self, texts: DataFrame):
        self.texts = texts

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are linked. A pair's first set travels to its second."""
        wanted = pairs.select(F.col("a").alias("_w")).unionByName(pairs.select(F.col("b").alias("_w"))).distinct()

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "_text", RUN):
                    codes, offsets = shingle_sets(part.column("_text"))
                    packed = [codes[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([part.column(ROW_ID), pa.array(packed, pa.binary())], ["_r", "_set"])

        sets = written(self.texts.join(wanted, F.col(ROW_ID) == F.col("_w"), "left_semi").mapInArrow(made, "_r long, _set binary"), "sets")
        first = pairs.join(sets.withColumnsRenamed({"_r": "a", "_set": "x"}), "a")
        return first.join(sets.withColumnsRenamed({"_r": "b", "_set": "y"}), "b").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")


def _allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = nodes.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_near, "a long, b long")


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[k] .. begin[k] + size[k] - 1 of all k."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def _tile_links(block: list[tuple]) -> list[tuple[int, int]]:
    """Of a tile's rows (side, row, comp, origin, set), links that join all components that any link joins. All pairs are
    verified on their sets, of two sides those across, but for those of one component or origin."""
    block = sorted(block, key=lambda b: (b[0], len(b[4])))
    side, row, comp, origin = (np.array([b[k] for b in block], np.int64) for k in range(4))
    if (comp == comp[0]).all() or (origin == origin[0]).all():
        return []
    n = np.array([len(b[4]) // 8 for b in block], np.int64)
    begin = np.cumsum(n) - n
    known, code = np.unique(np.frombuffer(b"".join(b[4] for b in block), np.uint64), return_inverse=True)
    split = int(np.searchsorted(side, side[0], "right"))
    whole = split == len(block)  # one side: each row meets those after it
    first, other = (0, n) if whole else (split, n[split:])
    marked, found = np.zeros(len(known), np.int32), []
    for i in range(split):
        low = i + 1 if whole else first + int(np.searchsorted(other * 100, n[i] * LEAST_PERCENT, "left"))
        high = first + int(np.searchsorted(other * LEAST_PERCENT, n[i] * 100, "right"))
        at = low + np.flatnonzero((comp[low:high] != comp[i]) & (origin[low:high] != origin[i])) if low < high else ()
        if not len(at):
            continue
        own = code[begin[i] : begin[i] + n[i]]
        marked[own] = 1
        common = np.add.reduceat(marked[code[_ragged(begin[at], n[at])]], np.cumsum(n[at]) - n[at]).astype(np.int64)
        marked[own] = 0
        for j in at[100 * common >= LEAST_PERCENT * (n[i] + n[at] - common)]:
            if comp[j] != comp[i]:
                found.append((int(row[i]), int(row[j])))
                comp[comp == comp[j]] = comp[i]
    return found


def _joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (own, part_a, part_b, side, row, comp, origin, set) sorted by the first three: links (a, b), see
    _tile_links. A tile gives fewer links than it has rows."""
    block, own, got = [], None, []
    for batch in batches:
        for group, a, b, *member in zip(*(batch.column(c).to_pylist() for c in ("own", "part_a", "part_b", "side", "row", "comp", "origin", "set")), strict=True):
            if (group, a, b) != own and block:
                got += _tile_links(block)
                block = []
            own = (group, a, b)
            block.append(member)
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(2)], ["a", "b"])
        got = []
    got = _tile_links(block) if block else []
    yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(2)], ["a", "b"])


def _joined_in_tiles(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (a, b) that join all components that links within the groups `own` of placed (own, row, comp, n, origin)
    join; placed is a written table. Groups are cut into parts by count and by shingles, and each two parts are a tile:
    a row's set is sent once for each part of its group, and no pair is written down but the links that join something."""
    sizes = placed.groupBy("own").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / GROUP_TILE)).cast("int").alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("origin").alias("lo_o"), F.max("origin").alias("hi_o"))
    sizes = written(sizes.where("lo != hi AND lo_o != hi_o").select("own", "parts"), "groups")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("part_a"), F.greatest(k, F.col("part")).alias("part_b")))
    dealt = placed.join(sizes, "own").withColumn("part", part)
    # A row's places are one list, so that its set is made once.
    dealt = dealt.groupBy(F.col("row").alias("_r"), F.col("comp")).agg(F.collect_list(F.struct("own", "parts", "part", "origin")).alias("at"))
    dealt = written(dealt, "tiled")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, "_text", RUN):
                codes, offsets = shingle_sets(run.column("_text"))
                packed = pa.array([codes[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([run.column("_r"), packed], ["_r", "set"])

    sets = texts.join(dealt.select("_r"), F.col(ROW_ID) == F.col("_r"), "left_semi").select(F.col(ROW_ID).alias("_r"), "_text").mapInArrow(made, "_r long, set binary")
    tiles = dealt.join(sets, "_r").select(F.col("_r").alias("row"), "comp", "set", F.inline("at")).select("row", "comp", "set", "own", "origin", F.col("part"), F.explode(meets).alias("m"))
    tiles = tiles.select("own", "m.part_a", "m.part_b", F.col("part").alias("side"), "row", "comp", "origin", "set")
    links = tiles.repartition("own", "part_a", "part_b").sortWithinPartitions("own", "part_a", "part_b").mapInArrow(_joins, "a long, b long")
    return written(links.distinct(), "tile-links")


def _tile(block: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Of a tile's rows (side, row, weight, set), the rows and the weight of those that each is linked to. All pairs are
    verified on their sets, of two sides those across; sizes alone leave some out, which can't be linked."""
    block = sorted(block, key=lambda b: (b[0], len(b[3])))
    side, row, weight = (np.array([b[k] for b in block], np.int64) for k in range(3))
    n = np.array([len(b[3]) // 8 for b in block], np.int64)
    ends = np.concatenate(([0], np.cumsum(n)))
    known, code = np.unique(np.frombuffer(b"".join(b[3] for b in block), np.uint64), return_inverse=True)
    split = int(np.searchsorted(side, side[0], "right"))
    whole = split == len(block)  # one side: each row meets those after it
    begin, other = (0, n) if whole else (split, n[split:])
    marked, links = np.zeros(len(known), np.int32), np.zeros(len(block), np.int64)
    for i in range(split):
        low = i + 1 if whole else begin + int(np.searchsorted(other * 100, n[i] * LEAST_PERCENT, "left"))
        high = begin + int(np.searchsorted(other * LEAST_PERCENT, n[i] * 100, "right"))
        if low >= high:
            continue
        own = code[ends[i] : ends[i + 1]]
        marked[own] = 1
        common = np.add.reduceat(marked[code[ends[low] : ends[high]]], ends[low:high] - ends[low]).astype(np.int64)
        marked[own] = 0
        at = low + np.flatnonzero(100 * common >= LEAST_PERCENT * (n[i] + n[low:high] - common))
        links[i] += weight[at].sum()
        links[at] += weight[i]
    return row, links


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (comp, part_a, part_b, side, row, weight, set) sorted by the first three: (row, links), see _tile."""
    block, own, rows, links = [], None, [], []

    def told() -> pa.RecordBatch:
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, links)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["row", "links"])

    def close() -> None:
        for x, kept in zip(_tile(block), (rows, links), strict=True):
            kept.append(x)

    for batch in batches:
        for comp, a, b, *member in zip(*(batch.column(c).to_pylist() for c in ("comp", "part_a", "part_b", "side", "row", "weight", "set")), strict=True):
            if (comp, a, b) != own and block:
                close()
                block = []
            own = (comp, a, b)
            block.append(member)
        yield told()
        rows, links = [], []
    if block:
        close()
    yield told()


def _n_links(texts: DataFrame, member: DataFrame, joined: DataFrame) -> DataFrame:
    """(rep, n_links, root) for each class: of one of its rows, the other rows that are linked to it.

    Every link lies within a component. So the classes of each component of several are verified pair by pair, in tiles
    of two parts of the component; a tile gives a count for each class and no pair.
    """
    weights = written(member.groupBy("rep").agg(F.count("*").alias("weight"), F.first("n").alias("n")), "weights")
    placed = joined.select(F.col("node").alias("_r"), F.col("root").alias("comp")).unionByName(joined.select(F.col("root").alias("_r"), F.col("root").alias("comp")).distinct())
    placed = written(placed.join(weights, F.col("_r") == F.col("rep")).select("_r", "comp", "weight", "n"), "placed")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / TILE)).cast("int")
    parts = written(placed.groupBy("comp").agg(parts.alias("parts")), "parts")
    placed = placed.join(parts, "comp").select("_r", "comp", "weight", "parts", F.pmod(F.xxhash64("_r"), F.col("parts")).cast("int").alias("own"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", RUN):
                codes, offsets = shingle_sets(part.column("_text"))
                packed = pa.array([codes[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "comp", "weight", "parts", "own")), packed], ["row", "comp", "weight", "parts", "own", "set"])

    sets = texts.join(placed, F.col(ROW_ID) == F.col("_r")).select(F.col(ROW_ID).alias("row"), "comp", "weight", "parts", "own", "_text")
    sets = sets.mapInArrow(made, "row long, comp long, weight long, parts int, own int, set binary")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("part_a"), F.greatest(k, F.col("own")).alias("part_b")))
    tiles = sets.select("comp", "own", "row", "weight", "set", F.explode(meets).alias("m")).select("comp", "m.*", F.col("own").alias("side"), "row", "weight", "set")
    found = tiles.repartition("comp", "part_a", "part_b").sortWithinPartitions("comp", "part_a", "part_b").mapInArrow(_tiles, "row long, links long")
    found = found.groupBy("row").agg(F.sum("links").alias("links"))
    counted = weights.join(found, F.col("rep") == F.col("row"), "left").select("rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return written(counted.join(joined, F.col("rep") == F.col("node"), "left").select("rep", "n_links", F.coalesce("root", "rep").alias("root")), "n-links")


def _rooted(rows: DataFrame, id_col: str, text_col: str, count: bool = False) -> DataFrame:
    """(row, _id, n, root) for each row of rows, which have row ids; with count also n_links."""
    texts = rows.select(ROW_ID, F.col(text_col).alias("_text"))
    id_type = rows.schema[id_col].dataType.simpleString()
    described = rows.select(ROW_ID, F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_described, f"{ROW_ID} long, _id {id_type}, n long, d1 long, d2 long, sketch binary")
    described = written(described, "sets-described")
    # A written table, so that the join below is split where a class has very many rows.
    kinds = written(described.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(ROW_ID).alias("rep")), "kinds")
    member = written(described.join(kinds, ["n", "d1", "d2"], "left").select(F.col(ROW_ID).alias("row"), F.coalesce("rep", F.col(ROW_ID)).alias("rep"), "_id", "n"), "classes")
    nodes = described.join(member.where("row = rep").select(F.col("row").alias("_m")), F.col(ROW_ID) == F.col("_m"), "left_semi").select(F.col(ROW_ID).alias("row"), "n", "sketch")

    keyed = texts.mapInArrow(_keyed, "key long, row long, more array<long>")
    shared = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, row long, first long")
    shared = written(shared, "shared-keys")
    rep = member.select(F.col("row").alias("_r"), "rep")
    stars = shared.where("row != first").select("row", "first").distinct()
    stars = stars.join(rep, F.col("row") == F.col("_r")).select("first", F.col("rep").alias("x")).join(rep, F.col("first") == F.col("_r")).select("x", F.col("rep").alias("y"))
    stars = written(_allowed(stars.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), nodes), "stars")
    sets = _Sets(texts)
    links = written(sets.linked(stars), "links")
    joined = components(links)

    def belongs() -> DataFrame:
        return nodes.join(joined, F.col("row") == F.col("node"), "left").select(F.col("row").alias("_r"), "n", "sketch", F.coalesce("root", "row").alias("comp"))

    def mixed(held: DataFrame, comps: DataFrame) -> DataFrame:
        """(key, row, size, bytes) of the keys of held (key, row) with several components."""
        placed = held.join(comps.select("_r", "comp", F.octet_length("sketch").alias("bytes")), F.col("row") == F.col("_r"))
        placed = written(placed.select("key", "row", "comp", "bytes"), "held-keys")
        sizes = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
        sizes = written(sizes.where("lo != hi").select("key", "size", "bytes"), "mixed")
        found = written(placed.select("key", "row").join(sizes, "key"), "mixed-keys")
        drop(placed, sizes)
        return found

    # Keys whose rows still belong to several components. A key goes on to the next turn only if some of its rows had
    # more likely pairs than the turn took: of the others every allowed pair is verified.
    held, tested = shared.select("key", "row"), stars
    for most in LIKELIEST:
        comps = belongs()
        held = mixed(held, comps)
        grouped = held.withColumn("parts", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")).withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("part_a"), F.greatest(k, F.col("own")).alias("part_b")))
        grouped = grouped.select("key", "row", "own", F.explode(meets).alias("m")).select("key", "row", "m.*", F.when(F.col("m.part_a") == F.col("m.part_b"), -1).otherwise(F.col("own")).alias("side"))
        grouped = grouped.join(comps, F.col("row") == F.col("_r")).select("key", "part_a", "part_b", "side", "row", "comp", "n", "sketch")
        crossing = grouped.repartition("key", "part_a", "part_b").sortWithinPartitions("key", "part_a", "part_b").mapInArrow(_crossing(most), "a long, b long, key long")
        crossing = written(crossing.distinct(), "crossing")
        fresh = written(crossing.where("key IS NULL").select("a", "b").join(tested, ["a", "b"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            tested = tested.unionByName(fresh)
            links = written(links.unionByName(sets.linked(fresh)), "links")
            joined = components(links)
        more = written(crossing.where("key IS NOT NULL").select("key"), "more-keys")
        if more.isEmpty():
            break
        held = held.join(more, "key", "left_semi").select("key", "row")
    else:
        # What is left are keys of many rows that lie close to each other without being linked. Rows that share their
        # keys' smallest row are a group, in which a pair meets once however many keys it shares; then, in keys of several
        # groups, those across meet.
        held = mixed(held, belongs()).select("key", "row")
        least = written(held.groupBy("key").agg(F.min("row").alias("least")), "least-rows")
        leaders = written(held.join(least, "key").groupBy("row").agg(F.min("least").alias("leader")), "leaders")
        by_leader = leaders.select(F.col("leader").alias("own"), "row", F.col("row").alias("origin"))
        by_key = held.join(leaders, "row").select(F.col("key").alias("own"), "row", F.col("leader").alias("origin"))
        for groups in (by_leader, by_key):
            placed = groups.join(belongs().select("_r", "n", "comp"), F.col("row") == F.col("_r")).select("own", "row", "n", "comp", "origin")
            fresh = _joined_in_tiles(texts, written(placed, "close-rows"))
            if not fresh.isEmpty():
                links = written(links.unionByName(fresh), "links")
                joined = components(links)

    if count:
        return written(member.join(_n_links(texts, member, joined), "rep").select("row", "_id", "n", "root", "n_links"), "rooted")
    rooted = member.join(joined, F.col("rep") == F.col("node"), "left").select("row", "_id", "n", F.coalesce("root", "rep").alias("root"))
    return written(rooted, "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_shingles, n_links, the number of other rows linked to it, and component_id, the smallest id reachable
    by links.

    Texts with equal sets are one class, and its first row stands for it. Classes are linked in two steps, both exact
    where they find something, and then counted in a third:

    1. All rows of a part key (see part_keys) are held against its first row. Nearly all near copies are joined here,
       at one pair per row and first row however large the group.
    2. In the groups that still hold several components, the sketches of all rows of different components are compared
       in memory, in blocks, and of the pairs that the sketch bound allows the likeliest few of each row go on, in two
       turns. Where a row had more still, the pairs between components are verified on their sets, in tiles of bounded
       size that tell of no pair but the links that join something: quadratic in time where thousands of texts lie close
       to each other without being linked, but not in rows or memory.

    Allowed pairs are verified on the sets themselves. Any two linked sets have a key in common, so a link between
    components of step 1 is found in step 2: no link between components is lost.

    3. The links within the components, which the steps before needn't all find, are counted by verifying all classes of
       each component against each other (see _n_links). one_of_each needs no counts and leaves this out.

    A key's rows are gathered within each run of rows before the shuffle and streamed after it; a group larger than
    BLOCK is compared as pairs of blocks in tasks of their own.

    Defined cases: a null or empty text has n_shingles 0, no links and its own id; so has any text that nothing links to; equal
    texts are linked, also of fewer than SHINGLE words; rows with one id are rows of their own that share the id; null
    ids count for nothing in the smallest id, which is null in a component without any; an empty table gives an empty
    one; other columns pass through, but for n_shingles, n_links and component_id.
    """
    names = [c for c in docs.columns if c not in ("n_shingles", "n_links", "component_id")]
    rows = with_row_id(docs)
    rooted = _rooted(rows, id_col, text_col, count=True)
    least = written(rooted.groupBy("root").agg(F.min("_id").alias("_least")), "least-ids")
    named = rooted.join(least, "root").select(F.col("row").alias("_row"), F.col("n").alias("_n"), F.col("n_links").alias("_links"), "_least")
    return rows.join(named, F.col(ROW_ID) == F.col("_row")).select(*names, F.col("_n").alias("n_shingles"), F.col("_links").alias("n_links"), F.col("_least").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, unchanged: that of the smallest id (null last), and of several with that id the first.

    Texts without words are components of their own and stay. Its cases are those of near_duplicates(), but that all
    columns pass through, whatever their names."""
    rows = with_row_id(docs)
    rooted = _rooted(rows, id_col, text_col)
    # Two minima that each task makes before the shuffle; with no id at all, the smallest row.
    chosen = written(rooted.groupBy("root", "_id").agg(F.min("row").alias("_kept")), "chosen")
    least = written(chosen.groupBy("root").agg(F.min("_id").alias("_least")), "least-ids")
    kept = chosen.join(least.withColumnRenamed("root", "_root"), (F.col("root") == F.col("_root")) & F.col("_id").eqNullSafe(F.col("_least"))).select("_kept")
    return rows.join(kept, F.col(ROW_ID) == F.col("_kept"), "left_semi").select(*docs.columns)

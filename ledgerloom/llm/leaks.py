"""Operator 1, benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edits allowed in an item, as a share of its normalised characters. Pieces then have about 1 / EDIT_SHARE characters.
EDIT_SHARE = 0.05

#: Characters of benchmark text that are searched for at a time; a larger benchmark is searched for in several passes.
#: Measured in a Python worker: 0.2 GB for a searcher of 2 million characters, 0.6 GB for one of 8 million.
BLOCK_CHARS = 4_000_000


class Item(NamedTuple):
    item_id: object
    text: str
    budget: int
    pieces: list[tuple[int, str]]


def normalise(text: str) -> str:
    """Lower case, one blank for each run of white space."""
    return " ".join(text.lower().split())


def cut(item_id, text: str) -> Item | None:
    """An item, with a blank at either end, in budget-plus-one pieces of nearly equal length: any match within budget
    edits holds one unchanged."""
    text = normalise(text)
    if not text:
        return None
    budget = int(len(text) * EDIT_SHARE)
    text = f" {text} "
    ends = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return Item(item_id, text, budget, [(a, text[a:b]) for a, b in zip(ends, ends[1:], strict=False)])


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of a pattern of m characters in text, the first of several; None beyond budget.

    Myers' algorithm: a column of the edit table is two bit vectors of its vertical differences, and a character of the
    text costs a few operations on them. The pattern may begin anywhere.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        diagonal = ((eq & up) + up ^ up) | eq
        right, left = down | ~(diagonal | up), up & diagonal
        if right & high:
            score += 1
        elif left & high:
            score -= 1
        right, left = right << 1, left << 1
        up, down = (left | ~(x | right)) & full, right & x & full
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


def searcher(items: list[Item]):
    """A function from a text to its matches: for each item found, (item_id, distance, end in the normalised text)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    holders: dict[str, list[tuple[int, int]]] = {}
    for k, item in enumerate(items):
        for start, piece in item.pieces:
            holders.setdefault(piece, []).append((k, start))
    for piece, held in holders.items():
        machine.add_word(piece, (len(piece), held))
    if holders:
        machine.make_automaton()
    masks = [bit_masks(i.text) for i in items]

    def search(text: str | None) -> list[tuple[object, int, int]]:
        if not text or not holders:
            return []
        text = f" {normalise(text)} "
        found: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for last, (n, held) in machine.iter(text):
            for k, start in held:
                item = items[k]
                begin = last + 1 - n - start
                if found.get(k, (1,))[0] == 0 or (k, begin) in seen:
                    continue
                seen.add((k, begin))
                if item.budget:
                    low = max(0, begin - item.budget)
                    match = best_match(masks[k], len(item.text), text[low : begin + len(item.text) + item.budget], item.budget)
                    match = match and (match[0], match[1] + low)
                else:
                    match = (0, begin + len(item.text))
                if match and (k not in found or match < found[k]):
                    found[k] = match
        # Ends without the blanks: that before the text, and the item's last one where it stands.
        return [(items[k].item_id, d, end - 2) for k, (d, end) in sorted(found.items())]

    return search


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """The distinct items, in blocks whose texts have about BLOCK_CHARS characters together."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).dropna(subset=["t"]).distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        cuts = [cut(r["i"], r["t"]) for r in block.sort("t", "i").toLocalIterator()]
        yield [c for c in cuts if c]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of docs that hold a benchmark item, without the text: the other columns, item_id, distance and end.

    Every item is split into one piece more than the edits it may have (EDIT_SHARE of its characters), all pieces of a
    block of items are searched for at once, and each place that a hit implies is verified by edit distance, so that
    nothing within the budget is missed and nothing beyond it is returned. The blanks at an item's ends are part of it:
    without edits it stands as whole words, and a letter that touches it is an edit like any other. `end` is a position in
    the text in lower case with single blanks. Documents never move: the benchmark is the stated query set, sent out in
    blocks of BLOCK_CHARS.

    Defined cases: null and empty texts hold nothing; null or blank items are never found; items of fewer than
    1 / EDIT_SHARE characters have no edits to spare; ids, of documents and of items, are of any type and may be null; of
    equal items with different ids each is returned, and a repeated document row returns its rows again; a very long text
    is searched whole, in time in proportion to it and its hits; an empty table gives an empty one; columns named item_id,
    distance or end in docs are left out.
    """
    names = [c for c in docs.columns if c not in (text_col, "item_id", "distance", "end")]
    kind = benchmark.schema[item_id_col].dataType
    schema = docs.select(*names).schema.add("item_id", kind).add("distance", "integer").add("end", "long")
    arrow = to_arrow_type(kind)
    found = None
    for items in _blocks(benchmark, item_id_col, item_text_col):

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            look = searcher(items)
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(batch.column(text_col)):
                    for hit in look(text.as_py()):
                        rows.append(i)
                        hits.append(hit)
                kept = batch.select(names).take(pa.array(rows, pa.int64()))
                own = [pa.array([h[j] for h in hits], t) for j, t in enumerate((arrow, pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*kept.columns, *own], [*names, "item_id", "distance", "end"])

        part = docs.select(*names, text_col).mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs in which find_leaks() finds nothing, unchanged."""
    for items in _blocks(benchmark, item_id_col, item_text_col):

        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            look = searcher(items)
            for batch in batches:
                yield batch.filter(pa.array([not look(t.as_py()) for t in batch.column(text_col)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

"""Minimal perfect hashing by recursive splitting (Esposito, Mueller Graf, Vigna: RecSplit, 2020).

Keys fall into buckets by one half of their hash. A bucket of m keys is a tree: an inner node's seed sends the right number
of keys to each child, a leaf's seed sends its keys to different places. The shape of the tree follows from m, so that
only the seeds are stored, as Golomb-Rice codes: the low bits of all nodes in order, then the high parts in unary.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .codecs import U, remap16, remix

MOST_LEAF, MOST_KEYS = 24, (1 << 16) - 1

#: Seeds tried at a time; in all. Equal hashes never part, so the search must end.
TRIED, MOST_TRIED = 512, 1 << 34


def aggregations(leaf: int) -> tuple[int, int]:
    """Keys of the nodes above the leaves, and of those above them: the paper's sizes."""
    first = leaf * max(2, math.ceil(0.35 * leaf + 0.5))
    return first, first * (2 if leaf < 7 else math.ceil(0.21 * leaf + 0.9))


class Shape:
    """The tree of a bucket of m keys: unit, the keys of each child but the last; the children; nodes in all."""

    def __init__(self, m: int, leaf: int):
        first, second = aggregations(leaf)
        if m <= leaf:
            self.unit, sizes = 1, []
            chance = math.factorial(m) / m**m
        else:
            self.unit = -(-((m + 1) // 2) // second) * second if m > second else first if m > first else leaf
            sizes = [self.unit] * ((m - 1) // self.unit)
            sizes.append(m - sum(sizes))
            logs = math.lgamma(m + 1) - sum(math.lgamma(k + 1) - k * math.log(k / m) for k in sizes)
            chance = math.exp(logs)
        self.children = [shape(k, leaf) for k in sizes]
        self.m, self.sizes = m, sizes
        self.wanted = (np.arange(m) // self.unit).astype(U)
        # The paper's parameter for a search that succeeds with this chance at each seed.
        golden = math.log((math.sqrt(5) + 1) / 2)
        self.rice = 0 if chance > 0.999 else max(0, math.ceil(math.log2(golden / -math.log1p(-chance))))
        self.widths = [self.rice, *(w for c in self.children for w in c.widths)]

    def sent(self, x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return remap16(remix(x + seeds), self.m)


@lru_cache(maxsize=4096)
def shape(m: int, leaf: int) -> Shape:
    return Shape(m, leaf)


def split_keys(x: np.ndarray, leaf: int, starts: tuple[int, ...], level: int = 0) -> tuple[list[int], np.ndarray]:
    """(seeds, order) of a bucket's hashes, all different: the seeds of its nodes in order, counted from their level's
    start, and which hash comes to each place."""
    node = shape(len(x), leaf)
    start = starts[level]
    for tried in range(0, MOST_TRIED, TRIED):
        seeds = np.arange(tried, tried + TRIED, dtype=U) + U(start)
        places = node.sent(x[None, :], seeds[:, None])
        fits = np.flatnonzero((np.sort(places // U(node.unit), axis=1) == node.wanted).all(axis=1))
        if len(fits):
            found, places = [tried + int(fits[0])], places[fits[0]]
            break
    else:
        raise ValueError("hashes that no seed parts")
    order = np.argsort(places, kind="stable")
    at = 0
    for size in node.sizes:
        own = order[at : at + size]
        below, inner = split_keys(x[own], leaf, starts, level + 1)
        found += below
        order[at : at + size] = own[inner]
        at += size
    return found, order


def seed_bits(seeds: list[int], m: int, leaf: int) -> np.ndarray:
    """Bits of a bucket's seeds, one in each byte."""
    widths = shape(m, leaf).widths
    low = [s >> b & 1 for s, w in zip(seeds, widths, strict=True) for b in range(w)]
    high = [bit for s, w in zip(seeds, widths, strict=True) for bit in [0] * (s >> w) + [1]]
    return np.array(low + high, np.uint8)


def seeds_of(bits: np.ndarray, m: int, leaf: int) -> list[int]:
    """The seeds of seed_bits()."""
    widths = shape(m, leaf).widths
    fixed = sum(widths)
    ones = np.flatnonzero(bits[fixed:])
    if len(ones) != len(widths):
        raise ValueError("not as many seeds as a bucket of this size has")
    high = np.diff(ones, prepend=-1) - 1
    seeds, at = [], 0
    for w, h in zip(widths, high.tolist(), strict=True):
        seeds.append(h << w | sum(int(bits[at + b]) << b for b in range(w)))
        at += w
    return seeds


def places_of(x: np.ndarray, m: int, seeds: list[int], leaf: int, starts: tuple[int, ...], node: int = 0, level: int = 0) -> np.ndarray:
    """The place in its bucket that each hash is sent to; hashes that aren't of the bucket come to some place too."""
    own = shape(m, leaf)
    found = own.sent(x, np.full(1, seeds[node] + starts[level], U)).astype(np.int64)
    if not own.children:
        return found
    part, node = found // own.unit, node + 1
    for k, child in enumerate(own.children):
        here = np.flatnonzero(part == k)
        if len(here):
            found[here] = k * own.unit + places_of(x[here], child.m, seeds, leaf, starts, node, level + 1)
        node += len(child.widths)
    return found

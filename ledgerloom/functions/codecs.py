"""Hashes and encodings that Spark lacks. Hashes take a batch at a time: array operations run over all its values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

U = np.uint64


class CorruptRlp(ValueError):
    """Bytes that aren't one RLP list."""


def _by_blocks(values: list[bytes | None], size: Callable[[int], int], fill: Callable[[bytes], bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, words) for each number of blocks that occurs: values of as many blocks are one array."""
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(values):
        if x is not None:
            groups.setdefault(size(len(x)), []).append(i)
    return [(np.array(at), np.frombuffer(b"".join(fill(values[i]) for i in at), "<u8").reshape(len(at), -1)) for at in groups.values()]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << U(by) | x >> U(64 - by) if by else x


# Keccak-f[1600] from its definition: rotations and round constants come from the rules of the specification.


def _rotations() -> dict[tuple[int, int], int]:
    found, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        found[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return found


def _round_constants() -> list[int]:
    found, register = [], 1
    for _ in range(24):
        constant = 0
        for j in range(7):
            constant |= (register & 1) << ((1 << j) - 1)
            register <<= 1
            if register & 0x100:
                register ^= 0x171
        found.append(constant)
    return found


ROTATIONS, ROUND_CONSTANTS = _rotations(), _round_constants()
RATE = 136


def keccak_256(values: list[bytes | None]) -> list[bytes | None]:
    """Keccak-256 with its original padding, which differs from SHA-3's. Null stays null."""
    out: list[bytes | None] = [None] * len(values)
    for at, words in _by_blocks(values, lambda n: n // RATE + 1, _keccak_padded):
        a = {(x, y): np.zeros(len(at), U) for x in range(5) for y in range(5)}
        for first in range(0, words.shape[1], RATE // 8):
            for k in range(RATE // 8):
                a[k % 5, k // 5] = a[k % 5, k // 5] ^ words[:, first + k]
            for constant in ROUND_CONSTANTS:
                c = [a[x, 0] ^ a[x, 1] ^ a[x, 2] ^ a[x, 3] ^ a[x, 4] for x in range(5)]
                d = [c[x - 1] ^ _turn(c[(x + 1) % 5], 1) for x in range(5)]
                b = {(y, (2 * x + 3 * y) % 5): _turn(a[x, y] ^ d[x], by) for (x, y), by in ROTATIONS.items()}
                a = {(x, y): b[x, y] ^ (~b[(x + 1) % 5, y] & b[(x + 2) % 5, y]) for x, y in b}
                a[0, 0] = a[0, 0] ^ U(constant)
        digest = np.stack([a[k, 0] for k in range(4)], axis=1).astype("<u8")
        for i, x in zip(at.tolist(), digest, strict=True):
            out[i] = x.tobytes()
    return out


def _keccak_padded(x: bytes) -> bytes:
    padded = bytearray(x + bytes(RATE - len(x) % RATE))
    padded[len(x)] ^= 0x01
    padded[-1] ^= 0x80
    return bytes(padded)


def murmur3_128(values: list[bytes | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of MurmurHash3 x64 128; 0 for null."""
    one, two = U(0x87C37B91114253D5), U(0x4CF5AD432745937F)
    high, low = np.zeros(len(values), U), np.zeros(len(values), U)
    lengths = np.array([len(x or b"") for x in values], U)
    for at, words in _by_blocks(values, lambda n: -(-n // 16), lambda x: x + bytes(-len(x) % 16)):
        length = lengths[at]
        h1 = np.full(len(at), seed, U)
        h2 = h1.copy()
        for k in range(0, words.shape[1], 2):
            whole = length >= U(8 * k + 16)
            k1 = _turn(words[:, k] * one, 31) * two
            k2 = _turn(words[:, k + 1] * two, 33) * one
            h1, h2 = h1 ^ k1, np.where(whole, h2, h2 ^ k2)
            h1 = np.where(whole, (_turn(h1, 27) + h2) * U(5) + U(0x52DCE729), h1)
            h2 = np.where(whole, (_turn(h2 ^ k2, 31) + h1) * U(5) + U(0x38495AB5), h2)
        h1, h2 = h1 ^ length, h2 ^ length
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = (_finished(x) for x in (h1, h2))
        h1 = h1 + h2
        high[at], low[at] = h1, h2 + h1
    return high, low


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(33)) * U(0xFF51AFD7ED558CCD)
    x = (x ^ x >> U(33)) * U(0xC4CEB9FE1A85EC53)
    return x ^ x >> U(33)


def remix(x: np.ndarray) -> np.ndarray:
    """Stafford's thirteenth variant of the 64-bit finaliser."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def remap(x: np.ndarray, n: int) -> np.ndarray:
    """floor(x * n / 2^64) for n below 2^32, by halves."""
    x_low, x_high = x & U(0xFFFFFFFF), x >> U(32)
    return (x_high * U(n) + (x_low * U(n) >> U(32))) >> U(32)


def remap16(x: np.ndarray, n: int) -> np.ndarray:
    """Of the low 48 bits, floor(x * n / 2^48) for n below 2^16."""
    return (x & U((1 << 48) - 1)) * U(n) >> U(48)


# RLP


def _byte(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2, "0"))


def _prefixed(content: Column, base: int) -> Column:
    n = F.octet_length(content)
    spelled = F.hex(n.cast("long"))
    spelled = F.unhex(F.when(F.length(spelled) % 2 == 1, F.concat(F.lit("0"), spelled)).otherwise(spelled))
    return F.when(n < 56, F.concat(_byte(n + base), content)).otherwise(F.concat(_byte(F.octet_length(spelled) + base + 55), spelled, content))


def rlp_item(x: Column) -> Column:
    """A byte string: itself if it is one byte below 0x80, else with its length before it. Null stays null."""
    return F.when((F.octet_length(x) == 1) & (F.hex(x) < "80"), x).otherwise(_prefixed(x, 0x80))


def rlp_integer(x: Column) -> Column:
    """A non-negative integer: big-endian without leading zeros, so 0 is the empty string."""
    spelled = F.hex(x.cast("long"))
    return rlp_item(F.when(x == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.when(F.length(spelled) % 2 == 1, F.concat(F.lit("0"), spelled)).otherwise(spelled))))


def rlp_list(*items: Column) -> Column:
    """The list of encoded items."""
    return _prefixed(F.concat(*items), 0xC0)


def rlp_split(data: bytes) -> list[bytes]:
    """The contents of a list's items; nested lists stay encoded. Takes no spelling but the shortest."""
    if not data:
        raise CorruptRlp("no bytes")
    at, end, is_list = _rlp_span(data, 0, len(data))
    if not is_list or end != len(data):
        raise CorruptRlp("not one list")
    found = []
    while at < end:
        begin, stop, nested = _rlp_span(data, at, end)
        found.append(data[at:stop] if nested else data[begin:stop])
        at = stop
    return found


def _rlp_span(data: bytes, at: int, end: int) -> tuple[int, int, bool]:
    """Where an item's content begins and ends; whether it is a list."""
    head = data[at]
    if head < 0x80:
        return at, at + 1, False
    is_list, n = head >= 0xC0, (head - 0x80) % 0x40
    begin = at + 1
    if n > 55:
        begin += n - 55
        spelled = data[at + 1 : begin]
        n = int.from_bytes(spelled)
        if begin > end or n < 56 or spelled[0] == 0:
            raise CorruptRlp("length not spelled in the shortest way")
    if begin + n > end:
        raise CorruptRlp("item beyond the end")
    if not is_list and n == 1 and data[begin] < 0x80:
        raise CorruptRlp("byte not spelled in the shortest way")
    return begin, begin + n, is_list


# Golomb-Rice: quotients in unary, rests in so many bits, lowest bit first.


def golomb_rice_encode(values: list[int], bits: int) -> bytes:
    """All rests, then all quotients: a one after so many zeros."""
    total, at = 0, 0
    for x in values:
        total |= (x & (1 << bits) - 1) << at
        at += bits
    for x in values:
        at += x >> bits
        total |= 1 << at
        at += 1
    return total.to_bytes(-(-at // 8), "little")


def golomb_rice_decode(data: bytes, bits: int, n: int) -> list[int]:
    total = int.from_bytes(data, "little")
    rests = [total >> i * bits & (1 << bits) - 1 for i in range(n)]
    total >>= n * bits
    found = []
    for rest in rests:
        if not total:
            raise ValueError("fewer values than asked for")
        zeros = (total & -total).bit_length() - 1
        found.append(zeros << bits | rest)
        total >>= zeros + 1
    return found


# As column functions


@F.pandas_udf(BinaryType())
def keccak256(x: pd.Series) -> pd.Series:
    return pd.Series(keccak_256(x.tolist()), dtype=object)


@F.pandas_udf(ArrayType(BinaryType()))
def rlp_items(x: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else rlp_split(b) for b in x], dtype=object)


def murmur_bucket(x: Column, buckets: int, seed: int = 0) -> Column:
    """The bucket that the first half of the hash falls into."""

    @F.pandas_udf("long")
    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(remap(murmur3_128(values.tolist(), seed)[0], buckets).astype(np.int64))

    return bucket(x)


# Transactions in their envelopes (EIP-2718): a list, or a type byte and a list, or either as an RLP string.

# The fields of each type, in order.
LEGACY = ("nonce", "gas_price", "gas", "to", "value", "data", "v", "r", "s")
TYPED = {
    1: ("chain_id", "nonce", "gas_price", "gas", "to", "value", "data", "access_list", "v", "r", "s"),
    2: ("chain_id", "nonce", "tip", "gas_price", "gas", "to", "value", "data", "access_list", "v", "r", "s"),
    3: ("chain_id", "nonce", "tip", "gas_price", "gas", "to", "value", "data", "access_list", "blob_fee", "blob_hashes", "v", "r", "s"),
    4: ("chain_id", "nonce", "tip", "gas_price", "gas", "to", "value", "data", "access_list", "authorizations", "v", "r", "s"),
}
LISTS = ("access_list", "blob_hashes", "authorizations")
#: Numbers of up to 256 bits stay bytes, big-endian.
TRANSACTION = StructType([StructField("type", IntegerType()), *(StructField(n, LongType()) for n in ("chain_id", "nonce", "gas")), *(StructField(n, BinaryType()) for n in ("to", "value", "gas_price", "tip", "data", "v", "r", "s"))])


class UnknownTransaction(ValueError):
    """A transaction of a type that isn't known."""


def transaction(data: bytes) -> dict[str, object]:
    """The fields of TRANSACTION; tip and chain_id are None where the type has none. A legacy signature names its chain in
    v, if that is 35 or more (EIP-155)."""
    if data and 0x80 <= data[0] < 0xC0:
        begin, end, _ = _rlp_span(data, 0, len(data))
        if end != len(data):
            raise CorruptRlp("bytes after the transaction")
        data = data[begin:end]
    if not data:
        raise CorruptRlp("no bytes")
    kind = 0 if data[0] >= 0xC0 else data[0]
    if kind and kind not in TYPED:
        raise UnknownTransaction(f"type {kind}")
    names = TYPED.get(kind, LEGACY)
    items = rlp_split(data[1:] if kind else data)
    if len(items) != len(names):
        raise CorruptRlp(f"{len(items)} fields, not {len(names)}")
    found: dict[str, object] = dict(zip(names, items, strict=True))
    for name in LISTS:
        if name in found:
            rlp_split(found[name])
    if len(found["to"]) not in (0, 20):
        raise CorruptRlp("an address of other than 20 bytes")
    for name in set(names) - {"to", "data", *LISTS}:
        if found[name][:1] == b"\0" or len(found[name]) > 32:
            raise CorruptRlp("a number not spelled in the shortest way")
    for name in ("nonce", "gas", "chain_id"):
        if len(found.get(name, b"")) > 8 or (number := int.from_bytes(found.get(name, b""))) >= 1 << 63:
            raise CorruptRlp("a number that is too large")
        found[name] = number if name in names else None
    v = int.from_bytes(found["v"])
    if not kind and v >= 35 and (v - 35) // 2 < 1 << 63:
        found["chain_id"] = (v - 35) // 2
    return {"type": kind, "tip": None, **found}


@F.pandas_udf(TRANSACTION)
def transactions(x: pd.Series) -> pd.DataFrame:
    """Decoded transactions; an undecodable one is an error, null stays null in every field."""
    names = TRANSACTION.names
    rows = [dict.fromkeys(names) if b is None else transaction(bytes(b)) for b in x]
    found = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})
    return found.astype({"type": "Int32", "chain_id": "Int64", "nonce": "Int64", "gas": "Int64"})

"""Scalar functions over integers, bytes and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compression flags: bit 1 for keys, bit 2 for values.
FLAGS = {0: "none", 1: "k", 2: "v", 3: "kv"}


def bit_length(x: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def uvarint_length(x: Column) -> Column:
    """Bytes of a LEB128 varint: seven bits each, one at least."""
    return F.greatest(F.lit(1), F.ceil(bit_length(x) / 7).cast("int"))


def uvarint_hex(x: Column) -> Column:
    """The varint in hexadecimal: low groups first, the high bit on all but the last."""
    n = uvarint_length(x)
    byte = lambda i: F.pmod(F.floor(x / F.pow(F.lit(128), i)), F.lit(128)).cast("int") + F.when(i < n - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.lower(F.hex(byte(i))), 2, "0")), "")


def reverse_bits(x: Column) -> Column:
    """The 64 bits in reverse, as a string of bits."""
    return F.reverse(F.lpad(F.bin(x), 64, "0"))


def be_u64(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def inverted_step(step: Column) -> Column:
    """Big-endian bytes of the inverted step: ascending bytes are descending steps."""
    return be_u64(F.bitwise_not(step.cast("long")))


def bytes_per_record(largest: Column) -> Column:
    return F.ceil(bit_length(largest) / 8).cast("int")


def compression_flag(flags: Column) -> Column:
    known = F.lit(None)
    for bits, name in FLAGS.items():
        known = F.when(flags == bits, name).otherwise(known)
    return F.when(flags.between(0, 3), known).otherwise(F.raise_error(F.lit("unknown compression flag")))


def file_name(start: Column, end: Column, kind: Column, extension: str = "seg") -> Column:
    return F.format_string(f"v1-%06d-%06d-%s.{extension}", (start / 1000).cast("int"), (end / 1000).cast("int"), kind)


def key_string(key: Column) -> Column:
    """How a progress report shows a key: its first four bytes, or less if it is shorter; whole if it has eight or more
    and begins with four zero bytes; null is `final`."""
    text = F.lower(F.hex(key))
    whole = (F.octet_length(key) >= 8) & text.startswith("00000000")
    return F.coalesce(F.when(whole, text).otherwise(F.substring(text, 1, 8)), F.lit("final"))


def next_key(key: Column) -> Column:
    """The next byte string of the same length in order; an error for an empty one and for the last. Null stays null."""
    spelled = F.hex(key)
    head = F.regexp_replace(spelled, "(FF)+$", "")  # an even number of digits, so whole bytes
    n = F.length(head)
    raised = F.lpad(F.hex(F.conv(F.right(head, F.lit(2)), 16, 10).cast("long") + 1), 2, "0")
    rest = F.repeat(F.lit("00"), ((F.length(spelled) - n) / 2).cast("int"))
    found = F.when(n > 0, F.unhex(F.concat(F.substring(head, F.lit(1), n - 2), raised, rest)))
    return F.when(F.octet_length(key) == 0, F.raise_error(F.lit("next key of the empty key"))).when(n == 0, F.raise_error(F.lit("next key overflows"))).otherwise(found)


def split_parameters(m: Column, leaf: int, first: int, second: int) -> Column:
    """struct(fanout, unit): how a group of m keys is divided further. Above the second bound in two, the left part a
    multiple of that bound; above the first in parts of its size; else in leaves."""
    parts = lambda n, size: F.ceil(n / size).cast("int")
    halves = F.struct(F.lit(2).alias("fanout"), (parts(F.ceil(m / 2), second) * second).alias("unit"))
    groups = lambda size: F.struct(parts(m, size).alias("fanout"), F.lit(size).alias("unit"))
    return F.when(m > second, halves).when(m > first, groups(first)).otherwise(groups(leaf))

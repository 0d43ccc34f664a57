import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import codecs, scalars


def spelled(x: bytes, base: int = 0x80) -> bytes:
    if base == 0x80 and len(x) == 1 and x[0] < 0x80:
        return x
    if len(x) < 56:
        return bytes([base + len(x)]) + x
    n = len(x).to_bytes(-(-len(x).bit_length() // 8))
    return bytes([base + 55 + len(n)]) + n + x


def test_keccak_known_values():
    found = codecs.keccak_256([b"", None, b"abc", b"x" * 135, b"x" * 136, b"abc"])
    assert found[0].hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert found[2].hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert found[1] is None and found[5] == found[2] and len(set(found)) == 5


def test_murmur_known_values():
    high, low = codecs.murmur3_128([b"hello", b"", b"The quick brown fox jumps over the lazy dog", None])
    found = [f"{a:016x}{b:016x}" for a, b in zip(high, low, strict=True)]
    assert found == ["cbd8a7b341bd9b025b1e906a48ae1d19", "0" * 32, "e34bbc7bbc071b6c7a433ca9c49a9347", "0" * 32]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.integers(1, 2**16 - 1))
def test_ranges(values, n):
    import numpy as np

    x = np.array(values, np.uint64)
    assert codecs.remap(x, n).tolist() == [v * n >> 64 for v in values]
    assert codecs.remap16(x, n).tolist() == [(v & (1 << 48) - 1) * n >> 48 for v in values]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=60), st.integers(0, 10))
def test_golomb_rice_round_trip(values, bits):
    assert codecs.golomb_rice_decode(codecs.golomb_rice_encode(values, bits), bits, len(values)) == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=8))
def test_rlp_split(items):
    assert codecs.rlp_split(spelled(b"".join(map(spelled, items)), 0xC0)) == items


@pytest.mark.parametrize("data", [b"", b"\x80", b"\xc1", b"\xc2\x81\x05", b"\xc0\x00", b"\xf8\x01\x05"])
def test_corrupt_rlp(data):
    with pytest.raises(codecs.CorruptRlp):
        codecs.rlp_split(data)


def test_rlp_columns(spark):
    rows = [(b"", 0), (b"\x05", 127), (b"\x80", 128), (b"a" * 55, 255), (b"a" * 56, 256), (b"a" * 300, 2**62)]
    df = spark.createDataFrame(rows, "x binary, n long").select("x", "n", codecs.rlp_list(codecs.rlp_item(F.col("x")), codecs.rlp_integer(F.col("n"))).alias("rlp"))
    for r in df.withColumn("items", codecs.rlp_items("rlp")).collect():
        n = r.n.to_bytes(-(-r.n.bit_length() // 8))
        assert bytes(r.rlp) == spelled(spelled(bytes(r.x)) + spelled(n), 0xC0)
        assert [bytes(i) for i in r["items"]] == [bytes(r.x), n]


def test_next_key(spark):
    rows = [(b"\x01\x01",), (b"\x01\xff",), (b"\x0f\xff\xff",), (None,)]
    found = spark.createDataFrame(rows, "k binary").select(scalars.next_key(F.col("k")).alias("n")).collect()
    assert [r.n and bytes(r.n) for r in found] == [b"\x01\x02", b"\x02\x00", b"\x10\x00\x00", None]
    for last, said in ((b"", "empty key"), (b"\xff\xff", "overflows")):
        with pytest.raises(Exception, match=said):
            spark.createDataFrame([(last,)], "k binary").select(scalars.next_key(F.col("k"))).collect()

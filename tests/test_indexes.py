import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions import codecs, perfect
from ledgerloom.operators import temporal
from ledgerloom.sources import domains, indexes
from ledgerloom.sources.words import CorruptFile


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(max_size=20), max_size=400), st.integers(1, 300), st.integers(1, 9), st.sampled_from([0, 1, 3]), st.integers(0, 2**32 - 1))
def test_every_key_has_its_place(keys, bucket, leaf, features, salt):
    keys = sorted(keys)
    offsets = [13 * i for i in range(len(keys))]
    index = indexes.Index(indexes.write_index(keys, offsets, 100, bucket, leaf, salt, features))
    known, ordinal, offset = index.find(keys)
    assert known.all() and offset.tolist() == offsets
    assert ordinal.tolist() == ([100 + i for i in range(len(keys))] if features & indexes.ORDINALS else [-1] * len(keys))


def test_seeds_take_less_than_two_bits_a_key():
    index = indexes.Index(indexes.write_index([f"{i}".encode() for i in range(5000)], list(range(5000))))
    assert index.sizes["seeds"] * 8 < 2 * 5000
    strange, _, _ = index.find([f"no {i}".encode() for i in range(5000)])
    assert 0 < strange.mean() < 0.01


@pytest.mark.parametrize("m", [1, 2, 8, 9, 48, 49, 240, 241, 1000])
def test_shapes_hold_all_keys(m):
    shape = perfect.shape(m, 8)
    assert sum(shape.sizes) == (m if m > 8 else 0) and all(shape.sizes)
    assert len(shape.widths) == 1 + sum(len(c.widths) for c in shape.children)
    seeds = [k * 37 % 1000 for k in range(len(shape.widths))]
    assert perfect.seeds_of(perfect.seed_bits(seeds, m, 8), m, 8) == seeds


def test_equal_keys_are_an_error():
    with pytest.raises(indexes.DuplicateKey, match="b'x'"):
        indexes.write_index([b"x", b"y", b"x"], [0, 1, 2])


def test_leaves_too_large_are_an_error():
    with pytest.raises(ValueError, match="leaves of 64"):
        indexes.write_index([b"x"], [0], leaf=64)


def test_corrupt_and_strange_indexes():
    keys = [f"k{i}".encode() for i in range(300)]
    data = indexes.write_index(keys, list(range(300)))
    for cut in (0, 5, 30, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            indexes.Index(data[:cut])
    with pytest.raises(CorruptFile):
        indexes.Index(data + b"x")
    at = indexes.HEAD.size + 300 * 2 + indexes.SIZES.size + 1 + 8 * indexes.LEVELS
    assert data[at] == indexes.ORDINALS | indexes.CHECKED
    with pytest.raises(indexes.IncompatibleIndex, match="unknown features"):
        indexes.Index(data[:at] + b"\x07" + data[at + 1 :])
    one = indexes.ef_size(data[at + 1 :])
    wrong = data[: at + 1 + one] + struct.pack(">Q", 299) + data[at + 9 + one :]
    with pytest.raises(indexes.IncompatibleIndex, match="299 checks for 300 keys"):
        indexes.Index(wrong)


def test_lookups_of_null_and_unknown(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytes([i, i]), i * 5) for i in range(200)] + [("b", b"z", 0)], "file string, key binary, offset long")
    files = indexes.index_files(rows)
    probes = spark.createDataFrame([("a", b"\x03\x03"), ("a", b"\x03\x03"), ("a", None), ("b", b"z"), ("c", b"z"), (None, b"z")], "file string, key binary")
    for shares in (1, 8):
        got = sorted(((r["file"], r["key"] and bytes(r["key"]), r["known"], r["ordinal"], r["offset"]) for r in indexes.find(files, probes, shares=shares).collect()), key=repr)
        assert got == sorted([("a", b"\x03\x03", True, 3, 15)] * 2 + [("a", None, False, None, None), ("b", b"z", True, 0, 0), ("c", b"z", False, None, None), (None, b"z", False, None, None)], key=repr)
    assert indexes.find(files.limit(0), probes).where("known").count() == 0 and indexes.find(files, probes.limit(0)).count() == 0
    for r in files.collect():
        (tmp_path / f"{r['file']}.idx").write_bytes(bytes(r["content"]))
    assert sorted(r["n_keys"] for r in indexes.open_indexes(indexes.read_indexes(spark, str(tmp_path))).collect()) == [1, 200]


def rlp(x):
    if isinstance(x, list):
        body = b"".join(map(rlp, x))
        return bytes([0xC0 + len(body)]) + body if len(body) < 56 else bytes([0xF8, len(body)]) + body
    if isinstance(x, int):
        x = x.to_bytes(-(-x.bit_length() // 8))
    return x if len(x) == 1 and x[0] < 0x80 else bytes([0x80 + len(x)]) + x


TO = bytes(range(20))


def test_transactions_of_all_types():
    legacy = codecs.transaction(rlp([9, 20, 21000, TO, 10**18, b"", 37, 5, 6]))
    assert legacy["type"] == 0 and legacy["chain_id"] == 1 and legacy["nonce"] == 9 and legacy["value"] == (10**18).to_bytes(8) and legacy["tip"] is None
    assert codecs.transaction(rlp([9, 20, 21000, b"", 0, b"hi", 27, 5, 6]))["chain_id"] is None
    access = [[TO, [bytes(32)]]]
    fields = {1: [1, 2, 3, 4, TO, 5, b"x", access, 0, 8, 9], 2: [1, 2, 3, 4, 5, TO, 5, b"x", access, 0, 8, 9], 3: [1, 2, 3, 4, 5, TO, 5, b"x", [], 7, [], 0, 8, 9], 4: [1, 2, 3, 4, 5, TO, 5, b"x", [], [], 0, 8, 9]}
    for kind, items in fields.items():
        data = bytes([kind]) + rlp(items)
        for spelled in (data, bytes([0x80 + len(data)]) + data if len(data) < 56 else bytes([0xB8, len(data)]) + data):
            t = codecs.transaction(spelled)
            assert (t["type"], t["chain_id"], t["nonce"], t["to"], t["data"], t["r"]) == (kind, 1, 2, TO, b"x", b"\x08")


@pytest.mark.parametrize("data", [b"", b"\x05\xc0", b"\x01\xc0", b"\x02", rlp([9, 20, 21000, TO[:19], 1, b"", 37, 5, 6]), rlp([b"\0", 20, 21000, TO, 1, b"", 37, 5, 6]), rlp([2**63, 20, 21000, TO, 1, b"", 37, 5, 6]), b"\x01" + rlp([1, 2, 3, 4, TO, 5, b"x", b"no list", 0, 8, 9])])
def test_corrupt_transactions(data):
    with pytest.raises(ValueError):
        codecs.transaction(data)


def test_null_transactions_stay_null(spark):
    (got,) = spark.createDataFrame([(None,)], "x binary").select(codecs.transactions("x").alias("t")).select("t.*").collect()
    assert set(got) == {None}


def test_pruning_goes_on_where_it_stopped(spark):
    changes = spark.createDataFrame([(k, 10 * s + k, s, "v") for k in range(7) for s in range(5) if (k + s) % 3], "key long, tx long, step long, value string")
    everything, none = temporal.prune(changes, 3)
    assert none is None
    left, resume, runs = changes, None, []
    while True:
        taken, resume = temporal.prune(left, 3, 4, resume)
        runs.append([(r["key"], r["step"]) for r in taken.collect()])
        left = left.join(spark.createDataFrame(runs[-1] or [(-1, -1)], "key long, step long"), ["key", "step"], "left_anti").select(*changes.columns)
        if resume is None:
            break
    assert all(len(r) == 4 for r in runs[:-1]) and sorted(sum(runs, [])) == sorted((r["key"], r["step"]) for r in everything.collect())
    assert left.where("step <= 3").count() == 0 and temporal.prune(changes.limit(0), 3, 4)[1] is None


def test_built_files_are_written_once_and_registered(spark, tmp_path):
    changes = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b"), (2, 3, 0, ""), (1, 11, 1, "c"), (1, 31, 3, "d")], "key long, tx long, step long, value string")
    built = domains.build_files(changes, "things", 0, 3, str(tmp_path / "files"))
    manifest = {r["file"]: (r["start"], r["end"], r["n_keys"], r["n_words"]) for r in built.manifest.collect()}
    assert manifest == {"v1-things.0-1.kv": (0, 1, 2, 4), "v1-things.1-2.kv": (1, 2, 1, 2)}
    old = built.manifest.where("start = 0")
    assert domains.integrate(old, built.manifest).count() == 2 and domains.integrate(built.manifest, built.manifest).count() == 2
    probes = spark.createDataFrame([(f, k) for f in [*manifest, "v1-things.3-4.kv"] for k in (1, 2, 3)], "file string, key long")
    assert sorted((r["start"], r["key"], r["value"]) for r in domains.get(built, probes).collect()) == [(0, 1, "b"), (0, 2, ""), (1, 1, "c")]

import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import dictionary, etl, lookup, positions, predicates, succinct, temporal
from ledgerloom.sources import segments
from ledgerloom.sources import words as files
from ledgerloom.streaming import hot_store

SEQUENCE = [2, 3, 3, 7, 12, 20, 21, 33, 50, 50, 71, 90]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=300), st.booleans()), max_size=60))
def test_word_file_round_trip(words):
    assert [(w, c) for _, _, w, c in files.decode(files.encode(words))] == words


@pytest.mark.parametrize("data", [b"", b"short", files.encode([(b"word", True)])[:-1], files.encode([(b"", True)]) + b"x"])
def test_corrupt_files(data):
    with pytest.raises(files.CorruptFile):
        list(files.decode(data))


def test_seek(spark):
    values = spark.createDataFrame([(0, i, x) for i, x in enumerate(SEQUENCE)], "seq int, i long, value long")
    probes = spark.createDataFrame([(0, x) for x in (33, 0, 11, 100)], "seq int, x long")
    assert {r["x"]: r["found"] for r in succinct.seek(values, probes, ["seq"]).collect()} == {33: 33, 0: 2, 11: 12, 100: None}
    assert {r["x"]: r["found"] for r in succinct.seek(values, probes, ["seq"], True).collect()} == {33: 33, 0: None, 11: 7, 100: 90}


def test_predicates(spark):
    df = spark.createDataFrame([(b"",), (b"tide",), (b"tidetable",), (None,)], "w binary")
    got = df.select(
        predicates.match_prefix(F.col("w"), F.lit(b"tide")).alias("p"),
        predicates.match_prefix_raw(F.col("w"), F.lit(b"tide")).alias("r"),
        predicates.match_cmp(F.lit(b"tide"), F.col("w")).alias("c"),
        predicates.match_cmp_raw(F.lit(b""), F.col("w")).alias("e"),
    ).collect()
    assert [tuple(r) for r in got[:3]] == [(False, True, 1, -1), (True, True, 0, -1), (True, True, -1, -1)]


def test_match_cmp_is_antisymmetric(spark):
    rng = random.Random(1)
    words = [rng.randbytes(rng.randrange(4)) for _ in range(60)]
    df = spark.createDataFrame([(a, b) for a in words[:20] for b in words], "a binary, b binary")
    for r in df.withColumn("x", predicates.match_cmp(F.col("a"), F.col("b"))).withColumn("y", predicates.match_cmp(F.col("b"), F.col("a"))).collect():
        a, b = bytes(r["a"]), bytes(r["b"])
        assert r["x"] == -r["y"] == (a > b) - (a < b)


def test_uvarint(spark):
    xs = [0, 1, 127, 128, 300, 16383, 16384, 2**40]
    df = spark.createDataFrame([(x,) for x in xs], "x long").select("x", scalars.uvarint_length(F.col("x")).alias("n"), scalars.uvarint_hex(F.col("x")).alias("h"))
    for r in df.collect():
        assert r["h"] == files.put_uvarint(r["x"]).hex() and r["n"] == len(r["h"]) // 2
        assert files.get_uvarint(bytes.fromhex(r["h"]), 0) == (r["x"], r["n"])


def test_forward_asof(spark):
    rng = random.Random(2)
    keys, probes = sorted(rng.sample(range(50_000), 40)), [rng.randrange(60_000) for _ in range(200)]
    table = spark.createDataFrame([(k, k * 2) for k in keys], "k long, v long")
    got = lookup.forward_asof(spark.createDataFrame([(p,) for p in probes], "p long"), table, "p", "k", "v").collect()
    assert sorted((r["p"], r["v"] or -1) for r in got) == sorted((p, next((k * 2 for k in keys if k >= p), -1)) for p in probes)


def test_duplicate_key_is_an_error(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 5)], "key string, ordinal long, offset long")
    with pytest.raises(Exception, match="duplicate key"):
        lookup.build_index(df, "key").collect()


def test_code_lengths_are_a_full_tree():
    depth = dictionary.code_lengths({"a": 5, "b": 2, "c": 1, "d": 1})
    assert depth == {"a": 1, "b": 2, "c": 3, "d": 3}
    assert dictionary.code_lengths({"x": 9}) == {"x": 0}


def test_cover_prefers_what_saves_most():
    assert dictionary.cover(b"seasidetide", {b"seaside": 1, b"sidetide": 1, b"seasidetide": 1}) == [(0, b"seasidetide")]
    assert dictionary.cover(b"abc", {b"abc": 100}) == []


def test_positions_of_every_match_are_counted(spark):
    rng = random.Random(3)
    patterns = {bytes(rng.choice(b"ab") for _ in range(n)): n % 3 for n in [5, 5, 5, 6, 7, 7, 8, 11]}
    texts = [bytes(rng.choice(b"aabbc") for _ in range(n)) for n in (0, 3, 5, 40, 400, 3000)]
    expected = collections.Counter()
    for t in texts:
        last = 0
        expected[len(t) + 1] += 1
        expected[0] += 1
        for at, _ in dictionary.cover(t, patterns):
            expected[at - last + 1] += 1
            last = at
    got = dictionary.position_uses(spark.createDataFrame([(t,) for t in texts], "word binary"), "word", patterns).collect()
    assert {r["pos"]: r["uses"] for r in got} == expected
    assert sum(expected.values()) > 100 + 2 * len(texts)


def test_pieces_come_from_anywhere_in_the_words(spark):
    words = {"seasidetide": 3, "xsidetidex": 4, "abc": 9, "": 1}
    expected = collections.Counter()
    for w, score in words.items():
        for i in range(len(w)):
            for k in range(i + 5, len(w) + 1):
                expected[w[i:k]] += score * (k - i)
    got = dictionary.pieces(spark.createDataFrame(list(words.items()), "word string, score long")).collect()
    assert {r["word"]: r["score"] for r in got} == expected


WORDS = [b"", b"a plain word", b"tide and time and tide and time", b"\x00\xff", b"time and tide " * 40, b"", bytes(range(256)), b"tide"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(WORDS), st.binary(max_size=60), st.text("ab ", max_size=200).map(str.encode)), st.booleans()), max_size=40))
def test_segment_round_trip(words):
    s = segments.Segment(segments.encode_segment(words))
    assert (s.count, s.empty) == (len(words), sum(not w for w, _ in words))
    assert [w for *_, w in s.words()] == [w for w, _ in words]
    assert [(i, at, n) for i, at, n, _ in s.words(decode=False)] == [(i, at, n) for i, at, n, _ in s.words()]


def test_segments_get_smaller_by_their_dictionary():
    words = [(f"entry {k} of the harbour register, signed by the harbour master".encode(), True) for k in range(500)]
    packed = segments.encode_segment(words)
    assert len(packed) < len(files.simple_encode([w for w, _ in words])) / 2
    assert len(segments.Segment(packed).patterns.leaves) > 3
    assert len(segments.encode_segment([(w, False) for w, _ in words])) > len(packed) * 2


def test_words_of_one_symbol_and_none():
    assert list(segments.Segment(segments.encode_segment([])).words()) == []
    assert [w for *_, w in segments.Segment(segments.encode_segment([(b"", True)] * 5)).words()] == [b""] * 5
    assert [w for *_, w in segments.Segment(segments.encode_segment([(b"tide!tide!", True)], {b"tide!": 1})).words()] == [b"tide!tide!"]


def a_segment(patterns=b"", positions=b"", body=b"", words=1):
    return words.to_bytes(8) + bytes(8) + len(patterns).to_bytes(8) + patterns + len(positions).to_bytes(8) + positions + body


@pytest.mark.parametrize(
    "data",
    [b"", bytes(31), (1).to_bytes(8) + bytes(8) + (99).to_bytes(8) + bytes(16), a_segment(bytes([51, 1, 65])), a_segment(b"", bytes([51, 1])), a_segment(bytes([1, 1, 65])), a_segment(bytes([0, 9, 65])), a_segment(b"", b"", b"left over", 0), a_segment(b"", bytes([1, 0, 2, 3]))],
)
def test_corrupt_segments(spark, data):
    with pytest.raises(files.CorruptFile):
        segments.Segment(data)
    good = segments.encode_segment([(b"word", True)])
    rows = segments.open_segments(spark.createDataFrame([("bad", data), ("good", good)], "file string, content binary"), strict=False).collect()
    assert {r["file"]: (r["n_words"], r["corrupt"] is None) for r in rows} == {"bad": (None, False), "good": (1, True)}


def test_cut_segments_are_errors():
    data = segments.encode_segment([(b"some word that is long", True), (b"another", False)])
    for n in range(32, len(data)):
        with pytest.raises(files.CorruptFile):
            list(segments.Segment(data[:n]).words())


def test_files_on_disk(spark, tmp_path):
    words = [(w, i % 2 == 0) for i, w in enumerate(WORDS)]
    (tmp_path / "w").mkdir()
    (tmp_path / "s").mkdir()
    (tmp_path / "w" / "one").write_bytes(files.encode(words))
    (tmp_path / "w" / "bad").write_bytes(b"short")
    (tmp_path / "s" / "one").write_bytes(segments.encode_segment(words))
    got = files.read_word_files(spark, str(tmp_path / "w"), strict=False).orderBy("ordinal").collect()
    assert [(bytes(r["word"]), r["compressed"]) for r in got] == words
    assert [bytes(r["word"]) for r in segments.read_segments(spark, str(tmp_path / "s")).orderBy("ordinal").collect()] == WORDS
    assert list(files.simple_decode(files.simple_encode(WORDS))) == list(enumerate(WORDS))
    with pytest.raises(files.CorruptFile):
        list(files.simple_decode(files.simple_encode(WORDS)[:-1]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=700).map(sorted))
def test_stored_sequences(values):
    data = succinct.ef_bytes(values)
    assert succinct.ef_values(data).tolist() == values
    assert (int.from_bytes(data[:8]), int.from_bytes(data[8:16])) == (len(values) - 1, values[-1] + 1)
    with pytest.raises(succinct.CorruptSequence):
        succinct.ef_values(data[:-1])


def test_directory_of_a_stored_sequence():
    """Every 2^14th value's place in the upper bits, and every 2^8th's distance from it."""
    values = [7 * i + i * i // 5000 for i in range(40_000)]
    data = succinct.ef_bytes(values)
    width, lower, upper, directory = succinct._layout(len(values), values[-1] + 1)
    words = [int.from_bytes(data[16 + 8 * k : 24 + 8 * k], "little") for k in range(lower + upper, lower + upper + directory)]
    high = [(v >> width) + i for i, v in enumerate(values)]
    for i in range(0, len(values), 256):
        first = i // 16384
        assert words[first * 33] == high[first * 16384]
        half = words[first * 33 + 1 + i % 16384 // 256 // 2] >> 32 * (i // 256 % 2) & 0xFFFFFFFF
        assert half == high[i] - high[first * 16384]
    assert succinct.ef_values(data).tolist() == values


def test_superstrings_are_filled_one_after_another(spark):
    rng = random.Random(4)
    lengths = [rng.choice([0, 1, 5, 30, 49, 50, 200]) for _ in range(500)]
    for limit in (100, 10_000, 10**9):
        expected, number, size = [], 0, 0
        for n in lengths:
            if size + 2 * n + 2 > limit:
                number, size = number + 1, 0
            size += 2 * n + 2
            expected.append((number, number % 4 == 0))
        words = spark.createDataFrame(list(enumerate(lengths)), "ordinal long, length long").repartition(5)
        got = dictionary.superstrings(words, limit, 4).orderBy("ordinal").collect()
        assert [(r["superstring"], r["sampled"]) for r in got] == expected


def test_key_strings(spark):
    keys = ["", "00", "0102", "00000001", "01020304", "0001020304", "0000000001020304", "000000000000000a0b", "0102030405060708", "00000000010203"]
    shown = ["", "00", "0102", "00000001", "01020304", "00010203", "0000000001020304", "000000000000000a0b", "01020304", "00000000"]
    df = spark.createDataFrame([(i, bytes.fromhex(k)) for i, k in enumerate(keys)] + [(len(keys), None)], "i int, k binary")
    assert [r["s"] for r in df.orderBy("i").select(scalars.key_string(F.col("k")).alias("s")).collect()] == [*shown, "final"]


def test_ancestors_off_the_chain(spark):
    rows = [(n, f"c{n}", f"c{n - 1}", True) for n in range(10)] + [(5, "s5", "c4", False), (6, "s6", "s5", False), (7, "s7", "s6", False)]
    headers = spark.createDataFrame(rows, "number long, hash string, parent_hash string, canonical boolean")
    probes = spark.createDataFrame([(7, "s7", 0), (7, "s7", 1), (7, "s7", 2), (7, "s7", 3), (7, "s7", 5), (7, "c7", 5), (7, "s7", 8), (3, "none", 1), (3, "c3", 3)], "number long, hash string, distance long")
    expected = {("s7", 0): "s7", ("s7", 1): "s6", ("s7", 2): "s5", ("s7", 3): "c4", ("s7", 5): "c2", ("c7", 5): "c2", ("s7", 8): None, ("none", 1): None, ("c3", 3): "c0"}
    got = lookup.ancestor_by_parents(probes, headers, "distance", 3).collect()
    assert {(r["hash"], r["distance"]): r["ancestor_hash"] for r in got} == expected
    assert all(r["ancestor_number"] == (None if r["ancestor_hash"] is None else r["number"] - r["distance"]) for r in got)
    short = lookup.ancestor_by_parents(probes, headers, "distance", 1).collect()
    assert {(r["hash"], r["distance"]) for r in short if r["ancestor_hash"] is None} == {("s7", 2), ("s7", 3), ("s7", 5), ("s7", 8), ("none", 1)}


def test_large_values_stand_once(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (1, 9, "c")], "key long, tx long, value string")
    assert sorted(map(tuple, temporal.collate_large(df, 5, 9, lambda v, a, b: F.concat(v, F.lit(f"{a}-{b}"))).collect())) == [(1, "a5-9"), (2, "b5-9")]
    with pytest.raises(Exception, match="duplicate key 1"):
        temporal.collate_large(df, 5, 10).collect()


def test_functions_of_the_user(spark):
    df = spark.createDataFrame([(1, "b a"), (2, ""), (3, "a")], "k long, v string")
    words = lambda: F.transform(F.filter(F.split("v", " "), lambda w: w != ""), lambda w: F.struct(w.alias("key"), F.col("k").alias("k")))
    got = [tuple(r) for r in etl.transform(df, "k", words, etl.identity, 1, 4).collect()]
    assert [k for k, _ in got] == ["a", "a", "b"] and sorted(got) == [("a", 1), ("a", 3), ("b", 1)]
    assert sorted(map(tuple, etl.transform(df, "k", words, etl.identity, 2).collect())) == [("a", 3)]
    raw = spark.createDataFrame([(b"xyz", True), (b"", False)], "word binary, compressed boolean")
    got = etl.walk(raw, lambda w, c: [(x, c) for x in w], "byte int, compressed boolean").collect()
    assert sorted(map(tuple, got)) == [(120, True), (121, True), (122, True)]


def test_load_merge_with_empty_values(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    merged = lambda **x: sorted(map(tuple, etl.load_merge(target, new, "k", "v", **x).collect()))
    assert merged() == [(1, "a"), (3, "c")] and merged(empty_values=True) == [(1, "a"), (2, ""), (3, "c")]


def test_positions_with_null_and_equal_keys(spark):
    rng = random.Random(6)
    rows = [(None if rng.random() < 0.4 else rng.randrange(9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(4)
    got = positions.with_positions(df, "k", ["t"], before={"sum": F.col("t")}).collect()
    order, total = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 0
    at = {r["t"]: (r["ordinal"], r["sum"]) for r in got}
    for i, (_, t) in enumerate(order):
        assert at[t] == (i, total)
        total += t
    free = positions.with_positions(df, "k").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in free] == list(range(500)) and [r["k"] for r in free] == [k for k, _ in order]


def test_longest_matches(spark):
    patterns = ["tide", "tidetable", "table", "ab", "\u00e9t\u00e9"]
    text = "a tidetable, ab tide \u00e9t\u00e9 xtablex"
    words = spark.createDataFrame([(1, text), (2, None), (3, "")], "ordinal long, text string")
    got = dictionary.matches(words, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    assert sorted((r["ordinal"], text[r["at"] : r["until"]]) for r in got) == [(1, "ab"), (1, "table"), (1, "tide"), (1, "tidetable"), (1, "\u00e9t\u00e9")]
    assert dictionary.matches(words, spark.createDataFrame([], "pattern string")).count() == 0


def test_the_last_value_of_each_step(spark):
    rows = [("2024-01-01 00:10:00", 1, "a"), ("2024-01-01 00:50:00", 1, "b"), ("2024-01-01 01:10:00", 1, "c"), ("2024-01-01 00:20:00", 2, "d")]
    df = spark.createDataFrame(rows, "ts string, key long, value string")
    got = hot_store.latest_by_step(df.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert sorted((r["key"], r["value"], r["n"]) for r in got) == [(1, "b", 2), (1, "c", 1), (2, "d", 1)]

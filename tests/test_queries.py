import oracle
import pytest

from ledgerloom.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    oracle.same(spark, name, QUERIES, ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_uncompressed_words_come_back_whole(spark):
    raw = {r["ordinal"] for r in QUERIES["raw_words"](spark, oracle.DATA).withColumnRenamed("order", "ordinal").where("NOT compressed").collect()}
    got = QUERIES["word_scan_uncompressed"](spark, oracle.DATA).collect()
    assert {r["ordinal"] for r in got} == raw
    assert all(len(r["word"].encode()) == r["length"] for r in got) and max(r["length"] for r in got) > 16


def test_cover_uses_patterns_of_all_lengths(spark):
    assert {len(r["pattern"]) for r in QUERIES["pattern_uses"](spark, oracle.DATA).collect()} - {5, 6}


def test_code_lengths_are_the_least(spark):
    """Within each brand the code is full, and no code needs fewer bits: the sum of joined weights is the least there is."""
    import heapq

    uses = spark.read.parquet(f"{oracle.DATA}/part.parquet").groupBy("p_brand", "p_type").count().collect()
    depth = {(r["p_brand"], r["p_type"]): r["depth"] for r in QUERIES["huffman_depths"](spark, oracle.DATA).collect()}
    for brand in {r["p_brand"] for r in uses}:
        own = {r["p_type"]: r["count"] for r in uses if r["p_brand"] == brand}
        heap, least = sorted(own.values()), 0
        while len(heap) > 1:
            joined = heapq.heappop(heap) + heapq.heappop(heap)
            least += joined
            heapq.heappush(heap, joined)
        assert sum(n * depth[brand, t] for t, n in own.items()) == least
        assert len(own) == 1 or sum(2.0 ** -depth[brand, t] for t in own) == 1


def test_covers_by_brute_force(spark):
    """Patterns of a name's cover don't overlap, and no other choice saves more."""
    import collections
    import math

    from ledgerloom.operators import dictionary

    parts = spark.read.parquet(f"{oracle.DATA}/part.parquet").collect()
    score = collections.Counter()
    for r in parts:
        name = r["p_name"].encode()
        for i in range(len(name)):
            for k in range(i + 5, min(len(name), i + 128) + 1):
                score[name[i:k]] += r["p_size"] * (k - i)
    best = sorted(score.items(), key=lambda x: (x[1], x[0]), reverse=True)[:1000]
    known = {p: int(math.log2(1 + n)) for p, n in best}
    covers = collections.defaultdict(list)
    for r in QUERIES["cover_words"](spark, oracle.DATA).collect():
        covers[r["p_partkey"]].append((r["at"], bytes(r["pattern"])))
    for r in parts:
        name = r["p_name"].encode()
        most = [(0, 0)] * (len(name) + 1)
        for i in range(len(name) - 1, -1, -1):
            options = [most[i + 1]] + [(most[k][0] + k - i - 4, most[k][1] + known[name[i:k]]) for k in range(i + 5, len(name) + 1) if name[i:k] in known]
            most[i] = max(options)
        own = sorted(covers[r["p_partkey"]])
        assert all(name[a : a + len(p)] == p for a, p in own) and all(a + len(p) <= b for (a, p), (b, _) in zip(own, own[1:], strict=False))
        assert (sum(len(p) - 4 for _, p in own), sum(known[p] for _, p in own)) == most[0]
    uses = {bytes(r["pattern"]): r["uses"] for r in QUERIES["pattern_uses"](spark, oracle.DATA).collect()}
    assert uses == collections.Counter(p for c in covers.values() for _, p in c)


def test_hashed_headers_by_brute_force(spark):
    from ledgerloom.functions import codecs

    rlp = {r["number"]: bytes.fromhex(r["rlp"]) for r in QUERIES["header_rlp"](spark, oracle.DATA).collect()}
    got = {r["number"]: (r["hash"], r["marker"]) for r in QUERIES["header_keccak"](spark, oracle.DATA).collect()}
    numbers = sorted(rlp)
    hashes = [h.hex() for h in codecs.keccak_256([rlp[n] for n in numbers])]
    assert got == {n: (h, h[:2]) for n, h in zip(numbers, hashes, strict=True)}


def test_buckets_are_counted_in_order(spark):
    got = sorted(map(tuple, QUERIES["bucket_cumkeys"](spark, oracle.DATA).collect()))
    total = 0
    for _, keys, before in got:
        assert before == total
        total += keys
    assert total == spark.read.parquet(f"{oracle.DATA}/orders.parquet").count()


def test_segment_ratios_are_those_of_files(spark):
    ratios = [float(r["ratio"]) for r in QUERIES["segment_ratio"](spark, oracle.DATA).collect()]
    assert ratios and all(1 < x < 5 for x in ratios)

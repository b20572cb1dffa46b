"""SimHash near-duplicates against a brute-force version over all pairs."""
import random
import re

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import types as T

from quarry.llm import simhash
from quarry.sources.tables import load

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, distance=2):
    """rows: (doc_id, text) -> sorted (doc_id, hex, component)"""
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(map(tuple, simhash.digest(df).collect()), key=repr)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("fp", T.StringType()), T.StructField("root", T.IntegerType())])


def test_whole_table_equals_brute_force(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.near_duplicates(docs)) == brute(rows)


def test_links_find_every_pair_within_two_bits(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 1, base ^ 3, base ^ 7, base ^ (1 << 63), base ^ (1 << 63) ^ (1 << 17), 0, 5, 0xFFFFFFFFFFFFFFFF,
           0xFFFFFFFFFFFFFFFF ^ (1 << 63) ^ 1]
    signed = [simhash._signed(f) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for r in (0, 1, 2):
        from quarry.llm.graph import components
        roots = {x.u: x.root for x in components(simhash.links(df, r)).collect()}
        comp = [roots.get(f, f) for f in signed]
        for i in range(len(fps)):
            reach = {i}
            while True:
                more = {j for j in range(len(fps)) for k in reach if (fps[j] ^ fps[k]).bit_count() <= r}
                if more <= reach:
                    break
                reach |= more
            assert reach == {j for j in range(len(fps)) if comp[j] == comp[i]}


def test_nulls_ties_empty_and_clashing_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [Row(None, "a b c d", "x", 1), Row(5, None, "x", 2), Row(3, "", "y", None), Row(3, "", "y", None),
            Row(7, "  \t\n ", None, 1), Row(9, long, "x", 1), Row(8, long.upper(), "x", 1), Row(4, "one two", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(simhash.near_duplicates(docs)) == brute([(r[0], r[1]) for r in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 8, None]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_drops_all_but_the_least_id(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    first = {c for _, _, c in got(simhash.near_duplicates(docs))}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(first)


def close(fps, distance):
    return {(max(a, b), min(a, b)) for a in fps for b in fps if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}


@pytest.mark.parametrize("segments", [1, 2, 4, 8])
def test_lookups_find_each_link_whatever_the_segments(spark, segments):
    rng = random.Random(segments)
    some = [rng.getrandbits(64) for _ in range(12)]
    some += [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in some for _ in range(4)]
    fps = sorted({simhash._signed(f) for f in some})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for d in (1, 2):
        assert {tuple(r) for r in simhash.links(df, d, segments).collect()} == close(fps, d)


def test_a_ball_holds_each_value_within_its_radius():
    assert [(len(flips), flips[0]) for _, flips in simhash.search_plan(2, 2)] == [(33, 0), (1, 0)]
    assert [len(flips) for _, flips in simhash.search_plan(2, 4)] == [1, 1, 1]
    assert [len(flips) for _, flips in simhash.search_plan(2, 1)] == [1 + 64 + 64 * 63 // 2]
    with pytest.raises(ValueError):
        simhash.search_plan(2, 3)


def test_hot_buckets_lose_no_component(spark):
    """Hundreds of fingerprints in one bucket of either segment, and a cold one linked to them."""
    from quarry.llm.graph import components
    rng = random.Random(5)
    base = 0x0123456789ABCDEF
    some = {base ^ sum(1 << b for b in rng.sample(range(32), 3)) for _ in range(150)}   # share the high half
    some |= {base ^ sum(1 << b for b in rng.sample(range(32, 64), 3)) for _ in range(150)}
    some |= {next(iter(some)) ^ 1 << 40, next(iter(some)) ^ 1 << 3 ^ 1 << 50, rng.getrandbits(64)}
    fps = sorted(simhash._signed(f) for f in some)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = close(fps, 2)
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for a, b in edges:
        hi, lo = max(find(a), find(b)), min(find(a), find(b))
        parent[hi] = lo
    for bucket in (1, 8, 10_000):
        found = simhash.links(df, 2, bucket=bucket)
        assert {tuple(r) for r in found.collect()} <= edges
        roots = {r.u: r.root for r in components(found).collect()}
        assert {f: roots.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_no_join_broadcasts_a_table(spark, sf_small, monkeypatch):
    """All tables of the joins grow with the input; Spark sizes the lookups 34 times too low."""
    from quarry.llm import base, graph
    plans = []

    def plan(name, df):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))

    def recorded(df, name):
        plan(name, df)
        return base.stored(df, name)

    monkeypatch.setattr(simhash, "stored", recorded)
    monkeypatch.setattr(graph, "stored", recorded)
    plan("rows", simhash.near_duplicates(load(spark, sf_small, "documents")))
    fps = base.stored(spark.createDataFrame([(f,) for f in range(40)], "fp long"), "few")
    plan("links", simhash.links(fps, 2, bucket=4))  # with hot buckets
    assert {n for n, p in plans if "SortMergeJoin" in p} == {"cc", "components", "rows", "segments", "links"}
    assert not [n for n, p in plans if "Broadcast" in p]

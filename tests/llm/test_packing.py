"""Packing: every piece placed once, constraints kept, and best fit by brute force."""
import random
from collections import Counter

from pyspark.sql import Row
from pyspark.sql import types as T

from quarry.llm import packing
from quarry.sources.tables import load


def brute_place(items, capacity, max_per_source):
    """Scans all bins for the compatible one with the least room."""
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(b["room"], k) for k, b in enumerate(bins)
               if b["room"] >= size and cluster not in b["clusters"] and b["sources"][source] < max_per_source]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"room": capacity, "clusters": set(), "sources": Counter()})
        b = bins[k]
        out.append((k, capacity - b["room"]))
        b["room"] -= size
        b["clusters"].add(cluster)
        b["sources"][source] += 1
    return out


def test_place_is_the_tightest_compatible_bin():
    rnd = random.Random(2)
    for _ in range(40):
        items = [(rnd.randint(0, 50), rnd.choice(["a", "a", "a", "b", None]), rnd.choice([0, 0, 0, *range(1, 60)]))
                 for _ in range(150)]
        items.sort(key=lambda x: -x[0])
        p = packing.Packer(100, 3)
        assert [p.place(*x) for x in items] == brute_place(items, 100, 3)


def check(rows, docs, capacity, max_per_source):
    placed = Counter()
    for r in rows:
        placed[(r.doc_id, r.cluster, r.copy)] += r.size
    want = Counter()
    for d in docs:
        want[d] += 1
    assert len(placed) == sum(want.values())
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for rs in bins.values():
        assert sum(r.size for r in rs) <= capacity
        assert len({r.cluster for r in rs}) == len(rs)
        assert max(Counter(r.source for r in rs).values()) <= max_per_source
        at = 0
        for r in sorted(rs, key=lambda r: (r.bin_offset, r.size)):
            assert r.bin_offset == at
            at += r.size
    return bins


def test_whole_table(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    rows = packing.pack(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(rows, [(d,) for d in texts], packing.CAPACITY, packing.MAX_PER_SOURCE)
    sizes = Counter()
    for r in rows:
        sizes[r.doc_id] += r.size
    assert sizes == Counter({d: len(t.encode().split()) for d, t in texts.items()})
    assert {r.doc_id for r in rows} == set(texts)


def test_shards_copies_long_texts_nulls_and_clashing_columns(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("shard", T.StringType()),
                           T.StructField("size", T.IntegerType())])
    rows = [Row(1, "w " * 1050, "s", "x", 1), Row(None, None, None, "x", 1), Row(None, "", None, None, 1),
            Row(2, "A b", "s", "x", None), Row(3, "a\tB ", "s", "x", 1)]
    rows += [Row(9, "same text here", "hot", "x", 1)] * 60 + [Row(100 + k, f"t{k} u v", "hot", "x", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, schema)
    got = packing.pack(docs, capacity=100, max_per_source=4, shard_pieces=20).collect()
    check(got, [(r[0], r[1]) for r in rows], 100, 4)
    assert sorted(r.size for r in got if r.doc_id == 1) == [50] + [100] * 10
    assert len({r.bin_id >> 32 for r in got}) > 3
    assert len({r.bin_id for r in got if r.doc_id == 9}) == 60  # copies never share a bin
    two, three = ([r.cluster for r in got if r.doc_id == d][0] for d in (2, 3))
    assert two == three
    assert sum(r.doc_id is None for r in got) == 2
    assert packing.pack(docs.limit(0)).count() == 0

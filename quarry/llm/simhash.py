"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments, and each segment has a table from its value
to the fingerprints that hold it.  Fingerprints within ``d`` bits differ in few
bits of some segment, so a fingerprint looks up, in each table, the values of a
small Hamming ball around its own segment, fetches the bucket found there and
verifies complete distances.  With 2 segments and 2 bits these are the 33 values
within one bit of the first segment and the one value of the second.

Near copies of one text may share a segment by the thousand.  A bucket of more
than ``BUCKET`` fingerprints is not fetched: it stays out of its table, and
links between two fingerprints that both lie in such buckets come from a table
of whole fingerprints, where the ball of one bit around each of them meets the
other's half way.  There a key has at most 65 fingerprints, kept as a bitmap of
the flipped bits, however many near copies there are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, fresh, stored, text_of
from .graph import components

SHINGLE = 3
MAX_DISTANCE = 2
SEGMENTS = 2
BUCKET = 128  # fingerprints of a segment's value that a lookup fetches
SEED = 42
_SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space,
    shingles with repeats joined by a space; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SLICE):
        size = min(_SLICE, n - at)
        h = np.fromiter((digest(g, SEED) for g, _ in zip(grams, range(size))), dtype="<u8", count=size)
        counts += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little") \
            .sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, fp)`` per row: text_key is a 64-bit hash of the
    text, fp the fingerprint as a signed long.  Null text is empty."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
                      F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fps = [0 if not t.is_valid else _signed(fingerprint(t.as_py(), shingle)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())],
                                             ["doc_id", "text_key", "fp"])

    return src.mapInArrow(run, "doc_id long, text_key long, fp long")


def text_key(text_col: str):
    return F.xxhash64(text_of(text_col), F.lit(7))


def search_plan(max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> list[tuple[int, list[int]]]:
    """``(mask, flips)`` of each table that is looked up: the segment's bits, and
    the ball around a value as what is flipped in it (0 first).

    ``max_distance = segments * r + a``: either one of the first ``a + 1``
    segments differs in at most ``r`` bits, or one of the others in at most
    ``r - 1``; otherwise the whole would differ in more than ``max_distance``."""
    width = 64 // segments
    if segments < 1 or segments * width != 64:
        raise ValueError("segments must divide 64")
    r, a = divmod(max_distance, segments)
    plan = []
    for s in range(segments):
        radius = r if s <= a else r - 1
        if radius < 0:
            continue
        bits = [1 << (s * width + b) for b in range(width)]
        flips = [_signed(sum(c)) for n in range(radius + 1) for c in combinations(bits, n)]
        plan.append((_signed(sum(bits)), flips))
    return plan


def segment_entries(fps: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """``(seg, key, fp)``: the segment tables, a row for each table of each fingerprint."""
    keys = [F.struct(F.lit(s).alias("seg"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"))
            for s, (mask, _) in enumerate(search_plan(max_distance, segments))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.seg", "k.key", "fp")


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS,
          bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> edges ``(u, v)`` whose components are
    those of all pairs at ``max_distance`` (0, 1 or 2) or fewer differing bits.

    A link of two fingerprints is found when either looks the other up.  So only
    links between two that lie in buckets above ``bucket`` are left for the
    table of whole fingerprints.  A lookup compares at most ``bucket``
    fingerprints, and what it keeps are verified links."""
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance must be 0, 1 or 2")
    if max_distance == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("u != v")
    # a row becomes many: few rows in few files are dealt to all tasks first
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    entries = segment_entries(fps, max_distance, segments)
    hot = stored(entries.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
                 .select("seg", "key", F.lit(True).alias("hot")), "hot-buckets")
    any_hot = not hot.isEmpty()
    if any_hot:
        # written, so that adaptive execution may split a hot value's rows
        entries = stored(entries.join(hot.hint("merge"), ["seg", "key"], "left"), "segments")
    cold = entries.where("hot is null") if any_hot else entries
    buckets = cold.groupBy("seg", "key").agg(F.collect_list("fp").alias("found"))
    def ball(s, mask, flips):
        return F.transform(F.lit(flips), lambda x: F.struct(
            F.lit(s).alias("seg"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(x).alias("key")))

    balls = [ball(s, *table) for s, table in enumerate(search_plan(max_distance, segments))]
    lookups = fps.select("fp", F.explode(F.concat(*balls)).alias("k")).select("k.seg", "k.key", "fp")
    near = F.expr(f"filter(found, x -> x != fp and bit_count(x ^ fp) <= {int(max_distance)})")
    # Spark sizes the lookups as if each fingerprint had one: never broadcast
    out = lookups.join(buckets.hint("merge"), ["seg", "key"]).select(F.col("fp").alias("u"), F.explode(near).alias("v"))
    if any_hot:
        out = out.unionByName(_half_way(entries.where("hot").select("fp").distinct(), max_distance))
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _half_way(fps: DataFrame, max_distance: int) -> DataFrame:
    """Edges that join whatever lies within ``max_distance`` (1 or 2): two
    fingerprints meet at a key of the table of whole fingerprints, the value
    half way between them.  A key's fingerprints are linked as a star."""
    masks = [_signed(1 << b) for b in range(64)]
    # position 64 is the fingerprint itself
    probes = fps.select(F.col("fp"), F.posexplode(F.array(*[F.lit(m) for m in [*masks, 0]])).alias("bit", "mask"))
    table = (probes.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), "bit")
             .groupBy("key")
             .agg(F.expr("bit_or(if(bit < 64, shiftleft(1L, bit), 0L))").alias("flipped"),
                  F.max(F.col("bit") == 64).alias("own")))
    hits = table.where("bit_count(flipped) + int(own) > 1")
    if max_distance == 1:  # only the key itself and its neighbours
        hits = hits.where("own")
    hits = hits.select(
        "key", "own",
        F.expr("transform(filter(sequence(0, 63), i -> (shiftright(flipped, i) & 1L) = 1L), "
               "i -> key ^ shiftleft(1L, i))").alias("found"))
    linked = hits.select(
        F.when(F.col("own"), F.col("key")).otherwise(F.col("found")[0]).alias("v"),
        F.explode("found").alias("u"))
    return linked.where(f"u != v and bit_count(u ^ v) <= {int(max_distance)}").select("u", "v")


def _components(rows: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """Fingerprint rows ``(doc_id, text_key, fp)`` -> ``(fp, best, component_id)``
    per fingerprint: the first row of its component and the least doc_id.

    Rows meet by fingerprint only in aggregates that combine in each task; the
    table is written, so that joining rows to it is a join of two plain scans,
    whose hot fingerprints adaptive execution can split.  No join broadcasts a
    table: all of them grow with the input, and the driver's memory does not."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    nodes = stored(rows.groupBy("fp").agg(F.min(rank).alias("first"), F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), max_distance, segments))
    known = nodes.join(roots.hint("merge"), nodes.fp == roots.u, "left").select(
        "fp", "first", "least", F.coalesce("root", "fp").alias("root"))
    best = known.groupBy("root").agg(F.min("first").alias("best"), F.min("least").alias("component_id"))
    return stored(known.join(best.hint("merge"), "root").select("fp", "best", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE,
                    segments: int = SEGMENTS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    component_id is the least doc_id reachable over links, the row's own
    included.  Null and empty texts have fingerprint 0 and link like any other;
    a null doc_id stays null and is passed over by the minimum (a component of
    null ids only has a null component_id); repeated rows are returned as often
    as they come.  An empty table gives an empty table; other columns are not
    read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = _components(rows, max_distance, segments)
    return rows.join(found.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: the fingerprint as 16 hexadecimal digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE,
             segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id
    (null ids come last), ties by the text's hash; a row that comes several
    times is kept once.  The rows that go are joined back as a list of ids, so
    texts cross the network once."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = _components(rows, max_distance, segments)
    of = rows.groupBy("fp", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).join(found.hint("merge"), "fp")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    of = stored(of.select("doc_id", "text_key", "n", same.alias("stays")), "decisions")
    gone_id, gone_key, own_key = fresh(docs, "gone_id", "gone_key", "own_key")
    gone = of.where(~F.col("stays")).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    kept = docs.withColumn(own_key, text_key(text_col))
    kept = kept.join(gone, docs[id_col].cast("long").eqNullSafe(gone[gone_id])
                     & (kept[own_key] == gone[gone_key]), "left_anti")
    if not of.where("stays and n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, own_key])
    return kept.drop(own_key)

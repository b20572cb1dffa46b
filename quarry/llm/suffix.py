"""Removal of repeated byte strings with suffix arrays and longest previous factors.

A byte goes if a string of ``length`` bytes that covers it starts at more than
one place of the corpus; with ``keep="first"`` the first copy stays.

1. Winnowing: of the ``length - GRAM + 1`` grams in a window, the one with the
   least hash (leftmost in a tie) is its anchor.  That depends on the window's
   bytes alone, so equal windows have equal anchors at equal offsets, and only
   windows with one anchor need to be compared.  Consecutive windows with the
   same anchor are one run: a row with the hashes of its anchor and its bytes.
2. Runs whose anchor is unique have no repeats.  Runs with equal bytes are
   repeats as a whole, found by counting; no bytes move.  Bytes are equal where
   their BLAKE2b digests of 128 bits are: no text can be made to collide.
3. What is left are runs that share an anchor but differ somewhere.  One run of
   each kind is fetched with its bytes, and each group's windows are put into
   suffix order; previous and next smaller positions in that order give the
   longest previous factor of each window, and a factor of the full length is
   a repeat.
4. A group of too many different runs for one task is split: its runs are cut in
   halves by the windows' offset from the anchor, and each half meets others by
   the longer string that all its windows contain.  After a few halvings a run
   is one window, whose group has one kind; so every group is decided, and no
   list of pairs is made.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, byte_rows, fresh, prefix_hash, row_blocks, span_hash, stored

LENGTH = 400
GRAM = 64
GROUP_RUNS = 512          # kinds of runs put into one suffix array at most
BLOCK = (1 << 20) - LENGTH
ARRAY_BYTES = 1 << 16     # bytes of whole groups put into one suffix array; its tables stay in the cache


# ---------------------------------------------------------------- 1. anchors

def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values)
    pad = np.full(-n % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    cells = np.concatenate([values, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def span_digest(raw) -> bytes:
    """What stands for a run's bytes where equal runs are counted."""
    return blake2b(raw, digest_size=16).digest()


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of one block of rows: (row, first window, windows, anchor's distance
    from the first window, anchor hash, bytes' digest).  At most 2**20 bytes."""
    n = len(data)
    none = (*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64)), [])
    if n < length:
        return none
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    low = np.uint64((1 << 20) - 1)
    anchor = (window_minima((grams & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    starts = np.arange(n - length + 1)
    row = np.searchsorted(offsets[1:], starts, side="right")
    ok = starts + length <= offsets[row + 1]
    starts, row, anchor = starts[ok], row[ok], anchor[ok]
    if not len(starts):
        return none
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    p, a, r = starts[first], anchor[first], row[first]
    raw = memoryview(np.ascontiguousarray(data))
    spans = [span_digest(raw[i:j]) for i, j in zip(p.tolist(), (p + count - 1 + length).tolist())]
    return r, p - offsets[r], count, a - p, grams[a], spans


def _segments(offsets: np.ndarray, length: int):
    """Blocks of whole rows, and pieces of rows that are longer than a block;
    the pieces overlap so that each window lies in one."""
    for i, j in row_blocks(offsets, BLOCK):
        if offsets[j] - offsets[i] <= BLOCK + length - 1:
            yield i, offsets[i:j + 1]
        else:
            for at in range(int(offsets[i]), int(offsets[j]) - length + 1, BLOCK):
                yield i, np.array([at, min(at + BLOCK + length - 1, offsets[j])])


def runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs(doc_id, text_key, text)`` -> a row per run."""
    def scan(batches):
        for b in batches:
            data, offsets = byte_rows(b.column(2))
            for i, bounds in _segments(offsets, length):
                r, p, n, o, a, s = runs_of(data[bounds[0]:bounds[-1]], bounds - bounds[0], length, gram)
                p = p + bounds[r] - offsets[i + r]
                take = pa.array(i + r, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(p, pa.int64()), pa.array(n, pa.int32()),
                     pa.array(o, pa.int32()), pa.array(a.view(np.int64)), pa.array(s, pa.binary())],
                    ["doc_id", "text_key", "at", "n", "off", "core", "span"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(
        scan, "doc_id long, text_key long, at long, n int, off int, core long, span binary")


# ---------------------------------------------------------------- 3. suffix arrays

def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value, or -1."""
    at = np.arange(len(values)) - 1
    while True:
        wrong = np.flatnonzero((at >= 0) & (values[at] > values))
        if not len(wrong):
            return at
        at[wrong] = at[at[wrong]]


def suffix_order(data: np.ndarray, left: np.ndarray, group: np.ndarray, limit: int):
    """Places with ``limit`` bytes left, in suffix order within their group, and
    whether each agrees with the one before it in all ``limit`` bytes.  Prefix
    doubling; only classes of several places are refined."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    word = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        word |= padded[k:k + n] << np.uint64(56 - 8 * k)
    idx = np.flatnonzero(left >= 8)
    # pairs are sorted as one whole number, which is faster than two sorts
    by_word = np.argsort(word[idx])
    place = np.zeros(len(idx), dtype=np.int64)
    place[by_word[1:]] = np.cumsum(word[idx[by_word[1:]]] != word[idx[by_word[:-1]]])
    order = idx[np.argsort(group[idx].astype(np.int64) * (n + 1) + place)]
    rank = np.full(n, -1, dtype=np.int64)
    new = np.ones(len(order), dtype=bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
    base = np.flatnonzero(new)
    size = np.diff(np.append(base, len(order)))
    rank[order] = np.repeat(base, size)
    live = order[np.repeat(size > 1, size)]
    h = 8
    while h < limit:
        step = min(h, limit - h)
        live = live[left[live] >= h + step]
        first, second = rank[live], rank[live + step]
        o = np.argsort(first * (n + 1) + second)
        live, first, second = live[o], first[o], second[o]
        start = np.ones(len(live), dtype=bool)
        start[1:] = first[1:] != first[:-1]
        new = start.copy()
        new[1:] |= second[1:] != second[:-1]
        base = np.flatnonzero(new)
        size = np.diff(np.append(base, len(live)))
        in_class = np.maximum.accumulate(np.where(start, np.arange(len(live)), 0))
        rank[live] = first + np.repeat(base - in_class[base], size)
        live = live[np.repeat(size > 1, size)]
        h += step
    idx = np.flatnonzero(left >= limit)
    sa = idx[np.argsort(rank[idx] * n + idx)]
    # single places were not refined, so a rank is shared only by live ones
    is_live = np.zeros(n, dtype=bool)
    is_live[live] = True
    same = np.zeros(len(sa), dtype=bool)
    if len(sa) > 1:
        same[1:] = (rank[sa[1:]] == rank[sa[:-1]]) & is_live[sa[1:]] & is_live[sa[:-1]]
    return sa, same


def repeats(texts: list[bytes], groups: np.ndarray, limit: int, keep: str = "none") -> list[np.ndarray]:
    """For each text, which of its windows are repeats within its group.  The
    longest previous factor of a place is the longer agreement with its previous
    and its next smaller position in suffix order; agreements count as ``limit``
    or nothing.  With ``keep="none"`` later positions count too."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    sa, same = suffix_order(data, left, np.repeat(groups, sizes), limit)
    breaks = np.cumsum(~same)  # agreement reaches from place to place where this stays the same

    def agrees(at):
        ok = (at >= 0) & (at < len(sa))
        return ok & (breaks[np.where(ok, at, 0)] == breaks)

    before = previous_smaller(sa)
    after = len(sa) - 1 - previous_smaller(sa[::-1])[::-1]
    hit = agrees(before) | agrees(after)
    if keep == "none":
        larger = previous_smaller(-sa)
        hit |= agrees(larger) | agrees(len(sa) - 1 - previous_smaller(-sa[::-1])[::-1])
    marked = np.zeros(len(data), dtype=bool)
    marked[sa[hit]] = True
    return [marked[e - s:e - limit + 1] for e, s in zip(ends, sizes)]


def _pieces(marked: np.ndarray, at: int, limit: int):
    """Byte bounds of stretches of marked windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return [(int(at + a), int(at + b - 1 + limit)) for a, b in zip(edge[::2], edge[1::2])]


SPAN_SCHEMA = "doc_id long, text_key long, start long, end long"


def _resolve(contexts: DataFrame, length: int, keep: str) -> DataFrame:
    """Contexts dealt by group -> repeated byte spans.  Whole groups are taken
    into suffix arrays of about ``ARRAY_BYTES``."""
    def flush(rows):
        texts = [r[5] for r in rows]
        _, groups = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        out = [(r[2], r[3], a, b) for r, m in zip(rows, repeats(texts, groups, length, keep))
               for a, b in _pieces(m, r[4], length)]
        return pa.RecordBatch.from_arrays(
            [pa.array([o[k] for o in out], pa.int64()) for k in range(4)], ["doc_id", "text_key", "start", "end"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in range(6)]):
                if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    dealt = contexts.repartition("core").sortWithinPartitions("core", "doc_id", "text_key", "at")
    return dealt.select("core", "span", "doc_id", "text_key", "at", "bytes").mapInArrow(run, SPAN_SCHEMA)


# ---------------------------------------------------------------- 2. and 4. groups

def _kinds(part: DataFrame, group_runs: int) -> tuple[DataFrame, DataFrame]:
    """``kinds``: per ``(core, span)`` how many runs there are (``seen``) and the
    first one; ``mixed``: the kinds of groups that have several.  Both sides of
    the join by core are written, so that a core with very many kinds is split."""
    place = F.struct("doc_id", "text_key", "at", "n", "off")
    kinds = stored(part.groupBy("core", "span").agg(F.sum("seen").alias("seen"), F.min(place).alias("first")), "run-kinds")
    groups = stored(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed-groups")
    mixed = kinds.join(groups, "core").select("core", "span", "seen", "first", (F.col("kinds") > group_runs).alias("hot"))
    return kinds, mixed


def _whole(part: DataFrame, kinds: DataFrame, length: int, keep: str) -> DataFrame:
    """Spans of the runs whose kind comes more than once."""
    full = stored(kinds.where("seen > 1").select("core", "span", "first"), "repeated-runs")
    out = part.join(full, ["core", "span"])
    if keep == "first":
        out = out.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
                          & (F.col("at") == F.col("first.at"))))
    return out.select("doc_id", "text_key", F.col("at").alias("start"),
                      (F.col("at") + F.col("n") - 1 + length).alias("end"))


def _fetch(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of runs: ``places`` meets the texts by document."""
    cols = ["core", "span", "seen", "at", "n", "off", "hot"]
    listed = places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*cols)).alias("places"))
    d, k = fresh(docs, "of_id", "of_key")
    listed = listed.select(F.col("doc_id").alias(d), F.col("text_key").alias(k), "places")
    # rows that come several times are read once: their runs are one kind
    both = docs.join(listed, docs.doc_id.eqNullSafe(listed[d]) & (docs.text_key == listed[k]))
    cut = both.select("doc_id", "text_key", "text", F.explode("places").alias("p"))
    return cut.select("doc_id", "text_key", *[f"p.{c}" for c in cols],
                      F.expr(f"substring(text, int(p.at) + 1, p.n - 1 + {length})").alias("bytes"))


def _halves(hot: DataFrame, lo: str, hi: str, length: int) -> DataFrame:
    """Cuts runs at the middle of their range of offsets [lo, hi]; each part's
    core is what all windows of its half hold."""
    mid = F.floor((F.col(lo) + F.col(hi)) / 2)
    last = F.col("off") - F.col("n") + 1  # offsets of a run go from off down to last
    parts = []
    for u, v in ((F.col(lo), mid), (mid + 1, F.col(hi))):
        top, bottom = F.least(F.col("off"), v), F.greatest(last, u)
        skip = (F.col("off") - top).cast("int")
        n = (top - bottom + 1).cast("int")
        part = hot.where(top >= bottom).select(
            "doc_id", "text_key", "seen", (F.col("at") + skip).alias("at"), n.alias("n"), top.cast("int").alias("off"),
            u.cast("int").alias("lo"), v.cast("int").alias("hi"),
            F.substring("bytes", skip + 1, n - 1 + length).alias("bytes"))
        core = F.substring("bytes", (F.col("off") - F.col("lo") + 1).cast("int"),
                           (length - (F.col("hi") - F.col("lo"))).cast("int"))
        parts.append(part.select("*", F.xxhash64(core, "lo", "hi").alias("core"),
                                 F.unhex(F.sha2(F.concat("bytes", F.col("off").cast("string").cast("binary")), 256)).alias("span")))
    return parts[0].unionByName(parts[1])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_runs: int = GROUP_RUNS,
                   keep: str = "none") -> DataFrame:
    """``docs(doc_id, text_key, text binary)`` -> ``(doc_id, text_key, start,
    end)``, byte spans to remove (they may overlap)."""
    part = stored(runs(docs, length, gram), "runs").withColumn("seen", F.lit(1).cast("long"))
    # written, so that the join is one of two plain scans: a text that repeats one
    # word has its anchor at very many places, and such a join can be split
    shared = stored(part.groupBy("core").agg(F.sum("seen").alias("all")).where("all > 1").select("core"), "shared-anchors")
    part = stored(part.join(shared, "core", "left_semi"), "shared-runs")
    kinds, mixed = _kinds(part, group_runs)
    spans = _whole(part, kinds, length, keep)
    places = mixed.select("core", "span", "seen", "first.*", "hot")
    contexts = stored(_fetch(docs, places, length), "contexts")
    spans = spans.unionByName(_resolve(contexts.where("not hot"), length, keep))
    hot = contexts.where("hot").withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    while not hot.isEmpty():
        part = stored(_halves(hot, "lo", "hi", length), "halved-runs")
        kinds, mixed = _kinds(part, group_runs)
        spans = spans.unionByName(_whole(part, kinds, length, keep))
        first = mixed.select("core", "span", "hot", "first.doc_id", "first.text_key", "first.at")
        one = part.select("core", "span", "doc_id", "text_key", "at", "n", "off", "lo", "hi", "bytes", "seen")
        same = [one[c].eqNullSafe(first[c]) for c in ("core", "span", "doc_id", "text_key", "at")]
        go_on = one.join(first, same[0] & same[1] & same[2] & same[3] & same[4]).select(
            *[one[c] for c in one.columns], "hot")
        go_on = stored(go_on.dropDuplicates(["core", "span"]), "halved-contexts")
        spans = spans.unionByName(_resolve(go_on.where("not hot"), length, keep))
        hot = go_on.where("hot")
    return spans


def text_key(col: str = "text"):
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("")), F.lit(11))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    gram: int = GRAM, group_runs: int = GROUP_RUNS, keep: str = "none") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept binary)`` for each row.

    Texts are UTF-8 bytes, and strings are judged on the input.  ``keep`` is
    "none" (all copies go) or "first" (the copy with the least doc_id, a null id
    before others, then the leftmost, stays; of equal rows all or none).  Texts
    shorter than ``length``, empty and null ones lose nothing.  Null and
    repeated ids are returned as they come; a repeated row is a document of its
    own, so its strings are repeats.  An empty table gives an empty table; other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    if not 8 <= gram < length:
        raise ValueError("8 <= gram < length is needed")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
                      F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    spans = repeated_spans(src, length, gram, group_runs, keep)
    lists = spans.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    both = src.join(lists, src.doc_id.eqNullSafe(lists.of_id) & (src.text_key == lists.of_key), "left")

    def run(batches):
        for b in batches:
            rows = []
            for t, spans in zip(b.column(1), b.column(2)):
                raw = t.as_py()
                kept, at, n = [], 0, 0
                for s in sorted(spans.as_py() or (), key=lambda s: (s["start"], s["end"])):
                    if s["start"] > at or not n:
                        kept.append(raw[at:s["start"]])
                        n += 1
                        at = s["end"]
                    else:
                        at = max(at, s["end"])
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((len(raw), len(raw) - len(rest), n, rest))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)],
                 pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

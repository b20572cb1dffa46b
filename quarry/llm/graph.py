"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored

MAX_ROUNDS = 60


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and its partners.  The minimum
    is combined in each task first, so a hub is no hot key there; the join back
    on u is a plain sort-merge join, whatever Spark takes the tables' sizes for,
    that adaptive execution splits if skewed."""
    m = pairs.groupBy("u").agg(F.min("v").alias("least"))
    m = m.select("u", F.least("u", "least").alias("m"))
    return pairs.join(m.hint("merge"), "u")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    s = _with_minimum(both).where("v > u and v != m")
    return s.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    s = _with_minimum(down)
    links = s.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = s.select(F.col("u"), F.col("m").alias("v"))
    return links.unionByName(own).distinct()


def _mark(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")),
                 F.sum(F.xxhash64("u", "v") % 1000003)).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` (long) -> ``(u, root)`` for each vertex that is not its
    component's least vertex.  Every round is written to the shared folder, so
    the plan stays short and a lost executor costs one round."""
    e = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"),
                                            F.least("u", "v").alias("v")).distinct(), "cc")
    before = _mark(e)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        e = stored(_small_star(_large_star(e)), "cc")
        now = _mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select("u", F.col("v").alias("root"))

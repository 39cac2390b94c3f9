"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.runtime import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:  # a's larger neighbours move to the least of a and its neighbours
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # a and its smaller neighbours move to the least of them
        down = both.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``a``, ``root``: each vertex of an edge (``a``, ``b``) that isn't its component's least, and that least vertex.

    Runs until a round changes nothing (rounds grow with the logarithm of the longest path). Each round is
    written to the shared folder, so lineage stays short. Null vertices and loops are ignored; repeated
    edges count once; no edges give no rows.
    """
    now = scratch.keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        after = scratch.keep(_star(_star(now, True), False))
        seen = state(after)
        scratch.drop(now)
        now = after
        if seen == before:
            break
        before = seen
    return now.select("a", F.col("b").alias("root"))

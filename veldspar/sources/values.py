"""An append-only value log in segments: pointers, checks by CRC-32, tombstones and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.scalars import record_bytes

SEGMENT_BYTES = 1 << 30


def append(values: DataFrame, order: str = "seq", by: str = "namespace", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``values`` (``value`` binary) with ``segment``, ``offset``, ``length``, ``crc``, in ``order`` within ``by``.

    Segments are cut by the running sum of record sizes; a record lies in the segment in which it begins.
    """
    size = record_bytes("value")
    before = F.coalesce(F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = values.withColumn("_at", before)
    return out.select(
        *values.columns, F.floor(F.col("_at") / segment_bytes).cast("long").alias("segment"), (F.col("_at") % segment_bytes).cast("long").alias("offset"),
        F.octet_length("value").cast("long").alias("length"), F.crc32("value").alias("crc"),
    )


def read(log: DataFrame, pointers: DataFrame, by: str = "namespace") -> DataFrame:
    """Values at pointers (``by``, ``segment``, ``offset``) with ``valid``: whether the check agrees."""
    return pointers.join(log, [by, "segment", "offset"]).withColumn("valid", F.crc32("value") == F.col("crc"))


def stats(log: DataFrame, dead: DataFrame | None = None, by: str = "namespace") -> DataFrame:
    """Records, bytes, segments and live and dead bytes of each namespace; ``dead`` are deleted pointers."""
    rows = log.withColumn("b", record_bytes("value"))
    gone = None if dead is None else dead.select(by, "segment", "offset").distinct().withColumn("_dead", F.lit(True))
    rows = rows.withColumn("_dead", F.lit(None).cast("boolean")) if gone is None else rows.join(gone, [by, "segment", "offset"], "left")
    is_dead = F.coalesce("_dead", F.lit(False))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("appends"), F.sum("b").alias("bytes"), F.countDistinct("segment").alias("segments"),
        F.coalesce(F.sum(F.when(~is_dead, F.col("b"))), F.lit(0)).alias("live_bytes"), F.coalesce(F.sum(F.when(is_dead, F.col("b"))), F.lit(0)).alias("dead_bytes"),
    )

"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.runtime import Scratch


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (id, text): ``doc_id``, ``keep_id``, ``group_size``, ``is_kept``.

    ``keep_id`` is the smallest id of the rows with the same bytes, ``group_size`` how many distinct ids have them,
    ``is_kept`` whether the row is the one that stays. Null texts are never copies of one another: each stays.
    A null id counts as larger than any other and never as kept beside one; rows with null id and equal text are
    one row. Empty texts are copies like any other; repeated rows count once; an empty table gives an
    empty result. Other columns are ignored, whatever their names.

    Only ids and 16-byte hashes of all rows are shuffled. Texts move only for the rows of a hash that occurs
    more than once, and meet just their group's first text, so a group of any size needs no more memory; a text
    that differs (a collision) is grouped again by hash and bytes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    hashed = rows.select("doc_id", F.unhex(F.md5("text")).alias("h"))
    scratch = Scratch(docs.sparkSession)
    ids = scratch.keep(hashed.where("h is not null").dropDuplicates(["doc_id", "h"]))
    groups = scratch.keep(
        ids.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").withColumn("n", F.col("n").cast("long"))
    )
    lone = rows.where("text is null").select("doc_id").distinct()
    single = ids.join(groups, "h", "left_anti").select("doc_id")
    alone = lone.select("doc_id").unionByName(single).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("is_kept")
    )
    # the texts of groups alone
    members = (
        rows.where("text is not null").withColumn("h", F.unhex(F.md5("text")))
        .join(scratch.small(groups), "h")
    )
    heads = members.where("doc_id <=> keep_id").groupBy("h").agg(F.min("text").alias("first"))
    judged = scratch.keep(
        members.join(heads, "h").select("h", "doc_id", "keep_id", "n", F.col("text").eqNullSafe(F.col("first")).alias("same"))
    )
    grouped = judged.select("doc_id", "keep_id", F.col("n").alias("group_size")).distinct()
    clash = scratch.keep(judged.where("not same").select("h").distinct())
    if not clash.isEmpty():  # two contents of one hash: its rows are grouped by their bytes
        clash = scratch.small(clash)
        sound = judged.join(clash, "h", "left_anti").select("doc_id", "keep_id", F.col("n").alias("group_size")).distinct()
        exact = members.join(clash, "h", "left_semi").select("h", "text", "doc_id").distinct()
        exact = exact.groupBy("h", "text").agg(F.min("doc_id").alias("keep_id"), F.collect_list(F.struct("doc_id")).alias("ids"))
        exact = exact.select(F.explode("ids").alias("one"), "keep_id", F.size("ids").cast("long").alias("group_size"))
        grouped = sound.unionByName(exact.select("one.doc_id", "keep_id", "group_size"))
    return grouped.withColumn("is_kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).unionByName(alone)


EXACT_SQL = """
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS is_kept
FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
WINDOW w AS (PARTITION BY text)
UNION ALL
SELECT DISTINCT doc_id, doc_id, 1, TRUE FROM documents WHERE text IS NULL
"""

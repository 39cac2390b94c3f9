"""Incremental indexing: classify scanned files against stored assets, then apply the difference.

All steps are equi-joins on (dataset, asset), so one partitioning of the assets serves classification, archiving
and upsert; file contents are read for changed files alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.operators import upsert as u

KEY = ["dataset_id", "asset_id"]


def classify(files: DataFrame, assets: DataFrame) -> DataFrame:
    """Scanned files and stored assets in one row each with ``state``.

    ``new`` (not stored), ``changed`` (another hash), ``revived`` (archived, seen again), ``unchanged``, or ``removed``
    (live, not seen); archived assets that aren't seen are ``gone`` already. ``files``: dataset_id, asset_id, path,
    md5, size, mod_time.
    """
    f = files.select(*KEY, F.struct("path", "md5", "size", "mod_time").alias("f"))
    a = assets.select(*KEY, F.struct("path", "md5", "size", "mod_time").alias("a"), F.col("archived").alias("_archived"))
    state = (
        F.when(F.col("a").isNull(), "new")
        .when(F.col("f").isNull(), F.when(F.col("_archived") == 0, "removed").otherwise("gone"))
        .when(F.col("_archived") != 0, "revived")
        .when(F.col("f.md5").eqNullSafe(F.col("a.md5")), "unchanged")
        .otherwise("changed")
    )
    both = f.join(a, KEY, "full_outer").withColumn("state", state).withColumn("x", F.coalesce("f", "a"))
    return both.select(*KEY, "x.path", "x.md5", "x.size", "x.mod_time", "state")


def stats(classified: DataFrame) -> DataFrame:
    """Files total, changed, unchanged and removed by dataset."""
    one = F.col("state")
    return classified.groupBy("dataset_id").agg(
        F.count_if(~one.isin("removed", "gone")).alias("total"), F.count_if(one.isin("new", "changed", "revived")).alias("changed"),
        F.count_if(one == "unchanged").alias("unchanged"), F.count_if(one == "removed").alias("removed"),
    )


def skip_known_content(files: DataFrame, assets: DataFrame) -> DataFrame:
    """Files whose content no live asset of their dataset has (by hash): indexing by content instead of name."""
    return files.join(assets.where("archived = 0").select("dataset_id", "md5").distinct(), ["dataset_id", "md5"], "left_anti")


def matches_upstream(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """Files that an upstream asset of the same path has already: equal hash (any case), or equal size and no other hash."""
    up = upstream.select("dataset_id", "path", F.lower("md5").alias("_md5"), F.col("size").alias("_size"))
    same = F.lower("md5").eqNullSafe(F.col("_md5")) | ((F.col("size") == F.col("_size")) & F.coalesce(F.col("_md5") == "", F.lit(True)))
    return files.join(up, ["dataset_id", "path"]).where(same).select(*files.columns)


@dataclass
class Delta:
    """What an indexing run changes: the next asset table, changed and removed assets, and the counters."""

    assets: DataFrame
    changed: DataFrame
    removed: DataFrame
    counters: DataFrame


def index_assets(files: DataFrame, assets: DataFrame, counters: DataFrame) -> Delta:
    """Apply a scan to the asset table: one new SCN for each changed or removed asset, in order of asset."""
    found = classify(files, assets)
    moved = u.allocate_scn(found.where("state in ('new', 'changed', 'revived', 'removed')"), counters, ["asset_id"])
    rows = moved.withColumn("archived", F.when(F.col("state") == "removed", 1).otherwise(0))
    following = u.upsert(assets, rows, KEY)
    return Delta(
        following, rows.where("state <> 'removed'"), rows.where("state = 'removed'"),
        u.raise_scn(counters, rows.select("dataset_id", F.col("scn").alias("last_scn"))),
    )


def index_documents(delta: Delta, docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Next document table: removed assets' documents archived, changed assets' replaced by ``fragments``.

    ``fragments`` has the columns of ``docs`` but ``scn`` and ``archived``, which come from the asset.
    """
    stamped = fragments.join(delta.changed.select(*KEY, "scn"), KEY).withColumn("archived", F.lit(0).cast(docs.schema["archived"].dataType))
    gone = delta.removed.select(*KEY, F.col("scn").alias("_scn"))
    kept = docs.join(delta.changed.select(*KEY), KEY, "left_anti").join(gone, KEY, "left")
    hit = F.col("_scn").isNotNull()
    kept = kept.withColumn("archived", F.when(hit, 1).otherwise(F.col("archived")).cast(docs.schema["archived"].dataType))
    kept = kept.withColumn("scn", F.coalesce("_scn", "scn"))
    return kept.select(*docs.columns).unionByName(stamped.select(*docs.columns))

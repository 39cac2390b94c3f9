"""Summaries and integrity: each table is aggregated once by dataset, then the small results are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def root_summary(roots: DataFrame, assets: DataFrame, docs: DataFrame, state: DataFrame) -> DataFrame:
    """One row a root with counts, sizes, latest asset and document facts and sync cursors.

    ``docs`` has ``content_chars`` (its content's characters) and ``embedding_model``. Roots without rows have
    zeros, and null where there is no latest row. Three aggregations, each with partial sums before its shuffle.
    """
    live, gone = F.col("archived") == 0, F.col("archived") == 1
    a = assets.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("assets"), F.count_if(gone).alias("assets_archived"), F.count_if(live).alias("assets_active"),
        F.sum("size").alias("assets_size"), F.max("mod_time").alias("last_asset_mod_time"), F.max_by("md5", "mod_time").alias("last_asset_md5"),
    )
    d = docs.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(gone).alias("docs_archived"), F.count_if(live).alias("docs_active"),
        F.avg(F.when(live, F.col("content_chars"))).alias("avg_doc_len"), F.max("scn").alias("last_doc_scn"),
        F.max_by("embedding_model", F.when(F.col("embedding_model") != "", F.struct("scn", "id"))).alias("embedding_model"),
    )
    s = state.groupBy("dataset_id").agg(
        F.max("last_scn").alias("last_sync_scn"), F.concat_ws(",", F.array_sort(F.collect_set("shadow_table"))).alias("upstream_shadow")
    )
    out = roots.join(a, "dataset_id", "left").join(d, "dataset_id", "left").join(s, "dataset_id", "left")
    zero = ["assets", "assets_archived", "assets_active", "assets_size", "docs", "docs_archived", "docs_active", "avg_doc_len", "last_sync_scn"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


def orphan_documents(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """Documents whose asset is unknown."""
    return docs.join(assets.select("dataset_id", "asset_id"), ["dataset_id", "asset_id"], "left_anti")


def orphan_assets(assets: DataFrame, docs: DataFrame) -> DataFrame:
    """Assets without a document."""
    return assets.join(docs.select("dataset_id", "asset_id"), ["dataset_id", "asset_id"], "left_anti")


def check_integrity(assets: DataFrame, docs: DataFrame) -> DataFrame:
    """By dataset: totals, archived and active rows, orphans both ways, documents without a vector.

    Both tables are counted by asset first, and one full join of those counts gives orphans both ways.
    """
    d = docs.groupBy("dataset_id", "asset_id").agg(
        F.count(F.lit(1)).alias("d"), F.count_if(F.col("archived") == 1).alias("da"), F.count_if(F.col("embedding_missing")).alias("dm")
    )
    a = assets.groupBy("dataset_id", "asset_id").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("archived") == 1).alias("aa"))
    both = a.join(d, ["dataset_id", "asset_id"], "full_outer")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.groupBy("dataset_id").agg(
        total("d").alias("docs"), total("da").alias("docs_archived"), total(F.col("d") - F.col("da")).alias("docs_active"),
        total("a").alias("assets"), total("aa").alias("assets_archived"), total(F.col("a") - F.col("aa")).alias("assets_active"),
        total(F.when(F.col("a").isNull(), F.col("d"))).alias("orphan_docs"), total(F.when(F.col("d").isNull(), F.col("a"))).alias("orphan_assets"),
        total("dm").alias("missing_embeddings"),
    )


def is_empty(docs: DataFrame, dataset: str) -> bool:
    """Whether a dataset has no document; reads until the first."""
    return docs.where(F.col("dataset_id") == dataset).isEmpty()


def known_md5s(assets: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Live assets' content hashes by dataset; with ``wanted`` (md5) only those, trimmed and distinct."""
    live = assets.where("archived = 0").select("dataset_id", "md5").distinct()
    if wanted is None:
        return live
    return live.join(wanted.select(F.trim("md5").alias("md5")).where("md5 <> ''").distinct(), "md5", "left_semi")


def asset_meta(assets: DataFrame) -> DataFrame:
    """Hash and size of live assets by path."""
    return assets.where("archived = 0").select("dataset_id", "path", "md5", "size")


def paths_to_roots(docs: DataFrame) -> DataFrame:
    """One row a path with the root that wrote it last (greatest root name)."""
    return docs.groupBy("path").agg(F.max("dataset_id").alias("root"))


def joined_content(pages: DataFrame, text: str, order: str) -> DataFrame:
    """Content of each ``page`` in order, and its bytes."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    out = pages.groupBy("page").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("content"))
    return out.withColumn("n_bytes", F.octet_length("content").cast("long"))

"""Engine tables derived from general tables: assets and documents, vectors, change log, cursors, roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions.scalars import checksum32, fragment_name
from veldspar.operators.splitters import size_chunks
from veldspar.runtime import table


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``emb_asset`` from documents: the source is the dataset, language and id make the path."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.col("source").alias("dataset_id"), path.alias("asset_id"), path.alias("path"), F.md5("text").alias("md5"),
        F.octet_length("text").cast("long").alias("size"), F.timestamp_seconds("doc_id").alias("mod_time"),
        (F.col("doc_id") + 1).alias("scn"), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0).alias("archived"),
    )


ASSETS_SQL = """
  SELECT source AS dataset_id, lang || '/' || doc_id || '.txt' AS asset_id, lang || '/' || doc_id || '.txt' AS path, md5(text) AS md5,
    strlen(text)::bigint AS size, make_timestamp(doc_id * 1000000) AS mod_time, doc_id + 1 AS scn,
    CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS archived
  FROM documents"""


def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``emb_docs`` from documents: chunks of 4,096 bytes with ids and checksums."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = size_chunks(d.select(
        F.col("source").alias("dataset_id"), path.alias("asset_id"), (F.col("doc_id") + 1).alias("scn"),
        F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0).alias("archived"), "text",
    ))
    return rows.withColumn("id", fragment_name(F.lit(""), "asset_id", "start", "end"))


CHUNKS_SQL = """
  SELECT source AS dataset_id, asset_id, scn, archived, s AS start, least(s + 4096, strlen(text))::bigint AS "end",
    asset_id || ':' || s || '-' || least(s + 4096, strlen(text)) AS id, encode(text)[s + 1:s + 4096] AS chunk
  FROM (SELECT source, text, lang || '/' || doc_id || '.txt' AS asset_id, doc_id + 1 AS scn, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS archived,
    unnest(range(0, strlen(text)::bigint, 4096)) AS s FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``emb_docs`` from embeddings: the label is the dataset."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("string").alias("dataset_id"), F.col("vec_id").alias("id"), F.concat(F.lit("v/"), (F.col("vec_id") % 5).cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".txt")).alias("path"),
        "embedding", F.when(F.col("vec_id") % 11 == 0, 1).otherwise(0).alias("archived"),
    )


VECTORS_SQL = """
  SELECT label::varchar AS dataset_id, vec_id AS id, 'v/' || (vec_id % 5) || '/' || vec_id || '.txt' AS path, embedding,
    CASE WHEN vec_id % 11 = 0 THEN 1 ELSE 0 END AS archived FROM embeddings"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_shadow_log`` from events: four datasets, the user is the document, the payload is JSON."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    asset = F.concat(F.lit("a"), (F.col("user_id") % 50).cast("string"))
    meta = F.to_json(F.struct(asset.alias("asset_id"), F.concat(F.lit("docs/"), asset, F.lit(".txt")).alias("path"), F.md5("props").alias("md5")))
    payload = F.to_json(F.struct(F.col("props").alias("content"), meta.alias("meta"), F.lit("simple").alias("embedding_model")))
    return e.select(
        (F.col("user_id") % 4).cast("string").alias("dataset_id"), F.lit("shadow_vec_docs").alias("shadow_table"), (F.col("event_id") + 1).alias("scn"),
        op.alias("op"), F.col("user_id").cast("string").alias("document_id"), payload.alias("payload"), F.col("ts").alias("created_at"),
    )


LOG_SQL = """
  SELECT (user_id % 4)::varchar AS dataset_id, event_id + 1 AS scn,
    CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
    user_id::varchar AS document_id, props AS content, 'a' || (user_id % 50) AS asset_id, md5(props) AS md5
  FROM events"""


def cursors(spark: SparkSession, datasets: DataFrame, share: int = 2) -> DataFrame:
    """``vec_sync_state``: each dataset's log read up to 1 / ``share`` of its greatest SCN."""
    return datasets.groupBy("dataset_id").agg(F.floor(F.max("scn") / share).cast("long").alias("last_scn")).withColumn("shadow_table", F.lit("shadow_vec_docs"))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``emb_root``: one row a source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dataset_id")).distinct().withColumn("source_uri", F.concat(F.lit("/data/"), "dataset_id"))


__all__ = ["assets", "chunked_documents", "vectors", "change_log", "cursors", "roots", "checksum32"]

"""Pulling a change log as a stream: each micro-batch is applied to the snapshots of documents and assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veldspar.operators.matching import PathRules
from veldspar.plans.changelog import apply_assets, apply_log
from veldspar.sources.snapshots import SnapshotStore, schema

DOCS = "dataset_id string, id string, asset_id string, path string, md5 string, content string, meta string, embedding array<float>, embedding_model string, scn long, archived int"
ASSETS = "dataset_id string, asset_id string, path string, md5 string, size long, mod_time timestamp, scn long, archived int"


def start_sync(
    spark: SparkSession, log_path: str, store: SnapshotStore, checkpoint: str, rules: PathRules | None = None,
    files_per_batch: int = 1, every: str | None = None,
) -> StreamingQuery:
    """Follow a folder of log files; documents go to ``synced_docs``, assets to ``synced_assets``, cursors to ``vec_sync_state``.

    Without ``every`` the stream ends when all files are read (a catch-up run). Entries at or below the cursor are
    skipped, so a batch that is repeated after a failure changes nothing. One query a checkpoint keeps a
    single writer.
    """

    def apply(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        docs, assets = (
            store.read(name) if store.current(name) else session.createDataFrame([], kind)
            for name, kind in (("synced_docs", DOCS), ("synced_assets", ASSETS))
        )
        state = store.read("vec_sync_state")
        assets = apply_assets(assets, batch, state, rules)
        docs, state = apply_log(docs, batch, state, rules)
        # tables before cursors: a crash in between repeats the batch, which changes nothing twice
        store.write("synced_assets", assets)
        store.write("synced_docs", docs)
        store.write("vec_sync_state", state)

    stream = spark.readStream.schema(schema("vec_shadow_log")).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

"""Tables as Parquet snapshots: every change writes a new folder, and a pointer file names the current one.

Readers see the old or the new snapshot, never a mixture; a failed write leaves the pointer alone.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Schemas of the engine's tables.
SCHEMAS = {
    "emb_asset": "dataset_id string, asset_id string, path string, md5 string, size long, mod_time timestamp, scn long, archived int",
    "emb_docs": "dataset_id string, id string, asset_id string, content string, meta string, embedding array<float>, embedding_model string, scn long, archived int",
    "emb_root": "dataset_id string, source_uri string, last_scn long, last_indexed_at timestamp",
    "emb_root_config": "dataset_id string, include_globs string, exclude_globs string, max_size_bytes long, updated_at timestamp",
    "vec_dataset_scn": "dataset_id string, last_scn long",
    "vec_sync_state": "dataset_id string, shadow_table string, last_scn long",
    "vec_shadow_log": "dataset_id string, shadow_table string, scn long, op string, document_id string, payload string, created_at timestamp",
}


def schema(name: str) -> T.StructType:
    """Schema of an engine table."""
    return T.StructType.fromDDL(SCHEMAS[name])


class SnapshotStore:
    """Named tables below one root folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self, name: str) -> str | None:
        """Folder of the current snapshot; None if the table doesn't exist."""
        p, fs = self._path(f"{self.root}/{name}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        """The table; one of ``SCHEMAS`` that doesn't exist yet is empty."""
        path = self.current(name)
        if path is None:
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.parquet(path)

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a snapshot and let the pointer name it; the new folder."""
        path = f"{self.root}/{name}/{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        made, fs = self._path(f"{self.root}/{name}/.CURRENT-{uuid.uuid4().hex}")
        stream = fs.create(made, True)
        stream.write(bytearray(path.encode()))
        stream.close()
        target, _ = self._path(f"{self.root}/{name}/CURRENT")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(made, target, options)
        return path

    def verify(self, name: str) -> list[str]:
        """Columns of the table's schema that the stored table lacks or has with another type."""
        have = {f.name: f.dataType for f in self.read(name).schema}
        return [f.name for f in schema(name) if have.get(f.name) != f.dataType]

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete all but the current and the newest ``keep`` snapshots; how many went."""
        folder, fs = self._path(f"{self.root}/{name}")
        now = self.current(name)
        found = sorted((s.getPath().toString() for s in fs.listStatus(folder) if s.isDirectory()), reverse=True)
        old = [p for p in found[keep:] if not (now or "").endswith(p.rpartition("/")[2])]
        for p in old:
            fs.delete(self._path(p)[0], True)
        return len(old)

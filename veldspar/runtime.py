"""Session helpers: table loading, shared scratch tables, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its materialised Parquet files stay below this many bytes.
BROADCAST_LIMIT = 32 << 20
#: Spark's setting by which the shuffle files of a query are removed when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_importable(spark: SparkSession) -> None:
    """Let local Python workers import this package whatever the working directory is.

    On a cluster the package is shipped the usual way (installed or ``--py-files``), so only local masters
    are touched.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent, and only on a local master, a folder of this machine is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="veldspar-scratch-")
    spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written to the shared folder; they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/veldspar-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return it as read back. The shuffle files it took are freed, since nothing reads them again."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def bytes(self, df: DataFrame) -> int:
        """Size of a kept table's files."""
        p, fs = self._fs(df._scratch_path)
        return fs.getContentSummary(p).getLength()

    def drop(self, *dfs: DataFrame) -> None:
        """Delete kept tables that no returned result reads any more."""
        for df in dfs:
            p, fs = self._fs(df._scratch_path)
            fs.delete(p, True)

    def small(self, df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
        """A kept table with a broadcast hint where its files are below ``limit``, else as it is."""
        return F.broadcast(df) if self.bytes(df) <= limit else df


def packed(df: DataFrame, columns: list[str] | None = None, name: str = "row") -> Column:
    """The row as one struct, so that columns beside it can't clash with its names."""
    columns = df.columns if columns is None else columns
    return F.struct(*(F.col(f"`{c}`") for c in columns) if columns else [F.lit(0).alias("none")]).alias(name)


def numbered(df: DataFrame, order: list[str], scratch: Scratch, name: str = "number") -> DataFrame:
    """``df`` with ``name``: each row's place (from 0) in ``order``, rows that tie in it numbered in any order.

    Rows are range-partitioned, sorted and numbered within their partition, and written; what precedes a partition
    is added from the partitions' counts (one number each), so no task sees more than its share of the rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = scratch.keep(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = {r.part: r.n for r in own.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    offsets = F.array(*map(F.lit, before or [0])).cast("array<long>")
    place = F.get(offsets, F.shiftright("_at", 33).cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1)
    return own.withColumn(name, place).drop("_at")

"""Files of any Hadoop file system as tables, filtered by path and size before contents are read."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions.scalars import file_uri, relative_path
from veldspar.operators.lexical import list_files, read
from veldspar.operators.matching import PathRules
from veldspar.runtime import ensure_importable


def _files(spark: SparkSession, root: str) -> DataFrame:
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    bare = base.partition("://")[2] if "://" in base else base.removeprefix("file:")
    bare = bare if bare.startswith("/") else "/" + bare.partition("/")[2]
    return rows.withColumn("uri", F.col("path")).withColumn("full_path", plain).withColumn("path", relative_path(plain, bare))


def _local(uri: str) -> tuple:
    """File system and path of a file's URI."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem(), "/" + (rest if scheme == "file" else uri).lstrip("/")
    return fs.FileSystem.from_uri(quote(uri, safe=":/@"))


def contents(rows: DataFrame, uri: str = "uri", at_once: int = 32 << 20) -> DataFrame:
    """``rows`` with ``content``: the bytes of the file that ``uri`` names, read by the tasks, that of no other file."""
    ensure_importable(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches):
        for batch in batches:
            data, begin, held = [], 0, 0
            for k, name in enumerate(batch.column(uri).to_pylist()):
                system, path = _local(name)
                with system.open_input_stream(path) as f:
                    data.append(f.read())
                held += len(data[-1])
                if held >= at_once or k + 1 == batch.num_rows:
                    part = batch.slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "content"])
                    data, begin, held = [], k + 1, 0

    return rows.mapInArrow(run, schema)


def scan(spark: SparkSession, root: str, rules: PathRules | None = None, dataset: str = "") -> DataFrame:
    """``dataset_id``, ``asset_id``, ``path`` (below root), ``md5``, ``size``, ``mod_time``, ``content`` of a root's files.

    Path and size rules are tested on the listing, which reads no contents; then those of the files that are left are
    read, dealt out anew so that few tasks don't hold them all.
    """
    rows = _files(spark, root).select(F.col("uri"), "path", "length", "modificationTime")
    if rules is not None:
        rows = rows.where(rules.kept("path", "length"))
    rows = contents(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"))
    return rows.select(
        F.lit(dataset).alias("dataset_id"), F.col("path").alias("asset_id"), "path", F.md5("content").alias("md5"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), "content",
    )


def up_to_date(spark: SparkSession, root: str, last_run) -> bool:
    """Whether no file below root is newer than the last run (a snapshot taken then can be used)."""
    newest = _files(spark, root).agg(F.max("modificationTime").alias("m")).first().m
    return newest is None or newest <= last_run


def listing(spark: SparkSession, root: str, include=(), exclude=(), folder: str = "", recursive: bool = True, limit: int | None = None) -> DataFrame:
    """``path``, ``uri``, ``size``, ``mod_time`` of files, in order of path; contents aren't read."""
    rows = _files(spark, root).select("path", file_uri("full_path").alias("uri"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))
    return list_files(rows, include, exclude, folder, recursive, limit)


def read_file(spark: SparkSession, root: str, path: str, **selection) -> DataFrame:
    """Part of one file (see ``operators.lexical.read``); a path that leaves the root is an error."""
    parts = []
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            if not parts:
                raise ValueError(f"{path} leaves the root")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    inside = "/".join(parts)
    one = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{inside}")
    return read(one.select(F.lit(inside).alias("path"), F.col("content").cast("string").alias("text")), **selection)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A table over JDBC, read in ``parts`` ranges of ``key`` where given; needs the database's driver jar."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def driver_of(dsn: str) -> str:
    """Kind of database that a data source name means: mysql, postgres, bigquery or sqlite."""
    low = dsn.lower()
    if low.startswith("bigquery:"):
        return "bigquery"
    if low.startswith(("postgres:", "postgresql:")):
        return "postgres"
    if low.startswith(("mysql:", "mariadb:")) or "@tcp(" in low or "@unix(" in low:
        return "mysql"
    return "sqlite"

"""Changes to tables as new DataFrames: upsert, insert if absent, archive, prune, reset, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.runtime import Scratch, numbered

ASSET_KEY, DOC_KEY, STATE_KEY = ["dataset_id", "asset_id"], ["dataset_id", "id"], ["dataset_id", "shadow_table"]


def last_per_key(rows: DataFrame, key: list[str], order: str = "scn") -> DataFrame:
    """The row of greatest ``order`` of each key (a repeated greatest one counts once)."""
    best = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def upsert(current: DataFrame, new: DataFrame, key: list[str], order: str | None = "scn") -> DataFrame:
    """``current`` with rows of ``new`` added, replacing those of the same key; the last of ``new`` wins.

    Null keys equal nothing in the join, so such rows are only added.
    """
    if order is not None:
        new = last_per_key(new, key, order)
    return current.join(new.select(*key), key, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def insert_absent(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` whose key it lacks."""
    return current.unionByName(new.dropDuplicates(key).join(current.select(*key), key, "left_anti").select(*current.columns))


def replace_documents(docs: DataFrame, new: DataFrame) -> DataFrame:
    """All documents of the assets in ``new`` go; those of ``new`` come."""
    gone = new.select(*ASSET_KEY).distinct()
    return docs.join(gone, ASSET_KEY, "left_anti").select(*docs.columns).unionByName(last_per_key(new, DOC_KEY).select(*docs.columns))


def archive(rows: DataFrame, which: DataFrame, key: list[str], scn: Column | None = None) -> DataFrame:
    """Rows whose key is in ``which`` become archived, stamped with ``scn`` where given."""
    marked = rows.join(which.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    out = marked.withColumn("archived", F.when(F.col("_hit"), F.lit(1)).otherwise(F.col("archived")).cast(rows.schema["archived"].dataType))
    if scn is not None:
        out = out.withColumn("scn", F.when(F.col("_hit"), scn).otherwise(F.col("scn")).cast(rows.schema["scn"].dataType))
    return out.select(*rows.columns)


def prune(rows: DataFrame, dataset: str, before_scn: int | None = None) -> DataFrame:
    """Rows without a dataset's archived ones; with ``before_scn`` only up to it (0 or less changes nothing)."""
    gone = (F.col("dataset_id") == dataset) & (F.col("archived") == 1)
    if before_scn is not None:
        if before_scn <= 0:
            return rows
        gone = gone & (F.col("scn") <= before_scn)
    return rows.where(~F.coalesce(gone, F.lit(False)))


def reset(rows: DataFrame, dataset: str) -> DataFrame:
    """Rows of all other datasets."""
    return rows.where(~F.col("dataset_id").eqNullSafe(F.lit(dataset)))


def raise_scn(counters: DataFrame, new: DataFrame, key: str = "dataset_id", column: str = "last_scn") -> DataFrame:
    """Counters raised to ``new``'s where those are larger; they never fall. Unknown keys are added."""
    top = new.groupBy(key).agg(F.max(column).alias("_new"))
    return counters.join(top, key, "full_outer").select(key, F.greatest(column, "_new").alias(column))


def allocate_scn(rows: DataFrame, counters: DataFrame, order: list[str], by: str = "dataset_id") -> DataFrame:
    """``rows`` with ``scn``: the dataset's counter plus 1, 2, ... by distinct ``order`` value (one a asset)."""
    number = F.dense_rank().over(Window.partitionBy(by).orderBy(*order))
    base = counters.select(by, F.col("last_scn").alias("_last"))
    return rows.drop("scn").join(base, by, "left").withColumn("scn", (F.coalesce("_last", F.lit(0)) + number).cast("long")).drop("_last")


def append_events(log: DataFrame, new: DataFrame, order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Events numbered after the log's greatest SCN in ``order``; ``id`` is the number as text.

    Numbering is one sequence over all new events, made by ranges of ``order`` (see ``runtime.numbered``).
    """
    last = log.agg(F.coalesce(F.max("scn"), F.lit(0))).first()[0]
    rows = numbered(new, order, scratch or Scratch(new.sparkSession), "scn").withColumn("scn", F.col("scn") + (last + 1))
    return rows.withColumn("id", F.col("scn").cast("string"))


def claim_jobs(jobs: DataFrame, n: int, worker: str) -> DataFrame:
    """All jobs, the ``n`` oldest pending ones claimed by ``worker`` (``n`` is the size of a claim)."""
    chosen = jobs.where("status = 'pending'").orderBy("enqueued_at", "id").limit(n).select("id", F.lit(True).alias("_mine"))
    out = jobs.join(chosen, "id", "left")
    return out.withColumn("status", F.when(F.col("_mine"), "claimed").otherwise(F.col("status"))).withColumn(
        "worker", F.when(F.col("_mine"), worker).otherwise(F.col("worker"))
    ).select(*jobs.columns)

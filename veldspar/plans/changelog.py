"""Change log: difference of snapshots as a log, its reduction to the latest state, push and pull between stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.scalars import asset_of, hex_of_vector, vector_of_hex
from veldspar.operators import upsert as u
from veldspar.operators.matching import PathRules, sync_filter

PAYLOAD = "struct<id:string,content:string,meta:string,embedding:string,embedding_model:string,archived:int>"


def pending(log: DataFrame, state: DataFrame) -> DataFrame:
    """By dataset: entries above its cursor (0 if it has none), and the greatest SCN among them."""
    rows = log.join(state.groupBy("dataset_id").agg(F.max("last_scn").alias("_last")), "dataset_id", "left")
    new = F.col("scn") > F.coalesce("_last", F.lit(0))
    return rows.groupBy("dataset_id").agg(F.count_if(new).alias("pending"), F.coalesce(F.max(F.when(new, F.col("scn"))), F.lit(0)).alias("max_scn"))


def diverged(log: DataFrame, state: DataFrame) -> DataFrame:
    """Cursors above 0 whose entry the log doesn't have."""
    return state.where("last_scn > 0").join(log.select("dataset_id", F.col("scn").alias("last_scn")), ["dataset_id", "last_scn"], "left_anti").select(*state.columns)


def batches(log: DataFrame, size: int) -> DataFrame:
    """``log`` with ``batch``: groups of ``size`` distinct SCNs of a dataset in order; one SCN is never split."""
    number = F.dense_rank().over(Window.partitionBy("dataset_id").orderBy("scn"))
    return log.withColumn("batch", F.floor((number - 1) / size).cast("long"))


def batch_counters(batched: DataFrame) -> DataFrame:
    """Inserts, updates, deletions and SCN range of each batch."""
    op = F.lower("op")
    return batched.groupBy("dataset_id", "batch").agg(
        *[F.count_if(op == k).alias(f"{k}s") for k in ("insert", "update", "delete")], F.min("scn").alias("min_scn"), F.max("scn").alias("max_scn")
    )


def _entries(log: DataFrame, rules: PathRules | None) -> DataFrame:
    """Entries with their payload ``p``, document ``id`` (the payload's, else the entry's), asset ``a``, and what they do.

    ``gone`` are deletions, which rules never filter; ``kept`` are inserts and updates that pass them.
    """
    rows = log.withColumn("p", F.from_json("payload", PAYLOAD))
    rows = rows.withColumn("id", F.coalesce(F.nullif(F.col("p.id"), F.lit("")), "document_id")).withColumn("a", asset_of("p.meta", "id"))
    gone = F.lower("op") == "delete"
    return rows.withColumn("gone", gone).withColumn("kept", ~gone & sync_filter(rules, F.col("a.path"), F.col("p.meta"), "op"))


def _folded(entries: DataFrame, key: list, kept: Column, value: Column) -> DataFrame:
    """By key: ``last`` (SCN and value of its last entry that is kept) and ``dead`` (SCN of its last deletion).

    These two decide, whatever came before them and in whatever parts a log is read: one aggregation with partial
    results before its shuffle, and entries aren't sorted.
    """
    return entries.where(kept | F.col("gone")).groupBy("dataset_id", *key).agg(
        F.max(F.when(kept, F.col("scn"))).alias("at"), F.max_by(value, F.when(kept, F.col("scn"))).alias("last"),
        F.max(F.when(F.col("gone"), F.col("scn"))).alias("dead"),
    )


def _fold_documents(log: DataFrame, rules: PathRules | None) -> DataFrame:
    return _folded(_entries(log, rules), ["id"], F.col("kept"), F.struct("p", "a"))


def _fold_assets(log: DataFrame, rules: PathRules | None) -> DataFrame:
    entries = _entries(log, rules).where("a.asset_id <> ''").withColumn("asset_id", F.col("a.asset_id"))
    return _folded(entries, ["asset_id"], F.col("kept") & (F.col("a.path") != "") & (F.col("a.md5") != ""), F.col("a"))


def _dead() -> Column:
    return F.coalesce(F.col("dead") >= F.col("at"), F.lit(False))


def _document_columns() -> dict[str, Column]:
    last = {c: F.col(f"last.a.{c}") for c in ("asset_id", "path", "md5")} | {c: F.col(f"last.p.{c}") for c in ("content", "meta", "embedding_model")}
    last["embedding"] = vector_of_hex("last.p.embedding")
    archived = F.when(_dead(), 1).otherwise(F.coalesce("last.p.archived", F.lit(0)))
    return last | {"scn": F.greatest("at", F.when(_dead(), F.col("dead"))), "archived": archived}


def _asset_columns() -> dict[str, Column]:
    return {"path": F.col("last.path"), "md5": F.col("last.md5"), "scn": F.greatest("at", F.when(_dead(), F.col("dead"))), "archived": F.when(_dead(), 1).otherwise(0)}


def final_state(log: DataFrame, rules: PathRules | None = None) -> DataFrame:
    """Documents after the whole log: ``dataset_id``, ``id``, ``asset_id``, ``path``, ``md5``, ``content``, ``meta``, ``embedding``, ``embedding_model``, ``scn``, ``archived``.

    The last insert or update that passes ``rules`` gives the content, vector and ``archived``; a deletion at its SCN or
    later archives the document under the deletion's SCN, whatever the rules. A document that no such entry tells of has
    no row. The payload's id, where it has one, names the document.
    """
    names = ["asset_id", "path", "md5", "content", "meta", "embedding", "embedding_model", "scn", "archived"]
    columns = _document_columns()
    return _fold_documents(log, rules).where("at is not null").select("dataset_id", "id", *(columns[c].alias(c) for c in names))


def asset_state(log: DataFrame, rules: PathRules | None = None) -> DataFrame:
    """Assets after the whole log: the last entry of any of its documents decides; a deletion archives the asset.

    Entries without a hash or filtered by ``rules`` leave assets alone; an asset that was only deleted has no row.
    """
    columns = _asset_columns()
    return _fold_assets(log, rules).where("at is not null").select("dataset_id", "asset_id", *(c.alias(n) for n, c in columns.items()))


def _unread(log: DataFrame, state: DataFrame) -> DataFrame:
    """Entries above the cursor of their dataset and table."""
    cursor = state.groupBy("dataset_id", "shadow_table").agg(F.max("last_scn").alias("_last"))
    fresh = log.join(cursor, ["dataset_id", "shadow_table"], "left").where(F.col("scn") > F.coalesce("_last", F.lit(0)))
    return fresh.select(*log.columns)


def _applied(stored: DataFrame, folded: DataFrame, key: list[str], columns: dict[str, Column], defaults: dict[str, Column]) -> DataFrame:
    """Stored rows after folded entries: an update replaces what it tells, a deletion archives a row there is."""
    folded = folded.withColumnsRenamed({c: f"_{c}" for c in key})
    on = F.lit(True)
    for c in key:
        on = on & (stored[c] == folded[f"_{c}"])
    both = stored.join(folded, on, "full_outer").where(F.col("at").isNotNull() | stored[key[0]].isNotNull())
    told, late = F.col("at").isNotNull(), F.col("dead").isNotNull()
    own = {"archived": F.when(late, 1).otherwise(stored["archived"]), "scn": F.when(late, F.col("dead")).otherwise(stored["scn"])}
    out = []
    for f in stored.schema.fields:
        c = f.name
        if c in key:
            x = F.coalesce(stored[c], F.col(f"_{c}"))
        else:
            new = columns.get(c, F.coalesce(stored[c], defaults.get(c, F.lit(None))))
            x = F.when(told, new).otherwise(own.get(c, stored[c]))
        out.append(x.cast(f.dataType).alias(c))
    return both.select(*out)


def apply_log(docs: DataFrame, log: DataFrame, state: DataFrame, rules: PathRules | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and cursors after the entries above the cursors: new contents replace, deletions archive.

    A deletion archives the stored document under its SCN, also where rules filter what came between; of an unknown
    document it does nothing. Filtered entries advance the cursor too. A log applied in parts, wherever it is parted,
    gives what it gives at once. ``docs`` may lack columns, and have others, which new documents have empty.
    """
    fresh = _unread(log, state)
    out = _applied(docs, _fold_documents(fresh, rules), u.DOC_KEY, _document_columns(), {})
    top = fresh.groupBy("dataset_id", "shadow_table").agg(F.max("scn").alias("last_scn"))
    names = ["dataset_id", "shadow_table", "last_scn"]
    raised = state.select(*names).unionByName(top).groupBy("dataset_id", "shadow_table").agg(F.max("last_scn").alias("last_scn"))
    return out, raised


def apply_assets(assets: DataFrame, log: DataFrame, state: DataFrame, rules: PathRules | None = None) -> DataFrame:
    """Assets after the entries above the cursors (before ``apply_log`` raises them).

    A new asset has size 0 and the present time where the table has such columns; a known one keeps its own.
    """
    defaults = {"size": F.lit(0), "mod_time": F.current_timestamp()}
    return _applied(assets, _fold_assets(_unread(log, state), rules), u.ASSET_KEY, _asset_columns(), defaults)


def snapshot_difference(before: DataFrame, after: DataFrame, key: list[str], last_scn: int = 0) -> DataFrame:
    """Log entries that turn one snapshot into another: ``op``, ``scn`` (after ``last_scn``), and the payload as JSON.

    Rows are compared by their JSON; an update of a row to itself is no change. SCNs number a dataset's changes
    in order of key.
    """
    rest = [c for c in after.columns if c not in key]
    b = before.select(*key, F.to_json(F.struct(*rest)).alias("_b"))
    a = after.select(*key, F.to_json(F.struct(*rest)).alias("_a"))
    both = a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    op = F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete").otherwise("update")
    number = F.row_number().over(Window.partitionBy(key[0]).orderBy(*key[1:]))
    return both.select(*key, op.alias("op"), (F.lit(last_scn) + number).cast("long").alias("scn"), F.coalesce("_a", "_b").alias("payload"))


def push_entries(docs: DataFrame, cursors: DataFrame) -> DataFrame:
    """Log entries for documents above a downstream cursor: archived ones as deletions, others as updates."""
    fresh = docs.join(cursors.select("dataset_id", "last_scn"), "dataset_id", "left").where(F.col("scn") > F.coalesce("last_scn", F.lit(0)))
    if "embedding" in docs.columns:  # vectors travel as the hexadecimal of their bytes
        fresh = fresh.withColumn("embedding", hex_of_vector("embedding"))
    payload = F.to_json(F.struct(*[c for c in docs.columns if c != "dataset_id"]))
    op = F.when(F.col("archived") != 0, "delete").otherwise("update")
    return fresh.select("dataset_id", F.lit("shadow_vec_docs").alias("shadow_table"), "scn", op.alias("op"), F.col("id").alias("document_id"), payload.alias("payload"))


def baseline(local: DataFrame, downstream: DataFrame) -> DataFrame:
    """By dataset, the SCN from which to push: the downstream's greatest, but not above the local cursor if that is set."""
    d = downstream.groupBy("dataset_id").agg(F.max("scn").alias("_down"))
    both = local.select("dataset_id", "last_scn").join(d, "dataset_id", "full_outer")
    down, mine = F.coalesce("_down", F.lit(0)), F.coalesce("last_scn", F.lit(0))
    return both.select("dataset_id", F.when(mine > 0, F.least(mine, down)).otherwise(down).alias("last_scn"))

"""Which runs of words occur more than once: packed exchange of hashes, shared by substring and suffix dedup.

A task sends, for each bucket of hash values, one row with the packed hashes, document ids and positions of
its texts' runs; a bucket's rows meet in one task, which sorts them and sends back the positions of values that
occur again. So the shuffle holds about 14 bytes for a run, and no row is made for a single run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.minhash import _groups
from veldspar.llm.words import anchors, run_hashes, text_buffer, word_hashes
from veldspar.runtime import Scratch, ensure_importable, numbered

PACKED = "bucket int, hashes binary, docs binary, places binary"
FLAGGED = "doc_id long, places binary"
#: Documents whose runs are packed together.
DOCS_AT_ONCE = 2000


def buckets_of(df: DataFrame) -> int:
    """Buckets for hash values: four to a shuffle partition, so that one fits in a task's memory."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, n: int):
    """A record batch with a row for each bucket; entries keep their order."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(n)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bucket = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    cols = []
    for x, width in ((hashes[order], 8), (docs[order].astype(np.int64), 8), (places[order].astype(np.uint32), 4)):
        offsets = pa.array((cuts * width).astype(np.int32))
        cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(x))]))
    ids = pa.array(bucket[cuts[:-1]].astype(np.int32) if len(bucket) else np.zeros(0, np.int32))
    return pa.RecordBatch.from_arrays([ids, *cols], names=["bucket", "hashes", "docs", "places"])


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=kind)


def by_document(docs: np.ndarray, values: np.ndarray):
    """Rows (doc_id, packed values) of entries sorted by document."""
    if not len(docs):
        return
    cuts = np.concatenate([[0], np.flatnonzero(docs[1:] != docs[:-1]) + 1, [len(docs)]])
    step = 50_000
    for k in range(0, len(cuts) - 1, step):
        at = cuts[k : k + step + 1]
        part = np.ascontiguousarray(values[at[0] : at[-1]].astype(np.uint32))
        offsets = pa.array(((at - at[0]) * 4).astype(np.int32))
        blob = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, offsets.buffers()[1], pa.py_buffer(part)])
        yield pa.RecordBatch.from_arrays([pa.array(docs[at[:-1]]), blob], names=["doc_id", "places"])


def _flag(batches, later: bool):
    for group in _groups(batches, 0):
        h, d, p = (_joined(group.column(c), k) for c, k in (("hashes", np.uint64), ("docs", np.int64), ("places", np.uint32)))
        order = np.argsort(h, kind="stable")
        same = h[order]
        same = same[1:] == same[:-1]
        again = np.zeros(len(h), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        at = order[again]
        h, d, p = h[at], d[at], p[at]
        if later:  # the lowest bit of a place: whether an earlier occurrence exists
            order = np.lexsort((p, d, h))
            h, d, p = h[order], d[order], p[order]
            after = np.concatenate([[False], h[1:] == h[:-1]])[: len(h)]
            p = p << np.uint32(1) | after
        order = np.lexsort((p, d))
        yield from by_document(d[order], p[order])


def repeated(packed: DataFrame, n: int, later: bool = False) -> DataFrame:
    """``doc_id`` and its ``places`` (a list of packed parts) whose values occur more than once."""
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        packed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket")
        .mapInArrow(lambda batches: _flag(batches, later), FLAGGED)
    )
    return found.groupBy("doc_id").agg(F.collect_list("places").alias("places"))


def places_of(parts: list[bytes]) -> np.ndarray:
    """Sorted places of a document."""
    return np.sort(np.frombuffer(b"".join(parts), dtype=np.uint32)).astype(np.int64)


def texts_of(docs: DataFrame) -> DataFrame:
    """One row an id: ``doc_id``, ``text``; rows without id or text are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")


def told_apart(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``texts_of`` with ids that no two rows share, and ``doc_id``, ``of`` (the row's own id) where ids had to change.

    Where an id repeats, rows are numbered in order of id and a hash of their text, so that the order of ids is kept.
    """
    rows = texts_of(docs)
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows, None
    rows = numbered(rows.withColumn("hash", F.xxhash64("text")), ["doc_id", "hash"], scratch)
    rows = rows.select(F.col("number").alias("doc_id"), "text", F.col("doc_id").alias("of"))
    return rows, rows.select("doc_id", "of")


def named(found: DataFrame, names: DataFrame | None) -> DataFrame:
    """Results of rows that ``told_apart`` made, under the rows' own ids."""
    if names is None:
        return found
    return found.join(names, "doc_id").select(*(F.col("of").alias(c) if c == "doc_id" else c for c in found.columns))


def anchored(docs: DataFrame, length: int, least: int, n: int) -> DataFrame:
    """Packed runs of ``length`` words chosen by winnowing, such that any passage of ``least`` words has one.

    A run is chosen if its hash is the least of some ``least - length + 1`` successive ones, so equal passages
    choose equal runs. Texts of fewer than ``least`` words have none.
    """
    ensure_importable(docs.sparkSession)
    width = least - length + 1

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(k, DOCS_AT_ONCE)
                words, at = word_hashes(*text_buffer(part.column(1)))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                hashes = run_hashes(words, length)
                chosen, owner = [], []
                for r in np.flatnonzero(np.diff(at) >= least):
                    mine = np.flatnonzero(anchors(hashes[at[r] : at[r + 1] - length + 1], width)) + at[r]
                    chosen.append(mine)
                    owner.append(np.full(len(mine), r))
                if chosen:
                    chosen, owner = np.concatenate(chosen), np.concatenate(owner)
                    yield pack(hashes[chosen], ids[owner], chosen - at[owner], n)

    return texts_of(docs).mapInArrow(run, PACKED)


def near_starts(places: np.ndarray, before: int, n_starts: int) -> np.ndarray:
    """Starts within ``before`` words before a place, or at it, that are below ``n_starts``."""
    if n_starts <= 0 or not len(places):
        return np.zeros(0, dtype=np.int64)
    edge = np.zeros(n_starts + 1, dtype=np.int32)
    np.add.at(edge, np.minimum(np.maximum(places - before, 0), n_starts), 1)
    np.add.at(edge, np.minimum(places + 1, n_starts), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def runs_of(starts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans (first, one past last) that windows of ``reach`` words at sorted ``starts`` cover together."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(starts[1:] > starts[:-1] + reach)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + reach


def with_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of the documents in a table of repeats, which grows with the corpus: a merge join at every size."""
    return texts_of(docs).join(found.hint("merge"), "doc_id")

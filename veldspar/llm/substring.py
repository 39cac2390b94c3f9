"""Substring dedup by level-wise doubling of repeated windows of words.

Windows of 25 words that occur more than once are extended to 50 words; those that occur again at 50 to 100,
and so on until none survive. At 25 words windows are chosen by winnowing, so that every repeated passage of twice
the length holds a chosen window; from 50 on every window is tested that may survive. So the spans reported, the words
that repeated windows of 50 words cover, and the levels are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.repeats import (
    PACKED, anchored, buckets_of, named, near_starts, pack, places_of, repeated, runs_of, told_apart, with_texts,
)
from veldspar.llm.words import mix, run_hashes, text_buffer, word_hashes
from veldspar.runtime import Scratch, ensure_importable

#: Words of the shortest repeated passage that is reported; half of it is the first level.
LEAST_WORDS = 50
SPANS = "doc_id long, start_word int, n_words int, removable_words int, words binary"


def _extend(batches, n: int, least: int):
    """All windows of ``least`` words near the repeated ones of half the length."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            words, at = word_hashes(*text_buffer(part.column("text")))
            hashes = run_hashes(words, least)
            ids, out = part.column("doc_id").to_numpy(zero_copy_only=False), []
            for r, places in enumerate(part.column("places").to_pylist()):
                starts = near_starts(places_of(places), least - least // 2, int(at[r + 1] - at[r]) - least + 1)
                out.append((hashes[starts + at[r]], np.full(len(starts), ids[r]), starts))
            if out:
                yield pack(*(np.concatenate(x) for x in zip(*out)), n)


def _spans(batches, least: int):
    """Covered spans of each document, and from twice ``least`` on the hashes of their words (32 bits each)."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            words, at = word_hashes(*text_buffer(part.column("text")))
            ids, out = part.column("doc_id").to_numpy(zero_copy_only=False), []
            for r, places in enumerate(part.column("places").to_pylist()):
                marked = places_of(places)
                starts = marked >> 1
                first, past = runs_of(np.unique(starts), least)
                a, z = runs_of(np.unique(starts[marked & 1 == 1]), least)
                later = np.zeros(int(at[r + 1] - at[r]) + 1, dtype=np.int32)
                np.add.at(later, a, 1)
                np.add.at(later, z, -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(later)[:-1] > 0)])
                for s, e in zip(first.tolist(), past.tolist()):
                    own = (words[at[r] + s : at[r] + e] >> np.uint64(32)).astype(np.uint32).tobytes() if e - s >= 2 * least else None
                    out.append((int(ids[r]), s, e - s, int(covered[e] - covered[s]), own))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out), types)],
                    names=["doc_id", "start_word", "n_words", "removable_words", "words"],
                )


def _double(batches, n: int, length: int):
    """All windows of ``length`` words of which both halves are repeated (where ``places`` tells the halves that are)."""
    for batch in batches:
        out, held = [], 0
        halves = batch.column("places").to_pylist() if "places" in batch.schema.names else [None] * batch.num_rows
        for content, words, places in zip(batch.column("content").to_pylist(), batch.column("words"), halves):
            hashes = run_hashes(mix(np.frombuffer(words.as_buffer(), dtype=np.uint32).astype(np.uint64)), length)
            starts = np.arange(len(hashes))
            if places is not None:
                alive = np.zeros(len(hashes) + length, dtype=bool)
                alive[places_of(places)] = True
                starts = starts[alive[: len(hashes)] & alive[length // 2 : length // 2 + len(hashes)]]
            out.append((hashes[starts], np.full(len(starts), content), starts))
            held += len(starts)
            if held >= 1_000_000:
                yield pack(*(np.concatenate(x) for x in zip(*out)), n)
                out, held = [], 0
        if out:
            yield pack(*(np.concatenate(x) for x in zip(*out)), n)


def _levels(spans: DataFrame, least: int, n: int, scratch: Scratch) -> DataFrame:
    """``content``, ``level``: the longest ``least`` * 2**k words of each distinct long span that occur again.

    Spans of equal words are one content; one that several spans have is repeated whole. Windows are told to occur again
    by those of the distinct contents alone, so copies add nothing to a level, and a level's windows are those of which
    both halves are left from the one before.
    """
    whole = F.expr(f"cast({least} * shiftleft(1, length(bin(n_words div {least})) - 1) as int)")
    contents = scratch.keep(
        spans.where("content is not null").groupBy("content")
        .agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words"), F.first("words").alias("words"))
    )
    levels = contents.where("n > 1").select("content", whole.alias("level"))
    length, alive = 2 * least, None
    while True:
        long = contents.where(F.col("n_words") >= length).select("content", "words")
        if alive is not None:
            long = long.join(alive.hint("merge"), "content")
        packed = long.mapInArrow(lambda b, k=length: _double(b, n, k), PACKED)
        after = scratch.keep(repeated(packed, n).withColumnRenamed("doc_id", "content"))
        if after.isEmpty():
            break
        levels = levels.unionByName(after.select("content", F.lit(length).alias("level")))
        length, alive = length * 2, after
    return levels.groupBy("content").agg(F.max("level").alias("level"))


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``start_word``, ``n_words``, ``removable_words``, ``level_words`` of each repeated span.

    A span is a maximal stretch of a text's words (parted by ASCII white space) that windows of
    ``least_words`` words cover which occur more than once in all texts, in another or the same one. Its
    ``removable_words`` are in windows that occur earlier too (by id, then place). ``level_words`` is the
    largest ``least_words`` * 2**k at which a window inside it still occurs more than once.

    Null and empty texts, texts of fewer words, and rows with a null id have no spans. Rows that repeat an id
    are texts of their own under the same id (in order of a hash of their text). Texts of any length are taken whole.
    Other columns are ignored; an empty table gives an empty result.
    Windows are told apart by 64-bit hashes of their words.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    ensure_importable(docs.sparkSession)
    n = buckets_of(docs)
    docs, own = told_apart(docs, scratch)
    half = least_words // 2
    found = scratch.keep(repeated(anchored(docs, half, least_words, n), n))
    windows = with_texts(docs, found).mapInArrow(lambda b: _extend(b, n, least_words), PACKED)
    marked = scratch.keep(repeated(windows, n, later=True))
    spans = with_texts(docs, marked).mapInArrow(lambda b: _spans(b, least_words), SPANS)
    spans = scratch.keep(spans.withColumn("content", F.when(F.col("words").isNotNull(), F.xxhash64("words"))))
    scratch.drop(found, marked)
    levels = scratch.keep(_levels(spans, least_words, n, scratch))
    found = spans.select("doc_id", "start_word", "n_words", "removable_words", "content").join(scratch.small(levels), "content", "left")
    level = F.coalesce("level", F.lit(least_words)).cast("int").alias("level_words")
    return named(found.select("doc_id", "start_word", "n_words", "removable_words", level), own)

"""Suffix-array dedup by threshold-bounded expansion of suffix intervals.

Winnowing picks anchors, runs of 12 words such that any passage of 50 words holds one. An anchor that
occurs again takes its context along, the words of every 50-word passage that could hold it, to the task of
its hash value. There the distinct contexts make one text, whose suffixes (sorted as deep as the least length
needs) give its Burrows-Wheeler transform. From the interval of all suffixes on, intervals are extended backward,
breadth first: an extension that ends at a boundary not met before gives the common prefix length there, so lengths
come out by increasing value. Expansion stops at the least length, and neighbours whose boundary isn't met by then
share at least so many words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.minhash import _groups
from veldspar.llm.repeats import anchored, buckets_of, named, places_of, repeated, runs_of, told_apart, with_texts
from veldspar.llm.words import run_hashes, text_buffer, word_hashes
from veldspar.runtime import Scratch, ensure_importable

LEAST_WORDS, ANCHOR_WORDS = 50, 12
CONTEXTS = "bucket int, lengths binary, docs binary, firsts binary, words binary"


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` symbols (at least) that begin there, by doubling of ranks."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(text), 1
    order = np.argsort(rank, kind="stable")
    while k < depth and n:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        k *= 2
        if fresh[-1] == n - 1:
            break
    return order


def transform(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a text, and of each of its places the row of the suffix one symbol longer.

    ``transform[k]`` is the symbol before the suffix of row ``k`` (the text's last before its first). The longer suffix
    stands where the symbol's equals begin, after as many rows as equals come before it: the stable sorting of the
    transform gives both at once.
    """
    symbols = text[order - 1]
    rows = np.empty(len(text), dtype=np.int64)
    rows[np.argsort(symbols, kind="stable")] = np.arange(len(text))
    return symbols, rows


def bounded_common_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and for each neighbour pair the common prefix length, ``least`` standing for so many or more.

    Symbol 0 separates texts and equals nothing, itself included; the text ends with one. A queue holds the intervals
    of rows that share a prefix, shortest first, beginning with that of the empty prefix. Each is extended backward by
    every symbol that the transform has in it; where an extended interval ends at a boundary not met before, the
    prefix length of the two rows there is that of the interval it came from, and the new interval joins the queue.
    All intervals of one length are extended together. Lengths come out by increasing value; at ``least`` it stops,
    and boundaries not met by then are of rows that share so many symbols.
    """
    n = len(text)
    apart = text == 0
    count = int(apart.sum())
    own = text + count
    own[apart] = np.arange(count)  # each separator a symbol of its own
    order = suffix_array(own, least + 1)
    lcp = np.full(max(n - 1, 0), least, dtype=np.int32)
    if n < 2:
        return order, lcp
    symbols, longer = transform(own, order)
    known = np.full(n + 1, least, dtype=np.int32)  # of the boundary before each row
    known[0] = -1
    begin, end = np.zeros(1, dtype=np.int64), np.full(1, n, dtype=np.int64)
    for length in range(least):
        if not len(begin):
            break
        size = end - begin
        rows = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        of = np.repeat(np.arange(len(begin)), size)
        # rows of one interval and symbol stand together among the longer suffixes
        to = longer[rows]
        sort = np.argsort(to)
        to, of, by = to[sort], of[sort], symbols[rows[sort]]
        first = np.concatenate([[True], (of[1:] != of[:-1]) | (by[1:] != by[:-1])])
        at = np.flatnonzero(first)
        begin, end = to[at], to[np.concatenate([at[1:], [len(to)]]) - 1] + 1
        fresh = known[end] == least
        begin, end = begin[fresh], end[fresh]
        known[end] = length
    return order, known[1:-1] if n > 1 else lcp


def repeated_starts(contexts: list[np.ndarray], counts: np.ndarray, least: int) -> list[np.ndarray]:
    """For each distinct context, the offsets at which ``least`` words begin that occur again."""
    size = np.array([len(c) for c in contexts])
    total = int(size.sum()) + len(contexts)
    text = np.zeros(total, dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    for b, c in zip(begin, contexts):
        text[b : b + len(c)] = c.astype(np.int64) + 1
    order, lcp = bounded_common_prefixes(text, least)
    hit = np.zeros(total, dtype=bool)
    long = np.flatnonzero(lcp >= least)
    hit[order[long]] = True
    hit[order[long + 1]] = True
    out = []
    for b, n, c in zip(begin, size, counts):
        out.append(np.arange(max(n - least + 1, 0)) if c > 1 else np.flatnonzero(hit[b : b + n]))
    return out


def _contexts(batches, n: int, anchor: int, least: int):
    """The words around each repeated anchor, packed by bucket of the anchor's hash."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            words, at = word_hashes(*text_buffer(part.column("text")))
            hashes = run_hashes(words, anchor)
            short = (words >> np.uint64(32)).astype(np.uint32)
            ids, rows = part.column("doc_id").to_numpy(zero_copy_only=False), []
            for r, places in enumerate(part.column("places").to_pylist()):
                p = np.unique(places_of(places))
                size = int(at[r + 1] - at[r])
                p = p[p + anchor <= size]
                lo, hi = np.maximum(p - (least - anchor), 0), np.minimum(p + least, size)
                rows.append((hashes[p + at[r]], np.full(len(p), ids[r]), lo, hi - lo, lo + at[r]))
            if not rows:
                continue
            h, doc, lo, length, source = (np.concatenate(x) for x in zip(*rows))
            bucket = ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int32)
            # a text's contexts that overlap in a bucket are one, so that no place stands beside itself
            order = np.lexsort((source, bucket))
            h, bucket, doc, lo, length, source = (x[order] for x in (h, bucket, doc, lo, length, source))
            own = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (source[1:] >= source[:-1] + length[:-1])])[: len(h)]
            begin = np.flatnonzero(own)
            if len(begin):
                end = np.concatenate([begin[1:], [len(h)]]) - 1
                length = source[end] + length[end] - source[begin]
                h, bucket, doc, lo, source = (x[begin] for x in (h, bucket, doc, lo, source))
            # equal anchors of a bucket stand together, so that copies compress
            order = np.lexsort((h, bucket))
            bucket, doc, lo, length, source = (x[order] for x in (bucket, doc, lo, length, source))
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            out = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                ln = length[a:z]
                take = np.arange(int(ln.sum())) - np.repeat(np.cumsum(ln) - ln, ln) + np.repeat(source[a:z], ln)
                out.append((int(bucket[a]), ln.astype(np.uint32).tobytes(),
                            doc[a:z].astype(np.int64).tobytes(), lo[a:z].astype(np.uint32).tobytes(), short[take].tobytes()))
            if out:
                types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["bucket", "lengths", "docs", "firsts", "words"]
                )


def _expand(batches, least: int):
    """Passages of each bucket's contexts as (doc_id, first word, words)."""
    for group in _groups(batches, 0):
        lengths, docs, firsts = (
            np.frombuffer(b"".join(x.as_py() for x in group.column(c)), dtype=t)
            for c, t in (("lengths", np.uint32), ("docs", np.int64), ("firsts", np.uint32))
        )
        blob = b"".join(x.as_py() for x in group.column("words"))
        stop = np.cumsum(lengths, dtype=np.int64) * 4
        known: dict[bytes, int] = {}
        which = np.empty(len(lengths), dtype=np.int64)
        a = 0
        for k, z in enumerate(stop.tolist()):
            which[k] = known.setdefault(blob[a:z], len(known))
            a = z
        del blob
        contexts = [np.frombuffer(c, dtype=np.uint32) for c in known]
        counts = np.bincount(which, minlength=len(known))
        starts = repeated_starts(contexts, counts, least)
        spans = [runs_of(s, least) for s in starts]
        number = np.array([len(f) for f, _ in spans])
        all_first = np.concatenate([f for f, _ in spans]) if spans else np.zeros(0, int)
        all_past = np.concatenate([z for _, z in spans]) if spans else np.zeros(0, int)
        at = np.cumsum(number) - number
        mine = number[which]
        pick = np.arange(int(mine.sum())) - np.repeat(np.cumsum(mine) - mine, mine) + np.repeat(at[which], mine)
        if len(pick):
            base = np.repeat(firsts.astype(np.int64), mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(docs, mine)), pa.array((base + all_first[pick]).astype(np.int32)), pa.array((base + all_past[pick]).astype(np.int32))],
                names=["doc_id", "first", "past"],
            )


def suffix_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``start_word``, ``n_words`` of each maximal stretch of words that repeated passages cover.

    A passage is ``least_words`` successive words (parted by ASCII white space) that occur at another place
    too, in the same text or another. Stretches of overlapping or touching passages are one.

    Null and empty texts, texts of fewer words, and rows with a null id have none. Rows that repeat an id are
    texts of their own under the same id. Texts of any length are taken whole. Other columns are ignored; an empty table gives an empty result.
    Words are told apart by 32 bits of their hash, passages thus by 32 bits a word.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    ensure_importable(docs.sparkSession)
    n = buckets_of(docs)
    docs, own = told_apart(docs, scratch)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(repeated(anchored(docs, ANCHOR_WORDS, least_words, n), n))
    contexts = with_texts(docs, found).mapInArrow(lambda b: _contexts(b, n, ANCHOR_WORDS, least_words), CONTEXTS)
    passages = (
        contexts.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket")
        .mapInArrow(lambda b: _expand(b, least_words), "doc_id long, first int, past int")
    )
    union = passages.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first", "past"))).alias("spans"))

    def merge(batches):
        for batch in batches:
            ids, first, size = [], [], []
            for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = z = None
                for s in spans:
                    if a is None or s["first"] > z:
                        if a is not None:
                            ids.append(doc), first.append(a), size.append(z - a)
                        a, z = s["first"], s["past"]
                    z = max(z, s["past"])
                ids.append(doc), first.append(a), size.append(z - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(first, pa.int32()), pa.array(size, pa.int32())], names=["doc_id", "start_word", "n_words"]
            )

    return named(union.mapInArrow(merge, "doc_id long, start_word int, n_words int"), own)

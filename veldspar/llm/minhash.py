"""MinHash near-dedup with b-bit signatures.

A document's set is its runs of three words (lower-cased ASCII, marks separate words; a shorter text is one
run). ``PERMUTATIONS`` minima give band keys, from which candidates come, and a signature of the low
``BITS`` bits of each minimum, stored bit plane by bit plane. Two signatures agree at a position where the
exclusive-or of all planes is 0, so bit counts give the share of agreement p, and (p - c) / (1 - c) with
c = 2**-BITS estimates the Jaccard similarity corrected for chance collisions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.graph import components
from veldspar.llm.words import PLAIN, mix, run_hashes, text_buffer, word_hashes
from veldspar.runtime import Scratch, ensure_importable

#: Words in a run; bands of rows; low bits kept; least estimated similarity of near copies.
RUN, BANDS, ROWS, BITS, THRESHOLD = 3, 40, 4, 4, 0.5
PERMUTATIONS = BANDS * ROWS
LANES = -(-PERMUTATIONS // 64)
_BLOCK = 1 << 16

_rng = np.random.default_rng(0x5EED)
_MULTIPLY = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def minima(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows with any word, and their minima (rows by permutations)."""
    words, at = word_hashes(*text_buffer(column), PLAIN)
    count = np.diff(at)
    runs = run_hashes(words, RUN)
    rows, values, sizes = [], [], []
    full = np.flatnonzero(count >= RUN)
    short = np.flatnonzero((count > 0) & (count < RUN))
    # runs that stay inside their text: positions from the text's first word
    out = np.empty((len(full) + len(short), PERMUTATIONS), dtype=np.uint32)
    n = count[full] - RUN + 1
    stops = np.cumsum(n)
    lo = 0
    while lo < len(full):
        base = stops[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(stops, base + _BLOCK, "right")))
        sizes = n[lo:hi]
        begin = np.cumsum(sizes) - sizes
        where = np.arange(int(sizes.sum())) - np.repeat(begin, sizes) + np.repeat(at[full[lo:hi]], sizes)
        values = (runs[where] >> np.uint64(32)).astype(np.uint32)
        work = np.empty_like(values)
        for k in range(PERMUTATIONS):
            np.multiply(values, _MULTIPLY[k], out=work)
            np.add(work, _ADD[k], out=work)
            out[lo:hi, k] = np.minimum.reduceat(work, begin)
        lo = hi
    for k, row in enumerate(short):
        h = run_hashes(words[at[row] : at[row + 1]], int(count[row]))
        out[len(full) + k] = (h >> np.uint64(32)).astype(np.uint32) * _MULTIPLY + _ADD
    rows = np.concatenate([full, short])
    return rows, out


def has_word(text: str = "text") -> Column:
    """Whether a text has a word: a letter, a digit or a character beyond ASCII."""
    return F.col(text).rlike(r"[0-9A-Za-z]|[^\x00-\x7f]")


def run_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct runs of each text, as sorted 32-bit hashes; none for a text without a word."""
    words, at = word_hashes(*text_buffer(column), PLAIN)
    runs = (run_hashes(words, RUN) >> np.uint64(32)).astype(np.uint32)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        if z - a >= RUN:
            out.append(np.unique(runs[a : z - RUN + 1]))
        else:
            out.append((run_hashes(words[a:z], z - a) >> np.uint64(32)).astype(np.uint32) if z > a else np.zeros(0, dtype=np.uint32))
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """Low bits of mixed minima by plane: rows by ``BITS * LANES`` words of 64 bits."""
    low = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    out = np.zeros((len(least), BITS, LANES), dtype=np.uint64)
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for plane in range(BITS):
        bit = (low >> np.uint32(plane) & np.uint32(1)).astype(np.uint64)
        for lane in range(LANES):
            part = bit[:, lane * 64 : lane * 64 + 64]
            out[:, plane, lane] = (part * place[: part.shape[1]]).sum(axis=1, dtype=np.uint64)
    return out.reshape(len(least), BITS * LANES)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which names the band too."""
    x = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r])
    return key.view(np.int64)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Corrected similarity of a signature with each row of others."""
    differ = np.bitwise_or.reduce((many ^ one).reshape(len(many), BITS, LANES), axis=1)
    agree = PERMUTATIONS - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return np.maximum((agree / PERMUTATIONS - chance) / (1 - chance), 0.0)


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``sig``, ``bands`` of each row with an id and at least one word."""
    ensure_importable(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                rows, least = minima(part.column(1))
                ids = part.column(0).take(pa.array(rows))
                sig, keys = pack(least).view(np.int64), band_keys(least)
                yield pa.RecordBatch.from_arrays(
                    [ids] + [pa.ListArray.from_arrays(
                        pa.array(np.arange(len(rows) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())
                    ) for x in (sig, keys)], names=["doc_id", "sig", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, sig array<long>, bands array<long>")


def link(ids: np.ndarray, sigs: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Edges of a spanning forest of the pairs with at least such similarity.

    Each member reached is compared with all not yet reached, so the components are those of all pairs, while
    a group that is alike takes one comparison a member.
    """
    left = np.arange(len(ids))
    out = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            s = similarity(sigs[at], sigs[left])
            hit = s >= threshold
            if hit.any():
                out += [(int(ids[at]), int(ids[x]), float(v)) for x, v in zip(left[hit], s[hit])]
                frontier += left[hit].tolist()
                left = left[~hit]
    return out


def _groups(batches, key: int):
    """Tables of consecutive rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, z - a))
            if z < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _buckets(batches):
    """Sorted (key, doc_id) rows to the lists of ids that share a key."""
    keys = ids = np.zeros(0, dtype=np.int64)
    done = False
    batches = iter(batches)
    while not done:
        batch = next(batches, None)
        done = batch is None
        if not done:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            ids = np.concatenate([ids, batch.column(1).to_numpy()])
        if not len(keys):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        if not done:  # the last key may go on
            cuts = cuts[:-1]
        size = np.diff(cuts)
        take = np.flatnonzero(size > 1)
        if len(take):
            lists = [ids[cuts[t] : cuts[t + 1]] for t in take]
            ends = np.concatenate([[0], np.cumsum(size[take])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], names=["ids"])
        keys, ids = keys[cuts[-1] :], ids[cuts[-1] :]


def near_pairs(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """``a``, ``b``, ``sim``: pairs that link each group of near copies (a spanning forest by candidate bucket)."""
    spark = docs.sparkSession
    signed = scratch.keep(signatures(docs))
    # copies of a signature are one vertex from here on
    vertices = scratch.keep(signed.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    same = (
        signed.select("doc_id", "sig").join(vertices.select("sig", F.col("doc_id").alias("a")), "sig")
        .where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("sim"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = (
        vertices.select(F.explode("bands").alias("key"), "doc_id").repartition(n, "key").sortWithinPartitions("key", "doc_id")
        .mapInArrow(_buckets, "ids array<long>").select("ids", F.xxhash64("ids").alias("bucket"))
        .groupBy("bucket", "ids").agg(F.count(F.lit(1)).alias("n")).drop("n")
    )
    members = scratch.keep(buckets.select("bucket", F.explode("ids").alias("doc_id")))

    def judge(batches):
        for group in _groups(batches, 0):
            ids = group.column("doc_id").to_numpy()
            sigs = group.column("sig").combine_chunks()
            flat = (sigs.flatten() if isinstance(sigs, pa.ListArray) else pa.concat_arrays([c.flatten() for c in sigs.chunks])).to_numpy()
            edges = link(ids, flat.view(np.uint64).reshape(len(ids), -1), threshold)
            if edges:
                a, b, s = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "sim"])

    edges = (
        members.join(vertices.select("doc_id", "sig"), "doc_id")
        .select("bucket", "doc_id", "sig").repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id")
        .mapInArrow(judge, "a long, b long, sim double")
    )
    return edges.unionByName(same)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """One row per distinct id: ``doc_id``, ``group_id``, ``group_size``, ``similarity``, ``is_kept``.

    Groups are the connected components of pairs whose estimated similarity is at least ``threshold``;
    ``group_id`` is the least id of the group, the one document that stays; ``similarity`` is the largest of the
    pairs found with the document (null for one without a near copy). Texts that are null, empty or without a word
    are near copies of nothing. Repeated rows of an id count once (their texts' pairs all count if they differ).
    Rows with a null id are left out. Other columns are ignored, whatever their names. An empty table gives an
    empty result.

    Texts are read once and never shuffled. Shuffled are signatures (96 bytes), band keys (40 a document), and
    for candidates alone signatures again. No bucket or partner list is capped.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    pairs = scratch.keep(near_pairs(docs, scratch, threshold))
    roots = components(pairs, scratch)
    best = (
        pairs.select(F.col("a").alias("doc_id"), "sim").unionByName(pairs.select(F.col("b").alias("doc_id"), "sim"))
        .groupBy("doc_id").agg(F.max("sim").alias("similarity"))
    )
    heads = roots.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("group_size"))
    grouped = (
        roots.join(heads, "root").select(F.col("a").alias("doc_id"), F.col("root").alias("group_id"), "group_size")
        .unionByName(heads.select(F.col("root").alias("doc_id"), F.col("root").alias("group_id"), "group_size"))
        .join(best, "doc_id", "left")
    )
    grouped = scratch.keep(grouped)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = ids.join(grouped, "doc_id", "left")
    return out.select(
        "doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.round("similarity", 6).alias("similarity"), F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)).alias("is_kept"),
    )

"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, compared between versions.

A sketch is cells of (count, exclusive-or of digests, exclusive-or of their checks); each digest is in one
cell of each of ``HASHES`` parts. The difference of two sketches holds just the digests that differ, and
peeling cells that hold one digest recovers them. Where peeling stops short, the pair is compared again with
``GROW`` times the cells, until it succeeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm import minhash
from veldspar.llm.graph import components
from veldspar.llm.words import mix
from veldspar.runtime import Scratch, ensure_importable

#: Cells of the first sketch and their growth; hash functions, each with a part of the cells.
CELLS, GROW, HASHES = 30, 4, 3
#: Least share of common word runs of two versions; least estimate by signatures that makes candidates of them.
ALIKE, CANDIDATE = 0.5, 0.35
_SALTS = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x6A09E667F3BCC908], dtype=np.uint64)
_CHECK = np.uint64(0xBB67AE8584CAA73B)


def digests_column(text: str = "text") -> Column:
    """Distinct 60-bit digests (of MD5) of a text's lines that hold more than blanks."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each part (parts by digests)."""
    part = cells // HASHES
    return np.stack([(mix(keys ^ s) % np.uint64(part)).astype(np.int64) + k * part for k, s in enumerate(_SALTS)])


class Sketches:
    """Sketches of many documents: three arrays of documents by cells."""

    def __init__(self, count: np.ndarray, keys: np.ndarray, checks: np.ndarray):
        self.count, self.keys, self.checks = count, keys, checks

    @classmethod
    def of(cls, rows: np.ndarray, keys: np.ndarray, n: int, cells: int) -> Sketches:
        """Sketches of ``n`` documents from digests and the documents that have them."""
        out = cls(*(np.zeros((n, cells), dtype=t) for t in (np.int32, np.uint64, np.uint64)))
        out.toggle(rows, keys, np.ones(len(keys), dtype=np.int32))
        return out

    def toggle(self, rows: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        """Add (sign 1) or take away (-1) digests."""
        check = mix(keys ^ _CHECK)
        cells = self.count.shape[1]
        for place in _places(keys, cells):
            at = rows * cells + place
            np.add.at(self.count.reshape(-1), at, sign)
            np.bitwise_xor.at(self.keys.reshape(-1), at, keys)
            np.bitwise_xor.at(self.checks.reshape(-1), at, check)

    def minus(self, other: Sketches) -> Sketches:
        """The sketches of the differences."""
        return Sketches(self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, digests and signs recovered, and which documents are fully resolved. Empties the cells."""
        rows, keys, signs = [], [], []
        while True:
            r, c = np.nonzero((np.abs(self.count) == 1) & (mix(self.keys ^ _CHECK) == self.checks))
            if not len(r):
                break
            k, s = self.keys[r, c], self.count[r, c]
            # one digest may stand alone in several cells of a document
            order = np.lexsort((k, r))
            r, k, s = r[order], k[order], s[order]
            fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
            r, k, s = r[fresh], k[fresh], s[fresh]
            self.toggle(r, k, -s)
            rows.append(r), keys.append(k), signs.append(s)
        done = ~((self.count != 0) | (self.keys != 0) | (self.checks != 0)).any(axis=1)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
        return cat(rows, np.int64), cat(keys, np.uint64), cat(signs, np.int32), done

    def pack(self) -> pa.Array:
        """One binary a document."""
        flat = np.concatenate([self.count.view(np.uint8).reshape(len(self.count), -1), self.keys.view(np.uint8).reshape(len(self.keys), -1), self.checks.view(np.uint8).reshape(len(self.checks), -1)], axis=1)
        return pa.array([x.tobytes() for x in flat], type=pa.binary())

    @classmethod
    def unpack(cls, blobs: list[bytes], cells: int) -> Sketches:
        flat = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(len(blobs), 20 * cells)
        cut = [np.ascontiguousarray(x) for x in np.split(flat, [4 * cells, 12 * cells], axis=1)]
        return cls(*(x.view(t).reshape(len(blobs), cells).copy() for x, t in zip(cut, (np.int32, np.uint64, np.uint64))))


def _sketch(batches, cells: int, keep: list[str]):
    for batch in batches:
        for k in range(0, batch.num_rows, max(1, 200_000 // cells)):
            part = batch.slice(k, max(1, 200_000 // cells))
            lists = part.column("digests")
            keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.array([len(x) for x in lists.to_pylist()])
            made = Sketches.of(np.repeat(np.arange(len(sizes)), sizes), keys, len(sizes), cells)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made.pack()], names=[*keep, "sketch"])


def _compare(batches, cells: int):
    """Pairs with both sketches to (doc_id, prev_id, added, removed); null lists where peeling stopped short."""
    for batch in batches:
        for k in range(0, batch.num_rows, max(1, 200_000 // cells)):
            part = batch.slice(k, max(1, 200_000 // cells))
            n = part.num_rows
            own, other = (Sketches.unpack(part.column(c).to_pylist(), cells) for c in ("sketch", "prev_sketch"))
            rows, keys, signs, done = own.minus(other).peel()
            cols = []
            for sign in (1, -1):
                mine = (signs == sign) & done[rows]
                r, v = rows[mine], keys[mine].view(np.int64)
                order = np.lexsort((v, r))
                ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))])
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~done, False)), pa.array(v[order])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("prev_id"), *cols], names=["doc_id", "prev_id", "added", "removed"])


_OUT = "doc_id long, prev_id long, added array<long>, removed array<long>"


def version_differences(docs: DataFrame, cells: int = CELLS, scratch: Scratch | None = None) -> DataFrame:
    """One row an id: ``doc_id``, ``prev_id``, ``n_paragraphs``, ``added``, ``removed``.

    Documents with the same least paragraph digest are versions of one another, in order of id; ``prev_id`` is
    the version before. ``added`` and ``removed`` are the digests (sorted) of paragraphs that only this version
    or only the one before has, as recovered from their sketches. Without a version before, all three are null.
    Paragraphs are lines that hold more than blanks; one that a document repeats counts once.

    Rows that share an id are one document with all their paragraphs; rows with a null id are left out. Null and
    empty texts have no paragraph and no version. Other columns are ignored; an empty table gives an empty result.

    One shuffle brings versions together with their sketches of ``20 * cells`` bytes (mostly zeros, which
    compress); only failed pairs move larger ones.
    """
    if cells % HASHES:
        raise ValueError(f"cells must be a multiple of {HASHES}")
    scratch = scratch or Scratch(docs.sparkSession)
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digests_column().alias("digests")).where("doc_id is not null")
    digests = scratch.keep(
        rows.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("digests"))).alias("digests"))
        .select("doc_id", "digests", F.array_min("digests").alias("least"), F.size("digests").cast("long").alias("n_paragraphs"))
    )
    order = Window.partitionBy("least").orderBy("doc_id")
    first = (
        digests.where("least is not null").select("doc_id", "least", "digests")
        .mapInArrow(lambda b: _sketch(b, cells, ["doc_id", "least"]), "doc_id long, least long, sketch binary")
        .select("doc_id", "sketch", F.lag("doc_id").over(order).alias("prev_id"), F.lag("sketch").over(order).alias("prev_sketch"))
        .where("prev_id is not null")
    )
    done = scratch.keep(first.mapInArrow(lambda b, c=cells: _compare(b, c), _OUT))
    parts = [done.where("added is not null")]
    while not (failed := done.where("added is null").select("doc_id", "prev_id")).isEmpty():
        cells *= GROW
        need = failed.select("doc_id").unionByName(failed.select(F.col("prev_id").alias("doc_id"))).distinct()
        larger = scratch.keep(
            digests.select("doc_id", "digests").join(need, "doc_id")
            .mapInArrow(lambda b, c=cells: _sketch(b, c, ["doc_id"]), "doc_id long, sketch binary")
        )
        pairs = failed.join(larger, "doc_id").join(larger.select(F.col("doc_id").alias("prev_id"), F.col("sketch").alias("prev_sketch")), "prev_id")
        done = scratch.keep(pairs.mapInArrow(lambda b, c=cells: _compare(b, c), _OUT))
        parts.append(done.where("added is not null"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return digests.select("doc_id", "n_paragraphs").join(found, "doc_id", "left").select("doc_id", "prev_id", "n_paragraphs", "added", "removed")


def _alike(sets: list[np.ndarray], least: float):
    """Pairs (earlier, later, similarity) of the sets whose Jaccard similarity is at least ``least``, by later ones."""
    size = np.array([len(x) for x in sets])
    inner = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.cumsum(size) - size
    flag = np.zeros(int(inner.max()) + 1, dtype=np.int64)
    for k in range(1, len(sets)):
        own = inner[at[k] : at[k] + size[k]]
        flag[own] = 1
        common = np.add.reduceat(flag[inner[: at[k]]], at[:k])
        flag[own] = 0
        share = common / (size[:k] + size[k] - common)
        hit = np.flatnonzero(share >= least)
        if len(hit):
            yield hit, np.full(len(hit), k), share[hit]


def _resolve(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray, cells: int):
    """For slices of the pairs: their places, and offsets and values of the digests that only ``b``, only ``a`` has."""
    step = max(1, 200_000 // cells)
    for lo in range(0, len(a), step):
        docs, at = np.unique(np.concatenate([a[lo : lo + step], b[lo : lo + step]]), return_inverse=True)
        n, own = len(at) // 2, [lists[d] for d in docs]
        made = Sketches.of(np.repeat(np.arange(len(docs)), [len(x) for x in own]), np.concatenate(own), len(docs), cells)
        one = lambda x: Sketches(made.count[x], made.keys[x], made.checks[x])
        rows, keys, signs, done = one(at[n:]).minus(one(at[:n])).peel()
        whole = np.flatnonzero(done)
        place, cols = np.cumsum(done) - 1, []
        for sign in (1, -1):
            mine = (signs == sign) & done[rows]
            r, v = place[rows[mine]], keys[mine].view(np.int64)
            order = np.lexsort((v, r))
            cols.append((np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(whole)))]), v[order]))
        if len(whole):
            yield whole + lo, cols
        failed = np.flatnonzero(~done) + lo
        for where, more in _resolve(lists, a[failed], b[failed], cells * GROW):
            yield failed[where], more


_PAIR = "doc_id long, prev_id long, similarity double, added array<long>, removed array<long>"


def _version_pairs(batches, least: float, cells: int):
    """Rows (root, doc_id, digests, runs) in order to the pairs of each root's rows that are alike."""
    for group in minhash._groups(batches, 0):
        ids = group.column("doc_id").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint32) for x in group.column("runs").to_pylist()]
        lists = [np.array(x, dtype=np.int64).view(np.uint64) for x in group.column("digests").to_pylist()]
        held, count = [], 0
        for found in [*_alike(sets, least), None]:
            if found is not None:
                held.append(found)
                count += len(found[0])
            if not held or found is not None and count < 50_000:
                continue
            a, b, share = (np.concatenate(x) for x in zip(*held))
            held, count = [], 0
            for where, cols in _resolve(lists, a, b, cells):
                ends = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, pa.int64())) for e, v in cols]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[b[where]]), pa.array(ids[a[where]]), pa.array(share[where]), *ends],
                    names=["doc_id", "prev_id", "similarity", "added", "removed"],
                )


def version_pairs(docs: DataFrame, least: float = ALIKE, cells: int = CELLS, scratch: Scratch | None = None) -> DataFrame:
    """One row a pair of versions: ``doc_id``, ``prev_id`` (the smaller id), ``similarity``, ``added``, ``removed``.

    Versions are texts whose runs of three words (see ``minhash``) have a Jaccard similarity of at least ``least``;
    each such pair of a group of candidates is a row, with the digests (sorted) of the paragraphs that only
    ``doc_id`` or only ``prev_id`` has, as recovered from their sketches. Candidates are linked by band keys: a pair
    of similarity 0.5 shares one with probability 0.92, a pair more alike with a larger one, and pairs that others
    link are found too. Of the rows with the same text the one of least id takes part; each further id is a pair
    with that one, of similarity 1.

    Rows with a null id or text are left out, texts without a word are versions of nothing. An id with several
    texts stands for each. Other columns are ignored; an empty table gives an empty result. The pairs are as
    many as the result has rows, so they grow with the square of a group's distinct texts.

    Texts of the groups alone are shuffled, once to tell equal ones, then as runs (4 bytes each) and digests by group.
    """
    if cells % HASHES:
        raise ValueError(f"cells must be a multiple of {HASHES}")
    scratch = scratch or Scratch(docs.sparkSession)
    ensure_importable(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("content")).where("doc_id is not null and text is not null")
    worded = rows.where(minhash.has_word())
    ids = worded.select("doc_id", "content").distinct()
    first = F.min("doc_id").over(Window.partitionBy("content"))
    equal = ids.withColumn("prev_id", first).where("doc_id <> prev_id").select(
        "doc_id", "prev_id", F.lit(1.0).alias("similarity"), *(F.array().cast("array<long>").alias(c) for c in ("added", "removed"))
    )
    links = scratch.keep(minhash.near_pairs(rows.select(F.col("content").alias("doc_id"), "text"), scratch, min(CANDIDATE, least)))
    roots = components(links, scratch).select(F.col("a").alias("content"), "root")
    roots = scratch.keep(roots.unionByName(roots.select(F.col("root").alias("content"), "root").distinct()))
    texts = rows.join(scratch.small(roots), "content").groupBy("root", "content").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))

    def runs(batches):
        for batch in batches:
            sets = minhash.run_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("root", "doc_id", "digests")), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["root", "doc_id", "digests", "runs"],
            )

    members = texts.select("root", "doc_id", digests_column().alias("digests"), "text").mapInArrow(runs, "root long, doc_id long, digests array<long>, runs binary")
    pairs = members.repartition(n, "root").sortWithinPartitions("root", "doc_id").mapInArrow(lambda b: _version_pairs(b, least, cells), _PAIR)
    return pairs.unionByName(equal)


FINGERPRINT_SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL),
digest AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(line), 1, 15))::bigint AS d FROM lines WHERE trim(line, ' ') <> ''
),
sets AS (
  SELECT i.doc_id, coalesce(list_sort(list(d) FILTER (d IS NOT NULL)), []) AS ds, min(d) AS least, count(d) AS n
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) i LEFT JOIN digest USING (doc_id) GROUP BY ALL
),
chain AS (
  SELECT doc_id, n, ds, CASE WHEN least IS NOT NULL THEN lag(doc_id) OVER w END AS prev_id, lag(ds) OVER w AS ps
  FROM sets WINDOW w AS (PARTITION BY least ORDER BY doc_id)
)
SELECT doc_id, prev_id, n AS n_paragraphs,
  CASE WHEN prev_id IS NOT NULL THEN list_filter(ds, lambda x: NOT list_contains(ps, x)) END AS added,
  CASE WHEN prev_id IS NOT NULL THEN list_filter(ps, lambda x: NOT list_contains(ds, x)) END AS removed
FROM chain
"""

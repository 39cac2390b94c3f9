"""Exact vector search: one query, all datasets, long queries by windows, matching across roots.

Scores are computed in one scan without a shuffle of vectors; top-k is a partial sort per task
(``TakeOrderedAndProject``) or a window with a group limit, so only k rows a task and dataset travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.scalars import location
from veldspar.operators.matching import PathRules

DEFAULT_K = 10
#: Bytes of a window of a long query, and of its overlap with the one before; least candidates a window.
WINDOW, OVERLAP, LEAST_CANDIDATES = 4096, 256, 32


def vector(values) -> Column:
    """A query vector as a column."""
    return F.array(*[F.lit(float(x)) for x in values])


def cosine(a, b) -> Column:
    """Cosine of two arrays in double precision, over the shorter length; 0 for empty or zero vectors."""
    a, b = (F.transform(F.col(x) if isinstance(x, str) else x, lambda v: v.cast("double")) for x in (a, b))
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def total(x) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norms > 0, dot / norms).otherwise(F.lit(0.0))


def scored(docs: DataFrame, query: Column, min_score: float | None = None) -> DataFrame:
    """Live documents with their ``score`` (rounded to 6 places); ``min_score`` drops lower ones.

    Documents without a vector aren't scored.
    """
    out = docs.where("archived = 0 and embedding is not null").withColumn("score", F.round(cosine("embedding", query), 6))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def topk(docs: DataFrame, query: Column, k: int = DEFAULT_K, offset: int = 0, min_score: float | None = None) -> DataFrame:
    """The ``k`` documents (10 if not positive) of highest score after ``offset``; ties go to the smaller id."""
    k, offset = (k if k > 0 else DEFAULT_K), max(offset, 0)
    return scored(docs, query, min_score).orderBy(F.desc("score"), "id").offset(offset).limit(k)


def hits_with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits (dataset_id, id, score) with the live documents they name."""
    return hits.join(docs.where("archived = 0"), ["dataset_id", "id"])


def topk_by_dataset(docs: DataFrame, query: Column, k: int = DEFAULT_K, min_score: float | None = None) -> DataFrame:
    """The ``k`` best of each dataset, with their ``rank``."""
    best = Window.partitionBy("dataset_id").orderBy(F.desc("score"), "id")
    return scored(docs, query, min_score).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= (k if k > 0 else DEFAULT_K))


def search_all(docs: DataFrame, query: Column, k: int = DEFAULT_K, limit: int | None = None, min_score: float | None = None) -> DataFrame:
    """All datasets' best merged by score, then id; ``limit`` cuts the merged list."""
    out = topk_by_dataset(docs, query, k, min_score).orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


def score_range(found: DataFrame) -> DataFrame:
    """Least and greatest score and number of results by dataset."""
    return found.groupBy("dataset_id").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n"))


def query_windows(text: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[str]:
    """A text in windows of at most ``size`` bytes that overlap by ``overlap``, cut between characters; none for an empty one.

    The last window ends with the text's last byte, and no window lies inside another.
    """
    data = text.encode()
    if size <= 0 or len(data) <= size:
        return [text] if text else []
    overlap = overlap if 0 <= overlap < size else 0

    def boundary(at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    out, start = [], 0
    while True:
        end = boundary(min(start + size, len(data)))
        if end <= start:  # a character that is longer than the window
            end = start + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append(data[start:end].decode())
        if end == len(data):
            return out
        after = boundary(end - overlap)
        start = after if after > start else end


def windows_column(text, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Byte windows of an ASCII text as an array (``query_windows`` for single-byte characters, in the JVM)."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.octet_length(text)
    step = size - overlap
    last = F.greatest(F.ceil((n - overlap) / F.lit(float(step))).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text.cast("binary"), k * step + 1, F.lit(size)).cast("string"))


def windowed_topk(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K, offset: int = 0, combine: str = "max") -> DataFrame:
    """Top-k for windows (``queries``: ``window``, ``vector``) combined by document, by ``max`` or ``mean``.

    Every window contributes its best ``max(2k, k + offset)`` documents (32 at least). Windows come from one
    query text, so they are few, and are broadcast.
    """
    k = k if k > 0 else DEFAULT_K
    candidates = max(2 * k, k + offset, LEAST_CANDIDATES)
    pairs = docs.where("archived = 0 and embedding is not null").crossJoin(F.broadcast(queries))
    best = Window.partitionBy("window").orderBy(F.desc("s"), "id")
    ranked = pairs.withColumn("s", F.round(cosine("embedding", "vector"), 6)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= candidates)
    score = F.max("s") if combine == "max" else F.round(F.avg("s"), 6)
    return ranked.groupBy("dataset_id", "id").agg(score.alias("score")).orderBy(F.desc("score"), "id").offset(offset).limit(k)


def match(docs: DataFrame, query: Column, limit: int = DEFAULT_K, path_prefix: str = "", rules: PathRules | None = None, min_score: float = 0.0) -> DataFrame:
    """Matches across roots: each root's top ``limit`` in order of root, filtered afterwards, until ``limit`` in all."""
    found = topk_by_dataset(docs, query, limit, min_score)
    if path_prefix:
        found = found.where(F.startswith("path", F.lit(path_prefix)))
    if rules is not None:
        found = found.where(rules.kept("path", F.lit(0)))
    return found.orderBy("dataset_id", "rank").limit(limit)


def formatted(path="path", doc_id="id", content="content") -> Column:
    """A match as text: its location, then its content."""
    return F.concat(F.lit("file: "), location(path, doc_id), F.lit("\n"), F.col(content), F.lit("\n\n"))


def byte_pages(df: DataFrame, size, order: list, limit_bytes: int = 7000, by: str | None = None) -> DataFrame:
    """``df`` with ``page``: rows packed in order until a page would exceed ``limit_bytes``; a larger row is alone.

    Packing carries state from row to row, so a group's sizes are folded in one array; group by ``by`` to
    pack many result lists at once.
    """
    limit_bytes = 7000 if limit_bytes <= 0 else min(limit_bytes, 200_000)
    size = F.col(size) if isinstance(size, str) else size
    rows = df.withColumn("_g", F.col(by) if by else F.lit(0)).withColumn("_b", size.cast("long"))
    lists = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).groupBy("_g").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_b", F.struct(*df.columns).alias("row")))).alias("xs")
    )
    start = F.struct(F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, x):
        alone = x["_b"] > limit_bytes
        fresh = alone | (acc["used"] + x["_b"] > limit_bytes) | (acc["page"] == 0)
        page = acc["page"] + fresh.cast("long")
        # nothing joins a row that is larger than a page
        used = F.when(alone, F.lit(limit_bytes + 1).cast("long")).otherwise(F.when(fresh, x["_b"]).otherwise(acc["used"] + x["_b"]))
        return F.struct(page.alias("page"), used.alias("used"), F.concat(acc["out"], F.array(page)).alias("out"))

    paged = lists.withColumn("ps", F.aggregate("xs", start, step, lambda acc: acc["out"]))
    one = paged.select(F.explode(F.arrays_zip("xs", "ps")).alias("z"))
    return one.select("z.xs.row.*", F.col("z.ps").alias("page"))


def select_page(pages: DataFrame, cursor: int = 1) -> DataFrame:
    """Rows of one page; a cursor beyond the last page means the last."""
    last = pages.agg(F.max("page").alias("_last"))
    return pages.crossJoin(F.broadcast(last)).where(F.col("page") == F.least(F.lit(max(cursor, 1)).cast("long"), "_last")).drop("_last")

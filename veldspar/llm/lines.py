"""Line dedup by site-relative frequency: lines that too large a share of a host's pages contain are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm import minhash
from veldspar.runtime import Scratch, packed

#: A line in more than this share of its host's pages, and in so many pages, is boilerplate.
RATIO, LEAST_PAGES = 0.01, 3


def boilerplate_lines(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, page: str | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """``host``, ``line``, ``n_pages``, ``host_pages`` of each line that is boilerplate on its host.

    A page is a row with text, or where ``page`` names a column, all rows with one value of it and equal text. A line
    counts once a page; one in exactly ``ratio`` of the pages isn't boilerplate. Lines without anything but blanks
    aren't counted. At most (mean lines of a page) / ``ratio`` lines of a host can be boilerplate, whatever the size.
    Rows of a null host form a host of their own; null texts are no pages; a table without a page gives no lines.

    Lines are counted by host and a 64-bit hash first (partial counts, some 20 bytes each, are shuffled, so a line of
    every page costs each task one row); the lines of hashes that pass are then counted themselves.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    own = [F.col(page).alias("page")] if page else []
    pages = docs.where("text is not null").select(F.col(host).alias("host"), "text", *own)

    def counted(rows: DataFrame, what: str) -> DataFrame:
        rows = rows.select("host", what, "page").distinct() if page else rows
        return rows.groupBy("host", what).agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= least_pages)

    totals = (pages.select("host", "page").distinct() if page else pages).groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    totals = scratch.keep(totals)
    lines = pages.select("host", *(["page"] if page else []), F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where("trim(line) <> ''")

    def frequent(rows: DataFrame) -> DataFrame:
        rows = rows.withColumnRenamed("host", "_h").join(scratch.small(totals), F.expr("_h <=> host"))
        return rows.where(F.col("n_pages") > ratio * F.col("host_pages")).drop("_h")

    hashed = lines.withColumn("hash", F.xxhash64("line"))
    hot = scratch.keep(frequent(counted(hashed, "hash")).select(F.col("host").alias("_h"), F.col("hash").alias("_hash")))
    found = hashed.join(scratch.small(hot), F.expr("_hash = hash and _h <=> host"), "left_semi")
    return frequent(counted(found, "line")).select("host", "line", "n_pages", "host_pages")


def distinct_pages(docs: DataFrame, host: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """``host``, ``text`` and ``page`` of one page for each group of near copies on a host.

    Texts are told apart by a 64-bit hash (``page``) and grouped over all hosts, whatever their ids; of a group's
    texts on a host the one of least hash stands for all. Rows of equal text have one ``page`` and all stay. A text
    without a word is a group of its own; null texts are left out.

    Hashes and signatures are grouped as in ``near_duplicates``; no text is shuffled.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    pages = docs.where("text is not null").select(F.col(host).alias("host"), "text", F.xxhash64("text").alias("page"))
    groups = minhash.near_duplicates(pages.select(F.col("page").alias("doc_id"), "text"), scratch=scratch)
    grouped = scratch.keep(groups.where("group_size > 1").select(F.col("doc_id").alias("page"), "group_id"))
    seen = pages.select("host", "page").distinct().join(grouped, "page")
    first = seen.groupBy(F.col("host").alias("_h"), "group_id").agg(F.min("page").alias("_first"))
    extra = scratch.keep(
        seen.join(first, F.expr("_h <=> host") & (seen.group_id == first.group_id) & F.expr("page <> _first"))
        .select("_h", F.col("page").alias("_p"))
    )
    return pages.join(scratch.small(extra), F.expr("_h <=> host and _p = page"), "left_anti").select(F.col("host").alias(host), "text", "page")


def drop_boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, n_chars: str | None = "n_chars",
    counted: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines of their host taken out of ``text``, and ``n_dropped`` lines counted.

    Every row stays: a page of nothing but boilerplate has an empty text, a null text stays null (0 dropped), an
    empty text stays empty. Other lines keep their order and bytes. ``n_chars``, where named and present, is set to
    the new length for rows that changed. Repeated rows are pages of their own. Extra columns pass through, whatever
    their names; one called ``n_dropped`` is replaced. A line in exactly ``ratio`` of its host's pages stays. An empty
    table gives an empty result. Lines are counted over the pages of ``counted`` where it is given (as by
    ``distinct_pages``, so that copies of one page can't make its lines boilerplate).

    Counting shuffles hashes and counts (see ``boilerplate_lines``). The lines found are written, their size is
    checked, and they are broadcast by host if small; else the join is shuffled and left to adaptive skew handling.
    A page's lines meet its host's by a hash set, then only those of them that are boilerplate.
    """
    scratch = Scratch(docs.sparkSession)
    found = (
        boilerplate_lines(docs, host, ratio, least_pages, scratch=scratch) if counted is None
        else boilerplate_lines(counted, host, ratio, least_pages, "page", scratch)
    )
    found = scratch.keep(found.groupBy(F.col("host").alias("of")).agg(F.collect_set("line").alias("known")))
    keep = [c for c in docs.columns if c.lower() != "n_dropped"]
    rows = docs.select(packed(docs, [c for c in keep if c != "text"]), F.col(host).alias("host"), "text").join(scratch.small(found), F.expr("host <=> of"), "left")
    lines = F.split("text", "\n", -1)
    rows = rows.select("row", "text", F.array_intersect(lines, "known").alias("hits"))
    cut = F.when(F.size("hits") > 0, F.filter(lines, lambda x: ~F.array_contains("hits", x)))
    rows = rows.select("row", "text", cut.alias("cut")).withColumn("dropped", F.when(F.col("cut").isNotNull(), F.size(lines) - F.size("cut")).otherwise(0))
    text = F.when(F.col("cut").isNotNull(), F.array_join("cut", "\n")).otherwise(F.col("text"))

    def column(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        own = F.col(f"row.`{c}`")
        if c == n_chars:
            own = F.when(F.col("cut").isNotNull(), F.length(text).cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)

    return rows.select(*map(column, keep), F.col("dropped").cast("long").alias("n_dropped"))


LINES_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS r, * FROM documents),
lines AS (
  SELECT DISTINCT r, source, unnest(string_split(text, chr(10))) AS line FROM pages WHERE text IS NOT NULL
),
counted AS (
  SELECT source, line, count(*) AS c FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL HAVING count(*) >= {LEAST_PAGES}
),
totals AS (SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL),
found AS (
  SELECT t.source, list(line) AS bp FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.c > {RATIO}::double * t.n GROUP BY ALL
),
cut AS (
  SELECT p.*, string_split(p.text, chr(10)) AS ls,
    list_filter(string_split(p.text, chr(10)), lambda x: NOT list_contains(coalesce(f.bp, []), x)) AS kept
  FROM pages p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, CASE WHEN len(kept) < len(ls) THEN array_to_string(kept, chr(10)) ELSE text END AS text, lang, source,
  CASE WHEN len(kept) < len(ls) THEN length(array_to_string(kept, chr(10))) ELSE n_chars END AS n_chars,
  coalesce(len(ls) - len(kept), 0)::bigint AS n_dropped
FROM cut
"""

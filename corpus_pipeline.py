"""From raw documents to token ids: toxicity, line dedup, near dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of the documents
table, but for the last, which returns token ids. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import bpe, lines, minhash, mixing, toxicity
from veldspar.runtime import Scratch, packed, table


def _apart(docs: DataFrame, added) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns called like an added one renamed, and what gives a result the columns of ``docs`` back."""
    taken = {c.lower() for c in docs.columns}
    names = {}
    for c in docs.columns:
        new = c
        while new.lower() in added or (new != c and new.lower() in taken):
            new += "_"
        names[c] = new
        taken.add(new.lower())
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return renamed, lambda df: df.select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled ones among them, doesn't reject.

    Null and empty texts stay (they have no score); a score that equals the threshold is rejected. Texts of any
    length are read whole. Repeated rows stay or go together. An empty table stays empty. Columns pass through
    unchanged, whatever their names.
    """
    rows, back = _apart(docs, toxicity.ADDED)
    return back(toxicity.score_documents(rows, table(spark, sf_dir, "labels"), keep=rows.columns).where("not toxic"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many of their source's distinct documents contain (near copies count once).

    Null texts stay null, empty ones empty; a document of boilerplate alone becomes empty. Documents of a null source
    are a source of their own. A line in exactly the ratio's share stays. Repeated rows are cut alike and count once.
    An empty table stays empty. Of the columns only ``text`` and ``n_chars`` change, whatever the others' names.
    """
    rows, back = _apart(docs, ("n_dropped",))
    return back(lines.drop_boilerplate(rows, counted=lines.distinct_pages(rows)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each group of near copies, and all rows that are like no other; equal rows of an id are one.

    Texts are grouped whatever their ids, so an id with several texts is as many documents. Rows without an id or
    text stay, and so do texts without a word (equal ones of an id once). Of several texts of the least id the one of
    least hash stays; of rows that differ in other columns alone the least. Long texts are signed whole. An empty table
    stays empty. Columns pass through unchanged, whatever their names.
    """
    scratch = Scratch(spark)
    docs, back = _apart(docs, ("_content", "_own"))
    key = ["doc_id", "_content"]
    keyed = docs.withColumn("_content", F.xxhash64("text"))
    rows = keyed.where("doc_id is not null and text is not null")
    groups = minhash.near_duplicates(rows.select(F.col("_content").alias("doc_id"), "text"), scratch=scratch)
    groups = groups.where("group_size > 1").select(F.col("doc_id").alias("_content"), "group_id")
    own = F.when(minhash.has_word(), F.col("_content")).alias("_own")
    pairs = scratch.keep(
        rows.select(*key, own).groupBy(*key, "_own").agg(F.count(F.lit(1)).alias("n")).join(groups, "_content", "left")
        .select(*key, "n", F.coalesce("group_id", "_own").alias("group_id"))
    )
    heads = pairs.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct(*key)).alias("head"), F.count(F.lit(1)).alias("size"))
    extra = scratch.keep(pairs.join(heads.where("size > 1"), "group_id").where("struct(doc_id, _content) <> head").select(*key))
    left = keyed.join(scratch.small(extra), key, "left_anti")
    repeated = scratch.keep(pairs.where("n > 1").select(*key))
    if repeated.isEmpty():
        return back(left)
    repeated = scratch.small(repeated)
    one = left.join(repeated, key, "left_semi").groupBy(*key).agg(F.min(packed(docs)).alias("row")).select("row.*")
    return back(left.join(repeated, key, "left_anti").select(*docs.columns).unionByName(one))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target weights.

    Null sources and languages are cells of their own; null and empty texts weigh nothing and have their cell's
    probability. Rows of one id, and all rows of a null id, stay or go together; one whose number equals its
    probability goes. Long texts weigh by their length. An empty table stays empty. Columns pass through unchanged,
    whatever their names.
    """
    rows, back = _apart(docs, mixing.ADDED)
    return back(mixing.with_probability(rows).where("sampled"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding gives its text back.

    Null texts have null ids, empty ones none; texts of any length are encoded whole. Every row gives one, repeated ones
    too; an empty table none. Columns other than ``doc_id``, ``lang`` and ``source`` are left out.
    """
    return bpe.encode_column(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", sample_mixture),
    ("bpe", encode),
]

#: SQL can't express the toxicity, near-copy and BPE stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``{sf_dir}/documents.parquet``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling.

Cells are (source, language, topic). Raking scales the cells' tokens until their sums by source, by language
and by topic have the target shares; a cell's sampling probability is its raked weight over its tokens, times
the largest factor with which no probability exceeds 1, so the expected tokens of the sample have the
target margins without capping.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.runtime import Scratch, packed

#: Topics by the first rule that a text meets; else ``prose``. The rules take linear time on any text.
TOPICS = (
    ("licence", r"(?i)licen[sc]e|all rights reserved"),
    ("contact", r"[\w.]@[\w.]|\+\d[\d ()-]{8}"),
    ("code", r"[{};]|\w\(\)"),
)
#: Shares by language and topic; those not named share ``other``. Sources weigh their share to the power ``TEMPER``.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.10, "other": 0.05}
TOPIC_SHARES = {"prose": 0.90, "licence": 0.03, "contact": 0.04, "code": 0.03, "other": 0.05}
TEMPER, ROUNDS, TOLERANCE = 0.7, 12, 1e-9
#: Rounds after which fitting stops though the margins aren't met; ``ROUNDS`` are those that the SQL unrolls.
MOST_ROUNDS = 100_000
ADDED = ("topic", "tokens", "p", "u", "sampled", "margin_error")


def topic_column(text: str = "text", topics=TOPICS) -> Column:
    """Topic by the first rule that matches; null text is ``prose``."""
    return reduce(lambda e, t: F.when(F.coalesce(F.col(text).rlike(t[1]), F.lit(False)), t[0]).otherwise(e), reversed(topics), F.lit("prose"))


def token_weight(text: str = "text", tokens: str | None = None) -> Column:
    """Tokens of a text as they are weighed: those counted in a column, else one for each four bytes begun; none for null."""
    return F.coalesce(F.col(tokens) if tokens else F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def cells(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """``source``, ``lang``, ``topic``, ``n_docs``, ``tokens``; nulls are values of their own, named ``?``."""
    return (
        docs.select(*_keys(), token_weight(tokens=tokens).alias("w"))
        .groupBy("_source", "_lang", "_topic").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("w").alias("tokens"))
    )


def _keys() -> list[Column]:
    return [F.coalesce("source", F.lit("?")).alias("_source"), F.coalesce("lang", F.lit("?")).alias("_lang"), topic_column().alias("_topic")]


def _shares(values: np.ndarray, tokens: np.ndarray, named: dict[str, float]) -> np.ndarray:
    """Target share of each code's value: named ones as given, the rest by their tokens in ``other``; sums to 1."""
    names, code = np.unique(values, return_inverse=True)
    own = np.bincount(code, tokens, len(names))
    rest = np.array([n not in named or n == "other" for n in names])
    share = np.array([named.get(n, 0.0) for n in names])
    if rest.any() and own[rest].sum() > 0:
        share[rest] = named.get("other", 0.0) * own[rest] / own[rest].sum()
    share = np.where(own > 0, share, 0.0)
    return share / share.sum() if share.sum() > 0 else share


def rake(source, lang, topic, tokens, languages=None, topics=None, temper: float = TEMPER, rounds: int = MOST_ROUNDS) -> np.ndarray:
    """Sampling probability of each cell, as ``fit`` has it."""
    return fit(source, lang, topic, tokens, languages, topics, temper, rounds)[0]


def fit(source, lang, topic, tokens, languages=None, topics=None, temper: float = TEMPER, rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, float]:
    """Sampling probability of each cell by fitting the three margins in turn, and the largest error of a share.

    Fitting ends when no share is off by ``TOLERANCE``, when a round changes nothing any more (no weights of these
    cells have all margins), or after ``rounds`` rounds; what is left is the error.
    Cells without tokens have probability 1 (they weigh nothing). Cells whose target share is 0 have 0.
    """
    tokens = np.asarray(tokens, dtype=float)
    if not len(tokens) or tokens.sum() <= 0:
        return np.ones(len(tokens)), 0.0
    margins = []
    for values, named in ((source, None), (lang, languages or LANGUAGES), (topic, topics or TOPIC_SHARES)):
        values = np.asarray(values, dtype=object).astype(str)
        names, code = np.unique(values, return_inverse=True)
        if named is None:
            own = np.bincount(code, tokens, len(names))
            share = np.where(own > 0, (own / own.sum()) ** temper, 0.0)
            share = share / share.sum()
        else:
            share = _shares(values, tokens, named)
        margins.append((code, share, len(names)))
    weight = tokens / tokens.sum()
    off = lambda w: max(np.abs(np.bincount(code, w, n) - share).max() for code, share, n in margins)
    for _ in range(rounds):
        before = weight
        for code, share, n in margins:
            total = np.bincount(code, weight, n)
            weight = weight * np.divide(share, total, out=np.zeros(n), where=total > 0)[code]
        if off(weight) < TOLERANCE or np.abs(weight - before).max() < 1e-15:
            break
    ratio = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    top = ratio.max()
    return np.where(tokens > 0, ratio / top if top > 0 else 1.0, 1.0), float(off(weight))


def rake_table(table: DataFrame, **targets) -> DataFrame:
    """``fit`` over a cell table; cells are as many as distinct (source, language, topic), gathered by one task."""

    def run(batches):
        import pandas as pd
        import pyarrow as pa

        batches = list(batches)
        if not batches:
            return
        df = pa.Table.from_batches(batches).to_pandas().sort_values(["_source", "_lang", "_topic"], ignore_index=True)
        df["p"], df["margin_error"] = fit(df._source, df._lang, df._topic, df.tokens, **targets)
        yield pa.RecordBatch.from_pandas(pd.DataFrame(df), preserve_index=False)

    return table.coalesce(1).mapInArrow(run, "_source string, _lang string, _topic string, n_docs long, tokens long, p double, margin_error double")


def uniform(id_col: str = "doc_id") -> Column:
    """A number in [0, 1) fixed by the id: the first 48 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def with_probability(docs: DataFrame, tokens: str | None = None, **targets) -> DataFrame:
    """``docs`` with ``topic``, ``tokens``, ``p``, ``u``, ``sampled`` (``u < p``) and ``margin_error`` for every row.

    ``margin_error`` is the same for all rows: by how much the fitted share that is farthest from its target misses it.

    Null source and language are cells of their own (``?``); null or empty text weighs nothing; it is
    ``prose`` and has the probability of its cell. Repeated rows have the same ``u`` and stay or go together; so do all rows of a null
    id. A row whose ``u`` equals ``p`` isn't sampled. Columns of ``docs`` called like an added one are replaced, all
    others pass through whatever their names. An empty table gives an empty result. ``tokens`` names a column of
    token counts to weigh by (as ``bpe`` gives them; null is 0); without it a token is four bytes of text.

    One scan makes the cells (partial aggregation, the shuffle is one row a cell and task), one task rakes
    them, and a second scan looks probabilities up in the cells, broadcast where their files are small.
    """
    scratch = Scratch(docs.sparkSession)
    fitted = scratch.keep(rake_table(cells(docs, tokens), **targets).select("_source", "_lang", "_topic", "p", "margin_error"))
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    rows = docs.select(packed(docs, keep), *_keys(), token_weight(tokens=tokens).alias("tokens"), uniform().alias("u"))
    out = rows.join(scratch.small(fitted), ["_source", "_lang", "_topic"], "left")
    own = [F.col(f"row.`{c}`").alias(c) for c in keep]
    p = F.round("p", 9)
    return out.select(*own, F.col("_topic").alias("topic"), "tokens", p.alias("p"), "u", (F.col("u") < p).alias("sampled"), "margin_error")


def _rake_sql() -> str:
    """The fitting unrolled: each margin of each round is one common table expression."""

    def targets(named: dict[str, float]) -> str:
        return "(VALUES " + ", ".join(f"('{k}', {v!r}::double)" for k, v in named.items()) + ") v(k, s)"

    esc = lambda r: r.replace("'", "''")
    topic = "CASE " + " ".join(f"WHEN regexp_matches(text, '{esc(r)}') THEN '{n}'" for n, r in TOPICS) + " ELSE 'prose' END"
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, '?') AS a, coalesce(lang, '?') AS b, {topic} AS c, "
        "coalesce(ceil(strlen(text) / 4.0), 0)::bigint AS tokens FROM documents)",
        "cell AS MATERIALIZED (SELECT a, b, c, sum(tokens)::double AS t FROM d GROUP BY ALL)",
        f"ta AS MATERIALIZED (SELECT a, m / sum(m) OVER () AS s FROM (SELECT a, CASE WHEN sum(t) > 0 THEN pow(sum(t) / (SELECT sum(t) FROM cell), {TEMPER}::double) ELSE 0 END AS m FROM cell GROUP BY a))",
    ]
    for col, named in (("b", LANGUAGES), ("c", TOPIC_SHARES)):
        parts.append(
            f"t{col} AS MATERIALIZED (SELECT {col}, m / sum(m) OVER () AS s FROM (SELECT x.{col}, CASE WHEN own = 0 THEN 0 "
            f"WHEN v.s IS NOT NULL AND x.{col} <> 'other' THEN v.s ELSE {named['other']!r}::double * own / sum(CASE WHEN v.s IS NULL OR x.{col} = 'other' THEN own END) OVER () END AS m "
            f"FROM (SELECT {col}, sum(t) AS own FROM cell GROUP BY {col}) x LEFT JOIN {targets(named)} ON v.k = x.{col}))"
        )
    last = "w0"
    parts.append("w0 AS MATERIALIZED (SELECT a, b, c, t, t / sum(t) OVER () AS w FROM cell)")
    for r in range(ROUNDS):
        for col in "abc":
            now = f"w{r}{col}"
            parts.append(f"{now} AS MATERIALIZED (SELECT {last}.a, {last}.b, {last}.c, t, CASE WHEN sum(w) OVER (PARTITION BY {last}.{col}) > 0 THEN w * s / sum(w) OVER (PARTITION BY {last}.{col}) ELSE 0 END AS w FROM {last} JOIN t{col} USING ({col}))")
            last = now
    parts.append(f"fit AS (SELECT a, b, c, CASE WHEN t > 0 THEN (w / t) / max(CASE WHEN t > 0 THEN w / t END) OVER () ELSE 1 END AS p FROM {last})")
    return (
        "WITH " + ",\n".join(parts)
        + "\nSELECT doc_id, c AS topic, tokens, round(p, 6) AS p, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint::double / 281474976710656 < round(p, 9) AS sampled"
        " FROM d JOIN fit USING (a, b, c)"
    )


MIXING_SQL = _rake_sql()

"""Embedding: a deterministic embedder as column expressions, and an Arrow adapter for any other."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.runtime import ensure_importable

_MOD = 1 << 32
#: Texts that an embedder gets at once; queries whose vectors the driver remembers.
BATCH, QUERY_CACHE = 64, 1000


def text_hash(text) -> Column:
    """32-bit multiply and exclusive-or hash over a text's bytes."""
    text = F.col(text) if isinstance(text, str) else text
    digits = F.hex(text.cast("binary"))
    n = (F.length(digits) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    byte = lambda k: F.conv(F.substring(digits, k * 2 - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(at, F.lit(0).cast("long"), lambda h, k: ((h * 16777619) % _MOD).bitwiseXOR(byte(k)))


def simple_embedding(text, dim: int = 64) -> Column:
    """Deterministic vector of a text: a linear congruential sequence that its hash seeds, values in [0, 1).

    One pass over the text for its hash, then ``dim`` steps; nothing leaves the JVM. Null text gives null.
    """
    dim = dim if dim > 0 else 64
    start = F.struct(text_hash(text).alias("s"), F.array().cast("array<double>").alias("v"))

    def step(acc, _):
        s = (acc["s"] * 1664525 + 1013904223) % _MOD
        return F.struct(s.alias("s"), F.concat(acc["v"], F.array((s % 10000) / F.lit(10000.0))).alias("v"))

    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(dim)), start, step, lambda acc: acc["v"]))


class Embedder(Protocol):
    """What turns texts into vectors; ``embed`` returns the vectors and the tokens used."""

    def embed(self, texts: Sequence[str]) -> tuple[list[list[float]], int]: ...


class SimpleEmbedder:
    """The deterministic embedder over a batch in NumPy; the same vectors as :func:`simple_embedding`."""

    def __init__(self, dim: int = 64):
        self.dim = dim if dim > 0 else 64

    def embed(self, texts: Sequence[str]) -> tuple[list[list[float]], int]:
        out = []
        for text in texts:
            h = 0
            for b in text.encode():
                h = (h * 16777619 % _MOD) ^ b
            row = []
            for _ in range(self.dim):
                h = (h * 1664525 + 1013904223) % _MOD
                row.append(h % 10000 / 10000.0)
            out.append(row)
        return out, sum(len(t.split()) for t in texts)


class Retrying:
    """An embedder that repeats transient failures, waiting twice as long each time."""

    def __init__(self, inner: Embedder, tries: int = 3, wait: float = 0.5, transient=(ConnectionError, TimeoutError)):
        self.inner, self.tries, self.wait, self.transient = inner, tries, wait, transient

    def embed(self, texts: Sequence[str]) -> tuple[list[list[float]], int]:
        for k in range(self.tries):
            try:
                return self.inner.embed(texts)
            except self.transient:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**k)
        raise ValueError("tries must be positive")


def embed_documents(df: DataFrame, make: Callable[[], Embedder], text: str = "content", batch: int = BATCH) -> DataFrame:
    """``df`` with ``embedding`` and ``tokens`` (of its batch, on the batch's first row).

    ``make`` builds the embedder once a task. Texts go to it ``batch`` at a time (null as empty); a wrong number
    of vectors is an error.
    """
    ensure_importable(df.sparkSession)
    keep = [c for c in df.columns if c not in ("embedding", "tokens")]
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("tokens", T.LongType())]
    )

    def run(batches):
        embedder = make()
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                texts = [t or "" for t in part.column(text).to_pylist()]
                vectors, tokens = embedder.embed(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(texts)} texts, but {len(vectors)} vectors")
                used = np.zeros(len(texts), dtype=np.int64)
                used[:1] = tokens
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(vectors, pa.list_(pa.float32())), pa.array(used)],
                    names=[*keep, "embedding", "tokens"],
                )

    return df.select(*keep).mapInArrow(run, schema)


def query_embedder(make: Callable[[], Embedder], capacity: int = QUERY_CACHE) -> Callable[[str, str], list[float]]:
    """A function (model, query) -> vector that remembers the latest ``capacity`` queries on the driver."""
    embedder = make()

    @lru_cache(maxsize=capacity)
    def look_up(model: str, query: str) -> tuple[float, ...]:
        return tuple(embedder.embed([query])[0][0])

    return lambda model, query: list(look_up(model, query))

"""Scalar column builders: hashes, identities, paths, metadata. All stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def raw(text) -> Column:
    """A text's UTF-8 bytes."""
    return _c(text).cast("binary")


def byte_slice(text, start, length) -> Column:
    """``length`` bytes of a text from byte ``start`` (0 is the first), as binary."""
    start, length = (F.lit(x) if isinstance(x, int) else _c(x) for x in (start, length))
    return F.substring(raw(text), start.cast("int") + 1, length.cast("int"))


def checksum32(data) -> Column:
    """First four bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(_c(data), 256), 1, 8), 16, 10).cast("long")


def content_hash(text) -> Column:
    """First eight bytes of MD5 as an unsigned decimal; 0 for empty content."""
    number = F.conv(F.substring(F.md5(_c(text)), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(_c(text)) == 0, F.lit(0).cast("decimal(20,0)")).otherwise(number)


def namespace_hash(name) -> Column:
    """An opaque 64-bit name for a namespace (xxHash)."""
    return F.xxhash64(_c(name))


def server_name(name) -> Column:
    """A name with everything but letters, digits, dot, dash and underscore replaced by underscores."""
    return F.regexp_replace(_c(name), r"[^A-Za-z0-9._-]", "_")


def relative_path(path, base: str) -> Column:
    """``path`` below folder ``base``; unchanged if it isn't below it."""
    root = base.rstrip("/") + "/"
    return F.when(F.startswith(_c(path), F.lit(root)), F.substring(_c(path), len(root) + 1, 1 << 30)).otherwise(_c(path))


def file_uri(path) -> Column:
    """``file://`` URI of an absolute path."""
    return F.concat(F.lit("file://"), _c(path))


def hex_lower(data) -> Column:
    """Lower-case hexadecimal of bytes."""
    return F.lower(F.hex(_c(data)))


def vector_of_hex(text) -> Column:
    """Floats of a vector's hexadecimal bytes (four each, the lowest byte first); null for null, an empty array for none.

    The bits are taken apart in arithmetic that doubles do exactly. Bytes left over at the end are ignored.
    """
    text = _c(text)

    def one(i: Column) -> Column:
        part = F.substring(text, i * 8 + 1, F.lit(8))
        bits = F.conv(F.concat(*(F.substring(part, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1))), 16, 10).cast("long")
        power, rest = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND(0x7FFFFF).cast("double")
        size = F.when(power == 0, rest * 2.0**-149).when(power < 255, (1 + rest * 2.0**-23) * F.pow(F.lit(2.0), power - 127))
        size = F.coalesce(size, F.when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        return F.when(bits >= 1 << 31, -size).otherwise(size).cast("float")

    count = F.floor(F.length(text) / 8).cast("int")
    return F.when(count == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), one))


def hex_of_vector(vector) -> Column:
    """A vector's hexadecimal bytes, as ``vector_of_hex`` reads them; null for null.

    Arrow batches, since no built-in gives a float's bits.
    """

    @F.pandas_udf("string")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes().hex())

    return encode(_c(vector))


def csv_items(text) -> Column:
    """Comma-separated items, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def text_or_empty(value) -> Column:
    """A value as text; null is empty."""
    return F.coalesce(_c(value).cast("string"), F.lit(""))


def meta_text(meta, key: str) -> Column:
    """A key of JSON metadata as text; empty where absent."""
    return F.coalesce(F.get_json_object(_c(meta), f"$.{key}"), F.lit(""))


def meta_size(meta) -> Column:
    """Size that the metadata names under ``size``, else under ``bytes``, else 0."""
    number = [F.get_json_object(_c(meta), f"$.{k}").cast("double").cast("long") for k in ("size", "bytes")]
    return F.coalesce(*number, F.lit(0)).cast("long")


def asset_of(meta, doc_id) -> Column:
    """Struct of ``asset_id``, ``path``, ``md5`` that a document's metadata and id name.

    The asset id falls back to the id before ``#`` (if something is before it), then to the id. ``path`` wins
    over ``rel_path``, and falls back to the asset id.
    """
    own = F.nullif(meta_text(meta, "asset_id"), F.lit(""))
    cut = F.instr(_c(doc_id), "#")
    asset = F.coalesce(own, F.when(cut > 1, F.substring_index(_c(doc_id), "#", 1)).otherwise(_c(doc_id)))
    named = [F.nullif(meta_text(meta, k), F.lit("")) for k in ("path", "rel_path")]
    return F.struct(asset.alias("asset_id"), F.coalesce(*named, asset).alias("path"), meta_text(meta, "md5").alias("md5"))


def fragment_name(fragment_id, document_id, start, end) -> Column:
    """A fragment's id: the given one, else ``document:start-end`` (``doc`` without a document)."""
    first = F.coalesce(_c(start).cast("long"), F.lit(0))
    last = F.greatest(F.coalesce(_c(end).cast("long"), F.lit(0)), first)
    stem = F.coalesce(F.nullif(_c(document_id), F.lit("")), F.lit("doc"))
    return F.coalesce(F.nullif(_c(fragment_id), F.lit("")), F.format_string("%s:%d-%d", stem, first, last))


def location(path, doc_id) -> Column:
    """Where a match is shown: its path, else its id."""
    return F.coalesce(F.nullif(_c(path), F.lit("")), _c(doc_id))


def utc_micros(ts) -> Column:
    """A timestamp as text with six decimals."""
    return F.date_format(F.date_trunc("MICROSECOND", _c(ts)), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def varint_size(n) -> Column:
    """Bytes of an unsigned number in base 128."""
    bits = F.when(_c(n) > 0, F.length(F.bin(_c(n).cast("long")))).otherwise(F.lit(1))
    return F.ceil(bits / 7).cast("int")


def record_bytes(value) -> Column:
    """Bytes that a value takes in a segment: its length, itself and a checksum of four bytes."""
    n = F.octet_length(_c(value))
    return (varint_size(n) + n + 4).cast("long")


def is_binary(data) -> Column:
    """Whether bytes hold NUL or aren't UTF-8 (null isn't binary)."""
    text = raw(data).cast("string")
    return F.coalesce(F.contains(text, F.lit("\x00")) | ~F.is_valid_utf8(text), F.lit(False))


def is_binary_content(data) -> Column:
    """``is_binary``, or more than a tenth of the first 1,024 bytes are control bytes other than tab and line ends."""
    body = raw(data)
    head = F.substring(body, 1, 1024)
    controls = F.regexp_count(head.cast("string"), F.lit(r"[\x01-\x08\x0b\x0c\x0e-\x1f]"))
    return is_binary(data) | (controls > F.floor(F.least(F.octet_length(body), F.lit(1024)) / 10))

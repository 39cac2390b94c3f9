"""Grep with context, reading by range, and listing, as column expressions over a table of files."""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions.scalars import is_binary
from veldspar.operators.matching import listed

#: Defaults of a search: bytes and lines of a snippet, files, snippets, bytes read of a file.
SNIPPET_BYTES, SNIPPET_LINES, MAX_FILES, MAX_BLOCKS, MAX_SIZE = 512, 32, 20, 200, 1 << 20
READ_BYTES = 8192


def split_patterns(expression: str) -> list[str]:
    """Alternatives of a pattern expression: parted by `` or `` (any case) and by ``|``."""
    parts = re.split(r" or ", expression.strip(), flags=re.IGNORECASE)
    return [p.strip() for part in parts for p in part.split("|") if p.strip()]


#: What linear-time expressions don't have: look-around, atomic groups, back references, possessive repetition.
_FOREIGN = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+)")
#: What makes a line's match depend on what is around it; texts can't be tested as wholes then.
_SURROUNDED = re.compile(r"[\^$]|\\[AzZGbB]|\(\?[^:]")


def _java(pattern: str) -> str:
    """The pattern as Java's expressions have it: named groups are ``(?<name>``, their names letters and digits."""
    return re.sub(r"\(\?P<([A-Za-z_]\w*)>", lambda m: "(?<g" + m.group(1).replace("_", "0") + ">", pattern)


def _compiles(pattern: str) -> bool:
    """Whether the engine that runs expressions takes the pattern (asked of the driver's JVM)."""
    if _FOREIGN.search(pattern):
        return False
    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def compile_patterns(patterns: list[str], ignore_case: bool = False) -> str | None:
    """One Java expression for any of the patterns; one that doesn't compile is taken literally. None for none."""
    out = []
    for p in patterns:
        own = _java(p)
        out.append(f"(?:{own if _compiles(own) else re.escape(p)})")
    return None if not out else ("(?i)" if ignore_case else "") + "|".join(out)


def line_matches(line, include: str | None, exclude: str | None = None) -> Column:
    """Whether a line has a match and none of the exclusions."""
    line = F.col(line) if isinstance(line, str) else line
    hit = F.lit(True) if include is None else F.rlike(line, F.lit(include))
    return hit if exclude is None else hit & ~F.rlike(line, F.lit(exclude))


def cut_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of a text, without the part of a character that the cut leaves."""
    short = F.substring(text.cast("binary"), 1, limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(_whole_characters(short))


def _whole_characters(data: Column) -> Column:
    """Bytes as text, an incomplete character at the end left out."""
    out = data.cast("string")
    n = F.octet_length(data)
    for k in (1, 2, 3):
        out = F.when(F.is_valid_utf8(out), out).otherwise(F.substring(data, F.lit(1), n - k).cast("string"))
    return out


def matching_lines(files: DataFrame, pattern: str, exclude: str = "", ignore_case: bool = False, text: str = "text") -> DataFrame:
    """``files`` with the numbers (from 0) of their matching ``lines`` as ``hits``; files without any are left out."""
    include = compile_patterns(split_patterns(pattern), ignore_case)
    if include is None:
        raise ValueError("the pattern is empty")
    drop = compile_patterns(split_patterns(exclude), ignore_case)
    lines = F.split(F.col(text), "\n", -1)
    numbered = F.filter(F.transform(lines, lambda x, i: F.when(line_matches(x, include, drop), i)), lambda i: i.isNotNull())
    if not _SURROUNDED.search(include.removeprefix("(?i)")):  # texts without any match aren't split
        files = files.where(F.rlike(F.col(text), F.lit(include)))
    return files.withColumn("hits", numbered).where(F.size("hits") > 0)


def grep(
    files: DataFrame, pattern: str, exclude_pattern: str = "", ignore_case: bool = False, include=(), exclude=(), mode: str = "match",
    snippet_bytes: int = SNIPPET_BYTES, snippet_lines: int = SNIPPET_LINES, max_files: int | None = MAX_FILES,
    max_blocks: int | None = MAX_BLOCKS, max_size: int = MAX_SIZE, path: str = "path", text: str = "text",
) -> DataFrame:
    """Matching files in order of path: ``path``, ``matches``, ``snippets`` (start_line, end_line, text, cut).

    In ``match`` mode every matching line has a snippet of ``snippet_lines`` lines around it; in ``head`` mode a
    file has its first lines. Files with NUL or invalid UTF-8 are left out; longer files are cut to
    ``max_size`` bytes between characters. ``max_files`` and ``max_blocks`` are features of the search (None
    lifts them): files come until so many match, snippets until so many were made.
    """
    rows = files.where(listed(path, include, exclude) & ~is_binary(text)).select(F.col(path).alias("path"), cut_bytes(F.col(text), max_size).alias("text"))
    rows = matching_lines(rows, pattern, exclude_pattern, ignore_case).withColumn("matches", F.size("hits").cast("long"))
    # each file of a match takes a block, so no more files than blocks are asked for
    most = [n for n in (max_files, max_blocks if mode != "head" else None) if n is not None]
    if most:
        rows = rows.orderBy("path").limit(min(most))
    lines = F.split("text", "\n", -1)

    def snippet(start: Column) -> Column:
        end = F.least(start + snippet_lines, F.size(lines))
        whole = F.array_join(F.slice(lines, start + 1, end - start), "\n")
        return F.struct(
            (start + 1).cast("long").alias("start_line"), end.cast("long").alias("end_line"), cut_bytes(whole, snippet_bytes).alias("text"),
            (F.octet_length(whole) > snippet_bytes).alias("cut"),
        )

    if mode == "head":
        return rows.select("path", "matches", F.array(snippet(F.lit(0))).alias("snippets"))
    found = "hits"
    if max_blocks is not None:  # of at most ``max_blocks`` files, as above
        before = F.sum("matches").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_left", F.lit(max_blocks) - F.coalesce(before, F.lit(0))).where("_left > 0")
        rows = rows.withColumn("hits", F.slice("hits", F.lit(1), F.least(F.size("hits"), F.col("_left").cast("int"))))
    return rows.select("path", "matches", F.transform(found, lambda i: snippet(F.greatest(i - snippet_lines // 2, F.lit(0)))).alias("snippets"))


def grep_file(files: DataFrame, file: str, pattern: str, max_blocks: int = MAX_BLOCKS, max_size: int = MAX_SIZE, path: str = "path", text: str = "text", **options) -> DataFrame:
    """One file's ``path``, ``matches``, ``snippets`` and ``truncated``: whether its text or its snippets were cut.

    A file without a match has no row; a binary one neither. Other options are those of ``grep``.
    """
    one = files.where(F.col(path) == file)
    found = grep(one, pattern, max_files=None, max_blocks=max_blocks, max_size=max_size, path=path, text=text, **options)
    size = one.select(F.col(path).alias("path"), F.octet_length(text).alias("_size"))
    cut = (F.col("_size") > max_size) | (F.col("matches") > F.size("snippets")) & F.lit(options.get("mode", "match") != "head")
    return found.join(size, "path").select("path", "matches", "snippets", cut.alias("truncated"))


def grep_stats(files: DataFrame, pattern: str, exclude_pattern: str = "", ignore_case: bool = False, text: str = "text") -> DataFrame:
    """Files scanned and matched, and lines matched, in one pass."""
    include, drop = (compile_patterns(split_patterns(p), ignore_case) for p in (pattern, exclude_pattern))
    hits = F.size(F.filter(F.split(F.col(text), "\n", -1), lambda x: line_matches(x, include, drop)))
    return files.where(F.col(text).isNotNull()).select(hits.alias("h")).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("h") > 0).alias("matched"), F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("lines")
    )


def search_hash(request: dict) -> str:
    """Twelve hexadecimal digits that name a search request."""
    import hashlib

    return hashlib.sha1(json.dumps(request, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def search_hash_column(request) -> Column:
    """``search_hash`` of a request that is JSON already."""
    return F.substring(F.sha1(F.col(request) if isinstance(request, str) else request), 1, 12)


def clip_bytes(text, offset: int = 0, length: int = 0) -> Column:
    """Struct of ``data`` (binary), ``start``, ``end``: ``length`` bytes from ``offset``, to the end without a length."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.octet_length(text)
    start = F.least(F.lit(max(offset, 0)), n)
    end = F.least(F.lit(offset + length), n) if length > 0 else n
    end = F.greatest(end, start)
    return F.struct(
        F.substring(text.cast("binary"), start + 1, end - start).alias("data"), start.cast("long").alias("start"), end.cast("long").alias("end")
    )


def clip_lines(text, start_line: int = 0, count: int = 0) -> Column:
    """Struct of ``data``, ``start``, ``end`` (bytes): ``count`` lines from ``start_line`` (1 is the first), or all after it.

    A newline at the text's end begins no line. The range ends before the newline of its last line, but for
    the text's last line, whose newline belongs to it.
    """
    text = F.col(text) if isinstance(text, str) else text
    n = F.octet_length(text)
    if start_line <= 0 and count <= 0:
        return F.struct(text.cast("binary").alias("data"), F.lit(0).cast("long").alias("start"), n.cast("long").alias("end"))
    lines = F.split(text, "\n", -1)
    total = F.size(lines) - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)
    total = F.greatest(total, F.lit(1))
    first = F.least(F.lit(max(start_line - 1, 0)), total)
    last = F.least(first + count, total) if count > 0 else total

    def offset(k: Column) -> Column:
        return F.aggregate(F.slice(lines, F.lit(1), k), F.lit(0), lambda s, x: s + F.octet_length(x) + 1)

    start = F.when(first < total, offset(first)).otherwise(n)
    end = F.greatest(F.when(last < total, offset(last) - 1).otherwise(n), start)
    return F.struct(
        F.substring(text.cast("binary"), start + 1, end - start).alias("data"), start.cast("long").alias("start"), end.cast("long").alias("end")
    )


def head(text, max_bytes: int = READ_BYTES, max_lines: int = 0) -> Column:
    """First bytes, or first lines if ``max_lines`` is positive (bytes then don't matter); binary."""
    text = F.col(text) if isinstance(text, str) else text
    if max_lines > 0:
        return F.array_join(F.slice(F.split(text, "\n", -1), 1, max_lines), "\n").cast("binary")
    return F.substring(text.cast("binary"), 1, max_bytes) if max_bytes > 0 else text.cast("binary")


def tail(text, max_bytes: int = READ_BYTES, max_lines: int = 0) -> Column:
    """Last bytes or lines; binary."""
    text = F.col(text) if isinstance(text, str) else text
    if max_lines > 0:
        lines = F.split(text, "\n", -1)
        n = F.least(F.size(lines), F.lit(max_lines))
        return F.array_join(F.slice(lines, F.size(lines) - n + 1, n), "\n").cast("binary")
    n = F.octet_length(text)
    return F.substring(text.cast("binary"), F.greatest(n - max_bytes, F.lit(0)) + 1, F.lit(max_bytes)) if max_bytes > 0 else text.cast("binary")


SIGNATURE = r"^\s*(?:(?:class|def|func|import|interface|package|private|protected|public)|\w+\s+\w+\()"


def signatures(text, max_bytes: int = 0) -> Column:
    """Lines that look like declarations, joined, at most ``max_bytes`` bytes."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(SIGNATURE))), "\n")
    return cut_bytes(found, max_bytes) if max_bytes > 0 else found


def read(files: DataFrame, offset: int = 0, length: int = 0, start_line: int = 0, line_count: int = 0, max_bytes: int = 0, path: str = "path", text: str = "text") -> DataFrame:
    """Part of each file: ``path``, ``data``, ``size``, ``returned``, ``remaining``, ``next_offset``.

    Lines are chosen before bytes; ``max_bytes`` cuts what is chosen. ``next_offset`` says where to go on if some
    limit was asked for and bytes are left; else it is null.
    """
    by_lines = start_line > 0 or line_count > 0
    part = clip_lines(text, start_line, line_count) if by_lines else clip_bytes(text, offset, length)
    rows = files.select(F.col(path).alias("path"), F.octet_length(text).cast("long").alias("size"), part.alias("p"))
    data = F.substring("p.data", 1, max_bytes) if max_bytes > 0 else F.col("p.data")
    rows = rows.select("path", "size", data.alias("data"), F.col("p.start").alias("_start")).withColumn("returned", F.octet_length("data").cast("long"))
    left = F.greatest(F.col("size") - F.col("_start") - F.col("returned"), F.lit(0)).cast("long")
    limited = by_lines or offset > 0 or length > 0 or max_bytes > 0
    after = F.when(left > 0, F.col("_start") + F.col("returned")) if limited else F.lit(None).cast("long")
    return rows.select("path", "data", "size", "returned", left.alias("remaining"), after.alias("next_offset"))


def list_files(files: DataFrame, include=(), exclude=(), folder: str = "", recursive: bool = True, limit: int | None = None, path: str = "path") -> DataFrame:
    """Files below ``folder`` that the globs let through, in order of path, at most ``limit`` (a feature of listing).

    Without ``recursive`` only the folder's own files are listed.
    """
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    rows = files.where(listed(path, include, exclude))
    if prefix:
        rows = rows.where(F.startswith(F.col(path), F.lit(prefix)))
    if not recursive:
        rows = rows.where(~F.contains(F.substring(F.col(path), len(prefix) + 1, 1 << 30), F.lit("/")))
    rows = rows.orderBy(path)
    return rows if limit is None else rows.limit(limit)

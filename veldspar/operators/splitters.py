"""Splitting files into fragments: by size as expressions; code, Markdown and office files in Arrow batches."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.scalars import byte_slice, checksum32, fragment_name
from veldspar.runtime import ensure_importable

CHUNK, LARGE = 4096, 1 << 20
#: Kind of splitter by file ending.
KINDS = {
    "go": "code", "java": "code", "py": "code", "js": "code", "ts": "code", "jsx": "code", "tsx": "code",
    "md": "markdown", "pdf": "pdf", "docx": "docx", "xlsx": "excel", "xlsm": "excel", "xltx": "excel", "xltm": "excel", "xls": "xls",
}
LANGUAGES = {"go": "go", "java": "java", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}


def splitter_kind(path, size) -> Column:
    """Which splitter a file gets: by its ending; ``large`` above 1 MiB; else ``size``."""
    path = F.col(path) if isinstance(path, str) else path
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    size = F.col(size) if isinstance(size, str) else size
    return F.coalesce(F.element_at(known, ending), F.when(size > LARGE, F.lit("large")).otherwise(F.lit("size")))


def size_chunks(docs: DataFrame, text: str = "text", size: int = CHUNK) -> DataFrame:
    """``docs`` (without the text) by chunk of ``size`` bytes: ``start``, ``end``, ``chunk`` (binary), ``checksum``.

    Chunks may cut a character. Empty and null texts have none. All in generated code, one row a chunk.
    """
    keep = [c for c in docs.columns if c != text]
    n = F.octet_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    rows = docs.select(*keep, text, F.explode(starts).alias("start"))
    rows = rows.select(
        *keep, F.col("start").cast("long"), F.least(F.col("start") + size, n).cast("long").alias("end"), byte_slice(text, "start", size).alias("chunk")
    )
    return rows.withColumn("checksum", checksum32("chunk"))


def chunk_documents(chunks: DataFrame, path="path") -> DataFrame:
    """Chunks as documents: ``id`` (``path:start-end``), ``content`` and JSON ``meta``."""
    name = fragment_name(F.lit(""), path, "start", "end")
    meta = F.to_json(F.struct(F.col(path).alias("path"), "start", "end", "checksum", F.lit("binary").alias("kind"), name.alias("fragmentId")))
    return chunks.withColumn("id", name).withColumn("meta", meta)


def _regexes(language: str) -> tuple[re.Pattern, re.Pattern]:
    name, args = r"\w+", r"\([^)]*\)"
    function, kind = {
        "go": (rf"func\s+{name}\s*{args}", rf"type\s+{name}\s+(?:interface|struct)"),
        "java": (rf"(?:private|protected|public)?\s+{name}\s+{name}\s*{args}\s*\{{", rf"\s+class\s+{name}"),
        "python": (rf"def\s+{name}\s*\(", rf"class\s+{name}"),
        "script": (rf"function\s+{name}\s*\(|{name}\s*=\s*function\s*\(|{name}\s*{args}\s*\{{", rf"class\s+{name}"),
    }.get("script" if language in ("javascript", "typescript") else language, (rf"(?:def|func|function)\s+{name}", rf"(?:class|type)\s+{name}"))
    return re.compile(function, re.ASCII), re.compile(kind, re.ASCII)


def code_boundaries(data: bytes, language: str) -> list[int]:
    """Offsets of lines after the first that begin a function or a type."""
    function, kind = _regexes(language)
    out, at = [], 0
    for line in data.split(b"\n"):
        text = line.decode("latin-1")
        if at and (function.search(text) or kind.search(text)):
            out.append(at)
        at += len(line) + 1
    return out


_ATX = re.compile(rb"^ {0,3}#{1,6}(?: .*)?$", re.DOTALL)
_SETEXT = re.compile(rb"^ {0,3}(?:={3,}|-{3,})\s*$")


def heading_boundaries(data: bytes) -> list[int]:
    """Offsets of headings after the text's begin: ``#`` lines, and lines underlined by ``===`` or ``---``.

    An underline counts from the third line on, below a line that isn't blank; a heading line that is
    underlined as well stands twice.
    """
    out, at, before = [], 0, b""
    for k, line in enumerate(data.split(b"\n")):
        if _ATX.match(line):
            if at:
                out.append(at)
        elif k > 1 and _SETEXT.match(line) and before.strip():
            out.append(at - len(before) - 1)
        before = line
        at += len(line) + 1
    return out


def by_size(data: bytes, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """Spans of at most about ``size`` bytes, ended after a newline where the span's second half has one."""
    out = []
    while start < end:
        stop = min(start + size, end)
        if stop < end:
            newline = data.rfind(b"\n", start + size // 2 + 1, stop + 1)
            if newline >= 0:
                stop = newline + 1
        out.append((start, stop))
        start = stop
    return out


def by_boundaries(data: bytes, boundaries: list[int], size: int) -> list[tuple[int, int]]:
    """Spans between boundaries, those above ``size`` cut further; spans of no length are left out."""
    if len(data) <= size:
        return [(0, len(data))] if data else []
    out, start = [], 0
    for b in boundaries:
        if b - start > size:
            out += by_size(data, start, b, size)
        elif b > start:
            out.append((start, b))
        start = max(start, b)
    return out + by_size(data, start, len(data), size)


def _plain_chunks(data: bytes, size: int) -> list[tuple[int, int]]:
    return [(k, min(k + size, len(data))) for k in range(0, len(data), size)]


def printable(data: bytes) -> bytes:
    """Printable ASCII and white space of a binary file."""
    return bytes(b for b in data if b in b"\t\n\r" or 32 <= b < 127)


def pdf_text(data: bytes) -> bytes:
    """Text of a PDF. No PDF library is assumed, so this is the printable part."""
    return printable(data)


def docx_text(data: bytes) -> bytes:
    """Text of a DOCX: paragraphs and table rows end lines, cells end with tabs; else the printable part."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as f:
            out, ended = [], False
            for event, node in ElementTree.iterparse(f, events=("start", "end")):
                tag = node.tag.rpartition("}")[2]
                if event == "start":
                    if tag == "tab":
                        out.append("\t")
                        ended = False
                    elif tag in ("br", "cr"):
                        out.append("\n")
                        ended = True
                elif tag in ("t", "instrText"):
                    out.append(node.text or "")
                    ended = False
                elif tag in ("p", "tr") and not ended:
                    out.append("\n")
                    ended = True
                elif tag == "tc" and not ended:
                    out.append("\t")
            return "".join(out).encode()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return printable(data)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n


def read_workbook(data: bytes) -> list[tuple[str, list[dict[int, tuple[str, str]]]]]:
    """Sheets of an XLSX: name and rows, a row by column number to (value, formula)."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{space}t")))
        target = {}
        for rel in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            path = rel.get("Target", "")
            target[rel.get("Id")] = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet"):
            rows: list[dict[int, tuple[str, str]]] = []
            for row in ElementTree.fromstring(z.read(target[sheet.get(link)])).iter(f"{space}row"):
                number = int(row.get("r") or len(rows) + 1)
                while len(rows) < number:
                    rows.append({})
                for k, cell in enumerate(row.iter(f"{space}c"), 1):
                    value = cell.findtext(f"{space}v") or ""
                    if cell.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{space}t"))
                    rows[number - 1][_column(cell.get("r") or "") or k] = value, cell.findtext(f"{space}f") or ""
            out.append((sheet.get("name", ""), rows))
        return out


def workbook_chunks(data: bytes, size: int) -> tuple[list[tuple[int, int, dict]], bytes]:
    """Fragments (start, end, meta) of a workbook and the text they lie in.

    Each fragment repeats its sheet's header. A row that doesn't fit begins the next fragment, so one below
    a header may hold the header alone.
    """
    found, full = [], bytearray()

    def shown(value: str, formula: str) -> str:
        if not formula:
            return value
        return f"{value} (f={formula})" if value else f"f={formula}"

    for sheet, rows in read_workbook(data):
        if not rows:
            continue
        header = rows[0]
        width = max(header, default=0)
        head = f"Sheet: {sheet}\nHeader: " + "\t".join(header.get(c, ("", ""))[0] for c in range(1, width + 1)) + "\n"
        chunk, first, last = head, 1, 1

        def close():
            start = len(full)
            full.extend(chunk.encode())
            meta = {"sheet": sheet, "start_row": str(first), "end_row": str(last), "row_range": f"{first}-{last}", "header_row": "1"}
            found.append((start, len(full), meta))

        for number, row in enumerate(rows[1:], 2):
            columns = max(width, max(row, default=0))
            line = f"Row {number}: " + "\t".join(shown(*row.get(c, ("", ""))) for c in range(1, columns + 1))
            if len(chunk.encode()) + len(line.encode()) + 1 > size:
                close()
                chunk, first = head, number
            chunk += line + "\n"
            last = number
        close()
    return found, bytes(full)


def split_file(path: str, data: bytes, size: int = CHUNK) -> list[tuple[int, int, bytes, str, dict]]:
    """Fragments of one file: start, end, content, kind and metadata."""
    ending = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    kind, extra = KINDS.get(ending, "binary"), {}
    if not data:
        return []
    if kind == "code":
        extra = {"language": LANGUAGES[ending]}
        spans = by_boundaries(data, code_boundaries(data, LANGUAGES[ending]) if len(data) > size else [], size)
    elif kind == "markdown":
        spans = by_boundaries(data, heading_boundaries(data) if len(data) > size else [], size)
    elif kind == "excel":
        try:
            found, full = workbook_chunks(data, size)
            return [(a, z, full[a:z], kind, m) for a, z, m in found]
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError):
            kind, spans = "binary", _plain_chunks(data, size)
    else:
        if kind in ("pdf", "docx"):
            data = pdf_text(data) if kind == "pdf" else docx_text(data)
        # XLS has no reader here: it is cut by size, as an unreadable file is
        kind, spans = "binary", _plain_chunks(data, size)
    return [(a, z, data[a:z], kind, extra) for a, z in spans]


FRAGMENTS = "path string, start long, end long, content binary, checksum long, kind string, meta map<string,string>"


def split_files(files: DataFrame, size: int = CHUNK, path: str = "path", content: str = "content") -> DataFrame:
    """Fragments of files (``path``, ``content`` binary) by their kind's splitter, in Arrow batches, no shuffle.

    A null path is cut by size; null and empty files have no fragments.
    """
    ensure_importable(files.sparkSession)

    def run(batches):
        names = ["path", "start", "end", "content", "checksum", "kind", "meta"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1)):
                rows = [
                    (p.as_py(), a, z, c, int(hashlib.sha256(c).hexdigest()[:8], 16), kind, list(({"path": p.as_py() or ""} | extra).items()))
                    for a, z, c, kind, extra in split_file(p.as_py() or "", data.as_py() or b"", size)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, FRAGMENTS)

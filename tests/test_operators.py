"""Path rules, splitters, embedding, vectors, lexical search and pages on small cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veldspar.functions import embedding, scalars
from veldspar.functions.globs import segment_regex
from veldspar.operators import lexical, splitters, vectors
from veldspar.operators.matching import PathRules, listed, parse_gitignore

RULES = [
    ("s3://b/dir/foo_test.go", 1, [], ["**/*_test.go"], 0, True),
    ("s3://b/dir/foo.go", 1, [], ["**/*_test.go"], 0, False),
    ("s3://b/dir/foo.go", 1, ["**/*.go"], ["**/*_test.go"], 0, False),
    ("s3://b/dir/foo_test.go", 1, ["**/*.go"], ["**/*_test.go"], 0, True),
    ("s3://b/dir/readme.txt", 1, ["**/*.go"], [], 0, True),
    ("s3://b/app/node_modules/pkg/index.js", 1, [], ["node_modules/"], 0, True),
    ("s3://b/app/modules/node_modules.js", 1, [], ["node_modules/"], 0, False),
    ("s3://b/app/vendor/x.com/mod/file.go", 1, [], ["**/vendor/**"], 0, True),
    ("/tmp/a/c/file.min.js", 1, [], ["*.min.js"], 0, True),
    ("/tmp/a/.DS_Store", 1, [], [".DS_Store"], 0, True),
    ("/tmp/a/big.bin", 101, [], [], 100, True),
    ("/tmp/a/small.bin", 99, [], [], 100, False),
    ("gs://b/dir/note.txt", 1, [], ["**/note.txt"], 0, True),
    ("dir/sub/file.go", 1, [], ["dir/**"], 0, True),
    ("s3://b/app/adir/file.go", 1, [], ["dir/"], 0, False),
    ("C:\\repo\\dir\\file_test.go", 1, [], ["**/*_test.go"], 0, True),
    ("a/b.log", 1, [], ["*.log", "!b.log", "#x", ""], 0, False),
    ("app/bin/x", 1, [], None, 0, True),
]


@pytest.mark.parametrize("path, size, include, exclude, most, excluded", RULES)
def test_path_rules(spark, path, size, include, exclude, most, excluded):
    got = spark.createDataFrame([(path, size)], "p string, n int").select(PathRules(include, exclude, most).excluded("p", "n")).first()[0]
    assert got is excluded


def test_gitignore(spark):
    rules = PathRules(exclude=parse_gitignore("\n# c\n*.log\ndist/\n**/*_test.go\n!keep.log\n/build\ntmp/\ndocs/*.md\n**/cache/**\n"))
    cases = {
        "app/debug.log": True, "app/keep.log": False, "app/dist/main.js": True, "app/foo_test.go": True, "app/main.go": False, "build/app.js": True,
        "dir/build/app.js": False, "tmp/f.txt": True, "dir/tmp/f.txt": True, "docs/r.md": True, "dir/docs/r.md": False, "dir/cache/f.bin": True, "tmp": False,
    }
    df = spark.createDataFrame([(f"s3://b/{p}", p) for p in cases], "p string, k string")
    assert {r.k: r.x for r in df.select("k", rules.excluded("p").alias("x")).collect()} == cases


def test_listing_globs(spark):
    df = spark.createDataFrame([(p,) for p in ("a.go", "x/b.go", "x/y/c.go", "x/d.md", "x/b_test.go")], "p string")
    got = lambda *a: sorted(r.p for r in df.where(listed("p", *a)).collect())
    assert got(["x/**"]) == ["x/b.go", "x/b_test.go", "x/d.md", "x/y/c.go"]
    assert got(["*.go"], ["*_test.go"]) == ["a.go", "x/b.go", "x/y/c.go"]
    assert got(["x/*.md"]) == ["x/d.md"]


def test_malformed_globs():
    assert segment_regex("[a") is None and segment_regex("a\\") is None and segment_regex("[a-]") is None
    assert segment_regex("[^a-c]?") == "[^/a-c][^/]"


def test_embedding(spark):
    row = spark.createDataFrame([("auth",), ("",), (None,)], "t string").select(embedding.simple_embedding("t").alias("v")).collect()
    assert [round(x, 4) for x in row[0].v[:4]] == [0.9265, 0.2684, 0.9035, 0.5902]
    assert row[0].v == embedding.SimpleEmbedder().embed(["auth"])[0][0]
    assert row[1].v == embedding.SimpleEmbedder().embed([""])[0][0]
    assert row[2].v is None


def test_retrying_stops_and_repeats():
    class Flaky:
        calls = 0

        def embed(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise ConnectionError
            return [[0.0]] * len(texts), 1

    assert embedding.Retrying(Flaky(), 3, 0.0).embed(["a"]) == ([[0.0]], 1)
    with pytest.raises(ConnectionError):
        embedding.Retrying(Flaky(), 2, 0.0).embed(["a"])


def test_cosine_cases(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 1.0], [1.0], 1.0), ([0.0], [1.0], 0.0), ([], [1.0], 0.0), ([1.0, 2.0], [-1.0, -2.0], -1.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(abs(r.s - r.want) < 1e-9 for r in df.withColumn("s", vectors.cosine("a", "b")).collect())


def test_query_windows_cover_the_text():
    assert vectors.query_windows("0123456789", 6, 2) == ["012345", "456789"]
    text = "aé漢😀" * 40
    got = vectors.query_windows(text, 16, 5)
    assert all(0 < len(w.encode()) <= 16 for w in got) and got[-1].endswith("😀")
    assert vectors.query_windows("") == [] and vectors.query_windows("é", 1, 0) == ["é"]


def test_byte_pages(spark):
    df = spark.createDataFrame(list(enumerate([3, 5, 4, 2, 9, 1])), "k int, b int")
    pages = vectors.byte_pages(df, "b", [F.asc("k")], 8)
    assert [r.page for r in pages.orderBy("k").collect()] == [1, 1, 2, 2, 3, 4]
    assert [r.k for r in vectors.select_page(pages, 99).collect()] == [5]
    assert vectors.byte_pages(df.limit(0), "b", [F.asc("k")], 8).count() == 0


def test_sizes_and_checksum(spark):
    df = spark.createDataFrame([(1, "a" * 9000), (2, "abc"), (3, ""), (4, None)], "i int, text string")
    got = splitters.size_chunks(df).orderBy("i", "start").collect()
    assert [(r.i, r.end - r.start) for r in got] == [(1, 4096), (1, 4096), (1, 808), (2, 3)]
    assert got[-1].checksum == 3128432319


def test_heading_boundaries():
    text = b"# First heading\nContent.\n\n# Second heading\nMore content."
    assert splitters.heading_boundaries(text) == [26]
    assert splitters.heading_boundaries(b"a\nb\n===\nc\n\n---\n####### no\n#no\n  ## yes") == [2, 30]
    assert splitters.heading_boundaries(b"T\n===\n") == []


def test_code_and_size_spans():
    body = b"package x\n" + b"".join(b"func F%d(a int) {\n" % k + b"  x\n" * 20 + b"}\n" for k in range(5))
    spans = splitters.by_boundaries(body, splitters.code_boundaries(body, "go"), 120)
    assert spans[0] == (0, 10) and all(a < z <= a + 120 for a, z in spans)
    assert b"".join(body[a:z] for a, z in spans) == body
    assert splitters.by_size(b"x" * 10, 0, 10, 4) == [(0, 4), (4, 8), (8, 10)]


def _workbook() -> bytes:
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = "".join(
        f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{c.lower()}{r}</t></is></c>' for c in "AB") + "</row>" for r in range(1, 9)
    )
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def _document() -> bytes:
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<d xmlns="{w}"><p><r><t>Hello</t><tab/><t>x</t></r></p><p><r><t>y</t></r></p></d>')
    return out.getvalue()


def test_files_by_kind(spark):
    files = [("a.xlsx", _workbook()), ("b.docx", _document()), ("c.pdf", b"%PDF\x00\nHi"), ("d.xls", b"\xd0\xcf" * 3), ("e.xlsx", b"no zip"), ("f.md", b""), (None, b"z"), ("g.go", None)]
    got = splitters.split_files(spark.createDataFrame(files, "path string, content binary"), 80).collect()
    by = {}
    for r in got:
        by.setdefault(r.path, []).append(r)
    assert len(by["a.xlsx"]) >= 2 and all(b"Header: a1\tb1" in r.content and len(r.content) <= 80 for r in by["a.xlsx"])
    assert bytes(by["b.docx"][0].content) == b"Hello\tx\ny\n"
    assert bytes(by["c.pdf"][0].content) == b"%PDF\nHi"
    assert "f.md" not in by and "g.go" not in by and None in by and "d.xls" in by and "e.xlsx" in by


def test_patterns():
    assert lexical.split_patterns("a OR b|c or ") == ["a", "b", "c or"]
    assert lexical.compile_patterns(["(a", "b"]) == r"(?:\(a)|(?:b)"
    assert lexical.compile_patterns([]) is None


def test_grep(spark):
    files = [("a.txt", "one\ntwo\nthree\nfour"), ("b.txt", "two\x00"), ("c.txt", "zero"), ("d.md", "TWO\ntwo not"), ("e.txt", None)]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r.path: r for r in lexical.grep(df, "two or thr", "not", snippet_lines=2).collect()}
    assert set(got) == {"a.txt"} and got["a.txt"].matches == 2
    assert [(s.start_line, s.end_line, s.text) for s in got["a.txt"].snippets] == [(1, 2, "one\ntwo"), (2, 3, "two\nthree")]
    assert {r.path for r in lexical.grep(df, "two", ignore_case=True, include=["*.md"]).collect()} == {"d.md"}
    assert lexical.grep(df, "two", mode="head", snippet_lines=1).collect()[0].snippets[0].text == "one"
    capped = lexical.grep(df, "t", max_blocks=1).collect()
    assert sum(len(r.snippets) for r in capped) == 1


def test_clips(spark):
    df = spark.createDataFrame([("ab\ncd\nef\n",), ("",)], "text string")
    one = lambda c: [bytes(r[0]["data"]) for r in df.select(c).collect()]
    assert one(lexical.clip_lines("text", 2, 1)) == [b"cd", b""]
    assert one(lexical.clip_lines("text", 3, 5)) == [b"ef\n", b""]
    assert one(lexical.clip_lines("text", 9, 1)) == [b"", b""]
    assert one(lexical.clip_bytes("text", 3, 2)) == [b"cd", b""]
    assert one(lexical.clip_bytes("text", 99)) == [b"", b""]
    r = lexical.read(df.withColumn("path", F.lit("p")), max_bytes=4).collect()[0]
    assert (r.returned, r.remaining, r.next_offset) == (4, 5, 4)
    sig = spark.createDataFrame([("  def f(x):\n  y = 1\nclass A:\n",)], "text string").select(lexical.signatures("text")).first()[0]
    assert sig == "  def f(x):\nclass A:"


def test_scalars(spark):
    rows = [("d#1", '{"path":"p/x","rel_path":"x","md5":"m"}'), ("#1", "{}"), ("z", "not json"), ("k", '{"asset_id":"a","rel_path":"r"}')]
    got = spark.createDataFrame(rows, "id string, meta string").select(scalars.asset_of("meta", "id").alias("a")).collect()
    assert [tuple(r.a) for r in got] == [("d", "p/x", "m"), ("#1", "#1", ""), ("z", "z", ""), ("a", "r", "")]
    f = spark.createDataFrame([("", "d", 5, 3), ("f", "d", 0, 1), ("", "", None, None)], "f string, d string, s int, e int")
    assert [r[0] for r in f.select(scalars.fragment_name("f", "d", "s", "e")).collect()] == ["d:5-5", "f", "doc:0-0"]
    b = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\x00"),), (bytearray(b"\xff\xfe"),), (None,)], "b binary")
    assert [r[0] for r in b.select(scalars.is_binary("b")).collect()] == [False, True, True, False]


def test_patterns_are_those_of_the_engine_that_runs_them(spark):
    rows = [("a", "abc\n"), ("b", "a++b\nx\n"), ("c", "ÄÖ 12\n\nend"), ("d", "a\n"), ("e", "see (?=x) here")]
    files = spark.createDataFrame(rows, "path string, text string")
    found = lambda p, **o: [(r.path, r.matches) for r in lexical.grep(files, p, **o).collect()]
    assert found(r"\p{L}{3}") == [("a", 1), ("c", 1), ("e", 1)]
    assert found(r"(?P<first_one>a)b") == [("a", 1)]
    assert found("^$") == [("a", 1), ("b", 1), ("c", 1), ("d", 1)]
    assert found(r"\bx\b") == [("b", 1), ("e", 1)]
    assert found("a++b") == [("b", 1)] and found("(?=x)") == [("e", 1)] and found("[") == []
    blocks = lambda **o: [len(r.snippets) for r in lexical.grep(files, "^$", **o).collect()]
    assert blocks(max_files=None, max_blocks=3) == [1, 1, 1] and blocks(max_files=2, max_blocks=9) == [1, 1] and blocks(max_files=None, max_blocks=None) == [1] * 4


def test_one_file_tells_whether_it_was_cut(spark):
    files = spark.createDataFrame([("a", "x\n" * 5), ("b", "x\n")], "path string, text string")
    assert [(r.path, r.matches, len(r.snippets), r.truncated) for r in lexical.grep_file(files, "a", "x", max_blocks=3).collect()] == [("a", 5, 3, True)]
    assert [(r.matches, r.truncated) for r in lexical.grep_file(files, "a", "x").collect()] == [(5, False)]
    assert lexical.grep_file(files, "a", "x", max_size=4).first().truncated and lexical.grep_file(files, "b", "q").count() == 0


def test_numbers_run_through_all_partitions(spark):
    from veldspar.runtime import Scratch, numbered

    df = spark.range(1000).selectExpr("id % 100 k", "hash(id) v")
    rows = numbered(df, ["k", "v"], Scratch(spark)).collect()
    assert [(r.k, r.v) for r in sorted(rows, key=lambda r: r.number)] == sorted((r.k, r.v) for r in df.collect())
    assert sorted(r.number for r in rows) == list(range(1000)) and numbered(df.limit(0), ["k"], Scratch(spark)).count() == 0

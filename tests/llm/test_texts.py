"""Tokens, toxicity, mixing, lines, exact copies, fingerprints and captures against brute force, with odd inputs."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, spark_rows, sql_rows
from veldspar.llm import bpe, exact, fingerprint, lines, mixing, queries, toxicity, warc

ODD = [
    (1, "", "en", "s"), (2, None, None, None), (3, "x" * 300_000, "en", "s"), (4, "a b c", "en", "s"), (4, "a b c", "en", "s"),
    (5, "a b c", "de", "t"), (None, "a b c", "en", "s"), (None, "a b c", "en", "s"), (6, "\n\n \n", "zz", "s"), (7, "naïve 漢字 😀\r\n\t x  y\n", "fr", "s"),
]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in (
        "n_tokens", "tokens", "topic", "p", "n_dropped", "score", "toxic", "h", "keep_id", "least", "sig", "places", "_source", "_lang", "_topic",
        "_host", "_boilerplate", "_kept", "host", "of", "known", "row", "page", "_content", "_own", "content", "u", "sampled", "margin_error", "key",
    ):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.oracle_sql()[name])


def test_tokens_are_those_of_the_merges():
    tiktoken = pytest.importorskip("tiktoken")
    encoder, _ = bpe.load_encoder(bpe.DEFAULT_VOCABULARY)
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["", " ", "hello world's 123", "naïve 漢字 😀\r\n\t  x", "aaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>"]
    texts += ["".join(rng.choice("abcdefgh IJ.'0é漢\n") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    for t in texts:
        assert list(encoder.encode(t)) == other.encode_ordinary(t), t
        assert encoder.decode(encoder.encode(t)) == t


def test_bounded_memories_give_the_same_tokens(monkeypatch):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(3000)) + " " + "ab" * 2000
    encoder, _ = bpe.load_encoder(bpe.DEFAULT_VOCABULARY)
    want = list(encoder.encode(text))
    for every in (1, 4):
        for name, most in (("MAX_STATES", 50), ("MAX_PAIRS", 40), ("MAX_WORDS", 30), ("MAKE_EVERY", every)):
            monkeypatch.setattr(bpe, name, most)
        encoder.forget()
        assert list(encoder.encode(text)) == want and len(encoder.states) <= 52 and len(encoder.pairs) <= 40
        assert len(encoder.words) + len(encoder.older) <= 60
    encoder.forget()


def test_memories_are_freed_when_a_task_ends():
    import gc

    import pyarrow as pa

    class Ranks:
        value = None

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", "and others there"])], names=["doc_id", "text"])
    out = list(bpe._encode_batches([batch], bpe.DEFAULT_VOCABULARY, Ranks, ["doc_id"], "text", True))
    encoder, _ = bpe.load_encoder(bpe.DEFAULT_VOCABULARY)
    assert out[0].num_rows == 2 and gc.isenabled() and not encoder.words and len(encoder.states) == 1 and not encoder.pairs


def test_sparing_takes_linear_time():
    import time

    matcher = toxicity.Matcher([(None, w, v) for w, v in toxicity.SEED.items()])
    text = "the idiot trash can " * 50_000  # a million characters, half of its hits spared
    began = time.perf_counter()
    assert matcher.score(text, "en") == (200_000, 50_000, 50_000.0)
    assert time.perf_counter() - began < 20


def test_decoding_any_bytes_equals_pythons():
    rng = random.Random(7)
    single = {b: bytes([b]) for b in range(256)}
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(rng.randint(0, 9)))
        stream = bpe.Utf8Stream(single)
        assert "".join(stream.feed([b]) for b in data) + stream.end() == data.decode(errors="replace"), data


def test_encode_odd(spark):
    got = bpe.encode_column(odd(spark), keep=["doc_id"])
    assert got.columns == ["doc_id", "n_tokens", "tokens", "exact"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].tokens is None and by[1][0].tokens == [] and len(by[4]) == 2 and len(by[None]) == 2
    assert all(r.exact for rows in by.values() for r in rows if r.tokens is not None)
    assert {r.decoded for r in bpe.decode_column(got).where("doc_id = 7").collect()} == {ODD[-1][1]}
    assert bpe.encode_column(odd(spark).limit(0)).count() == 0


def test_toxicity_cases(spark):
    cases = [
        ("you are an 1d10t", True), ("уоu are scum", True), ("the trash can is full", False), ("a class clown", False), ("IDIOT", True), ("idiotic", True),
        ("scummy idioms", False), ("", False), (None, False), ("clean words only here", False), ("idiot " + "word " * 2000, False), ("​mo​ron", True),
    ]
    df = spark.createDataFrame([(k, t, "en") for k, (t, _) in enumerate(cases)], "doc_id long, text string, lang string")
    assert [r.toxic for r in toxicity.score_documents(df).orderBy("doc_id").collect()] == [want for _, want in cases]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(odd(spark), labels).count() == len(ODD)
    assert toxicity.score_documents(odd(spark).limit(0), labels).count() == 0


def test_matcher_equals_brute_force():
    rng = random.Random(3)
    terms = [(None, "ab", 0.5), (None, "abc*", 0.7), ("en", "b", 0.2), (None, "c", 1.0)]
    matcher = toxicity.Matcher(terms, ("ab c",))
    for _ in range(500):
        text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 8)))
        want, words = 0.0, text.split()
        for k, w in enumerate(words):
            weights = [v for lang, t, v in terms if (w.startswith(t[:-1]) if t.endswith("*") else w == t)]
            spared = (w == "ab" and words[k + 1 : k + 2] == ["c"]) or (w == "c" and k and words[k - 1] == "ab")
            want += 0 if spared else max(weights, default=0.0)
        assert abs(matcher.score(text, "en")[2] - want) < 1e-9, text


def test_learned_terms_find_held_out_rows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = toxicity.score_documents(d, train).join(held.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    wrong = sum(r.toxic != (r.truth == 1) for r in got)
    assert got and wrong <= 0.1 * len(got)


def test_raking_meets_the_margins():
    rng = np.random.default_rng(1)
    cells = [(s, g, t) for s in "abc" for g in ("en", "de", "xx") for t in ("prose", "code")]
    tokens = rng.integers(1, 1000, len(cells))
    p = mixing.rake(*zip(*cells), tokens, rounds=200)
    w = p * tokens / (p * tokens).sum()
    share = {g: sum(x for x, c in zip(w, cells) if c[1] == g) for g in ("en", "de", "xx")}
    assert abs(share["en"] / share["de"] - mixing.LANGUAGES["en"] / mixing.LANGUAGES["de"]) < 1e-3
    assert 0 <= p.min() and abs(p.max() - 1) < 1e-12
    assert list(mixing.rake([], [], [], [])) == [] and list(mixing.rake(["a"], ["b"], ["c"], [0])) == [1.0]


def test_raking_goes_on_until_the_margins_are_met():
    cells = [(f"s{k}", g, "prose") for k in range(20) for g in ("en", "de", "fr", "es")]
    tokens = np.array([(40 if s == "s0" else 1) * (1e6 if g == ("en", "de", "fr", "es")[int(s[1:]) % 4] else 1e3) for s, g, _ in cells])
    p, error = mixing.fit(*zip(*cells), tokens)
    w = p * tokens / (p * tokens).sum()
    named = sum(mixing.LANGUAGES[g] for g in ("en", "de", "fr", "es"))
    for g in ("en", "de", "fr", "es"):
        assert abs(sum(x for x, c in zip(w, cells) if c[1] == g) * named / mixing.LANGUAGES[g] - 1) < 1e-6
    own = np.array([sum(tokens[4 * k : 4 * k + 4]) for k in range(20)]) ** mixing.TEMPER
    assert np.abs(w.reshape(20, 4).sum(axis=1) / (own / own.sum()) - 1).max() < 1e-6 and error < mixing.TOLERANCE
    assert (mixing.rake(*zip(*cells), tokens) == p).all() and mixing.fit(*zip(*cells), tokens, rounds=12)[1] > 1e-3
    # two sources of one language each, whose shares the languages' contradict
    assert mixing.fit(["a", "b"], ["en", "de"], ["prose"] * 2, [1, 1])[1] > 0.1


def test_mixing_odd(spark):
    got = mixing.with_probability(odd(spark))
    assert got.count() == len(ODD) and got.columns.count("p") == 1
    assert got.where("p is null or sampled is null or (coalesce(text, '') = '' and (topic <> 'prose' or tokens <> 0))").count() == 0
    assert mixing.with_probability(odd(spark).limit(0)).count() == 0


def test_lines_odd(spark):
    rows = [(k, f"same line\nown {k}\n\nsame line", "h") for k in range(10)] + [(99, "same line", "other"), (98, None, "h"), (97, "", None)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), ratio=0.5).collect()}
    assert got[3] == ("own 3\n", 2) and got[99] == ("same line", 0) and got[98] == (None, 0) and got[97] == ("", 0)
    full = lines.drop_boilerplate(odd(spark))
    assert full.count() == len(ODD) and full.columns.count("n_dropped") == 1
    assert lines.drop_boilerplate(odd(spark).limit(0)).count() == 0


def test_exact_odd(spark):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.is_kept) for r in exact.exact_duplicates(odd(spark)).collect()), key=str)
    want = [(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 3, True), (5, 4, 3, False), (6, 6, 1, True), (7, 7, 1, True), (None, 4, 3, False)]
    assert got == sorted(want, key=str)
    assert exact.exact_duplicates(odd(spark).limit(0)).count() == 0


def test_exact_tells_collisions_apart(spark, monkeypatch):
    real = F.md5
    monkeypatch.setattr(exact.F, "md5", lambda c: real(F.substring(c, 1, 1)))
    df = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab"), (4, "z")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(df).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_sketches_recover_differences(spark):
    rng = random.Random(2)
    common = [f"line {k}" for k in range(50)]
    rows = [(1, "\n".join(common))]
    for doc, extra in ((2, 3), (3, 400)):
        rows.append((doc, "\n".join(common + [f"x{doc} {rng.random()}" for _ in range(extra)])))
    rows += [(4, None), (5, ""), (None, "q"), (5, " ")]
    got = {r.doc_id: r for r in fingerprint.version_differences(spark.createDataFrame(rows, "doc_id long, text string"), cells=6).collect()}

    def digests(text):
        return {int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in (text or "").split("\n") if x.strip(" ")}

    texts = dict(rows[:3])
    chains = [(r.doc_id, r.prev_id) for r in got.values() if r.prev_id]
    for a, b in chains:
        assert set(got[a].added) == digests(texts[a]) - digests(texts[b]) and set(got[a].removed) == digests(texts[b]) - digests(texts[a])
    assert chains and got[4].n_paragraphs == 0 and got[5].added is None and len(got) == 5
    assert fingerprint.version_differences(odd(spark).limit(0)).count() == 0


def test_captures(spark):
    rows = [(k, f"https://www.Site{k % 3}.example.com:443/p{k % 5}?q={k % 2}#f", f"<p>{k}</p>") for k in range(60)]
    rows += [(100, None, None), (101, "no url", ""), (102, "http://h", "x" * 200_000), (None, "http://n/", "y"), (0, rows[0][1], "<p>0</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = sorted((r.page_id, r.digest) for r in warc.captures(df, block=4).collect())
    assert got == sorted((k, hashlib.md5((h or "").encode()).hexdigest()) for k, _, h in rows if k is not None)
    index = warc.CaptureIndex(df, block=4)
    hits = index.lookup(spark.createDataFrame([("com,example,site1)/p1?q=1",), ("nowhere",), ("zzz",)], "key string")).collect()
    assert sorted(r.id for r in hits) == sorted(k for k, u, _ in rows[:60] if "Site1" in u and "/p1?" in u and "q=1" in u)
    assert warc.captures(df.limit(0)).count() == 0


def test_repeated_rows_in_two_partitions_are_two_captures(spark):
    one = spark.createDataFrame([(1, "http://x.org/a", "page")], "page_id long, url string, html string")
    got = warc.captures(one.unionByName(one)).collect()
    assert [(r.page_id, r.n_captures, r.n_bytes) for r in got] == [(1, 2, 4)] * 2


def test_a_lookup_reads_a_page_a_block_and_a_range(spark):
    df = spark.range(400).selectExpr("id page_id", "concat('http://h', id % 7, '.example.com/', id) url", "repeat(concat('text ', id), 50) html")
    index = warc.CaptureIndex(df.repartition(3), block=10)
    assert len(index.root) >= 2
    found = warc.Lookup(index.files, index.root)
    (line,) = found.find("com,example,h3)/3")
    assert line[:2] == ["com,example,h3)/3", "3"]
    assert found.reader.n_reads <= 4  # at most two pages and two blocks may hold a key
    reader = index.files.reader()
    ((head, body),) = warc.parse(reader.read(line[2], int(line[3]), int(line[4])))
    assert body == b"text 3" * 50 and head["warc-target-uri"] == "http://h3.example.com/3" and reader.n_bytes == int(line[4]) < 400
    whole = sum(r.size for r in index.lines.collect())
    assert found.reader.n_bytes < whole / 20
    assert list(found.find("com,example,h3)/4")) == [] and list(found.find("")) == [] and list(found.find("zz")) == []


def test_files_of_records_are_read(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    made = [warc.record(k, f"http://x/{k}", b"p" * k) for k in (0, 3, 3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    (tmp_path / "b.warc").write_bytes(made[1] + made[2][:-9])
    (tmp_path / "c.warc").write_bytes(b"")
    got = sorted((r.path.rpartition("/")[2], r.type, r.url, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == [
        ("a.warc.gz", "resource", "http://x/0", b""), ("a.warc.gz", "resource", "http://x/3", b"ppp"), ("a.warc.gz", "resource", "http://x/3", b"ppp"),
        ("b.warc", "resource", "http://x/3", b"ppp"),
    ]


def test_records_round_trip():
    made = [warc.record(k, f"http://x/{k}\r\n", bytes([k]) * k + b"\r\nWARC/1.0\r\n") for k in range(5)]
    got = list(warc.parse(b"".join(gzip.compress(m) for m in made)))
    assert [p for _, p in got] == [bytes([k]) * k + b"\r\nWARC/1.0\r\n" for k in range(5)]
    assert [h["warc-target-uri"] for h, _ in got] == [f"http://x/{k}%0D%0A" for k in range(5)]
    assert list(warc.parse(made[4][:-10])) == []

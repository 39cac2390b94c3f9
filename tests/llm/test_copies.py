"""Near copies and repeated passages against brute force, with odd inputs; the pipeline's stages."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_texts import ODD, odd
from veldspar.llm import fingerprint, graph, minhash, repeats, substring, suffix
from veldspar.runtime import Scratch


def _words(rng, n):
    return [f"w{rng.randint(0, 10**9)}" for _ in range(n)]


def _corpus():
    """Own texts, near copies by edits, exact copies, and passages of 60 to 300 words that several texts share."""
    rng = random.Random(11)
    texts, groups = [], []
    for g in range(25):
        base = _words(rng, rng.randint(80, 400))
        mine = []
        for k in range(rng.choice([1, 1, 2, 4])):
            t = list(base)
            for _ in range(len(t) // 60 if k else 0):
                t[rng.randrange(len(t))] = f"e{rng.random()}"
            mine.append(len(texts))
            texts.append(t)
        groups.append(mine)
    shared = [_words(rng, n) for n in (49, 50, 60, 120, 300)]
    for s in shared:
        for _ in range(3):
            texts.append(_words(rng, rng.randint(0, 60)) + s + _words(rng, rng.randint(0, 60)))
    twice = _words(rng, 70)
    texts.append(twice + _words(rng, 9) + twice)
    return [" ".join(t) for t in texts], groups


TEXTS, GROUPS = _corpus()


def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def _runs(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))}


def _covered(least):
    """Words of each text that a run of ``least`` words covers which occurs again anywhere."""
    where = {}
    words = [t.split() for t in TEXTS]
    for d, w in enumerate(words):
        for k in range(len(w) - least + 1):
            where.setdefault(tuple(w[k : k + least]), []).append((d, k))
    out = {d: set() for d in range(len(words))}
    for at in where.values():
        if len(at) > 1:
            for d, k in at:
                out[d].update(range(k, k + least))
    return {d: s for d, s in out.items() if s}


def test_near_groups_equal_brute_force(spark):
    got = {r.doc_id: r for r in minhash.near_duplicates(corpus(spark)).collect()}
    sets = [_runs(t) for t in TEXTS]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7]
    found = sum(got[a].group_id == got[b].group_id for a, b in pairs)
    assert found >= 0.9 * len(pairs) and len(pairs) > 10
    far = [(a, b) for a in range(len(sets)) for b in range(a) if not sets[a] & sets[b] and got[a].group_id == got[b].group_id]
    assert not far
    assert sum(r.is_kept for r in got.values()) == len({r.group_id for r in got.values()}) and len(got) == len(TEXTS)


def test_estimate_is_close():
    import pyarrow as pa

    rng = random.Random(4)
    words = _words(rng, 3000)
    texts = [" ".join(words)] + [" ".join(words[k:] + _words(rng, k)) for k in (100, 600, 1500)]
    _, least = minhash.minima(pa.array(texts))
    packed = minhash.pack(least)
    got = minhash.similarity(packed[0], packed)
    real = [len(_runs(texts[0]) & _runs(t)) / len(_runs(texts[0]) | _runs(t)) for t in texts]
    assert np.abs(got - real).max() < 0.15 and got[0] == 1


def test_near_odd(spark):
    got = {r.doc_id: r for r in minhash.near_duplicates(odd(spark)).collect()}
    assert set(got) == {r[0] for r in ODD if r[0] is not None}
    assert got[5].group_id == 4 and not got[5].is_kept and got[4].is_kept and got[1].is_kept and got[2].is_kept and got[6].similarity is None
    assert minhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.a: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


@pytest.mark.parametrize("find", [substring.repeated_passages, suffix.suffix_repeats])
def test_passages_equal_brute_force(spark, find):
    got = {}
    rows = find(corpus(spark)).collect()
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert got == _covered(50)
    assert len({(r.doc_id, r.start_word) for r in rows}) == len(rows)


def _windows(texts, length):
    """Places (id, start) of each window of a length, in order."""
    where = {}
    for d in sorted(texts):
        words = texts[d].split()
        for k in range(len(words) - length + 1):
            where.setdefault(tuple(words[k : k + length]), []).append((d, k))
    return where


def test_levels_and_removable_equal_brute_force(spark):
    rng = random.Random(51)
    texts = dict(enumerate(TEXTS))
    # repeats of just a level's length, just below it and between levels, in passages that are themselves copied
    for size in (99, 100, 101, 149, 150, 199, 200, 201, 399, 400, 700):
        shared = _words(rng, size)
        for _ in range(2):
            texts[len(texts)] = " ".join(_words(rng, rng.randint(0, 40)) + shared + _words(rng, rng.randint(0, 40)))
    texts[len(texts)] = texts[len(texts) - 1]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = substring.repeated_passages(docs).collect()
    later, level = {}, {}
    for length in (50, 100, 200, 400, 800):
        for at in _windows(texts, length).values():
            if len(at) > 1:
                for d, k in at:
                    level.setdefault(d, []).append((k, length))
                if length == 50:
                    for d, k in at[1:]:
                        later.setdefault(d, set()).update(range(k, k + length))
    for r in rows:
        inside = range(r.start_word, r.start_word + r.n_words)
        assert r.removable_words == len(later.get(r.doc_id, set()) & set(inside)), r
        assert r.level_words == max(n for k, n in level[r.doc_id] if k in inside and k + n - 1 in inside), r
    assert {r.level_words for r in rows} >= {50, 100, 200, 400}


@pytest.mark.parametrize("find", [substring.repeated_passages, suffix.suffix_repeats])
def test_rows_that_share_an_id_are_texts_of_their_own(spark, find):
    rng = random.Random(52)
    a, b = _words(rng, 80), _words(rng, 90)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(_words(rng, 7) + a)), (3, None)]
    got = sorted((r.doc_id, r.start_word, r.n_words) for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 80), (2, 7, 80)]
    again = sorted((r.doc_id, r.n_words) for r in find(spark.createDataFrame([(5, " ".join(b)), (5, " ".join(b))], "doc_id long, text string")).collect())
    assert again == [(5, 90), (5, 90)]


@pytest.mark.parametrize("find", [substring.repeated_passages, suffix.suffix_repeats])
def test_a_long_text_that_repeats_and_one_passage_everywhere(spark, find):
    rng = random.Random(53)
    long, passage = _words(rng, 60_000), _words(rng, 64)
    texts = [" ".join(long + ["end"] + long)] + [" ".join(_words(rng, 5) + passage + _words(rng, 5)) for _ in range(400)]
    got = {}
    for r in find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.n_words))
    assert sorted(got[0]) == [(0, 60_000), (60_001, 60_000)] and all(got[d] == [(5, 64)] for d in range(1, 401))


@pytest.mark.parametrize("find", [substring.repeated_passages, suffix.suffix_repeats])
def test_passages_odd(spark, find):
    assert find(odd(spark)).count() == 0
    assert find(odd(spark).limit(0)).count() == 0


def test_bounded_prefixes_equal_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        text = rng.integers(0, 4, rng.integers(0, 60)).astype(np.int64)
        text = np.append(text, 0)
        order, lcp = suffix.bounded_common_prefixes(text, 5)
        assert sorted(order) == list(range(len(text)))
        for k in range(len(order) - 1):
            a, b, n = order[k], order[k + 1], 0
            while n < 5 and max(a, b) + n < len(text) and text[a + n] == text[b + n] != 0:
                n += 1
            assert lcp[k] == n


def test_anchors_hold_every_passage():
    rng = np.random.default_rng(8)
    for _ in range(50):
        h = rng.integers(0, 50, 80).astype(np.uint64)
        marked = repeats.anchors(h, 9)
        assert all(marked[k : k + 9].any() for k in range(len(h) - 8))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "tokens", "exact"} <= set(out.columns) and 0 < out.count() <= docs.count()
    assert out.where("not exact").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns


def test_every_stage_takes_odd_rows(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd(spark), sf_dir)
        if name != "bpe":
            same = got.schema.simpleString() == odd(spark).schema.simpleString()
            assert same and {r.toxic for r in got.collect()} <= {"clash"} and {r["_content"] for r in got.collect()} <= {"clash"}
        if name == "near_dedup":
            # of the rows with the text of document 4, its own (and those without an id) stay
            assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4, 6, 7, None}
        elif name != "mixing":
            assert got.count() == len(ODD)


def test_a_large_copy_group_leaves_one_document_with_its_text(spark, sf_dir):
    rng = random.Random(21)
    page = lambda n: [" ".join(_words(rng, 9)) for _ in range(n)]
    rows, base = [], page(40)
    for host in ("s", "t", None):
        rows += [("\n".join(["terms of use apply here"] + page(4)), host) for _ in range(120)]
        for k in range(40):  # a quarter of each source; half of them edited
            copy = list(base)
            if k % 2:
                copy[rng.randrange(40)] = f"edited {rng.random()} in this copy alone"
            rows.append(("\n".join(copy), host))
    docs = spark.createDataFrame([(k, t, "en", h, len(t)) for k, (t, h) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = Scratch(spark).keep(corpus_pipeline.drop_boilerplate(spark, docs, sf_dir))
    assert cut.count() == len(rows) and cut.where("contains(text, 'terms of use') or text = ''").count() == 0
    own = {r.doc_id: r.text for r in cut.collect()}
    assert all(own[k] == t for k, (t, _) in enumerate(rows) if "terms of use" not in t)
    left = [r.text for r in corpus_pipeline.drop_near_copies(spark, cut, sf_dir).collect()]
    assert len(left) == 361 and sum(len(set(t.split("\n")) & set(base)) > 30 for t in left) == 1


def test_version_pairs_equal_brute_force(spark):
    rng = random.Random(31)
    texts = []
    for g in range(30):
        base = [" ".join(_words(rng, rng.randint(8, 20))) for _ in range(rng.choice([1, 2, 12, 60]))]
        for _ in range(rng.choice([1, 2, 5])):
            mine = list(base)
            for _ in range(max(1, len(mine) // 12)):  # edits that touch any paragraph, the least digest too
                k = rng.randrange(len(mine))
                words = mine[k].split()
                words[rng.randrange(len(words))] = f"e{rng.random()}"
                mine[k] = " ".join(words)
            texts.append("\n".join(mine))
    docs = spark.createDataFrame([*enumerate(texts), (900, texts[0]), (901, "..."), (902, "..."), (903, None), (None, texts[0])], "doc_id long, text string")
    sets, digests = [_runs(t) for t in texts], [{int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in t.split("\n")} for t in texts]
    same = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(b, a) for b in range(len(texts)) for a in range(b) if same(a, b) >= fingerprint.ALIKE}
    rows = fingerprint.version_pairs(docs, cells=6).collect()
    got = {(r.doc_id, r.prev_id): r for r in rows}
    assert len(got) == len(rows) and got.pop((900, 0)).added == []
    assert len(want) > 60 and set(got) <= want and len(got) >= 0.9 * len(want)
    for (b, a), r in got.items():
        assert r.added == sorted(digests[b] - digests[a]) and r.removed == sorted(digests[a] - digests[b]) and abs(r.similarity - same(a, b)) < 1e-9
    chained = {(r.doc_id, r.prev_id) for r in fingerprint.version_differences(docs).collect()}
    assert len(want & chained) < 0.9 * len(want)  # by the least digest alone
    assert fingerprint.version_pairs(docs.limit(0)).count() == 0
    assert {(r.doc_id, r.prev_id) for r in fingerprint.version_pairs(odd(spark)).collect()} == {(5, 4)}


def test_one_row_of_a_group_stays_where_rows_repeat_ids(spark, sf_dir):
    rng = random.Random(41)
    base = _words(rng, 200)
    near = " ".join(base[:-3] + _words(rng, 3))
    base, other, lone = " ".join(base), " ".join(_words(rng, 90)), " ".join(_words(rng, 90))
    rows = [(1, base), (1, base), (1, near), (2, near), (3, base), (1, other), (4, other), (5, lone), (5, lone), (6, "..."), (7, "..."), (6, "..."), (None, base), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars")
    got = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    kept = next(t for k, t in left if k == 1 and t in (base, near))
    assert left == sorted([(1, kept), (1, other), (5, lone), (6, "..."), (7, "..."), (None, base), (8, None)], key=str)

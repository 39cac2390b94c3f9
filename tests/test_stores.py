"""Snapshots, incremental indexing, change log in batch and stream, files, values and configuration."""

import json

import pytest
from pyspark.sql import functions as F

from veldspar.operators import upsert as up
from veldspar.operators.matching import PathRules
from veldspar.plans import admin, changelog, indexing
from veldspar.sources import config, files, values
from veldspar.sources.snapshots import SnapshotStore, schema
from veldspar.streaming.sync import start_sync


def _log(spark, rows):
    full = [
        ("r", "shadow_vec_docs", scn, op, doc, json.dumps({"content": text, "meta": json.dumps({"asset_id": a, "path": f"docs/{a}.txt", "md5": "m"}), "embedding_model": "s"}), None)
        for scn, op, doc, a, text in rows
    ]
    return spark.createDataFrame(full, schema("vec_shadow_log"))


ROWS = [(1, "insert", "a#0", "a", "alpha"), (2, "update", "a#0", "a", "beta"), (3, "Delete", "a#0", "a", "beta"), (4, "delete", "x", "x", ""), (5, "insert", "b", "b", "bee")]


def test_final_state(spark):
    got = {r.id: (r.content, r.scn, r.archived) for r in changelog.final_state(_log(spark, ROWS)).collect()}
    assert got == {"a#0": ("beta", 3, 1), "b": ("bee", 5, 0)}
    assets = {r.asset_id: (r.md5, r.archived) for r in changelog.asset_state(_log(spark, ROWS)).collect()}
    assert assets == {"a": ("m", 1), "b": ("m", 0)}
    blocked = changelog.final_state(_log(spark, ROWS), PathRules(exclude=["docs/"]))
    assert blocked.count() == 0


@pytest.mark.parametrize("cut", [0, 1, 2, 3, 5])
def test_applying_in_parts_equals_applying_at_once(spark, cut):
    log = _log(spark, ROWS)
    state = spark.createDataFrame([("r", "shadow_vec_docs", cut)], schema("vec_sync_state"))
    docs, after = changelog.apply_log(changelog.final_state(log.where(F.col("scn") <= cut)), log, state)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, changelog.final_state(log).collect()))
    assert after.first().last_scn == 5


def test_stream_equals_batch(spark, tmp_path):
    log, path = _log(spark, ROWS), str(tmp_path / "log")
    for scn in range(1, 6):
        log.where(F.col("scn") == scn).coalesce(1).write.mode("append").parquet(path)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    start_sync(spark, path, store, str(tmp_path / "checkpoint"), files_per_batch=10).awaitTermination()
    assert sorted(map(tuple, store.read("synced_docs").collect())) == sorted(map(tuple, changelog.final_state(log).collect()))
    assert store.read("vec_sync_state").first().last_scn == 5
    assert {r.asset_id: (r.scn, r.archived) for r in store.read("synced_assets").collect()} == {"a": (3, 1), "b": (5, 0)}


@pytest.mark.parametrize("order", [[(2, "update", 99), (3, "delete", 0)], [(2, "delete", 0), (3, "update", 99)]])
def test_a_deletion_passes_the_rules_in_any_part(spark, order):
    """A stored document, an update that is too large for the rules and a deletion, in either order, at once and in parts."""
    meta = lambda size: json.dumps({"asset_id": "a", "path": "docs/a.txt", "md5": "m", "size": size})
    rows = [("r", "shadow_vec_docs", scn, op, "a#0", json.dumps({"content": f"c{scn}", "meta": meta(size)}), None) for scn, op, size in [(1, "insert", 1), *order]]
    log, rules = spark.createDataFrame(rows, schema("vec_shadow_log")), PathRules(max_size=10)
    dead = next(scn for scn, op, _ in order if op == "delete")
    whole = [(r.content, r.scn, r.archived) for r in changelog.final_state(log, rules).collect()]
    assert whole == [("c1", dead, 1)]
    for cut in (0, 1, 2, 3):
        state = spark.createDataFrame([("r", "shadow_vec_docs", cut)], schema("vec_sync_state"))
        docs, _ = changelog.apply_log(changelog.final_state(log.where(F.col("scn") <= cut), rules), log, state, rules)
        assert [(r.content, r.scn, r.archived) for r in docs.collect()] == whole
        assets = changelog.apply_assets(changelog.asset_state(log.where(F.col("scn") <= cut), rules), log, state, rules)
        assert [(r.asset_id, r.scn, r.archived) for r in assets.collect()] == [("a", dead, 1)]


def test_any_split_of_any_log_equals_the_whole(spark):
    import random

    rng = random.Random(3)
    rows, states = [], []
    for d in range(40):  # a dataset each: a log of its own, and a cut
        for scn in range(1, 9):
            doc, size = f"x{rng.randint(0, 2)}#{rng.randint(0, 1)}", rng.choice([1, 99])
            meta = json.dumps({"md5": rng.choice(["m", "n", ""]), "path": f"p{rng.randint(0, 1)}", "size": size})
            payload = {"content": f"c{scn}", "meta": meta, "archived": rng.choice([0, 0, 1]), "embedding": bytes([0, 0, 128, 63, 0, 0, 0, scn]).hex()}
            rows.append((f"d{d}", "shadow_vec_docs", scn, rng.choice(["insert", "update", "delete"]), doc, json.dumps(payload), None))
        states.append((f"d{d}", "shadow_vec_docs", rng.randint(0, 8)))
    log, state, rules = spark.createDataFrame(rows, schema("vec_shadow_log")), spark.createDataFrame(states, schema("vec_sync_state")), PathRules(max_size=10)
    first = log.join(state, ["dataset_id", "shadow_table"]).where("scn <= last_scn").drop("last_scn").select(*log.columns)
    for whole, part in (
        (changelog.final_state(log, rules), changelog.apply_log(changelog.final_state(first, rules), log, state, rules)[0]),
        (changelog.asset_state(log, rules), changelog.apply_assets(changelog.asset_state(first, rules), log, state, rules)),
    ):
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect())) and whole.count() > 40
    # the fold against a plain walk over the entries
    want = {}
    for d, _, scn, op, doc, payload, _ in rows:
        p = json.loads(payload)
        if op == "delete":
            if (d, doc) in want:
                want[d, doc] = (want[d, doc][0], scn, 1)
        elif json.loads(p["meta"])["size"] <= 10:
            want[d, doc] = (p["content"], scn, p["archived"])
    assert {(r.dataset_id, r.id): (r.content, r.scn, r.archived) for r in changelog.final_state(log, rules).collect()} == want


def test_vectors_travel_through_the_log(spark):
    import struct

    vector = [1.0, -2.5, 0.0, 1e-40, 3.4e38, 0.1]
    vector = [struct.unpack("<f", struct.pack("<f", x))[0] for x in vector]
    rows = [("r", "a#0", "a", "text", "{}", vector, "m", 4, 0), ("r", "b", "b", "other", "{}", None, "m", 5, 1)]
    docs = spark.createDataFrame(rows, schema("emb_docs"))
    log = changelog.push_entries(docs, spark.createDataFrame([("r", 3)], "dataset_id string, last_scn long")).withColumn("created_at", F.lit(None).cast("timestamp"))
    empty = spark.createDataFrame([], schema("emb_docs"))
    got, state = changelog.apply_log(empty, log, spark.createDataFrame([], schema("vec_sync_state")))
    assert [(r.id, r.content, r.embedding, r.scn, r.archived) for r in got.collect()] == [("a#0", "text", vector, 4, 0)]
    assert state.first().last_scn == 5 and got.schema == empty.schema


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.read("vec_sync_state").count() == 0 and store.current("vec_sync_state") is None
    for k in range(4):
        store.write("vec_sync_state", spark.createDataFrame([("d", "s", k)], schema("vec_sync_state")))
    assert store.read("vec_sync_state").first().last_scn == 3 and store.verify("vec_sync_state") == []
    assert store.vacuum("vec_sync_state") == 2 and store.read("vec_sync_state").count() == 1


def test_index_run(spark):
    kind = "dataset_id string, asset_id string, path string, md5 string, size long, mod_time timestamp, scn long, archived int"
    stored = spark.createDataFrame([("d", x, x, "1", 1, None, 1, gone) for x, gone in (("same", 0), ("chg", 0), ("gone", 0), ("back", 1), ("old", 1))], kind)
    seen = spark.createDataFrame([("d", x, x, m, 1, None) for x, m in (("same", "1"), ("chg", "2"), ("back", "1"), ("new", "9"))], "dataset_id string, asset_id string, path string, md5 string, size long, mod_time timestamp")
    state = {r.asset_id: r.state for r in indexing.classify(seen, stored).collect()}
    assert state == {"same": "unchanged", "chg": "changed", "gone": "removed", "back": "revived", "old": "gone", "new": "new"}
    delta = indexing.index_assets(seen, stored, spark.createDataFrame([("d", 10)], "dataset_id string, last_scn long"))
    got = {r.asset_id: (r.scn, r.archived) for r in delta.assets.collect()}
    assert got == {"same": (1, 0), "back": (11, 0), "chg": (12, 0), "gone": (13, 1), "new": (14, 0), "old": (1, 1)}
    assert delta.counters.first().last_scn == 14
    docs = spark.createDataFrame([("d", f"{a}:0-1", a, 1, 0) for a in ("same", "chg", "gone")], "dataset_id string, id string, asset_id string, scn long, archived int")
    fresh = spark.createDataFrame([("d", "chg:0-2", "chg")], "dataset_id string, id string, asset_id string")
    after = {r.id: (r.scn, r.archived) for r in indexing.index_documents(delta, docs, fresh).collect()}
    assert after == {"same:0-1": (1, 0), "gone:0-1": (13, 1), "chg:0-2": (12, 0)}


def test_changes(spark):
    rows = spark.createDataFrame([("d", "a", 1, 1), ("d", "b", 9, 1), ("e", "c", 1, 1), ("d", "x", 2, 0)], "dataset_id string, id string, scn long, archived int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(up.prune(rows, "d")) == ["c", "x"] and ids(up.prune(rows, "d", 5)) == ["b", "c", "x"] and ids(up.prune(rows, "d", 0)) == ["a", "b", "c", "x"]
    assert ids(up.reset(rows, "d")) == ["c"]
    assert up.insert_absent(rows, rows.unionByName(rows), up.DOC_KEY).count() == 4
    assert not admin.is_empty(rows, "d") and admin.is_empty(rows, "nope")


def test_batches_never_split_a_number(spark):
    log = spark.createDataFrame([("d", s) for s in (1, 2, 2, 2, 3, 5)], "dataset_id string, scn long").withColumn("op", F.lit("update"))
    got = changelog.batches(log, 2).groupBy("batch").count().orderBy("batch").collect()
    assert [(r.batch, r["count"]) for r in got] == [(0, 4), (1, 2)]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.go").write_text("hello")
    (tmp_path / "sub/b.txt").write_text("auth flow")
    (tmp_path / "sub/c.log").write_text("x")
    root = str(tmp_path)
    got = {r.path: r.size for r in files.scan(spark, root, PathRules.for_root()).select("path", "size").collect()}
    assert got == {"a.go": 5, "sub/b.txt": 9}
    assert [r.path for r in files.listing(spark, root, recursive=False).collect()] == ["a.go"]
    assert bytes(files.read_file(spark, root, "sub/b.txt", max_bytes=4).first().data) == b"auth"
    with pytest.raises(ValueError):
        files.read_file(spark, root, "../x")
    assert files.driver_of("user@tcp(h)/d") == "mysql" and files.driver_of("x.db") == "sqlite"


def test_values(spark):
    df = spark.createDataFrame([("n", k, bytearray(b"x" * 10)) for k in range(4)], "namespace string, seq int, value binary")
    log = values.append(df, segment_bytes=30)
    assert [(r.segment, r.offset) for r in log.orderBy("seq").collect()] == [(0, 0), (0, 15), (1, 0), (1, 15)]
    dead = log.where("seq = 0")
    s = values.stats(log, dead).first()
    assert (s.appends, s.bytes, s.segments, s.live_bytes, s.dead_bytes) == (4, 60, 2, 45, 15)
    assert values.read(log, dead.select("namespace", "segment", "offset")).first().valid


def test_config():
    made = config.load('{"roots": {"b": "/x", "a": {"path": "/y", "include": ["**/*.go"], "max_size_bytes": 5}}}')
    assert [r.name for r in config.resolve(made)] == ["a", "b"]
    assert config.resolve(made, "a")[0].rules().include == ["git:**/*.go"]
    with pytest.raises(ValueError):
        config.resolve(made, "zz")

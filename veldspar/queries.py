"""Queries of the engine's own operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import embedding as emb
from veldspar.functions import scalars as sc
from veldspar.operators import lexical as lx
from veldspar.operators import splitters as sp
from veldspar.operators import upsert as up
from veldspar.operators import vectors as ve
from veldspar.operators.matching import PathRules, listed, match_path, sync_filter
from veldspar.plans import admin, changelog, indexing, views
from veldspar.runtime import table
from veldspar.sources import values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The vector that the search queries look for.
PROBE = [round(((k * 37) % 19 - 9) / 10.0, 1) for k in range(64)]
_PROBE_SQL = "[" + ", ".join(f"{x}::double" for x in PROBE) + "]"
_SCORED_SQL = f"""scored AS (SELECT dataset_id, id, path, round(list_cosine_similarity(embedding::double[], {_PROBE_SQL}), 6) AS score
  FROM ({views.VECTORS_SQL}) WHERE archived = 0)"""
RULES = PathRules(include=["**/*.txt", "en/"], exclude=["git:/de", "fr/", "!git:fr/*7.txt", "**/1*.txt"], max_size=20_000)
PATTERN = "the or [0-9]{3}"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- vector search ------------------------------------------------------------------------------------


def _probe():
    return ve.vector(PROBE)


@query(f"WITH {_SCORED_SQL} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 10")
def v1_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten live vectors of greatest cosine."""
    return ve.topk(views.vectors(spark, sf_dir), _probe()).select("id", "score")


@query(f"WITH {_SCORED_SQL} SELECT id, path, score FROM scored WHERE score >= 0.05 ORDER BY score DESC, id LIMIT 10 OFFSET 5")
def v2_topk_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later page of results above a least score, with their paths."""
    return ve.topk(views.vectors(spark, sf_dir), _probe(), offset=5, min_score=0.05).select("id", "path", "score")


@query(f"WITH {_SCORED_SQL} SELECT dataset_id, id, score FROM scored")
def v4_cosine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every live vector."""
    return ve.scored(views.vectors(spark, sf_dir), _probe()).select("dataset_id", "id", "score")


_HALVES = [[x if k < 32 else 0.0 for k, x in enumerate(PROBE)], [x if k >= 32 else 0.1 for k, x in enumerate(PROBE)]]


def _halves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in enumerate(_HALVES)], "window int, vector array<double>")


_WINDOWED_SQL = f"""
WITH q AS (SELECT unnest([{", ".join("{w: " + str(k) + ", v: " + str(v) + "::double[]}" for k, v in enumerate(_HALVES))}]) AS q),
s AS (SELECT q.w AS w, d.dataset_id, d.id, round(list_cosine_similarity(d.embedding::double[], q.v), 6) AS s FROM ({views.VECTORS_SQL}) d, q WHERE archived = 0),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY w ORDER BY s DESC, id) <= 32)
SELECT dataset_id, id, AGG AS score FROM r GROUP BY ALL ORDER BY score DESC, id LIMIT 10"""


@query(_WINDOWED_SQL.replace("AGG", "max(s)"))
def v5_windows_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long query's windows combined by their best score."""
    return ve.windowed_topk(views.vectors(spark, sf_dir), _halves(spark))


@query(_WINDOWED_SQL.replace("AGG", "round(avg(s), 6)"))
def a6_windows_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long query's windows combined by their mean score."""
    return ve.windowed_topk(views.vectors(spark, sf_dir), _halves(spark), combine="mean")


@query("""
WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS a FROM conversations),
w AS (SELECT conv_id, turn, a, unnest(range(0, greatest(ceil((strlen(a) - 16) / 48.0)::bigint, 1))) AS k FROM t WHERE a IS NOT NULL)
SELECT conv_id, turn, k AS pos, a[k * 48 + 1:k * 48 + 64] AS part FROM w""")
def v6_query_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 64 bytes of all conversation turns (their ASCII part)."""
    t = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "").alias("a"))
    out = t.select("conv_id", "turn", F.posexplode(ve.windows_column("a", 64, 16)).alias("pos", "part"))
    return out.withColumn("pos", F.col("pos").cast("long"))


_RANKED_SQL = f"WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, id) AS rank FROM scored)"


@query(f"{_RANKED_SQL} SELECT dataset_id, id, rank, score FROM r WHERE rank <= 3")
def v7_all_roots_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of every dataset."""
    return ve.topk_by_dataset(views.vectors(spark, sf_dir), _probe(), 3).select("dataset_id", "id", "rank", "score")


@query(f"{_RANKED_SQL} SELECT dataset_id, id, score FROM r WHERE rank <= 3 ORDER BY score DESC, id LIMIT 12")
def o3_merged_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All datasets' best merged, cut to twelve."""
    return ve.search_all(views.vectors(spark, sf_dir), _probe(), 3, limit=12).select("dataset_id", "id", "score")


@query(f"{_RANKED_SQL} SELECT dataset_id, min(score) AS min_score, max(score) AS max_score, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL")
def v8_score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score range of each dataset's best."""
    return ve.score_range(ve.topk_by_dataset(views.vectors(spark, sf_dir), _probe(), 5))


@query(f"""{_RANKED_SQL} SELECT dataset_id, id, path, score FROM r WHERE rank <= 20 AND path LIKE 'v/%' AND NOT regexp_matches(path, '^v/3/')
ORDER BY dataset_id, rank LIMIT 20""")
def v9_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in order of root, filtered by path after each root's top-k."""
    found = ve.match(views.vectors(spark, sf_dir), _probe(), 20, "v/", PathRules(exclude=["git:/v/3/"]), min_score=-1.0)
    return found.select("dataset_id", "id", "path", "score")


_EMBED_SQL = """
WITH t AS (SELECT item_id, hex(encode(text)) AS x, strlen(text) AS n FROM benchmark WHERE text IS NOT NULL),
h AS (SELECT item_id, list_reduce(list_prepend(0::bigint, [('0x' || x[2 * k - 1:2 * k])::bigint for k in range(1, n + 1)]),
  lambda a, b: xor((a * 16777619) % 4294967296, b)) AS h FROM t)
SELECT item_id, h AS text_hash, [x % 10000 / 10000.0::double for x in list_reduce(list_prepend([h::bigint], [[k] for k in range(64)]),
  lambda a, b: list_append(a, (a[len(a)] * 1664525 + 1013904223) % 4294967296))[2:65]] AS embedding FROM h"""


@query(_EMBED_SQL)
def v11_simple_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and deterministic embedding of all benchmark texts."""
    b = table(spark, sf_dir, "benchmark").where("text is not null")
    return b.select("item_id", emb.text_hash("text").alias("text_hash"), F.transform(emb.simple_embedding("text"), lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query()
def v10_embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts embedded in batches by the pluggable embedder; tokens are summed a batch."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("content"))
    return emb.embed_documents(b, emb.SimpleEmbedder).select("item_id", "embedding", "tokens")


@query(f"""{_RANKED_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n, 100 + id % 700 AS b FROM r WHERE rank <= 5),
f AS (SELECT list_reduce(list_prepend({{'page': 0::bigint, 'used': 0::bigint, 'out': []::bigint[]}}, list({{'page': 0::bigint, 'used': b::bigint, 'out': []::bigint[]}} ORDER BY n)),
  lambda a, x: {{'page': a.page + (a.used + x.used > 900 OR a.page = 0)::bigint,
    'used': CASE WHEN a.used + x.used > 900 OR a.page = 0 THEN x.used ELSE a.used + x.used END,
    'out': list_append(a.out, a.page + (a.used + x.used > 900 OR a.page = 0)::bigint)}}).out AS ps FROM p)
SELECT id, ps[n] AS page FROM p, f""")
def o8_byte_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all datasets packed into pages of 900 bytes."""
    found = ve.topk_by_dataset(views.vectors(spark, sf_dir), _probe(), 5).select("id", "score", (F.lit(100) + F.col("id") % 700).alias("b"))
    return ve.byte_pages(found, "b", [F.desc("score"), F.asc("id")], 900).select("id", "page")


# --- chunks, hashes, scalars --------------------------------------------------------------------------


@query(f"""SELECT id, start, "end", ('0x' || sha256(chunk)[1:8])::bigint AS checksum FROM ({views.CHUNKS_SQL})""")
def x2_size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in chunks of 4,096 bytes with ids and checksums."""
    return views.chunked_documents(spark, sf_dir).select("id", "start", "end", "checksum")


@query()
def x3_code_and_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Markdown files and all pages as script files, split at headings and functions."""
    d = table(spark, sf_dir, "documents").select(F.format_string("d/%d.md", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    p = table(spark, sf_dir, "pages").select(F.format_string("p/%d.js", "page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    return sp.split_files(d.unionByName(p)).select("path", "start", "end", "checksum", "kind")


@query("""
SELECT doc_id, md5(text) AS md5, CASE WHEN strlen(text) = 0 THEN 0 ELSE ('0x' || md5(text)[1:16])::hugeint END::varchar AS hash64,
  regexp_replace(source || ' / ' || lang, '[^A-Za-z0-9._-]', '_', 'g') AS name, 'file:///data/' || doc_id AS uri, lower(hex(encode(lang))) AS lang_hex
FROM documents WHERE text IS NOT NULL""")
def c1_hashes_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes, safe names, URIs and hexadecimal of all documents."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(
        "doc_id", F.md5("text").alias("md5"), sc.content_hash("text").cast("string").alias("hash64"),
        sc.server_name(F.concat("source", F.lit(" / "), "lang")).alias("name"), sc.file_uri(F.concat(F.lit("/data/"), F.col("doc_id").cast("string"))).alias("uri"),
        sc.hex_lower(F.col("lang").cast("binary")).alias("lang_hex"),
    )


@query(f"SELECT scn, asset_id, 'docs/' || asset_id || '.txt' AS path, md5, 'docs/' || asset_id || '.txt' AS match_path FROM ({views.LOG_SQL})")
def c6_asset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset that each log entry's metadata names."""
    log = views.change_log(spark, sf_dir).withColumn("meta", F.get_json_object("payload", "$.meta"))
    return log.select("scn", sc.asset_of("meta", "document_id").alias("a"), match_path("meta").alias("match_path")).select("scn", "a.*", "match_path")


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at_text, [x for x in [trim(y) for y in string_split(event_type || ', ,' || user_id, ',')] if x <> ''] AS items,
  coalesce(nullif(props, ''), 'none') AS place FROM events""")
def c13_times_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in microseconds and comma-separated items of all events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", sc.utc_micros("ts").alias("at_text"), sc.csv_items(F.concat("event_type", F.lit(", ,"), F.col("user_id").cast("string"))).alias("items"),
        sc.location("props", F.lit("none")).alias("place"),
    )


# --- path rules ---------------------------------------------------------------------------------------


@query(f"""
SELECT dataset_id, path, size > 20000 OR NOT (path LIKE '%.txt' OR path LIKE 'en/%' OR path LIKE '%/en/%')
  OR ((path LIKE 'de/%' OR path LIKE 'fr/%') AND NOT regexp_matches(path, '^fr/[^/]*7[.]txt$')) OR regexp_matches(path, '/1[^/]*[.]txt$') AS excluded
FROM ({views.ASSETS_SQL}) WHERE size IS NOT NULL""")
def f1_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered include, exclude and gitignore rules over all assets."""
    a = views.assets(spark, sf_dir).where("size is not null")
    return a.select("dataset_id", "path", RULES.excluded("path", "size").alias("excluded"))


@query(f"SELECT scn, op <> 'delete' AND NOT regexp_matches(path, '/a[0-9]*7[.]txt$') OR op = 'delete' AS passes FROM (SELECT *, 'docs/' || asset_id || '.txt' AS path FROM ({views.LOG_SQL}))")
def f8_sync_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which log entries pass a root's rules."""
    log = views.change_log(spark, sf_dir).withColumn("meta", F.get_json_object("payload", "$.meta"))
    return log.select("scn", sync_filter(PathRules(exclude=["git:**/a*7.txt"]), sc.asset_of("meta", "document_id")["path"], "meta", "op").alias("passes"))


@query(f"SELECT dataset_id, path FROM ({views.ASSETS_SQL}) WHERE regexp_matches(path, '^(en|de)/[^/]*[.]txt$') AND NOT regexp_matches(path, '/[^/]*[05][.]txt$')")
def f9_list_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing globs over all assets."""
    return views.assets(spark, sf_dir).where(listed("path", ["en/**", "de/*.txt"], ["*[05].txt"])).select("dataset_id", "path")


@query("""
WITH d AS (SELECT doc_id, text, hex(encode(replace(text, 'e', chr(1)))[1:1024]) AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, text LIKE '%' || chr(0) || '%' AS nul,
  len(list_filter(regexp_extract_all(h, '..'), lambda x: regexp_full_match(x, '0[1-8BCEF]|1.'))) > strlen(h) // 20 AS control FROM d""")
def f10_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents look binary: as they are, and by control bytes if each e were one."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", sc.is_binary("text").alias("nul"), sc.is_binary_content(F.replace("text", F.lit("e"), F.lit("\x01"))).alias("control"))


# --- lexical search -----------------------------------------------------------------------------------

_LINES_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, ls, [i for i in range(1, len(ls) + 1) if regexp_matches(ls[i], 'the|[0-9]{3}') AND NOT regexp_matches(ls[i], 'zz')] AS hits FROM l)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.format_string("%09d.txt", "doc_id").alias("path"), "text").where("text is not null")


@query(_LINES_SQL + " SELECT doc_id, [x - 1 for x in hits] AS hits FROM m WHERE len(hits) > 0")
def g1_matching_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching lines of all documents."""
    out = lx.matching_lines(_files(spark, sf_dir), PATTERN, "zz").select("doc_id", "hits")
    return out.withColumn("hits", F.col("hits").cast("array<bigint>"))


@query(_LINES_SQL + """, s AS (SELECT doc_id, h, ls, greatest(h - 2, 1) AS a FROM (SELECT doc_id, ls, unnest(hits) AS h FROM m))
SELECT doc_id, h - 1 AS line, a AS start_line, least(a + 3, len(ls)) AS end_line, md5(array_to_string(ls[a:a + 3], chr(10))) AS digest FROM s""")
def g2_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snippet of four lines around every matching line of all documents (no caps)."""
    files = _files(spark, sf_dir)
    found = lx.grep(files, PATTERN, "zz", snippet_lines=4, snippet_bytes=1 << 30, max_files=None, max_blocks=None, max_size=1 << 30)
    hits = lx.matching_lines(files, PATTERN, "zz").select("path", "doc_id", "hits")
    both = found.join(hits, "path").select("doc_id", F.explode(F.arrays_zip("hits", "snippets")).alias("z"))
    return both.select(
        "doc_id", F.col("z.hits").cast("long").alias("line"), "z.snippets.start_line", "z.snippets.end_line", F.md5("z.snippets.text").alias("digest")
    )


@query(_LINES_SQL + " SELECT count(*) AS scanned, count(*) FILTER (len(hits) > 0) AS matched, coalesce(sum(len(hits)), 0)::bigint AS lines FROM m")
def a8_grep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scanned and matched, and lines matched."""
    return lx.grep_stats(_files(spark, sf_dir), PATTERN, "zz")


@query(_LINES_SQL + """, f AS (SELECT * FROM m WHERE len(hits) > 0 ORDER BY doc_id LIMIT 20),
c AS (SELECT doc_id, len(hits) AS n, coalesce(sum(len(hits)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f)
SELECT lpad(doc_id::varchar, 9, '0') || '.txt' AS path, n AS matches, least(n, 200 - b)::bigint AS n_snippets FROM c WHERE b < 200""")
def o9_grep_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped search: the first twenty files that match, with two hundred snippets at most."""
    found = lx.grep(_files(spark, sf_dir), PATTERN, "zz", max_size=1 << 30)
    return found.select("path", "matches", F.size("snippets").cast("long").alias("n_snippets"))


@query("SELECT doc_id, md5(encode(text)[101:300]) AS part, least(100, strlen(text)) AS start, greatest(least(300, strlen(text)), least(100, strlen(text))) AS \"end\" FROM documents WHERE text IS NOT NULL")
def g6_byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 100 to 300 of all documents."""
    return _files(spark, sf_dir).select("doc_id", lx.clip_bytes("text", 100, 200).alias("c")).select("doc_id", F.md5("c.data").alias("part"), "c.start", "c.end")


@query("""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, greatest(len(ls) - (text LIKE '%' || chr(10))::int, 1) AS n FROM l)
SELECT doc_id, CASE WHEN n < 2 THEN md5('') WHEN n <= 4 THEN md5(array_to_string(ls[2:], chr(10))) ELSE md5(array_to_string(ls[2:4], chr(10))) END AS part FROM t""")
def g7_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of all documents."""
    return _files(spark, sf_dir).select("doc_id", F.md5(lx.clip_lines("text", 2, 3)["data"]).alias("part"))


@query("""SELECT doc_id, md5(encode(text)[1:64]) AS head_bytes, md5(array_to_string(string_split(text, chr(10))[1:3], chr(10))) AS head_lines,
  md5(array_to_string(string_split(text, chr(10))[-2:], chr(10))) AS tail_lines, md5(encode(text)[greatest(strlen(text) - 63, 1):strlen(text)]) AS tail_bytes FROM documents WHERE text IS NOT NULL""")
def g8_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last bytes and lines of all documents."""
    return _files(spark, sf_dir).select(
        "doc_id", F.md5(lx.head("text", 64)).alias("head_bytes"), F.md5(lx.head("text", 0, 3)).alias("head_lines"),
        F.md5(lx.tail("text", 0, 2)).alias("tail_lines"), F.md5(lx.tail("text", 64)).alias("tail_bytes"),
    )


@query("SELECT lpad(doc_id::varchar, 9, '0') || '.txt' AS path, strlen(text) AS size, least(strlen(text), 500) AS returned, greatest(strlen(text) - 500, 0) AS remaining, CASE WHEN strlen(text) > 500 THEN 500 END AS next_offset FROM documents WHERE text IS NOT NULL")
def g10_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading the first 500 bytes of all documents, with how to go on."""
    return lx.read(_files(spark, sf_dir), max_bytes=500).drop("data")


@query("SELECT lpad(doc_id::varchar, 9, '0') || '.txt' AS path FROM documents WHERE text IS NOT NULL ORDER BY 1 LIMIT 100")
def o10_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing capped at a hundred files."""
    return lx.list_files(_files(spark, sf_dir), ["*.txt"], limit=100).select("path")


# --- summaries and integrity --------------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.chunked_documents(spark, sf_dir)
    return d.withColumn("content_chars", F.octet_length("chunk")).withColumn("embedding_model", F.lit("simple"))


@query(f"""
WITH a AS ({views.ASSETS_SQL}), d AS ({views.CHUNKS_SQL}),
x AS (SELECT dataset_id, count(*) AS assets, count(*) FILTER (archived = 1) AS assets_archived, count(*) FILTER (archived = 0) AS assets_active,
  coalesce(sum(size), 0)::bigint AS assets_size, arg_max(md5, mod_time) AS last_asset_md5 FROM a GROUP BY ALL),
y AS (SELECT dataset_id, count(*) AS docs, count(*) FILTER (archived = 1) AS docs_archived, count(*) FILTER (archived = 0) AS docs_active,
  round(coalesce(avg("end" - start) FILTER (archived = 0), 0), 6) AS avg_doc_len, max(scn) AS last_doc_scn FROM d GROUP BY ALL),
z AS (SELECT dataset_id, max(scn) // 2 AS last_sync_scn FROM a GROUP BY ALL)
SELECT x.*, coalesce(docs, 0) AS docs, coalesce(docs_archived, 0) AS docs_archived, coalesce(docs_active, 0) AS docs_active, coalesce(avg_doc_len, 0) AS avg_doc_len,
  last_doc_scn, CASE WHEN docs > 0 THEN 'simple' END AS embedding_model, last_sync_scn, 'shadow_vec_docs' AS upstream_shadow
FROM x LEFT JOIN y ON x.dataset_id = y.dataset_id JOIN z ON x.dataset_id = z.dataset_id""")
def a1_root_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of every root."""
    a = views.assets(spark, sf_dir)
    out = admin.root_summary(views.roots(spark, sf_dir), a, _docs(spark, sf_dir), views.cursors(spark, a))
    return out.drop("source_uri", "last_asset_mod_time")


_SPLIT_SQL = f"a AS (SELECT * FROM ({views.ASSETS_SQL}) WHERE scn % 5 <> 0), d AS (SELECT * FROM ({views.CHUNKS_SQL}) WHERE scn % 3 <> 0)"


def _incomplete(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assets and documents as after losses, so that there are orphans both ways."""
    return views.assets(spark, sf_dir).where("scn % 5 <> 0"), views.chunked_documents(spark, sf_dir).where("scn % 3 <> 0")


@query(f"""WITH {_SPLIT_SQL},
k AS (SELECT dataset_id FROM a UNION SELECT dataset_id FROM d)
SELECT dataset_id, (SELECT count(*) FROM d WHERE d.dataset_id = k.dataset_id) AS docs, (SELECT count(*) FROM d WHERE d.dataset_id = k.dataset_id AND archived = 1) AS docs_archived,
  (SELECT count(*) FROM d WHERE d.dataset_id = k.dataset_id AND archived = 0) AS docs_active, (SELECT count(*) FROM a WHERE a.dataset_id = k.dataset_id) AS assets,
  (SELECT count(*) FROM a WHERE a.dataset_id = k.dataset_id AND archived = 1) AS assets_archived, (SELECT count(*) FROM a WHERE a.dataset_id = k.dataset_id AND archived = 0) AS assets_active,
  (SELECT count(*) FROM d ANTI JOIN a USING (dataset_id, asset_id) WHERE d.dataset_id = k.dataset_id) AS orphan_docs,
  (SELECT count(*) FROM a ANTI JOIN d USING (dataset_id, asset_id) WHERE a.dataset_id = k.dataset_id) AS orphan_assets,
  (SELECT count(*) FROM d WHERE d.dataset_id = k.dataset_id AND start > 0) AS missing_embeddings FROM k""")
def a2_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity counts of every dataset."""
    a, d = _incomplete(spark, sf_dir)
    return admin.check_integrity(a, d.withColumn("embedding_missing", F.col("start") > 0))


@query(f"WITH {_SPLIT_SQL} SELECT id FROM d ANTI JOIN a USING (dataset_id, asset_id)")
def j2_orphan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their asset."""
    a, d = _incomplete(spark, sf_dir)
    return admin.orphan_documents(d, a).select("id")


@query(f"WITH {_SPLIT_SQL} SELECT dataset_id, asset_id FROM a ANTI JOIN d USING (dataset_id, asset_id)")
def j3_orphan_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets without a document."""
    a, d = _incomplete(spark, sf_dir)
    return admin.orphan_assets(a, d).select("dataset_id", "asset_id")


@query(f"{_RANKED_SQL} SELECT r.dataset_id, r.id, r.score, d.path FROM r JOIN ({views.VECTORS_SQL}) d ON r.dataset_id = d.dataset_id AND r.id = d.id WHERE rank <= 7 AND d.archived = 0")
def j1_hits_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index hits joined with their documents."""
    v = views.vectors(spark, sf_dir)
    hits = ve.topk_by_dataset(v, _probe(), 7).select("dataset_id", "id", "score")
    return ve.hits_with_documents(hits, v.drop("embedding")).select("dataset_id", "id", "score", "path")


@query(f"WITH l AS ({views.LOG_SQL}), c AS (SELECT dataset_id, max(scn) // 2 AS c FROM l GROUP BY ALL) SELECT l.dataset_id, count(*) FILTER (scn > c) AS pending, coalesce(max(scn) FILTER (scn > c), 0) AS max_scn FROM l JOIN c USING (dataset_id) GROUP BY ALL")
def a3_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries above each dataset's cursor."""
    log = views.change_log(spark, sf_dir)
    return changelog.pending(log, views.cursors(spark, log))


@query(f"WITH l AS ({views.LOG_SQL}), c AS (SELECT dataset_id, max(scn) // 2 AS last_scn FROM l GROUP BY ALL) SELECT dataset_id, last_scn FROM c WHERE last_scn > 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.dataset_id = c.dataset_id AND scn = last_scn)")
def a12_diverged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors whose entry the log lacks."""
    log = views.change_log(spark, sf_dir)
    return changelog.diverged(log, views.cursors(spark, log)).select("dataset_id", "last_scn")


@query(f"SELECT dataset_id, md5 FROM ({views.ASSETS_SQL}) WHERE archived = 0 AND md5 IN (SELECT md5(text) FROM documents) GROUP BY ALL")
def f15_known_md5s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the documents' hashes live assets have."""
    wanted = table(spark, sf_dir, "documents").select(F.md5("text").alias("md5"))
    return admin.known_md5s(views.assets(spark, sf_dir), wanted).select("dataset_id", "md5")


@query("SELECT md5(text) AS path, max(source) AS root FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a10_paths_to_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last root of each content path."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("path"), F.col("source").alias("dataset_id"))
    return admin.paths_to_roots(d)


@query("SELECT conv_id AS page, string_agg(text, '' ORDER BY turn) AS content, strlen(string_agg(text, '' ORDER BY turn)) AS n_bytes FROM conversations GROUP BY ALL")
def a11_joined_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every conversation joined in order."""
    return admin.joined_content(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "page"), "text", "turn")


# --- incremental indexing -----------------------------------------------------------------------------


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a later scan finds them: some gone, some changed."""
    a = views.assets(spark, sf_dir).where("scn % 13 <> 0")
    return a.select("dataset_id", "asset_id", "path", F.when(F.col("scn") % 4 == 0, F.md5(F.concat("md5", F.lit("x")))).otherwise(F.col("md5")).alias("md5"), "size", "mod_time")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets as stored: some not yet known."""
    return views.assets(spark, sf_dir).where("scn % 6 <> 0")


_STATE_SQL = f"""
WITH a AS ({views.ASSETS_SQL}),
s AS (SELECT dataset_id, asset_id, scn, archived, md5, CASE WHEN scn % 4 = 0 THEN md5(md5 || 'x') ELSE md5 END AS now_md5, scn % 13 <> 0 AS seen, scn % 6 <> 0 AS known FROM a),
c AS (SELECT *, CASE WHEN NOT known THEN 'new' WHEN NOT seen THEN CASE WHEN archived = 0 THEN 'removed' ELSE 'gone' END
  WHEN archived <> 0 THEN 'revived' WHEN md5 IS NOT DISTINCT FROM now_md5 THEN 'unchanged' ELSE 'changed' END AS state FROM s WHERE seen OR known),
m AS (SELECT *, CASE WHEN state IN ('new', 'changed', 'revived', 'removed') THEN 1000000 + dense_rank() OVER (PARTITION BY dataset_id, state IN ('new', 'changed', 'revived', 'removed') ORDER BY asset_id)
  ELSE scn END AS next_scn FROM c)"""


@query(_STATE_SQL + " SELECT dataset_id, asset_id, state FROM c")
def j4_classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan against the stored assets."""
    return indexing.classify(_scanned(spark, sf_dir), _stored(spark, sf_dir)).select("dataset_id", "asset_id", "state")


@query(_STATE_SQL + " SELECT dataset_id, count(*) FILTER (seen) AS total, count(*) FILTER (state IN ('new', 'changed', 'revived')) AS changed, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'removed') AS removed FROM c GROUP BY ALL")
def a7_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress counts of an indexing run."""
    return indexing.stats(indexing.classify(_scanned(spark, sf_dir), _stored(spark, sf_dir)))


@query(_STATE_SQL + """ SELECT dataset_id, asset_id, CASE WHEN state IN ('new', 'changed', 'revived') THEN now_md5 ELSE md5 END AS md5,
  next_scn::bigint AS scn, CASE WHEN state IN ('removed', 'gone') THEN 1 WHEN state = 'unchanged' THEN archived ELSE 0 END AS archived FROM m""")
def l9_index_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset table after an indexing run, with new SCNs for what changed."""
    stored = _stored(spark, sf_dir)
    counters = views.roots(spark, sf_dir).select("dataset_id", F.lit(1_000_000).cast("long").alias("last_scn"))
    return indexing.index_assets(_scanned(spark, sf_dir), stored, counters).assets.select("dataset_id", "asset_id", "md5", "scn", "archived")


@query(f"""WITH a AS ({views.ASSETS_SQL}), f AS (SELECT dataset_id, asset_id, CASE WHEN scn % 2 = 0 THEN md5 || 'x' ELSE md5 END AS md5 FROM a)
SELECT dataset_id, asset_id FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.archived = 0 AND a.dataset_id = f.dataset_id AND a.md5 = f.md5)""")
def j6_new_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content no live asset has; every other one has changed since it was stored."""
    a = views.assets(spark, sf_dir)
    files = a.withColumn("md5", F.when(F.col("scn") % 2 == 0, F.concat("md5", F.lit("x"))).otherwise(F.col("md5")))
    return indexing.skip_known_content(files, a).select("dataset_id", "asset_id")


@query(f"WITH a AS ({views.ASSETS_SQL}) SELECT dataset_id, asset_id FROM a WHERE scn % 3 <> 0 OR scn % 5 = 0")
def j7_matches_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an upstream asset has already, by hash or by size."""
    a = views.assets(spark, sf_dir)
    up_md5 = F.when(F.col("scn") % 5 == 0, F.lit("")).when(F.col("scn") % 3 == 0, F.lit("other")).otherwise(F.upper("md5"))
    return indexing.matches_upstream(a, a.withColumn("md5", up_md5)).select("dataset_id", "asset_id")


# --- changes to tables --------------------------------------------------------------------------------


@query(f"""WITH a AS ({views.ASSETS_SQL}) SELECT dataset_id, asset_id, CASE WHEN scn % 3 = 0 THEN 'n' || md5 ELSE md5 END AS md5, CASE WHEN scn % 3 = 0 THEN scn + 7 ELSE scn END AS scn
FROM a UNION ALL SELECT dataset_id, asset_id || '-new', 'n' || md5, scn + 7 FROM a WHERE scn % 3 <> 0""")
def w3_upsert_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with a newer row for each upserted, some under new ids; the last of repeated ones wins."""
    a = views.assets(spark, sf_dir)
    known = F.col("scn") % 3 == 0
    new = a.withColumn("asset_id", F.when(known, F.col("asset_id")).otherwise(F.concat("asset_id", F.lit("-new"))))
    new = new.withColumn("md5", F.concat(F.lit("n"), "md5")).withColumn("scn", F.col("scn") + 7)
    twice = new.unionByName(new.withColumn("md5", F.lit("older")).withColumn("scn", F.col("scn") - 1))
    return up.upsert(a, twice, up.ASSET_KEY).select("dataset_id", "asset_id", "md5", "scn")


@query(f"WITH d AS ({views.CHUNKS_SQL}) SELECT id, CASE WHEN scn % 4 = 0 THEN 1 ELSE archived END AS archived, CASE WHEN scn % 4 = 0 THEN 999999999 ELSE scn END AS scn FROM d")
def w7_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of removed assets archived under a new SCN."""
    d = views.chunked_documents(spark, sf_dir)
    gone = views.assets(spark, sf_dir).where("scn % 4 = 0")
    return up.archive(d, gone, up.ASSET_KEY, F.lit(999_999_999).cast("long")).select("id", "archived", "scn")


@query(f"WITH d AS ({views.CHUNKS_SQL}), m AS (SELECT min(source) AS s FROM documents) SELECT id FROM d, m WHERE NOT (dataset_id = s AND archived = 1 AND scn <= 500)")
def w9_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without one dataset's archived ones up to an SCN."""
    name = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    return up.prune(views.chunked_documents(spark, sf_dir), name, 500).select("id")


@query(f"WITH a AS ({views.ASSETS_SQL}) SELECT dataset_id, greatest(max(scn) // 2, max(scn) FILTER (archived = 0) // 3) AS last_scn FROM a GROUP BY ALL")
def w15_raise_scn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters raised to newer ones."""
    a = views.assets(spark, sf_dir)
    return up.raise_scn(views.cursors(spark, a), views.cursors(spark, a.where("archived = 0"), 3))


@query("SELECT event_id, 5000000 + row_number() OVER (ORDER BY ts, event_id) AS scn, (5000000 + row_number() OVER (ORDER BY ts, event_id))::varchar AS id FROM events")
def w20_append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events numbered after a log's last."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    log = spark.createDataFrame([(5_000_000,)], "scn long")
    return up.append_events(log, e, ["ts", "event_id"]).select("event_id", "scn", "id")


@query("SELECT event_id AS id, CASE WHEN event_id IN (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 25) THEN 'claimed' WHEN event_type = 'click' THEN 'pending' ELSE 'done' END AS status FROM events")
def o13_claim_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 oldest pending jobs claimed."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("enqueued_at"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"), F.lit("").alias("worker"))
    return up.claim_jobs(jobs, 25, "w1").select("id", "status")


# --- change log ---------------------------------------------------------------------------------------


@query(f"""
WITH l AS ({views.LOG_SQL}), s AS (SELECT dataset_id, document_id AS id, max(scn) AS scn, arg_max(op, scn) AS op, arg_max(content, scn) FILTER (op <> 'delete') AS content,
  arg_max(asset_id, scn) FILTER (op <> 'delete') AS asset_id, count(*) FILTER (op <> 'delete') AS n FROM l GROUP BY ALL)
SELECT dataset_id, id, asset_id, content, scn, (op = 'delete')::int AS archived FROM s WHERE n > 0""")
def l2_log_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after the whole log."""
    return changelog.final_state(views.change_log(spark, sf_dir)).select("dataset_id", "id", "asset_id", "content", "scn", "archived")


@query(f"""
WITH l AS ({views.LOG_SQL}), s AS (SELECT dataset_id, asset_id, max(scn) AS scn, arg_max(op, scn) AS op, arg_max(md5, scn) FILTER (op <> 'delete') AS md5, count(*) FILTER (op <> 'delete') AS n FROM l GROUP BY ALL)
SELECT dataset_id, asset_id, md5, scn, (op = 'delete')::int AS archived FROM s WHERE n > 0""")
def l2_asset_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets after the whole log."""
    return changelog.asset_state(views.change_log(spark, sf_dir)).select("dataset_id", "asset_id", "md5", "scn", "archived")


@query(f"""
WITH l AS (SELECT *, op <> 'delete' AND NOT regexp_matches('docs/' || asset_id || '.txt', '/a[0-9]*7[.]txt$') AS kept FROM ({views.LOG_SQL})),
s AS (SELECT dataset_id, document_id AS id, max(scn) FILTER (kept) AS told, max(scn) FILTER (op = 'delete') AS dead, arg_max(content, scn) FILTER (kept) AS content,
  arg_max(embedding, scn) FILTER (kept) AS embedding FROM (SELECT *, [1.0, scn / 1024] AS embedding FROM l) GROUP BY ALL)
SELECT dataset_id, id, content, embedding[1]::double AS e0, embedding[2]::double AS e1, greatest(told, coalesce(dead, 0)) AS scn, (coalesce(dead, 0) > told)::int AS archived FROM s WHERE told IS NOT NULL""")
def l1_incremental_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the log applied as a whole, the rest on top of it, under a root's rules: the same state, vectors too, as in one go."""
    log = views.change_log(spark, sf_dir)
    vector = F.concat(F.lit("0000803f"), sc.hex_of_vector(F.array((F.col("scn") / 1024).cast("float"))))
    payload = F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(',"embedding":"'), vector, F.lit('"}'))
    log = log.withColumn("payload", payload)
    rules = PathRules(exclude=["git:**/a*7.txt"])
    state = views.cursors(spark, log).select("dataset_id", "shadow_table", "last_scn")
    first = log.join(state, ["dataset_id", "shadow_table"]).where("scn <= last_scn").select(*log.columns)
    docs, _ = changelog.apply_log(changelog.final_state(first, rules), log, state, rules)
    return docs.select("dataset_id", "id", "content", F.col("embedding")[0].cast("double").alias("e0"), F.col("embedding")[1].cast("double").alias("e1"), "scn", "archived")


@query(f"""
WITH l AS (SELECT *, op <> 'delete' AND NOT regexp_matches('docs/' || asset_id || '.txt', '/a[0-9]*7[.]txt$') AS kept FROM ({views.LOG_SQL})),
s AS (SELECT dataset_id, asset_id, max(scn) FILTER (kept) AS told, max(scn) FILTER (op = 'delete') AS dead, arg_max(md5, scn) FILTER (kept) AS md5 FROM l GROUP BY ALL)
SELECT dataset_id, asset_id, md5, greatest(told, coalesce(dead, 0)) AS scn, (coalesce(dead, 0) > told)::int AS archived FROM s WHERE told IS NOT NULL""")
def l1_incremental_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets after the first half of the log and then the rest, under a root's rules."""
    log, rules = views.change_log(spark, sf_dir), PathRules(exclude=["git:**/a*7.txt"])
    state = views.cursors(spark, log).select("dataset_id", "shadow_table", "last_scn")
    first = log.join(state, ["dataset_id", "shadow_table"]).where("scn <= last_scn").select(*log.columns)
    return changelog.apply_assets(changelog.asset_state(first, rules), log, state, rules).select("dataset_id", "asset_id", "md5", "scn", "archived")


@query(f"""
WITH l AS (SELECT *, (dense_rank() OVER (PARTITION BY dataset_id ORDER BY scn) - 1) // 200 AS batch FROM (SELECT * REPLACE (scn // 12 AS scn) FROM ({views.LOG_SQL})))
SELECT dataset_id, batch, count(*) FILTER (op = 'insert') AS inserts, count(*) FILTER (op = 'update') AS updates, count(*) FILTER (op = 'delete') AS deletes, min(scn) AS min_scn, max(scn) AS max_scn FROM l GROUP BY ALL""")
def a5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log batches of 200 SCNs, which several entries share, with their counters."""
    log = views.change_log(spark, sf_dir).withColumn("scn", F.floor(F.col("scn") / 12).cast("long"))
    return changelog.batch_counters(changelog.batches(log, 200))


@query(f"WITH d AS ({views.CHUNKS_SQL}), c AS (SELECT dataset_id, max(scn) // 2 AS c FROM d GROUP BY ALL) SELECT d.dataset_id, id AS document_id, scn, CASE WHEN archived <> 0 THEN 'delete' ELSE 'update' END AS op, asset_id, id AS named, archived::varchar AS state FROM d JOIN c USING (dataset_id) WHERE scn > c")
def w10_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents above a downstream cursor as log entries."""
    d = views.chunked_documents(spark, sf_dir).select("dataset_id", "id", "asset_id", "scn", "archived")
    told = [F.get_json_object("payload", f"$.{k}").alias(n) for k, n in (("asset_id", "asset_id"), ("id", "named"), ("archived", "state"))]
    return changelog.push_entries(d, views.cursors(spark, d)).select("dataset_id", "document_id", "scn", "op", *told)


@query(f"""
WITH a AS ({views.ASSETS_SQL}), x AS (SELECT dataset_id, asset_id, md5, (CASE WHEN scn % 7 <> 0 AND scn % 3 = 0 THEN scn - 1000000000 ELSE size END)::varchar AS size,
    CASE WHEN scn % 5 = 0 THEN 'insert' WHEN scn % 7 = 0 THEN 'delete' ELSE 'update' END AS op FROM a
  WHERE (scn % 5 = 0) <> (scn % 7 = 0) OR (scn % 5 <> 0 AND scn % 7 <> 0 AND scn % 3 = 0))
SELECT dataset_id, asset_id, op, md5, size, 100 + row_number() OVER (PARTITION BY dataset_id ORDER BY asset_id) AS scn FROM x""")
def w16_snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two snapshots as a log."""
    a = views.assets(spark, sf_dir)
    after = a.where("scn % 7 <> 0").withColumn("size", F.when(F.col("scn") % 3 == 0, F.col("scn") - 1_000_000_000).otherwise(F.col("size")))
    return changelog.snapshot_difference(a.where("scn % 5 <> 0"), after, ["dataset_id", "asset_id"], 100).select(
        "dataset_id", "asset_id", "op", *(F.get_json_object("payload", f"$.{k}").alias(k) for k in ("md5", "size")), "scn"
    )


@query(f"WITH a AS ({views.ASSETS_SQL}), x AS (SELECT dataset_id, max(scn) // 2 AS l, max(scn) FILTER (archived = 0) AS d FROM a GROUP BY ALL) SELECT dataset_id, CASE WHEN l > 0 THEN least(l, coalesce(d, 0)) ELSE coalesce(d, 0) END AS last_scn FROM x")
def l6_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which SCN to push to each downstream dataset."""
    a = views.assets(spark, sf_dir)
    return changelog.baseline(views.cursors(spark, a), a.where("archived = 0"))


@query("""
WITH v AS (SELECT source, doc_id, strlen(text)::bigint AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, n + 4 + greatest(1, ceil(CASE WHEN n > 0 THEN strlen(bin(n)) ELSE 1 END / 7.0)::bigint) AS b FROM v),
s AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pos FROM r)
SELECT doc_id, pos // 65536 AS segment, pos % 65536 AS "offset", n AS length FROM s""")
def w19_value_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts appended to segments of 64 KiB."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("namespace"), F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("value"))
    return values.append(d, segment_bytes=1 << 16).select(F.col("seq").alias("doc_id"), "segment", "offset", "length")


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL")
def c12_plain_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by group over a join of general tables."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = li.where("l_shipdate >= timestamp '1995-01-01'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


__all__ = ["QUERIES", "ORACLE_SQL"]

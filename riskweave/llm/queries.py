"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anagrams, binary_codes, chat, curriculum, forest, main_text, maxscore, merkle, prefix_bpe, site_quality, token_store, toxicity, warc
from .workspace import Workspace, compact, cores, gather


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that come in fewer pieces than there are cores are dealt out first."""
    return rows if rows.rdd.getNumPartitions() >= cores(rows) else rows.repartition(2 * cores(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


def spread(files: DataFrame) -> DataFrame:
    """Rows that name files, dealt to at most two tasks a core."""
    return files.repartition(max(1, min(files.count(), 2 * cores(files))))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "tokens")
    files = token_store.write_token_files(table(spark, sf_dir, "documents"), ws.folder("files"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_token_files(spark, ws.gathered_table("manifest", files))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    files = ws.gathered_table("manifest", warc.write_warc(table(spark, sf_dir, "pages"), ws.folder("files")))
    records = warc.read_warc(spread(files), with_payload=False).filter("kind in ('response', 'revisit')")
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"), Workspace(spark, "chat"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forest.near_duplicates(documents(spark, sf_dir), Workspace(spark, "forest"))
    return compact(rows.withColumnRenamed("id", "doc_id"))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(maxscore.finite_vector(F.col("embedding")))
    terms, weights = maxscore.quantized_terms(F.col("embedding"), 256)
    rows = rows.select(F.col("vec_id").alias("id"), terms.alias("terms"), weights.alias("weights"))
    found = maxscore.top_k(rows, rows.filter("id % 50 = 0"), 5, every_row=True)
    return compact(found.select("query_id", "rank", F.col("id").alias("vec_id"), "score"))


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix, in training order (those not taken last); places are billionths of the training time."""
    rows = curriculum.assign(table(spark, sf_dir, "documents"), ws=Workspace(spark, "mix"), keep=["doc_id"])
    billionths = lambda at: F.floor(at * 1e9).cast("long")
    rows = rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"),
                       billionths(F.array_min("_positions")).alias("first_place"), billionths(F.array_max("_positions")).alias("last_place"))
    order = F.col("first_place").asc_nulls_last(), F.col("doc_id")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def op7_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binary_codes.near_duplicates(table(spark, sf_dir, "embeddings"), Workspace(spark, "codes"))
    return compact(rows.withColumnRenamed("id", "vec_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # a row without an id is not
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    scored = toxicity.score(docs, model, score_col="score")
    return gather(scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = prefix_bpe.encode_column(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids_col=None, digests=True)
    return gather(rows.drop("text"))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # a row without an id is not
    model = site_quality.train(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    rows = site_quality.classify(docs, model, Workspace(spark, "quality"), keep=["doc_id"])
    return gather(rows.select("doc_id", held_out.alias("held_out"), *(F.col(c).alias(c[1:]) for c in site_quality.NEW)))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = dealt(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return main_text.extract(pages, drop_html=True)


def op12_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anagrams.variants(documents(spark, sf_dir).select("doc_id", "text"), Workspace(spark, "anagrams"), min_length=7, min_count=2, ratio=10, slips=31)
    return rows.select("word", "form", "root", "n", "n_near", "form_n")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fields = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = docs.select("doc_id", "lang", fields(F.col("text")).alias("leaf"), F.when(tampered, fields(lowered)).alias("tampered"))
    return merkle.manifest(leaves, Workspace(spark, "merkle"), tree_col="lang", order_col="doc_id", leaf_col="leaf", tampered_col="tampered").withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_warc": op2_warc,
    "op3_perspectives": op3_perspectives,
    "op4_minhash_forest": op4_minhash_forest,
    "op5_maxscore": op5_maxscore,
    "op6_curriculum": op6_curriculum,
    "op7_binary_codes": op7_binary_codes,
    "op8_toxicity": op8_toxicity,
    "op9_prefix_bpe": op9_prefix_bpe,
    "op10_site_quality": op10_site_quality,
    "op11_main_text": op11_main_text,
    "op12_anagram_variants": op12_anagram_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: DuckDB: components of edges (a, b, both directions) over nodes (id), by the smallest id reachable.
REACH_SQL = """
reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id WHERE r.root < e.b),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY 1)"""

#: DuckDB: crc32 of the bytes of the text ``{text}``, by the table ``t`` of CRC_TABLE.
CRC_TABLE = """
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(t[CAST(xor(c & 255, b) AS INTEGER) + 1], c >> 8)))"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS q FROM d)
SELECT page_id, octet_length(payload) AS payload_bytes,
  list_aggregate(list_transform(q, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g""",
    "op3_perspectives": r"""
WITH t AS (
  SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') AS text,
    regexp_replace(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') AS name FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS position FROM t
), people AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS DISTINCT FROM 'system'),
r AS (
  SELECT n.*, p.speaker, n.role IS NOT DISTINCT FROM p.speaker AS own, text || '<|im_end|>' AS body,
    CASE WHEN n.role IS NOT DISTINCT FROM p.speaker THEN '<|im_start|>assistant' WHEN n.role = 'system' THEN '<|im_start|>system' ELSE '<|im_start|>user' || coalesce(' name=' || name, '') END || chr(10) AS head
  FROM n JOIN people p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), c AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS BIGINT) AS start FROM r
)
SELECT conv_id, speaker, position, role, head || body || chr(10) AS text, CASE WHEN own THEN start END AS mask_start, CASE WHEN own THEN start + length(body) END AS mask_end FROM c""",
    "op4_minhash_forest": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM pairs JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * shared >= 75 * (i.n_shingles + j.n_shingles - shared)),
nodes AS (SELECT doc_id AS id FROM documents),"""
    + REACH_SQL
    + """
SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN least l ON l.id = d.doc_id""",
    "op5_maxscore": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_curriculum": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || md5(coalesce(text, ''))) AS digest FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
o AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS shape, 3 * source_size AS cap FROM s),
w AS (SELECT *, CAST([5, 2, 1][shape + 1] AS DOUBLE) AS weight FROM o),
l AS (
  SELECT *, cap / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, shape, weight AS area, CASE WHEN ratio > x.level THEN x.level * weight ELSE CAST(cap AS DOUBLE) END AS target
  FROM l LEFT JOIN (SELECT level FROM l WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1) x ON true
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shape, t.area, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, list_transform(list_filter([0, 1, 2], lambda e: size > 0 AND 2 * (start + e * source_size) + size < 2 * target), lambda e: CAST(start + e * source_size AS DOUBLE) / target * area) AS demands FROM p
), k AS (
  SELECT *, list_transform(demands, lambda c: CASE WHEN shape = 0 THEN {'at': 0.0::DOUBLE, 'w': 8.0::DOUBLE, 'slope': -6.0::DOUBLE, 'need': c} WHEN shape = 2 THEN {'at': 0.0::DOUBLE, 'w': 0.0::DOUBLE, 'slope': 2.0::DOUBLE, 'need': c}
    WHEN c < 1 THEN {'at': 0.0::DOUBLE, 'w': 1.0::DOUBLE, 'slope': 4.0::DOUBLE, 'need': c} ELSE {'at': 0.5::DOUBLE, 'w': 3.0::DOUBLE, 'slope': -4.0::DOUBLE, 'need': c - 1} END) AS knots FROM q
), z AS (
  SELECT *, list_transform(knots, lambda x: least(coalesce(x.at + 2 * x.need / nullif(x.w + sqrt(greatest(x.w * x.w + 2 * x.slope * x.need, 0)), 0), x.at), 1)) AS positions FROM k
)
SELECT doc_id, size, source_size, target, CAST(size * len(positions) AS BIGINT) AS taken, CAST(floor(list_min(positions) * 1e9) AS BIGINT) AS first_place, CAST(floor(list_max(positions) * 1e9) AS BIGINT) AS last_place FROM z""",
    "op7_binary_codes": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings),"""
    + REACH_SQL
    + """
SELECT d.vec_id, (SELECT count(*) FROM edges e WHERE e.a = d.vec_id) AS n_links, component_id, d.vec_id = component_id AS kept FROM embeddings d JOIN least l ON l.id = d.vec_id""",
    "op11_main_text": r"""
WITH b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<br>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM pages
), x AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM x""",
    "op12_anagram_variants": r"""
WITH RECURSIVE""" + CRC_TABLE + r""",
o AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), r AS (SELECT doc_id, run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS id, count(*) AS n FROM o WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, n, """ + CRC.format(text="id") + r""" AS h FROM r, t),
e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
x AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM x a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM x a JOIN w b ON a.rest = b.word
), f AS (
  SELECT near.word, count(*) AS n_near, first(near.near ORDER BY v.n DESC, near.near) AS form, max(v.n) AS form_n FROM near JOIN w v ON v.word = near.near GROUP BY 1
), k AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN f ON f.word = w.word
), c AS (SELECT word, word AS root FROM k UNION SELECT c.word, k.form FROM c JOIN k ON k.word = c.root WHERE k.form IS NOT NULL)
SELECT k.word, k.form, c.root, k.n, k.n_near, k.form_n FROM k JOIN c ON c.word = k.word JOIN k z ON z.word = c.root AND z.form IS NULL""",
    "op13_merkle_manifest": """
WITH RECURSIVE""" + CRC_TABLE + """,
d AS (
  SELECT doc_id, lang, n_chars, source, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
      || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS front FROM documents
), l AS (
  SELECT d.doc_id, d.lang, sha256(front || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(front || coalesce(octet_length(encode(lowered)) || ':' || lowered, '-')) AS lowered,
    doc_id IS NOT NULL AND """ + CRC.format(text="id") + """ % 3 = 0 AS tampered FROM d, t
), a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS total FROM l),
nodes AS (
  SELECT lang, 0 AS level, spot, leaf AS node, total FROM a
  UNION ALL
  SELECT lang, any_value(level) + 1, spot // 8, sha256(string_agg(node, '' ORDER BY spot)), any_value(total + 7) // 8 FROM nodes WHERE total > 1 GROUP BY lang, spot // 8
), tops AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM nodes WHERE total = 1),
upper AS (
  SELECT 0 AS level, tree AS spot, subroot AS node, trees AS total FROM tops
  UNION ALL
  SELECT any_value(level) + 1, spot // 8, sha256(string_agg(node, '' ORDER BY spot)), any_value(total + 7) // 8 FROM upper WHERE total > 1 GROUP BY spot // 8
), path AS (
  SELECT a.lang, a.doc_id, a.spot AS leaf_at, 0 AS part, n.level, (a.spot >> CAST(3 * n.level AS BIGINT)) & 7 AS place, coalesce(string_agg(n.node, '' ORDER BY n.spot) FILTER (n.spot <> (a.spot >> CAST(3 * n.level AS BIGINT))), '') AS others
  FROM a JOIN nodes n ON n.lang IS NOT DISTINCT FROM a.lang AND n.total > 1 AND n.spot // 8 = (a.spot >> CAST(3 * n.level + 3 AS BIGINT)) GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.doc_id, a.spot, 1, u.level, (p.tree >> CAST(3 * u.level AS BIGINT)) & 7, coalesce(string_agg(u.node, '' ORDER BY u.spot) FILTER (u.spot <> (p.tree >> CAST(3 * u.level AS BIGINT))), '')
  FROM a JOIN tops p ON p.lang IS NOT DISTINCT FROM a.lang JOIN upper u ON u.total > 1 AND u.spot // 8 = (p.tree >> CAST(3 * u.level + 3 AS BIGINT)) GROUP BY a.lang, a.doc_id, a.spot, p.tree, u.level
), paths AS (SELECT lang, leaf_at, list({'place': place, 'others': others} ORDER BY part, level) AS path FROM path GROUP BY 1, 2),
g AS (
  SELECT a.*, subroot, (SELECT node FROM upper WHERE total = 1) AS root, coalesce(path, []) AS path FROM a JOIN tops p ON p.lang IS NOT DISTINCT FROM a.lang LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM a.lang AND q.leaf_at = a.spot
), z AS (
  SELECT *, list_reduce(list_prepend({'place': 0::BIGINT, 'others': CASE WHEN tampered THEN lowered ELSE leaf END}, path),
    lambda x, y: {'place': 0::BIGINT, 'others': sha256(substr(y.others, 1, 64 * y.place) || x.others || substr(y.others, 64 * y.place + 1))}).others AS folded_root FROM g
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.others), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z""",
}

"""The registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, crosstok, cws, decontam, fim, kdshards, langid, linededup, lpf, minhash, recipes, sitetree, warc

SHARDS = 40
MIN_DOCS = 10


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), "doc_id", decode=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshards.kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_bytes")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.learns(F.col("doc_id"))
    languages = langid.fit(docs.where(learned).select("text", "lang"))
    return langid.predict(docs, languages, "doc_id").select("doc_id", (~learned).alias("held_out"), "lang_pred", "score", "rejected")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lpf.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"), MIN_DOCS)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edit_likeness(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    aligned, _ = crosstok.cross_align(table(spark, sf_dir, "documents"), *paths, "doc_id", digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    done = fim.fill_in_middle(table(spark, sf_dir, "documents"), "doc_id")
    hashed = done.select(*columns, "output", F.sha2("output", 256).alias("output_sha256"))
    back = fim.restore(hashed, *columns, "output_sha256")
    return back.select(*columns, "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_site_style_tree": op1,
    "op2_bpe_forced_boundaries": op2,
    "op3_kd_shards": op3,
    "op4_chunk_recipes": op4,
    "op5_compression_langid": op5,
    "op6_minhash_coordinates": op6,
    "op7_warc_index_first": op7,
    "op8_previous_factors": op8,
    "op9_line_bitmaps": op9,
    "op10_simhash_windows": op10,
    "op11_weighted_sampling": op11,
    "op12_spill_counting": op12,
    "op13_skip_list_fim": op13,
}

SPACES = r"[\x20\x09-\x0D]"

ORACLE = {
    "op4_chunk_recipes": rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g') AS t FROM documents
), r AS (
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
  FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r""",
    "op6_minhash_coordinates": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * shared >= 85 * (u.n + v.n - shared)
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c
), m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op7_warc_index_first": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f""",
    "op8_previous_factors": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT doc_id, start, substr(h, 2 * start + 1, 2 * (1000 + 49)) AS block
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 1000)) AS start FROM d)
), w AS MATERIALIZED (
  SELECT doc_id, start + i AS i, hash(substr(block, 2 * i + 1, 100)) AS s
  FROM (SELECT doc_id, start, block, unnest(range(0, length(block) // 2 - 49)) AS i FROM b)
), m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), c AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN m ON m.s = w.s WHERE m.first < w.doc_id
), g AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM c
), r AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run, i FROM g
), spans AS (SELECT doc_id, run, min(i) AS low, max(i) + 50 AS high FROM r GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM spans
), k AS (
  SELECT p.doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last_high,
         string_agg(substr(d.h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS head
  FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last_high, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op9_line_bitmaps": rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^{SPACES}+', ''), '{SPACES}+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), heavy AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), m AS (SELECT k.*, h.key IS NOT NULL AS gone FROM k LEFT JOIN heavy h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op13_skip_list_fim": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACES}*[^\x20\x09-\x0D]+|{SPACES}+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(u[greatest(x, y) + 1:], '') AS z
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE '<P>' || a || '<S>' || z || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""",
}

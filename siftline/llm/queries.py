"""The queries of this folder's operators, each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extraction, linededup, mixing, mpegts, neardup, outliers, packing, quality_model, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), ngram=3, similarity=0.85)


def op5_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outlier_rules(table(spark, sf_dir, "documents"))


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the lines that repeat elsewhere removed; the digest lists what went."""
    cleaned = linededup.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.array_join("removed_lines", "\n")).alias("removed_md5"), "text")


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = mpegts.transport_streams(table(spark, sf_dir, "documents"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units")


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_vector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_kd_shards": op1_kd_shards,
    "op2_tag_path_ratios": op2_tag_path_ratios,
    "op3_byte_cnn": op3_byte_cnn,
    "op4_minhash_join": op4_minhash_join,
    "op5_outlier_rules": op5_outlier_rules,
    "op6_line_windows": op6_line_windows,
    "op7_transport_streams": op7_transport_streams,
    "op8_warc_zstd": op8_warc_zstd,
    "op9_vector_pack": op9_vector_pack,
    "op10_pivotal_mix": op10_pivotal_mix,
}

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op6_line_windows": f"""
WITH lines AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
), worded AS (
  SELECT doc_id, i AS lno, trim(all_lines[i], {_WS}) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
  FROM (SELECT doc_id, all_lines, unnest(range(1, len(all_lines) + 1)) AS i FROM lines) WHERE trim(all_lines[i], {_WS}) <> ''
), win AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER w AS line1, lead(line, 2) OVER w AS line2 FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line1, line2 ORDER BY doc_id, pos) AS nr FROM win WHERE line2 IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE nr > 1
), owner AS (
  SELECT l.doc_id, i, all_lines[i] AS line, (SELECT max(lno) FROM worded w WHERE w.doc_id = l.doc_id AND w.lno <= i) AS lno
  FROM (SELECT doc_id, all_lines, unnest(range(1, len(all_lines) + 1)) AS i FROM lines) l WHERE l.doc_id IN (SELECT doc_id FROM covered)
), kept AS (
  SELECT o.doc_id, string_agg(o.line, chr(10) ORDER BY o.i) AS kept_text
  FROM owner o JOIN worded w ON w.doc_id = o.doc_id AND w.lno = o.lno LEFT JOIN covered c ON c.doc_id = w.doc_id AND c.pos = w.pos
  WHERE c.pos IS NULL GROUP BY o.doc_id
), removed AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.line, chr(10) ORDER BY w.pos) AS gone FROM worded w JOIN covered c USING (doc_id, pos) GROUP BY w.doc_id
), counted AS (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::INT AS n_lines, coalesce(r.n, 0)::INT AS n_removed, md5(coalesce(r.gone, '')) AS removed_md5,
       CASE WHEN r.n > 0 THEN coalesce(k.kept_text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN counted n USING (doc_id) LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
    # Base32 of the SHA-1: each five hexadecimal digits are four letters.
    "op8_warc_zstd": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, payload_bytes, list_reduce(list_transform(range(0, 8), lambda i:
    list_reduce(list_transform(range(0, 4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT >> (15 - 5 * k)) & 31)::INT), 1)), lambda a, b: a || b)
  ), lambda a, b: a || b) AS payload_digest FROM p
), m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM m
""",
    "op4_minhash_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS id, b AS other FROM both_ways UNION SELECT r.id, t.b FROM reach r JOIN both_ways t ON t.a = r.other),
c AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
""",
}

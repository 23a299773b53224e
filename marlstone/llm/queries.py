"""Queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup, near_dedup, order_minhash, packing, piece_sampling, sharding, toxicity, trie_dedup, warc

SHARDS = 40
SEQUENCE = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.line_dedup(docs).select("doc_id", "removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op2_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("low_id")


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each sample. Each is decoded again: text_sha256 is that of the decoded text, which must be the document's."""
    return piece_sampling.sample_pieces(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), with_digest=True)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op5_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of ``op5_sharding``: each shard's rows, and that its slots are gapless; the sum of all sizes."""
    out = op5_sharding(spark, sf_dir)
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))
    return per.crossJoin(F.broadcast(out.agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"))))  # 40 rows and one


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(_table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), k=4)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"))
    return warc.records(warc.read_warc(manifest, with_data=False))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), SEQUENCE, with_ids=False).drop("ids")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_trie_dedup": op2_trie_dedup,
    "op3_piece_sampling": op3_piece_sampling,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op5_shard_sizes": op5_shard_sizes,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_order_minhash": op7_order_minhash,
    "op8_warc": op8_warc,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h, len(regexp_extract_all(line, '[^\x09\x0B\x0C\x0D\x20]+')) AS w FROM l),
r AS (SELECT *, (h + 31 * coalesce(lag(h) OVER p, 0)) % 4 = 0 AS cut, lead(line) OVER p AS next, lead(w) OVER p AS next_w FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
sparse AS (SELECT doc_id, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, k HAVING count(*) >= 2 AND sum(w) < 50),
old_sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS nth FROM sparse) WHERE nth > 1),
old_line AS (SELECT * FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM c WHERE w >= 50) WHERE nth > 1),
old_pair AS (SELECT * FROM (SELECT doc_id, i, w, next_w, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) AS nth FROM c WHERE next IS NOT NULL) WHERE nth > 1),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM old_pair),
run AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM island GROUP BY doc_id, g HAVING sum(w) + arg_max(next_w, i) >= 50),
gone AS (SELECT doc_id, unnest(range(a, b + 1)) AS i FROM (SELECT doc_id, a, b FROM run UNION ALL SELECT doc_id, a, b FROM old_sparse UNION ALL SELECT doc_id, i, i FROM old_line)),
once AS (SELECT DISTINCT doc_id, i FROM gone)
SELECT l.doc_id, count(once.i) AS removed_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (once.i IS NULL), '')) AS text_sha256
FROM l LEFT JOIN once ON once.doc_id = l.doc_id AND once.i = l.i GROUP BY l.doc_id
UNION ALL SELECT doc_id, 0, NULL FROM documents WHERE text IS NULL
""",
    "op2_trie_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id)
""",
    "op5_shard_sizes": r"""
WITH t AS (SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS bytes, max(octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS largest FROM documents)
SELECT s::INT AS shard, n // 40 + (s < n % 40)::BIGINT AS n, 0::BIGINT AS first_slot, n // 40 + (s < n % 40)::BIGINT - 1 AS last_slot, n // 40 + (s < n % 40)::BIGINT AS slots, bytes, largest
FROM t, range(40) AS r(s)
""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p GROUP BY html),
d AS (SELECT html, top, sha1(html) AS hex FROM g),
bits AS (SELECT html, list_transform(range(8), lambda k: ('0x' || substr(hex, 5 * k + 1, 5))::BIGINT) AS fives FROM d),
b32 AS (SELECT html, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS digest FROM bits)
SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes, b32.digest AS payload_digest,
       CASE WHEN p.page_id = g.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> g.top THEN g.top END AS refers_to
FROM p JOIN g USING (html) JOIN b32 USING (html)
""",
}

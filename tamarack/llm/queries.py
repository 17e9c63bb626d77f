"""One query for each corpus operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import chat_quotes, cross_polytope, near_dup, packing, quality, secret_scan, sentencepiece_sa, sharding, suffix_dedup, va_topk

#: Vocabulary files are parameters; these are the public ones that the environment offers.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return cross_polytope.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sentencepiece_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sa.encode_texts(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat_quotes.linked_conversations(_table(spark, sf_dir, "conversations"))
    return messages.select("conv_id", "turn", "role", "position", "reply_to", "n_quoted", "max_level", "n_linked", F.length("formatted").cast("long").alias("formatted_chars"), F.md5("formatted").alias("formatted_md5"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "n_judged", "least_base")


def op10_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return va_topk.top_products(vectors, vectors.where("vec_id % 20 = 0"), 20)


QUERIES = {f.__name__: f for f in (op1_cross_polytope_ann, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_vector_packing, op5_byte_shards, op6_sentencepiece_suffix_array, op7_quotation_linking, op8_quality_classifier, op9_secret_scan, op10_va_file_topk)}
ORACLES: dict[str, str] = {
    "op5_byte_shards": """
        WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step),
        b AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
                     list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
        r AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1]), 4294967295), 4294967295) AS text_crc32 FROM b, crc),
        p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY text_crc32, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, sum(size) OVER ()::BIGINT AS total, max(size) OVER () AS largest FROM r),
        g AS (SELECT *, count(*) OVER (PARTITION BY text_crc32, size) * size AS group_bytes, min(first) OVER (PARTITION BY text_crc32, size) AS group_first FROM p),
        m AS (SELECT *, CASE WHEN group_bytes * 40 <= 0.01 * total OR group_bytes <= largest THEN group_first * 2 + group_bytes ELSE first * 2 + size END AS middle FROM g),
        s AS (SELECT *, least(39, (middle * 40) // (2 * total))::INTEGER AS shard FROM m)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY text_crc32, size, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s""",
    "op7_quotation_linking": """
        WITH RECURSIVE m AS (SELECT row_number() OVER () AS message, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
        l AS (SELECT message, conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        k AS (SELECT *, regexp_extract(line, '^((?:[ \\t]*>)+)', 1) AS mark FROM l),
        n AS (SELECT message, conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) AS level,
                     lower(trim(regexp_replace(regexp_replace(substr(line, length(mark) + 1), '[\\x01\\x02]', '', 'g'), '[ \\t]+', ' ', 'g'))) AS said FROM k),
        b AS (SELECT *, CASE WHEN lag(level) OVER each IS DISTINCT FROM level OR lag(said) OVER each = '' THEN 1 ELSE 0 END AS begins FROM n WINDOW each AS (PARTITION BY message ORDER BY i)),
        p AS (SELECT * FROM (SELECT *, sum(begins) OVER (PARTITION BY message ORDER BY i) AS passage FROM b) WHERE said <> ''),
        g AS (SELECT message, conv_id, turn, level, passage, string_agg(said, chr(10) ORDER BY i) AS body, count(*) AS n FROM p GROUP BY message, conv_id, turn, level, passage),
        o AS (SELECT conv_id, said, min(turn) AS original FROM (SELECT conv_id, turn, body AS said FROM g WHERE level = 0 UNION ALL SELECT conv_id, turn, said FROM p WHERE level = 0) GROUP BY conv_id, said),
        w AS (SELECT g.*, o.original FROM g LEFT JOIN o ON o.conv_id = g.conv_id AND o.said = g.body AND o.original < g.turn WHERE g.level > 0),
        v AS (SELECT conv_id, turn, level, original, sum(n) AS votes FROM (SELECT conv_id, turn, level, original, n FROM w WHERE original IS NOT NULL
              UNION ALL SELECT p.conv_id, p.turn, p.level, o.original, 1 FROM w JOIN p ON p.message = w.message AND p.passage = w.passage JOIN o ON o.conv_id = p.conv_id AND o.said = p.said AND o.original < p.turn
              WHERE w.original IS NULL) GROUP BY conv_id, turn, level, original),
        r AS (SELECT conv_id, turn, original, votes::BIGINT AS votes FROM v
              QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, votes DESC, original DESC) = 1),
        up AS (SELECT conv_id, turn, original AS above FROM r
               UNION ALL SELECT up.conv_id, up.turn, r.original FROM up JOIN r ON r.conv_id = up.conv_id AND r.turn = up.above),
        root AS (SELECT conv_id, turn, min(above) AS root FROM up GROUP BY conv_id, turn),
        c AS (SELECT conv_id, turn, role, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*>'))) AS n_quoted,
                     coalesce(list_max(list_transform(lines, lambda x: length(regexp_replace(regexp_extract(x, '^((?:[ \\t]*>)+)', 1), '[^>]', '', 'g')))), 0) AS max_level,
                     '<|' || coalesce(role, '') || '|>' || chr(10)
                     || trim(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '^[ \\t]*>')), chr(10)), chr(10))
                     || chr(10) || '<|end|>' || chr(10) AS formatted FROM m)
        SELECT c.conv_id, c.turn, c.role,
               row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(root.root, c.turn) NULLS FIRST, c.turn NULLS FIRST, c.role NULLS FIRST, md5(formatted)) - 1 AS position,
               r.original AS reply_to, n_quoted::INTEGER AS n_quoted, max_level::INTEGER AS max_level, coalesce(r.votes, 0) AS n_linked,
               length(formatted) AS formatted_chars, md5(formatted) AS formatted_md5
        FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn LEFT JOIN root ON root.conv_id = c.conv_id AND root.turn = c.turn""",
    "op10_va_file_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.w) = len(q.w) WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}

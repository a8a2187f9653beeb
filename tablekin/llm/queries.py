"""The subpackage's registered queries: each takes (spark, sf_dir) and applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import table
from .ann import nearest_neighbours
from .language_id import identify_languages
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import pack
from .quality_forest import quality_rules, train_quality
from .sharding import shard_by_bytes
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .warc import page_archives


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_rules(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
}

def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 in SQL: its half bytes, the lower one first, are taken in one after the other."""
    bit = lambda x: f"xor({x} >> 1, 3988292384 * ({x} & 1))"
    halves = f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: [strpos('123456789ABCDEF', hexed[2 * i]), strpos('123456789ABCDEF', hexed[2 * i - 1])]::BIGINT[]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, n: {bit(bit(bit(bit('xor(c, n)'))))}), 4294967295)"


ORACLE = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT s.r, s.i, md5(array_to_string(d.w[s.i : s.i + 34], ' ')) AS g FROM s JOIN d ON s.r = d.r),
dup AS (SELECT r, i FROM h WHERE g IN (SELECT g FROM h GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM dup),
pos AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT pos.r, string_agg(pos.word, ' ' ORDER BY pos.p) AS t FROM pos ANTI JOIN gone ON pos.r = gone.r AND pos.p = gone.p GROUP BY pos.r),
n AS (SELECT r, count(*) AS c FROM gone GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r LEFT JOIN n ON d.r = n.r
""",
    "op2_warc_revisits": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM m
""",
    "op4_sharding": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, string_split(hex(encode(coalesce(text, ''))), '') AS hexed FROM documents),
c AS (SELECT doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, {_crc32_sql("t")} AS text_crc32, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS h FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY text_crc32, h, doc_id NULLS FIRST) AS n FROM c),
r AS (SELECT *, sum(size) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS run, sum(size) OVER () AS every FROM o),
s AS (SELECT *, CAST(((2 * run - size) * 40) // (2 * every) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
""",
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, text, coalesce('a' || source, 'b') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
q AS (SELECT *, greatest(size, 1)::DOUBLE AS nw, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::DOUBLE AS chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::DOUBLE AS symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, len(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))::DOUBLE AS words FROM (SELECT *, coalesce(text, '') AS t FROM d)),
f AS (SELECT doc_id, s, size, t, greatest(0.05::DOUBLE, greatest(0, least(1, (chars / nw - 1::DOUBLE) / 2::DOUBLE))::DOUBLE * (1::DOUBLE - greatest(0, least(1, (chars / nw - 10::DOUBLE) / 6::DOUBLE))::DOUBLE)
 * (1::DOUBLE - greatest(0, least(1, symbols / nw))::DOUBLE) * (len(list_distinct(lines))::DOUBLE / greatest(len(lines), 1)::DOUBLE) * greatest(0, least(1, (words / least(nw, 100::DOUBLE)) / 0.5::DOUBLE))::DOUBLE) AS weight FROM q),
k AS (SELECT doc_id, s, size, -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(t)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS key FROM f),
g AS (SELECT s, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w FROM d GROUP BY s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(2.0::DOUBLE * sum(source_size) OVER up, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS lv
 FROM g WINDOW up AS (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT s, source_size, least(2.0::DOUBLE * source_size, max(CASE WHEN lv <= 2.0::DOUBLE * source_size / w THEN lv END) OVER () * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, e.source_size, e.target, e.epochs, sum(k.size) OVER (PARTITION BY k.s ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) AS run FROM k JOIN e ON k.s = e.s)
SELECT doc_id, size, source_size, target,
CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND run - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
""",
}

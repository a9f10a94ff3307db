"""The registered queries of this subpackage, each over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spoor.llm import bpe, fingerprint, jaccard, language, mixing, packing, quality, repetition, rtree, secrets, sharding, spelling, substring
from spoor.llm.common import documents, tokenizer_path


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op2_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(documents(spark, sf_dir))


def op3_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op4_adaptive_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir))


def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(documents(spark, sf_dir)).drop("longest_repeat")


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(documents(spark, sf_dir))


def op8_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op11_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_packed_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_extendible_sharding,
        op2_linked_secrets,
        op3_language_ecoc,
        op4_adaptive_prefixes,
        op5_fingerprint_index,
        op6_suffix_repetition,
        op7_bottom_k,
        op8_quality_ftrl,
        op9_mixing,
        op10_bpe,
        op11_trie_pairs,
        op12_packed_rtree,
        op13_deficit_packing,
    )
}

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), v AS (SELECT d.*, CAST(t.depth AS BIGINT) AS depth, h >> (60 - t.depth) AS prefix FROM d, range(0, 61) t(depth)
), b AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM v GROUP BY ALL
), f AS (SELECT v.doc_id, min(depth) AS depth FROM v JOIN b USING (depth, prefix)
         WHERE shard_bytes <= {sharding.LIMIT} OR shard_docs = 1 GROUP BY v.doc_id)
SELECT v.doc_id, v.n_bytes,
       CASE WHEN v.depth = 0 THEN '' ELSE right(bin(v.prefix + (1::BIGINT << v.depth)), v.depth) END AS shard,
       CAST(v.depth AS INTEGER) AS depth, CAST(b.shard_bytes AS BIGINT) AS shard_bytes, b.shard_docs
FROM v JOIN f ON v.doc_id = f.doc_id AND v.depth = f.depth JOIN b ON b.depth = v.depth AND b.prefix = v.prefix
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)
), n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.size + y.size - common)
), v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, v.b FROM r JOIN v ON v.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.size), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), g AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN sha256(array_to_string(w[i:i+34], ' ')) END AS h FROM p
), c AS (SELECT doc_id, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS hit FROM g
), s AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS 34 PRECEDING) AS gone FROM c
), k AS (SELECT doc_id, sum(gone::INT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), g AS (
  SELECT doc_id, i, strlen(w[i]) AS bytes,
    CASE WHEN i + 2 <= len(w) THEN array_to_string(w[i:i+2], ' ') END AS g3,
    CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i+7], ' ') END AS g8,
    CASE WHEN i + 120 <= len(w) THEN md5(array_to_string(w[i:i+120], ' ')) END AS g121
  FROM p
), c AS (
  SELECT *, g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3,
            g8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g8) > 1 AS r8,
            g121 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g121) > 1 AS r121
  FROM g
), s AS (
  SELECT *, bool_or(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS in3,
            bool_or(r8) OVER (PARTITION BY doc_id ORDER BY i ROWS 7 PRECEDING) AS in8
  FROM c
), t AS (
  SELECT doc_id, sum(in3::INT) AS n3, sum(CASE WHEN in8 THEN bytes ELSE 0 END) AS b8, sum(bytes) AS b, bool_or(r121) AS long
  FROM s GROUP BY doc_id
), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), k AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), o AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n3, 0) AS BIGINT) AS n_repeat_words,
    coalesce(CAST(b8 AS DOUBLE) / CAST(b AS DOUBLE), 0.0) AS repeat_fraction, coalesce(long, false) AS long
  FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, repeat_fraction,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND repeat_fraction <= 0.4 AND NOT long AS kept
FROM o
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
    CAST(sum(size) AS DOUBLE) * 2.0::DOUBLE AS cap
  FROM d GROUP BY source
), total AS (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5::DOUBLE AS words, sum(weight) AS weights FROM s
), level(value, capped, over) AS (
  SELECT words / weights, CAST(0 AS HUGEINT), false FROM total
  UNION ALL
  SELECT CASE WHEN free > 0 AND n <> capped THEN (words - held) / free ELSE value END, n, free = 0 OR n = capped
  FROM (
    SELECT value, capped, words, sum(CASE WHEN weight * value >= cap THEN cap ELSE 0 END) AS held,
      sum(CASE WHEN weight * value >= cap THEN 0 ELSE weight END) AS free, CAST(sum(CASE WHEN weight * value >= cap THEN 1 ELSE 0 END) AS HUGEINT) AS n
    FROM level, s, total WHERE NOT over GROUP BY value, capped, words
  )
), w AS (SELECT source, source_size, least(cap, weight * (SELECT max(value) FROM level)) AS target FROM s
), e AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM w
), p AS (
  SELECT d.*, source_size, target, epochs, budget - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) - size AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM p
"""

# The checksum of document and run is worked out byte by byte, with the usual table of 256 remainders. A pair of words one letter apart shares what is
# left of both when a letter is left out at the same place (replaced), or one word is the other without a letter.
OP11_SQL = r"""
WITH RECURSIVE table_of(b, k, c) AS (
  SELECT range, 0, range FROM range(0, 256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_of WHERE k < 8
), t AS (SELECT list(c ORDER BY b) AS crc FROM table_of WHERE k = 8
), r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL
), x AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM r
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::BIGINT)),
    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM x, t
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
), v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), s AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v
), d AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM s
), p AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.a || d.b
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.a || d.b
), f AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -near_n, near := near)) AS best FROM p GROUP BY word
), o AS (
  SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * v.n THEN best.near END AS form, CASE WHEN -best.m >= 2 * v.n THEN -best.m END AS form_n
  FROM v LEFT JOIN f ON f.word = v.word
), chain(word, root) AS (SELECT word, word FROM o UNION SELECT c.word, o.form FROM chain c JOIN o ON o.word = c.root WHERE o.form IS NOT NULL
), e AS (SELECT c.word, c.root FROM chain c JOIN o ON o.word = c.root WHERE o.form IS NULL)
SELECT o.word, o.form, e.root, o.n, CAST(o.n_near AS BIGINT) AS n_near, CAST(o.form_n AS BIGINT) AS form_n FROM o JOIN e ON e.word = o.word
"""

OP12_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""

ORACLE_SQL = {"op11_trie_pairs": OP11_SQL, "op12_packed_rtree": OP12_SQL, "op1_extendible_sharding": OP1_SQL, "op4_adaptive_prefixes": OP4_SQL, "op5_fingerprint_index": OP5_SQL, "op6_suffix_repetition": OP6_SQL, "op9_mixing": OP9_SQL}

"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, chat, collocations, langid, merkle, mixing, packing, pii, rules, simhash, tokencount, topk, warc
from .common import scratch, small_batches, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), scratch(spark, "warc"), roll_bytes=8 << 20, shard_bytes=32 << 20)
    return warc.read_archive(spark, archive, with_payload=False).drop("url", "payload")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("predicted.lang").alias("lang_pred"), F.col("predicted.score").alias("score"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", boilerplate.extract("html").alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allotment(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rules.assess(docs, rules.learn_from(docs, table(spark, sf_dir, "labels")))
    stats = (F.col("stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return found.select("doc_id", *stats, "base_failed", "kept", "rule")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", F.coalesce(tampered, F.col("text")))
    return merkle.proven(rows, "doc_id")


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.report(chat.windows(given.unionByName(added)))


def _on_texts(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _on_texts(f) for f in (op1_warc, op2_language_id, op3_token_counts, op4_html_extraction, op5_pii, op6_exact_top_k, op7_packing, op8_mix_sources, op9_quality_rules, op10_simhash_near_dedup, op11_collocations, op12_merkle_manifest, op13_chat_windows)}


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
named AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM hashed)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((k // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to
FROM named
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 5
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, (row_number() OVER (ORDER BY (source IS NULL), source) - 1) AS nth FROM per
), weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 3 * source_size AS cap FROM named
), sums AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - cap_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS level FROM sums
), shared AS (
  SELECT *, (SELECT arg_min(level, (cap::DOUBLE / weight, nth)) FROM levels WHERE cap > weight * level) AS rest FROM levels
), rates AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap::DOUBLE ELSE weight * rest END AS target FROM shared
), drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('17:' || d.doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM drawn
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), said AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM said
), four AS (
  SELECT lang, word AS w1, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4 FROM placed WINDOW p AS (PARTITION BY piece ORDER BY i)
), phrases AS (
  SELECT lang, w1 AS phrase, 1 AS k FROM four UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM four WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), 3 FROM four WHERE w3 IS NOT NULL UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3, w4), 4 FROM four WHERE w4 IS NOT NULL
), counts AS (
  SELECT lang, phrase, k, count(*) AS f FROM phrases GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), often AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT s.lang, s.phrase, s.k, s.a, c.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * s.a) // (l.f + r.f) AS score
  FROM often s JOIN range(1, 4) c(cut) ON c.cut < s.k
  JOIN counts l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:c.cut], ' ') JOIN counts r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[c.cut + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
  SELECT s.lang, array_to_string(s.w[i:i + m - 1], ' ') AS phrase, max(s.a) AS longer FROM often s JOIN range(2, 4) m(m) ON m.m < s.k JOIN range(1, 4) i(i) ON i.i + m.m - 1 <= s.k GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

OP12_SQL = r"""
WITH RECURSIVE given AS (
  SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS tampered
  FROM documents
), bits AS (
  -- crc32 of the decimal doc_id, a bit at a time
  SELECT doc_id, doc_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS crc FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, i + 1, list_reduce(list_prepend(xor(crc, ascii(s[i + 1])::BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)
  FROM bits WHERE i < length(s)
), odd AS (
  SELECT doc_id FROM bits WHERE i = length(s) AND crc & 1 = 0 GROUP BY doc_id
), leaves AS (
  SELECT *, coalesce(strlen(source) || ':' || source, '-') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM (SELECT g.doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN o.doc_id IS NOT NULL THEN body ELSE tampered END) AS used FROM given g LEFT JOIN odd o ON g.doc_id = o.doc_id)
), trees AS (
  SELECT g, 0 AS level, place, leaf AS node FROM leaves
  UNION ALL
  SELECT g, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM trees) WHERE n > 1 GROUP BY g, level, place // 3
), sub AS (
  SELECT *, row_number() OVER (ORDER BY g = '-' DESC, substr(g, instr(g, ':') + 1)) - 1 AS nth
  FROM (SELECT g, node AS subroot, level AS height FROM trees QUALIFY level = max(level) OVER (PARTITION BY g))
), top AS (
  SELECT 0 AS level, nth AS place, subroot AS node FROM sub
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, place // 3
), every AS (
  SELECT * FROM trees UNION ALL SELECT '', level, place, node FROM top
), height AS (
  SELECT max(level) AS level FROM top
), folds AS (
  SELECT l.g, l.place AS leaf_place, l.g AS tree, 0 AS level, l.place, l.used AS node, '' AS proof, s.height, s.nth FROM leaves l JOIN sub s USING (g)
  UNION ALL
  SELECT f.g, f.leaf_place, CASE WHEN f.level = f.height AND f.tree != '' THEN '' ELSE f.tree END,
    CASE WHEN f.level = f.height AND f.tree != '' THEN 0 ELSE f.level + 1 END, CASE WHEN f.level = f.height AND f.tree != '' THEN f.nth ELSE f.place // 3 END,
    CASE WHEN f.level = f.height AND f.tree != '' THEN f.node ELSE sha256(concat(a.node, b.node, f.node, c.node, d.node)) END,
    CASE WHEN f.level = f.height AND f.tree != '' THEN f.proof ELSE concat(f.proof, a.node, b.node, c.node, d.node) END,
    CASE WHEN f.level = f.height AND f.tree != '' THEN (SELECT level FROM height) ELSE f.height END, f.nth
  FROM folds f
  LEFT JOIN every a ON a.g = f.tree AND a.level = f.level AND a.place = f.place - 2 AND f.place % 3 = 2
  LEFT JOIN every b ON b.g = f.tree AND b.level = f.level AND b.place = f.place - 1 AND f.place % 3 > 0
  LEFT JOIN every c ON c.g = f.tree AND c.level = f.level AND c.place = f.place + 1 AND f.place % 3 < 2
  LEFT JOIN every d ON d.g = f.tree AND d.level = f.level AND d.place = f.place + 2 AND f.place % 3 = 0
  WHERE f.tree != '' OR f.level < f.height
)
SELECT l.doc_id, l.leaf, s.subroot, t.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM folds f JOIN leaves l ON l.g = f.g AND l.place = f.leaf_place JOIN sub s ON s.g = l.g JOIN top t ON t.level = (SELECT level FROM height)
WHERE f.tree = '' AND f.level = f.height
"""

#: For conversations of at most 256 turns, which are one chapter.
OP13_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) + 4 AS tokens,
    list_sum(list_transform([role, text], lambda x: length(x) + length(x) - length(replace(x, '\', ''))
      + length(x) - length(replace(x, '#', '')) - len(regexp_extract_all(x, '#+')) + (length(x) - length(replace(x, '</', ''))) // 2)) + 17 AS chars
  FROM given
), t AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) - tokens AS before, count(*) OVER (PARTITION BY conv_id) AS n,
    max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led,
    max(CASE WHEN i = 0 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS led_tokens,
    max(CASE WHEN i = 0 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS led_chars
  FROM sized
), dealt AS (
  SELECT conv_id, i, i AS s, before AS base, 1 AS k FROM t WHERE i = led
  UNION ALL
  SELECT t.conv_id, t.i, CASE WHEN opens THEN t.i ELSE s END, CASE WHEN opens THEN before ELSE base END, CASE WHEN opens THEN k + 1 ELSE k END
  FROM (SELECT t.*, d.s, d.base, d.k, before + tokens - base > 1024 - led_tokens - CASE WHEN k = 1 THEN 0 ELSE 256 END AS opens FROM dealt d JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i + 1) t
), spans AS (
  SELECT d.conv_id, d.s, max(d.i) AS last, min(base) AS base, least(256, greatest(0, 1024 - max(led_tokens) - sum(tokens))) AS allowed, max(led_chars) AS led_chars, max(led) AS led
  FROM dealt d JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i GROUP BY d.conv_id, d.s
), formatted AS (
  SELECT s.conv_id, s.s, max(led_chars) AS led_chars, (SELECT sum(chars) FROM t WHERE t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i <= s.last AND (t.i >= s.s OR t.i >= greatest(s.led, s.s - 2) AND s.base - t.before <= s.allowed)) AS chars
  FROM spans s GROUP BY ALL
), totals AS (
  SELECT conv_id, sum(led_chars + chars) AS chars, count(*) AS n_windows FROM formatted GROUP BY conv_id
)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(max(x.chars), max(t.led_chars))::BIGINT AS formatted_chars, coalesce(max(x.n_windows), 1)::BIGINT AS n_windows
FROM t LEFT JOIN totals x ON x.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op6_exact_top_k": OP6_SQL, "op8_mix_sources": OP8_SQL, "op11_collocations": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_chat_windows": OP13_SQL}

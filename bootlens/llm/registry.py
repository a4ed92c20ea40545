"""Queries of the numbered operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from bootlens.llm import bpe, conversations, embed_dedup, hard_negatives, langid, mixing, quality_mil, quality_rules, secret_scan, simhash, token_store, url_filter, warc
from bootlens.llm.common import table

#: Installed vocabulary file of the public tokenizers package; any other path can be given to the operators.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: The URL rules of the production filter.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
SHINGLE, SHINGLE_SEED, MAX_BITS = 3, 42, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op2_embedding_near_dup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_token_store(spark, sf_dir):
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=SHINGLE, seed=SHINGLE_SEED, max_bits=MAX_BITS)


def op9_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), is_anchor=F.col("id") % 100 == 0, label=label)


def op12_conversation_repair(spark, sf_dir):
    return conversations.audit(table(spark, sf_dir, "conversations"))


def op13_quality_classifier(spark, sf_dir):
    return quality_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_embedding_near_dup, op3_token_store, op4_mixing, op5_url_filter, op6_language_id,
                                   op7_secret_scan, op8_simhash, op9_quality_rules, op10_warc,
                                   op11_hard_negatives, op12_conversation_repair, op13_quality_classifier,
                                   pipeline)}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op2_embedding_near_dup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT vec_id, x FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.b, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.b, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
""",
    "op4_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
), k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
            / greatest(CAST(0.1 AS DOUBLE), least(CAST(1 AS DOUBLE), size / CAST(50 AS DOUBLE))) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM k GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w, ss * CAST(2 AS DOUBLE) AS cap,
         CAST(1.5 AS DOUBLE) * sum(ss) OVER () AS goal FROM s
), o AS (
  SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate, cap / w AS turn FROM w
), t AS (
  SELECT source, ss, least(cap, (SELECT arg_min(rate, turn) FROM o WHERE rate * w <= cap) * w) AS target FROM o
), b AS (
  SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS epochs FROM t
), u AS (
  SELECT k.source, k.key, k.size, CAST(count(*) * k.size AS BIGINT) AS total FROM k GROUP BY k.source, k.key, k.size
), rounds AS (
  SELECT source, target, 0 AS n, CAST(-1 AS DOUBLE) AS lk, CAST(-1 AS BIGINT) AS ls, CAST('inf' AS DOUBLE) AS longest, CAST(NULL AS DOUBLE) AS hk, CAST(NULL AS BIGINT) AS hs,
         CAST(target - epochs * ss AS DOUBLE) AS gap, CAST(-1 AS DOUBLE) AS nk, CAST(-1 AS BIGINT) AS ns, CAST('inf' AS DOUBLE) AS most FROM b
  UNION ALL
  SELECT source, target, n + 1, nk, ns, most, hi.key, hi.size, gap - filled, blocked.key, blocked.size, (gap - filled) / 2
  FROM (
    SELECT source, any_value(target) AS target, any_value(n) AS n, any_value(nk) AS nk, any_value(ns) AS ns, any_value(most) AS most, any_value(gap) AS gap,
           max({{'key': key, 'size': size}}) FILTER (fin <= gap) AS hi, coalesce(max(fin) FILTER (fin <= gap), 0) AS filled, min({{'key': key, 'size': size}}) FILTER (fin > gap) AS blocked
    FROM (
      SELECT r.*, u.key, u.size, sum(u.total) OVER (PARTITION BY r.source ORDER BY u.key, u.size) AS fin
      FROM rounds r JOIN u ON u.source IS NOT DISTINCT FROM r.source AND (u.key > r.nk OR (u.key = r.nk AND u.size > r.ns)) AND u.size <= r.most
      WHERE r.nk IS NOT NULL AND (r.n = 0 OR r.gap > {mixing.NEAR} * r.target))
    GROUP BY source)
), c AS (
  SELECT source, arg_min(gap, -n) AS gap FROM rounds GROUP BY source
), drawn AS (
  SELECT DISTINCT u.source, u.key, u.size FROM u JOIN rounds r ON u.source IS NOT DISTINCT FROM r.source AND (u.key > r.lk OR (u.key = r.lk AND u.size > r.ls))
    AND (u.key < r.hk OR (u.key = r.hk AND u.size <= r.hs)) AND u.size <= r.longest
), f AS (
  SELECT u.source, u.key, u.size FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source
  WHERE abs(c.gap - u.total) < c.gap AND NOT EXISTS (SELECT 1 FROM drawn d WHERE d.source IS NOT DISTINCT FROM u.source AND d.key = u.key AND d.size = u.size)
  QUALIFY row_number() OVER (PARTITION BY u.source ORDER BY abs(c.gap - u.total), u.key, u.size) = 1
), once AS (SELECT * FROM drawn UNION SELECT * FROM f)
SELECT k.doc_id, k.size, b.ss AS source_size, b.target, CAST(k.size * (b.epochs + CASE WHEN once.key IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source LEFT JOIN once ON once.source IS NOT DISTINCT FROM k.source AND once.key = k.key AND once.size = k.size
""",
    "op9_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), a AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM rep, (VALUES (0), (1), (2)) x(j)) GROUP BY doc_id
), m AS (
  SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)}))) AS BIGINT) AS n_stop
  FROM a LEFT JOIN cov USING (doc_id)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND n_words >= 50 AND n_repeat_words <= 0.5 * n_words AND word_chars BETWEEN 2 * n_words AND 12 * n_words
  AND n_symbols <= 0.15 * word_chars AND n_stop >= 0.01 * n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM m
""",
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, upper(sha1(b)) AS hex FROM p),
q AS (
  SELECT page_id, first, octet_length(b) AS n,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS digest
  FROM h
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), v1 AS (
  SELECT DISTINCT * FROM v
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id AS id, b.label, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v1 a JOIN v1 b ON a.vec_id % 100 = 0 AND len(a.x) = len(b.x)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = al AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE label <> al AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), y AS (
  SELECT x.*, xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT)),
                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM x, crc
), z AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END)
  FROM y WHERE code <> 0
), p AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM z
), r AS (
  SELECT *, substr(role, 1, 1) AS mark, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev,
         CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM p
), stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (prev IS NOT NULL AND prev || mark NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), ins(q, q2, own, lines) AS (
  VALUES (0, 0, '', ''), (0, 2, 'I', 'user:' || chr(10)), (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
         (1, 1, '', ''), (1, 2, 'I', 'user:' || chr(10)), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
         (2, 2, '', ''), (2, 3, 'I', 'assistant:' || chr(10)), (2, 2, 'II', 'assistant:' || chr(10) || 'user:' || chr(10)),
         (3, 3, '', ''), (3, 2, 'I', 'user:' || chr(10)), (3, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))
), ed(q, letter, mark, q2, role) AS (
  VALUES (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL),
         (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (3, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL),
         (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user')
), dp(conv_id, i, q, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'out': ''} FROM stats
  UNION ALL
  SELECT d.conv_id, d.i + 1, ed.q2, min({'cost': d.best.cost + CAST(3 * length(ins.own) + CASE ed.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
                   + CASE WHEN ed.letter <> 'D' AND r.fault IS NOT NULL THEN 3 ELSE 0 END AS BIGINT),
              'audit': d.best.audit || ins.own || ed.letter,
              'out': d.best.out || ins.lines || CASE WHEN ed.letter = 'D' THEN '' ELSE coalesce(ed.role, r.role) || ':' || r.text || chr(10) END})
  FROM dp d JOIN ins ON ins.q = d.q JOIN ed ON ed.q = ins.q2 JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.pos = d.i + 1
  WHERE ed.letter = 'D' OR (coalesce(r.fault, 'truncated') = 'truncated' AND (ed.letter = 'R' OR ed.mark = r.mark))
  GROUP BY d.conv_id, d.i, ed.q2
), done AS (
  SELECT d.conv_id, min({'cost': d.best.cost + CAST(3 * length(ins.own) AS BIGINT), 'audit': d.best.audit || ins.own, 'out': d.best.out || ins.lines}) AS best
  FROM dp d JOIN stats s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.n = d.i JOIN ins ON ins.q = d.q AND ins.q2 IN (0, 3)
  GROUP BY d.conv_id
)
SELECT o.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
       coalesce(s.illegal, 0) AS illegal, coalesce(d.best.cost, 0) AS cost, coalesce(d.best.audit, '') AS audit,
       sha256(CASE WHEN coalesce(d.best.out, '') = '' THEN '' ELSE left(d.best.out, length(d.best.out) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
""",
}

"""The corpus queries that SQL can state, for another engine (DuckDB dialect)."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLAIN_WORDS = "regexp_extract_all(" + LOWER + r", '[^\x20\x09-\x0D]+')"
DIGITS = "'0123456789ABCDEF'"

CHAT = r"""WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
  sized AS (SELECT *, 8 + length(role)
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id"""

#: The same conversations through JSON records: what came in must come out.
RECORDS = CHAT.replace("UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)", "")

CONTAMINATION = f"""WITH docs AS (SELECT doc_id, {ALNUM_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  items AS (SELECT item_id, {ALNUM_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
    SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(len(w), 10) AS size FROM items WHERE len(w) > 0))),
  grams AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
    SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows))),
  hits AS (SELECT doc_id, i, size, item_id FROM grams JOIN windows USING (size, gram)),
  places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
  found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)"""

_BIT = "(substr(bits, 5 * i + {0}, 1) = '1')::INTEGER * {1}"
_FIVE = " + ".join(_BIT.format(k + 1, 16 >> k) for k in range(5))
ARCHIVE = f"""WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
  digests AS (SELECT page_id, octet_length(data) AS payload_bytes, array_to_string(list_transform(
      string_split(upper(sha1(data)), ''), lambda h: lpad(bin(position(h IN {DIGITS}) - 1), 4, '0')), '') AS bits,
    min(page_id) OVER (PARTITION BY data) AS first FROM payloads)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM digests"""

COMPONENTS = f"""WITH RECURSIVE docs AS (SELECT doc_id, {PLAIN_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  classes AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY set) AS class_id FROM (
    SELECT doc_id, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS set FROM shingles GROUP BY doc_id)),
  own AS (SELECT s.* FROM shingles s JOIN classes c ON s.doc_id = c.doc_id AND c.doc_id = c.class_id),
  links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
      FROM own x JOIN own y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * common >= 80 * (m.n + n.n - common)),
  reach AS (SELECT DISTINCT class_id AS a, class_id AS b FROM classes
    UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
  roots AS (SELECT a AS class_id, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(class_id, d.doc_id) AS class_id
FROM docs d LEFT JOIN classes USING (doc_id) LEFT JOIN roots USING (class_id)"""

NEGATIVES = """WITH whole AS MATERIALIZED (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scores AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM whole a, whole r WHERE a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
  positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""

STATEMENTS = {"op1_chat_format": CHAT, "op2_decontaminate": CONTAMINATION, "op3_warc": ARCHIVE, "op10_jaccard_join": COMPONENTS,
              "op12_hard_negatives": NEGATIVES, "chat_records": RECORDS}

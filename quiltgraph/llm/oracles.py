"""DuckDB SQL of the queries that SQL can express."""

OP4 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cut AS (SELECT item_id, w, CAST(least(len(w), 13) AS BIGINT) AS size FROM items WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS phrase FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM cut)),
sizes AS (SELECT DISTINCT size FROM phrases),
windows AS (SELECT rid, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS phrase FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT rid, k, windows.size, item_id FROM windows JOIN phrases ON windows.size = phrases.size AND windows.phrase = phrases.phrase),
hit_words AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS place FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

OP8 = r"""
WITH lines AS (SELECT rid, doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM (SELECT row_number() OVER () AS rid, * FROM documents)),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counted AS (SELECT source, line, count(DISTINCT rid) AS with_line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
dropped AS (SELECT counted.source AS source, counted.line AS line, 1 AS gone FROM counted JOIN totals ON counted.source IS NOT DISTINCT FROM totals.source WHERE with_line >= 5 AND with_line > 0.1::DOUBLE * pages)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(lines.line, chr(10) ORDER BY k) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN dropped ON lines.source IS NOT DISTINCT FROM dropped.source AND lines.line = dropped.line GROUP BY rid, doc_id
"""

OP9 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, doc_id, k, md5(array_to_string(list_slice(w, k, k + 19), ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM docs WHERE len(w) >= 20)),
firsts AS (SELECT h, min((doc_id, k)) AS earliest FROM windows GROUP BY h),
gone AS (SELECT DISTINCT rid, unnest(range(k, k + 20)) AS place FROM windows JOIN firsts USING (h) WHERE (doc_id, k) <> earliest),
placed AS (SELECT rid, doc_id, w[k] AS word, k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM docs)),
kept AS (SELECT placed.rid AS rid, string_agg(word, ' ' ORDER BY k) AS text FROM placed LEFT JOIN gone ON placed.rid = gone.rid AND placed.k = gone.place WHERE gone.place IS NULL GROUP BY placed.rid),
counted AS (SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (rid) LEFT JOIN counted USING (rid)
"""

OP2 = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(role) + length(text) + 22
  + (length(role || text) - length(replace(role || text, '\', '')))
  + len(regexp_extract_all(role, '[<\[](\|turn\|>|\|sep\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)'))
  + len(regexp_extract_all(text, '[<\[](\|turn\|>|\|sep\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: Every row goes one bit deeper as long as the rows that share its bits are over the limit of a shard.
OP3 = """WITH RECURSIVE keyed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, lpad(bin(CAST('0x' || substr(md5(coalesce('=' || CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT)), 64, '0') AS bits FROM documents),
buckets AS (
  SELECT doc_id, n_bytes, bits, 0 AS depth, sum(n_bytes) OVER () AS bytes, count(*) OVER () AS n FROM keyed
  UNION ALL
  SELECT doc_id, n_bytes, bits, depth + 1, sum(n_bytes) OVER (PARTITION BY substr(bits, 1, depth + 1)), count(*) OVER (PARTITION BY substr(bits, 1, depth + 1))
  FROM buckets WHERE bytes > {limit} AND n > 1 AND depth < 64)
SELECT doc_id, n_bytes, substr(bits, 1, depth) AS shard, CAST(depth AS BIGINT) AS depth FROM buckets WHERE bytes <= {limit} OR n = 1 OR depth = 64"""

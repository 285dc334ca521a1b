"""DuckDB SQL over the raw tables, for the queries that SQL can state.

Lists and windows stand in for the operators' own methods; nothing is shared with them.
"""

CHAT_FORMATTING = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
said AS (
  SELECT conv_id, turn, role, text,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS role_chars,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars
  FROM rows),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(role_chars + text_chars + length('<|im_start|>') + length('<|im_end|>') + 2) AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
           ELSE array_to_string(words[i : i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS node FROM d
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.node) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text FROM d),
one AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
three AS (
  SELECT rid, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3
  FROM one WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) > 1 AS again
  FROM three WHERE w3 IS NOT NULL),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) WHERE again GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.rid, d.doc_id, d.source, CAST(len(w.words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS bad FROM f GROUP BY source),
p AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS spread FROM h),
s AS (
  SELECT source, CASE WHEN spread > 0 THEN
           (bad + mean * greatest(mean * (1 - mean) / spread - 1, 0))
           / (n + greatest(mean * (1 - mean) / spread - 1, 0)) ELSE mean END AS rate
  FROM h, p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND s.rate <= 0.5 AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""

URL_FILTERS = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
hits AS (
  SELECT rid, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM c LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (rid)
"""

SOURCE_MIXING = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS BIGINT) AS weight FROM p),
a AS (SELECT sum(source_size) AS words, sum(weight) AS weights FROM w),
-- the sources that stop at three times their size are those that fill up first
b AS (
  SELECT source, 3 * source_size AS lim, weight,
         coalesce(sum(3 * source_size) OVER o, 0) AS lim_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT b.*, (words - lim_before) * weight > lim * (weights - weight_before) AS is_full FROM b, a),
z AS (SELECT words - coalesce(sum(lim) FILTER (is_full), 0) AS words_left,
             weights - coalesce(sum(weight) FILTER (is_full), 0) AS weights_left
      FROM c, a GROUP BY words, weights),
t AS (
  SELECT w.source, place, w.source_size,
         CASE WHEN is_full THEN CAST(lim AS DOUBLE)
              ELSE CAST(words_left AS DOUBLE) * w.weight / CAST(weights_left AS DOUBLE) END AS target
  FROM w JOIN c ON w.source IS NOT DISTINCT FROM c.source, z),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN
              least(CAST(floor(target / source_size * 4294967296.0) AS BIGINT), 12884901888) ELSE 0 END AS step,
         CAST('0x' || substr(md5('mix:' || place), 1, 8) AS BIGINT) AS start
  FROM t),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS FIRST) AS k FROM d)
SELECT doc_id, size, u.source_size, target,
       CAST(size * (((k * step + start) >> 32) - (((k - 1) * step + start) >> 32)) AS BIGINT) AS taken
FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source
"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS mark
  FROM conversations),
crc AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(mark, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
        lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))),
      4294967295::BIGINT) % 20 AS fault
  FROM raw),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS again
  FROM crc WHERE fault != 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i FROM hurt),
faulty AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS ini,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed),
counted AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
-- from the last row to the first: per state (0 nothing, 1 system, 2 user, 3 assistant) the cheapest rest, then the least
rest AS (
  SELECT conv_id, max(i) + 1 AS i,
         {'c': 0::BIGINT, 'a': '', 'r': ''} AS s0, {'c': 4::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s1,
         {'c': 2::BIGINT, 'a': 'I', 'r': chr(10) || 'assistant:'} AS s2, {'c': 0::BIGINT, 'a': '', 'r': ''} AS s3
  FROM faulty GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i,
         list_min([n0, {'c': n2.c + 2, 'a': 'I' || n2.a, 'r': chr(10) || 'user:' || n2.r},
                   {'c': n3.c + 4, 'a': 'II' || n3.a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || n3.r}]),
         list_min([n1, {'c': n2.c + 2, 'a': 'I' || n2.a, 'r': chr(10) || 'user:' || n2.r},
                   {'c': n3.c + 4, 'a': 'II' || n3.a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || n3.r}]),
         list_min([n2, {'c': n3.c + 2, 'a': 'I' || n3.a, 'r': chr(10) || 'assistant:' || n3.r}]),
         list_min([n3, {'c': n2.c + 2, 'a': 'I' || n2.a, 'r': chr(10) || 'user:' || n2.r}])
  FROM (
    SELECT f.conv_id, f.i,
           list_min([{'c': s0.c + 3, 'a': 'D' || s0.a, 'r': s0.r},
                     {'c': s1.c + late + CASE WHEN ini = 's' THEN 0 ELSE 1000000000 END, 'a': 'K' || s1.a, 'r': line || s1.r},
                     {'c': s2.c + late + CASE WHEN ini = 'u' THEN 0 ELSE 1000000000 END, 'a': 'K' || s2.a, 'r': line || s2.r},
                     {'c': s2.c + late + 2, 'a': 'R' || s2.a, 'r': chr(10) || 'user:' || text || s2.r}]) AS n0,
           list_min([{'c': s1.c + 3, 'a': 'D' || s1.a, 'r': s1.r},
                     {'c': s2.c + late + CASE WHEN ini = 'u' THEN 0 ELSE 1000000000 END, 'a': 'K' || s2.a, 'r': line || s2.r},
                     {'c': s2.c + late + 2, 'a': 'R' || s2.a, 'r': chr(10) || 'user:' || text || s2.r}]) AS n1,
           list_min([{'c': s2.c + 3, 'a': 'D' || s2.a, 'r': s2.r},
                     {'c': s3.c + late + CASE WHEN ini = 'a' THEN 0 ELSE 1000000000 END, 'a': 'K' || s3.a, 'r': line || s3.r},
                     {'c': s3.c + late + 2, 'a': 'R' || s3.a, 'r': chr(10) || 'assistant:' || text || s3.r}]) AS n2,
           list_min([{'c': s3.c + 3, 'a': 'D' || s3.a, 'r': s3.r},
                     {'c': s2.c + late + CASE WHEN ini = 'u' THEN 0 ELSE 1000000000 END, 'a': 'K' || s2.a, 'r': line || s2.r},
                     {'c': s2.c + late + 2, 'a': 'R' || s2.a, 'r': chr(10) || 'user:' || text || s2.r}]) AS n3
    FROM rest JOIN (
      SELECT *, chr(10) || role || ':' || text AS line,
             CASE fault WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 WHEN 'truncated' THEN 1 ELSE 0 END AS late
      FROM faulty) f ON f.conv_id IS NOT DISTINCT FROM rest.conv_id AND f.i = rest.i - 1))
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(rest.s0.c, 0) AS BIGINT) AS cost,
       coalesce(rest.s0.a, '') AS audit, sha256(substr(coalesce(rest.s0.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN rest ON rest.conv_id IS NOT DISTINCT FROM o.conv_id AND rest.i = 1
"""

HARD_NEGATIVES = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid != b.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same)
  WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id NULLS LAST) AS k
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS "rank", negative_id, positive_score, negative_score
FROM n WHERE k <= 10
"""

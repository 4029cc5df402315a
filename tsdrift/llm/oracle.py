"""DuckDB statements for the corpus queries SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# one row per row of documents (r), with every measurement of the quality rules
_MEASURES = rf"""
base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT r, i, w[i:i+4] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM base)),
hits AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM hits) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '\P{{L}}+', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaim
  FROM base LEFT JOIN covered c USING (r)),
ledger AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * word_chars < 5 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper > n_letters THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_exclaim > 3 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM measured)"""

QUALITY = f"""WITH {_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM ledger"""

ABLATION = f"""WITH {_MEASURES},
policies(policy, hard, soft) AS (VALUES ('base', 3, 0), ('strict', 255, 0), ('production', 79, 176)),
rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8),
  ('word_length', 16), ('capitals', 32), ('exclamations', 64), ('few_letters', 128)),
cases AS (
  SELECT policy, rule, n_words, (fail_bits & bit) <> 0 AS fails, (fail_bits & (hard | soft)) = 0 AS kept,
         (fail_bits & (hard | soft) & ~bit) = 0 AS kept_without
  FROM ledger, policies, rules WHERE ((hard | soft) & bit) <> 0)
SELECT policy, rule, count(*) FILTER (fails) AS docs_failing, count(*) FILTER (kept) AS docs_kept,
       count(*) FILTER (NOT kept AND kept_without) AS docs_gained,
       coalesce(sum(n_words) FILTER (NOT kept AND kept_without), 0)::BIGINT AS words_gained
FROM cases GROUP BY policy, rule"""

PREFERENCE = r"""WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
ordered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM turns),
lasts AS (SELECT conv_id, max(i) FILTER (role = 'assistant') AS last FROM ordered GROUP BY conv_id),
partners AS (
  SELECT o.conv_id - 1 AS conv_id, role, text FROM ordered o JOIN lasts l ON o.conv_id = l.conv_id AND o.i = l.last),
rejected AS (
  SELECT o.conv_id, o.i, o.role, o.text FROM ordered o JOIN lasts l USING (conv_id)
  WHERE o.i < l.last AND o.conv_id IN (SELECT conv_id FROM partners)
  UNION ALL
  SELECT p.conv_id, l.last, p.role, p.text FROM partners p JOIN lasts l USING (conv_id) WHERE l.last IS NOT NULL),
compared AS (
  SELECT conv_id, i, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
  FROM ordered c FULL JOIN rejected r USING (conv_id, i)),
cut AS (
  SELECT conv_id, coalesce(min(i) FILTER (c_role IS DISTINCT FROM r_role OR c_text IS DISTINCT FROM r_text) - 1, max(i))
         AS n FROM compared GROUP BY conv_id),
sides AS (
  SELECT 'c' AS side, conv_id, i, role, text FROM ordered UNION ALL SELECT 'r', conv_id, i, role, text FROM rejected),
parts AS (
  SELECT side, conv_id, i, n, role, '<|' || replace(role, '|', '') || '|>' || chr(10) || replace(text, '<|', '< |')
         || '<|end|>' || chr(10) AS body FROM sides JOIN cut USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY side, conv_id, i > n ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM parts),
joined AS (
  SELECT conv_id, any_value(n)::BIGINT AS prefix_turns,
    coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND i <= n), '') AS prompt,
    coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen,
    coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected,
    coalesce(string_agg((pos + length(role) + 5) || '-' || (pos + length(body) - 1), ',' ORDER BY i)
      FILTER (side = 'c' AND i > n AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((pos + length(role) + 5) || '-' || (pos + length(body) - 1), ',' ORDER BY i)
      FILTER (side = 'r' AND i > n AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY conv_id)
SELECT conv_id AS pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask FROM joined"""

LINE_DEDUP = r"""WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
texts AS (SELECT DISTINCT source, text FROM documents),
lines AS (
  SELECT source, unnest(list_distinct(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)),
    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')), lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))))) AS line
  FROM texts),
totals AS (SELECT source, count(*) AS n FROM texts GROUP BY source),
bad AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(*) AS c FROM lines GROUP BY ALL) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE c >= 5 AND c > n * 0.01),
lists AS (SELECT source, list(line) AS ls FROM bad GROUP BY source),
done AS (
  SELECT p.doc_id, p.source, p.text, string_split(p.text, chr(10)) AS a,
    list_filter(string_split(p.text, chr(10)), lambda x: NOT list_contains(coalesce(b.ls, []),
      trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)))) AS k
  FROM pages p LEFT JOIN lists b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN len(k) < len(a) THEN array_to_string(k, chr(10)) ELSE text END AS text,
       coalesce(len(a) - len(k), 0)::BIGINT AS dropped_lines FROM done"""

_UNIT = "('0x' || substr(md5({}), 1, 15))::BIGINT"
MIXING = rf"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight,
           source_size * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ranked WINDOW o AS (ORDER BY cap / weight, source NULLS FIRST)),
common AS (SELECT max(level) AS c FROM levels WHERE level * weight <= cap),
aims AS (SELECT source, source_size, least(cap, coalesce(c * weight, cap)) AS target,
         greatest(1, ceil(source_size / 16384.0))::BIGINT AS n_blocks FROM levels, common),
placed AS (
  SELECT d.*, source_size, target, CASE WHEN size > 0 THEN
      {_UNIT.format("'42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size")} % n_blocks END AS block,
    {_UNIT.format("'42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size")} AS pos
  FROM d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
docs AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, block ORDER BY pos, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM placed),
blocks AS (SELECT source, block, any_value(source_size) AS source_size, round(any_value(target))::BIGINT AS goal,
  sum(size)::BIGINT AS w FROM docs WHERE size > 0 GROUP BY source, block),
passes AS (SELECT *, unnest(range(0, goal // source_size + 1)) AS epoch FROM blocks),
cut AS (
  SELECT source, block, epoch, least(w, least(source_size, goal - epoch * source_size)
    - coalesce(sum(w) OVER (PARTITION BY source, epoch ORDER BY
      {_UNIT.format("'43|' || coalesce(source, '') || '|' || epoch || '|' || block")}, block
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS use FROM passes),
taken AS (
  SELECT source, block, list(use) AS uses FROM cut WHERE use > 0 GROUP BY source, block)
SELECT doc_id, size, source_size, target,
  coalesce(list_sum(list_transform(uses, lambda u: greatest(0, least(size, u - before)))), 0)::BIGINT AS taken
FROM docs LEFT JOIN taken t ON docs.source IS NOT DISTINCT FROM t.source AND docs.block = t.block"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k::BIGINT AS k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
parts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, a FROM parts),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT p.* FROM parts p LEFT JOIN most m USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
cuts AS (SELECT lang, phrase, k AS size, a, w, unnest(range(1, k)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, c.k,
         ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000"""

SEARCH = rf"""WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
stats AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS all_terms FROM docs WHERE len(w) > 0),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
           FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), stats),
asked AS (SELECT i, item_id, unnest(w) AS t FROM items),
scored AS (
  SELECT i, item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(docs.w) * n_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN docs USING (d), stats GROUP BY i, item_id, d, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50"""

NEAR_SETS = rf"""WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT d, doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM docs),
sized AS (SELECT d, doc_id, len(s) AS n FROM sets),
shingles AS (SELECT d, len(s) AS n, unnest(s) AS s FROM sets),
links AS (
  SELECT x, y FROM (
    SELECT a.d AS x, b.d AS y, a.n AS nx, b.n AS ny, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.d < b.d AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL)
  WHERE 100 * c >= 80 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT d, d AS r FROM sized
  UNION SELECT reach.d, y FROM reach JOIN both_ways ON r = x)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(t.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM min(t.doc_id) AS kept
FROM reach JOIN sized s USING (d) JOIN sized t ON t.d = r GROUP BY s.d, s.doc_id, s.n"""

ORACLE = {
    "op13_setsketch": NEAR_SETS,
    "op11_phrases": PHRASES,
    "op12_search": SEARCH,
    "op1_quality_rules": QUALITY,
    "quality_ablation": ABLATION,
    "op5_preference": PREFERENCE,
    "op8_line_dedup": LINE_DEDUP,
    "op9_mixing": MIXING,
}

"""SQL that DuckDB runs on the same tables, for the queries that it can express."""

from __future__ import annotations

from benchlight.llm import rules, spread

_WORD = r"[^\x20\x09-\x0D]+"
_SMALL = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ENDINGS = ", ".join("'" + e.replace("'", "''") + "'" for e in rules.SENTENCE_END)

RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT id, regexp_extract_all(text, '{_WORD}') AS w FROM docs),
windows AS (
  SELECT id, unnest(range(1, len(w) - 6)) AS i, w FROM tokens WHERE len(w) >= 8),
keyed AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS k FROM windows),
twice AS (
  SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM keyed) WHERE n > 1),
steps AS (SELECT id, lead(i) OVER (PARTITION BY id ORDER BY i) - i AS step FROM twice),
repeats AS (SELECT id, sum(least(8, coalesce(step, 8))) AS n FROM steps GROUP BY id),
lines AS (
  SELECT id, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
    len(regexp_extract_all(line, '{_WORD}'))
      + len(regexp_extract_all(line, '{rules.UNSPACED}')) // {rules.UNSPACED_PER_WORD} AS m,
    right(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ({_ENDINGS}) AS unended
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{_WORD}')),
failing AS (
  SELECT id, line, n,
    (unended AND m < {rules.SHORT_LINE_WORDS})
    OR 2 * len(regexp_extract_all(line, '[#*$%&<>!?~^_=+{{}}\\]')) > m
    OR (len(regexp_extract_all(line, '[|»›•·>]')) >= {rules.MIN_SEPARATORS}
        AND 4 * len(regexp_extract_all(line, '[|»›•·>]')) > m)
    OR (m <= {rules.BOILERPLATE_WORDS} AND regexp_matches({_SMALL}, '{rules.phrase_pattern(rules.BOILERPLATE)}'))
    OR (unended AND m <= {rules.PROMPT_WORDS}
        AND regexp_matches({_SMALL}, '{rules.phrase_pattern(rules.PROMPTS)}')) AS fails
  FROM lines),
dup AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY id),
stay AS (
  SELECT id, count(*) FILTER (fails) AS removed, coalesce(sum(n) FILTER (NOT fails), 0) AS kept_words
  FROM failing GROUP BY id),
measured AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    coalesce(removed, 0) AS lines_removed, coalesce(kept_words, 0) AS kept_words
  FROM docs JOIN tokens USING (id) LEFT JOIN repeats USING (id) LEFT JOIN dup USING (id)
    LEFT JOIN stay USING (id)),
based AS (
  SELECT *, n_words < {rules.MIN_WORDS}
    OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM measured)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - kept_words) <= {rules.MAX_LOST_PERCENT} * n_words AS kept,
  CAST(lines_removed AS BIGINT) AS lines_removed, CAST(kept_words AS BIGINT) AS kept_words
FROM based
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SPREAD = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, source, text FROM documents),
cut AS (
  SELECT id, source, unnest(lines) AS line, unnest(range(len(lines))) AS place
  FROM (SELECT id, source, string_split(text, chr(10)) AS lines FROM docs)),
lines AS (
  SELECT id, place, line, regexp_matches(line, '{_WORD}') AS counts, trim(line, {_BLANKS}) AS body,
    coalesce('s' || source, '') AS site
  FROM cut),
wide AS (
  SELECT body FROM lines WHERE counts GROUP BY body HAVING count(DISTINCT site) >= {spread.MIN_SITES}),
marked AS (SELECT lines.*, counts AND body IN (SELECT body FROM wide) AS goes FROM lines)
SELECT doc_id, CAST(count(*) FILTER (counts) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (goes) AS BIGINT) AS n_removed,
  CASE WHEN any_value(text) IS NOT NULL
    THEN coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '') END AS text
FROM docs LEFT JOIN marked USING (id) GROUP BY id, doc_id
"""

# Sources fill up in the order of cap / weight; the level is the first that closes none.
MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE
    AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
filling AS (
  SELECT *, (SELECT sum(source_size) FROM sources)::DOUBLE * 150 / 100
      - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighted WINDOW o AS (ORDER BY cap / weight, encode(source))),
level AS (
  SELECT remaining, weights FROM filling WHERE weight * remaining <= cap * weights
  ORDER BY cap / weight, encode(source) LIMIT 1),
goals AS (
  SELECT source, source_size, least(weight * remaining / weights, cap) AS target FROM weighted, level),
rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)::DOUBLE
      / 281474976710656.0::DOUBLE AS draw
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size AS BIGINT) * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)
    AS taken
FROM rated
"""

EXACT = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
ranked AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
    first_value(doc_id) OVER best AS keep_id, row_number() OVER best = 1 AS kept
  FROM docs WINDOW best AS (PARTITION BY body ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM ranked
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS w FROM documents),
sized AS (SELECT id, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM sized),
items AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS w FROM benchmark),
asked AS (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, unnest(w) AS term FROM items)),
counted AS (
  SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY id, term),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM counted, totals GROUP BY term, nd),
scored AS (
  SELECT item, item_id, id, doc_id,
    CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nl)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weighed USING (term) JOIN sized USING (id), totals
  GROUP BY item, item_id, id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""

# The checksum of an id's digits, bit by bit: DuckDB has no function for it.
_CRC = """xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
    lambda crc, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)),
    4294967295::BIGINT))"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST,
    substr(sha256(length(role) || ':' || role || text), 1, 32)) AS t
  FROM turns GROUP BY conv_id),
headed AS (SELECT conv_id, conv_id - conv_id % 100 AS base, t, {_CRC} % 6 AS h FROM whole),
built AS (
  SELECT headed.conv_id, coalesce(first.t, [])[1:h] || headed.t[h + 1:] AS t
  FROM headed LEFT JOIN whole AS first ON first.conv_id = base),
prefixes AS (
  SELECT conv_id, d AS depth, t, length(t[d].text) AS chars, len(t) = d AS ends, sha256(CAST(t[1:d] AS VARCHAR)) AS key,
    CASE WHEN d > 0 THEN sha256(CAST(t[1:d - 1] AS VARCHAR)) END AS parent
  FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM built)),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n,
    (count(*) - 1) * coalesce(any_value(chars), 0) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key, depth),
kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
-- Every node under every prefix of its least member.
under AS (
  SELECT above.key, nodes.saved, kids.key IS NULL AS leaf
  FROM nodes JOIN prefixes AS above ON above.conv_id = nodes.conv_id AND above.depth <= nodes.depth
  LEFT JOIN kids ON kids.key = nodes.key),
sums AS (SELECT key, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM under GROUP BY key)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id,
  CAST(nodes.n AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums USING (key) LEFT JOIN kids ON kids.key = nodes.key LEFT JOIN nodes AS up ON up.key = nodes.parent
"""

ORACLES = {
    "op4_site_spread": SPREAD,
    "op5_line_first_rules": RULES,
    "op7_source_mix": MIX,
    "op10_exact_index": EXACT,
    "op12_shared_search": SEARCH,
    "op13_prefix_trie": TRIE,
}

"""SQL counterparts of the registered queries, for an engine that runs them over the same tables."""

from __future__ import annotations

from ticketlens.llm import chat, licenses, url_rules

ORACLE: dict[str, str] = {}

_CONTROL = chat.CONTROL
ORACLE["op1_chat_format"] = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq,
    count(*) OVER (PARTITION BY conv_id) AS n,
    len(regexp_extract_all(text, '{chat.PIECES}')) + {chat.TURN_TOKENS} AS tokens,
    24 + len(replace(replace(regexp_replace(
      role, '([<\\[])(\\\\*)({_CONTROL})', '\\1\\\\\\2\\3', 'g'), '%', '%25'), chr(10), '%0A'))
      + len(regexp_replace(text, '([<\\[])(\\\\*)({_CONTROL})', '\\1\\\\\\2\\3', 'g')) AS chars
  FROM said
), head AS (
  SELECT conv_id, tokens, chars FROM numbered WHERE seq = 1 AND role = 'system' AND n > 1
), placed AS (
  SELECT r.conv_id, r.seq, r.tokens, r.chars, h.chars AS head_chars,
    greatest({chat.BUDGET - chat.HISTORY} - coalesce(h.tokens, 0), 1) AS body,
    coalesce(sum(r.tokens) OVER (PARTITION BY r.conv_id ORDER BY r.seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM numbered r LEFT JOIN head h ON r.conv_id IS NOT DISTINCT FROM h.conv_id
  WHERE NOT (r.seq = 1 AND r.role = 'system' AND r.n > 1)
), windowed AS (
  SELECT *, 2 * (start // body)
    + CASE WHEN (start + tokens - 1) // body > start // body THEN 1 ELSE 0 END AS win FROM placed
), opened AS (
  SELECT conv_id, win, sum(chars) + coalesce(any_value(head_chars), 0) AS chars,
    min(start) AS start FROM windowed GROUP BY conv_id, win
), lengths AS (
  SELECT o.conv_id, o.win, o.chars + coalesce(sum(p.chars), 0) AS chars
  FROM opened o LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
    AND p.start < o.start AND p.start >= o.start - {chat.HISTORY}
  GROUP BY o.conv_id, o.win, o.chars
), formatted AS (
  SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) AS n_windows
  FROM lengths GROUP BY conv_id
), digests AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
    CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), ''))
      AS loss_sha256
  FROM numbered GROUP BY conv_id
)
SELECT d.*, f.formatted_chars, f.n_windows
FROM digests d JOIN formatted f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""

ORACLE["op6_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""

_RULES = ", ".join(
    f"('{r.label}', '{r.keyword}', '{licenses.pattern(r.spec)}', {r.priority}, {r.confidence})"
    for r in licenses.signature_rules())
_BASE = ", ".join(f"('{label}', '{licenses.pattern(spec)}')" for label, spec in licenses.BASE)


def _words(text: str) -> str:
    return f"((len({text}) - len(replace({text}, ' ', ''))) // 2)"


def _starts(pat: str) -> str:
    """Word positions of all matches of a pattern in norm, from 0."""
    return f"""list_transform(generate_series(1, len(regexp_extract_all(norm, {pat}))), lambda k:
      list_sum(list_transform(string_split_regex(norm, {pat})[1:k], lambda x: {_words('x')})) +
      coalesce(list_sum(list_transform(regexp_extract_all(norm, {pat})[1:k - 1],
        lambda x: {_words('x')})), 0))"""


ORACLE["op7_license_scan"] = f"""
WITH gaps AS (
  SELECT doc_id, row_number() OVER () AS row_id, trim(regexp_replace(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{licenses.WORD_GAP}', '  ', 'g')) AS inner_text
  FROM documents
), d AS (
  SELECT doc_id, row_id,
    CASE WHEN inner_text = '' THEN '' ELSE ' ' || inner_text || ' ' END AS norm FROM gaps
), base_rules(label, pat) AS (VALUES {_BASE}),
base_hits AS (
  SELECT row_id, label, unnest({_starts('pat')}) AS start FROM d JOIN base_rules
    ON contains(norm, pat)
), base AS (
  SELECT row_id, count(*) AS n_base, CAST(min(start) AS BIGINT) AS first_word,
    CAST(max(start) AS BIGINT) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels,
    list(DISTINCT label) AS base_list
  FROM base_hits GROUP BY row_id
), rules(label, keyword, pat, priority, confidence) AS (VALUES {_RULES}),
matched AS (
  SELECT row_id, label, priority, confidence, norm, pat FROM d JOIN rules
    ON contains(norm, ' ' || keyword || ' ') AND regexp_matches(norm, pat)
), hits AS (
  SELECT row_id, label, priority, confidence, unnest({_starts('pat')}) AS start,
    unnest(list_transform(regexp_extract_all(norm, pat), lambda x: {_words('x')})) AS width
  FROM matched
), alive AS (
  SELECT * FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits o WHERE o.row_id = h.row_id AND o.start <= h.start
      AND o.start + o.width >= h.start + h.width AND (o.priority > h.priority
      OR o.priority = h.priority AND (o.width > h.width
        OR (o.label, o.confidence) < (h.label, h.confidence))))
), found AS (
  SELECT row_id, list(DISTINCT label) AS list, CAST(max(confidence) AS DOUBLE) AS score
  FROM alive GROUP BY row_id
)
SELECT doc_id, CAST({_words('norm')} AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  first_word, last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []),
    coalesce(found.list, [])))), ',') AS labels,
  coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN base USING (row_id) LEFT JOIN found USING (row_id)
"""


def _pattern_case() -> str:
    """The method's verdict: all patterns, the longest first."""
    rules = sorted(url_rules.METHOD_RULES, key=lambda r: -len(r.spec))
    return "CASE " + " ".join(
        f"WHEN regexp_matches(low, '{r.regex()}') THEN '{r.verdict}'" for r in rules
    ) + " ELSE 'allow' END"


ORACLE["op4_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), u AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%'
      THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%'
      THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  ELSE {_pattern_case()} END AS verdict
FROM r
"""

_ITEM_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE["op9_decontaminate"] = f"""
WITH items AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items
    WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM windows),
d AS (SELECT doc_id, row_number() OVER () AS row_id, {_ITEM_WORDS} AS w FROM documents),
grams AS (
  SELECT row_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM (SELECT row_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes)
), hits AS (
  SELECT row_id, item_id, i, m FROM grams JOIN windows USING (m, gram)
), places AS (
  SELECT row_id, count(*) AS n_hit FROM (
    SELECT DISTINCT row_id, unnest(generate_series(i, i + m - 1)) AS p FROM hits) GROUP BY row_id
), found AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (row_id) LEFT JOIN found USING (row_id)
"""

_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    str_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"""


def _leaf(n_chars: str) -> str:
    values = ["doc_id", "source", "lang", n_chars, "text"]
    parts = [f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS given
  FROM documents
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), built(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM built WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (
  SELECT tree, h, (SELECT count(DISTINCT tree) FROM leaves) AS trees FROM built WHERE n = 1
), upper(tree, level, pos, n, h) AS (
  SELECT -1, 0, tree, trees, h FROM subroots
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM upper WHERE n > 1 GROUP BY tree, level, pos // 2, n
), nodes AS (
  SELECT * FROM built UNION ALL SELECT * FROM upper
), climb(doc_id, leaf, home, tree, level, pos, n, folded, proof) AS (
  SELECT doc_id, leaf, tree, tree, 0, pos, n, given, '' FROM leaves
  UNION ALL
  SELECT c.doc_id, c.leaf, c.home, CASE WHEN c.n > 1 THEN c.tree ELSE -1 END,
    CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.pos // 2 ELSE c.tree END,
    CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE (SELECT max(trees) FROM subroots) END,
    CASE WHEN c.n = 1 THEN c.folded WHEN c.pos % 2 = 0 THEN sha256(c.folded || coalesce(s.h, ''))
      ELSE sha256(s.h || c.folded) END,
    CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || coalesce(s.h, '') END
  FROM climb c LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.tree >= 0 OR c.n > 1
)
SELECT c.doc_id, c.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256,
  c.folded AS folded_root, c.folded = r.h AS verified
FROM climb c JOIN subroots s ON s.tree = c.home
CROSS JOIN (SELECT h FROM upper WHERE n = 1) r
WHERE c.tree = -1 AND c.n = 1
"""

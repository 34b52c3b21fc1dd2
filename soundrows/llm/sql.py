"""DuckDB SQL that must give the rows of the registered queries."""

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
LOWERED = "'abcdefghijklmnopqrstuvwxyz'"
ALPHANUMERIC_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWERED}), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {ALPHANUMERIC_WORDS} AS w FROM documents),
b AS (SELECT item_id, {ALPHANUMERIC_WORDS} AS w FROM benchmark),
starts AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
  FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM starts),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
  FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
grams AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM places),
found AS (SELECT doc_id, item_id, g.n, p FROM grams g JOIN windows x ON g.n = x.n AND g.g = x.g),
hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
BLANK = r"[\x09-\x0D\x20]"
NOT_WORD = r"[^\p{L}\p{N}_]"
#: **Emphasis** without its stars.  RE2 has no look-around, so both widths are spelled out.
EMPHASIS = "|".join(
    rf"\*{{{n}}}([^\x09-\x0D\x20*](?:[^*]*[^\x09-\x0D\x20*])?)\*{{{n}}}" for n in (3, 2)
)


def dense(mark: str, chars: int, line: str = "x") -> str:
    """A mark three times and once in so many characters."""
    count = f"len(regexp_extract_all({line}, '{mark}'))"
    return f"({count} >= 3 AND {count} * {chars} >= length(x) AND regexp_matches(x, '(?s)(?:{mark}.*?){{3}}'))"


def phrases(words: str, others: tuple[str, ...], chars: int) -> str:
    """Phrases as whole words: borders are doubled, so that neighbours do not share one."""
    doubled = f"regexp_replace(lower(x), '({NOT_WORD})', '\\1\\1', 'g')"
    either = words.replace(" ", "  ")
    count = f"len(regexp_extract_all({doubled}, '(?:^|{NOT_WORD})(?:{either})(?:$|{NOT_WORD})'))"
    count += "".join(f" + len(regexp_extract_all(lower(x), '{other}'))" for other in others)
    return f"(({count}) >= 1 AND ({count}) * {chars} >= length(lower(x)))"


SPACED = f"regexp_replace(x, '({BLANK})', '\\1\\1', 'g')"
ARROWS = f"len(regexp_extract_all({SPACED}, '{BLANK}[»›]{BLANK}'))"
FAILING_LINE = " OR ".join((
    "NOT regexp_matches(x, '[.!?…。！？．।॥؟۔։።]')",
    r"(regexp_matches(x, '\p{Lu}{2}') AND NOT regexp_matches(translate(x, 'ªº', ''), '[\p{Ll}\p{Lo}]'))",
    dense("[#*$%&]{2,}", 25, f"regexp_replace(x, '{EMPHASIS}', '\\1\\2', 'g')"),
    dense("[!?]{2,}", 25),
    dense("[|>•]", 25),
    f"({ARROWS} >= 3 AND {ARROWS} * 25 >= length(x) AND NOT regexp_matches(x, '[«‹]'))",
    phrases(
        "licensed under|released under|all rights reserved|privacy policy|terms of use|terms of service"
        "|cookie policy|cookie settings|accept cookies|accept all cookies|enable javascript|requires javascript"
        "|lorem ipsum|subscribe to our",
        ("©", "&copy;"),
        200,
    ),
    phrases("click here|read more|sign in|log in to|powered by", (), 60),
))

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {SPACE_WORDS} AS w,
    string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
m AS (
  SELECT *, list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(translate(text, {SPACES}, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols FROM d),
grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT q) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS q FROM grams JOIN twice USING (doc_id, g))
  GROUP BY doc_id),
v AS (
  SELECT m.doc_id, len(w) AS n_words, word_chars, n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(translate(array_to_string(list_filter(lines, lambda x: NOT ({FAILING_LINE})), ' '), {SPACES}, '')) AS left_chars
  FROM m LEFT JOIN repeated USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_chars >= 0.5 * word_chars AS kept
FROM v
"""

MIX = """
WITH n AS (SELECT source, count(*) AS n_docs, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM documents GROUP BY source),
r AS (
  SELECT source, (SELECT sum(n_docs) FROM n) * weight / (SELECT sum(weight) FROM n) / n_docs AS rate FROM n),
parts AS (
  SELECT doc_id, d.source, rate, greatest(1, CAST(ceil(rate / 16) AS INTEGER)) AS parts
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
draws AS (SELECT DISTINCT doc_id, rate / parts AS mean, unnest(range(1, parts + 1)) AS j FROM parts),
u AS (
  SELECT *, CAST('0x' || substr(md5('20:' || j || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
    / 4503599627370496.0 AS u FROM draws),
cumulative AS (
  SELECT mean, k, sum(exp(-mean) * pow(mean, k) / gamma(k + 1)) OVER (PARTITION BY mean ORDER BY k) AS below
  FROM (SELECT DISTINCT mean FROM draws), range(0, 90) AS t(k)),
counts AS (
  SELECT doc_id, sum(n) AS n
  FROM (SELECT doc_id, j, count(CASE WHEN below <= u THEN 1 END) AS n FROM u JOIN cumulative USING (mean) GROUP BY doc_id, j)
  GROUP BY doc_id),
copies AS (
  SELECT d.*, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INTEGER) AS copy
  FROM documents d JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id)
SELECT *, CAST('0x' || substr(md5('20:place:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), 1, 15) AS BIGINT) AS place
FROM copies
"""

URLS = rf"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UPPER}, {LOWERED}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN regexp_matches(host, '(^|\.)(ads-track|free-bets|spam-farm|casino-win|cheap-pills|adult-x)\.')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((CAST('0x' || substr(hex, 1 + (5 * i) // 4, 2) AS INTEGER)) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM p JOIN g USING (html)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWERED}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have
    FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * both_have >= 75 * (na.n + nb.n - both_have)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n
"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (
  SELECT doc_id, unnest(range(0, n - 49)) AS p,
    unnest(list_transform(range(0, n - 49), lambda i: substr(h, 2 * i + 1, 100))) AS g
  FROM d WHERE n >= 50),
least AS (SELECT g, min(doc_id) AS first FROM starts GROUP BY g),
hit AS (SELECT doc_id, p FROM starts JOIN least USING (g) WHERE first < doc_id),
bytes AS (
  SELECT doc_id, unnest(range(0, n)) AS p, unnest(list_transform(range(0, n), lambda i: substr(h, 2 * i + 1, 2))) AS byte
  FROM d WHERE doc_id IN (SELECT doc_id FROM hit)),
covered AS (
  SELECT b.doc_id, b.p, byte,
    max(CASE WHEN hit.p IS NULL THEN 0 ELSE 1 END)
      OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM bytes b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.p = b.p),
edges AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS begins FROM covered),
sums AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept
  FROM edges GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""

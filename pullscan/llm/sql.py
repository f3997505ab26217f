"""DuckDB SQL for the operators whose whole result SQL can express. The others hold against brute force in the tests."""

from __future__ import annotations

_LISTED = "('ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm')"

#: Rules from the longest to the shortest; no url fits two of the same length.
OP1 = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN len(list_filter(string_split(host, '.'), lambda x: x IN {_LISTED})) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_NUMBERED = r"""
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
)"""

OP6 = rf"""
WITH {_NUMBERED},
windows AS (
  SELECT doc_id, s, list_slice(w, s, s + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS s FROM words)
), firsts AS (SELECT g, min(doc_id) AS d FROM windows GROUP BY g),
later AS (SELECT doc_id, list(s) AS begins FROM windows JOIN firsts USING (g) WHERE doc_id > d GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(begins, lambda s: range(s, s + 13)))) AS x FROM later),
kept AS (
  SELECT doc_id, w, CASE WHEN x IS NULL THEN w ELSE list_filter(list_transform(w, lambda v, i: CASE WHEN list_contains(x, i) THEN NULL ELSE v END), lambda v: v IS NOT NULL) END AS k
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""

OP11 = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s
  FROM rows a JOIN rows b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)
), positives AS (
  SELECT a, b, s FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
), picked AS (
  SELECT p.a AS anchor_id, p.b AS positive_id, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS "rank"
  FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM picked WHERE "rank" <= 3
"""

OP13 = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
    CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS two,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS three, CAST('0x' || h[25:32] AS BIGINT) % 100 AS four
  FROM hashed
), parted AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR three >= 50 THEN 'plain'
         WHEN four < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(one, two)], '') AS p, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m,
    array_to_string(u[greatest(one, two) + 1:n], '') AS s
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parted
"""

ORACLES = {"op1_url_filter": OP1, "op6_substring_dedup": OP6, "op11_hard_negatives": OP11, "op13_fill_in_middle": OP13}

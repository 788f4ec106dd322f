"""SQL for the operators that compare windows and sets of words.

Written from the contracts: windows are joined as texts, sets are compared in full, and components
are walked link by link. Meant for small tables.
"""

from __future__ import annotations

_SPACE_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _numbered(source: str, words: str) -> str:
    return f"SELECT *, row_number() OVER () AS d FROM (SELECT *, {words} AS w FROM {source})"


REPEATS = f"""
WITH docs AS ({_numbered("documents", _SPACE_WORDS.format(text="coalesce(text, '')"))}),
starts AS (SELECT d, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
windows AS (SELECT d, i, array_to_string(w[i:i + 34], ' ') AS t FROM starts),
again AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT d, unnest(range(i, i + 35)) AS k FROM windows SEMI JOIN again USING (t)),
words AS (SELECT d, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs),
kept AS (
  SELECT d, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (d, k) GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (d)"""

NEAR = f"""
WITH RECURSIVE docs AS ({_numbered("documents", _SPACE_WORDS.format(text=_LOWER))}),
sets AS (
  SELECT DISTINCT d, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT d, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT d, count(*) AS n FROM sets GROUP BY d),
shared AS (
  SELECT a.d AS a, b.d AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.d < b.d GROUP BY ALL),
near AS (
  SELECT a, b FROM shared JOIN sizes x ON x.d = a JOIN sizes y ON y.d = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reached(d, r) AS (
  SELECT d, d FROM docs UNION SELECT reached.d, links.b FROM reached JOIN links ON links.a = reached.r),
least AS (SELECT reached.d, min(docs.doc_id) AS component_id FROM reached JOIN docs ON docs.d = reached.r GROUP BY reached.d)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs LEFT JOIN sizes USING (d) JOIN least USING (d)"""

LEAKS = f"""
WITH docs AS ({_numbered("documents", _ALNUM_WORDS.format(text=_LOWER))}),
items AS ({_numbered("benchmark", _ALNUM_WORDS.format(text=_LOWER))}),
wanted AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM wanted),
windows AS (
  SELECT d, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT d, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT d, i, windows.n, item FROM windows JOIN wanted USING (n, t)),
words AS (SELECT d, count(DISTINCT k) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS k FROM hits) GROUP BY d),
found AS (
  SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT d, item FROM hits) GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (d) LEFT JOIN found USING (d)"""

ORACLE = {"op4_substring_dedup": REPEATS, "op5_near_dedup": NEAR, "op8_decontamination": LEAKS}

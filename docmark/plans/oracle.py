"""DuckDB SQL giving the same rows as the queries, for checking only.

Written from the operators' rules, not from their plans: plain windows and joins, no
slices, buckets or sketches.
"""

from __future__ import annotations

from docmark import dims
from docmark.functions import html
from docmark.plans import bindings as b

ORACLE: dict[str, str] = {}


def _q(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _case(key: str, table: dict, default: object = None) -> str:
    arms = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {_q(default)} END"


_WHITE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


# --- shared relations --------------------------------------------------------

MAX = b.LIMITS.max_upload_bytes
_EXT = "CASE {x} WHEN 5 THEN '.csv' WHEN 6 THEN '.json' WHEN 7 THEN '.pdf' WHEN 8 THEN '.docx' WHEN 9 THEN '.exe' ELSE '.txt' END"

UPLOADS = f"""
docs_up AS (
  SELECT *, encode(raw) AS content, octet_length(encode(raw)) AS length FROM (
    SELECT doc_id, 'doc_' || doc_id || {_EXT.format(x='doc_id % 10')} AS filename,
      {_EXT.format(x='doc_id % 10')} AS ext,
      CASE WHEN doc_id % 20 = 7 THEN '%PDF-1.4 '
           WHEN doc_id % 20 IN (6, 8) THEN 'PK' || chr(3) || chr(4) ELSE '' END || text AS raw,
      md5(CAST(doc_id AS VARCHAR)) AS task_id
    FROM documents)),
docs_checked AS (
  SELECT *, {_case('ext', dims.EXTENSION_MIME)} AS mime,
    CASE
      WHEN length > {MAX} THEN 'PayloadTooLargeError'
      WHEN ext = '.exe' THEN 'UnsupportedFileTypeError'
      WHEN ext IN ('.txt', '.csv', '.json') THEN
        CASE WHEN TRY(decode(content[1:512])) IS NULL
               OR starts_with(raw, 'PK' || chr(3) || chr(4)) OR starts_with(raw, '%PDF')
             THEN 'MagicNumberMismatchError' END
      WHEN ext = '.docx' THEN
        CASE WHEN NOT starts_with(raw, 'PK' || chr(3) || chr(4)) THEN 'MagicNumberMismatchError' END
      ELSE CASE WHEN lower(raw[1:4]) <> '%pdf' THEN 'MagicNumberMismatchError' END
    END AS error
  FROM docs_up),
pages_checked AS (
  SELECT page_id, 'page_' || page_id || '.html' AS filename, html AS raw,
    octet_length(encode(html)) AS length, md5('p' || page_id) AS task_id, 'text/html' AS mime,
    CASE
      WHEN octet_length(encode(html)) > {MAX} THEN 'PayloadTooLargeError'
      WHEN TRY(decode(encode(html)[1:512])) IS NULL
        OR starts_with(html, 'PK' || chr(3) || chr(4)) OR starts_with(html, '%PDF')
      THEN 'MagicNumberMismatchError' END AS error
  FROM pages)"""

BATCHED = """
members AS (
  SELECT *,
    CASE WHEN (doc_id // 84) % 2 = 0 THEN md5('b' || (doc_id // 7)) ELSE md5('c' || (doc_id // 12)) END AS batch_id,
    CASE WHEN (doc_id // 84) % 2 = 0 THEN doc_id % 7 ELSE doc_id % 12 END AS pos
  FROM docs_checked)"""

THREATS = """
threat_hashes AS (
  SELECT DISTINCT sha256(raw) AS h FROM docs_up
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""

_INFECTED = "(" + " OR ".join(
    f"contains(raw, {_q(p.decode())})" for p in b.PATTERNS
) + " OR sha256(raw) IN (SELECT h FROM threat_hashes))"

STATUS = f"""
runs AS (
  SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run
  FROM events),
ev AS (
  SELECT md5('u' || user_id || '-' || run) AS task_id, event_id, ts,
    CASE event_type WHEN 'signup' THEN 'init' WHEN 'error' THEN 'fail' ELSE 'advance' END AS op,
    CASE event_type WHEN 'signup' THEN 'UPLOADED' WHEN 'view' THEN 'SCANNING'
      WHEN 'purchase' THEN 'PACKAGING' ELSE 'PARSING' END AS stage,
    CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'SUCCESS'
      WHEN 'error' THEN 'FAILURE' ELSE 'ACTIVE' END AS status,
    CASE event_type WHEN 'error' THEN {_q(b.FAIL_REASON)} END AS error_reason,
    user_id, run
  FROM runs)"""

LATEST = """
last_init AS (
  SELECT task_id, max(row(ts, event_id)) AS o FROM ev WHERE op = 'init' GROUP BY task_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev),
latest AS (
  SELECT r.task_id, r.user_id, r.stage, r.status, r.ts AS updated_at,
    (SELECT max_by(e.error_reason, row(e.ts, e.event_id)) FROM ev e
      WHERE e.task_id = r.task_id AND e.op = 'fail' AND row(e.ts, e.event_id) > i.o) AS error_reason
  FROM ranked r JOIN last_init i ON r.task_id = i.task_id WHERE rn = 1)"""

MEMBERS = """
run_members AS (
  SELECT md5('r' || user_id || '-' || (run // 10)) AS batch_id, run % 10 AS pos, task_id
  FROM ev WHERE op = 'init')"""

FINISHED = """
finished AS (
  SELECT task_id, ts AS finished_at, status FROM (
    SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS rn
    FROM ev WHERE status IN ('SUCCESS', 'FAILURE')) WHERE rn = 1)"""

OUTPUTS = f"""
outputs AS (
  SELECT task_id, 'result_' || task_id[1:8] ||
    CASE WHEN task_id[1:1] < '8' THEN '.md' ELSE '.zip' END AS file_name
  FROM finished WHERE status = 'SUCCESS'
    AND finished_at > (SELECT max(ts) FROM events) - INTERVAL {b.KEEP_S * 14} SECOND)"""

# accepted events by brute force along each task: a recursive walk would be the rule
# itself; here a write lives on if its last init is nearer than any lapse before it
ACCEPTED = """
gaps AS (
  SELECT *, lag(ts) OVER w AS prev FROM ev WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)),
marks AS (
  SELECT *, (op = 'init' OR prev IS NULL OR ts > prev + INTERVAL {ttl} SECOND) AS starts FROM gaps),
islands AS (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (
    PARTITION BY task_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM marks),
accepted AS (
  SELECT * FROM (SELECT *, first_value(op) OVER (
    PARTITION BY task_id, island ORDER BY ts, event_id) AS opener FROM islands)
  WHERE opener = 'init')"""

# lives of tasks: writes with no gap over the TTL between them
_LAST = "(SELECT max(ts) FROM events)"
LIVES = f"""
writes AS (
  SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS nxt, status IN ('SUCCESS', 'FAILURE') AS terminal
  FROM accepted WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL {b.TTL_S} SECOND THEN 1 ELSE 0 END) OVER (
    PARTITION BY task_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM writes),
lives AS (
  SELECT *, stage IS DISTINCT FROM lag(stage) OVER l AS changed,
    count(*) FILTER (WHERE terminal) OVER (
      PARTITION BY task_id, life ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS ended,
    last_value(CASE op WHEN 'fail' THEN coalesce(error_reason, '') WHEN 'init' THEN '' END IGNORE NULLS) OVER (
      PARTITION BY task_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS reason,
    ts + INTERVAL {b.TTL_S} SECOND AS expiry,
    CASE WHEN nxt IS NULL THEN expiry <= {_LAST} ELSE nxt > expiry END AS lapses
  FROM numbered WINDOW l AS (PARTITION BY task_id, life ORDER BY ts, event_id)),
sent AS (
  SELECT task_id, event_id, ts, stage, status, error_reason, n::INTEGER AS emit_no, NULL::VARCHAR AS error
  FROM lives, (VALUES (1), (2)) v(n) WHERE NOT ended AND n <= changed::INT + terminal::INT
  UNION ALL
  SELECT task_id, event_id, expiry, NULL, NULL, NULL, 1, {_q(dims.TASK_NOT_FOUND)}
  FROM lives WHERE NOT ended AND NOT terminal AND lapses)"""

LAYOUT = """
items AS (
  SELECT o_custkey AS doc_id, l_orderkey AS page_no, l_linenumber AS ln, l_partkey AS pk,
    l_suppkey AS sk, l_returnflag AS rf, l_linestatus AS ls
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
boxes AS (
  SELECT doc_id, page_no, ln || '-' || pk || '-' || sk || '-' || rf || '-' || ls AS table_id,
    (ln * 100 + pk % 37)::DOUBLE AS top,
    (ln * 100 + pk % 37)::DOUBLE + (40 + sk % 80)::DOUBLE AS bottom, pk, rf, ls
  FROM items WHERE sk % 3 = 0 AND pk % 11 <> 0),
tables_ordered AS (
  SELECT *, row_number() OVER w - 1 AS table_no, lag(bottom, 1, 0.0) OVER w AS above
  FROM boxes WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY top, table_id)),
layout_pages AS (SELECT o_custkey AS doc_id, o_orderkey AS page_no, 800.0::DOUBLE AS height FROM orders),
ends AS (
  SELECT doc_id, page_no, max_by(bottom, table_no) AS bottom, count(*) AS n
  FROM tables_ordered GROUP BY ALL),
regions AS (
  SELECT doc_id, page_no, table_no * 2 AS ord, above AS top, top AS bottom
  FROM tables_ordered WHERE top > above
  UNION ALL
  SELECT p.doc_id, p.page_no, coalesce(n, 0) * 2, coalesce(e.bottom, 0.0), height
  FROM layout_pages p LEFT JOIN ends e USING (doc_id, page_no)
  WHERE e.n IS NULL OR e.bottom < height),
layout_lines AS (
  SELECT doc_id, page_no, pk * 10 + ln AS line_no, (ln * 100 + sk % 90)::DOUBLE AS top,
    CASE WHEN sk % 7 = 0 THEN '   ' ELSE 'line ' || ln || ' ' || pk END AS text
  FROM items),
placed AS (
  SELECT l.*, r.ord FROM layout_lines l JOIN regions r
    ON l.doc_id = r.doc_id AND l.page_no = r.page_no AND l.top >= r.top AND l.top < r.bottom)"""

ASSETS = """
img AS (
  SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS page_index,
    l_partkey * 1000 + l_suppkey % 1000 AS image_index,
    CASE WHEN l_suppkey % 4 = 0 THEN 'logo.' ELSE 'img' || l_partkey || '.' END
      || (['png', 'JPG', 'gif', 'tiff', 'svg'])[l_partkey % 5 + 1] AS name,
    lower((['png', 'JPG', 'gif', 'tiff', 'svg'])[l_partkey % 5 + 1]) AS extension,
    l_partkey || '|' || l_suppkey AS data
  FROM lineitem),
adocs AS (SELECT o_orderkey AS doc_id, '# Order ' || o_orderkey AS markdown FROM orders)"""


def _html_sql(expr: str) -> str:
    """The conversion chain in DuckDB's syntax, from the same patterns."""
    out = expr

    def sub(pattern: str, to: str) -> None:
        nonlocal out
        to_sql = " || chr(10) || ".join(_q(p) for p in to.split("\n"))
        out = f"regexp_replace({out}, {_q(pattern)}, {to_sql}, 'g')"

    for pattern in html.REMOVED:
        sub(pattern, "")
    for n in range(1, 7):
        sub(rf"(?is)<h{n}(?:\s[^>]*)?>(.*?)</h{n}>", "\n\n" + "#" * n + " \\1\n\n")
    sub(html.LINK, r"[\2](\1)")
    sub(html.STRONG, r"**\1**")
    sub(html.EMPHASIS, r"*\1*")
    sub(html.IMAGE_ALT_FIRST, r"![\1](\2)")
    sub(html.IMAGE_SRC_FIRST, r"![\2](\1)")
    sub(html.IMAGE_NO_ALT, r"![](\1)")
    sub(html.BREAK, "\n")
    sub(html.ITEM, "\n- ")
    sub(html.BLOCK, "\n\n")
    sub(html.TAG, "")
    for entity, char in html.ENTITIES:
        out = f"replace({out}, {_q(entity)}, {_q(char)})"
    sub(r"[ \t]*\n[ \t]*", "\n")
    sub(r"\n{3,}", "\n\n")
    return _strip(out)


def _grid_row(cells: list[str]) -> str:
    clean = [
        _strip(f"replace(replace(replace(coalesce({c}, ''), chr(13), ' '), chr(10), ' '), '|', '\\|')")
        for c in cells]
    return "'| ' || " + " || ' | ' || ".join(clean) + " || ' |' || chr(10)"


_CSV = f"""
(SELECT string_agg(
   '| ' || array_to_string(list_transform(list_resize(string_split(line, ','), w, ''), lambda c:
     {_strip("replace(c, '|', chr(92) || '|')")}), ' | ')
   || ' |' || chr(10) || CASE WHEN n = 1 THEN
     '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' || chr(10)
   ELSE '' END, '' ORDER BY n)
 FROM (SELECT line, n, first(len(string_split(line, ','))) OVER (ORDER BY n) AS w FROM (
   SELECT line, row_number() OVER (ORDER BY i) AS n FROM (
     SELECT unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i)
   WHERE line <> '')))"""


def add(name: str, *ctes: str, select: str) -> None:
    head = "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" if ctes else ""
    ORACLE[name] = head + select.strip()


# --- flagship, sources, sinks ------------------------------------------------

add("pages_to_markdown", UPLOADS, select=f"""
SELECT page_id, mime, error, CASE WHEN error IS NULL THEN {_html_sql('raw')} END AS markdown
FROM pages_checked""")

_FILES = f"""
WITH docs AS (
  SELECT coalesce(doc_id, -1) AS doc_id, coalesce(text, '') AS text, coalesce(n_chars, -1) AS n_chars FROM documents),
numbered AS (SELECT *, CAST(floor(doc_id / {b.FILE_DOCS}) AS BIGINT) AS file FROM docs),
files AS (
  SELECT file, '.txt' AS ext, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS raw
  FROM numbered WHERE file % 3 = 0 GROUP BY file
  UNION ALL
  SELECT file, '.csv', string_agg(doc_id || ',' || n_chars || chr(10), '' ORDER BY doc_id)
  FROM numbered WHERE file % 3 = 1 GROUP BY file
  UNION ALL
  SELECT file, '.json', string_agg('{{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}}' || chr(10), '' ORDER BY doc_id)
  FROM numbered WHERE file % 3 = 2 GROUP BY file)
SELECT file, ext, octet_length(encode(raw)) AS length,
  CASE WHEN octet_length(encode(raw)) > {MAX} THEN {_q(dims.TOO_LARGE)} END AS error,
  CASE WHEN octet_length(encode(raw)) <= {MAX} THEN sha256(raw) END AS sha256 FROM files"""
add("read_uploads", select=_FILES)
add("stream_uploads", select=_FILES)
add("uploads_from_table", UPLOADS, select="""
SELECT doc_id, filename, length, sha256(raw) AS sha256 FROM docs_up""")

_ROUTED = f"""
routed AS (
  SELECT doc_id, task_id, filename, raw, {_case('ext', {'.csv': 'csv', '.json': 'json', '.txt': 'text', '.pdf': 'layout', '.docx': 'cells'})} AS route
  FROM docs_checked WHERE error IS NULL)"""
_DIRECT = f"""CASE route WHEN 'csv' THEN {_CSV} WHEN 'html' THEN {_html_sql('raw')}
  WHEN 'xml' THEN replace(raw, '{b.XML_HEAD}', '<?xml version="1.0"?>') ELSE raw END"""

add("write_standalone", UPLOADS, _ROUTED, select=f"""
SELECT task_id, regexp_replace(filename, '\\.[a-z]+$', '.md') AS file_name, route,
  md5({_DIRECT}) AS content_md5
FROM routed WHERE route NOT IN ('layout', 'cells')""")

_MANIFEST = """
SELECT doc_id, -1::BIGINT AS page_index, -1::BIGINT AS image_index, 'document.md' AS path,
  md5(markdown) AS content_md5 FROM adocs
UNION ALL
SELECT doc_id, first(page_index ORDER BY page_index, image_index),
  first(image_index ORDER BY page_index, image_index), 'images/' || name,
  md5(last(data ORDER BY page_index, image_index))
FROM img GROUP BY doc_id, name"""
add("write_package", ASSETS, select=_MANIFEST)
add("package_manifest", ASSETS, select=_MANIFEST)

add("resolve_status", STATUS, LATEST, select="""
SELECT event_id AS request_id, CASE WHEN l.status IS NULL THEN 404 ELSE 200 END AS http_status,
  l.stage, l.status, l.error_reason FROM ev LEFT JOIN latest l USING (task_id)""")
add("resolve_progress", UPLOADS, BATCHED, select="""
, clean AS (
  SELECT batch_id FROM members GROUP BY batch_id HAVING count(error) = 0)
SELECT 't' || doc_id AS request_id,
  CASE WHEN batch_id NOT IN (SELECT batch_id FROM clean) THEN 'task_not_found' END AS error FROM members
UNION ALL SELECT 'b' || doc_id,
  CASE WHEN batch_id NOT IN (SELECT batch_id FROM clean) THEN 'no_tasks_found' END FROM members
UNION ALL SELECT 'x' || doc_id, 'batch_not_found' FROM members""")
add("resolve_deliveries", STATUS, LATEST, FINISHED, OUTPUTS, select="""
SELECT event_id AS request_id,
  CASE WHEN l.status IS NULL THEN 410 WHEN l.status <> 'SUCCESS' THEN 404
       WHEN o.file_name IS NULL THEN 410 ELSE 200 END AS http_status,
  CASE WHEN l.status = 'SUCCESS' AND o.file_name IS NOT NULL THEN
    CASE WHEN o.file_name LIKE '%.zip' THEN 'application/zip' ELSE 'text/markdown' END END AS media_type,
  CASE WHEN l.status = 'SUCCESS' THEN o.file_name END AS file_name
FROM ev LEFT JOIN latest l USING (task_id) LEFT JOIN outputs o USING (task_id)""")

add("resolve_batch_deliveries", STATUS, LATEST, MEMBERS, select="""
, closed AS (
  SELECT batch_id FROM run_members JOIN latest USING (task_id) GROUP BY batch_id
  HAVING bool_and(status IN ('SUCCESS', 'FAILURE')))
SELECT task_id AS request_id, CASE WHEN c.batch_id IS NULL THEN 404 ELSE 200 END AS http_status,
  CASE WHEN c.batch_id IS NOT NULL THEN 'application/zip' END AS media_type,
  'Batch_Conversion_' || c.batch_id[1:8] || '.zip' AS file_name
FROM run_members m JOIN latest USING (task_id) LEFT JOIN closed c ON m.batch_id = c.batch_id""")

# --- validation --------------------------------------------------------------

add("size_guard", UPLOADS, select=f"""
SELECT doc_id, CASE WHEN length > {b.SMALL_LIMIT} THEN 'PayloadTooLargeError' END AS error FROM docs_up""")

_ODD = """CASE doc_id % 6 WHEN 0 THEN 'Doc.' || doc_id || '.TXT' WHEN 1 THEN '.' || doc_id
  WHEN 2 THEN 'doc' || doc_id WHEN 3 THEN 'doc' || doc_id || '.'
  WHEN 4 THEN '..' || doc_id || '.Pdf' ELSE doc_id || '.tar.gz' END"""
add("file_ext", select="""
SELECT doc_id,
  CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.' || doc_id WHEN 2 THEN ''
    WHEN 3 THEN '.' WHEN 4 THEN '.pdf' ELSE '.gz' END AS ext,
  CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 4 THEN '.pdf' WHEN 5 THEN '.gz' ELSE '' END AS suffix
FROM documents""")

add("supported_type", UPLOADS, select="""
SELECT doc_id, CASE WHEN ext = '.exe' THEN 'UnsupportedFileTypeError' END AS error FROM docs_up""")
add("declared_mime", UPLOADS, select="SELECT doc_id, mime FROM docs_checked")
add("utf8_prefix_ok", UPLOADS, select="""
SELECT doc_id, TRY(decode(content[1:512])) IS NOT NULL AS strict_ok,
  (TRY(decode(content[1:512])) IS NOT NULL OR TRY(decode(content[1:513])) IS NOT NULL
   OR TRY(decode(content[1:514])) IS NOT NULL OR TRY(decode(content[1:515])) IS NOT NULL) AS tolerant_ok
FROM docs_up""")
add("binary_spoof", UPLOADS, select="""
SELECT doc_id, raw LIKE 'PK' || chr(3) || chr(4) || '%' OR starts_with(raw, '%PDF') AS spoofed
FROM docs_up""")
add("zip_container", UPLOADS, select="""
SELECT doc_id, raw LIKE 'PK' || chr(3) || chr(4) || '%' AS is_zip FROM docs_up""")

_MATCH = f"""CASE WHEN starts_with(lower(raw), '%pdf') THEN {_q(dims.PDF)}
  WHEN starts_with(lower(raw), 'pk' || chr(3) || chr(4)) THEN {_q(dims.DOCX)}
  WHEN starts_with(lower(raw), '<?xml') THEN 'application/xml'
  WHEN starts_with(lower(raw), '<html') OR starts_with(lower(raw), '<!doctype') THEN 'text/html'
  WHEN starts_with(raw, '{{') OR starts_with(raw, '[') THEN 'application/json' END"""
add("match_signature", UPLOADS, select=f"""
SELECT task_id, {_MATCH} AS matched FROM docs_up
UNION ALL SELECT task_id, {_MATCH} FROM pages_checked""")
add("validate_uploads", UPLOADS, select="""
SELECT filename, length, mime, error FROM docs_checked
UNION ALL SELECT filename, length, mime, error FROM pages_checked""")

add("batch_size_gate", UPLOADS, BATCHED, select="""
SELECT doc_id, batch_id, CASE WHEN count(*) OVER (PARTITION BY batch_id) > 10
  THEN 'BatchSizeLimitExceededError' END AS error FROM members""")
add("batch_cap", UPLOADS, BATCHED, select="""
SELECT batch_id, doc_id, n > 10 AS truncated FROM (
  SELECT *, count(*) OVER (PARTITION BY batch_id) AS n,
    row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS rn FROM members) WHERE rn <= 10""")
add("batch_first_reject", UPLOADS, BATCHED, select="""
SELECT doc_id, CASE WHEN f IS NULL OR pos < f THEN 'queued' WHEN pos = f THEN 'rejected'
  ELSE 'skipped' END AS outcome, f IS NULL AS recorded
FROM (SELECT *, min(pos) FILTER (WHERE error IS NOT NULL) OVER (PARTITION BY batch_id) AS f FROM members)""")

add("signature_scan", UPLOADS, THREATS, select=f"""
SELECT task_id, 'VirusDetectedError' AS error FROM docs_up WHERE {_INFECTED}""")

add("signature_scan_table", UPLOADS, select=f"""
, patterns AS (SELECT DISTINCT substr(text, 1, {b.PATTERN_CHARS}) AS p FROM benchmark WHERE text <> '')
SELECT doc_id, {_q(dims.VIRUS)} AS error FROM docs_up
WHERE EXISTS (SELECT 1 FROM patterns WHERE contains(raw, p)) OR sha256(raw) IN (
  SELECT sha256(raw) FROM docs_up WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""")
add("scan_verdict", select="""
WITH r AS (
  SELECT user_id AS file_id, event_id AS ord,
    CASE WHEN event_type = 'error' AND value > 150 THEN 'FOUND'
         WHEN event_type = 'signup' AND value > 150 THEN 'ERROR' ELSE 'OK' END AS status FROM events),
bad AS (SELECT file_id, first(status ORDER BY ord) AS s FROM r WHERE status <> 'OK' GROUP BY 1)
SELECT c_custkey AS file_id,
  CASE WHEN c_custkey NOT IN (SELECT file_id FROM r) THEN 'unavailable'
       WHEN s = 'FOUND' THEN 'infected' WHEN s IS NOT NULL THEN 'unavailable' ELSE 'clean' END AS verdict
FROM customer LEFT JOIN bad ON c_custkey = bad.file_id""")

add("resolve_attempts", select="""
WITH a AS (
  SELECT user_id AS file_id,
    CASE event_type WHEN 'error' THEN 't' WHEN 'click' THEN 'p' ELSE 's' END AS o,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT file_id, string_agg(o, '' ORDER BY n) AS seq FROM a WHERE n <= 3 GROUP BY 1)
SELECT file_id,
  CASE WHEN regexp_matches(seq, '^t{0,2}s') THEN 'success'
       WHEN regexp_matches(seq, '^t{0,2}p') OR seq = 'ttt' THEN 'unavailable' ELSE 'pending' END AS verdict,
  length(regexp_extract(seq, '^t{0,2}.'))::BIGINT AS attempts_used,
  CASE WHEN seq LIKE 'tt%' THEN 9 WHEN seq LIKE 't%' THEN 3 ELSE 0 END::BIGINT AS wait_s
FROM s""")

add("reconnect_delays", select="""
WITH g AS (
  SELECT *, sum((event_type <> 'error')::INT) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events),
n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) - 1 AS k
  FROM g WHERE event_type = 'error')
SELECT user_id AS client_id, event_id, k AS retry_no, least(2 ** least(k, 10), 30)::BIGINT AS delay_s FROM n""")

XML = """
xml AS (
  SELECT doc_id, '<?xml version="1.0"?>' ||
    CASE doc_id % 3 WHEN 0 THEN '<!DOCTYPE doc [<!ENTITY x SYSTEM "file:///etc/passwd">]>'
      WHEN 1 THEN '<!DOCTYPE doc>' ELSE '' END || '<doc>' || text || '&x;</doc>' AS raw,
    '<?xml version="1.0"?><doc>' || text || '&x;</doc>' AS bare, text
  FROM documents)"""
add("xml_entity_guard", XML, select="""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'XmlInjectionAttemptError' END AS error,
  CASE WHEN doc_id % 3 <> 0 THEN md5(raw) END AS xml_md5 FROM xml""")

# --- scalar functions --------------------------------------------------------

add("clean_cell", select=f"""
SELECT doc_id, md5({_strip("replace(replace(replace(' ' || chr(9) || ' ' || text || '|' || chr(13) || chr(10) || '  ', chr(13), ' '), chr(10), ' '), '|', chr(92) || '|')")}) AS cell_md5
FROM documents""")
add("grid_to_markdown", select=f"""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE
  '| na\\|me | brand |' || chr(10) || '| --- | --- |' || chr(10)
  || {_grid_row(['p_name', 'p_brand'])} || {_grid_row(['p_name', "''"])}
  || {_grid_row(['p_name', 'p_brand'])} || {_grid_row(["''", "p_type || ' x'"])} END AS markdown
FROM part""")
add("html_to_markdown", select=f"SELECT page_id, {_html_sql('html')} AS markdown FROM pages")
add("text_to_markdown", UPLOADS, select="SELECT doc_id, md5(raw) AS markdown_md5 FROM docs_up")
add("csv_to_markdown", select="""
SELECT o_custkey,
  '| key | priority |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(
    '| ' || o_orderkey || ' | ' || o_orderpriority || ', "' || o_orderstatus || '" |' || chr(10),
    '' ORDER BY o_orderkey) AS markdown
FROM orders GROUP BY 1""")
add("json_to_markdown", select="""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN props[2:] ELSE props END AS markdown,
  json_valid(CASE WHEN event_id % 5 = 0 THEN props[2:] ELSE props END) AS valid FROM events""")
add("xml_to_markdown", XML, select="SELECT doc_id, md5(bare) AS markdown_md5 FROM xml")
add("data_uri", select="""
SELECT doc_id, md5('data:' || CASE doc_id % 8 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg'
  WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/webp' WHEN 5 THEN 'image/bmp'
  WHEN 6 THEN 'image/tiff' ELSE 'application/octet-stream' END
  || ';base64,' || base64(encode(text))) AS uri_md5 FROM documents""")
add("asset_names", select="""
SELECT p_partkey, name, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$')) ELSE 'png' END AS extension
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN p_brand || '.v2.PNG' WHEN 2 THEN p_name
  ELSE 'img_' || p_size || '_' || p_partkey END AS name FROM part)""")
add("output_name", select="""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Doc.' || doc_id WHEN 1 THEN '.' || doc_id
  WHEN 2 THEN 'doc' || doc_id WHEN 3 THEN 'doc' || doc_id || '.' WHEN 4 THEN '..' || doc_id
  ELSE doc_id || '.tar' END || CASE WHEN doc_id % 4 = 0 THEN '.zip' ELSE '.md' END AS output_name
FROM documents""")
add("state_json", STATUS, LATEST, select="""
SELECT task_id, to_json({'task_id': task_id, 'batch_id': NULL::VARCHAR,
  'original_name': 'user_' || user_id || '.txt', 'output_mode': 'standalone',
  'stage': stage, 'status': status, 'error_reason': error_reason})::VARCHAR AS state_json, stage, error_reason
FROM latest""")
add("size_mb", select="SELECT doc_id, round(n_chars * 1000 / 1048576.0, 1)::DOUBLE AS mb FROM documents")

# --- joins -------------------------------------------------------------------

_FAILED = f"""
failed AS (
  SELECT doc_id, CASE WHEN doc_id % 6 = 1 AND e = 'UnsupportedFileTypeError' THEN 'KeyError' ELSE e END AS error
  FROM (SELECT doc_id, CASE WHEN error IS NOT NULL THEN error WHEN {_INFECTED} THEN 'VirusDetectedError'
      WHEN ext IN ('.pdf', '.docx') THEN 'MarkdownCompilationError' END AS e FROM docs_checked)
  WHERE e IS NOT NULL)"""
add("attach_error_info", UPLOADS, THREATS, _FAILED, select=f"""
SELECT doc_id, {_case('error', {k: v[0] for k, v in dims.ERRORS.items()})} AS context,
  {_case('error', {k: v[1] for k, v in dims.ERRORS.items()}, 500)} AS http_status,
  {_case('error', {k: v[2] for k, v in dims.ERRORS.items()}, dims.GENERIC_MESSAGE)} AS user_message
FROM failed""")
add("failure_stage", UPLOADS, THREATS, _FAILED, select=f"""
SELECT doc_id, error,
  CASE WHEN error IN ('VirusDetectedError', 'AntivirusUnavailableError') THEN 'SCANNING'
       WHEN error = 'MarkdownCompilationError' THEN 'PARSING' ELSE 'PACKAGING' END AS stage,
  CASE error WHEN 'VirusDetectedError' THEN {_q(dims.ERRORS['VirusDetectedError'][2])}
    WHEN 'MarkdownCompilationError' THEN {_q(dims.ERRORS['MarkdownCompilationError'][2])}
    ELSE {_q(dims.PIPELINE_MESSAGE)} END AS error_reason
FROM failed""")
add("assign_lines_to_regions", LAYOUT, select="""
SELECT page_no, line_no, top, ord, text FROM placed""")
add("expand_batches", UPLOADS, BATCHED, select="""
SELECT batch_id, pos, task_id, CASE WHEN ext IN ('.pdf', '.docx') THEN 'FAILURE' ELSE 'SUCCESS' END AS status
FROM members WHERE error IS NULL""")
add("successful_outputs", STATUS, LATEST, MEMBERS, FINISHED, OUTPUTS, select="""
SELECT batch_id, task_id, file_name FROM run_members JOIN latest USING (task_id)
JOIN outputs USING (task_id) WHERE status = 'SUCCESS'""")
add("apply_known_tasks", STATUS, ACCEPTED.format(ttl=b.TTL_S), select="""
SELECT task_id, event_id, op FROM accepted WHERE op <> 'init'""")

# --- aggregations ------------------------------------------------------------

add("cells_to_markdown", select="""
WITH r AS (
  SELECT o_custkey AS table_id, o_orderkey AS k,
    CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey::VARCHAR, o_orderstatus]
      WHEN o_orderkey % 5 = 0 THEN [o_orderkey::VARCHAR, o_orderstatus, o_orderpriority, '']
      ELSE [o_orderkey::VARCHAR, o_orderstatus, o_orderpriority] END AS c,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
h AS (SELECT table_id, k AS k0, len(c) AS w FROM r WHERE n = 1)
SELECT table_id, string_agg(
  '| ' || array_to_string(list_resize(c, w, ''), ' | ') || ' |' || chr(10) || CASE WHEN n = 1 THEN
  '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' || chr(10) ELSE '' END,
  '' ORDER BY n) AS markdown
FROM r JOIN h USING (table_id) GROUP BY 1""")
add("frame_to_markdown", select="""
SELECT o_custkey,
  '| o_orderkey | o_orderstatus | o_orderpriority |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |'
  || chr(10), '' ORDER BY o_orderkey) AS markdown
FROM orders GROUP BY o_custkey""")
add("assemble_page", select=f"""
SELECT conv_id AS doc_id, 1 AS page_no,
  md5(string_agg({_strip('text')}, chr(10) || chr(10) ORDER BY turn)) AS text
FROM conversations WHERE turn % 5 <> 3 GROUP BY conv_id""")
add("assemble_document", select="""
SELECT doc_id, md5(coalesce(t, '')) AS markdown_md5 FROM (
  SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)
    FILTER (WHERE (conv_id + turn) % 2 = 0 AND text <> '') AS t
  FROM conversations GROUP BY conv_id)""")
add("inline_assets", ASSETS, select=f"""
SELECT d.doc_id, any_value(markdown) || coalesce(string_agg(
  chr(10) || chr(10) || '![' || name || '](data:'
  || {_case('extension', dims.IMAGE_MIME, dims.DEFAULT_IMAGE_MIME)} || ';base64,' || base64(encode(data)) || ')',
  '' ORDER BY page_index, image_index), '') AS markdown
FROM adocs d LEFT JOIN img USING (doc_id) GROUP BY d.doc_id""")
add("link_assets", ASSETS, select="""
SELECT d.doc_id, any_value(markdown) || coalesce(string_agg(
  chr(10) || chr(10) || '![' || name || '](images/' || name || ')',
  '' ORDER BY page_index, image_index), '') AS markdown
FROM adocs d LEFT JOIN img USING (doc_id) GROUP BY d.doc_id""")
add("batch_manifest", STATUS, LATEST, MEMBERS, FINISHED, OUTPUTS, select="""
SELECT batch_id, 'Batch_Conversion_' || batch_id[1:8] || '.zip' AS archive_name,
  min(pos) AS entry_no, task_id[1:8] || '_' || file_name AS entry_name, max_by(task_id, pos) AS task_id
FROM run_members m JOIN latest USING (task_id) JOIN outputs USING (task_id)
WHERE status = 'SUCCESS' GROUP BY batch_id, m.task_id[1:8] || '_' || file_name, m.task_id""")

_RANK = _case("stage", {s: i for i, s in enumerate(dims.STAGES)}, 0)
add("batch_rollup", STATUS, LATEST, MEMBERS, select=f"""
SELECT batch_id AS task_id,
  CASE WHEN count(*) = count(*) FILTER (WHERE status = 'SUCCESS') THEN 'SUCCESS'
       WHEN count(*) FILTER (WHERE status = 'FAILURE') > 0 THEN 'FAILURE' ELSE 'ACTIVE' END AS status,
  first(stage ORDER BY {_RANK}, pos) AS stage,
  first(error_reason ORDER BY pos) FILTER (WHERE error_reason <> '') AS error_reason
FROM run_members JOIN latest USING (task_id) GROUP BY batch_id""")
BARRIER = """
barrier_members AS (
  SELECT batch_id, finished_at, status, min(i.ts) OVER (PARTITION BY batch_id) + INTERVAL 864000 SECOND AS deadline
  FROM run_members m JOIN (SELECT task_id, ts FROM ev WHERE op = 'init') i USING (task_id)
  LEFT JOIN finished USING (task_id)),
barrier AS (
  SELECT batch_id,
    CASE WHEN bool_or(finished_at IS NULL) OR max(finished_at) > any_value(deadline)
      THEN any_value(deadline) ELSE max(finished_at) END AS closes_at,
    bool_or(finished_at IS NULL) OR max(finished_at) > any_value(deadline) AS timed_out,
    count(*) AS members, count(*) FILTER (WHERE status = 'SUCCESS' AND finished_at <= deadline) AS included
  FROM barrier_members GROUP BY batch_id)"""
add("batch_barrier", STATUS, MEMBERS, FINISHED, BARRIER, select="""
SELECT batch_id, epoch_us(closes_at) AS closes_at, timed_out, members, included FROM barrier""")
add("count_conversions", select="""
SELECT count(*) AS conversions FROM events WHERE event_type = 'purchase'""")
add("count_visitors", select="SELECT count(DISTINCT user_id) AS visitors FROM events")
add("current_stats", select="""
SELECT (SELECT count(DISTINCT user_id) FROM events) AS visitors,
  (SELECT count(*) FROM events WHERE event_type = 'purchase') AS conversions""")

add("kept_counters", select="""
SELECT (SELECT count(DISTINCT user_id) FROM events) AS visitors,
  (SELECT count(*) FROM events WHERE event_type = 'purchase') AS conversions""")

# --- windows -----------------------------------------------------------------

add("latest_state", STATUS, LATEST, select="""
SELECT task_id, stage, status, error_reason, epoch_us(updated_at) AS updated_at FROM latest""")
_LIVED = (STATUS, ACCEPTED.format(ttl=b.TTL_S), LIVES)
_SENT_SELECT = """
SELECT task_id, event_id, stage, status, error_reason, emit_no, error, epoch_us(ts) AS sent_at FROM sent"""


def _beats(key: str, rows: str, order: str) -> str:
    return f"""
, followed AS (
  SELECT *, coalesce(lead(ts) OVER (PARTITION BY {key} ORDER BY {order}),
    {_LAST} + INTERVAL 1 MICROSECOND) AS until FROM {rows}),
beats AS (
  SELECT {key}, event_id, ts, until,
    unnest(generate_series(1, (epoch_us(until) - epoch_us(ts)) // {b.BEAT_S * 1_000_000} + 1)) AS beat_no
  FROM followed WHERE status NOT IN ('SUCCESS', 'FAILURE') AND error IS NULL)
SELECT {key}, event_id, beat_no, epoch_us(ts) + beat_no * {b.BEAT_S * 1_000_000} AS beat_at
FROM beats WHERE epoch_us(ts) + beat_no * {b.BEAT_S * 1_000_000} < epoch_us(until)"""


add("stage_transitions", *_LIVED, select=_SENT_SELECT)
add("heartbeats", *_LIVED, select=_beats("task_id", "sent", "ts, event_id, emit_no"))

# as-of states of every member at every change of its batch, by brute force
_BATCH_SENT = f"""
changes AS (
  SELECT task_id, event_id, ts, 0 AS kind, stage, status, reason FROM lives
  UNION ALL SELECT task_id, event_id, expiry, 1, NULL, NULL, NULL FROM lives WHERE lapses),
spans AS (
  SELECT m.batch_id, m.pos, c.*, row(c.ts, c.event_id, c.kind) AS at,
    lead(row(c.ts, c.event_id, c.kind)) OVER (PARTITION BY c.task_id ORDER BY c.ts, c.event_id, c.kind) AS upto
  FROM changes c JOIN run_members m USING (task_id)),
states_then AS (
  SELECT a.batch_id, a.event_id, a.ts, a.kind, k.pos, k.stage, k.status, k.reason
  FROM spans a LEFT JOIN spans k ON a.batch_id = k.batch_id AND k.kind = 0 AND k.at <= a.at
    AND (k.upto IS NULL OR k.upto > a.at)),
rolled AS (
  SELECT batch_id, event_id, ts, kind,
    CASE WHEN count(pos) = 0 THEN NULL WHEN bool_and(status = 'SUCCESS') THEN 'SUCCESS'
      WHEN bool_or(status = 'FAILURE') THEN 'FAILURE' ELSE 'ACTIVE' END AS status,
    first(stage ORDER BY {_RANK}, pos) AS stage,
    first(reason ORDER BY pos) FILTER (WHERE reason <> '') AS error_reason,
    CASE WHEN count(pos) = 0 THEN {_q(dims.NO_TASKS_FOUND)} END AS error
  FROM states_then GROUP BY ALL),
watched AS (
  SELECT *, lag({{'a': status, 'b': stage, 'c': error_reason}}) OVER w AS prev,
    count(error) OVER (PARTITION BY batch_id ORDER BY ts, event_id, kind
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watch
  FROM rolled WINDOW w AS (PARTITION BY batch_id ORDER BY ts, event_id, kind)),
batch_sent AS (
  SELECT * FROM (SELECT *, count(*) FILTER (WHERE status IN ('SUCCESS', 'FAILURE')) OVER (
      PARTITION BY batch_id, watch ORDER BY ts, event_id, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
    FROM watched)
  WHERE ended = 0 AND {{'a': status, 'b': stage, 'c': error_reason}} IS DISTINCT FROM prev)"""
_BATCH_SELECT = """
SELECT batch_id, event_id, status, stage, error_reason, error, epoch_us(ts) AS sent_at FROM batch_sent"""
add("batch_transitions", *_LIVED, MEMBERS, _BATCH_SENT, select=_BATCH_SELECT)
add("batch_heartbeats", *_LIVED, MEMBERS, _BATCH_SENT, select=_beats("batch_id", "batch_sent", "ts, event_id, kind"))

add("order_tables", LAYOUT, select="""
SELECT doc_id, page_no, table_id, table_no, top, bottom FROM tables_ordered""")
add("text_regions", LAYOUT, select="SELECT doc_id, page_no, ord, top, bottom FROM regions")
add("number_assets", select="""
WITH p AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS page,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_index FROM documents),
w AS (
  SELECT doc_id, page_index, unnest(regexp_extract_all(page, '(\\S*)\\. ', 1)) AS word,
    generate_subscripts(regexp_extract_all(page, '(\\S*)\\. ', 1), 1) - 1 AS image_index FROM p),
n AS (
  SELECT doc_id, page_index, image_index,
    CASE WHEN word = '' THEN 'img_' || page_index || '_' || image_index ELSE word END AS name FROM w)
SELECT doc_id, page_index, image_index, name,
  CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$')) ELSE 'png' END AS extension FROM n""")
_STAGE_ROWS = ", ".join(f"({i}, {_q(s)}, {_q(t)})" for i, (s, t) in enumerate(dims.STAGES.items()))
add("stage_timeline", STATUS, LATEST, select=f"""
SELECT task_id, stage_no, stage_key, label,
  CASE WHEN cur IS NULL THEN 'pending' WHEN stage_no < cur THEN 'done' WHEN stage_no > cur THEN 'pending'
    ELSE CASE status WHEN 'SUCCESS' THEN 'done' WHEN 'ACTIVE' THEN 'active' WHEN 'FAILURE' THEN 'failed'
    ELSE 'none' END END AS mark
FROM (SELECT task_id, status, CASE WHEN task_id >= '1' THEN {_RANK} END AS cur FROM latest),
  (VALUES {_STAGE_ROWS}) s(stage_no, stage_key, label)""")

# --- state and streams -------------------------------------------------------

add("state_ttl", STATUS, select=f"""
SELECT task_id, event_id, epoch_us(least(nxt, ts + INTERVAL {b.TTL_S} SECOND)) AS valid_until,
  nxt IS NULL OR nxt > ts + INTERVAL {b.TTL_S} SECOND AS lapsed
FROM (SELECT *, lead(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS nxt FROM ev)""")
add("retention", STATUS, LATEST, MEMBERS, FINISHED, BARRIER, select=f"""
, ended AS (
  SELECT 'task' AS kind, task_id AS id, status, finished_at FROM finished
  UNION ALL SELECT 'batch', batch_id, 'ARCHIVE', closes_at FROM barrier),
judged AS (
  SELECT *, finished_at + INTERVAL {b.KEEP_S} SECOND > {_LAST} AS kept FROM ended)
SELECT kind, id, status, epoch_us(finished_at) AS finished_at, kept FROM judged
UNION ALL
SELECT 'state', task_id, status, epoch_us(updated_at), true FROM latest
WHERE task_id NOT IN (SELECT id FROM judged WHERE kind = 'task' AND NOT kept)""")
add("stream_transitions", *_LIVED, select=_SENT_SELECT)
add("stream_heartbeats", *_LIVED, select=_beats("task_id", "sent", "ts, event_id, emit_no"))
add("stream_rollup", *_LIVED, MEMBERS, _BATCH_SENT, select=_BATCH_SELECT)
add("stream_validate", UPLOADS, select="SELECT doc_id, mime, error FROM docs_checked")

# --- whole pipeline ----------------------------------------------------------

#: crc32 of ``crc_of``, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(8 * strlen(crc_of)),
    lambda i: (ascii(substr(crc_of, CAST(i // 8 + 1 AS INTEGER), 1)) >> CAST(i % 8 AS INTEGER)) & 1)),
    lambda c, v: CASE WHEN xor(c, v) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_ALL_ROUTED = f"""
all_files AS (
  SELECT task_id, filename, raw, error, {_case('ext', {'.csv': 'csv', '.json': 'json', '.txt': 'text', '.pdf': 'layout', '.docx': 'cells'})} AS route
  FROM docs_checked
  UNION ALL SELECT task_id, filename, raw, error, 'html' FROM pages_checked
  UNION ALL SELECT task_id, filename, raw, error, route FROM items_checked)"""
ITEMS = f"""
items AS (
  SELECT item_id, text, {_CRC32} % 3 AS kind FROM (SELECT *, CAST(item_id AS VARCHAR) AS crc_of FROM benchmark)),
items_checked AS (
  SELECT md5('i' || item_id) AS task_id, 'item_' || item_id || {_case('kind', {0: '.htm', 1: '.xlsx', 2: '.xml'})} AS filename,
    {_case('kind', {0: 'html', 1: 'cells', 2: 'xml'})} AS route, NULL::VARCHAR AS error,
    CASE kind WHEN 0 THEN '<p>' || text || '</p>' WHEN 1 THEN 'PK' || chr(3) || chr(4) || text
      ELSE '{b.XML_HEAD}<item>&who; ' || text || '</item>' END AS raw
  FROM items)"""
add("route_by_type", UPLOADS, ITEMS, _ALL_ROUTED, select=f"""
SELECT task_id, route,
  CASE WHEN route IN ('layout', 'cells') THEN 'MarkdownCompilationError' END AS error,
  CASE WHEN route NOT IN ('layout', 'cells') THEN md5({_DIRECT}) END AS markdown_md5
FROM all_files WHERE error IS NULL""")

add("assemble_layout", LAYOUT, select=f"""
, region_text AS (
  SELECT doc_id, page_no, ord, {_strip("string_agg(text, chr(10) ORDER BY top, line_no)")} AS text
  FROM placed GROUP BY ALL),
parts AS (
  SELECT doc_id, page_no, ord, text FROM region_text WHERE text <> ''
  UNION ALL
  SELECT doc_id, page_no, table_no * 2 + 1, '| part | flag\\|status |' || chr(10) || '| --- | --- |' || chr(10)
    || '| ' || pk || ' | ' || rf || ' ' || ls || ' |' FROM tables_ordered),
page_text AS (
  SELECT doc_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM parts GROUP BY ALL),
doc_text AS (
  SELECT doc_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_no) AS markdown
  FROM page_text GROUP BY ALL)
SELECT doc_id, coalesce(markdown, '') AS markdown, NULL::VARCHAR AS error
FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders) LEFT JOIN doc_text USING (doc_id)""")

_CORPUS = f"""
decoded AS (
  SELECT md5(CAST(conv_id * 10 + CASE WHEN conv_id % 2 = 0 THEN 7 ELSE 8 END AS VARCHAR)) AS task_id,
    string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS dtext
  FROM conversations GROUP BY conv_id),
said AS (
  SELECT md5(CAST(doc_id AS VARCHAR)) AS task_id, n_chars % 101 AS odd,
    CASE WHEN doc_id % 100 = 7 THEN 'PdfImageExtractionError' WHEN doc_id % 50 = 7 THEN 'KeyError' END AS lost
  FROM documents),
{{name}} AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'intake' WHEN {_INFECTED} THEN 'scan'
    WHEN {{stops}} AND odd = 0 THEN 'scan' WHEN {{stops}} AND odd = 1 THEN 'unavailable'
    WHEN {{stops}} AND odd = 2 THEN 'pending'
    WHEN route IN ('layout', 'cells') AND dtext IS NULL THEN 'parse'
    WHEN {{stops}} AND lost = 'KeyError' THEN 'lost' WHEN {{stops}} AND lost IS NOT NULL THEN 'images'
    ELSE 'done' END AS phase
  FROM all_files LEFT JOIN decoded USING (task_id) LEFT JOIN said USING (task_id))"""
_CORPUS_BASE = (UPLOADS, THREATS, ITEMS, _ALL_ROUTED, _CORPUS.format(name="corpus", stops="true"))
_CORPUS_PLAIN = _CORPUS.format(name="corpus", stops="false")
add("convert_corpus", *_CORPUS_BASE, select=f"""
SELECT task_id, route, regexp_replace(filename, '\\.[a-z]+$', '.md') AS output_name,
  md5(CASE WHEN route IN ('layout', 'cells') THEN dtext ELSE {_DIRECT} END) AS markdown_md5
FROM corpus WHERE phase = 'done'""")
_PHASE_ERROR = """CASE phase WHEN 'intake' THEN error WHEN 'scan' THEN 'VirusDetectedError'
  WHEN 'unavailable' THEN 'AntivirusUnavailableError' WHEN 'parse' THEN 'MarkdownCompilationError' ELSE lost END"""
add("corpus_failures", *_CORPUS_BASE, select=f"""
SELECT task_id, CASE WHEN phase = 'unavailable' THEN 'scan' WHEN phase IN ('images', 'lost') THEN 'assets' ELSE phase END AS phase,
  {_PHASE_ERROR} AS error FROM corpus WHERE phase NOT IN ('done', 'pending')""")
# an image that cannot be extracted is an unexpected error of the pipeline
_IMAGES = ("PACKAGING", dims.PIPELINE_MESSAGE)
add("corpus_status_events", *_CORPUS_BASE, select=f"""
, steps(phase, seq, op, stage, status, error_reason) AS (VALUES
  ('done', 0, 'init', 'UPLOADED', 'PENDING', NULL), ('done', 1, 'advance', 'SCANNING', 'ACTIVE', NULL),
  ('done', 2, 'advance', 'PARSING', 'ACTIVE', NULL), ('done', 3, 'advance', 'RESOLVING_ASSETS', 'ACTIVE', NULL),
  ('done', 4, 'advance', 'PACKAGING', 'ACTIVE', NULL), ('done', 5, 'advance', 'PACKAGING', 'SUCCESS', NULL),
  ('scan', 0, 'init', 'UPLOADED', 'PENDING', NULL), ('scan', 1, 'advance', 'SCANNING', 'ACTIVE', NULL),
  ('scan', 2, 'fail', 'SCANNING', 'FAILURE', {_q(dims.ERRORS['VirusDetectedError'][2])}),
  ('unavailable', 0, 'init', 'UPLOADED', 'PENDING', NULL), ('unavailable', 1, 'advance', 'SCANNING', 'ACTIVE', NULL),
  ('unavailable', 2, 'fail', 'SCANNING', 'FAILURE', {_q(dims.ERRORS['AntivirusUnavailableError'][2])}),
  ('pending', 0, 'init', 'UPLOADED', 'PENDING', NULL), ('pending', 1, 'advance', 'SCANNING', 'ACTIVE', NULL),
  ('images', 0, 'init', 'UPLOADED', 'PENDING', NULL), ('images', 1, 'advance', 'SCANNING', 'ACTIVE', NULL),
  ('images', 2, 'advance', 'PARSING', 'ACTIVE', NULL), ('images', 3, 'advance', 'RESOLVING_ASSETS', 'ACTIVE', NULL),
  ('images', 4, 'fail', {_q(_IMAGES[0])}, 'FAILURE', {_q(_IMAGES[1])}),
  ('lost', 0, 'init', 'UPLOADED', 'PENDING', NULL), ('lost', 1, 'advance', 'SCANNING', 'ACTIVE', NULL),
  ('lost', 2, 'advance', 'PARSING', 'ACTIVE', NULL), ('lost', 3, 'advance', 'RESOLVING_ASSETS', 'ACTIVE', NULL),
  ('lost', 4, 'fail', 'PACKAGING', 'FAILURE', {_q(dims.PIPELINE_MESSAGE)}),
  ('parse', 0, 'init', 'UPLOADED', 'PENDING', NULL), ('parse', 1, 'advance', 'SCANNING', 'ACTIVE', NULL),
  ('parse', 2, 'advance', 'PARSING', 'ACTIVE', NULL),
  ('parse', 3, 'fail', 'PARSING', 'FAILURE', {_q(dims.ERRORS['MarkdownCompilationError'][2])}))
SELECT task_id, seq, op, stage, status, error_reason FROM corpus JOIN steps USING (phase)""")
add("convert_batches", UPLOADS, THREATS, BATCHED, ITEMS, _ALL_ROUTED, _CORPUS_PLAIN, select="""
, good AS (
  SELECT batch_id FROM members GROUP BY batch_id
  HAVING count(*) <= 10 AND count(*) FILTER (WHERE error IS NOT NULL) = 0)
SELECT batch_id, 'Batch_Conversion_' || batch_id[1:8] || '.zip' AS archive_name, pos AS entry_no,
  task_id[1:8] || '_' || regexp_replace(c.filename, '\\.[a-z]+$', '.zip') AS entry_name, task_id
FROM corpus c JOIN (SELECT task_id, batch_id, pos FROM members) m USING (task_id) JOIN good USING (batch_id)
WHERE phase = 'done'""")
add("convert_corpus_package", *_CORPUS_BASE, select=f"""
, texts AS (
  SELECT *, regexp_replace(filename, '\\.[a-z]+$', '.zip') AS output_name,
    CASE WHEN route IN ('layout', 'cells') THEN dtext ELSE {_DIRECT} END AS text
  FROM corpus WHERE phase = 'done'),
images AS (
  SELECT md5(CAST(doc_id AS VARCHAR)) AS task_id, i, 'img' || CASE i WHEN 1 THEN md5(CAST(doc_id AS VARCHAR))[1:1] ELSE '0' END || '.png' AS name
  FROM documents, (VALUES (0), (1)) v(i) WHERE doc_id % 10 = 7),
linked AS (
  SELECT task_id, string_agg(chr(10) || chr(10) || '![' || name || '](images/' || name || ')', '' ORDER BY i) AS links
  FROM images GROUP BY task_id),
files AS (
  SELECT task_id, 'images/' || name AS path, min(i) AS first, max(i) AS last FROM images GROUP BY ALL)
SELECT task_id, output_name, -1::BIGINT AS page_index, -1::BIGINT AS image_index, 'document.md' AS path,
  md5(text || coalesce(links, '')) AS data_md5
FROM texts LEFT JOIN linked USING (task_id)
UNION ALL
SELECT task_id, output_name, 0, first, path, md5(task_id || last) FROM texts JOIN files USING (task_id)""")
add("convert_batches_in_time", UPLOADS, THREATS, BATCHED, ITEMS, _ALL_ROUTED, _CORPUS_PLAIN, select=f"""
, good AS (
  SELECT batch_id FROM members GROUP BY batch_id
  HAVING count(*) <= 10 AND count(*) FILTER (WHERE error IS NOT NULL) = 0),
times AS (
  SELECT md5(CAST(doc_id AS VARCHAR)) AS task_id, 1700000000000000 + doc_id * 1000000 AS begun,
    1700000000000000 + doc_id * 1000000 + n_chars * 100000 AS ended FROM documents),
closed AS (
  SELECT batch_id, least(max(ended), min(begun) + {b.LIMITS.barrier_timeout_s} * 1000000) AS closes_at,
    max(ended) > min(begun) + {b.LIMITS.barrier_timeout_s} * 1000000 AS timed_out
  FROM members JOIN good USING (batch_id) JOIN times USING (task_id) GROUP BY batch_id)
SELECT batch_id, 'Batch_Conversion_' || batch_id[1:8] || '.zip' AS archive_name, pos AS entry_no,
  task_id[1:8] || '_' || regexp_replace(c.filename, '\\.[a-z]+$', '.md') AS entry_name, task_id,
  closes_at, timed_out, closes_at + {b.LIMITS.retention_s} * 1000000 AS purge_at
FROM corpus c JOIN (SELECT task_id, batch_id, pos FROM members) m USING (task_id) JOIN closed USING (batch_id)
JOIN times USING (task_id) WHERE phase = 'done' AND ended <= closes_at""")
